import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs(spark):
    import odd

    from tickscope.llm.common import prepare
    prepare(spark)
    return odd.documents(spark).repartition(3).checkpoint()
