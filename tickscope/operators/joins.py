"""Join helpers: a side is broadcast only if its own row count is known and small.

``n_rows`` must bound the rows of the small side itself: a table fitted on the same bars has one row a series of
those bars. Stored models, which may hold more series, are joined without a hint (see live.score_rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest per-series table we broadcast (estimated bytes = rows x row width); above
# it the join shuffles and AQE splits skewed partitions.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def row_width(schema: T.StructType, items: int = 64) -> int:
    """Rough in-memory width of a row; arrays hold ``items`` elements."""
    def width(dt: T.DataType) -> int:
        if isinstance(dt, T.ArrayType):
            return 16 + items * width(dt.elementType)
        if isinstance(dt, T.StructType):
            return 16 + sum(width(f.dataType) for f in dt.fields)
        return 32 if isinstance(dt, T.StringType) else 8
    return width(schema)


def join_small(big: DataFrame, small: DataFrame, on, n_rows: int | None, how: str = "inner",
               max_bytes: int = BROADCAST_MAX_BYTES, items: int = 64) -> DataFrame:
    """Join a per-series table (at most ``n_rows`` rows, a counted bound, with arrays of ``items`` elements) onto a large one."""
    if n_rows is not None and n_rows * row_width(small.schema, items) <= max_bytes:
        small = F.broadcast(small)
    return big.join(small, on, how)
