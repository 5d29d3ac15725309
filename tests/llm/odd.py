"""Documents with every odd case: nulls, empty and long texts, repeated rows, ties, extra columns with names used inside."""

from pyspark.sql import types as T

#: Extra columns whose names the operators use themselves.
EXTRA = ["id", "key", "u", "size", "bucket", "stratum", "copies", "rank", "block", "lang_pred", "SCORE", "a.b"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       *[T.StructField(c, T.StringType()) for c in EXTRA]])

PASSAGE = " ".join(f"passage{i}" for i in range(60))


def long_text(n: int, salt: str) -> str:
    return " ".join(f"{salt}{i * 7919 % 5003}" for i in range(n))


ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, "b"), (4, "one two three", "en", "b"), (5, "one two three", "en", None),
    (None, "no id here at all in this row", "en", "a"), (None, None, None, None), (6, long_text(30_000, "w"), "en", "a"), (7, long_text(30_000, "w") + " tail", "en", "c"),
    (8, "start " + PASSAGE + " end here", "en", "c"), (9, "other begin " + PASSAGE + " and more", "en", "c"), (10, PASSAGE, "de", "a"),
    (11, "same row twice in the table", "en", "a"), (11, "same row twice in the table", "en", "a"), (12, "id twice first", "fr", "b"), (12, "id twice second text", "fr", "b"),
    (13, "éàü ñandú größe\nline two\nline two\n\nline three", "es", "d"), (14, "4111 1111 1111 1111 and a.b@c.de", "en", "d"), (15, "12345 !!! 678", "en", "d"),
    *[(20 + i, "hot line that all share\n" + f"own line {i} " + "again and again " * 30, "en", f"s{i % 7}") for i in range(40)],
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()
