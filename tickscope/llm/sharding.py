"""Sharding by proportional stratified interleaving, in DataFrame operations only.

The rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is
(2 rank - 1) / (2 rows of its source). Sorted by it, every stretch of the corpus holds the
sources in the proportions of the whole, so cutting the order into equal runs gives shards whose
row counts differ by at most one and whose mixture matches the corpus (law ``rows``).

Ranks are exact for sources of any size: rows fall into BUCKETS hash buckets a source, and into as
many buckets of fractional rank (prefix.py), each ranked in a task of its own. Texts are
read once, for their size and crc; only ids, sources and hashes move. At 10 ** 10 rows in one
source a bucket has 2.4 million rows.

Nulls: a null source is a source of its own, a null id hashes as a value of its own, a null text
has no bytes (crc32 0). Rows alike in id and text are still dealt one by one. An empty table gives
an empty result. Equal texts are not kept together: the strata are the sources. Columns other than
those named (and ``keep``) are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col
from .prefix import running

#: Buckets a source, and buckets of the whole order: 16 ** 3, three digits of the hash.
BUCKETS = 4096


def shuffle_hash(seed: str, id_value: Column, text: Column) -> Column:
    """32 hexadecimal digits that order rows at random but alike in every run."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_value.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          seed: str = "shard", keep: Sequence[str] = ()) -> DataFrame:
    """(id, source, size, text_crc32, law, shard, slot, ``keep``): size is the text's UTF-8 bytes plus 8; slots are gapless from 0 in each shard."""
    text = F.coalesce(col(text_col), F.lit(""))
    names = [id_col, source_col, *keep]
    parts = [col(c).alias(f"c{i}") for i, c in enumerate(names)]
    rows = docs.select(*parts, (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
                       source_key(col(source_col)).alias("stratum"), shuffle_hash(seed, col(id_col), col(text_col)).alias("u"))
    rows = rows.withColumn("bucket", F.conv(F.substring("u", 1, 3), 16, 10).cast("int")).checkpoint()
    total = rows.count()
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    ranked = running(rows, "stratum", "bucket", [F.col("u"), F.col("crc")], F.lit(1), "rank").drop("bucket").join(sizes, "stratum")
    at = (2 * F.col("rank") - 1) / (2 * F.col("n")).cast("double")
    ranked = ranked.select(*[f"c{i}" for i in range(len(names))], "size", "crc", "u", at.alias("at"), F.floor(at * BUCKETS).cast("int").alias("bucket"), F.lit(0).alias("all")).checkpoint()
    placed = running(ranked, "all", "bucket", [F.col("at"), F.col("u"), F.col("crc")], F.lit(1), "place")
    number = F.expr(f"int((place - 1) * {shards}L div {max(1, total)}L)")
    slot = F.expr(f"place - 1 - (shard * {total}L + {shards - 1}L) div {shards}L")
    return (placed.withColumn("shard", number).withColumn("slot", slot)
            .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot"))
