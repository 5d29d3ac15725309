"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets: the sources, in order of code points (null last), weigh ``weights`` in turn and share
``share`` of all words; no target passes ``most`` times its source's words, and what a capped source
leaves goes to the others by weight. That is one water level: sorted by cap / weight, the sources
below the level get their cap, the others level x weight.

Documents: a source that needs ``rate`` copies of its words takes floor(rate) whole copies of every
document for certain. The rest, ``wanted`` words, is a Pareto order sample with unequal inclusion: a document's
inclusion is p = scale x its measure (its words, or ``inclusion_col``), the scale being such that the
inclusions times the words sum to ``wanted``. Documents of p >= 1 are taken for certain and the scale is set anew for
the others, until none is left above: one water level over the measures. The others are ranked by random odds over
inclusion odds, u / (1 - u) / (p / (1 - p)), and the sample is the start of that order whose words come nearest to what
is still wanted. So each source ends within half a document (of those not certain) of its target.

Measures are whole numbers of which the five leading binary digits count, at most about a thousand values a source,
so the scale of a source of any size is found from that many sums. A measure that is a fraction counts in 65,536ths.

The random number is a hash of id and text, so reruns agree. The cut of a source is one pair (rank
value, hash), found with bucketed running sums (prefix.py): a hot source is split over BUCKETS tasks,
and the decision comes back to the documents as one row a source, not one row a document.

Nulls: a null source is a source of its own, a null text has 0 words (taken 0), a null or
non-positive inclusion counts as 1, as does a document without words. A source without words has target 0. Rows alike in id and text
are taken together. An empty table gives an empty result. Columns of any name pass through mixed().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, fresh
from .prefix import running
from .sharding import shuffle_hash, source_key

#: Rank values fall into buckets of 1/256 of a power of two: the fullest holds less than a thousandth of a source.
BUCKETS, STEPS = 16384, 256
#: Leading binary digits of a measure that count.
DIGITS = 5
#: Up to this many sources (one short row each) their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(hash_hex: Column) -> Column:
    """A number strictly between 0 and 1 from the first 13 digits of a hash."""
    return (F.conv(F.substring(hash_hex, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source (``stratum``, ``source``, ``words``): its ``target`` words. One row a source goes through one task."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    t = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("cap", F.col("words") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    earlier, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("words").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0)))
    t = t.withColumn("level", level).withColumn("open", F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level"))))
    water = F.min("open").over(everything)["level"]
    return t.select("stratum", "words", F.when(water.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), water * F.col("w"))).alias("target"))


def rank_value(u: Column, p: Column) -> Column:
    """Random odds divided by inclusion odds."""
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return u / (1 - u) / (p / (1 - p))


def leading(measure: Column) -> Column:
    """A positive whole number with all binary digits but the first DIGITS set to 0."""
    drop = F.greatest(F.length(F.bin(measure)) - F.lit(DIGITS), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", measure, drop), drop)


def _measure(size: Column, inclusion_col: str | None) -> Column:
    if inclusion_col is None:
        return leading(F.greatest(size, F.lit(1)))
    given = col(inclusion_col).cast("double")
    usable = F.when((given > 0) & ~F.isnan(given), F.least(given, F.lit(float(1 << 40)))).otherwise(1.0)
    return leading(F.greatest(F.floor(usable * 65536), F.lit(1)))


def scales(rows: DataFrame, per: DataFrame) -> DataFrame:
    """(stratum, scale, top, sure): p = scale x measure for measures up to ``top``; the larger ones, of ``sure`` words, are certain."""
    classes = rows.filter("size > 0").groupBy("stratum", "measure").agg(F.sum("size").alias("own"), F.sum(F.col("size").cast("decimal(38,0)") * F.col("measure")).alias("mass"))
    larger = Window.partitionBy("stratum").orderBy(F.col("measure").desc())
    # at most a thousand rows a source
    summed = classes.select("stratum", "measure", F.coalesce(F.sum("own").over(larger.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sure"),
                            F.sum("mass").over(larger.rowsBetween(0, Window.unboundedFollowing)).cast("double").alias("mass"))
    leveled = summed.join(_small(per.filter("lam > 0").select("stratum", "wanted")), "stratum").withColumn("scale", (F.col("wanted") - F.col("sure")) / F.col("mass"))
    open_ = leveled.filter(F.col("scale") * F.col("measure") < 1)
    return open_.groupBy("stratum").agg(F.max(F.struct("measure", "scale", "sure")).alias("m")).select("stratum", F.col("m.scale").alias("scale"), F.col("m.measure").alias("top"), F.col("m.sure").alias("sure"))


def plan(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """What each source does: (stratum, words, target, whole, lam, scale, top, cut) from rows (stratum, source, size, u, measure).

    A document's copies are ``whole``, and one more if its measure is above ``top`` or (rank value, u) is at most ``cut``.
    """
    sizes = rows.groupBy("stratum").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    rate = F.col("target") / F.col("words")
    per = targets(sizes, weights, share, most).withColumn("whole", F.when(F.col("words") > 0, F.floor(rate)).otherwise(0).cast("int"))
    per = per.withColumn("lam", F.when(F.col("words") > 0, rate - F.col("whole")).otherwise(0.0)).withColumn("wanted", F.col("target") - F.col("whole") * F.col("words")).checkpoint()
    per = per.join(scales(rows, per), "stratum", "left").checkpoint()
    # certain documents need no order
    ranked = rows.join(_small(per.select("stratum", "lam", "scale", "top")), "stratum").filter(F.col("measure") <= F.col("top"))
    ranked = ranked.withColumn("q", rank_value(uniform(F.col("u")), F.col("scale") * F.col("measure")))
    # near the source's mean inclusion, log2 of the rank value lies within a few units of that of its odds
    place = F.floor((F.log2("q") + F.log2(F.col("lam") / (1 - F.col("lam"))) + F.lit(BUCKETS / STEPS / 2)) * STEPS)
    bucket = F.least(F.greatest(place, F.lit(0)), F.lit(BUCKETS - 1)).cast("int")
    ranked = ranked.select("stratum", "size", "u", "q", bucket.alias("bucket")).checkpoint()
    summed = running(ranked, "stratum", "bucket", [F.col("q"), F.col("u")], F.col("size"), "until")
    taken = summed.join(_small(per), "stratum").filter(F.col("until") - F.col("size") / 2 <= F.col("wanted") - F.col("sure"))
    cuts = taken.groupBy("stratum").agg(F.max(F.struct("q", "u")).alias("cut"))
    return per.join(cuts, "stratum", "left")


def _small(per_source: DataFrame) -> DataFrame:
    return F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source


def sample(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source", inclusion_col: str | None = None, seed: str = "mix", keep: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """``docs`` with four more columns, and their names: size (words), source size, target, copies.

    With ``keep`` only these columns of ``docs`` come along, and the texts are read once.
    """
    size, stratum, u, measure, *own = fresh(docs, "size", "stratum", "u", "measure", "source_size", "target", "copies", "lam", "whole", "scale", "top", "cut")
    wide = docs.withColumns({size: word_count(col(text_col)), stratum: source_key(col(source_col)), u: shuffle_hash(seed, col(id_col), col(text_col))})
    wide = wide.withColumn(measure, _measure(F.col(size), inclusion_col))
    source, = fresh(wide, "own_source")
    if keep is not None:
        wide = wide.select(*[col(c) for c in keep], col(source_col).alias(source), size, stratum, u, measure).checkpoint()
    named = wide if keep is not None else wide.withColumn(source, col(source_col))
    rows = named.select(F.col(stratum).alias("stratum"), F.col(source).alias("source"), F.col(size).alias("size"), F.col(u).alias("u"), F.col(measure).alias("measure"))
    rows = rows if keep is not None else rows.checkpoint()
    source_size, target, copies, lam, whole, scale, top, cut = own
    per = plan(rows, weights, share, most).checkpoint()
    per = _small(per.select(F.col("stratum").alias(stratum), F.col("words").alias(source_size), F.col("target").alias(target), F.col("whole").alias(whole),
                            F.col("scale").alias(scale), F.col("top").alias(top), F.col("cut").alias(cut)))
    mine = F.struct(rank_value(uniform(F.col(u)), F.col(scale) * F.col(measure)).alias("q"), F.col(u).alias("u"))
    out = wide.join(per, stratum).withColumn(copies, F.col(whole) + F.when((F.col(measure) > F.col(top)) | (mine <= F.col(cut)), 1).otherwise(0))
    names = [size, source_size, target, copies]
    return out.select(*[col(c) for c in (docs.columns if keep is None else keep)], *names), names


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    out, (_, _, _, copies) = sample(docs, **options)
    each, = fresh(out, "each")
    return out.filter(F.col(copies) > 0).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[col(c) for c in docs.columns])
