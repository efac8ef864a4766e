"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each exact budget.

Each document gets a hash-random key. A source's key range is cut into as many equal ranges as its row count
asks for, so a source with a third of all rows is spread like the rest. Sums by range, a running sum over the
ranges in two levels and a running sum inside each range make the prefix sum of a document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import body, join_counted, materialize, sums_before

#: A word is a maximal run of characters other than space and the five ASCII controls from tab to return.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


#: The order of a source's documents: random by the key, then fixed.
ORDER = ("key", "doc_id", "size")


def hash_key(ident: Column, seed: int) -> Column:
    """A number from 0 to 2^32 - 1 that is fixed for equal values."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), ident)), 1, 8), 16, 10).cast("long")


def weigh_by_rank(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Weights repeating over the sources by code point, null last. ``sources`` has a row for each source."""
    # a rank of any number of sources: by ranges of names, counted range by range
    order = F.col("source").asc_nulls_last()
    ranged = materialize(sources.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "mix-ranks")
    earlier = sums_before(ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0)), "_all", "_part", "_n", "_before")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1 + F.col("_before")
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), (rank % len(weights)).cast("int"))
    return ranged.join(earlier.select("_part", "_before"), "_part").withColumn("weight", weight).drop("_part", "_before")


def set_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Add ``target``: ``share`` of all sizes by weight, at most ``most`` times a source's size, the excess reshared.

    The level (words for each unit of weight) rises until no more sources are full; each round is one
    aggregate of two numbers, so neither sources nor rounds are held on the driver.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, cap = 0.0, F.col("source_size") * F.lit(float(most))
    while True:
        free = ~(cap < F.lit(level) * F.col("weight"))
        row = sources.agg(F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(~free, cap)).alias("full")).first()
        now = (share * total - (row.full or 0.0)) / row.w if row.w else math.inf
        if now <= level or not row.w:
            break
        level = now
    held = F.lit(level) * F.col("weight")
    return sources.withColumn("target", F.when(cap < held, cap).otherwise(held) if math.isfinite(level) else cap)


def _sizes(df: DataFrame, seed: int) -> DataFrame:
    ident = F.coalesce(F.col("doc_id").cast("string"), F.md5(body()))
    return materialize(
        df.select("doc_id", "source", F.regexp_count(body(), F.lit(WORD)).cast("long").alias("size"), hash_key(ident, seed).alias("key")), "mix-sizes"
    )


def _targets(sized: DataFrame, share: float, most: float, weights: tuple[int, ...], rows_per_range: int) -> DataFrame:
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    weighed = materialize(weigh_by_rank(totals, weights).withColumn("ranges", F.ceil(F.col("rows") / rows_per_range)), "mix-sources")
    # written again, so that the planner knows how small it is and can send it whole where the limit allows
    return materialize(set_targets(weighed, share, most).select("source", "source_size", "target", "ranges", "rows"), "mix-targets")


def _with_source(rows: DataFrame, sources: DataFrame, spread: list[str]) -> DataFrame:
    """``rows`` with the columns of their source, a null one too. ``sources`` has the rows of each in ``rows``; large ones aren't dealt by name."""
    keys = {"_name": lambda: F.coalesce("source", F.lit("")), "_none": lambda: F.col("source").isNull()}
    total = sources.agg(F.sum("rows")).first()[0] or 0
    named = [t.withColumns({k: make() for k, make in keys.items()}) for t in (rows, sources)]
    return join_counted(named[0], named[1].drop("source"), list(keys), "rows", total, spread).drop(*keys, "rows")


def _cut(sized: DataFrame, sources: DataFrame, whole: bool) -> DataFrame:
    placed = _with_source(sized, sources, ["doc_id", "key"])
    placed = placed.withColumn("range", F.floor(F.col("key") * F.col("ranges") / F.lit(2.0**32)))
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("words"))
    sums = sums_before(sums, "source", "range", "words", "offset").select(F.col("source").alias("s"), F.col("range").alias("r"), "offset")
    inside = Window.partitionBy("source", "range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ranked = ranked.join(sums, ranked["source"].eqNullSafe(sums["s"]) & (ranked["range"] == sums["r"]))
    left = F.round("target").cast("long") - passes() * F.col("source_size") - F.col("offset") - F.col("inside")
    if whole:
        more = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    else:
        more = F.greatest(F.lit(0), F.least(F.col("size"), left))
    return ranked.withColumn("more", more).withColumn("taken", (passes() * F.col("size") + F.col("more")).cast("long"))


def passes() -> Column:
    """Whole passes over a source that its target holds."""
    return F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0))


def mix(
    df: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, rows_per_range: int = 2_000,
    whole: bool = False, seed: int = 17,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and taken (words the mix takes, repeats counted).

    Every whole pass over a source that its target holds counts each document once; the rest is cut in key order at
    the exact budget: the document on the boundary gives the words up to it, or with ``whole`` counts entirely if half
    of it fits. Null text has size 0; a null source is a source of its own; a null doc_id is keyed by its text; rows
    with equal ids and sizes stand in any order, which gives the same multiset of results. Words of a text of any length
    are all counted. An empty table gives no rows. Other columns play no part.
    """
    sized = _sizes(df, seed)
    cut = _cut(sized, _targets(sized, share, most, weights, rows_per_range), whole)
    return cut.select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_report(df: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the source."""
    return mix(df).select("doc_id", "size", "source_size", "target", "taken", "source")


def mix_documents(
    df: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, rows_per_range: int = 2_000, seed: int = 17
) -> DataFrame:
    """The mix itself: each document as many whole times as it is taken, with the columns of ``df``.

    Only ids and sizes are shuffled. What they give for each source is how many whole passes it has and the last
    document in key order of its partial pass, taken whole if half of it fits; by that row a scan of the texts
    decides alone. Rows equal to that last one in key, id and size are all taken. Documents without words are kept once.
    """
    sized = _sizes(df, seed)
    targets = _targets(sized, share, most, weights, rows_per_range)
    last = F.max(F.when(F.col("more") > 0, F.struct(F.col("key"), F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.col("size"))))
    cuts = _cut(sized, targets, True).groupBy("source").agg(F.max(passes()).alias("_passes"), last.alias("_last"), F.count("*").alias("rows"))
    cuts = materialize(cuts, "mix-cuts")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.md5(body()))
    # what isn't deterministic to the planner is computed once, and not again in each condition that names it
    once = (F.monotonically_increasing_id() * 0).cast("long")
    size = F.regexp_count(body(), F.lit(WORD)).cast("long") + once
    here = F.struct(hash_key(ident, seed).alias("key"), F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), size.alias("size"))
    rows = _with_source(df.select(F.struct("*").alias("_row"), "source", here.alias("_here")), cuts, ["_here"])
    more = F.coalesce((F.col("_here") <= F.col("_last")).cast("int"), F.lit(0))
    copies = F.when(F.col("_here.size") == 0, 1).otherwise(F.col("_passes") + more).cast("int")
    return rows.select("_row", F.explode(F.array_repeat(F.lit(0), copies))).select("_row.*")
