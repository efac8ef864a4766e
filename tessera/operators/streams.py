"""Byte streams: checksums, histograms, prefix codes, and where LZ77 would look."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def crc32(data: Column) -> Column:
    return F.crc32(data)


@F.pandas_udf(T.LongType())
def adler32(data: pd.Series) -> pd.Series:
    return data.map(zlib.adler32, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def deflated(data: pd.Series) -> pd.Series:
    return data.map(zlib.compress, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def inflated(data: pd.Series) -> pd.Series:
    """Inflated bytes; null for a damaged stream."""

    def one(raw: bytes) -> bytes | None:
        try:
            return zlib.decompress(raw)
        except zlib.error:
            return None

    return data.map(one, na_action="ignore")


def byte_counts(df: DataFrame, data: str) -> DataFrame:
    """(symbol, n) over all rows: histograms by batch, then a sum of at most 256 rows a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(256, np.int64)
        for b in batches:
            for raw in b[data].dropna():
                total += np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        yield pd.DataFrame({"symbol": np.flatnonzero(total), "n": total[total > 0]})

    return df.select(data).mapInPandas(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def code_lengths(counts: dict[int, int], most: int = 15) -> dict[int, int]:
    """Lengths of an optimal prefix code with at most ``most`` bits, by merging the cheapest packages ``most`` times."""
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    if len(counts) > 1 << most:
        raise ValueError("too many symbols")
    leaves = sorted((n, s) for s, n in counts.items())
    levels = [[(n, k, True) for k, (n, _) in enumerate(leaves)]]  # (weight, place, is a symbol)
    for _ in range(most - 1):
        last = levels[-1]
        pairs = [(a[0] + b[0], k, False) for k, (a, b) in enumerate(zip(last[::2], last[1::2]))]
        levels.append(list(heapq.merge(levels[0], pairs, key=lambda p: p[0])))
    # the cheapest packages of the last level; each package of a level opens two of the level below
    lengths, taken = [0] * len(leaves), 2 * len(leaves) - 2
    for level in reversed(levels):
        packages = 0
        for _, place, single in level[:taken]:
            if single:
                lengths[place] += 1
            else:
                packages += 1
        taken = 2 * packages
    return {s: n for (_, s), n in zip(leaves, lengths, strict=True)}


def canonical_codes(lengths: DataFrame) -> DataFrame:
    """(symbol, length, code) of (symbol, length): codes of a length ascend with the symbol, after all shorter ones.

    A code is the number of codes of its length that shorter codes take up, plus its rank. At most a few hundred rows.
    """
    used = lengths.where("length > 0")
    shorter = used.groupBy("length").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("length", "n")).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("length").orderBy("symbol")) - 1
    base = F.aggregate("_all", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["length"] < F.col("length"), x["n"] * F.pow(F.lit(2), F.col("length") - x["length"]).cast("long")).otherwise(0))
    return used.withColumn("_r", rank).crossJoin(F.broadcast(shorter)).select("symbol", "length", (base + F.col("_r")).alias("code"))  # one row


def fixed_lengths(spark: SparkSession) -> DataFrame:
    """Lengths of the format's fixed literal code."""
    s = F.col("id")
    return spark.range(288).select(s.alias("symbol"), F.when(s < 144, 8).when(s < 256, 9).when(s < 280, 7).otherwise(8).cast("long").alias("length"))


def ladder(first: int, count: int, per: int, plain: int) -> list[tuple[int, int]]:
    """(base, extra bits) of codes whose ranges double after every ``per`` codes; the first ``plain`` hold one value each."""
    out, base = [], first
    for k in range(count):
        extra = 0 if k < plain else (k - plain) // per + 1
        out.append((base, extra))
        base += 1 << extra
    return out


def _bucket_table(spark: SparkSession, first_code: int, steps: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(first_code + k, base, extra) for k, (base, extra) in enumerate(steps)], "code long, base long, extra long")


def length_buckets(spark: SparkSession) -> DataFrame:
    """Codes of match lengths 3 to 258; the longest has a code of its own."""
    return _bucket_table(spark, 257, [*ladder(3, 28, 4, 8), (258, 0)])


def distance_buckets(spark: SparkSession) -> DataFrame:
    """Codes of match distances 1 to 32768."""
    return _bucket_table(spark, 0, ladder(1, 30, 2, 4))


def in_bucket(values: DataFrame, value: str, table: DataFrame) -> DataFrame:
    """Each value with its code and what is left for the extra bits: the greatest base that isn't above it.

    The table has at most 30 rows and is looked up in an array, so nothing is joined by range.
    """
    packed = table.agg(F.array_sort(F.collect_list(F.struct("base", "code", "extra"))).alias("_t"))
    hit = F.element_at(F.filter("_t", lambda t: t["base"] <= F.col(value)), -1)
    return values.crossJoin(F.broadcast(packed)).withColumn("_h", hit).select(*values.columns, F.col("_h.code").alias("code"), (F.col(value) - F.col("_h.base")).alias("rest"))


def grams(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, pos, gram): the three bytes at each position, as a number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = np.array([len(raw or b"") for raw in b[data]], np.int64)
            x = np.frombuffer(b"".join(raw or b"" for raw in b[data]) + bytes(2), np.uint8).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), np.maximum(sizes - 2, 0))
            pos = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(sizes - 2, 0)) - np.maximum(sizes - 2, 0), np.maximum(sizes - 2, 0))
            at = (np.cumsum(sizes) - sizes)[row] + pos
            for lo in range(0, len(at), 1 << 18):
                a = at[lo : lo + (1 << 18)]
                yield pd.DataFrame({key: b[key].to_numpy()[row[lo : lo + len(a)]], "pos": pos[lo : lo + len(a)], "gram": (x[a] << 16) | (x[a + 1] << 8) | x[a + 2]})

    return df.select(key, data).mapInPandas(run, f"{key} long, pos long, gram long")


def previous_occurrence(grams_: DataFrame, key: str, window: int = 2048) -> DataFrame:
    """Add ``distance`` to the last equal gram of the stream if it is at most ``window`` back, else null."""
    back = F.col("pos") - F.lag("pos").over(Window.partitionBy(key, "gram").orderBy("pos"))
    return grams_.withColumn("distance", F.when(back <= window, back))


def zero_runs(samples: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, start, length) of runs of zeros, by the difference of two counts."""
    w = Window.partitionBy(*keys).orderBy(order)
    zeros = samples.withColumn("_i", F.row_number().over(w)).where(F.col(value) == 0).withColumn("_g", F.col("_i") - F.row_number().over(w))
    return zeros.groupBy(*keys, "_g").agg(F.min(order).alias("start"), F.count("*").alias("length")).drop("_g")
