"""Scanline filters on arrays: a row needs itself and the row above, one window over rows and none over samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import raster

KINDS = ("none", "sub", "up", "average", "paeth")


def with_above(lines: DataFrame) -> DataFrame:
    """Add ``above``: the row before in the image, zeros for the first."""
    above = F.lag("line").over(Window.partitionBy("image").orderBy("y"))
    return lines.withColumn("above", F.coalesce(above, F.transform("line", lambda v: F.lit(0))))


def _at(line: Column, i: Column) -> Column:
    return F.coalesce(F.get(line, i), F.lit(0))


def guess(a: Column, b: Column, c: Column, kind: str) -> Column:
    """What a filter expects from left, up and up-left."""
    if kind == "none":
        return F.lit(0)
    if kind == "sub":
        return a
    if kind == "up":
        return b
    if kind == "average":
        return F.shiftright(a + b, 1)
    pa, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - c - c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def filtered(line: str, above: str, step: int, kind: str) -> Column:
    """A row of bytes (array of int) filtered; ``step`` is the bytes of a pixel, 1 at least."""
    return F.transform(
        F.col(line), lambda v, i: (v - guess(_at(F.col(line), i - step), _at(F.col(above), i), _at(F.col(above), i - step), kind)).bitwiseAND(255)
    )


def filter_lines(lines: DataFrame, step: int, kind: str) -> DataFrame:
    """(image, y, kind, line) with one filter for all rows."""
    return with_above(lines).select("image", "y", F.lit(KINDS.index(kind)).alias("kind"), filtered("line", "above", step, kind).alias("line"))


def _total(line: Column) -> Column:
    return F.aggregate(line, F.lit(0).cast("long"), lambda acc, v: acc + v)


def minsum_cost(line: Column, kind: str) -> Column:
    """Sum of the bytes as distances from zero, 255 - v above 127; unfiltered bytes count as they are."""
    return _total(line if kind == "none" else F.transform(line, lambda v: F.when(v < 128, v).otherwise(255 - v)))


def entropy_cost(line: Column, kind: str) -> Column:
    """Entropy of the row with its filter byte, rounded so that equal histograms tie."""
    n = F.size(line) + 1
    whole = F.concat(line, F.array(F.lit(KINDS.index(kind))))
    counts = F.transform(F.array_distinct(whole), lambda v: F.size(F.filter(whole, lambda w: w == v)))
    ordered = F.array_sort(counts)
    return F.round(F.aggregate(ordered, F.lit(0.0), lambda acc, c: acc - (c / n) * F.log2(c / n)), 6)


COSTS = {"minsum": minsum_cost, "entropy": entropy_cost}


def choose(lines: DataFrame, step: int, strategy: str, kinds: DataFrame | None = None) -> DataFrame:
    """(image, y, kind, line) by strategy: zero, minsum, entropy, brute_force, or predefined with ``kinds`` (image, y, kind).

    Of equally cheap filters the first is taken. All five are tried within the row, so nothing is shuffled for the choice.
    """
    if strategy == "zero":
        return filter_lines(lines, step, "none")
    if strategy == "brute_force":
        return _brute_force(lines, step)
    tried = with_above(lines)
    for k in KINDS:
        tried = tried.withColumn(f"_{k}", filtered("line", "above", step, k))
    if strategy == "predefined":
        told = tried.join(kinds.select("image", "y", F.col("kind").alias("_kind")), ["image", "y"])
        return told.select("image", "y", F.col("_kind").alias("kind"), F.get(F.array(*[f"_{k}" for k in KINDS]), F.col("_kind")).alias("line"))
    cost = COSTS[strategy]
    ranked = F.array_min(F.array(*[F.struct(cost(F.col(f"_{k}"), k).alias("cost"), F.lit(i).alias("kind"), F.col(f"_{k}").alias("line")) for i, k in enumerate(KINDS)]))
    return tried.select("image", "y", ranked.alias("_best")).select("image", "y", F.col("_best.kind").alias("kind"), F.col("_best.line").alias("line"))


def _brute_force(lines: DataFrame, step: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            kinds, out = [], []
            for line, above in zip(df["line"], df["above"], strict=True):
                line, above = np.asarray(line, np.uint8), np.asarray(above, np.uint8)
                tried = [raster.filter_line(line, above, step, k) for k in range(5)]
                kind = min(range(5), key=lambda k: (raster._line_cost("brute_force", k, tried[k]), k))
                kinds.append(kind)
                out.append(tried[kind].astype(np.int32))
            yield df[["image", "y"]].assign(kind=np.array(kinds, np.int32), line=out)

    return with_above(lines).mapInPandas(run, "image long, y long, kind int, line array<int>")


def unfilter(lines: DataFrame, step: int) -> DataFrame:
    """(image, y, line) of (image, y, kind, line); rows depend on each other, so an image goes to one task."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("y")
        out, above = [], None
        for kind, line in zip(df["kind"], df["line"], strict=True):
            line = np.asarray(line, np.uint8)
            above = raster.unfilter_line(line, np.zeros_like(line) if above is None else above, step, int(kind))
            out.append(above.astype(np.int32))
        return df[["image", "y"]].assign(line=out)

    return lines.select("image", "y", "kind", "line").groupBy("image").applyInPandas(run, "image long, y long, line array<int>")


def digest(lines: DataFrame, *more: str) -> DataFrame:
    """(image, y, ..., total, weighted) of rows: sums of the bytes and of bytes times their place from 1."""
    weighted = F.aggregate(F.transform("line", lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda acc, v: acc + v)
    return lines.select("image", "y", *[F.col(c).cast("long").alias(c) for c in more], _total(F.col("line")).alias("total"), weighted.alias("weighted"))
