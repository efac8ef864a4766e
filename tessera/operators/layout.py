"""Interlacing and bit packing as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.raster import PASSES


def pass_table(sizes: DataFrame) -> DataFrame:
    """Seven rows for each (image, width, height): size of each pass and where its filtered rows of 8-bit samples begin."""
    steps = F.array(*[F.struct(F.lit(i + 1).alias("pass"), *[F.lit(v).alias(n) for n, v in zip(("ix", "iy", "dx", "dy"), p)]) for i, p in enumerate(PASSES)])
    size = lambda n, first, step: F.floor((F.col(n) - first + step - 1) / step)
    dims = F.transform(steps, lambda s: F.struct(s["pass"].cast("long").alias("pass"), size("width", s["ix"], s["dx"]).alias("w"), size("height", s["iy"], s["dy"]).alias("h")))
    used = F.transform(F.col("_d"), lambda d: F.when((d["w"] > 0) & (d["h"] > 0), d["h"] * (d["w"] + 1)).otherwise(F.lit(0)).cast("long"))
    begun = F.transform(F.col("_d"), lambda d, i: F.aggregate(F.slice(F.col("_n"), 1, i), F.lit(0).cast("long"), lambda a, v: a + v))
    zipped = sizes.withColumn("_d", dims).withColumn("_n", used).withColumn("_b", begun)
    return zipped.select("image", F.inline(F.arrays_zip("_d", "_b"))).select("image", "_d.pass", F.col("_d.w").alias("width"), F.col("_d.h").alias("height"), F.col("_b").alias("offset"))


def pass_of(x: Column, y: Column) -> Column:
    """The pass of a sample, 1 to 7."""
    out = F.lit(7)
    for i in range(5, -1, -1):
        ix, iy, dx, dy = PASSES[i]
        out = F.when((x % dx == ix) & (y % dy == iy), i + 1).otherwise(out)
    return out.cast("long")


def interlaced(samples: DataFrame, width: int) -> DataFrame:
    """Add pass and place (within the pass, by row and column) to (image, y, x, v); arithmetic alone, no sort."""
    p = F.col("pass")
    pick = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in PASSES]), p.cast("int"))
    across = F.floor((F.lit(width) - pick(0) + pick(2) - 1) / pick(2))
    place = F.floor((F.col("y") - pick(1)) / pick(3)) * across + F.floor((F.col("x") - pick(0)) / pick(2))
    return samples.withColumn("pass", pass_of(F.col("x"), F.col("y"))).withColumn("place", place.cast("long"))


def deinterlaced(samples: DataFrame, width: int) -> DataFrame:
    """(image, y, x, v) of (image, pass, place, v)."""
    p = F.col("pass").cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in PASSES]), p)
    across = F.floor((F.lit(width) - pick(0) + pick(2) - 1) / pick(2))
    y = pick(1) + F.floor(F.col("place") / across) * pick(3)
    x = pick(0) + (F.col("place") % across) * pick(2)
    return samples.select("image", y.cast("long").alias("y"), x.cast("long").alias("x"), "v")


def packed(line: str, depth: int) -> Column:
    """Rows of samples of 1, 2 or 4 bits as bytes, the first sample in the high bits, padded with zeros."""
    per = 8 // depth
    groups = F.sequence(F.lit(0), F.ceil(F.size(line) / per).cast("int") - 1)
    byte = lambda g: F.aggregate(
        F.sequence(F.lit(0), F.lit(per - 1)), F.lit(0), lambda acc, k: F.shiftleft(acc, depth) + F.coalesce(F.get(line, g * per + k), F.lit(0))
    )
    return F.transform(groups, byte)


def unpacked(line: str, depth: int, n: Column) -> Column:
    """The first ``n`` samples of 1, 2 or 4 bits of a row of bytes."""
    per, mask = 8 // depth, (1 << depth) - 1
    value = lambda i: F.floor(F.get(line, F.floor(i / per).cast("int")) / F.pow(F.lit(2), (per - 1 - i % per) * depth)).cast("int").bitwiseAND(mask)
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), value)


def required_bits(v: Column) -> Column:
    """Bits that a grey byte needs: 1 for 0 and 255, 2 for multiples of 85, 4 for multiples of 17, else 8."""
    return F.when(v % 255 == 0, 1).when(v % 85 == 0, 2).when(v % 17 == 0, 4).otherwise(8)
