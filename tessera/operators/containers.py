"""Chunk lists and animation frames as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def names(chunks: DataFrame) -> DataFrame:
    """(image, names): types in order, joined by blanks."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "type"))), lambda c: c["type"])
    return chunks.groupBy("image").agg(F.array_join(ordered, " ").alias("names"))


def having(chunks: DataFrame, kind: str) -> DataFrame:
    """(image, found): whether there is a chunk of a type."""
    return chunks.groupBy("image").agg(F.bool_or(F.col("type") == kind).alias("found"))


def first(chunks: DataFrame, kind: str) -> DataFrame:
    """(image, seq, data) of the first chunk of a type; images without one are left out."""
    return chunks.where(F.col("type") == kind).groupBy("image").agg(F.min("seq").alias("seq"), F.min_by("data", "seq").alias("data"))


def keyword(data: Column) -> Column:
    """What stands before the first blank, and the rest, as (keyword, text, valid): 1 to 79 characters are legal."""
    text = F.decode(data, "UTF-8")
    word = F.substring_index(text, " ", 1)
    return F.struct(word.alias("keyword"), F.substring(text, F.length(word) + 2, F.length(text)).alias("text"), F.length(word).between(1, 79).alias("valid"))


def joined(chunks: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per image: for each type its number of chunks and bytes, in a single pass over the chunks."""
    made = []
    for k in kinds:
        own = F.col("type") == k
        made += [F.sum(own.cast("long")).alias(f"n_{k}"), F.coalesce(F.sum(F.when(own, F.octet_length("data"))), F.lit(0)).cast("long").alias(f"bytes_{k}")]
    return chunks.groupBy("image").agg(*made)


def checked(chunks: DataFrame) -> DataFrame:
    """Add crc over type and data."""
    return chunks.withColumn("crc", F.crc32(F.concat(F.encode("type", "UTF-8"), F.col("data"))))


def frames(controls: DataFrame) -> DataFrame:
    """(animation, frame_no, opened, parts, size): data by the control before it; what precedes the first is left out."""
    opened = F.sum((F.col("kind") == "fcTL").cast("long")).over(Window.partitionBy("animation").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    numbered = controls.withColumn("frame_no", opened - 1).where("frame_no >= 0")
    data = F.col("kind") == "fdAT"
    return numbered.groupBy("animation", "frame_no").agg(
        F.min("seq").alias("opened"), F.sum(data.cast("long")).alias("parts"), F.coalesce(F.sum(F.when(data, F.col("size"))), F.lit(0)).alias("size")
    )


def sequence_errors(controls: DataFrame, number: str) -> DataFrame:
    """(animation, errors): rows whose number isn't one more than the number before."""
    before = F.lag(number).over(Window.partitionBy("animation").orderBy("seq"))
    return controls.withColumn("_e", (F.col(number) != before + 1).cast("long")).groupBy("animation").agg(F.coalesce(F.sum("_e"), F.lit(0)).alias("errors"))


def outside(frame_table: DataFrame, canvas: DataFrame) -> DataFrame:
    """Frames (animation, frame_no, x, y, width, height) that don't lie within their canvas (animation, width, height)."""
    c = canvas.select("animation", F.col("width").alias("_w"), F.col("height").alias("_h"))
    bad = (F.col("width") <= 0) | (F.col("height") <= 0) | (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("width") > F.col("_w")) | (F.col("y") + F.col("height") > F.col("_h"))
    return frame_table.join(c, "animation").where(bad).drop("_w", "_h")
