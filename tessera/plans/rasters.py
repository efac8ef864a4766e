"""Rasters, pixels, chunks and frames derived from ordinary tables, so that every operator has input at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch where the session has Spark's own; a worker holds a batch several times over, so it must not grow with tables.
BATCH = {"maxRecordsPerBatch": ("10000", "500"), "maxBytesPerBatch": ("67108864b", str(4 << 20))}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    for name, (default, ours) in BATCH.items():
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", ours)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Vectors of which those with one label make an image: images stay small and their number grows with the table.
VECTORS = 512


def scanlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, y, line): embeddings as rows of grey bytes; a label is an image within each range of ``VECTORS`` ids."""
    byte = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 1) * 127.5))).cast("int")
    image = F.col("label").cast("long") + 1000 * F.floor(F.col("vec_id") / VECTORS)
    order = Window.partitionBy(image).orderBy("vec_id")
    return read(spark, sf_dir, "embeddings").select(
        image.alias("image"), (F.row_number().over(order) - 1).cast("long").alias("y"), F.transform("embedding", byte).alias("line")
    )


def rows_of_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, data): each embedding as 64 bytes."""
    byte = lambda e: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 1) * 127.5)))), 2, "0")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.unhex(F.array_join(F.transform("embedding", byte), "")).alias("data"))


def numbers(data: Column, width: int = 1) -> Column:
    """Bytes as an array of big-endian numbers of ``width`` bytes."""
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.octet_length(data) - width + 1, F.lit(1)), F.lit(width)),
        lambda i: F.coalesce(F.conv(F.hex(F.substring(data, i, F.lit(width))), 16, 10).cast("long"), F.lit(0).cast("long")),
    )


def samples(lines: DataFrame) -> DataFrame:
    """(image, y, x, v), one row for each sample."""
    return lines.select("image", "y", F.posexplode("line").alias("x", "v")).select("image", "y", F.col("x").cast("long").alias("x"), F.col("v").cast("long").alias("v"))


VARIANTS = ("rgba", "grey", "levels", "keyed", "two")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant, image, idx, r, g, b, a): scanlines as pixels in five ways, from all colours to two."""
    lines = scanlines(spark, sf_dir)
    quads = lines.select("image", "y", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.slice("line", p * 4 + 1, F.lit(4)))).alias("x", "q"))
    rgba = quads.select(F.lit("rgba").alias("variant"), "image", (F.col("y") * 16 + F.col("x")).alias("idx"), *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate("rgba")])
    one = samples(lines).select("image", (F.col("y") * 64 + F.col("x")).alias("idx"), F.col("v").cast("int").alias("v"))
    level = (F.floor(F.col("v") / 64) * 85).cast("int")
    kinds = {
        "grey": [F.col("v")] * 3 + [F.lit(255)],
        "levels": [level] * 3 + [F.lit(255)],
        "keyed": [level, F.col("v"), F.lit(9), F.when(level == 0, 0).otherwise(255)],
        "two": [F.when(F.col("v") < 128, 10).otherwise(20), F.lit(30), F.lit(40), F.when(F.col("v") < 128, 128).otherwise(255)],
    }
    out = rgba
    for name, parts in kinds.items():
        out = out.unionByName(one.select(F.lit(name).alias("variant"), "image", "idx", *[p.cast("int").alias(c) for p, c in zip(parts, "rgba")]))
    return out


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, seq, type, data): conversations as chunk lists; a turn is a chunk, its role the type."""
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("image"), F.col("turn").alias("seq"), F.col("role").alias("type"), F.encode("text", "UTF-8").alias("data")
    )


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(animation, seq, kind, size): events by user; a view opens a frame, whatever follows is its data."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("animation"), F.row_number().over(order).cast("long").alias("seq"),
        F.when(F.col("event_type") == "view", "fcTL").otherwise("fdAT").alias("kind"), F.length("props").cast("long").alias("size"),
    )
