"""Images as a stream of files: each new file is decoded once as it appears."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.images import decode


def stream_images(spark: SparkSession, path: str, mode: str = "RGBA8", files_per_batch: int = 100) -> DataFrame:
    """A streaming DataFrame (path, image) over the PNG files of a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("pathGlobFilter", "*.png").option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.select("path", decode("content", mode).alias("image"))
