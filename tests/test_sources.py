import random

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import png
from tessera.functions.raster import Mode
from tessera.plans import rasters
from tessera.sources import images
from tessera.streaming.images import stream_images


def pictures(folder):
    rng = random.Random(1)
    made = {}
    for k in range(9):
        data = bytes(rng.randrange(256) for _ in range(6 * 5 * 4))
        made[f"{k}.png"] = data
        (folder / f"{k}.png").write_bytes(png.encode(data, 6, 5, interlace=bool(k % 2)))
    (folder / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"x" * 30)
    (folder / "other.txt").write_bytes(b"no image")
    return made


def test_files_decode_and_damage_is_a_row(spark, tmp_path):
    made = pictures(tmp_path)
    got = {r.path.rsplit("/", 1)[1]: r.image for r in images.read_images(spark, str(tmp_path)).collect()}
    assert len(got) == 10 and got.pop("bad.png").error and {k: bytes(v.data) for k, v in got.items()} == made
    assert images.read_images(spark, str(tmp_path), on_error="drop").count() == 9
    files = spark.read.format("binaryFile").load(f"{tmp_path}/[0-9].png")
    parts = images.chunks(files, "path")
    assert parts.where("type = 'IHDR' and seq = 0 and crc_ok").count() == 9
    assert {len(r.f) for r in files.select(images.filter_types("content").alias("f")).collect()} == {5}
    assert files.select(images.chunk_list(F.lit(b"x")).alias("c")).where("c is null").count() == 9


def test_data_source_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    made = pictures(tmp_path / "in")
    images.register(spark)
    read = spark.read.format("png_images").option("files_per_task", 4).load(f"file://{tmp_path}/in")
    assert read.rdd.getNumPartitions() == 3 and read.where("error is not null").count() == 1
    good = read.where("error is null").select(F.regexp_extract("path", r"(\d)\.png", 1).alias("name"), images.encode("data", F.col("width"), F.col("height")).alias("e"))
    good.select("name", "e.content").write.format("png_images").mode("append").save(f"file://{tmp_path}/out")
    back = spark.read.format("png_images").load(f"file://{tmp_path}/out")
    assert {r.path.rsplit("/", 1)[1]: bytes(r.data) for r in back.collect()} == made


def test_animation_frames_and_encode_errors(spark):
    frame = {"x": 0, "y": 0, "width": 2, "height": 1, "data": bytes(8)}
    image = png.encode(bytes(16), 2, 2, frames=[frame, frame])
    df = spark.createDataFrame([(1, image), (2, None)], "k int, content binary").withColumn("image", images.decode("content"))
    assert [(r.k, r.frame_no, r.height) for r in images.frames(df, "k").orderBy("frame_no").collect()] == [(1, 0, 1), (1, 1, 1)]
    short = spark.createDataFrame([(b"123",), (None,)], "d binary").select(images.encode("d", F.lit(2), F.lit(2)).alias("e"))
    assert all(r.e.content is None and r.e.error for r in short.collect())


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pictures(tmp_path / "in")
    query = stream_images(spark, str(tmp_path / "in"), files_per_batch=4).writeStream.format("memory").queryName("pictures").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("pictures").count() == 10 and spark.table("pictures").where("image.error is null").count() == 9


def test_info_and_conversion_of_columns(spark):
    rich = png.encode(bytes(range(16)), 2, 2, auto=False, time=(2012, 1, 2, 3, 4, 60), phys=(1, 2, 1), background=(1, 2, 3), texts=[("k", "t")], itexts=[("i", "en", "x", "日")])
    plain = png.encode(bytes([1, 2, 3, 255] * 300), 300, 1)
    df = spark.createDataFrame([(1, rich), (2, plain), (3, b"x"), (4, None)], "k int, content binary").select("k", images.info("content").alias("i"))
    got = {r.k: r.i for r in df.collect()}
    assert got[1].time == [2012, 1, 2, 3, 4, 60] and got[1].phys == [1, 2, 1] and got[1].background == [1, 2, 3] and [t.text for t in got[1].texts] == ["t", "日"]
    assert got[2].palette == [[1, 2, 3, 255]] and got[2].bit_depth == 1 and got[2].time is None and got[2].chunk_names == "IHDR PLTE IDAT IEND"
    assert got[3].error and got[4].error and got[3].width is None
    px = spark.createDataFrame([(bytes([10, 20, 30, 40]),), (b"1",), (None,)], "d binary")
    rows = [r.o and bytes(r.o) for r in px.select(images.convert("d", F.lit(1), F.lit(1), Mode(6, 8), Mode(2, 16)).alias("o")).collect()]
    assert rows == [bytes([10, 10, 20, 20, 30, 30]), None, None]


def test_batches_do_not_grow_with_the_table(spark):
    @F.arrow_udf("long")
    def rows(ids: pa.Array) -> pa.Array:
        return pa.array([len(ids)] * len(ids), pa.int64())

    read = rasters.read(spark, "/root/testdata/sf0.01", "documents").coalesce(1)
    assert read.count() == 1000 and read.select(rows("doc_id").alias("n")).agg({"n": "max"}).first()[0] <= 500


def test_info_parses_a_file_once(monkeypatch):
    frame = {"x": 0, "y": 0, "width": 2, "height": 1, "data": bytes(8)}
    image, parse, calls = png.encode(bytes(16), 2, 2, frames=[frame], plays=3), png.parse_chunks, []
    monkeypatch.setattr(png, "parse_chunks", lambda *a, **b: calls.append(1) or parse(*a, **b))
    got = images._info(image, True)
    assert (got["plays"], got["chunk_names"], got["error"]) == (3, png.chunk_names(image), None) and len(calls) == 2  # one is chunk_names here
