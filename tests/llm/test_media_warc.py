import hashlib
import math
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import media, warc

TEXTS = [(1, "hello"), (1, "hello"), (None, None), (2, ""), (3, "é" * 96), (4, "x" * 500_000), (5, "y" * 192)]


def test_media_round_trip(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("payload", F.lit(1)).withColumn("name", F.lit("n"))
    got = media.media_report(df).collect()
    want = []
    for doc_id, text in TEXTS:
        raw = (text or "").encode()
        data = media.pad(raw)
        assert len(data) % 192 == 0 and data and media.from_png(media.to_png(raw)) == (data, len(raw))
        want.append((str(doc_id), len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert len({(r.media_sha256, r.feature) for r in got}) == 5
    assert media.media_report(df.limit(0)).count() == 0


def test_ranges_read_each_member_once_and_report_damage(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), F.col("id").cast("int")).alias("text"))
    folder, _ = media.write_archives(df, archive_bytes=20_000)
    spark.dataSource.register(media.MediaArchives)
    read = spark.read.format("media_archives").option("range_bytes", 3000).load(folder)
    assert read.rdd.getNumPartitions() > 20
    assert sorted(int(r.name.split("-")[1][:-4]) for r in read.collect()) == list(range(500))
    victim = read.orderBy("archive", "offset").first()
    path = victim.archive.removeprefix("file://")
    with open(path, "r+b") as f:
        f.seek(victim.offset + 60)
        f.write(b"\xff\x00\xff")
    failed = [r for r in spark.read.format("media_archives").option("on_error", "row").load(folder).collect() if r.error]
    assert [(r.archive, r.offset) for r in failed] == [(victim.archive, victim.offset)]
    described = media.describe(spark.read.format("media_archives").option("on_error", "row").load(folder)).collect()
    assert len(described) == 500 and [r.doc_id for r in described if r.n_bytes is None] == [int(victim.name.split("-")[1][:-4])]
    with pytest.raises(Exception, match="checksum"):
        spark.read.format("media_archives").load(folder).collect()


def test_warc_resolves_revisits(spark):
    big, small = "<p>" + "a" * 2000, "<p>b"
    rows = [(1, "u\r\nX: 1", big), (7, None, big), (7, "u", big), (3, "u", big), (4, "u", small), (5, "u", small), (None, "u", None), (8, "u", "é\r\n\r\n" * 300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(1))
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.warc_report(df).collect())
    digest = {h: hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in rows}
    want = [("1", "revisit", 7), ("3", "revisit", 7), ("4", "response", None), ("5", "response", None), ("7", "response", None), ("7", "revisit", 7), ("8", "response", None), ("None", "response", None)]
    assert [g[:3] for g in got] == want
    assert sorted((g[3], g[4]) for g in got) == sorted((len((h or "").encode()), digest[h]) for _, _, h in rows)
    assert warc.warc_report(df.limit(0)).count() == 0


def test_warc_archives_are_readable_members(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", "z" * (i % 3) * 600) for i in range(30)], "page_id long, url string, html string")
    archives = warc.rewrite(warc.resolve(warc.write_raw(df), 1000)).collect()
    seen = [f for a in archives for f, _ in warc.records(a.archive)]
    assert len(seen) == 30 == sum(a.records for a in archives)
    ids = {f["WARC-Record-ID"] for f in seen if f["WARC-Type"] == "response"}
    revisits = [f for f in seen if f["WARC-Type"] == "revisit"]
    assert len(revisits) == 9 and all(f["WARC-Refers-To"] in ids and f["WARC-Profile"] == warc.PROFILE for f in revisits)
    assert isinstance(warc._rows([], "page_id long"), pa.RecordBatch)


def test_warc_reads_back_in_as_many_tasks_as_archives(spark):
    df = spark.range(64).repartition(8).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("é"), F.col("id").cast("int") * 9_000).alias("html"))
    report = warc.warc_report(df)
    assert report.rdd.getNumPartitions() >= 4
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in report.collect()) == sorted((i, 18_000 * i, hashlib.sha1("é".encode() * 9_000 * i).hexdigest()) for i in range(64))


def test_warc_revisits_need_equal_bytes(spark):
    headers = [(i, "u", 2000, "ab", check, "a", i, 1) for i, check in enumerate("xxyzz")]
    found = warc.resolve(spark.createDataFrame(headers, warc.HEADERS), 1000).collect()
    assert sorted((r.page_id, r.original and r.original.page_id) for r in found) == [(0, 1), (1, 1), (2, None), (3, 4), (4, 4)]


def test_features_and_stored_form_by_the_book(spark):
    texts = ["", "a", "hello " * 60, "é😀" * 50, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.media_report(df).collect():
        raw = (texts[r.doc_id] or "").encode()
        samples = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        mean = sum(samples) / len(samples)
        share = [samples.count(v) / len(samples) for v in set(samples)]
        numbers = (mean, (sum((v - mean) ** 2 for v in samples) / len(samples)) ** 0.5, -sum(p * math.log2(p) for p in share), sum(abs(a - b) for a, b in zip(samples, samples[1:])) / (len(samples) - 1))
        assert [float(p.split("=")[1]) for p in r.feature.split(";")] == pytest.approx(numbers, abs=1e-3)
        stored = media.to_png(raw)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
