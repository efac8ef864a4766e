import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import exact_dedup, packing
from tessera.llm.common import deal, join_counted, sums_before

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b", "  x", "x  ", "a \n b", "a\n b\n\n c \n", "it's 'tis ' s", "tab\tb\r\n c", "<|endoftext|> hi", "日本語 テキスト ok", "a   b\n  c", "\n", "", " ", "Ü é ßs 12 345a !!??", "😀😀 hi", "x" * 5000]


def test_exact_groups_ties_nulls_and_extra_columns(spark):
    rows = [(1, "a", 0), (5, "a", 1), (3, "a", 2), (5, "a", 3), (None, "b", 4), (2, "b", 5), (None, None, 6), (None, "", 7), (9, "c" * 300_000, 8), (8, "c" * 300_000, 9), (7, "a ", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int").withColumn("bucket", F.lit(1))
    got = [(str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df, bucket_bytes=100).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("1", 5, 4, False), ("5", 5, 4, True), ("5", 5, 4, False), ("3", 5, 4, False), ("None", 2, 2, False), ("2", 2, 2, True), ("None", None, 2, True), ("None", None, 2, False), ("9", 9, 2, True), ("8", 9, 2, False), ("7", 7, 1, True)]))
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "5", "7", "9", "None"]
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_kept_rows_keep_all_their_columns(spark):
    when, words = F.lit("2024-05-06 07:08:09").cast("timestamp"), F.array(F.lit("x"), F.lit(None))
    df = spark.range(300).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.concat(F.lit("é "), F.col("id") % 7)).alias("text"), when.alias("rest"), words.alias("k"),
        F.struct("id").alias("a.b"), F.lit(None).cast("string").alias("c0"),
    )
    want = {}
    for r in df.collect():
        want[r.text or ""] = r
    got = exact_dedup.drop_copies(df, bucket_bytes=100)
    assert got.dtypes == df.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.values()))


def test_hot_keys_join_like_others(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = left.where("k <> 4500").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = join_counted(left, right, ["k"], "n", 4999, ["v"])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"hashpartitioning\(k#\w+, _salt#", plan)
    for how, rows in (("inner", 4999), ("left", 5000)):
        got = join_counted(left, right, ["k"], "n", 4999, ["v"], how).collect()
        want = {7: 3999} | {i: i for i in range(4000, 5000) if i != 4500}
        assert len(got) == rows and all(r.m == want.get(r.k) for r in got) and {r.v for r in got} >= set(range(4000))


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("k"), F.lit(100).alias("bytes"))
    directory = exact_dedup.build_directory(keys, 5000)
    held = np.array([r.k for r in keys.collect()], dtype=np.int64).view(np.uint64)
    counts = np.bincount(np.searchsorted(directory, held, side="right") - 1)
    assert directory[0] == 0 and len(directory) > 30 and counts.max() <= 50 and counts.sum() == 2000
    assert len(exact_dedup.build_directory(spark.createDataFrame([(5, 10**9)], "k long, bytes long"), 10)) == 1


def test_chains_compare_bytes():
    import pyarrow as pa

    names = ["bucket", "k", "text", "top", "rows", "top_rows"]
    batch = pa.record_batch([[0, 0, 0], [7, 7, 7], [b"x", b"y", b"x"], [1, 2, 3], [1, 1, 2], [1, 1, 1]], names=names)
    (page,) = exact_dedup._own(iter([batch]))
    assert [(r["place"], r["keep_id"], r["group_size"]) for r in page.to_pylist()] == [(0, 3, 3), (1, 2, 1)]


def test_encoder_agrees_with_the_tokenizer(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    slow, fast = Tokenizer.from_file(PATH), packing.encoder(PATH, Path(PATH).read_bytes)
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(fast(t), "<u4").tolist() == slow.encode(t, add_special_tokens=False).ids, t[:50]


@pytest.mark.parametrize("seed", range(4))
def test_plan_fits_and_places_every_length(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 1024])
    counts = {rng.randint(1, capacity): rng.randint(1, 500) for _ in range(rng.randint(1, 400))}
    runs = packing.plan(counts, capacity)
    used = defaultdict(int)
    for pattern, bins in runs:
        assert sum(n * k for n, k in pattern) <= capacity and sum(k for n, k in pattern if 3 * n > capacity) <= 2
        for n, k in pattern:
            used[n] += k * bins
    assert used == counts
    total = sum(n * k for n, k in counts.items())
    assert sum(b for _, b in runs) <= 11 / 9 * max(total / capacity, sum(k for n, k in counts.items() if 2 * n > capacity)) + 1


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_near_the_least_number_of_bins(seed):
    rng = random.Random(seed)
    pieces = sorted((rng.randint(1, 30) for _ in range(rng.randint(1, 9))), reverse=True)

    def fits(left, gaps):
        if not left:
            return True
        return any(fits(left[1:], [*gaps[:i], g - left[0], *gaps[i + 1 :]]) for i, g in enumerate(gaps) if g >= left[0] and g not in gaps[:i])

    least = next(n for n in range(1, 10) if fits(pieces, [30] * n))
    assert sum(b for _, b in packing.plan(Counter(pieces), 30)) <= least + (least > 2)


def test_packing_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1, "dup"), (1, "dup"), (None, "x"), (3, None), (50, "word " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(5)).withColumn("offset", F.lit(1))
    packed = packing.pack(packing.tokenize(df, PATH, with_ids=True)).collect()
    bins = defaultdict(list)
    for r in packed:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    slow = Tokenizer.from_file(PATH)
    want = sorted([str(i), *slow.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows)
    docs = defaultdict(list)
    for r in packed:
        docs[(str(r.doc_id), r.piece == 0 and r.start)].append(r)
    got = sorted([str(r.doc_id), *np.frombuffer(r.ids, "<u4").tolist()] for r in packed if r.doc_id != 50 and r.piece == 0 and r.length < 1024)
    assert [w for w in want if w[0] != "50" and len(w) < 1000] == got
    long = sorted((r for r in packed if r.doc_id == 50), key=lambda r: r.piece)
    assert all(r.length == 1024 for r in long[1:]) and [r.start for r in long] == [0, *np.cumsum([r.length for r in long])[:-1]]
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
    whole = packing.sequences(packing.pack(packing.tokenize(df, PATH, with_ids=True))).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in packed)
    assert packing.sequences(packing.pack(packing.tokenize(df.limit(0), PATH, with_ids=True))).count() == 0


def test_owners_have_tasks_of_their_own(spark):
    df = spark.range(3000).select((F.col("id") % 30).alias("owner"), "id")
    got = deal(df, "owner", 30).withColumn("task", F.spark_partition_id())
    assert got.select("owner", "id").distinct().count() == 3000
    assert {(r.n, r.rows) for r in got.groupBy("task").agg(F.countDistinct("owner").alias("n"), F.count("*").alias("rows")).collect()} == {(1, 100)}


def test_sums_before_in_blocks(spark):
    rng = random.Random(8)
    rows = [(by, i, rng.randint(0, 9)) for by in ("a", None, "b") for i in rng.sample(range(300), 200)]
    got = sums_before(spark.createDataFrame(rows, "s string, i long, v long"), "s", "i", "v", "t", block=16).collect()
    assert len(got) == len(rows) and all(r.t == sum(v for by, i, v in rows if by == r.s and i < r.i) for r in got)
