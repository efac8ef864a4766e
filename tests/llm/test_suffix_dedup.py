import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix_dedup


def brute(rows, n=50):
    first = {}
    key = lambda i: i if i is not None else float("inf")
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - n + 1):
            s = data[i : i + n]
            first[s] = min(first.get(s, float("inf")), key(doc_id))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - n + 1):
            if first[data[i : i + n]] < key(doc_id):
                gone[i : i + n] = b"\1" * n
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(gone)))
        out.append((str(doc_id), len(data), sum(gone), int(spans), hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeats_report(df).collect())


def make(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, 30)
            parts.insert(rng.randint(0, 3), p[a : a + rng.randint(20, 300)])
        rows.append((i if rng.random() > 0.1 else None, "|".join(parts)))
    rng.shuffle(rows)
    same = rows[3][1]
    return rows + [(7, None), (8, ""), (5, same), (5, same), (6, same), (None, same), (9, "z" * 500), (10, "z" * 49), (11, "z" * 50), (4, "z" * 51), (12, "y" * 300_000), (13, "q" + "y" * 60)]


@pytest.mark.parametrize("seed,split,chunk", [(1, 20_000, 1 << 20), (2, 1, 1 << 20), (5, 20_000, 130), (6, 1, 130)])
def test_report_matches_brute_force(spark, monkeypatch, seed, split, chunk):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix_dedup, "SORTED_STRINGS", 500)
    monkeypatch.setattr(suffix_dedup, "HELD_DOCS", 17)
    rows = make(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("o", F.lit(1)).withColumn("t1", F.lit("x")).repartition(5)
    assert got(df) == brute(rows)


def test_pieces_hold_every_string_once():
    for n in (0, 10, 49, 50, 51, 99, 100, 101, 1000, 1049, 1050):
        text = bytes(i % 251 for i in range(n))
        for size in (1, 130, 1 << 20):
            made = [(at + i, p[i : i + 50]) for at, p in suffix_dedup.pieces(text, size) for i in range(len(p) - 49)]
            assert made == [(i, text[i : i + 50]) for i in range(n - 49)] and max(len(p) for _, p in suffix_dedup.pieces(text, size)) <= max(size, 100)


def test_documents_match_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert got(df) == brute([tuple(r) for r in df.collect()])


def test_empty_table(spark):
    assert suffix_dedup.repeats_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("gram", [suffix_dedup.GRAM, suffix_dedup.FINE])
def test_runs_cover_every_string_once(gram):
    rng = np.random.default_rng(1)
    sizes = [0, 10, 49, 50, 51, 400, 7, 1000]
    data = rng.integers(97, 100, sum(sizes)).astype(np.uint8)
    bounds = np.r_[0, np.cumsum(sizes)]
    doc, start, strings, least = suffix_dedup.runs(data, bounds, gram)
    covered = [(int(d), int(a - bounds[d] + i)) for d, a, n in zip(doc, start, strings) for i in range(n)]
    assert covered == [(d, i) for d, n in enumerate(sizes) for i in range(n - 49)]
    alone = [suffix_dedup.runs(data[a:b], np.array([0, b - a]), gram) for a, b in zip(bounds, bounds[1:])]
    assert np.concatenate([x[3] for x in alone]).tolist() == least.tolist()
    by_hash = {}
    for d, a, n, h in zip(doc, start, strings, least):
        for i in range(a, a + n):
            assert by_hash.setdefault(data[i : i + 50].tobytes(), h) == h


@pytest.mark.parametrize("seed", range(5))
def test_factors_match_brute_force(seed):
    rng = random.Random(seed)
    length, groups = rng.choice([3, 9, 50]), 4
    stretches = [bytes(rng.choice(b"ab") for _ in range(rng.choice([length, length + 5, length + 60]))) for _ in range(40)]
    stretches += [s[: length + 2] for s in rng.sample(stretches, 20)]
    group = np.array([rng.randrange(groups) for _ in stretches], np.uint64)
    order = np.array([rng.randrange(12) for _ in stretches])
    suffixes = [(g, s, i, o) for g, s, o in zip(group.tolist(), stretches, order.tolist()) for i in range(len(s) - length + 1)]
    data = np.frombuffer(b"".join(stretches) + bytes(8), np.uint8)
    bounds = np.r_[0, np.cumsum([len(s) for s in stretches])]
    at = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(bounds, bounds[1:])])
    by, lcp = suffix_dedup.suffix_order(data, at, np.array([s[0] for s in suffixes], np.uint64), length)
    cut = [(s[0], s[1][s[2] : s[2] + length]) for s in suffixes]
    assert [cut[i] for i in by] == sorted(cut)
    common = lambda a, b: next((k for k in range(length) if a[k] != b[k]), length)
    assert lcp.tolist() == [0] + [common(cut[i][1], cut[j][1]) if cut[i][0] == cut[j][0] else 0 for i, j in zip(by, by[1:])]
    factor = [max((common(c[1], d[1]) for d, t in zip(cut, suffixes) if c[0] == d[0] and t[3] < s[3]), default=0) for c, s in zip(cut, suffixes)]
    got = suffix_dedup.previous_factors(np.array([suffixes[i][3] for i in by]), lcp, length)
    assert [(g >= length, g if g >= length else 0) for g in got] == [(factor[i] >= length, factor[i] if factor[i] >= length else 0) for i in by]
    assert suffix_dedup.previous_factors(np.array([suffixes[i][3] for i in by]), lcp, 1).tolist() == [factor[i] for i in by]
    owner, start = suffix_dedup.earlier_strings(stretches, group, order, length)
    ends = np.cumsum([len(s) - length + 1 for s in stretches])
    assert (ends[owner] - (ends - np.r_[0, ends[:-1]])[owner] + start).tolist() == [i for i, f in enumerate(factor) if f >= length]


def test_what_is_sent_is_the_same_in_a_second_run(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HELD_DOCS", 17)
    docs = suffix_dedup._documents(spark.createDataFrame(make(3), "doc_id long, text string").repartition(3), False)
    sent = [sorted(map(tuple, docs.select("o", "t1", "t2", "text").mapInArrow(suffix_dedup._file(4), suffix_dedup.SENT).collect())) for _ in range(2)]
    assert sent[0] == sent[1] and len({r[1] for r in sent[0]}) >= 7


def test_keys_that_clash_do_no_harm(spark, monkeypatch):
    """Bytes decide: with one key for everything the result is the same."""
    monkeypatch.setattr(suffix_dedup, "_MASK", np.uint64(0))
    rows = make(4)[:60]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_removed_text(spark):
    p = "this passage has well over fifty bytes and stands twice in the table"
    df = spark.createDataFrame([(1, "a " + p), (2, p + " é b"), (3, None)], "doc_id long, text string").withColumn("kept", F.lit(0))
    assert sorted((r.doc_id, r.text) for r in suffix_dedup.remove_repeats(df).collect()) == [(1, "a " + p), (2, " é b"), (3, None)]
