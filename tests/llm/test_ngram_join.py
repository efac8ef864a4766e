import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import graph, ngram_join


def grams(text, n=5):
    w = [x for x in re.split("[ \t\n\x0b\f\r]+", text) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    """doc -> (class, links, text links) with all pairs of different texts."""
    texts = list(dict.fromkeys(t or "" for _, t in rows))
    sets, copies = [grams(t) for t in texts], Counter(t or "" for _, t in rows)
    links = defaultdict(set)
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                links[i].add(j)
                links[j].add(i)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        stack = [i]
        while stack and label[i] == i:
            x = stack.pop()
            for y in links[x]:
                if label[y] > i:
                    label[y] = i
                    stack.append(y)
    least = {}
    for doc_id, t in rows:
        if doc_id is not None:
            k = label[texts.index(t or "")]
            least[k] = min(least.get(k, doc_id), doc_id)
    out = []
    for doc_id, t in rows:
        i = texts.index(t or "")
        out.append((str(doc_id), str(least.get(label[i])), copies[t or ""] - 1 + sum(copies[texts[j]] for j in links[i]), len(links[i])))
    return sorted(out)


def make(seed, n=160):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 8, 40, 120]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 5)}"
        rows.append((i if rng.random() > 0.05 else None, " ".join(w)))
    odd = [" ".join(f"o{i}{c}o{i + 1}" for i in range(0, 40, 2)) for c in "\u00a0\x0b\x1c\u2003 "]
    return rows + [(910 + i, t) for i, t in enumerate(odd)] + [(3, None), (4, ""), (1, rows[1][1]), (1, rows[1][1]), (900, "  \n"), (901, "long " * 40_000)]


def got(df):
    return sorted((str(r.doc_id), str(r.class_id), r.n_links, r.n_text_links) for r in df.collect())


@pytest.mark.parametrize("blocks", [1_500, 7, 1])
def test_groups_match_all_pairs(spark, monkeypatch, blocks):
    """Components compared whole; node by node, most nodes in one block; node by node, all in pairs of blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", blocks)
    rows = make(blocks)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t1", F.lit(0)).withColumn("label", F.lit("x"))
    assert got(ngram_join.ngram_groups(df, recall=1 - 1e-9)) == brute(rows)
    kept = ngram_join.drop_near_copies(df, recall=1 - 1e-9)
    assert kept.columns == df.columns
    want = brute(rows)
    ids = [str(r.doc_id) for r in kept.where("doc_id is not null").collect()]
    # doc 3 stands for two classes, its own and that of empty texts
    assert set(ids) == {c for _, c, _, _ in want if c != "None"} and all(k == 1 or i == "3" for i, k in Counter(ids).items())


@pytest.mark.parametrize("blocks", [1_500, 3])
def test_groups_match_all_pairs_on_documents(spark, monkeypatch, blocks):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", blocks)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert got(ngram_join.ngram_groups(df)) == brute([tuple(r) for r in df.collect()])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_groups(df).count() == 0 and ngram_join.drop_near_copies(df).count() == 0


def test_prefixes_shorten_until_the_recall_is_met():
    share = lambda s, k: 1 - (1 - s**k) ** 32
    lengths = []
    for s in (0.99, 0.9, 0.85, 0.8):
        k = ngram_join.choose_length({s: 10, 0.5: 1000}, 0.8, 32, 0.9999)
        mean = lambda k: 0.99 * share(s, k) + 0.01 * share(0.8, k)  # noqa: B023, E731
        assert mean(k) >= 0.9999 and (k == ngram_join.LONGEST or mean(k + 1) < 0.9999)
        lengths.append(k)
    assert lengths == sorted(lengths, reverse=True) and lengths[0] > lengths[-1]
    k = ngram_join.choose_length({}, 0.8, 32, 0.999)
    assert share(0.8, k) >= 0.999 > share(0.8, k + 1)


def test_forest_ties_neighbours_of_sorted_strings(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(5, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    held = ngram_join._texts(ngram_join._keyed(df), 5, 8).collect()
    entries = sorted((t, bytes(r["keys"])[t * 20 : t * 20 + 20], r.tid) for r in held for t in range(8))
    common = lambda a, b: next((k for k in range(10) if a[2 * k : 2 * k + 2] != b[2 * k : 2 * k + 2]), 10)
    label = {}
    for depth in (4, 7, 10):
        label[depth] = {r.tid: r.tid for r in held}
        for x, y in zip(entries, entries[1:]):
            if x[0] == y[0] and common(x[1], y[1]) >= depth:
                a, b = label[depth][x[2]], label[depth][y[2]]
                label[depth] = {t: min(a, b) if c in (a, b) else c for t, c in label[depth].items()}
    ties, below = ngram_join._forest(ngram_join._texts(ngram_join._keyed(df), 5, 8), 8)
    near = {x for a, b in zip(entries, entries[1:]) if a[0] == b[0] and common(a[1], b[1]) >= 4 for x in (a, b)}
    assert {(r.tree, bytes(r.key), r.tid) for r in below.collect()} == near
    for depth, want in label.items():
        got = {r.node: r.label for r in graph.components(ties.where(f"lcp >= {depth}").select("u", "v")).collect()}
        assert {t: got.get(t, t) for t in want} == want and len(set(want.values())) > 20


def test_compare_counts_rare_and_dense():
    rng = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([rng.integers(0, 60, 40), rng.integers(0, 4000, 9)])).astype(np.uint64) for _ in range(120)]
    want = np.array([[i != j and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.3 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert want.sum() > 50 and (ngram_join.compare(sets, 0.3) == want).all()
    cross = want.copy()
    cross[:50, :50] = cross[50:, 50:] = False
    assert (ngram_join.compare(sets, 0.3, 50) == cross).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000)]
    found = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {found[i] for i in range(301)} == {0} and {found[i] for i in range(1000, 1400)} == {1000} and len(found) == 701
