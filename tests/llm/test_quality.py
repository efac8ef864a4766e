import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality_report(docs.where("doc_id < 4000"), labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert np.mean([r.predicted for r in held if r.quality == 1]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_odd_rows_and_no_labels(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (1, "a b"), (2, "퟿" * 10 + " x " * 50_000)], "doc_id long, text string").withColumn("score", F.lit(3))
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_report(df, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]
    assert {r.score for r in quality.quality_report(df, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_report(df.limit(0), labels).count() == 0


def parts(*texts):
    return quality.features(pa.array(texts, pa.string()))


def test_only_the_text_is_scored():
    model = quality.fit(["good words here", "BAD!! BAD!!"] * 20, [1, 0] * 20)
    assert model.score("nice things there") > 0.5 > model.score("OTHER!! THING!!") and model.score("x y") == model.score("x y")
    made = parts("a a b")
    assert abs(sum(made.x[made.at >= quality.FORMS]) - (3 + 2 + 1) / 3) < 1e-9


def shape(word):
    kinds = "".join("a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c for c in word)
    return "".join(c for i, c in enumerate(kinds) if i == 0 or kinds[i - 1] != c)


def number(word):
    total = sum((ord(c) + 1) * pow(0x100000001B3, i, 1 << 64) for i, c in enumerate(word)) % (1 << 64)
    return ((total ^ total >> 31) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 33


def test_shape_covers_the_whole_word():
    opening = "ab1-" * 10
    words = [opening + "!?" * 30 + "XY", "A" + "b" * 500 + "7", "a", "日本語語", "Éé😀😀", "ǅ"]
    assert [shape(w) for w in words[:2]] == ["a9-" * 10 + "!?" * 30 + "A", "Aa9"]
    word, form = quality.hash_words(words)
    assert word.tolist() == [number(w.lower()) for w in words] and form.tolist() == [number(shape(w)) for w in words]
    forms = [set(m.at[m.at < quality.FORMS]) for m in map(parts, (opening + "CD", opening + "!!!"))]
    assert forms[0] != forms[1]


def plain(text):
    """Features by the book: a dict of index and value."""
    full = (1 << 64) - 1
    mul = 0x9E3779B97F4A7C15
    mix = lambda x, salt, bits: ((x + salt) * mul & full) >> (64 - bits)
    words = text.split()
    if not words:
        return {0: 1.0}
    w, f = [number(x.lower()) for x in words], [number(shape(x)) for x in words]
    grams = [mix(x, 1, quality.BITS) for x in w]
    grams += [mix((a + 1) * mul & full ^ b, 5, quality.BITS) for a, b in zip(w, w[1:])]
    grams += [mix(((a + 1) * mul & full ^ b) * mul & full ^ c, 6, quality.BITS) for a, b, c in zip(w, w[1:], w[2:])]
    small = Counter([mix(x, 2, quality.FORM_BITS) for x in f])
    small += Counter([mix((b * 0x100000001B3 + a) & full, 3, quality.FORM_BITS) for a, b in zip(f, f[1:])])
    small += Counter([mix(int(a == b), 4, quality.FORM_BITS) for a, b in zip(w, w[1:])])
    out = defaultdict(float)
    for k, c in small.items():
        out[k] += (c / len(words)) ** 0.5
    for g in grams:
        out[quality.FORMS + g % (quality.SIZE - quality.FORMS)] += 1 / len(words)
    return out


def test_training_and_scores_equal_brute_force():
    rng = random.Random(4)
    vocabulary = ["red", "dog", "Dog", "!!", "x1", "été", "a", "b", "  ", "\n", "ZZZ"]
    texts = ["", " ", "red dog", "dog red"] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))) for _ in range(120)]
    labels = [rng.randint(0, 1) if i % 3 else int("red" in t) for i, t in enumerate(texts)]
    z, n, bz, bn = defaultdict(float), defaultdict(float), 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    bias = lambda: -bz / ((quality.BETA + math.sqrt(bn)) / quality.ALPHA)
    chance = lambda t: 1 / (1 + math.exp(-sum(weight(i) * x for i, x in plain(t).items()) - bias()))
    for _ in range(quality.PASSES):
        for t, y in zip(texts, labels, strict=True):
            g, b = chance(t) - y, bias()
            old = {i: weight(i) for i in plain(t)}
            for i, x in plain(t).items():
                z[i] += g * x - (math.sqrt(n[i] + (g * x) ** 2) - math.sqrt(n[i])) / quality.ALPHA * old[i]
                n[i] += (g * x) ** 2
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / quality.ALPHA * b
            bn += g * g
    model = quality.fit(texts, labels)
    got = model.scores(pa.array(texts + [None], pa.string()))
    assert np.allclose(got, [chance(t) for t in texts + [""]], atol=1e-5) and got.std() > 0.05
    assert model.score("red dog") != model.score("dog red") and plain("red dog") != plain("dog red")


def test_blocks_and_single_texts_agree(monkeypatch):
    texts = pa.array(["red dog " * 50, None, "", "x" * 3000, "dog red"] * 20, pa.string())
    model = quality.fit(["red dog", "x"], [1, 0])
    whole = model.scores(texts)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 500)
    assert len(list(quality.blocks(texts))) > 20 and np.allclose(model.scores(texts), whole) and len(model.scores(texts[:0])) == 0


def test_sample_is_bounded_when_ids_repeat(spark):
    df = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(3, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    model, same = quality.train(df, labels), quality.train(df.where("text in ('text 0', 'other')"), labels)
    assert (model.weights == same.weights).all() and model.bias == same.bias
