from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import mixing, quality
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.01"


def test_stages_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows, kept = docs.columns, [tuple(r) for r in docs.collect()], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append([tuple(r) for r in docs.collect()])
        assert k == 4 or docs.columns == columns
    original = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(original, spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(kept[0]) == sorted(r for r in rows if model.score(r[1] or "") >= 0.7) and 700 < len(kept[0]) < 1000
    last = {r[1]: r for r in sorted(kept[0], key=lambda r: r[0])}
    assert sorted(kept[1]) == sorted(last.values())
    classes = brute([(r[0], r[1]) for r in kept[1]])
    assert sorted(str(r[0]) for r in kept[2]) == sorted({c for _, c, _, _ in classes})
    words = {r[0]: len([w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in r[1]).split(" ") if w]) for r in kept[2]}
    times, of_source, taken = Counter(r[0] for r in kept[3]), defaultdict(int), defaultdict(int)
    for r in kept[2]:
        of_source[r[3]] += words[r[0]]
        taken[r[3]] += words[r[0]] * times[r[0]]
    assert set(times) <= set(words) and max(times.values()) <= 2 and not set(kept[3]) - set(kept[2])
    targets = {r.source: r.target for r in mixing.mix(spark.createDataFrame(kept[2], docs_schema(original))).collect()}
    assert all(abs(taken[s] - targets[s]) <= max(words.values()) for s in targets)
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(slow.encode(r[1], add_special_tokens=False).ids) + 1 for r in kept[3])
    bins = defaultdict(int)
    for r in kept[4]:
        bins[r[5]] += r[3]
    assert sum(bins.values()) == tokens and max(bins.values()) <= 1024 and len(bins) <= 1.02 * tokens / 1024 + 1


def docs_schema(df):
    return df.schema


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_stages_take_odd_rows(spark, tmp_path):
    """Null ids and texts, empty and long texts, repeated rows, ties, and columns that clash with names used inside."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = [r.text for r in docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(6).collect()]
    rows = [(None, good[0]), (None, good[0]), (1, good[1]), (1, good[1]), (2, good[1]), (2, good[2]), (2, good[3]), (3, None), (4, ""), (None, None), (5, good[4] * 40), (6, good[5])]
    odd = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' lang", "CASE WHEN doc_id < 3 THEN NULL ELSE 's' END source", "length(text) n_chars", "1 _row", "2 k", "3 t1", "4 rest", "5 size", "6 key", "7 score", "8 _copies", "9 length", "10 bucket"
    )
    docs.limit(0).write.parquet(f"{tmp_path}/empty.parquet")
    table, kept = odd, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, SF).write.parquet(f"{tmp_path}/{k}")
        table = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(sorted((str(r[0]), str(r[1])) for r in table.collect()))
        assert k == 4 or table.columns == odd.columns
        assert stage(spark, spark.read.parquet(f"{tmp_path}/empty.parquet"), SF).count() == 0
    model = quality.train(odd, spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept[0] == sorted((str(i), str(t)) for i, t in rows if model.score(t) >= 0.7) and len(kept[0]) >= 6
    top = {}
    for i, t in sorted(kept[0], key=lambda r: (r[0] != "None", r[0])):
        top["" if t == "None" else t] = (i, t)
    assert kept[1] == sorted(top.values())
    assert {c for _, c, _, _ in brute([(None if i == "None" else int(i), t) for i, t in kept[1]])} == {i for i, _ in kept[2]}
    assert set(kept[3]) <= set(kept[2]) and max(Counter(kept[3]).values()) <= 2
    assert {i for i, _ in kept[4]} == {i for i, _ in kept[3]}
