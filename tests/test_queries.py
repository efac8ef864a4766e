"""Every raster and stream query beside its SQL on the smallest tables."""

import zlib

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tessera.functions import outcome
from tessera.operators import streams
from tessera.plans import queries as Q
from tessera.plans import rasters
from tools_compare import TABLES, frame

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    got, want = frame(Q.queries()[name](spark, SF).toPandas()), frame(con.execute(Q.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
    for c in got.columns:
        a, b = ([None if pd.isna(v) else v for v in f[c]] for f in (got, want))
        assert [str(v) for v in a] == [str(v) for v in b] or [v is not None and float(v) for v in a] == pytest.approx([v is not None and float(v) for v in b]), c


def test_crc_is_zlibs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.crc32 == zlib.crc32((docs[r.doc_id] or "").encode()) for r in Q.queries()["crc32_docs"](spark, SF).collect())
    chunks = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    for r in Q.queries()["chunk_crc"](spark, SF).collect():
        c = chunks[(r.image, r.seq)]
        assert r.crc == zlib.crc32((c.role + c.text).encode())


def test_optimal_codes_are_a_prefix_code_of_least_cost(spark):
    counts = {i: (i * 7919) % 1000 + 1 for i in range(100)} | {200: 10**6}
    for most in (8, 15):
        lengths = streams.code_lengths(counts, most)
        assert max(lengths.values()) <= most and sum(2.0**-n for n in lengths.values()) == 1
    free = list(counts.values())
    cost = 0
    while len(free) > 1:
        free.sort()
        cost += free[0] + free[1]
        free = [free[0] + free[1], *free[2:]]
    assert sum(counts[s] * n for s, n in streams.code_lengths(counts, 40).items()) == cost
    assert streams.code_lengths({5: 1}) == {5: 1} and streams.code_lengths({}) == {}
    rows = [(r.length, r.code) for r in Q.queries()["optimal_codes"](spark, SF).collect()]
    words = sorted(format(c, f"0{n}b") for n, c in rows)
    assert not any(b.startswith(a) for a, b in zip(words, words[1:]))


def test_brute_force_takes_the_filter_that_packs_best(spark):
    lines = {(r.image, r.y): bytes(r.line) for r in rasters.scanlines(spark, SF).collect()}
    for r in Q.queries()["strategy_brute_force"](spark, SF).collect():
        line, above, tried = lines[(r.image, r.y)], lines.get((r.image, r.y - 1), bytes(64)), []
        for kind in range(5):
            made = bytearray()
            for x, v in enumerate(line):
                a, b, c = (line[x - 1], above[x], above[x - 1]) if x else (0, above[0], 0)
                p = a + b - c
                nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                made.append((v - [0, a, b, (a + b) // 2, nearest][kind]) % 256)
            tried.append((len(zlib.compress(bytes(made), 9)), kind, bytes(made)))
        _, kind, made = min(tried)
        assert (r.kind, r.total, r.weighted) == (kind, sum(made), sum(v * (i + 1) for i, v in enumerate(made)))


def test_images_stay_small(spark):
    lines = rasters.scanlines(spark, "/root/testdata/sf0.1")
    assert lines.groupBy("image").count().agg({"count": "max"}).first()[0] <= rasters.VECTORS and lines.select("image").distinct().count() > 20


def test_outcomes_that_stop_a_query(spark):
    df = spark.range(1)
    for made in (outcome.get(outcome.err(F.lit("bad"))), outcome.expect(outcome.err(F.lit("bad")), "told"), outcome.error(outcome.ok(F.lit(5)))):
        with pytest.raises(Exception, match="bad|5"):
            df.select(made.alias("x")).collect()


@pytest.fixture(scope="module")
def late_keys(tmp_path_factory):
    """Customers whose keys exceed 16 bits, and DuckDB's view of them."""
    folder, c = tmp_path_factory.mktemp("late"), duckdb.connect()
    c.execute(f"COPY (SELECT c_custkey + 65500 AS c_custkey, * EXCLUDE (c_custkey) FROM '{SF}/customer.parquet') TO '{folder}/customer.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet'")
    return str(folder), c


def beside_sql(spark, late_keys, name):
    folder, c = late_keys
    got, want = frame(Q.queries()[name](spark, folder).toPandas()), frame(c.execute(Q.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
    for column in got.columns:
        a, b = ([None if pd.isna(v) else str(v).removesuffix(".0") for v in f[column]] for f in (got, want))
        assert a == b, column


def test_metadata_chunks_of_keys_beyond_16_bits(spark, late_keys):
    beside_sql(spark, late_keys, "metadata_chunks")


def test_metadata_fields_of_keys_beyond_16_bits(spark, late_keys):
    beside_sql(spark, late_keys, "metadata_fields")


def test_metadata_info_of_keys_beyond_16_bits(spark, late_keys):
    beside_sql(spark, late_keys, "metadata_info")


def test_animations_are_encoded_and_decoded_once(spark):
    plan = Q.queries()["animation_frames"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 4  # encoding and decoding in each half


@pytest.mark.parametrize("name", ["animation_info", "png_auto_mode", "auto_mode_wide"])
def test_images_go_by_arrow_in_bounded_batches(spark, name):
    plan = Q.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    kinds = {line.rstrip().rsplit(" ", 1)[1] for line in plan.splitlines() if "ArrowEvalPython [" in line}
    assert kinds == {"250"}  # Spark's number of scalar Arrow functions; pandas' is 200
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
