"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, media, mixing, ngram_join, packing, pii, quality, secrets, suffix_dedup, warc
from tessera.llm.common import read


def _over(table: str, report: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(read(spark, sf_dir, table))

    return query


def tokenizer() -> str:
    """The vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": _over("documents", pii.pii_report),
        "op2_mixing": _over("documents", mixing.mix_report),
        "op3_secrets": _over("documents", secrets.secrets_report),
        "op4_exact_dedup": _over("documents", exact_dedup.exact_groups),
        "op5_ngram_join": _over("documents", ngram_join.ngram_groups),
        "op6_media": _over("documents", media.media_report),
        "op7_quality": lambda spark, d: quality.quality_report(read(spark, d, "documents"), read(spark, d, "labels")),
        "op8_warc": _over("pages", warc.warc_report),
        "op9_suffix_dedup": _over("documents", partial(suffix_dedup.repeats_report, ordered=True)),
        "op10_packing": _over("documents", partial(packing.pack_documents, tokenizer=tokenizer())),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2, "op4_exact_dedup": OP4, "op5_ngram_join": OP5, "op8_warc": OP8, "op9_suffix_dedup": OP9}


OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (
  SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest,
         max(page_id) OVER (PARTITION BY html) AS original,
         row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS place
  FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND place > 1 THEN original END AS refers_to
FROM r
"""


OP4 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 8) AS BIGINT) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
-- Fullest first: the level at which all before are full and this one isn't.
levels AS (
  SELECT *, (1.5 * (SELECT sum(source_size) FROM sources)
             - 2.0 * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST)),
lifted AS (SELECT coalesce(max(level), 0) AS level FROM levels),
targets AS (
  SELECT source, source_size, least(2.0 * source_size, level * weight) AS target FROM sources, lifted),
placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(round(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS passes,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - passes * source_size - before)) AS BIGINT) AS taken, source
FROM placed
"""

OP9 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS o, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT rid, o, i, substr(h, 2 * i - 1, 100) AS s FROM (SELECT rid, o, h, unnest(range(1, n - 48)) AS i FROM d)),
f AS (SELECT s, min(o) AS first FROM w GROUP BY s),
g AS (SELECT rid, i FROM w JOIN f USING (s) WHERE o > first),
p AS (SELECT rid, i, substr(h, 2 * i - 1, 2) AS b FROM (SELECT rid, h, unnest(range(1, n + 1)) AS i FROM d)),
c AS (SELECT rid, i, b, coalesce(i - max(g.i) OVER (PARTITION BY rid ORDER BY p.i) < 50, false) AS gone FROM p LEFT JOIN g USING (rid, i)),
e AS (SELECT rid, i, b, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), false) AS opens FROM c),
r AS (SELECT rid, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r USING (rid)
"""
OP5 = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS tid, text, least, n FROM (SELECT coalesce(text, '') AS text, min(doc_id) AS least, count(*) AS n FROM documents GROUP BY 1)),
w AS (SELECT tid, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM t),
s AS (SELECT DISTINCT tid, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT tid, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
z AS (SELECT tid, count(*) AS z FROM s GROUP BY tid),
-- a gram of all words of a short text has fewer blanks than any gram of a long one, so they don't meet
i AS (SELECT a.tid AS u, b.tid AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.tid < b.tid GROUP BY 1, 2),
l AS (SELECT u, v FROM i JOIN z a ON a.tid = u JOIN z b ON b.tid = v WHERE CAST(shared AS DOUBLE) / (a.z + b.z - shared) >= 0.8),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach AS (SELECT u AS tid, u AS other FROM (SELECT DISTINCT u FROM e) UNION SELECT reach.tid, e.v FROM reach JOIN e ON e.u = reach.other),
c AS (SELECT reach.tid, min(t.least) AS class_id FROM reach JOIN t ON t.tid = reach.other GROUP BY 1),
k AS (SELECT u AS tid, count(*) AS texts, CAST(sum(t.n) AS BIGINT) AS docs FROM e JOIN t ON t.tid = e.v GROUP BY 1)
SELECT d.doc_id, CASE WHEN c.tid IS NULL THEN t.least ELSE c.class_id END AS class_id, CAST(t.n - 1 + coalesce(k.docs, 0) AS BIGINT) AS n_links, coalesce(k.texts, 0) AS n_text_links
FROM documents d JOIN t ON t.text = coalesce(d.text, '') LEFT JOIN c ON c.tid = t.tid LEFT JOIN k ON k.tid = t.tid
"""
