"""Secrets: strong patterns stand alone; weak parts of a credential count only beside their complements.

Identifiers, secrets and endpoints of one document meet in an interval join: spans are hashed to
(document, scope, bin) with bins as wide as the window, a long one to all bins that it covers; the parts of a
bin are first reduced to their least and greatest position, and each weak span then meets the bins from a window
before its start to a window behind its stop. No pairs of spans are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPAN, body, bound, count_kind, digest_text, materialize, running_sums, spans_of

#: Kinds in listing order and their patterns; the length floors are part of the patterns,
#: which changes nothing: a match that is too short has no longer match inside it.
KINDS = ("assign", "access", "hex", "ident", "blob", "endpoint")
BASE_KINDS = KINDS[:3]
_ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
PATTERNS = {
    "assign": _ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
    "ident": r"(?i)\b(?:client_?id|access_?key_?id|user(?:name)?|login|account)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}+",
    "blob": r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*+[0-9])[A-Za-z0-9+/]{32,}+={0,2}",
    "endpoint": r"\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9.@:-]++",
}
#: The part a kind plays, and the parts of which one must be near for a weak kind to count.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "ident": "id", "blob": "secret", "endpoint": "place"}
COMPLEMENT = {"ident": ("secret",), "blob": ("id", "place"), "endpoint": ("secret",)}
BREAK = r"\n[\x20\t]*\n"


def _kind_spans(text: Column, kind: str) -> Column:
    found = spans_of(text, PATTERNS[kind])
    if kind == "assign":
        found = F.filter(found, lambda s: F.length(F.regexp_extract(s["hit"], _ASSIGN, 2)) >= 6)
    if kind == "endpoint":
        found = F.when(F.contains(text, F.lit("://")), found).otherwise(F.array().cast(SPAN))
    if kind == "blob":
        found = F.filter(found, lambda s: ~s["hit"].rlike("^[0-9a-f]*$"))
    return F.transform(
        found,
        lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind")),
    )


def _scoped(spans: Column, breaks: Column) -> Column:
    """``spans``, in order of their starts, with the number of ``breaks`` before each: both are merged and counted once."""
    at = F.concat(
        F.transform(breaks, lambda b: F.struct(b["start"].alias("at"), F.lit(1).cast("long").alias("breaks"))),
        F.transform(spans, lambda s: F.struct((s["start"] + 1).alias("at"), F.lit(0).cast("long").alias("breaks"))),
    )

    def counted(marks: Column) -> Column:
        passed = F.zip_with(marks, running_sums(F.transform(marks, lambda m: m["breaks"])), lambda m, n: F.struct(m["breaks"].alias("breaks"), n.alias("n")))
        scopes = F.filter(passed, lambda p: p["breaks"] == 0)
        return F.zip_with(
            spans, scopes, lambda s, p: F.struct(*[s[c].alias(c) for c in ("start", "rank", "stop", "kind")], p["n"].alias("scope"))
        )

    return bound(F.array_sort(at), counted)


def propose(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``: all strong and weak spans (start, rank, stop, kind, scope), by start and then kind; null text: none.

    The scope is the number of blank lines before the span. Work is linear in the text, its spans and its blank lines.
    """

    def scoped(spans: Column) -> Column:
        weak = F.exists(spans, lambda s: s["rank"] >= len(BASE_KINDS))
        return _scoped(spans, F.when(weak, spans_of(body(text), BREAK)).otherwise(F.array().cast(SPAN)))

    return df.withColumn(out, bound(F.array_sort(F.concat(*[_kind_spans(body(text), k) for k in KINDS])), scoped))


def link_parts(spans: DataFrame, key: list[str], window: int = 256) -> DataFrame:
    """Of one row per span (``key``, start, rank, stop, kind, scope), the strong ones and the weak ones with a complement.

    A complement is a span of a fitting role, in the same scope, with at most ``window`` code points between the two;
    spans that touch or overlap have none between them.
    """
    roles = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])

    def bins(least: Column, greatest: Column) -> Column:
        return F.explode(F.sequence(F.floor(least / window), F.floor(greatest / window)))

    # A span lies in all bins from its start to its stop, cut to each bin; both ends count as part of it.
    held = spans.withColumn("role", roles[F.col("kind")]).withColumn("bin", bins(F.col("start"), F.col("stop")))
    parts = held.groupBy(*key, "scope", "bin", "role").agg(
        F.min(F.greatest(F.col("start"), F.col("bin") * window)).alias("least"),
        F.max(F.least(F.col("stop"), F.col("bin") * window + window - 1)).alias("greatest"),
    )
    weak = spans.where(F.col("rank") >= len(BASE_KINDS))
    wants = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in COMPLEMENT.items() for x in kv])
    low, high = F.col("start") - window, F.col("stop") + window
    near = weak.withColumn("role", F.explode(wants[F.col("kind")])).withColumn("bin", bins(low, high))
    on = [*key, "scope", "bin", "role"]
    # From low to high is wider than a bin, so whatever a bin holds is between them if its extremes aren't beyond.
    met = near.join(parts, on).where((F.col("greatest") >= low) & (F.col("least") <= high))
    cols = [*key, "start", "rank", "stop", "kind"]
    return spans.where(F.col("rank") < len(BASE_KINDS)).select(*cols).unionByName(met.select(*cols).distinct())


def find_secrets(df: DataFrame, text: str = "text", window: int = 256) -> DataFrame:
    """One row per input row: all its columns but ``text``, and ``secrets``: array of (start, rank, stop, kind).

    Null or empty text: an empty array. Rows with equal or null ids are kept apart by a row number that is
    frozen when the spans are written. A ``text`` of any length is scanned whole; time is linear in its length and
    its spans. An older column ``secrets`` is replaced; other columns play no part. An empty table gives no rows.
    """
    rest = [c for c in df.columns if c not in (text, "secrets")]
    rows = df.select(F.struct(*rest).alias("_row"), text).withColumn("_n", F.monotonically_increasing_id())
    found = materialize(propose(rows, text, "_spans").select("_n", "_row", "_spans"), "secret-spans")
    weak_rows = found.where(F.exists("_spans", lambda s: s["rank"] >= len(BASE_KINDS)))
    spans = weak_rows.select("_n", F.inline("_spans"))
    linked = link_parts(spans, ["_n"], window).groupBy("_n").agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "stop", "kind"))).alias("_linked")
    )
    strong = F.transform(F.filter("_spans", lambda s: s["rank"] < len(BASE_KINDS)), lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "stop", "kind")]))
    return found.join(linked, "_n", "left").select("_row.*", F.coalesce("_linked", strong).alias("secrets"))


def secrets_report(df: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans."""
    found = find_secrets(df.select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE_KINDS))
    return found.select(
        "doc_id",
        *[count_kind("secrets", k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(digest_text(base), 256).alias("base_sha256"),
        digest_text(F.col("secrets")).alias("spans"),
    )
