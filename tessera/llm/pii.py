"""Personal data: patterns propose spans, checksums confirm them, nearby context words move the score.

Everything is a DataFrame expression on the row's own text, so the operator is one narrow map over the
scan: no shuffle, no Python, nothing that grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPAN, body, bound, count_kind, digest_text, spans_of, text_around

#: Kinds in the order in which spans that start together are listed, and their patterns.
#: The possessive and look-behind forms match what the plain forms match, without backtracking over long runs.
#: For iban the pattern proposes a start only; what follows it is looked at in a look-ahead, and lengths are tried on that.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Letters and digits of an IBAN by country, as registered. Of other countries each length of 15 to 34 is tried.
IBAN_LENGTHS = {
    c: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in codes.split()
}
#: A literal without which a pattern can't match: a cheap test before the pattern runs.
NEEDS = {"email": "@", "phone": "+"}
#: Score before context, and the words that raise it when they stand shortly before or behind the span.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pay)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|whatsapp)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer)\b",
    "ssn": r"(?i)\b(?:ssn|social security|taxpayer)\b",
}
#: Words that lower the score: what follows them is a number of another sort.
AGAINST = {
    "email": r"(?i)\b(?:example|placeholder)\b",
    "ip": r"(?i)\b(?:version|release|section|chapter)\b",
    "card": r"(?i)\b(?:isbn|serial|tracking|order)\b",
    "phone": r"(?i)\b(?:version|equation|coordinates)\b",
    "iban": r"(?i)\b(?:serial|licen[cs]e key|part number)\b",
    "ssn": r"(?i)\b(?:order|invoice|part number|tracking|isbn|serial)\b",
}


def _luhn(hit: Column) -> Column:
    digits = F.reverse(F.regexp_replace(hit, "[^0-9]", ""))

    def worth(i: Column) -> Column:
        d = F.substring(digits, i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + worth(i))
    return F.when(F.length(digits).between(14, 19), total % 10 == 0).otherwise(False)


def _mod97(hit: Column) -> Column:
    plain = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def more(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(more(a, c))) == 1


def _iban_spans(text: Column) -> Column:
    """Of each proposed start, the longest span of a fitting length that ends at a word end and passes mod-97."""
    lengths = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])
    ahead = F.regexp_extract_all(text, F.lit(PATTERNS["iban"]), F.lit(1))

    def stops(run: Column) -> Column:
        # code points of the run up to its n-th letter or digit, for each n to try
        filled = F.filter(F.sequence(F.lit(1), F.length(run)), lambda i: F.substring(run, i, F.lit(1)) != " ")
        listed = F.try_element_at(lengths, F.left(run, F.lit(2)))
        tried = F.when(listed.isNotNull(), F.array(listed)).otherwise(F.sequence(F.lit(15), F.lit(34)))
        ends = F.transform(tried, lambda n: F.get(filled, n - 1))
        return F.filter(ends, lambda e: ~F.substring(run, e + 1, F.lit(1)).rlike("[A-Za-z0-9]") & _mod97(F.left(run, e)))

    runs = F.zip_with(
        spans_of(text, PATTERNS["iban"]),
        ahead,
        lambda s, a: F.struct(s["start"].alias("start"), F.concat(s["hit"], a).alias("run")),
    )
    ended = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["run"].alias("run"), F.array_max(stops(r["run"])).alias("n")))
    return F.transform(
        F.filter(ended, lambda r: r["n"].isNotNull()),
        lambda r: F.struct(r["start"].alias("start"), (r["start"] + r["n"]).alias("stop"), F.left(r["run"], r["n"]).alias("hit")),
    )


def _valid(kind: str, hit: Column) -> Column:
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    if kind == "ip":
        # compared as text, so that no run of digits is too long for a number
        return F.forall(
            F.split(hit, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.lpad(F.right(p, F.lit(3)), 3, "0") <= "255")
        )
    if kind == "card":
        return _luhn(hit)
    if kind == "phone":
        return digits.between(10, 15)
    if kind == "ssn":
        return ~hit.rlike("^(?:000|666|9)")
    return F.lit(True)


def _adjusted(kind: str, near: Column, boost: float) -> Column:
    """The kind's score, raised by ``boost`` for a word of its context and lowered by it for one against it; 0 to 1."""
    up = F.when(near.rlike(CONTEXT[kind]), F.lit(boost)).otherwise(F.lit(0.0))
    down = F.when(near.rlike(AGAINST[kind]), F.lit(boost)).otherwise(F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(SCORES[kind]) + up - down)), 4)


def _kind_spans(text: Column, kind: str, window: int, boost: float, threshold: float) -> Column:
    found = _iban_spans(text) if kind == "iban" else spans_of(text, PATTERNS[kind])
    if kind in NEEDS:
        found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast(SPAN))

    def scored(valid: Column) -> Column:
        return F.zip_with(
            valid,
            text_around(text, valid, window),
            lambda s, near: F.struct(
                s["start"].alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                s["stop"].alias("stop"),
                F.lit(kind).alias("kind"),
                _adjusted(kind, F.concat_ws("\n", near["before"], near["behind"]), boost).alias("score"),
            ),
        )

    # bound to a name, so that the valid spans are found once
    found = bound(F.filter(found, lambda s: _valid(kind, s["hit"])), scored)
    return found if kind in BASE_KINDS else F.filter(found, lambda s: s["score"] >= threshold)


def find_pii(
    df: DataFrame, text: str = "text", out: str = "pii", window: int = 48, boost: float = 0.3, threshold: float = 0.5
) -> DataFrame:
    """Add ``out``: an array of (start, rank, stop, kind, score), by start and then kind.

    Patterns propose spans; Luhn, mod-97 and range checks confirm them; a context word among the ``window``
    code points before or behind a span raises its score by ``boost``, a word that speaks against the kind lowers it.
    Base kinds always stay; iban and ssn need ``threshold``. Null or empty text: an empty array. A text of any length
    is scanned whole, in time linear in it and its spans. Repeated rows are judged alike; ids and other columns play no part and
    are kept, an older column called ``out`` is replaced.
    """
    # One column a kind: a match array is then computed once and not once for each use.
    kinds = [_kind_spans(body(text), k, window, boost, threshold) for k in KINDS]
    return df.withColumn(out, F.array_sort(F.concat(*kinds)))


def redact(df: DataFrame, text: str = "text", pii: str = "pii") -> DataFrame:
    """Replace each found span by its kind in brackets; of overlapping spans the first wins. Null text stays null."""

    def cut(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(
            s["start"] >= acc["at"],
            F.struct(F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["stop"].alias("at")),
        ).otherwise(acc)

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(
        F.col(pii), start, cut, lambda a: F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(F.col(text))))
    )
    return df.withColumn(text, F.when(F.size(pii) > 0, done).otherwise(F.col(text)))


def pii_report(df: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans, and the scores in their order."""
    found = find_pii(df.select("doc_id", "text"), "text", "pii").select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE_KINDS))
    return found.select(
        "doc_id",
        *[count_kind("pii", k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(digest_text(base), 256).alias("base_sha256"),
        digest_text(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
