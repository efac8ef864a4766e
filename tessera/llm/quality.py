"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Words, pairs and triples of words are hashed as they stand (lower case), words and pairs also as shapes, so that
unseen words still tell how they are written. All fall into one table of weights. A batch of texts is one sparse
matrix, its scores one product with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, body, give_back, materialize

BITS = 20
SIZE = 1 << BITS
FORM_BITS = 12
FORMS = 1 << FORM_BITS
#: The bound of the training sample: at most so many labelled rows, those with the least hash of their id.
TRAIN_ROWS = 8_000
PASSES = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Bytes of text that are made into one sparse matrix; a longer text is one by itself.
BLOCK_BYTES = 1 << 20
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.uint64(0x100000001B3)


def _table(of) -> np.ndarray:
    """A code point for each code point; those from U+3000 on stand for themselves."""
    return np.array([ord(c) if len(c := of(chr(p))) == 1 else p for p in range(0x3000)], np.uint32)


_LOWER = _table(str.lower)
#: A upper, a lower, 9 digit, other characters as they are.
_KIND = _table(lambda c: "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c)


def _mapped(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.where(points < len(table), table[np.minimum(points, len(table) - 1)], points)


def _hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A polynomial in the code points of each piece; the pieces begin at ``starts``, the first at 0, none is empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.r_[starts, len(points)])
    power = np.full(sizes.max(), _POWER)
    power[0] = 1
    place = np.arange(len(points)) - np.repeat(starts, sizes)
    total = np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * np.cumprod(power)[place], starts)
    return ((total ^ (total >> np.uint64(31))) * _MULTIPLY) >> np.uint64(33)


def hash_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 31 bits of words in lower case and of their shapes: the kinds of their characters, runs shortened. No word is empty."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    kinds = _mapped(points, _KIND)
    new = np.ones(len(kinds), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[starts] = True
    return _hashes(_mapped(points, _LOWER), starts), _hashes(kinds[new], (np.cumsum(new) - 1)[starts])


def _mix(x: np.ndarray, salt: int, bits: int) -> np.ndarray:
    return (((x + np.uint64(salt)) * _MULTIPLY) >> np.uint64(64 - bits)).astype(np.int64)


class Sparse(NamedTuple):
    """Entries of a sparse matrix with ``rows`` rows; an index may repeat within a row, its values add up."""

    rows: int
    row: np.ndarray
    at: np.ndarray
    x: np.ndarray


def features(texts: pa.Array) -> Sparse:
    """The sparse matrix of ``texts``, a row for each; words are what lies between white space, a null text has none.

    A word, pair or triple of words adds its share of the text. Shapes, pairs of shapes and repeated words are few
    and tell more: they have the square roots of their shares, in the first part of the table. A text without words
    has one entry of its own.
    """
    split = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    row = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False)
    if "" in words:  # white space at an end leaves an empty piece
        none = words.index("")
        real = code != none
        row, code = row[real], code[real]
        code = code - (code > none)
        del words[none]
    word, form = (h[code] for h in hash_words(words))
    n = np.bincount(row, minlength=len(texts))
    two = row[1:] == row[:-1]
    three = two[1:] & two[:-1]
    pair = ((word[:-1] + np.uint64(1)) * _MULTIPLY ^ word[1:])[two]
    triple = (((word[:-2] + np.uint64(1)) * _MULTIPLY ^ word[1:-1]) * _MULTIPLY ^ word[2:])[three]
    forms = (form[1:] * np.uint64(0x100000001B3) + form[:-1])[two]
    again = (word[1:] == word[:-1]).astype(np.uint64)[two]
    row2, row3 = row[1:][two], row[2:][three]
    key = np.concatenate([row << FORM_BITS | _mix(form, 2, FORM_BITS), row2 << FORM_BITS | _mix(forms, 3, FORM_BITS), row2 << FORM_BITS | _mix(again, 4, FORM_BITS)])
    key, count = np.unique(key, return_counts=True)
    few = key >> FORM_BITS
    empty = np.flatnonzero(n == 0)
    many = np.concatenate([row, row2, row3])
    hashed = np.concatenate([_mix(word, 1, BITS), _mix(pair, 5, BITS), _mix(triple, 6, BITS)])
    return Sparse(
        len(texts),
        np.concatenate([few, many, empty]),
        np.concatenate([key & (FORMS - 1), FORMS + hashed % (SIZE - FORMS), np.zeros(len(empty), np.int64)]),
        np.concatenate([np.sqrt(count / n[few]), 1 / n[many], np.ones(len(empty))]),
    )


def blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in slices of at most ``BLOCK_BYTES``, or of one text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    lo = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and size + n > BLOCK_BYTES:
            yield texts[lo:i]
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield texts[lo:]


class Model:
    """Weights of the features and a bias; picklable and small."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        made = [self._product(features(t)) for t in blocks(texts)]
        total = np.concatenate(made) if made else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))

    def _product(self, m: Sparse) -> np.ndarray:
        return np.bincount(m.row, self.weights[m.at] * m.x, m.rows)

    def score(self, text: str) -> float:
        return float(self.scores(pa.array([text], pa.string()))[0])


def fit(texts: list[str], labels: list[int], passes: int = PASSES) -> Model:
    """FTRL-proximal over the rows in their order, ``passes`` times."""
    z, n, bias_z, bias_n = np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0
    rows = []
    for part in blocks(pa.array(texts, pa.large_string())):
        made = features(part)
        once, back = np.unique(made.row << BITS | made.at, return_inverse=True)
        cuts, x = np.searchsorted(once, np.arange(made.rows + 1) << BITS), np.bincount(back, made.x)
        at, x = (once & (SIZE - 1)).astype(np.int32), x.astype(np.float32)
        rows += [(at[a:b], x[a:b]) for a, b in zip(cuts, cuts[1:])]

    def leader(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(passes):
        for (at, x), y in zip(rows, labels, strict=True):
            w = leader(z[at], n[at])
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w @ x + bias, -35, 35))) - y
            gx = g * x
            z[at] += gx - (np.sqrt(n[at] + gx * gx) - np.sqrt(n[at])) / ALPHA * w
            n[at] += gx * gx
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    return Model(leader(z, n).astype(np.float32), float(-bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)))


def held_out():
    """Rows that training never sees: crc32 of the id as text is 2 modulo 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def train(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, passes: int = PASSES) -> Model:
    """A model from at most ``train_rows`` labelled rows that aren't held out, in one task.

    Labels are joined by doc_id; null ids and labels take no part. Of repeated labels of an id the largest counts, of
    repeated documents the text that is least. Texts are taken whole. Without labelled rows every score is 0.5.
    """
    order = F.xxhash64("doc_id")
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    picked = usable.groupBy("doc_id").agg(F.max("quality").alias("y")).orderBy(order, "doc_id").limit(train_rows)
    picked = materialize(picked, "quality-sample")
    rows = documents.select("doc_id", body().alias("text")).join(F.broadcast(picked), "doc_id")  # at most train_rows ids
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        model = fit([t for t, _ in held], [y for _, y in held], passes)
        yield pa.record_batch([[model.weights.tobytes()], [model.bias]], names=["weights", "bias"])

    one = rows.repartition(1).sortWithinPartitions(order, "doc_id", "text").select("text", "y")
    made = one.transform(arrow_map, run, "weights binary, bias double").first()
    return Model(np.frombuffer(made["weights"], np.float32), made["bias"]) if made else Model(np.zeros(SIZE, np.float32), 0.0)


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``df`` with ``score`` and ``predicted``, older columns of these names replaced.

    Null text counts as empty; a text of any length is scored whole; repeated rows are scored alike. Only the text is
    an input of the score.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the input

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield pa.array(shared.value.scores(texts))
        finally:
            give_back()

    found = df.withColumn("score", scored(body(text)))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``df`` that the model accepts, with its columns, whatever they are called."""
    rows = df.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    return score(rows, model, "_text", threshold).where("predicted = 1").select("_row.*")


def quality_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null doc_id isn't held out, an empty table gives no rows."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
