"""Best-fit packing: large pieces are matched in pairs, smaller ones best-fit what is left.

What is packed are lengths, of which there are at most ``capacity``: the plan is made from their counts alone,
in runs of equal bins, so neither pieces nor bins reach the driver. A piece finds its place by its rank among
the pieces of its length, a distributed running count.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import CACHES, arrow_map, materialize, sums_before

END_ID = 2
#: Fixed value: how the byte-level vocabulary cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a Python worker remembers during a task.
CACHE_ENTRIES = 250_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: White space other than single spaces and line ends that no space precedes.
ODD = ["  ", " \n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]


class Encoder(dict):
    """Ids of a byte-level BPE as little-endian unsigned 32-bit bytes.

    A cut of the text always falls before a single space, so what stands between spaces is encoded once and
    remembered in this mapping. Texts with other runs of white space are encoded whole, and whatever has rare
    letters or the string of a special token goes to the tokenizer of the file itself.
    """

    def __init__(self, file: bytes):
        import tiktoken

        self.file = file
        spec = json.loads(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        as_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        ranks = {bytes(as_byte[c] for c in t): i for t, i in vocab.items()}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.opens = np.zeros(max(ranks.values()) + 1, dtype=bool)  # ids whose bytes begin with a space
        self.opens[[i for b, i in ranks.items() if b[:1] == b" "]] = True

    @cached_property
    def slow(self):
        """The tokenizer of the file, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.file.decode())

    def whole(self, text: str) -> bytes:
        if text.isascii() or max(text) < "\u0250":
            return array("I", self.fast(text)).tobytes()
        return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, words: list[str]) -> None:
        """Encode new words in one go; an id that begins with a space begins a word."""
        rare = [w for w in words if not (w.isascii() or max(w) < "\u0250")]
        for w in rare:
            self[w] = self.whole(" " + w)
        plain = [w for w in words if w not in self] if rare else words
        if plain:
            ids = np.array(self.fast(" " + " ".join(plain)), dtype="<u4")
            cuts = [*(np.flatnonzero(self.opens[ids]) * 4).tolist(), len(ids) * 4]
            raw = ids.tobytes()
            self.update(zip(plain, [raw[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        if any(s in text for s in ODD):
            return self.whole(text)
        if len(self) > CACHE_ENTRIES:
            self.clear()
        first, *words = text.split(" ")
        known = list(map(self.get, words))
        if None in known:
            self.learn(list(dict.fromkeys(w for w, ids in zip(words, known, strict=True) if ids is None)))
            known = map(self.__getitem__, words)
        return (self.whole(first) if first else b"") + b"".join(known)


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str, file: Callable[[], bytes]) -> Encoder:
    """The encoder of a vocabulary file, one for each Python worker; ``name`` tells files apart."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(file())
        CACHES.append(_ENCODERS[name])
    return _ENCODERS[name]


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Only what is longer than ``capacity`` is cut; the first piece takes the remainder."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def tokenize(df: DataFrame, tokenizer: str, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and with ``with_ids`` the ids as bytes.

    A document's ids end with 2, so null and empty texts have one piece of one id. Texts are taken whole, however long;
    equal rows give equal pieces; null ids stay null; an empty table gives no rows; other columns play no part. The
    driver reads the file ``tokenizer`` and sends its bytes, some megabytes, to the executors.
    """
    with open(tokenizer, "rb") as f:
        raw = f.read()
    file, name = df.sparkSession.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, lambda: file.value)
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = encode(text.as_py() or "") + end
                    at = 0
                    for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                        piece = ids[at * 4 : (at + n) * 4]
                        out.append((doc_id, k, at, n, zlib.crc32(piece), *([piece] if with_ids else [])))
                        at += n
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
                columns = zip(*out, strict=True) if out else [[]] * len(kinds)
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(arrow_map, run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins for counts of lengths, as runs of equal bins: ([(length, times), ...], number of bins).

    Two pieces above a third of the capacity fill a bin at most. Each, from the longest down, takes the longest
    partner that fits. Then each smaller length, from the longest down, goes to the smallest gap that holds it.
    """
    left = dict(counts)
    gaps: list[list[list]] = [[] for _ in range(capacity + 1)]

    def put(pattern: list[tuple[int, int]], bins: int) -> None:
        if bins:
            gaps[capacity - sum(n * k for n, k in pattern)].append([pattern, bins])

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        for b in large:
            if not left[a]:
                break
            if b > a or a + b > capacity or not left[b]:
                continue
            k = left[a] // 2 if a == b else min(left[a], left[b])
            put([(a, 2)] if a == b else [(a, 1), (b, 1)], k)
            left[a] -= k
            left[b] -= k
        put([(a, 1)], left[a])
        left[a] = 0
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = next((g for g in range(n, capacity + 1) if gaps[g]), None)
            if gap is None:
                pattern, bins, gap = [], -(-left[n] // (capacity // n)), capacity
            else:
                pattern, bins = gaps[gap].pop()
            times = gap // n
            full = min(bins, left[n] // times)
            put([*pattern, (n, times)], full)
            left[n] -= full * times
            bins -= full
            if bins and left[n]:
                put([*pattern, (n, left[n])], 1)
                left[n] = 0
                bins -= 1
            if pattern:
                put(pattern, bins)
    return [(pattern, bins) for at in gaps for pattern, bins in at]


def places(runs: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, times) for the lengths of a plan, by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, bins in runs:
        offset = 0
        for n, times in pattern:
            rows.append((n, rank.get(n, 0), sequence, offset, times))
            rank[n] = rank.get(n, 0) + bins * times
            offset += n * times
        sequence += bins
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 1024, rows_per_range: int = 2_000) -> DataFrame:
    """Add sequence_id and offset (older ones replaced) to rows with doc_id, piece, start, length, ids_crc32; lengths are 1 to ``capacity``.

    Rows that agree in everything are placed apart. An empty table gives no rows.
    """
    pieces = materialize(pieces.drop("sequence_id", "offset"), "pieces")
    counts = materialize(pieces.groupBy("length").agg(F.count("*").alias("rows")), "piece-counts")
    where = places(plan({r["length"]: r["rows"] for r in counts.collect()}, capacity))  # at most ``capacity`` rows
    spread = counts.select(F.col("length").alias("l"), F.ceil(F.col("rows") / rows_per_range).alias("ranges"))
    dealt = pieces.join(spread, pieces["length"] == spread["l"]).withColumn("range", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "ranges")).drop("l", "ranges")
    sums = dealt.groupBy("length", "range").agg(F.count("*").alias("n"))
    sums = sums_before(sums, "length", "range", "n", "before").select("length", "range", "before")
    inside = Window.partitionBy("length", "range").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(sums, ["length", "range"])
    ranked = ranked.select(*pieces.columns, (F.col("rank") + F.col("before")).alias("_rank"))
    shared = pieces.sparkSession.sparkContext.broadcast(where)
    names = [*pieces.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        keys = (at[:, 0] << 44) + at[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            row = at[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            made = [pa.array(row[:, 2] + nth // row[:, 4]), pa.array(row[:, 3] + nth % row[:, 4] * length)]
            yield pa.record_batch([*[batch.column(c) for c in names[:-2]], *made], names=names)

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.transform(arrow_map, place, schema)


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one id; texts of any length are cut, never shortened; null and repeated ids
    and repeated rows are packed like others, pieces that agree in everything apart. An empty table gives no rows; other
    columns play no part.
    """
    return pack(tokenize(df, tokenizer, capacity), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, of rows that have ``ids``: sequence_id, n_pieces, ids (little-endian bytes).

    A sequence has at most ``capacity`` ids, whatever the input. An empty table gives no rows; null doc_ids do no harm.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), joined.alias("ids"))
