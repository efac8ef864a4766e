"""Repeated passages: longest-previous-factor arrays over all stretches of text that documents share.

A string of ``LENGTH`` bytes is removed where it also starts in an earlier document. Equal strings have equal
least hashes of their grams of ``GRAM`` bytes, so every string is filed under its least hash, its key; neighbours
with the same key form a run, a stretch of text. Hashes only say where to look; bytes decide. Three passes:

1. Map tasks file the keys of their documents; owners of key ranges say which keys occur in more than one document.
   A string with any other key has no earlier match.
2. The stretches of those keys, equal ones of a task merged, go to the owners of their keys as text. An owner merges
   equal bytes: of an equal stretch all copies but the earliest go whole. The different stretches of a key have
   their suffixes sorted; from the longest common prefixes of neighbours and the previous and next smaller positions
   in suffix order comes the longest previous factor of each suffix, up to ``LENGTH`` bytes, and a suffix whose factor
   has ``LENGTH`` bytes goes. A key of over ``SPLIT`` documents is cut into finer keys by grams of ``FINE`` bytes,
   which leave a string three places: so many copies of a common line are merged before they are sent.
3. The removed spans of each document are joined to its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, body, deal, materialize

LENGTH = 50
GRAM = 16
FINE = 48
#: Documents of a key beyond which its strings are dealt by finer keys.
SPLIT = 20_000
CHUNK_BYTES = 1 << 20
HELD_RUNS = 1_500_000
HELD_BYTES = 24 << 20
#: Documents are numbered in two bytes while they are held; the last number stands for several at once.
HELD_DOCS = 60_000
SEVERAL = 0xFFFF
OWNER_BYTES = 256 << 20
SORTED_STRINGS = 400_000
LAST = (1 << 63) - 1

_RNG = np.random.default_rng(5)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = np.uint64(40)
_MASK = np.uint64((1 << 40) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def runs(data: np.ndarray, bounds: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of documents that lie one after another: document, start in ``data``, strings, least hash."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    h, width, windows = _hashed(data, gram), 1, LENGTH - gram + 1
    least = _mix(h + np.uint64(gram))
    while width * 2 <= windows:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < windows:
        least = np.minimum(least[: width - windows], least[windows - width :])
    inside = np.arange(n - LENGTH + 1) + LENGTH <= np.repeat(bounds[1:], np.diff(bounds))[: n - LENGTH + 1]
    change = np.flatnonzero(least[1:] != least[:-1])
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[change + 1] |= inside[change + 1]
    last[change] |= inside[change]
    start, stop = np.flatnonzero(first), np.flatnonzero(last)
    return np.searchsorted(bounds, start, side="right") - 1, start, stop - start + 1, _mix(least[start] + np.uint64(1))


def _hashed(data: np.ndarray, gram: int) -> np.ndarray:
    """A polynomial hash of each ``gram`` bytes: powers of two of them, joined."""
    power = lambda k: np.uint64(pow(int(_BASE), k, 1 << 64))
    h, width, made, done = _BYTE[data], 1, None, 0
    while True:
        if gram & width:
            size = len(data) - done - width + 1
            made = h[:size] if made is None else made[:size] * power(width) + h[done : done + size]
            done += width
        if done == gram:
            return made
        h = h[:-width] * power(width) + h[width:]
        width *= 2


def keys(least: np.ndarray, buckets: int) -> np.ndarray:
    """The key of a least hash: its bucket and 40 bits. Keys that clash only bring stretches together in vain."""
    return (((least >> _BITS) % np.uint64(buckets)) << _BITS) | (least & _MASK)


def _blob(*parts: np.ndarray) -> bytes:
    return b"".join(np.array([len(p)], "<u8").tobytes() + p.tobytes() for p in parts)


def _arrays(raw: bytes, kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds.split():
        n = int(np.frombuffer(raw, "<u8", 1, at)[0])
        a = np.frombuffer(raw, kind, n, at + 8)
        at += 8 + a.nbytes
        out.append(a)
    return out


def _pack(values: np.ndarray) -> np.ndarray:
    """The low five bytes of each."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :5].ravel()


def _unpack(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = raw.reshape(-1, 5)
    return wide.view(np.uint64).ravel()


def _starts(*sorted_by: np.ndarray) -> np.ndarray:
    """Where groups of equal values begin."""
    n = len(sorted_by[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for a in sorted_by:
        new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


_ZSTD = pa.Codec("zstd", compression_level=3)


def _packed(data: bytes) -> bytes:
    return np.array([len(data)], "<u8").tobytes() + _ZSTD.compress(data, asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return _ZSTD.decompress(memoryview(data)[8:], int(np.frombuffer(data, "<u8", 1)[0]), asbytes=True)


def _row(row: tuple) -> pa.RecordBatch:
    bucket, src, kind, data = row
    return pa.record_batch([pa.array([bucket], pa.int64()), pa.array([src], pa.int64()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "src", "kind", "data"])


SENT = "bucket long, src long, kind int, data binary"


class _Sources:
    """Numbers for what a task sends at once: equal when the task is run again over the same rows."""

    def __init__(self):
        self.next = TaskContext.get().partitionId() << 24

    def __call__(self) -> int:
        self.next += 1
        return self.next


def pieces(text: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """(start, piece) of a text in pieces of ``size`` bytes, each string of ``LENGTH`` bytes in exactly one.

    Keys are those of strings, so a cut only divides a run; memory is bounded however long a text is.
    """
    step = max(size, 2 * LENGTH) - LENGTH + 1
    for at in range(0, max(len(text) - LENGTH + 1, 1), step):
        yield at, text[at : at + step + LENGTH - 1]


def _chunk(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), np.uint8), bounds


def _file(buckets: int):
    """Pass 1, map side: kind 0 has keys for an owner, kind 1 the documents sent and the keys that several of them have."""

    def flush(src: int, docs: list[tuple], held: list[tuple]) -> Iterator[tuple]:
        table = np.array(docs, np.int64).reshape(-1, 3)
        doc, key = (np.concatenate([h[i] for h in held]) for i in range(2))
        by = np.lexsort((doc, key))
        doc, key = doc[by], key[by]
        once = _starts(key, doc)
        doc, key = doc[once], key[once]
        group = _starts(key)
        size = np.diff(np.r_[group, len(key)])
        order = table[doc, 0]
        several = np.minimum.reduceat(order, group) < np.maximum.reduceat(order, group) if len(key) else np.zeros(0, bool)
        shared = np.repeat(several, size)
        yield src % buckets, src, 1, _blob(table.ravel(), doc[shared].astype("<u2"), key[shared])
        alone, together = np.flatnonzero(~shared), group[several]
        many = size[several]
        bounds = np.arange(buckets + 1, dtype=np.uint64) << _BITS
        cut, cut2 = np.searchsorted(key[alone], bounds), np.searchsorted(key[together], bounds)
        for b in range(buckets):
            mine, ours = alone[cut[b] : cut[b + 1]], together[cut2[b] : cut2[b + 1]]
            if len(mine) or len(ours):
                own, local = np.unique(doc[mine], return_inverse=True)
                packed = _pack(np.concatenate([key[mine], key[ours]]))
                yield b, src, 0, _blob(own.astype("<u2"), table[own, 0], local.astype("<u2"), many[cut2[b] : cut2[b + 1]].astype("<u4"), packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources = _Sources()
        docs: list[tuple] = []
        held: list[tuple] = []
        texts: list[bytes] = []
        owner: list[int] = []
        size = n_runs = 0

        def scan() -> int:
            data, bounds = _chunk(texts)
            piece, _, _, least = runs(data, bounds)
            held.append((np.array(owner, np.int64)[piece], keys(least, buckets)))
            texts.clear()
            owner.clear()
            return len(piece)

        for batch in batches:
            for o, t1, t2, text in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3), strict=True):
                text = text.as_py()
                if len(text) < LENGTH:
                    continue
                docs.append((o, t1, t2))
                for _, piece in pieces(text, CHUNK_BYTES):
                    texts.append(piece)
                    owner.append(len(docs) - 1)
                    size += len(piece)
                    if size >= CHUNK_BYTES:
                        n_runs += scan()
                        size = 0
                if n_runs >= HELD_RUNS or len(docs) >= HELD_DOCS:
                    if texts:
                        scan()
                    yield from map(_row, flush(sources(), docs, held))
                    docs, held, size, n_runs = [], [], 0, 0
        if texts:
            scan()
        if docs:
            yield from map(_row, flush(sources(), docs, held))

    return run


def _share(bucket: int, parts: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Pass 1, owner side: for each source the documents and keys that others share: 1, or 2 where a key is to be split."""
    m, lo, hi, n, d, at = [], [], [], [], [], []
    for k, (_, raw) in enumerate(parts):
        own, order, local, many, packed = _arrays(raw, "<u2 <i8 <u2 <u4 u1")
        m.append(_unpack(packed))
        lo += [order[local], np.full(len(many), -LAST)]
        hi += [order[local], np.full(len(many), LAST)]
        n += [np.ones(len(local), np.int64), many.astype(np.int64)]
        d += [own[local], np.full(len(many), SEVERAL, np.uint16)]
        at.append(np.full(len(m[-1]), k, np.int32))
    m, lo, hi, n, d, at = map(np.concatenate, (m, lo, hi, n, d, at))
    by = np.argsort(m, kind="stable")
    m, d, at = m[by], d[by], at[by]
    group = _starts(m)
    shared = np.minimum.reduceat(lo[by], group) < np.maximum.reduceat(hi[by], group)
    verdict = np.where(shared, np.where(np.add.reduceat(n[by], group) > SPLIT, 2, 1), 0)
    verdict = np.repeat(verdict, np.diff(np.r_[group, len(m)]))
    told = (verdict > 0) & ((d != SEVERAL) | (verdict == 2))
    key = m | (np.uint64(bucket) << _BITS)
    by = np.flatnonzero(told)[np.argsort(at[told], kind="stable")]
    cuts = np.searchsorted(at[by], np.arange(len(parts) + 1))
    for k, (src, _) in enumerate(parts):
        mine = by[cuts[k] : cuts[k + 1]]
        if len(mine):
            yield src, _blob(d[mine].astype("<u2"), key[mine], verdict[mine].astype(np.uint8))


def _own(answer):
    """Owner side of a pass: rows come by bucket; kind 1 passes through, the others are answered bucket by bucket as kind 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            for bucket, src, kind, data in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if kind == 1:
                    yield _row((bucket, src, 1, data))
                    continue
                if bucket != at and parts:
                    yield from (_row((at, s, 2, a)) for s, a in answer(at, parts))
                    parts = []
                at = bucket
                parts.append((src, data))
        if parts:
            yield from (_row((at, s, 2, a)) for s, a in answer(at, parts))

    return run


def _collect(close):
    """Rows come by source; ``close`` makes a batch of what belongs to the documents of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            for src, kind, data in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                if src != at and parts:
                    yield close(parts)
                    parts = []
                at = src
                parts.append((kind, data))
        if parts:
            yield close(parts)

    return run


def _by_document(table: np.ndarray, doc: np.ndarray, values: list[tuple[str, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A row (o, t1, t2, ...) for each document in ``doc``; of each (name, mask, values) the masked ones, as bytes."""
    some = np.unique(doc)
    table = table.reshape(-1, 3)[some]
    columns, names = [pa.array(table[:, i]) for i in range(3)], ["o", "t1", "t2"]
    for name, mask, value in values:
        mine = np.flatnonzero(mask)
        mine = mine[np.argsort(doc[mine], kind="stable")]
        cuts, held = np.searchsorted(doc[mine], np.r_[some, some[-1:] + 1] if len(some) else []), value[mine]
        columns.append(pa.array([held[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()))
        names.append(name)
    return pa.record_batch(columns, names=names)


def _shared_keys(parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """End of pass 1: the shared keys of each document that has any; those to be split apart."""
    doc, key, verdict = [], [], []
    for kind, raw in parts:
        if kind == 1:
            table, d, k = _arrays(raw, "<i8 <u2 <u8")
            v = np.ones(len(d), np.uint8)
        else:
            d, k, v = _arrays(raw, "<u2 <u8 u1")
        doc.append(d)
        key.append(k)
        verdict.append(v)
    doc, key, verdict = map(np.concatenate, (doc, key, verdict))
    real = doc != SEVERAL
    verdict = np.where(np.isin(key, key[~real]), 2, verdict)[real]
    doc, key = doc[real].astype(np.int64), key[real]
    return _by_document(table, doc, [("shared", verdict == 1, key), ("split", verdict == 2, key)])


def _listed(doc: np.ndarray, key: np.ndarray, lists: list[bytes]) -> np.ndarray:
    """Which (document, key) are among the keys listed for the document."""
    sizes = np.array([len(x) // 8 for x in lists], np.int64)
    if not sizes.any():
        return np.zeros(len(doc), bool)
    known = np.frombuffer(b"".join(lists), "<u8")
    code = lambda d, k: _mix(k + (d.astype(np.uint64) + np.uint64(1)) * _BASE)
    return np.isin(code(doc, key), code(np.repeat(np.arange(len(lists)), sizes), known))


def _send(buckets: int):
    """Pass 2, map side: kind 0 has the stretches and runs for an owner, kind 1 the documents sent."""

    def flush(src: int, docs: list[tuple], distinct: dict[bytes, int], key: list[int], held: list[tuple]) -> Iterator[tuple]:
        table = np.array(docs, np.int64).reshape(-1, 3)
        yield src % buckets, src, 1, _blob(table.ravel())
        key = np.array(key, np.uint64)
        texts = np.empty(len(distinct), object)
        texts[:] = list(distinct)
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        which, doc, start = (np.concatenate([h[i] for h in held]) for i in range(3))
        bucket = (key >> _BITS).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
        runs_by = np.argsort(place[which], kind="stable")
        of = place[which][runs_by]
        cut2 = np.searchsorted(of, cut)
        for b in range(buckets):
            mine, ours = by[cut[b] : cut[b + 1]], runs_by[cut2[b] : cut2[b + 1]]
            if len(mine):
                own, local = np.unique(doc[ours], return_inverse=True)
                head = _blob(
                    own.astype("<u2"), table[own, 0], key[mine], sizes[mine].astype("<u4"), (of[cut2[b] : cut2[b + 1]] - cut[b]).astype("<u4"),
                    local.astype("<u2"), start[ours].astype("<u4"),
                )
                yield b, src, 0, _packed(np.array([len(head)], "<u8").tobytes() + head + b"".join(texts[mine]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources = _Sources()
        docs: list[tuple] = []
        texts: list[bytes] = []
        lists: list[tuple[bytes, bytes]] = []
        owner: list[tuple[int, int]] = []  # document of a piece, and where it starts in that
        distinct: dict[bytes, int] = {}
        key: list[int] = []
        held: list[tuple] = []
        size = kept = 0

        def add(data: bytes, doc: np.ndarray, start: np.ndarray, strings: np.ndarray, k: np.ndarray, inside: np.ndarray) -> int:
            """``start`` counts in ``data``, ``inside`` in the document."""
            new = 0
            which = []
            for a, b, c in zip(start.tolist(), (start + strings + LENGTH - 1).tolist(), k.tolist()):
                piece = data[a:b]
                i = distinct.get(piece)
                if i is None:
                    distinct[piece] = i = len(key)
                    key.append(c)
                    new += b - a + 100
                which.append(i)
            held.append((np.array(which, np.int64), doc, inside))
            return new + 20 * len(which)

        def scan() -> int:
            raw = b"".join(texts)
            data, bounds = _chunk(texts)
            part, start, strings, least = runs(data, bounds)
            k = keys(least, buckets)
            doc, first = np.array(owner, np.int64).reshape(-1, 2)[part].T
            inside = start - bounds[part] + first
            of = _listed(part, k, [a for a, _ in lists])
            new = add(raw, doc[of], start[of], strings[of], k[of], inside[of])
            fine = np.flatnonzero(_listed(part, k, [b for _, b in lists]))
            if len(fine):
                cut = [raw[a:b] for a, b in zip(start[fine].tolist(), (start + strings + LENGTH - 1)[fine].tolist())]
                data2, bounds2 = _chunk(cut)
                piece, start2, strings2, least2 = runs(data2, bounds2, FINE)
                whole = fine[piece]
                new += add(b"".join(cut), doc[whole], start2, strings2, keys(least2, buckets), inside[whole] + start2 - bounds2[piece])
            texts.clear()
            lists.clear()
            owner.clear()
            return new

        for batch in batches:
            for o, t1, t2, shared, split, text in zip(*[batch.column(c).to_pylist() for c in ("o", "t1", "t2", "shared", "split")], batch.column("text"), strict=True):
                docs.append((o, t1, t2))
                for at, piece in pieces(text.as_py(), CHUNK_BYTES):
                    texts.append(piece)
                    lists.append((shared, split))
                    owner.append((len(docs) - 1, at))
                    size += len(piece)
                    if size >= CHUNK_BYTES:
                        kept += scan()
                        size = 0
                if kept >= HELD_BYTES or len(docs) >= HELD_DOCS:
                    if texts:
                        scan()
                    yield from map(_row, flush(sources(), docs, distinct, key, held))
                    docs, distinct, key, held, size, kept = [], {}, [], [], 0, 0
        if texts:
            scan()
        if docs:
            yield from map(_row, flush(sources(), docs, distinct, key, held))

    return run


def suffix_order(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``data`` (eight more bytes at its end) at ``at``, sorted by group and ``length`` bytes, equal ones in
    the order given; and the longest common prefix of each with the one before, up to ``length``, 0 between groups."""
    word, width = data.astype(np.uint64), 1
    words = {1: word}
    while width < 8:
        word = (word[:-width] << np.uint64(8 * width)) | word[width:]
        width *= 2
        words[width] = word
    columns, k = [], 0
    while k < length:
        width = next(w for w in (8, 4, 2, 1) if w <= length - k)
        columns.append((width, words[width][at + k]))
        k += width
    by = np.lexsort((*[c for _, c in columns[::-1]], group))
    lcp = np.zeros(len(by), np.int32)
    open_ = np.zeros(len(by), bool)
    open_[1:] = group[by[1:]] == group[by[:-1]]
    for width, column in columns:
        here = np.flatnonzero(open_)
        differ = column[by[here]] ^ column[by[here - 1]]
        lcp[here] += sum((differ < np.uint64(1 << 8 * i)).astype(np.int32) for i in range(width))
        open_[here[differ > 0]] = False
    return by, lcp


def previous_factors(order: np.ndarray, lcp: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The longest previous factor of each suffix, given in suffix order; factors below ``length`` may come out shorter.

    The nearest position before, and behind, whose ``order`` is smaller is reached by jumps over positions that aren't;
    the common prefix with it is the least on the way, and a way is left once that falls below ``length``.
    """
    n = len(order)

    def nearest(order: np.ndarray, low: np.ndarray) -> np.ndarray:
        to = np.arange(-1, n - 1)
        going = np.arange(n)
        while len(going):
            going = going[(to[going] >= 0) & (low[going] >= length)]
            going = going[order[to[going]] >= order[going]]
            over = to[going]
            low[going], to[going] = np.minimum(low[going], low[over]), to[over]
        return np.where((to >= 0) & (order[to] < order), low, 0)

    before = nearest(order, lcp.copy())
    behind = nearest(order[::-1], np.r_[np.zeros(min(n, 1), lcp.dtype), lcp[:0:-1]])[::-1]
    return np.maximum(before, behind)


def earlier_strings(stretches: list[bytes], group: np.ndarray, order: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, start) of the strings of ``length`` bytes that occur in a stretch of their group with a smaller order."""
    sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
    data = np.frombuffer(b"".join(stretches) + bytes(8), np.uint8)
    strings = sizes - length + 1
    owner = np.repeat(np.arange(len(sizes)), strings)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    by, lcp = suffix_order(data, (np.cumsum(sizes) - sizes)[owner] + inside, group[owner], length)
    found = np.sort(by[previous_factors(order[owner[by]], lcp, length) >= length])
    return owner[found], inside[found]


def _settle(bucket: int, parts: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Pass 2, owner side: for each source the spans that go: (document, start, stop)."""
    distinct: dict[bytes, int] = {}
    key, which, order, doc, start, at = [], [], [], [], [], []
    for k, (_, packed) in enumerate(parts):
        raw = _unpacked(packed)
        head = int(np.frombuffer(raw, "<u8", 1)[0])
        own, o, gid, sizes, of, local, starts = _arrays(raw[8 : 8 + head], "<u2 <i8 <u8 <u4 <u4 <u2 <u4")
        ends = (8 + head + np.cumsum(sizes.astype(np.int64))).tolist()
        number = np.empty(len(sizes), np.int64)
        a = 8 + head
        for i, b in enumerate(ends):
            number[i] = distinct.setdefault(raw[a:b], len(distinct))
            a = b
        new = number >= len(key)
        key += gid[np.flatnonzero(new)[_first_seen(number[new])]].tolist()
        which.append(number[of])
        order.append(o[local])
        doc.append(own[local])
        start.append(starts.astype(np.int64))
        at.append(np.full(len(of), k, np.int32))
    which, order, doc, start, at = map(np.concatenate, (which, order, doc, start, at))
    texts, key = list(distinct), np.array(key, np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    by = np.lexsort((order, which))
    first = order[by][_starts(which[by])]
    a, b, n = _gone(texts, key, first, sizes)
    gone_at = np.r_[0, np.cumsum(n)]
    copy = order > first[which]
    partly = np.flatnonzero(~copy & (n[which] > 0))
    times = n[which[partly]]
    row = np.repeat(partly, times)
    span = np.repeat(gone_at[which[partly]] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(len(row)) if len(row) else row
    whole = np.flatnonzero(copy)
    out = np.concatenate([whole, row])
    lo = np.concatenate([start[whole], start[row] + a[span]])
    hi = np.concatenate([start[whole] + sizes[which[whole]], start[row] + b[span]])
    by = np.argsort(at[out], kind="stable")
    out, lo, hi = out[by], lo[by], hi[by]
    cuts = np.searchsorted(at[out], np.arange(len(parts) + 1))
    for k, (src, _) in enumerate(parts):
        mine = slice(cuts[k], cuts[k + 1])
        if cuts[k] < cuts[k + 1]:
            yield src, _blob(doc[out[mine]].astype("<u2"), lo[mine].astype("<u4"), hi[mine].astype("<u4"))


def _first_seen(numbers: np.ndarray) -> np.ndarray:
    """Where each number occurs first; numbers rise by one whenever they are new."""
    return np.unique(numbers, return_index=True)[1]


def _gone(texts: list[bytes], key: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (start, stop) of each text that lie in earlier texts of its key, and how many there are; ``SORTED_STRINGS`` at a time."""
    by = np.lexsort((first, key))
    group = _starts(key[by])
    size = np.diff(np.r_[group, len(by)])
    # only a key with stretches of two documents can have an earlier match
    mixed = first[by][group] < first[by][group + size - 1] if len(group) else np.zeros(0, bool)
    by = by[np.repeat(mixed, size)]
    ends = np.cumsum(size[mixed])
    strings = np.cumsum(sizes[by] - LENGTH + 1)
    owner, starts = [], []
    lo = 0
    while lo < len(by):
        full = np.searchsorted(strings, (strings[lo - 1] if lo else 0) + SORTED_STRINGS)
        hi = ends[min(np.searchsorted(ends, full, side="left"), len(ends) - 1)]
        part = by[lo:hi]
        o, s = earlier_strings([texts[i] for i in part], key[part], first[part])
        owner.append(part[o])
        starts.append(s)
        lo = hi
    owner, starts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, starts))
    by = np.lexsort((starts, owner))
    owner, starts = owner[by], starts[by]
    opens = np.ones(len(owner), bool)
    opens[1:] = (owner[1:] != owner[:-1]) | (starts[1:] - starts[:-1] > LENGTH)
    a = np.flatnonzero(opens)
    stop = starts[np.r_[a[1:] - 1, len(owner) - 1]] + LENGTH if len(owner) else starts
    return starts[a], stop, np.bincount(owner[a], minlength=len(texts))


def _spans(parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """End of pass 2: the spans that go of each document that has any, as pairs of starts and stops."""
    doc, pairs = [np.zeros(0, np.int64)], [np.zeros((0, 2), "<i4")]
    for kind, raw in parts:
        if kind == 1:
            (table,) = _arrays(raw, "<i8")
        else:
            d, a, b = _arrays(raw, "<u2 <u4 <u4")
            doc.append(d.astype(np.int64))
            pairs.append(np.stack([a, b], axis=1).astype("<i4"))
    doc, pairs = np.concatenate(doc), np.concatenate(pairs)
    return _by_document(table, doc, [("spans", np.ones(len(doc), bool), pairs)])


def _cut(with_text: bool):
    """Pass 3: the spans that go and the text of a document give what is kept."""
    names = ["o", "t1", "t2", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for o, t1, t2, spans, text in zip(*[batch.column(c).to_pylist() for c in ("o", "t1", "t2", "spans")], batch.column("text"), strict=True):
                data = text.as_py()
                pairs = np.frombuffer(spans, "<i4").reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                reach = np.maximum.accumulate(pairs[:, 1])
                opens = np.r_[True, pairs[1:, 0] > reach[:-1]]
                starts, stops = pairs[opens, 0].tolist(), reach[np.r_[opens[1:], True]].tolist()
                kept = b"".join(data[a:b] for a, b in zip([0, *stops], [*starts, len(data)]))
                out.append((o, t1, t2, len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            kinds = [pa.int64()] * 5 + [pa.string(), *([pa.binary()] if with_text else [])]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


KEY = ("o", "t1", "t2")


def _exchanged(sent: DataFrame, buckets: int, answer, close, schema: str) -> DataFrame:
    """Send to owners, answer, and bring the answers to the documents."""
    answered = deal(sent, "bucket", buckets).sortWithinPartitions("bucket").transform(arrow_map, _own(answer), SENT)
    return answered.repartition("src").sortWithinPartitions("src").transform(arrow_map, _collect(close), "o long, t1 long, t2 long, " + schema)


def _changes(docs: DataFrame, with_text: bool) -> DataFrame:
    """(o, t1, t2, n_removed, n_spans, kept_sha256[, kept]) of the documents that lose something."""
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-total // OWNER_BYTES))
    filed = docs.select(*KEY, "text").transform(arrow_map, _file(buckets), SENT)
    told = materialize(_exchanged(filed, buckets, _share, _shared_keys, "shared binary, split binary"), "suffix-keys").dropDuplicates([*KEY])
    affected = materialize(docs.select(*KEY, "text").join(told, [*KEY]), "suffix-affected", partitions, KEY)
    sent = affected.transform(arrow_map, _send(buckets), SENT)
    spans = materialize(_exchanged(sent, buckets, _settle, _spans, "spans binary"), "suffix-spans").dropDuplicates([*KEY])
    schema = "o long, t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return affected.select(*KEY, "text").join(spans, [*KEY]).transform(arrow_map, _cut(with_text), schema).dropDuplicates([*KEY])


def _documents(df: DataFrame, ordered: bool) -> DataFrame:
    """With keys of id and text. What tasks send is numbered in the order of rows, so that order must hold in a second run."""
    text = F.encode(body(), "UTF-8")
    docs = df.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("o"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), text.alias("text"))
    return docs if ordered else materialize(docs, "suffix-documents")


def repeats_report(df: DataFrame, ordered: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte goes that a string of 50 bytes covers which also starts in a document with a smaller doc_id, judged on
    the input. A null doc_id is larger than any; rows with equal ids don't affect each other. Null text counts as
    empty; texts under 50 bytes stay whole, longer ones of any length are searched whole. An empty table gives no rows;
    other columns play no part. ``ordered`` says that a task of ``df`` that is run again has its rows in the same order,
    as scans of files do; otherwise the documents are written first.
    """
    docs = _documents(df, ordered)
    changed = _changes(docs, False)
    every = docs.select("doc_id", "o", "t1", "t2", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256"))
    joined = every.join(changed, ["o", "t1", "t2"], "left")
    return joined.select("doc_id", "n_bytes", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_removed", "n_spans")], F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))


def remove_repeats(df: DataFrame, ordered: bool = False) -> DataFrame:
    """``df`` with repeated passages cut out of ``text``, as ``repeats_report`` counts them, all columns kept.

    Bytes of a character that lost others are dropped. Null text stays null.
    """
    docs = _documents(df, ordered)
    changed = _changes(docs, True).select(F.col("o").alias("_o"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("kept").alias("_kept"), F.col("n_removed").alias("_n"))
    text = F.encode(body(), "UTF-8")
    on = [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col("_o"), F.xxhash64(text) == F.col("_t1"), F.xxhash64(F.lit("second"), text) == F.col("_t2")]
    kept = F.col("_kept").cast("string")
    cleaned = F.coalesce(F.try_validate_utf8(kept), F.regexp_replace(F.make_valid_utf8(kept), "\ufffd", ""))
    return df.join(changed, on, "left").select(*[F.when(F.col("_n") > 0, cleaned).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in df.columns])
