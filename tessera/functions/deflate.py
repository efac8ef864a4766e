"""The deflate format in the open: tokens, prefix codes, blocks. For analysis; bulk work uses zlib."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

from tessera.operators.streams import code_lengths, ladder

#: Default values: window, the match length that ends a search, the longest match that waits for a longer one, and how
#: far back a match of the least length may lie.
WINDOW, NICE, LAZY, FAR = 2048, 128, 64, 4096
#: Fixed values of the format.
LEAST, LONGEST = 3, 258
#: Fixed value of the format: the order in which lengths of the code-length code are stored.
LENGTH_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)
END = 256
Token = int | tuple[int, int]


LENGTHS = [*ladder(3, 28, 4, 8), (258, 0)]
DISTANCES = ladder(1, 30, 2, 4)
#: Fixed value of the format: lengths of the fixed literal code.
FIXED = [8] * 144 + [9] * 112 + [7] * 24 + [8] * 8


def _code_of(value: int, ladder: list[tuple[int, int]]) -> tuple[int, int, int]:
    """Code, rest and extra bits of a length or distance."""
    k = max(i for i, (base, _) in enumerate(ladder) if base <= value)
    return k, value - ladder[k][0], ladder[k][1]


def tokens(data: bytes, window: int = WINDOW, lazy: bool = True, chain: int = 256) -> Iterator[Token]:
    """Literals and (length, distance) pairs. Of the last ``chain`` places with the same three bytes the longest match is taken,
    of equally long ones the nearest. One of up to ``LAZY`` bytes gives way to one at the next byte that is longer by two."""
    seen: dict[bytes, list[int]] = {}

    def best(i: int) -> tuple[int, int]:
        found = (0, 0)
        for j in reversed(seen.get(data[i : i + LEAST], [])[-chain:]):
            if i - j > window:
                break
            n, most = LEAST, min(LONGEST, len(data) - i)
            while n < most and data[j + n] == data[i + n]:
                n += 1
            if n > found[0]:
                found = (n, i - j)
            if n >= min(NICE, most):
                break
        return found if found[0] > LEAST or found[1] <= FAR else (0, 0)

    def note(i: int) -> None:
        if i + LEAST <= len(data):
            seen.setdefault(data[i : i + LEAST], []).append(i)

    i, ready = 0, None
    while i < len(data):
        n, back = ready or best(i)
        ready = None
        note(i)
        if n and lazy and n <= LAZY and i + 1 < len(data) and (later := best(i + 1))[0] > n + 1:
            yield data[i]
            i, ready = i + 1, later
        elif n:
            yield n, back
            for k in range(i + 1, i + n):
                note(k)
            i += n
        else:
            yield data[i]
            i += 1


def expand(stream: Iterator[Token] | list[Token]) -> bytes:
    """The bytes that tokens stand for; a match may overlap what it makes."""
    out = bytearray()
    for t in stream:
        if isinstance(t, int):
            out.append(t)
        else:
            n, back = t
            if not 0 < back <= len(out):
                raise ValueError("a match reaches back too far")
            for _ in range(n):
                out.append(out[-back])
    return bytes(out)


def canonical(lengths: list[int]) -> list[int]:
    """Codes by symbol: shorter ones first, those of a length in order of their symbols."""
    codes, code, last = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        codes[s], last = code, n
        code += 1
    if lengths and any(lengths) and code > 1 << last:
        raise ValueError("more codes than bits allow")
    return codes


class _Bits:
    """Bits from the low end of each byte."""

    def __init__(self, data: bytes = b""):
        self.data, self.at, self.held, self.n = data, 0, 0, 0
        self.out = bytearray()

    def take(self, n: int) -> int:
        while self.n < n:
            if self.at >= len(self.data):
                raise ValueError("deflate stream is cut short")
            self.held |= self.data[self.at] << self.n
            self.at += 1
            self.n += 8
        value = self.held & ((1 << n) - 1)
        self.held >>= n
        self.n -= n
        return value

    def align(self) -> None:
        self.held, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.held |= value << self.n
        self.n += n
        while self.n >= 8:
            self.out.append(self.held & 255)
            self.held >>= 8
            self.n -= 8

    def put_code(self, code: int, n: int) -> None:
        for k in range(n - 1, -1, -1):
            self.put(code >> k & 1, 1)

    def flush(self) -> bytes:
        if self.n:
            self.put(0, 8 - self.n)
        return bytes(self.out)


class _Tree:
    def __init__(self, lengths: list[int]):
        self.symbols = {(n, c): s for s, (n, c) in enumerate(zip(lengths, canonical(lengths), strict=True)) if n}

    def read(self, bits: _Bits) -> int:
        code = 0
        for n in range(1, 16):
            code = code << 1 | bits.take(1)
            if (n, code) in self.symbols:
                return self.symbols[n, code]
        raise ValueError("no such code")


def _read_lengths(bits: _Bits) -> tuple[_Tree, _Tree]:
    literals, distances, n = bits.take(5) + 257, bits.take(5) + 1, bits.take(4) + 4
    first = [0] * 19
    for k in LENGTH_ORDER[:n]:
        first[k] = bits.take(3)
    tree, out = _Tree(first), []
    while len(out) < literals + distances:
        s = tree.read(bits)
        if s < 16:
            out.append(s)
        elif s == 16:
            if not out:
                raise ValueError("nothing to repeat")
            out += [out[-1]] * (3 + bits.take(2))
        else:
            out += [0] * (3 + bits.take(3) if s == 17 else 11 + bits.take(7))
    if len(out) > literals + distances or not out[END]:
        raise ValueError("illegal code lengths")
    return _Tree(out[:literals]), _Tree(out[literals:])


def read_tokens(data: bytes) -> Iterator[Token]:
    """Tokens of a raw deflate stream; stored blocks give literals."""
    bits, last = _Bits(data), False
    while not last:
        last, kind = bool(bits.take(1)), bits.take(2)
        if kind == 0:
            bits.align()
            n, check = bits.take(16), bits.take(16)
            if n ^ check != 0xFFFF or bits.at + n > len(data):
                raise ValueError("illegal stored block")
            yield from data[bits.at : bits.at + n]
            bits.at += n
            continue
        if kind == 3:
            raise ValueError("no such block type")
        tree, far = (_Tree(FIXED), _Tree([5] * 32)) if kind == 1 else _read_lengths(bits)
        while (s := tree.read(bits)) != END:
            if s < END:
                yield s
                continue
            if s - 257 >= len(LENGTHS):
                raise ValueError("no such length")
            base, extra = LENGTHS[s - 257]
            n = base + bits.take(extra)
            d = far.read(bits)
            if d >= len(DISTANCES):
                raise ValueError("no such distance")
            yield n, DISTANCES[d][0] + bits.take(DISTANCES[d][1])


def inflate(data: bytes, raw: bool = False) -> bytes:
    """Bytes of a zlib stream, checked, or of a raw one."""
    if raw:
        return expand(read_tokens(data))
    if len(data) < 6 or (data[0] * 256 + data[1]) % 31 or data[0] & 15 != 8 or data[1] & 32:
        raise ValueError("no zlib header")
    out = expand(read_tokens(data[2:-4]))
    if zlib.adler32(out) != int.from_bytes(data[-4:], "big"):
        raise ValueError("wrong Adler-32")
    return out


def _pack_lengths(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Code lengths with runs folded: (symbol, rest, extra bits)."""
    out, i = [], 0
    while i < len(lengths):
        v, n = lengths[i], 1
        while i + n < len(lengths) and lengths[i + n] == v:
            n += 1
        if v == 0 and n >= 3:
            n = min(n, 138)
            out.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
        elif v and n >= 4:
            n = min(n, 7)
            out += [(v, 0, 0), (16, n - 4, 2)]
        else:
            out += [(v, 0, 0)] * n
        i += n
    return out


def _lengths_for(counts: Counter, size: int, most: int) -> list[int]:
    found = code_lengths(counts, most)
    return [found.get(s, 0) for s in range(size)]


def _blocks(stream: Iterator[Token], size: int) -> list[list[Token]]:
    """Tokens in blocks that stand for ``size`` bytes or, where a match crosses the end, a few more."""
    out, held = [[]], 0
    for t in stream:
        if held >= size:
            out.append([])
            held = 0
        out[-1].append(t)
        held += 1 if isinstance(t, int) else t[0]
    return out


def deflate(data: bytes, mode: str = "dynamic", window: int = WINDOW, lazy: bool = True, block: int | None = None) -> bytes:
    """A zlib stream in blocks of one kind: stored, fixed or dynamic. Matches reach back over the starts of blocks."""
    bits = _Bits()
    if mode == "stored":
        block = block or 65_535
        parts = [data[i : i + block] for i in range(0, len(data), block)] or [b""]
    elif mode == "fixed":
        parts = [list(tokens(data, window, lazy))]
    else:
        parts = _blocks(tokens(data, window, lazy), block or max(len(data) // 8 + 8, 65_535))
    for k, part in enumerate(parts):
        bits.put(k == len(parts) - 1, 1)
        bits.put(("stored", "fixed", "dynamic").index(mode), 2)
        if mode == "stored":
            bits.flush()
            bits.out += len(part).to_bytes(2, "little") + (len(part) ^ 0xFFFF).to_bytes(2, "little") + part
            continue
        coded = []
        for t in part:
            if isinstance(t, int):
                coded.append(((t, 0, 0), None))
            else:
                c, rest, extra = _code_of(t[0], LENGTHS)
                coded.append(((257 + c, rest, extra), _code_of(t[1], DISTANCES)))
        coded.append(((END, 0, 0), None))
        literal, distance = FIXED, [5] * 32
        if mode == "dynamic":
            literal = _lengths_for(Counter(a[0] for a, _ in coded), 286, 15)
            distance = _lengths_for(Counter(b[0] for _, b in coded if b) or Counter([0]), 30, 15)
            while len(literal) > 257 and not literal[-1]:
                literal.pop()
            while len(distance) > 1 and not distance[-1]:
                distance.pop()
            folded = _pack_lengths(literal + distance)
            first = _lengths_for(Counter(s for s, _, _ in folded), 19, 7)
            order = [first[s] for s in LENGTH_ORDER]
            while len(order) > 4 and not order[-1]:
                order.pop()
            for value, n in ((len(literal) - 257, 5), (len(distance) - 1, 5), (len(order) - 4, 4), *((v, 3) for v in order)):
                bits.put(value, n)
            codes = canonical(first)
            for s, rest, extra in folded:
                bits.put_code(codes[s], first[s])
                bits.put(rest, extra)
        near, far = canonical(literal), canonical(distance)
        for (s, rest, extra), b in coded:
            bits.put_code(near[s], literal[s])
            bits.put(rest, extra)
            if b:
                bits.put_code(far[b[0]], distance[b[0]])
                bits.put(b[1], b[2])
    return b"\x78\x01" + bits.flush() + zlib.adler32(data).to_bytes(4, "big")
