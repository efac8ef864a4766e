"""Raster samples in numpy: packing, scanline filters, interlacing, colour conversion, profiles.

Samples are arrays of shape (height, width, channels). A mode is (colour type, bit depth, palette, key): type 0 grey,
2 RGB, 3 palette, 4 grey and alpha, 6 RGB and alpha; the palette is an array (n, 4); the key a tuple at source depth.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np

#: Fixed values of the format.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Interlace passes: first column, first row, column step, row step.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
NONE, SUB, UP, AVERAGE, PAETH = range(5)


class Mode(NamedTuple):
    color_type: int = 6
    depth: int = 8
    palette: np.ndarray | None = None
    key: tuple[int, ...] | None = None


def check_mode(color_type: int, depth: int) -> None:
    if depth not in DEPTHS.get(color_type, ()):
        raise ValueError(f"colour type {color_type} has no depth {depth}")


def bits_per_pixel(color_type: int, depth: int) -> int:
    return CHANNELS[color_type] * depth


def row_bytes(width: int, bpp: int) -> int:
    return (width * bpp + 7) // 8


def unpack(rows: np.ndarray, width: int, color_type: int, depth: int) -> np.ndarray:
    """Rows of bytes (height, row bytes) as samples; padding bits at row ends are dropped."""
    h, ch = len(rows), CHANNELS[color_type]
    if depth == 8:
        return rows[:, : width * ch].reshape(h, width, ch).astype(np.uint16)
    if depth == 16:
        return rows[:, : width * ch * 2].reshape(h, width * ch, 2).astype(np.uint16).dot(np.array([256, 1], np.uint16)).reshape(h, width, ch)
    bits = np.unpackbits(rows, axis=1)[:, : width * ch * depth].reshape(h, width, ch, depth).astype(np.uint16)
    return bits.dot((1 << np.arange(depth)[::-1]).astype(np.uint16))


def pack(samples: np.ndarray, depth: int) -> np.ndarray:
    """Samples as rows of bytes, rows padded with zero bits."""
    h = len(samples)
    flat = samples.reshape(h, -1)
    if depth == 8:
        return flat.astype(np.uint8)
    if depth == 16:
        return np.stack([flat >> 8, flat & 255], axis=-1).astype(np.uint8).reshape(h, -1)
    bits = (flat[:, :, None] >> np.arange(depth)[::-1].astype(np.uint16)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(h, -1), axis=1)


def pack_flat(samples: np.ndarray, depth: int) -> bytes:
    """Samples without padding between rows."""
    return pack(samples.reshape(1, -1, 1), depth).tobytes()


def unpack_flat(data: bytes, width: int, height: int, color_type: int, depth: int) -> np.ndarray:
    ch = CHANNELS[color_type]
    need = row_bytes(width * height, ch * depth)
    if len(data) < need:
        raise ValueError(f"{len(data)} bytes of pixels, {need} needed")
    row = np.frombuffer(data, np.uint8, need)[None, :]
    return unpack(row, width * height, color_type, depth).reshape(height, width, ch)


def _shifted(line: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros_like(line)
    out[..., step:] = line[..., :-step]
    return out


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The neighbour nearest to a + b - c; of equally near ones left, then up, then up-left."""
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def filter_line(line: np.ndarray, above: np.ndarray, step: int, kind: int) -> np.ndarray:
    """One filtered row, or several; ``above`` is zeros for the first row."""
    left = _shifted(line, step).astype(np.int16)
    if kind == NONE:
        return line
    if kind == SUB:
        guess = left
    elif kind == UP:
        guess = above.astype(np.int16)
    elif kind == AVERAGE:
        guess = (left + above) // 2
    elif kind == PAETH:
        guess = paeth(left, above, _shifted(above, step))
    else:
        raise ValueError(f"no filter {kind}")
    return ((line.astype(np.int16) - guess) & 255).astype(np.uint8)


def unfilter_line(line: np.ndarray, above: np.ndarray, step: int, kind: int) -> np.ndarray:
    if kind == NONE:
        return line
    if kind == UP:
        return line + above
    if kind == SUB:
        wide = np.zeros(-(-len(line) // step) * step, np.uint8)
        wide[: len(line)] = line
        return np.cumsum(wide.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(line)]
    if kind not in (AVERAGE, PAETH):
        raise ValueError(f"no filter {kind}")
    out, up = [0] * step + line.tolist(), [0] * step + above.tolist()
    for i in range(step, len(out)):
        a, b, c = out[i - step], up[i], up[i - step]
        if kind == AVERAGE:
            guess = (a + b) >> 1
        else:
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        out[i] = (out[i] + guess) & 255
    return np.array(out[step:], np.uint8)


#: Bytes of rows that are filtered at once.
BLOCK = 1 << 16


def _line_cost(strategy: str, kind: int, line: np.ndarray) -> float:
    if strategy == "entropy":
        counts = np.bincount(line, minlength=256)
        counts[kind] += 1
        p = counts[counts > 0] / (len(line) + 1)
        return float(-(p * np.log2(p)).sum())
    return len(zlib.compress(line.tobytes(), 9))


def filter_rows(rows: np.ndarray, step: int, strategy: str = "minsum", kinds: list[int] | None = None) -> np.ndarray:
    """Rows with a leading filter byte. Strategies: zero, minsum, entropy, brute_force, predefined (``kinds``, one a row)."""
    h, n = rows.shape
    if strategy == "predefined" and (kinds is None or len(kinds) != h):
        raise ValueError(f"{h} filter kinds are needed")
    out = np.zeros((h, n + 1), np.uint8)
    if strategy == "zero":
        out[:, 1:] = rows
        return out
    if strategy == "predefined":
        above = np.zeros(n, np.uint8)
        for y in range(h):
            out[y, 0], out[y, 1:], above = kinds[y], filter_line(rows[y], above, step, kinds[y]), rows[y]
        return out
    many = max(1, BLOCK // max(n, 1))
    for y in range(0, h, many):
        block = rows[y : y + many]
        above = np.zeros_like(block)
        above[1:] = block[:-1]
        above[:1] = rows[y - 1] if y else 0
        tried = np.stack([filter_line(block, above, step, k) for k in range(5)])
        if strategy == "minsum":
            v = tried.astype(np.int64)
            v[1:] = np.minimum(v[1:], 255 - v[1:])
            costs = v.sum(axis=2)
        else:
            costs = np.array([[_line_cost(strategy, k, line) for line in tried[k]] for k in range(5)])
        best = costs.argmin(axis=0)  # of equal costs the first
        out[y : y + many, 0], out[y : y + many, 1:] = best, tried[best, np.arange(len(block))]
    return out


def unfilter_rows(data: np.ndarray, height: int, n: int, step: int) -> np.ndarray:
    lines = data[: height * (n + 1)].reshape(height, n + 1)
    if not lines[:, 0].any():
        return lines[:, 1:].copy()
    out = np.zeros((height, n), np.uint8)
    above = np.zeros(n, np.uint8)
    for y in range(height):
        above = out[y] = unfilter_line(lines[y, 1:], above, step, int(lines[y, 0]))
    return out


def pass_sizes(width: int, height: int) -> list[tuple[int, int]]:
    return [((width - x + dx - 1) // dx, (height - y + dy - 1) // dy) for x, y, dx, dy in PASSES]


def scan_size(width: int, height: int, bpp: int, interlaced: bool) -> int:
    """Bytes of filtered rows; an empty pass has none."""
    sizes = pass_sizes(width, height) if interlaced else [(width, height)]
    return sum(h * (row_bytes(w, bpp) + 1) for w, h in sizes if w > 0 and h > 0)


def to_scan(samples: np.ndarray, mode: Mode, interlaced: bool = False, strategy: str = "minsum", kinds: list[int] | None = None) -> bytes:
    bpp = bits_per_pixel(mode.color_type, mode.depth)
    step = max(1, bpp // 8)
    if not interlaced:
        return filter_rows(pack(samples, mode.depth), step, strategy, kinds).tobytes()
    parts, at = [], 0
    for x, y, dx, dy in PASSES:
        part = samples[y::dy, x::dx]
        if part.size:
            own = kinds[at : at + len(part)] if kinds is not None else None
            at += len(part)
            parts.append(filter_rows(pack(part, mode.depth), step, strategy, own).tobytes())
    return b"".join(parts)


def from_scan(data: bytes, width: int, height: int, color_type: int, depth: int, interlaced: bool) -> np.ndarray:
    bpp = bits_per_pixel(color_type, depth)
    if len(data) != scan_size(width, height, bpp, interlaced):
        raise ValueError(f"{len(data)} bytes of scanlines, {scan_size(width, height, bpp, interlaced)} expected")
    raw, step = np.frombuffer(data, np.uint8), max(1, bpp // 8)
    if not interlaced:
        return unpack(unfilter_rows(raw, height, row_bytes(width, bpp), step), width, color_type, depth)
    out, at = np.zeros((height, width, CHANNELS[color_type]), np.uint16), 0
    for (x, y, dx, dy), (w, h) in zip(PASSES, pass_sizes(width, height), strict=True):
        if w > 0 and h > 0:
            n = row_bytes(w, bpp)
            out[y::dy, x::dx] = unpack(unfilter_rows(raw[at:], h, n, step), w, color_type, depth)
            at += h * (n + 1)
    return out


def filter_kinds(data: bytes, width: int, height: int, bpp: int, interlaced: bool) -> list[int]:
    """Filter of each row. Interlaced images: even rows have the sixth pass's, odd rows the seventh's."""
    raw = np.frombuffer(data, np.uint8)
    by_pass, at = [], 0
    for w, h in pass_sizes(width, height) if interlaced else [(width, height)]:
        n = row_bytes(w, bpp) + 1
        here = h if w > 0 and h > 0 else 0
        by_pass.append(raw[at : at + here * n : n].tolist() if here else [])
        at += here * n
    if not interlaced:
        return by_pass[0]
    return [(by_pass[5] or by_pass[4] or [0])[min(y // 2, max(len(by_pass[5] or by_pass[4]) - 1, 0))] if y % 2 == 0 else by_pass[6][y // 2] for y in range(height)]


def to_rgba(samples: np.ndarray, mode: Mode, wide: bool = False, direct: bool = True) -> np.ndarray:
    """Samples as RGBA, 8 bits or with ``wide`` 16. ``direct``: an index beyond the palette is transparent black, else opaque black."""
    s, top = samples.astype(np.int64), 65535 if wide else 255
    out = np.empty((*s.shape[:2], 4), np.int64)
    if mode.color_type == 3:
        palette = np.asarray(mode.palette if mode.palette is not None else np.zeros((0, 4)), np.int64).reshape(-1, 4)
        index = s[:, :, 0]
        known = index < len(palette)
        out[:] = palette[np.where(known, index, 0)] if len(palette) else 0
        out[~known] = (0, 0, 0, 0 if direct else 255)
        return out
    colour = s[:, :, :1] if mode.color_type in (0, 4) else s[:, :, :3]
    if wide:
        scaled = colour
    elif mode.depth == 16:
        scaled = colour >> 8
    else:
        scaled = colour * 255 // ((1 << mode.depth) - 1)
    out[:, :, :3] = scaled
    if mode.color_type in (4, 6):
        alpha = s[:, :, -1]
        out[:, :, 3] = alpha >> 8 if mode.depth == 16 and not wide else alpha
    else:
        out[:, :, 3] = top
        if mode.key is not None:
            out[(colour == np.array(mode.key)[: colour.shape[2]]).all(axis=2), 3] = 0
    return out


def from_rgba(rgba: np.ndarray, mode: Mode, wide: bool = False) -> np.ndarray:
    """RGBA as samples of a mode. Grey is the red sample; alpha is dropped where the mode has none."""
    if mode.color_type == 3:
        palette = np.asarray(mode.palette, np.int64).reshape(-1, 4)[: 1 << mode.depth]
        codes = {tuple(c): i for i, c in enumerate(palette.tolist())}  # of equal colours the last
        found, back = np.unique(rgba.reshape(-1, 4), axis=0, return_inverse=True)
        try:
            index = np.array([codes[tuple(c)] for c in found.tolist()], np.uint16)
        except KeyError as e:
            raise ValueError(f"the palette lacks colour {e}") from None
        return index[back.ravel()].reshape(*rgba.shape[:2], 1)
    picked = {0: [0], 2: [0, 1, 2], 4: [0, 3], 6: [0, 1, 2, 3]}[mode.color_type]
    s = rgba[:, :, picked]
    if not wide:
        s = s * 257 if mode.depth == 16 else s >> (8 - mode.depth)
    return s.astype(np.uint16)


def same_mode(a: Mode, b: Mode) -> bool:
    if (a.color_type, a.depth, a.key) != (b.color_type, b.depth, b.key):
        return False
    none = np.zeros((0, 4))
    return a.color_type != 3 or np.array_equal(a.palette if a.palette is not None else none, b.palette if b.palette is not None else none)


def convert(samples: np.ndarray, source: Mode, target: Mode) -> np.ndarray:
    """Samples of one mode as samples of another; a palette target without colours takes the source's."""
    if target.color_type == 3 and (target.palette is None or not len(target.palette)):
        target = target._replace(palette=source.palette)
    if same_mode(source, target):
        return samples
    wide = source.depth == 16 and target.depth == 16
    direct = target.depth == 8 and target.color_type in (2, 6)
    return from_rgba(to_rgba(samples, source, wide, direct), target, wide)


class Profile(NamedTuple):
    colored: bool
    alpha: bool
    key: tuple[int, int, int] | None
    colors: int
    bits: int
    palette: np.ndarray


def required_bits(grey: np.ndarray) -> int:
    """1 for 0 and 255 alone, 2 for multiples of 85, 4 for multiples of 17, else 8."""
    return next((b for b, m in ((1, 255), (2, 85), (4, 17)) if not (grey % m).any()), 8)


def profile(samples: np.ndarray, mode: Mode) -> Profile:
    """What a smaller mode must hold. The palette has at most 256 colours by first appearance; colours count to 257."""
    wide = mode.depth == 16 and bool(((samples >> 8) != (samples & 255)).any())
    rgba = to_rgba(samples, mode, wide, True)
    flat, top = rgba.reshape(-1, 4), 65535 if wide else 255
    colored = bool((flat[:, :3] != flat[:, :1]).any())
    clear = flat[:, 3] == 0
    alpha = bool(((flat[:, 3] != top) & ~clear).any())
    key = None
    if clear.any() and not alpha:
        keys = np.unique(flat[clear, :3], axis=0)
        if len(keys) > 1 or (flat[~clear, :3] == keys[0]).all(axis=1).any():
            alpha = True
        else:
            key = tuple(int(v) for v in keys[0])
    found, first = np.unique(flat, axis=0, return_index=True)
    bits = 16 if wide else max(8 if colored else 1, required_bits(flat[:, 0]) if not colored else 8)
    if alpha and not wide:
        bits = max(bits, 8)
    palette = found[np.argsort(first)][:256] if not wide else np.zeros((0, 4), np.int64)
    return Profile(colored, alpha, key, min(len(found), 257), bits, palette)


def auto_mode(p: Profile, pixels: int, source: Mode) -> Mode:
    """The smallest mode that loses nothing."""
    alpha, bits, key = p.alpha, p.bits, p.key
    if key is not None and pixels <= 16:
        alpha, bits, key = True, max(bits, 8), None
    grey_ok = not p.colored and not alpha
    palette_bits = 1 if p.colors <= 2 else 2 if p.colors <= 4 else 4 if p.colors <= 16 else 8
    if p.colors <= 256 and 2 * p.colors < pixels and bits <= 8 and not (grey_ok and bits <= palette_bits):
        keep = source.color_type == 3 and source.depth == palette_bits and len(source.palette) >= len(p.palette)
        return Mode(3, palette_bits, source.palette if keep else p.palette)
    color_type = (6 if p.colored else 4) if alpha else (2 if p.colored else 0)
    depth = bits if color_type == 0 else max(bits, 8)
    if key is None or alpha:
        return Mode(color_type, depth)
    low = tuple(k & ((1 << depth) - 1) if bits > 8 else k >> (8 - depth) if depth < 8 else k for k in key)
    return Mode(color_type, depth, None, low[:1] if color_type == 0 else low)
