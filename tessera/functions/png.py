"""PNG and animated PNG containers: chunks, metadata, frames, encoding. Errors are ValueErrors."""

from __future__ import annotations

import struct
import zlib
from typing import Any

import numpy as np

from tessera.functions import raster
from tessera.functions.raster import Mode

SIGNATURE = b"\x89PNG\r\n\x1a\n"
LARGEST = (1 << 31) - 1
TAG = {"keyword": "tessera", "text": "1"}
#: Fixed values of the format: layouts of the chunks that are records.
FIELDS = {
    "tIME": (">H5B", ("year", "month", "day", "hour", "minute", "second")), "pHYs": (">IIB", ("x", "y", "unit")), "gAMA": (">I", ("gamma",)),
    "cHRM": (">8I", ("white_x", "white_y", "red_x", "red_y", "green_x", "green_y", "blue_x", "blue_y")), "sRGB": (">B", ("intent",)),
    "acTL": (">II", ("frames", "plays")), "fcTL": (">5IHHBB", ("sequence", "width", "height", "x", "y", "delay_num", "delay_den", "dispose", "blend")),
}


def parse_chunks(data: bytes, ignore_crc: bool = False) -> list[dict[str, Any]]:
    """seq, type, length, crc, data, crc_ok of each chunk up to IEND; a missing IEND is no error."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    out, at = [], 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if size > LARGEST or at + 12 + size > len(data):
            raise ValueError(f"chunk {kind!r} is cut short")
        body = data[at + 8 : at + 8 + size]
        (crc,) = struct.unpack_from(">I", data, at + 8 + size)
        ok = crc == zlib.crc32(kind + body)
        if not ok and not ignore_crc:
            raise ValueError(f"chunk {kind!r} has a wrong CRC")
        out.append({"seq": len(out), "type": kind.decode("latin-1"), "length": size, "crc": crc, "data": body, "crc_ok": ok})
        at += 12 + size
        if kind == b"IEND":
            break
    kinds = [c["type"] for c in out]
    if kinds[:1] != ["IHDR"]:
        raise ValueError("no IHDR first")
    if "IDAT" not in kinds:
        raise ValueError("no IDAT")
    if parse_header(out[0]["data"])["color_type"] == 3 and "PLTE" not in kinds:
        raise ValueError("no PLTE")
    return out


def inflate(data: bytes, ignore_adler: bool = False, most: int | None = None) -> bytes:
    try:
        if ignore_adler:
            z = zlib.decompressobj(-15)
            out = z.decompress(data[2:], most or 0)
        else:
            z = zlib.decompressobj()
            out = z.decompress(data, most or 0)
    except zlib.error as e:
        raise ValueError(str(e)) from None
    if not z.eof and z.unconsumed_tail:
        raise ValueError("more inflated bytes than expected")
    if not z.eof:
        raise ValueError("deflate stream is cut short")
    return out


def parse_header(d: bytes) -> dict[str, int]:
    if len(d) != 13:
        raise ValueError("IHDR must have 13 bytes")
    names = ("width", "height", "bit_depth", "color_type", "compression", "filter", "interlace")
    h = dict(zip(names, struct.unpack(">IIBBBBB", d), strict=True))
    raster.check_mode(h["color_type"], h["bit_depth"])
    if not (1 <= h["width"] <= LARGEST and 1 <= h["height"] <= LARGEST and h["compression"] == 0 and h["filter"] == 0 and h["interlace"] in (0, 1)):
        raise ValueError("illegal header")
    return h


def _keyword(d: bytes) -> tuple[str, bytes]:
    word, sep, rest = d.partition(b"\0")
    if not sep or not 1 <= len(word) <= 79:
        raise ValueError("a keyword needs 1 to 79 bytes")
    return word.decode("latin-1"), rest


def _parse_itext(d: bytes) -> dict[str, str]:
    word, rest = _keyword(d)
    if len(rest) < 2 or rest[1] != 0:
        raise ValueError("unknown compression")
    packed, (language, _, rest) = rest[0], rest[2:].partition(b"\0")
    translated, _, text = rest.partition(b"\0")
    text = inflate(text) if packed else text
    return {"keyword": word, "language": language.decode("latin-1"), "translated": translated.decode("utf-8", "replace"), "text": text.decode("utf-8", "replace")}


def _parse_suggested(d: bytes) -> dict[str, Any]:
    name, rest = _keyword(d)
    depth = rest[0] if rest else 0
    if depth not in (8, 16) or (len(rest) - 1) % (6 if depth == 8 else 10):
        raise ValueError("illegal sPLT")
    return {"name": name, "depth": depth, "entries": [list(e) for e in struct.iter_unpack(">4BH" if depth == 8 else ">5H", rest[1:])]}


def parse_ancillary(kind: str, d: bytes, header: dict[str, int], palette_size: int) -> dict[str, Any] | None:
    """Fields of an ancillary or animation chunk; None for one that is carried as it is."""
    ct, depth = header["color_type"], header["bit_depth"]
    if kind in FIELDS:
        form, names = FIELDS[kind]
        if len(d) != struct.calcsize(form):
            raise ValueError(f"{kind} has {len(d)} bytes")
        f = dict(zip(names, struct.unpack(form, d), strict=True))
        if kind == "tIME" and not (1 <= f["month"] <= 12 and 1 <= f["day"] <= 31 and f["hour"] <= 23 and f["minute"] <= 59 and f["second"] <= 60):
            raise ValueError("illegal time")
        if kind == "fcTL" and not (f["width"] > 0 and f["height"] > 0 and f["x"] + f["width"] <= header["width"] and f["y"] + f["height"] <= header["height"]):
            raise ValueError("a frame lies outside the canvas")
        return f
    if kind == "bKGD":
        size = {0: 2, 4: 2, 2: 6, 6: 6, 3: 1}[ct]
        if len(d) < size:
            raise ValueError("bKGD is cut short")
        v = list(d[:1]) if ct == 3 else list(struct.unpack(f">{size // 2}H", d[:size]))
        return dict(zip("rgb", v * 3 if len(v) == 1 else v))
    if kind == "tEXt":
        word, rest = _keyword(d)
        return {"keyword": word, "text": rest.decode("latin-1")}
    if kind in ("zTXt", "iCCP"):
        word, rest = _keyword(d)
        if rest[:1] != b"\0":
            raise ValueError("unknown compression")
        plain = inflate(rest[1:])
        return {"keyword": word, "text": plain.decode("latin-1")} if kind == "zTXt" else {"name": word, "profile": plain}
    if kind == "iTXt":
        return _parse_itext(d)
    if kind == "sPLT":
        return _parse_suggested(d)
    if kind == "hIST":
        if not palette_size or len(d) != 2 * palette_size:
            raise ValueError("hIST must match the palette")
        return {"counts": list(struct.unpack(f">{palette_size}H", d))}
    if kind == "sBIT":
        n = 3 if ct == 3 else raster.CHANNELS[ct]
        if len(d) != n or not all(1 <= v <= (8 if ct == 3 else depth) for v in d):
            raise ValueError("illegal sBIT")
        return {"bits": list(d)}
    return None


def write_ancillary(kind: str, f: dict[str, Any], color_type: int = 2) -> bytes:
    """The data of a chunk of the fields that ``parse_ancillary`` gives; texts are compressed where that is smaller.

    A background is written as the colour type has it: an index, a grey value or three numbers.
    """
    if kind in FIELDS:
        form, names = FIELDS[kind]
        return struct.pack(form, *(f[n] for n in names))
    if kind == "bKGD":
        return bytes([f["r"]]) if color_type == 3 else struct.pack(">H", f["r"]) if color_type in (0, 4) else struct.pack(">3H", f["r"], f["g"], f["b"])
    if kind == "tEXt":
        return _word(f["keyword"]) + b"\0" + f["text"].encode("latin-1")
    if kind == "zTXt":
        return _word(f["keyword"]) + b"\0\0" + zlib.compress(f["text"].encode("latin-1"))
    if kind == "iCCP":
        return _word(f["name"]) + b"\0\0" + zlib.compress(f["profile"])
    if kind == "iTXt":
        raw = f["text"].encode()
        packed = zlib.compress(raw)
        small = len(packed) < len(raw)
        return _word(f["keyword"]) + b"\0" + bytes([small, 0]) + f["language"].encode("latin-1") + b"\0" + f["translated"].encode() + b"\0" + (packed if small else raw)
    if kind == "sPLT":
        return _word(f["name"]) + bytes([0, f["depth"]]) + b"".join(struct.pack(">4BH" if f["depth"] == 8 else ">5H", *e) for e in f["entries"])
    if kind == "hIST":
        return struct.pack(f">{len(f['counts'])}H", *f["counts"])
    if kind == "sBIT":
        return bytes(f["bits"])
    raise ValueError(f"no layout for {kind}")


def field_texts(fields: dict[str, Any]) -> list[tuple[str, str]]:
    """(field, value) as text: numbers of a list by commas, lists of a list by semicolons, bytes as hex."""

    def told(v: Any) -> str:
        if isinstance(v, bytes):
            return v.hex()
        if isinstance(v, list):
            return ";".join(map(told, v)) if v and isinstance(v[0], list) else ",".join(map(str, v))
        return str(v)

    return [(k, told(v)) for k, v in fields.items()]


def fields_of_texts(kind: str, texts: dict[str, str]) -> dict[str, Any]:
    """The fields of a chunk from their texts."""
    if kind in FIELDS or kind == "bKGD":
        return {k: int(v) for k, v in texts.items()}
    if kind in ("hIST", "sBIT"):
        return {k: [int(x) for x in v.split(",")] for k, v in texts.items()}
    if kind == "sPLT":
        entries = [[int(x) for x in e.split(",")] for e in texts["entries"].split(";") if e]
        return {"name": texts["name"], "depth": int(texts["depth"]), "entries": entries}
    return texts | {"profile": bytes.fromhex(texts["profile"])} if kind == "iCCP" else texts


def with_metadata(data: bytes, entries: list[tuple[str, str, str]]) -> bytes:
    """A PNG with chunks before its pixels, from rows (type, field, value); a type opens a new chunk when a field comes again."""
    chunks = parse_chunks(data)
    made: list[tuple[str, dict[str, str]]] = []
    for kind, field, value in entries:
        if not made or made[-1][0] != kind or field in made[-1][1]:
            made.append((kind, {}))
        made[-1][1][field] = value
    ct = parse_header(chunks[0]["data"])["color_type"]
    try:
        raw = [chunk(kind, write_ancillary(kind, fields_of_texts(kind, texts), ct)) for kind, texts in made]
    except struct.error as e:
        raise ValueError(f"a number doesn't fit its field: {e}") from None
    first = next(i for i, c in enumerate(chunks) if c["type"] == "IDAT")
    parts = [chunk(c["type"], c["data"]) for c in chunks]
    return b"".join([SIGNATURE, *parts[:first], *raw, *parts[first:]])


def metadata(data: bytes) -> list[tuple[int, str, str, str]]:
    """(seq, type, field, value) of all ancillary and animation chunks that have fields."""
    chunks = parse_chunks(data)
    h, mode = parse_header(chunks[0]["data"]), image_mode(chunks)
    size = 0 if mode.palette is None else len(mode.palette)
    found = ((c, parse_ancillary(c["type"], c["data"], h, size)) for c in chunks)
    return [(c["seq"], c["type"], k, v) for c, fields in found if fields is not None for k, v in field_texts(fields)]


def image_mode(chunks: list[dict[str, Any]]) -> Mode:
    """Colour mode: header, palette with its alphas, colour key."""
    h = parse_header(chunks[0]["data"])
    by = {}
    for c in chunks:
        by.setdefault(c["type"], c["data"])
    palette = key = None
    if "PLTE" in by:
        raw = np.frombuffer(by["PLTE"][: len(by["PLTE"]) // 3 * 3], np.uint8).reshape(-1, 3)
        if not 0 < len(raw) <= 256:
            raise ValueError("a palette has 1 to 256 colours")
        palette = np.column_stack([raw, np.full(len(raw), 255)]).astype(np.int64)
    if "tRNS" in by:
        t, ct = by["tRNS"], h["color_type"]
        if ct == 3:
            if len(t) > len(palette):
                raise ValueError("more alphas than colours")
            palette[: len(t), 3] = np.frombuffer(t, np.uint8)
        elif ct in (0, 2):
            size = 2 if ct == 0 else 6
            if len(t) != size:
                raise ValueError("illegal tRNS")
            key = struct.unpack(f">{size // 2}H", t)
        else:
            raise ValueError("tRNS beside an alpha channel")
    return Mode(h["color_type"], h["bit_depth"], palette, key)


def info(data: bytes, texts: bool = True) -> dict[str, Any]:
    """Header, mode and the fields of ancillary chunks by type; texts as lists in file order."""
    return chunk_info(parse_chunks(data), texts)


def chunk_info(chunks: list[dict[str, Any]], texts: bool = True) -> dict[str, Any]:
    """What ``info`` gives, of chunks that are parsed already."""
    h, mode = parse_header(chunks[0]["data"]), image_mode(chunks)
    out: dict[str, Any] = {**h, "palette": None if mode.palette is None else mode.palette.tolist(), "key": mode.key, "tEXt": [], "zTXt": [], "iTXt": [], "sPLT": []}
    for c in chunks:
        if c["type"] in ("tEXt", "zTXt", "iTXt") and not texts:
            continue
        found = parse_ancillary(c["type"], c["data"], h, 0 if mode.palette is None else len(mode.palette))
        if found is not None:
            if c["type"] in ("tEXt", "zTXt", "iTXt", "sPLT"):
                out[c["type"]].append(found)
            elif c["type"] not in ("fcTL", "acTL"):
                out.setdefault(c["type"], found)
    return out


def chunk_names(data: bytes) -> str:
    return shown_names(parse_chunks(data))


def shown_names(chunks: list[dict[str, Any]]) -> str:
    """The types of parsed chunks, without those of frames."""
    return " ".join(c["type"] for c in chunks if c["type"] not in ("fcTL", "fdAT"))


def decode(data: bytes, color_type: int | None = None, depth: int | None = None, ignore_crc: bool = False, ignore_adler: bool = False) -> dict[str, Any]:
    """width, height, data, color_type, bit_depth, frames; without a target the file's own mode. Frames aren't composed."""
    chunks = parse_chunks(data, ignore_crc)
    h, mode = parse_header(chunks[0]["data"]), image_mode(chunks)
    bpp, interlaced = raster.bits_per_pixel(mode.color_type, mode.depth), bool(h["interlace"])
    target = mode if color_type is None else Mode(color_type, depth or 8)
    raster.check_mode(target.color_type, target.depth)

    def pixels(parts: list[bytes], w: int, hgt: int) -> bytes:
        size = raster.scan_size(w, hgt, bpp, interlaced)
        scan = inflate(b"".join(parts), ignore_adler, size + 1)
        samples = raster.from_scan(scan, w, hgt, mode.color_type, mode.depth, interlaced)
        return raster.pack_flat(raster.convert(samples, mode, target), target.depth)

    out: dict[str, Any] = {"width": h["width"], "height": h["height"], "color_type": target.color_type, "bit_depth": target.depth, "frames": []}
    out["data"] = pixels([c["data"] for c in chunks if c["type"] == "IDAT"], h["width"], h["height"])
    idat = next(c["seq"] for c in chunks if c["type"] == "IDAT")
    control = next((c for c in chunks if c["type"] == "acTL"), None)
    if control is None or control["seq"] > idat:
        return out
    wanted = parse_ancillary("acTL", control["data"], h, 0)
    groups: list[tuple[dict[str, Any], list[bytes], bool]] = []
    for c in chunks:
        if c["type"] == "fcTL":
            groups.append((parse_ancillary("fcTL", c["data"], h, 0), [], c["seq"] < idat))
        elif c["type"] == "fdAT":
            if not groups:
                raise ValueError("fdAT without fcTL")
            groups[-1][1].append(c["data"][4:])
    if len(groups) != wanted["frames"]:
        raise ValueError(f"{len(groups)} frames, {wanted['frames']} announced")
    for k, (f, parts, default) in enumerate(groups):
        if default:
            if (f["x"], f["y"], f["width"], f["height"]) != (0, 0, h["width"], h["height"]):
                raise ValueError("the default image must fill the canvas")
            data_ = out["data"]
        else:
            data_ = pixels(parts, f["width"], f["height"])
        out["frames"].append({"frame_no": k, **f, "data": data_})
    return out | {"plays": wanted["plays"]}


def chunk(kind: str, data: bytes) -> bytes:
    name = kind.encode("latin-1")
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def deflate(data: bytes, level: int = 6) -> bytes:
    packed = zlib.compress(data, level)
    stored = zlib.compress(data, 0)
    return packed if len(packed) <= len(stored) else stored


def _word(keyword: str) -> bytes:
    raw = keyword.encode("latin-1")
    if not 1 <= len(raw) <= 79 or b"\0" in raw:
        raise ValueError("a keyword needs 1 to 79 bytes")
    return raw


def encode(
    data: bytes, width: int, height: int, color_type: int = 6, depth: int = 8, *, palette: Any = None, key: tuple[int, ...] | None = None, out_mode: tuple[int, int] | None = None,
    auto: bool = True, interlace: bool = False, strategy: str = "minsum", kinds: list[int] | None = None, palette_zero: bool = True, background: tuple[int, ...] | None = None,
    time: tuple[int, ...] | None = None, phys: tuple[int, int, int] | None = None, texts: Any = (), itexts: Any = (), compress_text: bool = True, unknown: Any = (),
    frames: Any = (), plays: int = 0, default_control: dict[str, int] | None = None, level: int = 6, add_id: bool = False,
) -> bytes:
    """An image, or with ``frames`` (dicts of x, y, width, height, delay_num, delay_den, dispose, blend, data) an animation.

    ``unknown`` holds (type, data, slot): slot 0 after IHDR, 1 before IDAT, 2 before IEND. The background is in input values.
    ``add_id`` adds a plain text that names this library.
    """
    raster.check_mode(color_type, depth)
    if not (1 <= width <= LARGEST and 1 <= height <= LARGEST):
        raise ValueError("illegal size")
    source = Mode(color_type, depth, None if palette is None else np.asarray(palette, np.int64).reshape(-1, 4), key)
    images = [raster.unpack_flat(data, width, height, color_type, depth)]
    for f in frames:
        if f["width"] <= 0 or f["height"] <= 0 or min(f["x"], f["y"]) < 0 or f["x"] + f["width"] > width or f["y"] + f["height"] > height:
            raise ValueError("a frame lies outside the canvas")
        images.append(raster.unpack_flat(f["data"], f["width"], f["height"], color_type, depth))
    if auto:
        every = np.concatenate([i.reshape(1, -1, i.shape[2]) for i in images], axis=1)
        target = raster.auto_mode(raster.profile(every, source), width * height, source)
    else:
        target = Mode(*(out_mode or (color_type, depth)))
        if target.color_type == 3:
            target = target._replace(palette=source.palette)
        elif (target.color_type, target.depth) == (color_type, depth):
            target = source
    raster.check_mode(target.color_type, target.depth)
    if target.color_type == 3 and (target.palette is None or not 0 < len(target.palette) <= 256):
        raise ValueError("a palette has 1 to 256 colours")
    zero = palette_zero and (target.color_type == 3 or target.depth < 8) and strategy != "predefined"
    scans = [deflate(raster.to_scan(raster.convert(i, source, target), target, interlace, "zero" if zero else strategy, kinds), level) for i in images]
    out = [SIGNATURE, chunk("IHDR", struct.pack(">IIBBBBB", width, height, target.depth, target.color_type, 0, 0, int(interlace)))]
    extra = {s: [chunk(t, d) for t, d, slot in unknown if slot == s] for s in range(3)}
    out += extra[0]
    if target.palette is not None and len(target.palette):
        out.append(chunk("PLTE", target.palette[:, :3].astype(np.uint8).tobytes()))
        alphas = target.palette[:, 3].astype(np.uint8).tobytes().rstrip(b"\xff") if target.color_type == 3 else b""
        out += [chunk("tRNS", alphas)] if alphas else []
    if target.key is not None and target.color_type in (0, 2):
        out.append(chunk("tRNS", struct.pack(f">{len(target.key)}H", *target.key)))
    if background is not None:
        out.append(chunk("bKGD", write_ancillary("bKGD", dict(zip("rgb", (*background, 0, 0))), target.color_type)))
    out += [chunk("pHYs", struct.pack(">IIB", *phys))] if phys else []
    out += extra[1]
    number = 0

    def control(f: dict[str, int]) -> bytes:
        nonlocal number
        number += 1
        return chunk("fcTL", struct.pack(">5IHHBB", number - 1, f.get("width", width), f.get("height", height), f.get("x", 0), f.get("y", 0), f.get("delay_num", 0), f.get("delay_den", 0), f.get("dispose", 0), f.get("blend", 0)))

    if frames or default_control is not None:
        out.append(chunk("acTL", struct.pack(">II", len(frames) + (default_control is not None), plays)))
        out += [control(default_control | {"x": 0, "y": 0, "width": width, "height": height})] if default_control is not None else []
    out.append(chunk("IDAT", scans[0]))
    for f, scan in zip(frames, scans[1:], strict=True):
        out += [control(f), chunk("fdAT", struct.pack(">I", number) + scan)]
        number += 1
    out += [chunk("tIME", struct.pack(">H5B", *time))] if time else []
    for word, text in texts:
        raw = text.encode("latin-1")
        out.append(chunk("zTXt", _word(word) + b"\0\0" + zlib.compress(raw)) if compress_text else chunk("tEXt", _word(word) + b"\0" + raw))
    out += [chunk("tEXt", write_ancillary("tEXt", TAG))] if add_id else []
    for word, language, translated, text in itexts:
        fields = {"keyword": word, "language": language, "translated": translated, "text": text}
        out.append(chunk("iTXt", write_ancillary("iTXt", fields) if compress_text else _word(word) + b"\0\0\0" + language.encode("latin-1") + b"\0" + translated.encode() + b"\0" + text.encode()))
    return b"".join([*out, *extra[2], chunk("IEND", b"")])


def filter_types(data: bytes) -> list[int]:
    """Filter of each row of the default image."""
    chunks = parse_chunks(data)
    h = parse_header(chunks[0]["data"])
    bpp = raster.bits_per_pixel(h["color_type"], h["bit_depth"])
    scan = inflate(b"".join(c["data"] for c in chunks if c["type"] == "IDAT"))
    return raster.filter_kinds(scan, h["width"], h["height"], bpp, bool(h["interlace"]))
