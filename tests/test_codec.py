import random
import struct
import zlib

import numpy as np
import pytest

from tessera.functions import png, raster
from tessera.functions.raster import Mode

MODES = [(t, d) for t, ds in raster.DEPTHS.items() for d in ds]


def pixels(w, h, t, d, rng):
    ch = raster.CHANNELS[t]
    return raster.pack_flat(np.array([[[rng.randrange(1 << d) for _ in range(ch)] for _ in range(w)] for _ in range(h)], np.uint16), d)


@pytest.mark.parametrize("t,d", MODES)
@pytest.mark.parametrize("interlace", [False, True])
def test_every_mode_and_small_size_round_trips(t, d, interlace):
    rng = random.Random(t * 100 + d)
    palette = [[rng.randrange(256) for _ in range(4)] for _ in range(1 << min(d, 8))] if t == 3 else None
    for w, h in [(1, 1), (2, 3), (5, 4), (7, 7), (8, 9), (12, 11)]:
        data = pixels(w, h, t, d, rng)
        for strategy in ("zero", "minsum", "entropy", "brute_force"):
            image = png.encode(data, w, h, t, d, palette=palette, auto=False, interlace=interlace, strategy=strategy, palette_zero=False)
            got = png.decode(image)
            assert (got["width"], got["height"], got["color_type"], got["bit_depth"], got["data"]) == (w, h, t, d, data)
            assert len(png.filter_types(image)) == h


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("step", [1, 2, 3, 4, 8])
def test_filters_invert(kind, step):
    rng = np.random.default_rng(kind * 10 + step)
    for above in (np.zeros(128, np.uint8), rng.integers(0, 256, 128).astype(np.uint8)):
        line = rng.integers(0, 256, 128).astype(np.uint8)
        assert (raster.unfilter_line(raster.filter_line(line, above, step, kind), above, step, kind) == line).all()


def test_predefined_kinds_and_wrong_count():
    data = bytes(range(128))
    kinds = [y % 5 for y in range(8)]
    image = png.encode(data, 4, 8, 6, 8, auto=False, strategy="predefined", kinds=kinds)
    assert png.filter_types(image) == kinds and png.decode(image)["data"] == data
    with pytest.raises(ValueError, match="8 filter kinds"):
        png.encode(data, 4, 8, 6, 8, auto=False, strategy="predefined", kinds=kinds[:-1])


def test_black_and_white_survive_every_pair_of_modes():
    rng = random.Random(2)
    rgba = np.array([[[v, v, v, 255] for v in rng.choices((0, 255), k=3)] for _ in range(3)], np.int64)
    palette = np.array([[0, 0, 0, 255], [255, 255, 255, 255]] + [[7, 7, 7, 255]] * 254)
    modes = [Mode(t, d, palette if t == 3 else None) for t, d in MODES]
    base = Mode(6, 8)
    for a in modes:
        for b in modes:
            x = raster.convert(raster.convert(rgba.astype(np.uint16), base, a), a, b)
            assert (raster.convert(x, b, base) == rgba).all(), (a, b)


@pytest.mark.parametrize(
    "value,t,d,to,want",
    [([2], 0, 2, (6, 8), [170, 170, 170, 255]), ([9], 0, 4, (0, 8), [153]), ([0x1234], 0, 16, (0, 8), [0x12]), ([0x12], 0, 8, (0, 16), [0x1212]), ([255, 0, 0], 2, 8, (0, 1), [1])],
)
def test_single_pixels(value, t, d, to, want):
    assert raster.convert(np.array([[value]], np.uint16), Mode(t, d), Mode(*to)).ravel().tolist() == want


def test_key_and_index_beyond_the_palette():
    s = np.array([[[3], [2]]], np.uint16)
    assert raster.to_rgba(s, Mode(0, 2, None, (2,)))[0].tolist() == [[255] * 4, [170, 170, 170, 0]]
    short = Mode(3, 2, np.array([[1, 2, 3, 4]]))
    assert raster.to_rgba(s, short)[0, 0].tolist() == [0, 0, 0, 0] and raster.to_rgba(s, short, direct=False)[0, 0].tolist() == [0, 0, 0, 255]
    with pytest.raises(ValueError, match="lacks"):
        raster.from_rgba(np.array([[[9, 9, 9, 9]]]), short)


def auto(colors, n=300, depth=8):
    flat = (colors * (n // len(colors) + 1))[:n]
    return raster.auto_mode(raster.profile(np.array([flat], np.uint16), Mode(6, depth)), n, Mode(6, depth))


def test_automatic_modes():
    grey = lambda *v: [[x, x, x, 255] for x in v]
    assert auto(grey(0, 255))[:2] == (0, 1) and auto(grey(0, 85, 170, 255))[:2] == (0, 2) and auto(grey(*range(0, 256, 17)))[:2] == (0, 4)
    assert auto(grey(*range(256)))[:2] == (0, 8)
    for n, bits in ((1, 1), (2, 1), (4, 2), (7, 4), (17, 8)):
        m = auto([[i, 200, 3, 255] for i in range(n)])
        assert m[:2] == (3, bits) and m.palette[:, 0].tolist() == list(range(n))
    many = [[i % 256, i // 256, 9, 255] for i in range(257)]
    assert auto(many)[:2] == (2, 8)
    keyed = auto([*many, [1, 2, 3, 0]])
    assert keyed[:2] == (2, 8) and keyed.key == (1, 2, 3)
    assert auto([*many, [1, 2, 3, 0], [1, 2, 3, 255]])[:2] == (6, 8) == auto([[1, 2, 3, 255], *many, [1, 2, 3, 0]])[:2]
    assert auto([[258 + i, 4, 5, 65535] for i in range(4)], depth=16)[:2] == (2, 16)
    assert auto([[257 * i, 257, 514, 65535] for i in range(2)], depth=16)[:2] == (3, 1)


def test_metadata_and_chunk_order():
    data = bytes(i % 2 for i in range(16 * 17))
    palette = [[i, i, i, 255 if i else 3] for i in range(4)]
    image = png.encode(
        data, 16, 17, 3, 8, palette=palette, auto=False, background=(127,), time=(2012, 1, 2, 3, 4, 60), phys=(1, 2, 1), texts=[("a" * 79, "b\xe9"), ("c", "d" * 99)], itexts=[("k", "en", "tü", "日" * 90), ("k", "", "", "x")],
        unknown=[("uNKa", b"1", 0), ("uNKb", b"2", 1), ("uNKc", b"3", 2)],
    )
    assert png.chunk_names(image) == "IHDR uNKa PLTE tRNS bKGD pHYs uNKb IDAT tIME zTXt zTXt iTXt iTXt uNKc IEND"
    got = png.info(image)
    assert got["bKGD"]["r"] == 127 and got["tIME"]["second"] == 60 and got["pHYs"] == {"x": 1, "y": 2, "unit": 1} and got["palette"][0][3] == 3
    assert [t["keyword"] for t in got["zTXt"]] == ["a" * 79, "c"] and got["zTXt"][0]["text"] == "b\xe9"
    assert got["iTXt"][0] == {"keyword": "k", "language": "en", "translated": "tü", "text": "日" * 90}
    assert set(png.filter_types(image)) == {0}


def test_animation():
    rng = random.Random(4)
    frames = [{"x": 1, "y": 2, "width": 3, "height": 2, "delay_num": 1, "delay_den": 9, "dispose": 2, "blend": 1, "data": pixels(3, 2, 6, 8, rng)} for _ in range(3)]
    data = pixels(6, 5, 6, 8, rng)
    image = png.encode(data, 6, 5, frames=frames, default_control={"delay_num": 5})
    got = png.decode(image, 6, 8)
    assert got["data"] == data == got["frames"][0]["data"] and [f["data"] for f in got["frames"][1:]] == [f["data"] for f in frames]
    numbers = [struct.unpack(">I", c["data"][:4])[0] for c in png.parse_chunks(image) if c["type"] in ("fcTL", "fdAT")]
    assert numbers == list(range(len(numbers)))
    with pytest.raises(ValueError, match="outside"):
        png.encode(data, 6, 5, frames=[frames[0] | {"y": 4}])
    assert len(png.decode(png.encode(data, 6, 5, frames=frames))["frames"]) == 3


def test_damage_is_an_error_and_nothing_else():
    image = png.encode(bytes(range(64)), 4, 4)
    rng = random.Random(5)
    for _ in range(400):
        bad = bytearray(image)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        for raw in (bytes(bad), image[: rng.randrange(len(image))]):
            for ignore in (False, True):
                try:
                    png.decode(raw, 6, 8, ignore, ignore)
                except ValueError:
                    pass
    crc = bytearray(image)
    crc[-20] ^= 1
    with pytest.raises(ValueError):
        png.decode(bytes(crc))
    with pytest.raises(ValueError, match="PLTE"):
        png.parse_chunks(png.SIGNATURE + png.chunk("IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 3, 0, 0, 0)) + png.chunk("IDAT", zlib.compress(b"\0\0")))


def test_own_tag_comes_after_texts_and_before_international_ones():
    made = png.encode(b"\1\2\3", 1, 1, 2, 8, texts=[("Author", "x")], itexts=[("Title", "en", "T", "y")], compress_text=False, add_id=True)
    kinds = [c["type"] for c in png.parse_chunks(made)]
    assert kinds[-4:] == ["tEXt", "tEXt", "iTXt", "IEND"] and png.info(made)["tEXt"][1] == png.TAG
    assert png.TAG not in png.info(png.encode(b"\1\2\3", 1, 1, 2, 8))["tEXt"]


@pytest.mark.parametrize("color_type,size", [(0, 2), (2, 6), (3, 1), (4, 2), (6, 6)])
def test_background_has_the_size_of_its_colour_type(color_type, size):
    data = png.write_ancillary("bKGD", {"r": 3, "g": 4, "b": 5}, color_type)
    header = {"color_type": color_type, "bit_depth": 8}
    assert len(data) == size and png.parse_ancillary("bKGD", data, header, 4) == ({"r": 3, "g": 4, "b": 5} if size == 6 else dict.fromkeys("rgb", 3))


def test_long_texts_are_read_whole():
    text = "x" * (70 << 20)
    made = png.encode(b"\1\2\3", 1, 1, 2, 8, texts=[("Comment", text)])
    assert png.info(made)["zTXt"][0]["text"] == text


def test_metadata_texts_round_trip():
    made = png.encode(b"\1\2\3", 1, 1, 2, 8)
    entries = [("sPLT", "name", "p"), ("sPLT", "depth", "8"), ("sPLT", "entries", "1,2,3,4,5;6,7,8,9,10"), ("tEXt", "keyword", "a"), ("tEXt", "text", ""), ("tEXt", "keyword", "b"), ("tEXt", "text", "c"), ("iCCP", "name", "n"), ("iCCP", "profile", "00ff")]
    assert [m[1:] for m in png.metadata(png.with_metadata(made, entries))] == entries
    for bad in ([("tEXt", "keyword", "")], [("gAMA", "gamma", "x")], [("nope", "a", "b")]):
        with pytest.raises((ValueError, KeyError)):
            png.with_metadata(made, bad)


def test_numbers_beyond_their_field_are_an_error():
    indexed = png.encode(bytes(4), 2, 2, 3, 8, palette=[(0, 0, 0, 255)] * 2, auto=False, out_mode=(3, 8))
    for bad in ([("hIST", "counts", "0,65536")], [("sPLT", "name", "p"), ("sPLT", "depth", "16"), ("sPLT", "entries", "1,2,3,4,65536")], [("gAMA", "gamma", "4294967296")]):
        with pytest.raises(ValueError, match="fit"):
            png.with_metadata(indexed, bad)


@pytest.mark.parametrize("strategy", ["minsum", "entropy", "brute_force"])
def test_blocks_of_rows_are_filtered_as_rows_are(strategy, monkeypatch):
    rows = np.random.default_rng(7).integers(0, 256, (23, 12)).astype(np.uint8)
    whole = raster.filter_rows(rows, 3, strategy)
    monkeypatch.setattr(raster, "BLOCK", 60)
    assert (raster.filter_rows(rows, 3, strategy) == whole).all() and (raster.unfilter_rows(whole.ravel(), 23, 12, 3) == rows).all()
