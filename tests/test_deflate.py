import random
import zlib

import pytest

from tessera.functions import deflate, png


def inputs():
    rng = random.Random(6)
    yield from (b"", b"a", b"aaa", bytes(1000), bytes(range(256)), b"abcabcabcd" * 300)
    yield bytes(rng.randrange(256) for _ in range(3000))
    yield bytes(rng.choice(b"ab") for _ in range(5000))
    yield " ".join(rng.choice(("the", "of", "and", "thing", "tion")) for _ in range(3000)).encode()


@pytest.mark.parametrize("mode", ["stored", "fixed", "dynamic"])
@pytest.mark.parametrize("data", list(inputs()), ids=len)
def test_zlib_reads_ours_and_we_read_zlibs(mode, data):
    made = deflate.deflate(data, mode, block=2000)
    assert zlib.decompress(made) == data == deflate.inflate(made)
    for level in (0, 1, 9):
        assert deflate.inflate(zlib.compress(data, level)) == data
    fixed = zlib.compressobj(9, zlib.DEFLATED, -15, 9, zlib.Z_FIXED)
    assert deflate.inflate(fixed.compress(data) + fixed.flush(), raw=True) == data


def test_tokens_expand_and_stay_in_the_window():
    for data in inputs():
        for lazy in (False, True):
            made = list(deflate.tokens(data, 300, lazy))
            assert deflate.expand(made) == data and all(isinstance(t, int) or (3 <= t[0] <= 258 and t[1] <= 300) for t in made)
    assert len(deflate.deflate(b"abcabcabcd" * 300)) < 60


def test_matches_reach_back_over_blocks():
    rng = random.Random(8)
    data = bytes(rng.randrange(256) for _ in range(1000)) * 2
    made = deflate.deflate(data, block=1000)
    back = list(deflate.read_tokens(made[2:-4]))
    assert zlib.decompress(made) == data and back == list(deflate.tokens(data)) and any(t[1] == 1000 for t in back if not isinstance(t, int))
    long = data * 70
    made = deflate.deflate(long)
    assert zlib.decompress(made) == long and list(deflate.read_tokens(made[2:-4])) == list(deflate.tokens(long))


def test_damage_is_a_value_error():
    rng = random.Random(7)
    good = deflate.deflate(b"some text some more text " * 20)
    for _ in range(500):
        bad = bytearray(good)
        bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        with pytest.raises(ValueError):
            deflate.inflate(bytes(bad))
        with pytest.raises(ValueError):
            deflate.inflate(good[: rng.randrange(len(good))])
    with pytest.raises(ValueError):
        deflate.canonical([1, 1, 1])


def test_ancillary_chunks_round_trip():
    header = {"color_type": 2, "bit_depth": 8, "width": 9, "height": 9}
    fields = {
        "gAMA": {"gamma": 45455}, "sRGB": {"intent": 1}, "cHRM": dict(zip(("white_x", "white_y", "red_x", "red_y", "green_x", "green_y", "blue_x", "blue_y"), range(8))),
        "sPLT": {"name": "p", "depth": 16, "entries": [[1, 2, 3, 4, 500]]}, "hIST": {"counts": [1, 2, 65535]}, "iCCP": {"name": "n", "profile": b"x" * 40}, "sBIT": {"bits": [5, 6, 5]},
        "tIME": {"year": 2012, "month": 2, "day": 30, "hour": 0, "minute": 0, "second": 60}, "pHYs": {"x": 1, "y": 2, "unit": 1}, "acTL": {"frames": 2, "plays": 0},
        "fcTL": {"sequence": 0, "width": 1, "height": 2, "x": 3, "y": 4, "delay_num": 5, "delay_den": 6, "dispose": 1, "blend": 0}, "tEXt": {"keyword": "k", "text": "t"},
        "zTXt": {"keyword": "k", "text": "t" * 50}, "iTXt": {"keyword": "k", "language": "en", "translated": "é", "text": "日"}, "bKGD": {"r": 1, "g": 2, "b": 3},
    }
    for kind, f in fields.items():
        assert png.parse_ancillary(kind, png.write_ancillary(kind, f), header, 3) == f, kind
