"""Queries of the raster and stream operators over the driver's tables, and their SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import deflate
from tessera.functions.raster import PASSES
from tessera.operators import colors, containers, filters, layout, streams
from tessera.plans import codec, rasters
from tessera.sources import images

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ["variant", "image"]

LINES = """
rows_ AS (SELECT CAST(label AS BIGINT) + 1000 * (vec_id // 512) AS image, row_number() OVER (PARTITION BY label, vec_id // 512 ORDER BY vec_id) - 1 AS y, embedding FROM embeddings),
s AS (SELECT image, y, CAST(u.i AS BIGINT) AS x,
             CAST(least(255, greatest(0, floor((CAST(embedding[u.i + 1] AS DOUBLE) + 1) * 127.5))) AS BIGINT) AS v
      FROM rows_, range(64) u(i))"""
GUESS = {
    "none": "0", "sub": "a", "up": "b", "average": "(a + b) // 2",
    "paeth": "CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END",
}


def _neighbours(step: int) -> str:
    return f"""{LINES},
n AS (SELECT *, coalesce(lag(v, {step}) OVER (PARTITION BY image, y ORDER BY x), 0) AS a, coalesce(lag(v) OVER (PARTITION BY image, x ORDER BY y), 0) AS b FROM s),
m AS (SELECT *, coalesce(lag(b, {step}) OVER (PARTITION BY image, y ORDER BY x), 0) AS c FROM n)"""


def _tried(step: int) -> str:
    parts = " UNION ALL ".join(f"SELECT image, y, x, {i} AS kind, ((v - ({g})) + 512) % 256 AS f FROM m" for i, g in enumerate(GUESS.values()))
    return f"{_neighbours(step)},\nt AS ({parts})"


_DIGEST = "CAST(sum(f) AS BIGINT) AS total, CAST(sum(f * (x + 1)) AS BIGINT) AS weighted"


def _filter_sql(kind: int, step: int) -> str:
    return f"WITH {_tried(step)} SELECT image, y, {_DIGEST} FROM t WHERE kind = {kind} GROUP BY image, y"


def _choice_sql(cost: str, step: int) -> str:
    return f"""WITH {_tried(step)}, {cost},
best AS (SELECT image, y, min(CAST(kind AS BIGINT)) AS kind FROM (SELECT *, min(cost) OVER (PARTITION BY image, y) AS least FROM costs) WHERE cost = least GROUP BY image, y)
SELECT image, y, best.kind AS kind, {_DIGEST} FROM t JOIN best USING (image, y) WHERE t.kind = best.kind GROUP BY image, y, best.kind"""


MINSUM = "costs AS (SELECT image, y, kind, sum(CASE WHEN kind = 0 OR f < 128 THEN f ELSE 255 - f END) AS cost FROM t GROUP BY image, y, kind)"
ENTROPY = """h AS (SELECT image, y, kind, f, count(*) AS k FROM (SELECT image, y, kind, f FROM t UNION ALL SELECT DISTINCT image, y, kind, kind FROM t) GROUP BY image, y, kind, f),
costs AS (SELECT image, y, kind, round(sum(-(k / 65.0) * log2(k / 65.0)), 6) AS cost FROM h GROUP BY image, y, kind)"""


def _unfilter_sql(kind: str, step: int) -> str:
    which = "kind = y % 5" if kind == "mixed" else f"kind = {list(GUESS).index(kind)}"
    return f"""WITH {_tried(step)} SELECT image, y, 'filtered' AS side, {_DIGEST} FROM t WHERE {which} GROUP BY image, y
UNION ALL SELECT image, y, 'raw', CAST(sum(v) AS BIGINT), CAST(sum(v * (x + 1)) AS BIGINT) FROM s GROUP BY image, y"""


RAW = f"WITH {LINES} SELECT image, y, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (x + 1)) AS BIGINT) AS weighted FROM s GROUP BY image, y"

PIXELS = f"""{LINES},
q AS (SELECT image, y, x // 4 AS p, max(v) FILTER (x % 4 = 0) AS r, max(v) FILTER (x % 4 = 1) AS g, max(v) FILTER (x % 4 = 2) AS b, max(v) FILTER (x % 4 = 3) AS a FROM s GROUP BY image, y, x // 4),
px AS (
  SELECT 'rgba' AS variant, image, y * 16 + p AS idx, r, g, b, a FROM q
  UNION ALL SELECT 'grey', image, y * 64 + x, v, v, v, 255 FROM s
  UNION ALL SELECT 'levels', image, y * 64 + x, v // 64 * 85, v // 64 * 85, v // 64 * 85, 255 FROM s
  UNION ALL SELECT 'keyed', image, y * 64 + x, v // 64 * 85, v, 9, CASE WHEN v < 64 THEN 0 ELSE 255 END FROM s
  UNION ALL SELECT 'two', image, y * 64 + x, CASE WHEN v < 128 THEN 10 ELSE 20 END, 30, 40, CASE WHEN v < 128 THEN 128 ELSE 255 END FROM s)"""
PROFILE = f"""{PIXELS},
c AS (SELECT variant, image, r, g, b, a, min(idx) AS first, count(*) AS n FROM px GROUP BY ALL),
rgb AS (SELECT variant, image, r, g, b, bool_or(a = 0) AS clear, bool_or(a <> 0) AS seen, bool_or(a NOT IN (0, 255)) AS partial FROM c GROUP BY ALL),
w AS (SELECT variant, image, bool_or(r <> g OR g <> b) AS colored, bool_or(partial) OR count(*) FILTER (clear) > 1 OR bool_or(clear AND seen) AS alpha,
             max(CASE WHEN r % 255 = 0 THEN 1 WHEN r % 85 = 0 THEN 2 WHEN r % 17 = 0 THEN 4 ELSE 8 END) AS grey, min(CASE WHEN clear THEN r * 65536 + g * 256 + b END) AS k FROM rgb GROUP BY variant, image),
z AS (SELECT variant, image, least(count(*), 257) AS colors, CAST(sum(n) AS BIGINT) AS pixels FROM c GROUP BY variant, image),
prof AS (SELECT variant, image, colored, alpha, CASE WHEN NOT alpha THEN CAST(k AS BIGINT) END AS key, colors, CAST(CASE WHEN colored OR alpha THEN 8 ELSE grey END AS BIGINT) AS bits, pixels FROM w JOIN z USING (variant, image))"""
AUTO = f"""WITH {PROFILE},
e AS (SELECT *, alpha OR (key IS NOT NULL AND pixels <= 16) AS al, CASE WHEN key IS NOT NULL AND pixels <= 16 THEN greatest(bits, 8) ELSE bits END AS bi,
             CASE WHEN colors <= 2 THEN 1 WHEN colors <= 4 THEN 2 WHEN colors <= 16 THEN 4 ELSE 8 END AS pb FROM prof),
f AS (SELECT *, colors <= 256 AND colors * 2 < pixels AND NOT (NOT colored AND NOT al AND bi <= pb) AS pal FROM e)
SELECT variant, image, CAST(CASE WHEN pal THEN 3 WHEN al THEN CASE WHEN colored THEN 6 ELSE 4 END WHEN colored THEN 2 ELSE 0 END AS BIGINT) AS color_type,
       CAST(CASE WHEN pal THEN pb WHEN NOT al AND NOT colored THEN bi ELSE greatest(bi, 8) END AS BIGINT) AS bit_depth, key IS NOT NULL AND NOT al AND NOT pal AS keyed FROM f"""
PALETTE = f"{PIXELS}, pal AS (SELECT variant, image, row_number() OVER (PARTITION BY variant, image ORDER BY first) - 1 AS index, r, g, b, a FROM (SELECT variant, image, r, g, b, a, min(idx) AS first FROM px GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY variant, image ORDER BY first) <= 256)"


def _lines(kind: str, step: int) -> Query:
    return lambda spark, d: filters.digest(filters.filter_lines(rasters.scanlines(spark, d), step, kind))


def _strategy(name: str, step: int) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        lines = rasters.scanlines(spark, d)
        kinds = lines.select("image", "y", (F.col("y") % 5).cast("int").alias("kind")) if name == "predefined" else None
        return filters.digest(filters.choose(lines, step, name, kinds), "kind")

    return query


def _unfilter(kind: str, step: int) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        lines = rasters.scanlines(spark, d)
        if kind == "mixed":
            made = filters.choose(lines, step, "predefined", lines.select("image", "y", (F.col("y") % 5).cast("int").alias("kind")))
        else:
            made = filters.filter_lines(lines, step, kind)
        # both sides of the way, so that rows which were never filtered would show
        sides = {"filtered": made, "raw": filters.unfilter(made, step)}
        told = [filters.digest(side).withColumn("side", F.lit(name)) for name, side in sides.items()]
        return told[0].unionByName(told[1])

    return query


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return rasters.scanlines(spark, d).groupBy("image").agg(F.lit(64).alias("width"), F.count("*").alias("height"))


def _interlaced(spark: SparkSession, d: str) -> DataFrame:
    return layout.interlaced(rasters.samples(rasters.scanlines(spark, d)), 64)


def _adam7_order(spark: SparkSession, d: str) -> DataFrame:
    return _interlaced(spark, d).groupBy("image", "pass").agg(F.count("*").alias("n"), F.sum(F.col("v") * (F.col("place") + 1)).alias("weighted"))


def _adam7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return layout.deinterlaced(_interlaced(spark, d), 64).groupBy("image", "y").agg(F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("x") + 1)).alias("weighted"))


def _packed(spark: SparkSession, d: str, depth: int) -> DataFrame:
    low = rasters.scanlines(spark, d).withColumn("line", F.transform("line", lambda v: F.shiftright(v, 8 - depth)))
    return low.withColumn("line", layout.packed("line", depth))


def _bits_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for depth in (1, 2, 4):
        back = _packed(spark, d, depth).withColumn("line", layout.unpacked("line", depth, F.lit(64)))
        part = filters.digest(back.withColumn("depth", F.lit(depth)), "depth")
        out = part if out is None else out.unionByName(part)
    return out


def _convert_targets(spark: SparkSession, d: str) -> DataFrame:
    """Every mode without palette of the pixels of all variants, as sums by mode; one pass, no shuffle before the sums."""
    made = [F.struct(F.lit(t).alias("t"), F.lit(k).alias("d"), F.array(*colors.to_mode(t, k)).alias("s")) for t, k in colors.MODES]
    each = rasters.pixels(spark, d).select(*KEYS, F.explode(F.array(*made)).alias("m"))
    total = F.aggregate(F.transform("m.s", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return each.groupBy(*KEYS, F.col("m.t").cast("long").alias("color_type"), F.col("m.d").cast("long").alias("bit_depth")).agg(F.sum(total).alias("weighted"))


def _convert_sources(spark: SparkSession, d: str) -> DataFrame:
    """Pixels taken to each mode and back to RGBA8."""
    made = [F.struct(F.lit(t).alias("t"), F.lit(k).alias("d"), F.array(*[c.cast("long") for c in colors.from_mode(colors.to_mode(t, k), t, k)]).alias("s")) for t, k in colors.MODES]
    each = rasters.pixels(spark, d).select(*KEYS, F.explode(F.array(*made)).alias("m"))
    total = F.aggregate(F.transform("m.s", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return each.groupBy(*KEYS, F.col("m.t").cast("long").alias("color_type"), F.col("m.d").cast("long").alias("bit_depth")).agg(F.sum(total).alias("weighted"))


def _sample_sql(t: int, d: int, back: bool) -> str:
    names = {0: "r", 2: "rgb", 4: "ra", 6: "rgba"}[t]
    low = [f"({c} * 257)" if d == 16 else f"({c} >> {8 - d})" for c in names]
    if back:
        up = [f"({c} >> 8)" if d == 16 else f"({c} * 255 // {(1 << d) - 1})" for c in low]
        rgb = up[:3] if t in (2, 6) else [up[0]] * 3
        low = [*rgb, up[-1] if t in (4, 6) else "255"]
    return " + ".join(f"{c} * {i + 1}" for i, c in enumerate(low))


def _convert_sql(back: bool) -> str:
    parts = " UNION ALL ".join(
        f"SELECT variant, image, CAST({t} AS BIGINT) AS color_type, CAST({d} AS BIGINT) AS bit_depth, CAST(sum({_sample_sql(t, d, back)}) AS BIGINT) AS weighted FROM px GROUP BY variant, image" for t, d in colors.MODES
    )
    return f"WITH {PIXELS} {parts}"


def _convert_key(spark: SparkSession, d: str) -> DataFrame:
    """Grey at each depth with a key: the key is compared before it is scaled."""
    px = rasters.pixels(spark, d).where("variant = 'grey'")
    out = None
    for depth in (1, 2, 4, 8, 16):
        key = (1 << depth) // 2 if depth < 16 else 128 * 257
        a = colors.from_mode(colors.to_mode(0, depth), 0, depth, (key,))
        part = px.groupBy("image").agg(F.sum((a[3] == 0).cast("long")).alias("clear"), F.sum(a[0]).alias("total")).withColumn("bit_depth", F.lit(depth).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def _key_sql() -> str:
    parts = []
    for depth in (1, 2, 4, 8, 16):
        s, key = ("r * 257", 128 * 257) if depth == 16 else (f"r >> {8 - depth}", (1 << depth) // 2)
        up = f"({s}) >> 8" if depth == 16 else f"({s}) * 255 // {(1 << depth) - 1}"
        parts.append(f"SELECT image, CAST(count(*) FILTER (({s}) = {key}) AS BIGINT) AS clear, CAST(sum({up}) AS BIGINT) AS total, CAST({depth} AS BIGINT) AS bit_depth FROM px WHERE variant = 'grey' GROUP BY image")
    return f"WITH {PIXELS} " + " UNION ALL ".join(parts)


def _profile(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("key.r").cast("long") * 65536 + F.col("key.g") * 256 + F.col("key.b")
    return colors.profile(rasters.pixels(spark, d), KEYS).withColumn("key", key)


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    px = rasters.pixels(spark, d)
    return colors.encode_indices(px, colors.palette(px, KEYS), KEYS)


def _palette_encode(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d).groupBy(*KEYS).agg(F.count("index").alias("found"), F.coalesce(F.sum("index"), F.lit(0)).alias("total"))


def _palette_decode(direct: bool) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        px = rasters.pixels(spark, d)
        entries = colors.palette(px, KEYS)
        got = colors.look_up(colors.encode_indices(px, entries, KEYS).withColumn("index", F.coalesce("index", F.lit(999).cast("long"))), entries, KEYS, direct)
        return got.groupBy(*KEYS).agg(F.sum(F.col("r").cast("long") + F.col("g") * 2 + F.col("b") * 3).alias("rgb"), F.sum(F.col("a").cast("long")).alias("alpha"))

    return query


def _decode_sql(miss: int) -> str:
    return f"""WITH {PALETTE}, j AS (SELECT px.*, pal.index AS i FROM px LEFT JOIN pal USING (variant, image, r, g, b, a))
SELECT variant, image, CAST(sum(CASE WHEN i IS NULL THEN 0 ELSE r + g * 2 + b * 3 END) AS BIGINT) AS rgb, CAST(sum(CASE WHEN i IS NULL THEN {miss} ELSE a END) AS BIGINT) AS alpha FROM j GROUP BY variant, image"""


def _missing(spark: SparkSession, d: str) -> DataFrame:
    px = rasters.pixels(spark, d)
    return colors.missing_colors(px, colors.palette(px, KEYS, 16), KEYS).groupBy(*KEYS).agg(F.count("*").alias("colors"), F.sum("n").alias("pixels"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return rasters.read(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def _checksums(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", streams.crc32(F.col("data")).alias("crc32"))


def _adler(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", streams.adler32("data").alias("adler32"))


ADLER = """
WITH p AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
q AS (SELECT doc_id, octet_length(raw) AS n, unnest(range(1, octet_length(raw) + 1)) AS i, hex(raw) AS h FROM p),
b AS (SELECT doc_id, n, i, CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT) AS v FROM q)
SELECT d.doc_id, CAST(coalesce((n + sum((n - i + 1) * v)) % 65521 * 65536 + (1 + sum(v)) % 65521, 1) AS BIGINT) AS adler32
FROM documents d LEFT JOIN b USING (doc_id) GROUP BY d.doc_id, n"""


def _benchmark_bytes(spark: SparkSession, d: str) -> DataFrame:
    return rasters.read(spark, d, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("data"))


BYTES = """
h AS (SELECT item_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM benchmark),
i AS (SELECT item_id, h, unnest(range(1, n + 1)) AS i FROM h),
b AS (SELECT item_id, i - 1 AS pos, CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT) AS v FROM i)"""


def _previous(spark: SparkSession, d: str) -> DataFrame:
    found = streams.previous_occurrence(streams.grams(_benchmark_bytes(spark, d), "item_id", "data"), "item_id")
    return found.groupBy("item_id").agg(F.count("*").alias("positions"), F.count("distance").alias("hits"), F.coalesce(F.sum("distance"), F.lit(0)).alias("total"))


def _zero_runs(spark: SparkSession, d: str) -> DataFrame:
    low = rasters.samples(rasters.scanlines(spark, d)).withColumn("v", F.when(F.col("v") < 128, 0).otherwise(F.col("v")))
    return streams.zero_runs(low, ["image", "y"], "x", "v")


def _buckets(kind: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        if kind == "length":
            values = spark.range(3, 259).withColumnRenamed("id", "value")
            return streams.in_bucket(values, "value", streams.length_buckets(spark))
        values = spark.range(1, 32769).withColumnRenamed("id", "value")
        return streams.in_bucket(values, "value", streams.distance_buckets(spark))

    return query


LENGTH_BUCKETS = """
WITH v AS (SELECT range AS value FROM range(3, 259)),
e AS (SELECT value, value - 3 AS m, CASE WHEN value < 11 THEN 0 ELSE CAST(floor(log2(value - 3)) AS BIGINT) - 2 END AS x FROM v)
SELECT value, CASE WHEN value = 258 THEN 285 WHEN x = 0 THEN 257 + m ELSE 257 + 4 * x + (m >> x) END AS code,
       CASE WHEN value = 258 THEN 0 ELSE m % (1 << x) END AS rest FROM e"""
DISTANCE_BUCKETS = """
WITH v AS (SELECT range AS value FROM range(1, 32769)),
e AS (SELECT value, value - 1 AS m, CASE WHEN value < 5 THEN 0 ELSE CAST(floor(log2(value - 1)) AS BIGINT) - 1 END AS x FROM v)
SELECT value, CASE WHEN x = 0 THEN m ELSE 2 * x + (m >> x) END AS code, m % (1 << x) AS rest FROM e"""
FIXED_CODES = """
WITH l AS (SELECT range AS symbol, CASE WHEN range < 144 THEN 8 WHEN range < 256 THEN 9 WHEN range < 280 THEN 7 ELSE 8 END AS length FROM range(288))
SELECT symbol, CAST(length AS BIGINT) AS length, CAST(CASE WHEN symbol < 144 THEN 48 + symbol WHEN symbol < 256 THEN 400 + symbol - 144 WHEN symbol < 280 THEN symbol - 256 ELSE 192 + symbol - 280 END AS BIGINT) AS code FROM l"""


def _optimal_codes(spark: SparkSession, d: str) -> DataFrame:
    counts = {r["symbol"]: r["n"] for r in streams.byte_counts(_docs(spark, d), "data").collect()}  # 256 at most
    rows = [(s, n) for s, n in streams.code_lengths(counts).items()]
    return streams.canonical_codes(spark.createDataFrame(rows, "symbol long, length long"))


ROLES = ["system", "user", "assistant"]


def _validated(spark: SparkSession, d: str) -> DataFrame:
    return rasters.chunks(spark, d).select("image", "seq", containers.keyword(F.col("data")).alias("k")).select("image", "seq", "k.keyword", F.length("k.text").cast("long").alias("rest"), "k.valid")


def _frame_sequence(spark: SparkSession, d: str) -> DataFrame:
    events = rasters.read(spark, d, "events").select(F.col("user_id").alias("animation"), F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("number"))
    return containers.sequence_errors(events, "number")


def _frame_bounds(spark: SparkSession, d: str) -> DataFrame:
    items = rasters.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("q"), F.count("*").alias("n"), F.max("l_linenumber").cast("long").alias("m"))
    table = items.select(F.col("l_orderkey").alias("animation"), F.lit(0).alias("frame_no"), F.col("n").alias("x"), F.col("m").alias("y"), F.col("q").alias("width"), F.col("n").alias("height"))
    canvas = rasters.read(spark, d, "orders").select(F.col("o_orderkey").alias("animation"), F.length("o_orderpriority").cast("long").alias("height"), F.lit(100).cast("long").alias("width"))
    return containers.outside(table, canvas).select("animation", "x", "y", "width", "height")


def _as_images(spark: SparkSession, d: str) -> DataFrame:
    """Documents as grey images of 64 columns, blanks at the end."""
    docs = rasters.read(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    rows = F.greatest(F.ceil(F.length("raw") / 64), F.lit(1)).cast("int")
    return docs.select("doc_id", F.length("raw").alias("n"), rows.alias("rows"), F.rpad("raw", rows * 64, F.lit(b" ")).alias("pixels"))


def _png_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    made = _as_images(spark, d).withColumn("file", images.encode("pixels", F.lit(64), F.col("rows"), 0, 8, auto=False, strategy="zero", level=1))
    back = made.withColumn("image", images.decode("file.content", "RAW")).withColumn("chunks", images.chunk_list("file.content"))
    named = F.array_join(F.transform("chunks", lambda c: F.concat(c["type"], F.when(c["crc_ok"], "").otherwise("!"))), " ")
    return back.select("doc_id", named.alias("chunks"), F.col("image.height").cast("long").alias("height"), F.sha2(F.substring("image.data", F.lit(1), F.col("n")), 256).alias("sha256"))


def _png_profiled(spark: SparkSession, d: str) -> DataFrame:
    """The automatic choice inside the codec, read back from its headers: pixel variants as files."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "r", "g", "b", "a"))), lambda p: F.concat(*[F.lpad(F.hex(p[c]), 2, "0") for c in "rgba"]))
    files = rasters.pixels(spark, d).groupBy(*KEYS).agg(F.unhex(F.array_join(ordered, "")).alias("data"), F.count("*").alias("n"))
    width = F.when(F.col("variant") == "rgba", 16).otherwise(64)
    made = files.withColumn("file", images.encode("data", width, F.col("n") / width))
    back = made.withColumn("decoded", images.decode("file.content", "RGBA8")).withColumn("header", F.get(images.chunk_list("file.content"), F.lit(0))["data"])
    number = lambda i: F.conv(F.hex(F.substring("header", i, 1)), 16, 10).cast("long")
    return back.select(*KEYS, number(10).alias("color_type"), number(9).alias("bit_depth"), (F.col("decoded.data") == F.col("data")).alias("same"))


def _deflate_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Streams and back; their headers and checksums show that they are streams."""
    packed = _docs(spark, d).select("doc_id", streams.deflated("data").alias("packed")).withColumn("back", streams.inflated("packed"))
    number = lambda at, n: F.conv(F.hex(F.substring("packed", at, n)), 16, 10).cast("long")
    return packed.select("doc_id", number(1, 1).alias("header"), number(-4, 4).alias("adler32"), F.sha2("back", 256).alias("sha256"))


def _open_deflate(spark: SparkSession, d: str) -> DataFrame:
    """The open coder in each mode, read back by zlib; and its tokens, expanded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item, raw in zip(b["item_id"], b["data"], strict=True):
                made = list(deflate.tokens(raw))
                rows.append((item, "tokens", hashlib.sha256(deflate.expand(made)).hexdigest()))
                rows += [(item, m, hashlib.sha256(zlib.decompress(deflate.deflate(raw, m))).hexdigest()) for m in ("stored", "fixed", "dynamic")]
                for mode, level, strategy in (("inflate", 6, zlib.Z_DEFAULT_STRATEGY), ("inflate_stored", 0, zlib.Z_DEFAULT_STRATEGY), ("inflate_fixed", 6, zlib.Z_FIXED)):
                    z = zlib.compressobj(level, strategy=strategy)
                    rows.append((item, mode, hashlib.sha256(deflate.inflate(z.compress(raw) + z.flush())).hexdigest()))
            yield pd.DataFrame(rows, columns=["item_id", "mode", "sha256"])

    return _benchmark_bytes(spark, d).mapInPandas(run, "item_id long, mode string, sha256 string")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {f"filter_{k}": _lines(k, 1) for k in filters.KINDS}
    found |= {f"filter_{k}_rgba": _lines(k, 4) for k in filters.KINDS}
    found |= {f"strategy_{s}": _strategy(s, 1) for s in ("zero", "minsum", "entropy", "predefined", "brute_force")}
    found |= {"strategy_minsum_rgba": _strategy("minsum", 4)} | codec.queries()
    found |= {f"unfilter_{k}": _unfilter(k, 1) for k in (*filters.KINDS, "mixed")} | {"unfilter_mixed_rgba": _unfilter("mixed", 4)}
    return found | {
        "adam7_passes": lambda s, d: layout.pass_table(_sizes(s, d)),
        "adam7_order": _adam7_order,
        "adam7_roundtrip": _adam7_roundtrip,
        "bits_pack": lambda s, d: filters.digest(_packed(s, d, 2)),
        "bits_roundtrip": _bits_roundtrip,
        "bits_required": lambda s, d: rasters.samples(rasters.scanlines(s, d)).select("image", layout.required_bits(F.col("v")).cast("long").alias("bits")).groupBy("image", "bits").agg(F.count("*").alias("n")),
        "convert_targets": _convert_targets,
        "convert_sources": _convert_sources,
        "convert_key": _convert_key,
        "color_profile": _profile,
        "auto_mode": lambda s, d: colors.auto_mode(colors.profile(rasters.pixels(s, d), KEYS), KEYS),
        "distinct_colors": lambda s, d: colors.colors(rasters.pixels(s, d), KEYS).groupBy(*KEYS).agg(F.count("*").alias("colors"), F.sum("first").alias("firsts")),
        "palette_build": lambda s, d: colors.palette(rasters.pixels(s, d), KEYS).select(*KEYS, "index", *[F.col(c).cast("long").alias(c) for c in "rgba"]),
        "palette_encode": _palette_encode,
        "palette_decode": _palette_decode(True),
        "palette_decode_opaque": _palette_decode(False),
        "missing_colors": _missing,
        "crc32_docs": _checksums,
        "adler32_docs": _adler,
        "symbol_counts": lambda s, d: streams.byte_counts(_docs(s, d), "data"),
        "fixed_codes": lambda s, d: streams.canonical_codes(streams.fixed_lengths(s)),
        "optimal_codes": _optimal_codes,
        "length_buckets": _buckets("length"),
        "distance_buckets": _buckets("distance"),
        "previous_occurrence": _previous,
        "zero_runs": _zero_runs,
        "chunk_names": lambda s, d: containers.names(rasters.chunks(s, d)),
        "chunk_exists": lambda s, d: containers.having(rasters.chunks(s, d), "assistant"),
        "chunk_first": lambda s, d: containers.first(rasters.chunks(s, d), "user").select("image", "seq", F.sha2("data", 256).alias("sha256")),
        "chunk_keywords": _validated,
        "chunk_info": lambda s, d: containers.joined(rasters.chunks(s, d), ROLES),
        "chunk_crc": lambda s, d: containers.checked(rasters.chunks(s, d)).select("image", "seq", "crc"),
        "frame_groups": lambda s, d: containers.frames(rasters.controls(s, d)),
        "frame_sequence": _frame_sequence,
        "frame_bounds": _frame_bounds,
        "png_roundtrip": _png_roundtrip,
        "png_auto_mode": _png_profiled,
        "deflate_roundtrip": _deflate_roundtrip,
        "deflate_modes": _open_deflate,
    }


def oracle_sql() -> dict[str, str]:
    found = {f"filter_{k}": _filter_sql(i, 1) for i, k in enumerate(filters.KINDS)} | {f"filter_{k}_rgba": _filter_sql(i, 4) for i, k in enumerate(filters.KINDS)}
    found |= {f"unfilter_{k}": _unfilter_sql(k, 1) for k in (*filters.KINDS, "mixed")} | {"unfilter_mixed_rgba": _unfilter_sql("mixed", 4), "adam7_roundtrip": RAW} | codec.oracle_sql()
    first = "CASE " + " ".join(f"WHEN x % {p[2]} = {p[0]} AND y % {p[3]} = {p[1]} THEN {i + 1}" for i, p in enumerate(PASSES)) + " END"
    steps = ", ".join(f"({i + 1}, {', '.join(map(str, p))})" for i, p in enumerate(PASSES))
    kinds = ", ".join(f"CAST(count(*) FILTER (role = '{k}') AS BIGINT) AS n_{k}, CAST(coalesce(sum(octet_length(encode(text))) FILTER (role = '{k}'), 0) AS BIGINT) AS bytes_{k}" for k in ROLES)
    return found | {
        "strategy_zero": f"WITH {_tried(1)} SELECT image, y, CAST(0 AS BIGINT) AS kind, {_DIGEST} FROM t WHERE kind = 0 GROUP BY image, y",
        "strategy_predefined": f"WITH {_tried(1)} SELECT image, y, CAST(y % 5 AS BIGINT) AS kind, {_DIGEST} FROM t WHERE kind = y % 5 GROUP BY image, y",
        "strategy_minsum": _choice_sql(MINSUM, 1),
        "strategy_minsum_rgba": _choice_sql(MINSUM, 4),
        "strategy_entropy": _choice_sql(ENTROPY, 1),
        "adam7_passes": f"""WITH p(pass, ix, iy, dx, dy) AS (VALUES {steps}), z AS (SELECT CAST(label AS BIGINT) + 1000 * (vec_id // 512) AS image, count(*) AS height FROM embeddings GROUP BY 1),
s AS (SELECT image, CAST(pass AS BIGINT) AS pass, (64 - ix + dx - 1) // dx AS width, (height - iy + dy - 1) // dy AS height FROM z, p)
SELECT image, pass, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, CAST(coalesce(sum(CASE WHEN width > 0 AND height > 0 THEN height * (width + 1) ELSE 0 END) OVER (PARTITION BY image ORDER BY pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM s""",
        "adam7_order": f"""WITH {LINES}, p AS (SELECT *, CAST({first} AS BIGINT) AS pass FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY image, pass ORDER BY y, x) AS place FROM p)
SELECT image, pass, count(*) AS n, CAST(sum(v * place) AS BIGINT) AS weighted FROM o GROUP BY image, pass""",
        "bits_pack": f"""WITH {LINES}, g AS (SELECT image, y, x // 4 AS x, sum((v >> 6) << (2 * (3 - x % 4))) AS f FROM s GROUP BY image, y, x // 4) SELECT image, y, {_DIGEST} FROM g GROUP BY image, y""",
        "bits_roundtrip": f"WITH {LINES} SELECT image, y, CAST(d AS BIGINT) AS depth, CAST(sum(v >> (8 - d)) AS BIGINT) AS total, CAST(sum((v >> (8 - d)) * (x + 1)) AS BIGINT) AS weighted FROM s, (VALUES (1), (2), (4)) u(d) GROUP BY image, y, d",
        "bits_required": f"WITH {LINES} SELECT image, CAST(CASE WHEN v % 255 = 0 THEN 1 WHEN v % 85 = 0 THEN 2 WHEN v % 17 = 0 THEN 4 ELSE 8 END AS BIGINT) AS bits, count(*) AS n FROM s GROUP BY ALL",
        "convert_targets": _convert_sql(False),
        "convert_sources": _convert_sql(True),
        "convert_key": _key_sql(),
        "color_profile": f"WITH {PROFILE} SELECT variant, image, colored, alpha, key, colors, bits, pixels FROM prof",
        "auto_mode": AUTO,
        "png_auto_mode": f"SELECT variant, image, color_type, bit_depth, true AS same FROM ({AUTO})",
        "distinct_colors": f"WITH {PIXELS} SELECT variant, image, count(*) AS colors, CAST(sum(first) AS BIGINT) AS firsts FROM (SELECT variant, image, r, g, b, a, min(idx) AS first FROM px GROUP BY ALL) GROUP BY variant, image",
        "palette_build": f"WITH {PALETTE} SELECT variant, image, index, r, g, b, a FROM pal",
        "palette_encode": f"WITH {PALETTE} SELECT variant, image, count(index) AS found, CAST(coalesce(sum(index), 0) AS BIGINT) AS total FROM px LEFT JOIN pal USING (variant, image, r, g, b, a) GROUP BY variant, image",
        "palette_decode": _decode_sql(0),
        "palette_decode_opaque": _decode_sql(255),
        "missing_colors": f"""WITH {PIXELS}, c AS (SELECT variant, image, r, g, b, a, min(idx) AS first, count(*) AS n FROM px GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY variant, image ORDER BY first) AS i FROM c)
SELECT variant, image, count(*) AS colors, CAST(sum(n) AS BIGINT) AS pixels FROM k WHERE i > 16 GROUP BY variant, image""",
        "adler32_docs": ADLER,
        "symbol_counts": """WITH h AS (SELECT hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents), b AS (SELECT CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT) AS v FROM (SELECT h, unnest(range(1, n + 1)) AS i FROM h))
SELECT v AS symbol, count(*) AS n FROM b GROUP BY v""",
        "fixed_codes": FIXED_CODES,
        "length_buckets": LENGTH_BUCKETS,
        "distance_buckets": DISTANCE_BUCKETS,
        "previous_occurrence": f"""WITH {BYTES}, g AS (SELECT item_id, pos, v * 65536 + lead(v) OVER w * 256 + lead(v, 2) OVER w AS gram FROM b WINDOW w AS (PARTITION BY item_id ORDER BY pos)),
d AS (SELECT item_id, pos - lag(pos) OVER (PARTITION BY item_id, gram ORDER BY pos) AS back FROM g WHERE gram IS NOT NULL)
SELECT item_id, count(*) AS positions, count(*) FILTER (back <= 2048) AS hits, CAST(coalesce(sum(back) FILTER (back <= 2048), 0) AS BIGINT) AS total FROM d GROUP BY item_id""",
        "zero_runs": f"""WITH {LINES}, z AS (SELECT image, y, x, x - row_number() OVER (PARTITION BY image, y ORDER BY x) AS g FROM s WHERE v < 128) SELECT image, y, min(x) AS start, count(*) AS length FROM z GROUP BY image, y, g""",
        "chunk_names": "SELECT conv_id AS image, string_agg(role, ' ' ORDER BY turn) AS names FROM conversations GROUP BY conv_id",
        "chunk_exists": "SELECT conv_id AS image, bool_or(role = 'assistant') AS found FROM conversations GROUP BY conv_id",
        "chunk_first": "SELECT conv_id AS image, min(turn) AS seq, sha256(arg_min(text, turn)) AS sha256 FROM conversations WHERE role = 'user' GROUP BY conv_id",
        "chunk_keywords": "WITH k AS (SELECT conv_id AS image, turn AS seq, split_part(text, ' ', 1) AS keyword, text FROM conversations) SELECT image, seq, keyword, greatest(length(text) - length(keyword) - 1, 0) AS rest, length(keyword) BETWEEN 1 AND 79 AS valid FROM k",
        "chunk_info": f"SELECT conv_id AS image, {kinds} FROM conversations GROUP BY conv_id",
        "frame_groups": """WITH e AS (SELECT user_id AS animation, row_number() OVER w AS seq, event_type = 'view' AS opens, length(props) AS size, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS frame_no FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT animation, CAST(frame_no AS BIGINT) AS frame_no, min(seq) AS opened, CAST(count(*) FILTER (NOT opens) AS BIGINT) AS parts, CAST(coalesce(sum(size) FILTER (NOT opens), 0) AS BIGINT) AS size FROM e WHERE frame_no >= 0 GROUP BY animation, frame_no""",
        "frame_sequence": "WITH e AS (SELECT user_id AS animation, floor(value) <> lag(floor(value)) OVER (PARTITION BY user_id ORDER BY event_id) + 1 AS bad FROM events) SELECT animation, CAST(count(*) FILTER (bad) AS BIGINT) AS errors FROM e GROUP BY animation",
        "frame_bounds": """WITH i AS (SELECT l_orderkey AS animation, CAST(sum(l_quantity) AS BIGINT) AS width, count(*) AS height, count(*) AS x, CAST(max(l_linenumber) AS BIGINT) AS y FROM lineitem GROUP BY l_orderkey)
SELECT animation, x, y, width, height FROM i JOIN orders ON o_orderkey = animation WHERE width <= 0 OR x + width > 100 OR y + height > length(o_orderpriority)""",
        "png_roundtrip": "SELECT doc_id, 'IHDR IDAT IEND' AS chunks, CAST(greatest(ceil(octet_length(encode(coalesce(text, ''))) / 64.0), 1) AS BIGINT) AS height, sha256(coalesce(text, '')) AS sha256 FROM documents",
        "deflate_modes": "SELECT item_id, mode, sha256(text) AS sha256 FROM benchmark, (VALUES ('tokens'), ('stored'), ('fixed'), ('dynamic'), ('inflate'), ('inflate_stored'), ('inflate_fixed')) m(mode)",
        "deflate_roundtrip": f"SELECT doc_id, 120 AS header, adler32, sha256(coalesce(text, '')) AS sha256 FROM documents JOIN ({ADLER}) USING (doc_id)",
    }
