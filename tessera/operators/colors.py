"""Colour conversion, profiles, automatic modes and palettes on pixel tables (keys, idx, r, g, b, a)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.raster import DEPTHS
from tessera.operators.layout import required_bits

MODES = [(t, d) for t in sorted(DEPTHS) for d in DEPTHS[t] if t != 3]
SAMPLES = {0: "r", 2: "rgb", 4: "ra", 6: "rgba"}


def to_depth(v: Column, depth: int) -> Column:
    """An 8-bit sample at a depth: replicated to 16 bits, the top bits below 8."""
    return v * 257 if depth == 16 else F.shiftright(v, 8 - depth)


def from_depth(v: Column, depth: int) -> Column:
    """A sample of a depth at 8 bits: the high byte, or stretched to the full range."""
    return F.shiftright(v, 8) if depth == 16 else F.floor(v * 255 / ((1 << depth) - 1)).cast("long")


def to_mode(color_type: int, depth: int, r: str = "r", g: str = "g", b: str = "b", a: str = "a") -> list[Column]:
    """Samples of a mode without palette for an RGBA8 pixel; grey is the red sample."""
    names = dict(zip("rgba", (r, g, b, a), strict=True))
    return [to_depth(F.col(names[c]).cast("long"), depth) for c in SAMPLES[color_type]]


def from_mode(values: list[Column], color_type: int, depth: int, key: tuple[int, ...] | None = None) -> list[Column]:
    """RGBA8 of samples of a mode; a pixel that equals the key, at its own depth, is transparent."""
    scaled = [from_depth(v, depth) for v in values]
    if color_type in (4, 6):
        alpha = scaled[-1]
    elif key is None:
        alpha = F.lit(255)
    else:
        hit = F.lit(True)
        for v, k in zip(values, key, strict=True):
            hit = hit & (v == k)
        alpha = F.when(hit, 0).otherwise(255)
    rgb = scaled[:3] if color_type in (2, 6) else [scaled[0]] * 3
    return [*rgb, alpha]


def look_up(pixels: DataFrame, palette: DataFrame, keys: list[str], direct: bool = True) -> DataFrame:
    """Palette decode: (keys, idx, index) with (keys, index, r, g, b, a); beyond it black, transparent if ``direct``."""
    rest = [F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"]
    return pixels.join(palette, [*keys, "index"], "left").select(*keys, "idx", *rest, F.coalesce("a", F.lit(0 if direct else 255)).alias("a"))


def colors(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Different colours with their first pixel and count; merged before the shuffle."""
    return pixels.groupBy(*keys, "r", "g", "b", "a").agg(F.min("idx").alias("first"), F.count("*").alias("n"))


def profile(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """One row per image: colored, alpha, key (a colour or null), colors (257 for more than 256), bits, pixels.

    Transparent pixels of one colour that no opaque pixel has make a key; anything else that isn't opaque is alpha.
    """
    by_rgb = colors(pixels, keys).groupBy(*keys, "r", "g", "b").agg(
        F.count("*").alias("colors"), F.sum("n").alias("pixels"), F.bool_or(F.col("a") == 0).alias("clear"),
        F.bool_or(F.col("a") != 0).alias("seen"), F.bool_or(~F.col("a").isin(0, 255)).alias("partial"),
    )
    whole = by_rgb.groupBy(*keys).agg(
        F.bool_or((F.col("r") != F.col("g")) | (F.col("g") != F.col("b"))).alias("colored"),
        (F.bool_or("partial") | (F.sum(F.col("clear").cast("int")) > 1) | F.bool_or(F.col("clear") & F.col("seen"))).alias("alpha"),
        F.min(F.when(F.col("clear"), F.struct("r", "g", "b"))).alias("_key"),
        F.least(F.sum("colors"), F.lit(257)).alias("colors"), F.sum("pixels").alias("pixels"), F.max(required_bits(F.col("r"))).alias("_grey"),
    )
    bits = F.when(F.col("colored") | F.col("alpha"), 8).otherwise(F.col("_grey")).cast("long")
    return whole.select(*keys, "colored", "alpha", F.when(~F.col("alpha"), F.col("_key")).alias("key"), "colors", bits.alias("bits"), "pixels")


def auto_mode(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, color_type, bit_depth, keyed): the smallest mode that loses nothing, of images of 8-bit samples."""
    small = F.col("key").isNotNull() & (F.col("pixels") <= 16)
    alpha = F.col("alpha") | small
    bits = F.when(small, F.greatest("bits", F.lit(8))).otherwise(F.col("bits"))
    grey_ok = ~F.col("colored") & ~alpha
    index = F.when(F.col("colors") <= 2, 1).when(F.col("colors") <= 4, 2).when(F.col("colors") <= 16, 4).otherwise(8)
    palette = (F.col("colors") <= 256) & (F.col("colors") * 2 < F.col("pixels")) & ~(grey_ok & (bits <= index))
    kind = F.when(palette, 3).when(alpha, F.when(F.col("colored"), 6).otherwise(4)).otherwise(F.when(F.col("colored"), 2).otherwise(0))
    depth = F.when(palette, index).when(kind == 0, bits).otherwise(F.greatest(bits, F.lit(8)))
    return profiles.select(*keys, kind.cast("long").alias("color_type"), depth.cast("long").alias("bit_depth"), (F.col("key").isNotNull() & ~alpha & ~palette).alias("keyed"))


def palette(pixels: DataFrame, keys: list[str], most: int = 256) -> DataFrame:
    """(keys, index, r, g, b, a): up to ``most`` colours by first appearance."""
    first = F.array_sort(F.collect_list(F.struct("first", "r", "g", "b", "a")))
    few = _earliest(colors(pixels, keys), keys, most).groupBy(*keys).agg(first.alias("_c"))  # at most ``most`` of each image
    return few.select(*keys, F.posexplode("_c").alias("index", "_e")).select(*keys, F.col("index").cast("long").alias("index"), *[F.col(f"_e.{c}").alias(c) for c in "rgba"])


def _earliest(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    from pyspark.sql import Window

    return found.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("first"))).where(F.col("_i") <= most).drop("_i")


def encode_indices(pixels: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, index): pixels by their place in a palette; of equal entries the last. Colours it lacks: null index."""
    last = entries.groupBy(*keys, "r", "g", "b", "a").agg(F.max("index").alias("index"))
    return pixels.join(last, [*keys, "r", "g", "b", "a"], "left").select(*keys, "idx", "index")


def missing_colors(pixels: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Different colours that a palette lacks."""
    return colors(pixels, keys).join(entries, [*keys, "r", "g", "b", "a"], "left_anti").select(*keys, "r", "g", "b", "a", "n")
