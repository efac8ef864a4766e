"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OURS = "tessera.batches"
_SCRATCH: dict[str, list[str]] = {}
_KEPT: dict[str, list[str]] = {}
_TABLES: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (local mode) gets a temporary folder; a cluster gets an error, since
    its executors couldn't see a folder of the driver's machine.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str, until_exit: bool = False) -> str:
    """A new path in the shared folder; it goes with ``clear_scratch`` or, at the latest, at exit."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    (_KEPT if until_exit else _SCRATCH).setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str, buckets: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and it survives lost executors.

    With ``buckets`` it is dealt into so many by the columns ``by``, and a join by these doesn't shuffle it again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if not buckets:
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table = f"tessera_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *by).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(table)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(table)
    return spark.table(table)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this application. Call it only when no result that reads them is still wanted."""
    for table in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        clear_scratch(spark)
        for path in _KEPT.pop(spark.sparkContext.applicationId, []):
            delete(spark, path)


atexit.register(_at_exit)


#: Bytes of an Arrow batch where the session doesn't say otherwise; a batch of long texts is held several times over.
BATCH_BYTES = 4 << 20
#: What a Python worker remembers, in dictionaries; emptied when a task ends.
CACHES: list[dict] = []


def give_back() -> None:
    """Return memory to the system: Python workers wait for the next task, of whatever kind, with all that they hold."""
    for cache in CACHES:
        cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches of bounded size, and memory given back when a task ends."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not df.sparkSession.conf.get(_OURS, None):
        if df.sparkSession.conf.get(limit) == str(64 << 20) + "b":  # the default
            df.sparkSession.conf.set(limit, BATCH_BYTES)
        df.sparkSession.conf.set(_OURS, "true")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def body(text: str = "text") -> Column:
    """A text column where null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column, step: int = 256, levels: int = 2) -> Column:
    """Inclusive running sums of an array of longs: sums in blocks of ``step``, then sums of the blocks' ends likewise.

    With two levels over plain sums the cost of n values is about n * ``step`` / 2 up to ``step`` ** 3 values.
    """
    if levels == 0:
        return F.aggregate(
            values,
            F.array().cast("array<long>"),
            lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)),
        )
    blocks = bound(
        values,
        lambda a: F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / step).cast("int") - 1, F.lit(0))),
            lambda i: running_sums(F.slice(a, i * step + 1, F.lit(step)), step, 0),
        ),
    )

    def joined(b: Column) -> Column:
        ends = running_sums(F.transform(b, lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0).cast("long"))), step, levels - 1)
        before = F.concat(F.array(F.lit(0).cast("long")), ends)
        return bound(before, lambda e: F.flatten(F.transform(b, lambda x, i: F.transform(x, lambda v: v + F.get(e, i)))))

    return bound(blocks, joined)


SPAN = "array<struct<start:long,stop:long,hit:string>>"


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern as an array of (start, stop, hit).

    Positions count code points, ``stop`` is exclusive. The pattern must not match the empty string.
    """

    def located(pieces: Column, hits: Column) -> Column:
        before = F.slice(pieces, 1, F.size(hits))
        ends = running_sums(F.zip_with(hits, before, lambda h, p: (F.length(h) + F.length(p)).cast("long")))
        return F.zip_with(hits, ends, lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("stop"), h.alias("hit")))

    def found(pieces: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.when(F.size(pieces) > 1, bound(hits, lambda h: located(pieces, h))).otherwise(F.array().cast(SPAN))

    return bound(F.split(text, pattern, -1), found)


def text_around(text: Column, spans: Column, window: int) -> Column:
    """The ``window`` code points before and behind each span, as an array of (before, behind) beside ``spans``.

    The text is cut into blocks once and each span looks at two of them a side, so that cost doesn't grow as spans x text.
    """
    size = max(window, 512)

    def before(blocks: Column, start: Column) -> Column:
        i, rest = F.floor(start / size).cast("int"), (start % size).cast("int")
        earlier = F.when((rest < window) & (i > 0), F.get(blocks, i - 1)).otherwise(F.lit(""))
        return F.right(F.concat(earlier, F.left(F.coalesce(F.get(blocks, i), F.lit("")), rest)), F.lit(window))

    def behind(blocks: Column, stop: Column) -> Column:
        i, rest = F.floor(stop / size).cast("int"), (stop % size).cast("int")
        here = F.substring(F.coalesce(F.get(blocks, i), F.lit("")), rest + 1, F.lit(window))
        later = F.when(rest + window > size, F.coalesce(F.get(blocks, i + 1), F.lit(""))).otherwise(F.lit(""))
        return F.left(F.concat(here, later), F.lit(window))

    blocks = F.when(F.size(spans) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    return bound(
        blocks,
        lambda b: F.transform(spans, lambda s: F.struct(before(b, s["start"]).alias("before"), behind(b, s["stop"]).alias("behind"))),
    )


def deal(df: DataFrame, owner: str, tasks: int) -> DataFrame:
    """``df`` in ``tasks`` partitions, one for each value of ``owner``, a number from 0 to ``tasks`` - 1.

    Hash partitioning sends several owners to one task and leaves others idle, so owners go by numbers that it keeps
    apart. The planner merges no partitions.
    """
    place = F.pmod(F.hash("id"), F.lit(tasks)).cast("long").alias("_owner")
    places = df.sparkSession.range(40 * tasks).select(place, "id").groupBy("_owner").agg(F.min("id").alias("_place"))
    placed = df.join(F.broadcast(places), F.col(owner) == F.col("_owner"), "left").withColumn("_place", F.coalesce("_place", owner))
    return placed.repartition(tasks, "_place").select(*df.columns)


def sums_before(rows: DataFrame, by: str, order: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Add ``out``: the sum of ``value`` over rows of the same ``by`` (null is one) with a smaller ``order``, whole numbers from 0.

    Sums run over blocks of ``block`` orders and inside each block, so a group of n rows needs no task with more
    than n / ``block`` or ``block`` of them.
    """
    rows = rows.withColumn("_block", F.floor(F.col(order) / block))
    totals = rows.groupBy(by, "_block").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(by).alias("_by"), F.col("_block").alias("_of"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(totals, rows[by].eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_of")))
    return met.withColumn(out, F.col("_inside") + F.col("_base")).drop("_block", "_by", "_of", "_base", "_inside")


#: A key with more than one in so many rows is hot; there are fewer hot keys than this, whatever the input.
HOT_SHARE = 1_000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, spread: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right``, which has one row for each key and in ``count`` the rows that key has in ``left``.

    ``total`` is the sum of ``count``. Keys with over a thousandth of it are fewer than a thousand, so their rows of
    ``right`` are broadcast; rows of ``left`` that they meet are dealt by ``spread``, columns in which rows of a key
    differ, and all others by key. No task gets a hot key's rows. ``how`` is inner or left; keys aren't null.
    """
    hot = F.col(count) * HOT_SHARE > F.lit(total)
    values = [c for c in right.columns if c not in keys]

    def part(where: Column, name: str) -> DataFrame:
        return right.where(where).select(*keys, F.struct(*values).alias(name))

    dealt = left.join(F.broadcast(part(hot, "_hot")), keys, "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), F.lit(1 << 20)) + 1).cast("int"))
    # always 0, but not to the planner, which would leave a constant out of the keys
    cold = part(~hot, "_cold").withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int"))
    met = dealt.join(cold, [*keys, "_salt"], "left").withColumn("_right", F.coalesce("_hot", "_cold"))
    if how == "inner":
        met = met.where(F.col("_right").isNotNull())
    return met.select(*left.columns, "_right.*")


def digest_text(spans: Column) -> Column:
    """kind:start:stop of spans (structs with kind, start, stop), comma-joined in their order."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
