"""Exact duplicates by an extendible-hash index on shared files.

A directory doubles wherever a bucket of the hash space holds too many bytes of distinct keys. Map tasks merge
the equal texts they see; what is left goes to the owner of its key range, which chains the texts of a key and
compares their bytes. The chains are the pages of the index, a table in the shared folder; documents find their bucket
in the directory and themselves in its pages, by key and SHA-256. Where only the rows that stay are wanted, they travel with their texts.
Either way texts are shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import arrow_map, body, deal, join_counted, materialize

#: Bytes of distinct texts in a bucket, and the most leaves of a directory, which the driver holds. Beyond a quarter
#: of these leaves (1 TB of distinct text) buckets get twice as large, again and again; nothing is left out.
BUCKET_BYTES = 4 << 20
MOST_LEAVES = 1 << 20
#: Bytes of text that a map task holds for merging.
HELD_BYTES = 16 << 20


def key(text: Column) -> Column:
    return F.xxhash64(text)


def _prefix(k: Column, bits: int) -> Column:
    return F.shiftrightunsigned(k, 64 - bits) if bits else F.lit(0).cast("long")


def build_directory(keys: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> np.ndarray:
    """First keys (unsigned, ascending) of the buckets. ``keys``: a row (k, bytes) per distinct key.

    The driver holds a few numbers for each bucket, never keys: at most ``MOST_LEAVES`` buckets, for which
    ``bucket_bytes`` is doubled until a quarter of them would hold everything.
    """
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    while total / bucket_bytes > MOST_LEAVES / 4:
        bucket_bytes *= 2
    leaves: list[int] = []
    frontier, depth = [(0, total)], 0
    while frontier:
        step = min(64 - depth, max(1, int(np.ceil(np.log2(max(w for _, w in frontier) / bucket_bytes + 1))) + 1))
        inside = keys.where(_prefix(F.col("k"), depth).isin([p for p, _ in frontier])) if depth else keys
        found = {
            r["p"]: (r["w"], r["n"])
            for r in inside.groupBy(_prefix(F.col("k"), depth + step).alias("p")).agg(F.sum("bytes").alias("w"), F.count("*").alias("n")).collect()
        }
        later = []
        for prefix, _ in frontier:
            below = [found.get((prefix << step) + i, (0, 0)) for i in range(1 << step)]
            stack = [(0, 1 << step)]
            while stack:  # double: a bucket splits in two halves of its range
                lo, hi = stack.pop()
                weight, n = sum(w for w, _ in below[lo:hi]), sum(n for _, n in below[lo:hi])
                if weight <= bucket_bytes or n <= 1 or (hi - lo == 1 and depth + step == 64):
                    leaves.append(((prefix << step) + lo) << (64 - depth - step))
                elif hi - lo == 1:
                    later.append(((prefix << step) + lo, weight))
                else:
                    mid = (lo + hi) // 2
                    stack += [(lo, mid), (mid, hi)]
        frontier, depth = later, depth + step
    return np.array(sorted(leaves or [0]), dtype=np.uint64)


def _merge(directory: np.ndarray):
    """Map side: one row for each text that the task saw, with its bucket and, if there is a fourth column, that of its top row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        rests: list[pa.Array] = []
        size = seen = 0

        def flush() -> pa.RecordBatch:
            rows = list(held.values())
            keys = np.array([r[0] for r in rows], dtype=np.int64)
            bucket = _buckets(directory, keys)
            columns = [pa.array(bucket, pa.int64()), pa.array(keys), pa.array(list(held), pa.binary()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3))]
            names = ["bucket", "k", "text", "top", "rows", "top_rows"]
            if rests:
                columns.append(pa.concat_arrays(rests).take(pa.array([r[4] for r in rows])))
                names.append("rest")
            return pa.record_batch(columns, names=names)

        for batch in batches:
            if batch.num_columns > 3:
                rests.append(batch.column(3))
                size += batch.column(3).nbytes
            for i, (doc_id, k, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
                text = text.as_py()
                entry = held.get(text)
                if entry is None:
                    held[text] = [k, doc_id, 1, 1, seen + i]
                    size += len(text) + 200
                else:
                    _absorb(entry, doc_id, 1, 1, seen + i)
            seen += batch.num_rows
            if size > HELD_BYTES:
                yield flush()
                held, rests, size, seen = {}, [], 0, 0
        if held:
            yield flush()

    return run


def _absorb(entry: list, top: int | None, rows: int, top_rows: int, place: object = None) -> None:
    """Entry: key, largest id (null is least), rows, rows with that id, where one of them is."""
    entry[2] += rows
    if top == entry[1]:
        entry[3] += top_rows
    elif entry[1] is None or (top is not None and top > entry[1]):
        entry[1], entry[3], entry[4] = top, top_rows, place


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """Owner side: rows come by bucket and key; the texts of a key form a chain and are compared byte by byte.

    An entry of a chain: key, largest id, rows, rows with that id, (other columns, place in them), text.
    """
    at: tuple[int, int] | None = None
    chain: list[list] = []
    for batch in batches:
        rest = batch.column(6) if batch.num_columns > 6 else None
        heads = zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)], batch.column(2), strict=True)
        for i, (bucket, k, top, rows, top_rows, text) in enumerate(heads):
            if (bucket, k) != at:
                if chain:
                    yield at[0], chain
                at, chain = (bucket, k), []
            text = text.as_py()
            same = next((e for e in chain if e[5] == text), None)
            if same is None:
                chain.append([k, top, rows, top_rows, (rest, i), text])
            else:
                _absorb(same, top, rows, top_rows, (rest, i))
    if chain:
        yield at[0], chain


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of the index."""
    out: list[tuple] = []

    def page() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["bucket", "k", "place", "text_sha256", "n_bytes", "keep_id", "group_size", "top_rows"]
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for bucket, chain in _chains(batches):
        digests = [hashlib.sha256(e[5]).hexdigest() for e in chain]
        if len(set(digests)) < len(chain):
            raise ValueError("different texts have equal keys and SHA-256")
        for n, (e, digest) in enumerate(zip(chain, digests, strict=True)):
            out.append((bucket, e[0], n, digest, len(e[5]), e[1], e[2], e[3]))
        if len(out) > 10_000:
            yield page()
            out.clear()
    yield page()


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each entry and the other columns of its top row."""
    texts: list[bytes] = []
    rests: list[pa.Array] = []
    size = 0
    for _, chain in _chains(batches):
        for *_, (rest, i), text in chain:
            texts.append(text)
            rests.append(rest.slice(i, 1))
            size += len(text)
        if size > HELD_BYTES // 4 or len(texts) > 10_000:
            yield pa.record_batch([pa.array(texts, pa.binary()), pa.concat_arrays(rests)], names=["text", "rest"])
            texts, rests, size = [], [], 0
    if texts:
        yield pa.record_batch([pa.array(texts, pa.binary()), pa.concat_arrays(rests)], names=["text", "rest"])


_MERGED = "bucket long, k long, text binary, top long, rows long, top_rows long"


def _buckets(directory: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.searchsorted(directory, keys.view(np.uint64), side="right") - 1


def _with_bucket(keyed: DataFrame, directory: np.ndarray) -> DataFrame:
    """Add ``bucket`` to rows with a key ``k``."""
    shared = keyed.sparkSession.sparkContext.broadcast(directory)  # 8 bytes a bucket, ``MOST_LEAVES`` at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _buckets(shared.value, batch.column("k").to_numpy())
            yield pa.record_batch([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "bucket"])

    return keyed.transform(arrow_map, run, T.StructType([*keyed.schema.fields, T.StructField("bucket", T.LongType())]))


def _dealt(rows: DataFrame, bucket_bytes: int) -> tuple[DataFrame, np.ndarray]:
    """``rows`` (doc_id, text, maybe rest) merged by map tasks and dealt to the owners of their buckets, by key; and the directory."""
    keyed = rows.withColumn("k", key(F.col("text")))
    keys = materialize(keyed.groupBy("k").agg((F.max(F.octet_length("text")) + 64).alias("bytes")), "hash-keys")
    rest = [c for c in rows.columns if c == "rest"]
    schema = T.StructType([*T.StructType.fromDDL(_MERGED).fields, *(rows.schema[c] for c in rest)])
    directory = build_directory(keys, bucket_bytes)
    merged = keyed.select("doc_id", "k", F.encode("text", "UTF-8").alias("text"), *rest).transform(arrow_map, _merge(directory), schema)
    # ranges of buckets, as many as tasks: each owner has its share of the directory
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = merged.withColumn("owner", F.floor(F.col("bucket") * tasks / len(directory)).cast("long"))
    dealt = deal(owned, "owner", tasks).select(*merged.columns)
    return dealt.sortWithinPartitions("bucket", "k"), directory


def build_index(df: DataFrame, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, np.ndarray]:
    """The pages, a row (bucket, k, place, text_sha256, n_bytes, keep_id, group_size, top_rows) per distinct text; and the directory.

    Texts of any length are compared whole; null counts as empty. An empty table has no pages and one bucket.
    """
    owned, directory = _dealt(df.select(F.col("doc_id").cast("long").alias("doc_id"), body(text).alias("text")), bucket_bytes)
    pages = owned.transform(arrow_map, _own, "bucket long, k long, place int, text_sha256 string, n_bytes long, keep_id long, group_size long, top_rows long")
    return materialize(pages, "hash-pages"), directory


def exact_groups(df: DataFrame, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; null ids are least and null text counts as empty. Of
    repeated rows with that id one is kept and the others are not. Texts of any length are compared whole. An empty
    table gives no rows; other columns play no part.
    """
    index, directory = build_index(df, text, bucket_bytes)
    digest = F.sha2(F.encode(body(text), "UTF-8"), 256)
    keyed = df.select("doc_id", key(body(text)).alias("k"), digest.alias("text_sha256"))
    total = index.agg(F.sum("group_size")).first()[0] or 0
    pages = index.select("bucket", "k", "text_sha256", "keep_id", "group_size", "top_rows")
    found = join_counted(_with_bucket(keyed, directory), pages, ["bucket", "k", "text_sha256"], "group_size", total, ["doc_id"]).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    if index.where("top_rows > 1").isEmpty():
        return found.select(*columns)
    tied = F.col("kept") & (F.col("top_rows") > 1)
    # rows that are tied agree in all that is returned, so each group is written anew with one kept row
    once = found.where(tied).select("doc_id", "keep_id", "group_size", "text_sha256", "top_rows").distinct()
    anew = once.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("top_rows").cast("int")))).withColumn("kept", F.col("_i") == 1)
    return found.where(~tied).select(*columns).unionByName(anew.select(*columns))


def drop_copies(df: DataFrame, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``df`` that stay, with its columns: of equal texts that with the largest doc_id.

    Null ids are least; of repeated rows with the id that stays, any one. Null and empty texts are equal, and the row
    that stays keeps its own. Texts of any length are compared whole. An empty table gives no rows; other columns
    may have any names and types.
    """
    others = [c for c in df.columns if c != text]
    rest = F.struct(F.col(f"`{text}`").isNull().alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), body(text).alias("text"), rest.alias("rest"))
    schema = T.StructType([T.StructField("text", T.BinaryType()), rows.schema["rest"]])
    stay = _dealt(rows, bucket_bytes)[0].transform(arrow_map, _survivors, schema)
    whole = F.when(~F.col("rest.none"), F.col("text").cast("string")).alias(text)
    return stay.select(*[whole if c == text else F.col(f"rest.c{others.index(c)}").alias(c) for c in df.columns])
