"""Media columns: payloads in archive files, read by a data source that plans byte ranges.

A payload becomes an 8-bit greyscale PNG, a member of a zip archive. The source plans ranges of each archive's
bytes; a task reads the members that begin in its range by their offsets, each with retries of its own, and
streams them as Arrow batches of bounded size.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.llm.common import arrow_map, body, materialize, scratch_path
from tessera.llm.files import create, new_file, open_fs

ROW = 192
LEVEL = 3
PNG = b"\x89PNG\r\n\x1a\n"
ARCHIVE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
MOST_RANGES = 200_000


def pad(data: bytes) -> bytes:
    """Blanks up to a positive multiple of a row."""
    return data + b" " * (-len(data) % ROW or (0 if data else ROW))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """A greyscale image of the padded bytes, rows of 192 samples; the true length goes in a text chunk."""
    samples = np.frombuffer(pad(data), np.uint8).reshape(-1, ROW)
    rows = np.zeros((len(samples), ROW + 1), np.uint8)
    rows[:, 1:] = samples
    head = struct.pack(">IIBBBBB", ROW, len(samples), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> tuple[bytes, int]:
    """Samples and true length of an image that ``to_png`` made."""
    if image[:8] != PNG:
        raise ValueError("not a PNG")
    at, parts, n, width = 8, [], -1, 0
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", data)[0]
        elif kind == b"tEXt" and data.startswith(b"Length\0"):
            n = int(data[7:])
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, width + 1)
    return rows[:, 1:].tobytes(), n


def write_archives(df: DataFrame, text: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, str]:
    """Write each row's text as a member of an archive; the folder and the manifest of the archives that count.

    Members are called <number in the archive>-<doc_id>.png, so null and repeated ids do no harm.
    """
    folder = scratch_path(df.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, name, stream, archive, n = [], "", None, None, 0
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if archive is None:
                    name, n = new_file(folder, "media", ".zip"), 0
                    stream = create(name)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(f"{n}-{'' if doc_id is None else doc_id}.png"), to_png(data.as_py()))
                n += 1
                if archive.fp.tell() >= archive_bytes:
                    made.append((name, n, _close(archive, stream)))
                    archive = None
        if archive is not None:
            made.append((name, n, _close(archive, stream)))
        columns = zip(*made, strict=True) if made else ([], [], [])
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "members", "bytes"])

    rows = df.select(F.col("doc_id").cast("long"), F.encode(body(text), "UTF-8").alias("data"))
    manifest = materialize(rows.transform(arrow_map, run, "archive string, members long, bytes long"), "media-manifest")
    return folder, manifest.inputFiles()[0].rsplit("/", 1)[0] if not manifest.isEmpty() else ""


def _close(archive: zipfile.ZipFile, stream) -> int:
    archive.close()
    size = stream.tell()
    stream.close()
    return size


@dataclass
class Range(InputPartition):
    archive: str
    lo: int
    hi: int


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options.get("path", "")
        self.manifest = options.get("manifest", "")
        self.range_bytes = int(options.get("range_bytes", 8 << 20))
        self.tries = int(options.get("tries", 3))
        self.on_error = options.get("on_error", "fail")

    def partitions(self) -> list[Range]:
        """Byte ranges of the archives in the manifest, or else of all zip files of the folder."""
        if self.manifest:
            system, path = open_fs(self.manifest)
            listed = pq.read_table(path, filesystem=system, columns=["archive", "bytes"]).to_pylist()
            sizes = [(r["archive"], r["bytes"]) for r in listed]
        else:
            from pyarrow import fs

            system, path = open_fs(self.folder)
            found = system.get_file_info(fs.FileSelector(path, recursive=True))
            scheme = self.folder[: len(self.folder) - len(path)] if self.folder.endswith(path) else ""
            sizes = [(scheme + f.path, f.size) for f in found if f.is_file and f.path.endswith(".zip")]
        # the plan is held by the driver: ranges grow so that there are at most ``MOST_RANGES`` beside one an archive
        step = max(self.range_bytes, -(-sum(n for _, n in sizes) // MOST_RANGES))
        return [Range(a, lo, min(lo + step, size)) for a, size in sorted(sizes) for lo in range(0, size, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """The members whose headers begin in the range: archive, offset, name, payload, error."""
        system, path = open_fs(partition.archive)
        with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            members = [(i.header_offset, i.filename, i.compress_size, i.CRC) for i in z.infolist() if partition.lo <= i.header_offset < partition.hi]
            rows: list[tuple] = []
            size = 0
            for offset, name, n, crc in sorted(members):
                payload, error = self._member(f, system, path, offset, n, crc)
                rows.append((partition.archive, offset, name, payload, error))
                size += n
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    def _member(self, opened, system, path: str, offset: int, n: int, crc: int) -> tuple[bytes | None, str | None]:
        """One member by its offset; what fails is tried again alone, from a newly opened file."""
        error = ""
        for k in range(self.tries):
            try:
                if k == 0:
                    return _checked(opened, offset, n, crc), None
                with system.open_input_file(path) as f:
                    return _checked(f, offset, n, crc), None
            except OSError as e:
                error = f"{path} at {offset}: {e}"
                time.sleep(0.05 * k)
        if self.on_error == "fail":
            raise OSError(error)
        return None, error


def _checked(f, offset: int, n: int, crc: int) -> bytes:
    head = f.read_at(30, offset)
    if head[:4] != b"PK\x03\x04":
        raise OSError("no member begins there")
    name, extra = struct.unpack_from("<HH", head, 26)
    data = f.read_at(n, offset + 30 + name + extra)
    if len(data) != n or zlib.crc32(data) != crc:
        raise OSError("the bytes don't have the listed checksum")
    return data


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
    names = ["archive", "offset", "name", "payload", "error"]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class MediaArchives(DataSource):
    """``format("media_archives")``: options path or manifest, range_bytes, tries, on_error (fail or row)."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, offset long, name string, payload binary, error string"

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))


def features(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean step between neighbours."""
    x = np.frombuffer(samples, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    step = np.abs(np.diff(x.astype(np.int16))).mean() if len(x) > 1 else 0.0
    return f"mean={x.mean():.4f};sd={x.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};step={step:.4f}"


def describe(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of stored members.

    A member without payload, as the source gives with ``on_error`` row, has its doc_id and nulls.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                image, doc_id = image.as_py(), name.split("-", 1)[1].removesuffix(".png")
                if image is None:
                    rows.append((int(doc_id) if doc_id else None, *[None] * 7))
                    continue
                samples, n = from_png(image)
                rows.append((int(doc_id) if doc_id else None, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(image), hashlib.sha256(image).hexdigest(), features(samples)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=schema.replace(" long", "").replace(" string", "").split(", "))

    return media.select("name", "payload").transform(arrow_map, run, schema)


def media_report(df: DataFrame) -> DataFrame:
    """Store every text as an image in archives, read them back and describe what was read.

    Null text counts as empty and is stored as one row of blanks; ids may be null or repeated; an empty table gives
    no rows; other columns play no part. Equal texts give equal values.
    """
    spark = df.sparkSession
    spark.dataSource.register(MediaArchives)
    folder, manifest = write_archives(df)
    if not manifest:
        return describe(spark.createDataFrame([], MediaArchives({}).schema()))
    return describe(spark.read.format("media_archives").option("manifest", manifest).load(folder))
