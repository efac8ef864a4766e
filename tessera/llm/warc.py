"""WARC archives: payloads that occur again become revisit records.

Tasks write raw archives and return headers; headers alone are shuffled by payload digest and joined to the
original of their digest; then each raw archive is rewritten with fresh headers, and the new archives are read back.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, body, join_counted, materialize, scratch_path
from tessera.llm.files import create, new_file, open_fs

ARCHIVE_BYTES = 64 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
HEADERS = "page_id long, url string, payload_bytes long, payload_digest string, payload_check string, archive string, offset long, length long"
_KINDS = {"long": pa.int64(), "string": pa.string()}


def record_id(page_id: int | None, archive: str, offset: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {archive.rsplit("/", 1)[-1]} {offset}')}"


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A record as a gzip member of its own; line ends in values are escaped, null values left out."""
    lines = [f"{k}: {str(v).replace(chr(13), '%0D').replace(chr(10), '%0A')}" for k, v in fields.items() if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode()
    zipped = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return zipped.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + zipped.flush()


def http(payload: bytes | None, n: int) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    return head + (payload or b"")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    return fields, rest[: int(fields["Content-Length"])]


def payload_of(block: bytes) -> bytes:
    return block.split(b"\r\n\r\n", 1)[1]


def records(uri: str, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of an archive, one at a time."""
    system, path = open_fs(uri)
    with system.open_input_stream(path, compression=None) as f:
        data, done, parts = f.read(step), zlib.decompressobj(31), []
        while data:
            parts.append(done.decompress(data))
            if done.eof:
                yield parse(b"".join(parts))
                data, done, parts = done.unused_data or f.read(step), zlib.decompressobj(31), []
            else:
                data = f.read(step)
        if any(parts):
            raise ValueError(f"{uri} ends within a record")


class _Writer:
    """Archives of bounded size in a folder, written one after another."""

    def __init__(self, folder: str, stem: str):
        self.folder, self.stem, self.stream = folder, stem, None

    def add(self, make) -> tuple[str, int, int]:
        """``make(archive, offset)`` gives the record; its archive, offset and length."""
        if self.stream is None:
            self.name = new_file(self.folder, self.stem, ".warc.gz")
            self.stream, self.at = create(self.name), 0
        data = make(self.name, self.at)
        self.stream.write(data)
        at, self.at = self.at, self.at + len(data)
        if self.at >= ARCHIVE_BYTES:
            self.close()
        return self.name, at, len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.record_batch([pa.array(list(c), _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def write_raw(pages: DataFrame) -> DataFrame:
    """A response record for each page; its header rows, as a table."""
    folder = scratch_path(pages.sparkSession, "warc-raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, "raw")
        for batch in batches:
            rows = []
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = html.as_py()
                digest = hashlib.sha1(payload)

                def make(archive: str, offset: int) -> bytes:
                    fields = {
                        "WARC-Type": "response", "WARC-Record-ID": f"<{record_id(page_id, archive, offset)}>", "WARC-Date": DATE, "WARC-Target-URI": url,
                        "WARC-Payload-Digest": "sha1:" + base64.b32encode(digest.digest()).decode(), "Content-Type": "application/http; msgtype=response",
                    }
                    return record(fields, http(payload, len(payload)))

                rows.append((page_id, url, len(payload), digest.hexdigest(), hashlib.sha256(payload).hexdigest(), *out.add(make)))
            yield _rows(rows, HEADERS)
        out.close()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(body("html"), "UTF-8").alias("html"))
    return materialize(rows.transform(arrow_map, run, HEADERS), "warc-headers")


def resolve(headers: DataFrame, least_bytes: int) -> DataFrame:
    """Add ``original``: of equal payloads of at least ``least_bytes``, the record with the largest page_id.

    Payloads are equal if their SHA-1, their length and their SHA-256 are.
    """
    same = ["payload_digest", "payload_bytes", "payload_check"]
    where = F.struct("page_id", "archive", "offset")
    top = headers.where(F.col("payload_bytes") >= least_bytes).groupBy(*same).agg(F.max(where).alias("original"), F.count("*").alias("_n"))
    top = materialize(top.where("_n > 1"), "warc-originals")
    total = top.agg(F.sum("_n")).first()[0] or 0
    return join_counted(headers, top, same, "_n", total, ["archive", "offset"], "left").drop("_n")


def _archives(table: DataFrame) -> int:
    """How many archives a table names: so many tasks are worth starting. Never fewer than one."""
    return max(1, table.select("archive").distinct().count())


def rewrite(resolved: DataFrame) -> DataFrame:
    """Write the deduplicated archives; a table of their names and record counts."""
    folder = scratch_path(resolved.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, counts, source, f = _Writer(folder, "dedup"), {}, None, None
        for batch in batches:
            for r in batch.to_pylist():
                own, original = record_id(r["page_id"], r["archive"], r["offset"]), r["original"]
                fields = {
                    "WARC-Type": "response", "WARC-Record-ID": f"<{own}>", "WARC-Date": DATE, "WARC-Target-URI": r["url"],
                    "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(r["payload_digest"])).decode(),
                    "WARC-Page-ID": r["page_id"], "WARC-Payload-Length": r["payload_bytes"],
                }
                if original is None or (original["archive"], original["offset"]) == (r["archive"], r["offset"]):
                    if source != r["archive"]:
                        source = r["archive"]
                        system, path = open_fs(source)
                        f = system.open_input_file(path)
                    _, block = parse(zlib.decompress(f.read_at(r["length"], r["offset"]), 31))
                else:
                    block = http(None, r["payload_bytes"])
                    fields |= {
                        "WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To-Page-ID": original["page_id"],
                        "WARC-Refers-To": f"<{record_id(original['page_id'], original['archive'], original['offset'])}>",
                    }
                name, _, _ = out.add(lambda archive, offset: record(fields | {"Content-Type": "application/http; msgtype=response"}, block))
                counts[name] = counts.get(name, 0) + 1
        out.close()
        yield _rows(list(counts.items()), "archive string, records long")

    # a given number of tasks, which the planner doesn't merge
    dealt = resolved.repartition(_archives(resolved), "archive").sortWithinPartitions("archive", "offset")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "archive", "offset", "length", "original"]
    return materialize(dealt.select(*columns).transform(arrow_map, run, "archive string, records long"), "warc-archives")


def read_back(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def number(fields: dict[str, str], name: str) -> int | None:
        return int(fields[name]) if name in fields else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seen = [], 0
                for fields, block in records(archive):
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    size = int(fields["WARC-Payload-Length"])
                    if fields["WARC-Type"] == "response":
                        payload = payload_of(block)
                        if (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
                            raise ValueError(f"{archive}: a payload differs from its digest")
                    rows.append((number(fields, "WARC-Page-ID"), size, digest, fields["WARC-Type"], number(fields, "WARC-Refers-To-Page-ID")))
                    seen += 1
                    if len(rows) >= 10_000:
                        yield _rows(rows, schema)
                        rows = []
                if seen != n:
                    raise ValueError(f"{archive} has {seen} records, not {n}")
                yield _rows(rows, schema)

    return archives.repartition(2 * _archives(archives), "archive").transform(arrow_map, run, schema)


def warc_report(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write pages as records, resolve revisits, write deduplicated archives, and describe what is read back.

    Null html counts as empty; html of any length is one record. Of repeated rows with the largest page_id one is the response and the others
    revisit it; null page_ids are least. Null urls are left out of headers. An empty table gives no rows; other
    columns play no part.
    """
    return read_back(rewrite(resolve(write_raw(pages), least_bytes)))
