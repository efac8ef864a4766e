"""PNG files as a source and sink, and decoding and encoding of BINARY columns. Errors are values, not failed jobs."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from tessera.functions import png, raster
from tessera.functions.raster import Mode

FRAME = "struct<frame_no:int,x:int,y:int,width:int,height:int,delay_num:int,delay_den:int,dispose:int,blend:int,data:binary>"
IMAGE = f"struct<width:int,height:int,color_type:int,bit_depth:int,data:binary,frames:array<{FRAME}>,error:string>"
CHUNK = "struct<seq:int,type:string,length:bigint,crc:bigint,data:binary,crc_ok:boolean>"
#: Named targets: colour type and depth; None keeps the file's own mode.
TARGETS = {"RGBA8": (6, 8), "RGB8": (2, 8), "RGBA16": (6, 16), "RGB16": (2, 16), "GREY8": (0, 8), "RAW": (None, None)}


def _decoded(raw: bytes | None, color_type: int | None, depth: int | None, ignore_crc: bool, ignore_adler: bool) -> dict:
    empty = {"width": None, "height": None, "color_type": None, "bit_depth": None, "data": None, "frames": []}
    try:
        got = png.decode(raw or b"", color_type, depth, ignore_crc, ignore_adler)
    except ValueError as e:
        return empty | {"error": str(e)}
    names = ("frame_no", "x", "y", "width", "height", "delay_num", "delay_den", "dispose", "blend", "data")
    return {k: got[k] for k in empty} | {"frames": [{n: f[n] for n in names} for f in got["frames"]], "error": None}


def _column(kind: str, one: Callable, *columns: Column | str) -> Column:
    """``one`` of each row's values as a column of type ``kind``; structs are dicts. Values go by Arrow, since pandas holds and copies each several times."""
    made = to_arrow_type(_parse_datatype_string(kind))

    @F.arrow_udf(kind)
    def run(*values: pa.Array) -> pa.Array:
        return pa.array((one(*row) for row in zip(*(v.to_pylist() for v in values), strict=True)), made)

    return run(*columns)


def decode(content: Column | str, mode: str = "RGBA8", ignore_crc: bool = False, ignore_adler: bool = False) -> Column:
    """A struct (width, height, color_type, bit_depth, data, frames, error) of PNG bytes. What can't be decoded has an error alone."""
    color_type, depth = TARGETS[mode]
    return _column(IMAGE, lambda raw: _decoded(raw, color_type, depth, ignore_crc, ignore_adler), content)


def _or_null(read: Callable) -> Callable:
    """``read`` of bytes; null for what it can't read."""

    def one(raw: bytes | None):
        try:
            return read(raw or b"")
        except ValueError:
            return None

    return one


def chunk_list(content: Column | str) -> Column:
    """The chunks of PNG bytes, wrong checksums included; null for what isn't a PNG."""
    return _column(f"array<{CHUNK}>", _or_null(lambda raw: png.parse_chunks(raw, ignore_crc=True)), content)


def filter_types(content: Column | str) -> Column:
    """The filter of each row of the default image; null for what can't be decoded."""
    return _column("array<int>", _or_null(png.filter_types), content)


ENTRY = "struct<type:string,field:string,value:string>"


def metadata(content: Column | str) -> Column:
    """Rows (seq, type, field, value) of all chunks with fields, values as text; null for what can't be read."""
    names = ("seq", "type", "field", "value")
    return _column("array<struct<seq:int,type:string,field:string,value:string>>", _or_null(lambda raw: [dict(zip(names, m, strict=True)) for m in png.metadata(raw)]), content)


def with_metadata(content: Column | str, entries: Column | str) -> Column:
    """A PNG with more chunks, from an array of (type, field, value); null where that can't be done."""

    def one(raw: bytes | None, rows: list[dict] | None) -> bytes | None:
        try:
            return png.with_metadata(raw or b"", [(e["type"], e["field"], e["value"]) for e in rows])
        except (ValueError, KeyError, TypeError):
            return None

    return _column("binary", one, content, entries)


def _encoded(raw: bytes | None, width: int | None, height: int | None, color_type: int, depth: int, **settings) -> dict:
    try:
        return {"content": png.encode(raw, int(width), int(height), color_type, depth, **settings), "error": None}
    except (ValueError, TypeError, KeyError, struct.error) as e:
        return {"content": None, "error": str(e)}


def encode_animation(data: Column | str, width: Column, height: Column, frames: Column | str, color_type: int = 6, depth: int = 8, **settings) -> Column:
    """A struct (content, error) of a default image and ``frames``, an array of structs as ``decode`` gives them."""
    one = lambda raw, w, h, parts: _encoded(raw, w, h, color_type, depth, frames=parts, **settings)
    return _column("struct<content:binary,error:string>", one, data, width.cast("int"), height.cast("int"), frames)


INFO = (
    "struct<width:int,height:int,bit_depth:int,color_type:int,interlace:int,palette:array<array<int>>,key:array<int>,background:array<int>,phys:array<bigint>,time:array<int>,"
    "gamma:bigint,plays:bigint,texts:array<struct<kind:string,keyword:string,text:string,language:string,translated:string>>,chunk_names:string,error:string>"
)


def _info(raw: bytes | None, read_texts: bool) -> dict:
    names = ("width", "height", "bit_depth", "color_type", "interlace", "palette")
    empty = dict.fromkeys([*names, "key", "background", "phys", "time", "gamma", "plays", "chunk_names", "error"]) | {"texts": []}
    try:
        chunks = png.parse_chunks(raw or b"")
        got = png.chunk_info(chunks, read_texts)
        control = next((c for c in chunks if c["type"] == "acTL"), None)
        texts = [{"kind": k, "language": None, "translated": None} | t for k in ("tEXt", "zTXt", "iTXt") for t in got[k]]
        values = {n: list(got[c].values()) for n, c in (("background", "bKGD"), ("phys", "pHYs"), ("time", "tIME")) if c in got}
        return empty | {n: got[n] for n in names} | values | {
            "key": list(got["key"]) if got["key"] else None, "gamma": got["gAMA"]["gamma"] if "gAMA" in got else None,
            "plays": png.parse_ancillary("acTL", control["data"], got, 0)["plays"] if control else None, "texts": texts, "chunk_names": png.shown_names(chunks),
        }
    except ValueError as e:
        return empty | {"error": str(e)}


def info(content: Column | str, read_texts: bool = True) -> Column:
    """Header, colour mode, metadata, texts and chunk names of PNG bytes; what is absent is null."""
    return _column(INFO, lambda raw: _info(raw, read_texts), content)


def convert(data: Column | str, width: Column, height: Column, source: Mode, target: Mode) -> Column:
    """Pixels of one mode as pixels of another, without row padding; null for too few bytes or a colour that the palette lacks."""

    def one(raw: bytes | None, w: int, h: int) -> bytes | None:
        try:
            made = raster.convert(raster.unpack_flat(raw or b"", w, h, source.color_type, source.depth), source, target)
            return raster.pack_flat(made, target.depth)
        except ValueError:
            return None

    return _column("binary", one, data, width.cast("int"), height.cast("int"))


def encode(data: Column | str, width: Column, height: Column, color_type: int = 6, depth: int = 8, **settings) -> Column:
    """A struct (content, error) of pixels without row padding; ``settings`` are those of ``functions.png.encode``."""
    return _column("struct<content:binary,error:string>", lambda raw, w, h: _encoded(raw, w, h, color_type, depth, **settings), data, width.cast("int"), height.cast("int"))


def read_images(spark: SparkSession, path: str, mode: str = "RGBA8", on_error: str = "row", **options: bool) -> DataFrame:
    """Files as (path, image); ``on_error="drop"`` leaves out what can't be decoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)
    made = files.select("path", decode("content", mode, **options).alias("image"))
    return made.where("image.error is null") if on_error == "drop" else made


def chunks(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row per chunk: (key, seq, type, length, crc, data, crc_ok)."""
    return files.select(key, F.inline(chunk_list(content)))


def frames(images: DataFrame, key: str, image: str = "image") -> DataFrame:
    """One row per animation frame, in file order, not composed.

    A plain inline has Spark decode each file twice, once to leave out images without frames.
    """
    return images.select(key, F.inline_outer(F.col(f"{image}.frames"))).where("frame_no is not null")


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class Images(DataSource):
    """``format("png_images")``: reads (path, width, height, color_type, bit_depth, data, error); writes rows (name, content).

    Options: path, mode, files_per_task; writing adds files and never replaces one.
    """

    @classmethod
    def name(cls) -> str:
        return "png_images"

    def schema(self) -> str:
        return "path string, width int, height int, color_type int, bit_depth int, data binary, error string"

    def reader(self, schema) -> ImageReader:
        return ImageReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ImageWriter:
        return ImageWriter(dict(self.options))


class ImageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.mode, self.per = options["path"], options.get("mode", "RGBA8"), int(options.get("files_per_task", 64))

    def partitions(self) -> list[Files]:
        system, path = fs.FileSystem.from_uri(self.path)
        found = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.endswith(".png"))
        paths = [p for p, _ in found]
        return [Files(paths[i : i + self.per]) for i in range(0, len(paths), self.per)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        kinds = [pa.string(), *[pa.int32()] * 4, pa.binary(), pa.string()]
        names = ["path", "width", "height", "color_type", "bit_depth", "data", "error"]
        for path in partition.paths:
            with system.open_input_file(path) as f:
                got = _decoded(f.read(), *TARGETS[self.mode], False, False)
            row = [path, *(got[n] for n in names[1:])]
            yield pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)


class ImageWriter(DataSourceWriter):
    """Tasks write under hidden names of their own; commit gives the files their names."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, rows: Iterator) -> Written:
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(path, recursive=True)
        done = []
        for r in rows:
            name = f"{path}/.{uuid.uuid4().hex}-{TaskContext.get().partitionId()}~{r['name']}.png"
            with system.open_output_stream(name, compression=None) as f:
                f.write(bytes(r["content"]))
            done.append(name)
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for p in m.paths if m else []:
                folder, name = p.rsplit("/", 1)
                system.move(p, f"{folder}/{name.split('~', 1)[1]}")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for p in m.paths if m else []:
                system.delete_file(p)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Images)
