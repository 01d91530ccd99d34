"""Avro container files as a data source in plain Python: no jar is needed.

A file is split into ranges of bytes; a range's task looks for the first sync
marker in it and decodes the blocks that begin there, so a large file is read by
many tasks.  Codecs are null and deflate.  Writers name their files by the attempt,
and a file counts once the job has committed.  Paths are local or URIs that Arrow
knows.
"""

from __future__ import annotations

import datetime
import decimal
import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from veil.sources.avro_schema import to_avro, to_spark

MAGIC = b"Obj\x01"
EPOCH = datetime.datetime(1970, 1, 1)


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of the Avro files at a path: the file itself, or those of a folder."""
    fs, at = store(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(at, info.size)]
    if info.type == pafs.FileType.NotFound:
        return []
    return sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.type == pafs.FileType.File and f.base_name.endswith(".avro") and not f.base_name.startswith(("_", ".")))


# --- values ---------------------------------------------------------------


def _long(f: BinaryIO) -> int:
    value = shift = 0
    while True:
        byte = f.read(1)
        if not byte:
            raise EOFError
        value |= (byte[0] & 0x7F) << shift
        if byte[0] < 0x80:
            return (value >> 1) ^ -(value & 1)
        shift += 7


def _varint(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


class _Body:
    """A block's bytes with a place."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def read(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]


def _items(body: _Body) -> Iterator[None]:
    while n := _long(body):
        if n < 0:  # with the size in bytes
            _long(body)
        for _ in range(abs(n)):
            yield


def decoder(schema: Any, named: dict[str, Any] | None = None) -> Callable[[_Body], Any]:
    """A function that reads one value of the schema."""
    named = {} if named is None else named
    if isinstance(schema, list):
        options = [decoder(s, named) for s in schema]
        return lambda b: options[_long(b)](b)
    if isinstance(schema, str) and schema in named:
        return lambda b: named[schema](b)
    kind = schema if isinstance(schema, str) else schema["type"]
    logical = schema.get("logicalType") if isinstance(schema, dict) else None
    if kind == "record":
        named[schema["name"]] = lambda b: read(b)
        fields = [(f["name"], decoder(f["type"], named)) for f in schema["fields"]]
        read = lambda b: {n: d(b) for n, d in fields}
        return read
    if kind == "array":
        item = decoder(schema["items"], named)
        return lambda b: [item(b) for _ in _items(b)]
    if kind == "map":
        value = decoder(schema["values"], named)
        return lambda b: {b.read(_long(b)).decode(): value(b) for _ in _items(b)}
    if kind == "enum":
        return lambda b: schema["symbols"][_long(b)]
    if kind == "fixed":
        named[schema["name"]] = lambda b: b.read(schema["size"])
        return named[schema["name"]]
    if logical == "date":
        return lambda b: datetime.date(1970, 1, 1) + datetime.timedelta(days=_long(b))
    if logical in ("timestamp-micros", "timestamp-millis"):
        unit = "microseconds" if logical == "timestamp-micros" else "milliseconds"
        return lambda b: EPOCH + datetime.timedelta(**{unit: _long(b)})
    if logical == "decimal" and kind == "bytes":
        return lambda b: decimal.Decimal(int.from_bytes(b.read(_long(b)), "big", signed=True)).scaleb(-schema.get("scale", 0))
    plain: dict[str, Callable[[_Body], Any]] = {
        "null": lambda b: None,
        "boolean": lambda b: b.read(1) == b"\x01",
        "int": _long,
        "long": _long,
        "float": lambda b: struct.unpack("<f", b.read(4))[0],
        "double": lambda b: struct.unpack("<d", b.read(8))[0],
        "bytes": lambda b: b.read(_long(b)),
        "string": lambda b: b.read(_long(b)).decode(),
    }
    return plain[kind] if isinstance(kind, str) and kind in plain else decoder(kind, named)


def encoder(schema: Any) -> Callable[[Any], bytes]:
    """A function that gives the bytes of one value of a schema made by ``to_avro``."""
    if isinstance(schema, list):
        inner = encoder(next(s for s in schema if s != "null"))
        return lambda v: b"\x00" if v is None else b"\x02" + inner(v)
    kind = schema if isinstance(schema, str) else schema["type"]
    logical = schema.get("logicalType") if isinstance(schema, dict) else None
    if kind == "record":
        fields = [(f["name"], encoder(f["type"])) for f in schema["fields"]]
        return lambda v: b"".join(e(v[n]) for n, e in fields)
    if kind == "array":
        item = encoder(schema["items"])
        return lambda v: (_varint(len(v)) + b"".join(map(item, v)) if v else b"") + b"\x00"
    if kind == "map":
        value, key = encoder(schema["values"]), encoder("string")
        return lambda v: (_varint(len(v)) + b"".join(key(k) + value(x) for k, x in (v.items() if isinstance(v, dict) else v)) if v else b"") + b"\x00"
    if logical == "date":
        return lambda v: _varint((v - datetime.date(1970, 1, 1)).days)
    if logical == "timestamp-micros":
        return lambda v: _varint((v.replace(tzinfo=None) - EPOCH) // datetime.timedelta(microseconds=1))
    if logical == "decimal":
        scale = schema.get("scale", 0)
        whole = lambda v: int(decimal.Decimal(v).scaleb(scale))
        return lambda v: (lambda n: _varint((n.bit_length() + 8) // 8) + n.to_bytes((n.bit_length() + 8) // 8, "big", signed=True))(whole(v))
    sized = lambda b: _varint(len(b)) + b
    return {
        "null": lambda v: b"",
        "boolean": lambda v: b"\x01" if v else b"\x00",
        "int": _varint,
        "long": _varint,
        "float": lambda v: struct.pack("<f", v),
        "double": lambda v: struct.pack("<d", v),
        "bytes": sized,
        "string": lambda v: sized(str(v).encode()),
    }[kind]


# --- files ----------------------------------------------------------------


def header(f: BinaryIO) -> tuple[Any, str, bytes]:
    """(schema, codec, sync marker) of a file that stands at its start."""
    if f.read(4) != MAGIC:
        raise ValueError("no Avro container file")
    meta = {}
    while n := _long(f):
        if n < 0:
            _long(f)
        for _ in range(abs(n)):
            key = f.read(_long(f)).decode()
            meta[key] = f.read(_long(f))
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), f.read(16)


def schema_of(path: str) -> Any:
    found = files_of(path)
    if not found:
        raise FileNotFoundError(f"no Avro files at {path}")
    with store(path)[0].open_input_file(found[0][0]) as f:
        return header(f)[0]


def records(fs: pafs.FileSystem, path: str, low: int, high: int) -> Iterator[Any]:
    """The records of the blocks whose sync marker before them begins in [low, high), or that follow the header if low is 0."""
    with fs.open_input_file(path) as f:
        schema, codec, sync = header(f)
        if codec not in ("null", "deflate"):
            raise ValueError(f"Avro codec {codec!r} isn't supported")
        read, size = decoder(schema), f.size()
        if low > f.tell() - 16:
            f.seek(low)
            held, base = b"", low
            while (at := held.find(sync)) < 0:
                more = f.read(1 << 20)
                if not more:
                    return
                base += max(0, len(held) - 15)
                held = held[-15:] + more if len(held) > 15 else held + more
            if base + at >= high:
                return
            f.seek(base + at + 16)
        while f.tell() < size and f.tell() - 16 < high:
            n, length = _long(f), _long(f)
            data = f.read(length)
            if f.read(16) != sync:
                raise ValueError(f"{path} is damaged at {f.tell()}")
            body = _Body(zlib.decompress(data, -15) if codec == "deflate" else data)
            for _ in range(n):
                yield read(body)


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int) -> None:
        self.path, self.low, self.high = path, low, high


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: Mapping[str, str]) -> None:
        self.schema, self.options = schema, dict(options)

    def partitions(self) -> Sequence[InputPartition]:
        step = int(self.options.get("splitbytes", self.options.get("splitBytes", 64 << 20)))
        return [_Range(p, a, a + step) for p, size in files_of(self.options["path"]) for a in range(0, max(size, 1), step)] or [_Range("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        arrow, rows = to_arrow_schema(self.schema), []
        zoned = {f.name for f in arrow if pa.types.is_timestamp(f.type)}
        for record in records(store(self.options["path"])[0], partition.path, partition.low, partition.high):
            rows.append({f.name: record.get(f.name).replace(tzinfo=datetime.timezone.utc) if f.name in zoned and record.get(f.name) else record.get(f.name) for f in arrow})
            if len(rows) == 4096:
                yield pa.RecordBatch.from_pylist(rows, arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)


class _Written(WriterCommitMessage):
    def __init__(self, path: str) -> None:
        self.path = path


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: Mapping[str, str], overwrite: bool) -> None:
        self.schema, self.options, self.overwrite = schema, dict(options), overwrite
        self.avro = to_avro(schema)
        self.codec = self.options.get("compression", "deflate").lower()
        if self.codec not in ("null", "none", "uncompressed", "deflate"):
            raise ValueError(f"Avro codec {self.codec!r} isn't supported")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, at = store(self.options["path"])
        fs.create_dir(at, recursive=True)
        own, sync, encode = f"{at}/.part-{uuid.uuid4().hex}.avro", uuid.uuid4().bytes, encoder(self.avro)
        deflate, level = self.codec == "deflate", int(self.options.get("compressionlevel", self.options.get("compressionLevel", 6)))
        meta = {"avro.schema": json.dumps(self.avro).encode(), "avro.codec": b"deflate" if deflate else b"null"}
        with fs.open_output_stream(own) as out:
            out.write(MAGIC + _varint(len(meta)) + b"".join(_varint(len(k)) + k.encode() + _varint(len(v)) + v for k, v in meta.items()) + b"\x00" + sync)
            for batch in iterator:
                for first in range(0, batch.num_rows, 4096):
                    rows = batch.slice(first, 4096).to_pylist()
                    body = b"".join(map(encode, rows))
                    if deflate:
                        made = zlib.compressobj(level, zlib.DEFLATED, -15)
                        body = made.compress(body) + made.flush()
                    out.write(_varint(len(rows)) + _varint(len(body)) + body + sync)
        return _Written(own)

    def commit(self, messages: Any) -> None:
        fs, at = store(self.options["path"])
        old = [p for p, _ in files_of(self.options["path"])] if self.overwrite else []
        for m in messages:
            if m is not None:
                folder, _, name = m.path.rpartition("/")
                fs.move(m.path, f"{folder}/{name[1:]}")
        for path in old:
            fs.delete_file(path)

    def abort(self, messages: Any) -> None:
        for m in messages:
            if m is not None:
                store(self.options["path"])[0].delete_file(m.path)


class AvroSource(DataSource):
    """Options: path; splitBytes (bytes of a task's range); compression (null, deflate) and compressionLevel for writing."""

    @classmethod
    def name(cls) -> str:
        return "veil_avro"

    def schema(self) -> StructType:
        return to_spark(schema_of(self.options["path"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(schema, self.options, overwrite)
