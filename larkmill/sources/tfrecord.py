"""Record files of key-value examples: length-framed protocol-buffer messages, optionally gzip-compressed.

A Python data source (read and write) without the framework that defined the format. Features are lists of bytes, floats or
64-bit integers.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType


def crc32c_table() -> list[int]:
    """Table of the Castagnoli polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_TABLE = crc32c_table()


def masked_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _TABLE[(c ^ b) & 255] ^ (c >> 8)
    c ^= 0xFFFFFFFF
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        n |= (x & 127) << shift
        at += 1
        if x < 128:
            return n, at
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Numbered fields of a message."""
    at = 0
    while at < len(b):
        tag, at = read_varint(b, at)
        kind = tag & 7
        if kind == 0:
            value, at = read_varint(b, at)
        elif kind == 2:
            n, at = read_varint(b, at)
            value, at = b[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = b[at : at + n], at + n
        yield tag >> 3, value


def block(number: int, payload: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def encode_example(row: dict) -> bytes:
    """One message: strings and bytes, floats, or integers, as lists."""
    out = b""
    for name, values in row.items():
        if values is None:
            continue
        values = list(values) if isinstance(values, (list, tuple)) else [values]
        if values and isinstance(values[0], (str, bytes, bytearray)):
            feature = block(1, b"".join(block(1, v.encode() if isinstance(v, str) else bytes(v)) for v in values))
        elif values and isinstance(values[0], float):
            feature = block(2, block(1, struct.pack(f"<{len(values)}f", *values)))
        else:
            feature = block(3, block(1, b"".join(map(varint, values))))
        out += block(1, block(1, name.encode()) + block(2, feature))
    return block(1, out)


def decode_example(message: bytes) -> dict[str, list]:
    """Feature lists by name."""
    found: dict[str, list] = {}
    for _, features in fields(message):
        for _, entry in fields(features):
            parts = dict(fields(entry))
            kind, body = next(iter(fields(parts.get(2, b""))), (3, b""))
            values: list = []
            for _, v in fields(body):
                if kind == 1:
                    values.append(v)
                elif kind == 2:
                    values += struct.unpack(f"<{len(v) // 4}f", v)
                elif isinstance(v, int):
                    values.append(v - (1 << 64) if v >> 63 else v)
                else:
                    at = 0
                    while at < len(v):
                        n, at = read_varint(v, at)
                        values.append(n - (1 << 64) if n >> 63 else n)
            found[parts[1].decode()] = values
    return found


def frames(stream: BinaryIO, verify: bool = True) -> Iterator[bytes]:
    """Messages of a stream, one at a time; checksums of lengths are always compared, those of messages if verify."""
    while head := stream.read(12):
        if len(head) < 12 or struct.unpack_from("<I", head, 8)[0] != masked_crc(head[:8]):
            raise ValueError("damaged record length")
        (n,) = struct.unpack_from("<Q", head)
        body = stream.read(n + 4)
        if len(body) < n + 4 or verify and struct.unpack_from("<I", body, n)[0] != masked_crc(body[:n]):
            raise ValueError("damaged record")
        yield body[:n]


def framed(message: bytes) -> bytes:
    n = struct.pack("<Q", len(message))
    return n + struct.pack("<I", masked_crc(n)) + message + struct.pack("<I", masked_crc(message))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    store, bare = _store(path)
    info = store.get_file_info(bare)
    files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(bare, recursive=True))
    prefix = path[: len(path) - len(bare)] if path.endswith(bare) else ""
    return sorted(prefix + f.path for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def _messages(path: str, verify: bool) -> Iterator[bytes]:
    """Messages of a file, read as they are needed."""
    store, bare = _store(path)
    with store.open_input_stream(bare, compression=None) as f:
        zipped = f.read(2) == b"\x1f\x8b"
    with store.open_input_stream(bare, compression="gzip" if zipped else None) as f:
        yield from frames(f, verify)


def inferred(messages: Iterator[bytes]) -> StructType:
    """Schema of some examples: strings, floats and integers; a feature of more than one value anywhere is an array."""
    kinds: dict[str, tuple] = {}
    for message in messages:
        for name, values in decode_example(message).items():
            one = StringType() if values and isinstance(values[0], bytes) else DoubleType() if values and isinstance(values[0], float) else LongType()
            known, many = kinds.get(name, (one, False))
            kinds[name] = (one if values else known, many or len(values) > 1)
    return StructType([StructField(n, ArrayType(k) if many else k) for n, (k, many) in sorted(kinds.items())])


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.verify = schema, options["path"], options.get("verify", "true") != "false"

    def partitions(self):
        return [_File(f) for f in _files(self.path)]

    def read(self, partition):
        for message in _messages(partition.path, self.verify):
            row = decode_example(message)
            out = []
            for field in self.schema.fields:
                values, kind = row.get(field.name), field.dataType
                many = isinstance(kind, ArrayType)
                if isinstance(kind.elementType if many else kind, StringType) and values is not None:
                    values = [v.decode(errors="replace") for v in values]
                out.append(values if many else values[0] if values else None)
            yield tuple(out)


class _Writer(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.zip = schema.names, options["path"], options.get("compression", "gzip") == "gzip"

    def write(self, iterator):
        store, path = _store(self.path)
        out = None
        try:
            for row in iterator:
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/part-{uuid.uuid4().hex}.tfrecord" + ".gz" * self.zip, compression="gzip" if self.zip else None)
                out.write(framed(encode_example({n: row[n] for n in self.names})))
        finally:
            if out is not None:
                out.close()
        return WriterCommitMessage()


class TFRecord(DataSource):
    """format("tfrecord"): scalar columns take a list's first value.

    Without a schema that of the first `sample` examples (100) of the first file that has any is taken. verify = false leaves
    the messages' checksums unread, which is several times faster.
    """

    @classmethod
    def name(cls):
        return "tfrecord"

    def schema(self):
        for path in _files(self.options["path"]):
            found = inferred(islice(_messages(path, True), int(self.options.get("sample", 100))))
            if found.fields:
                return found
        raise ValueError("no example to take a schema from")

    def reader(self, schema):
        return _Reader(schema, self.options)

    def writer(self, schema, overwrite):
        return _Writer(schema, self.options)
