"""Avro container files, read and written without another package, by the published specification.

Files are read by Spark (so from any store that it knows, and as streams) and decoded in Arrow batches. Each task writes one
file under a temporary name, and the driver moves the files of the attempts that succeeded into place.
"""

from __future__ import annotations

import bz2
import io
import json
import lzma
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAGIC = b"Obj\x01"
#: Rows of a block that is written, and of an Arrow batch that is read.
BLOCK_ROWS = 4096
#: Bytes in which a file's header must end for its schema to be learned.
HEADER_BYTES = 1 << 20
_NAMED = ("record", "enum", "fixed")


# types


def _known(schema, names: dict):
    """The schema that a name or a definition stands for; definitions are noted under their name without its namespace."""
    if isinstance(schema, str):
        return names.get(schema.rpartition(".")[2], {"type": schema})
    if isinstance(schema, dict) and schema.get("type") in _NAMED:
        names[schema["name"].rpartition(".")[2]] = schema
    return schema


def spark_type(schema, names: dict | None = None) -> T.DataType:
    """The Spark type of an Avro schema. Unions are of one type and null."""
    names = {} if names is None else names
    s = _known(schema, names)
    if isinstance(s, list):
        some = [x for x in s if x != "null"]
        if len(some) != 1:
            raise TypeError(f"a union of {len(some)} types has no column type")
        return spark_type(some[0], names)
    kind, logical = s["type"], s.get("logicalType")
    if isinstance(kind, (dict, list)):
        return spark_type(kind, names)
    if kind == "record":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"], names)) for f in s["fields"]])
    if kind == "array":
        return T.ArrayType(spark_type(s["items"], names))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(s["values"], names))
    if logical == "decimal":
        return T.DecimalType(s["precision"], s.get("scale", 0))
    if logical in ("timestamp-millis", "timestamp-micros"):
        return T.TimestampType()
    if logical == "date":
        return T.DateType()
    plain = {"boolean": T.BooleanType, "int": T.IntegerType, "long": T.LongType, "float": T.FloatType, "double": T.DoubleType, "bytes": T.BinaryType, "fixed": T.BinaryType, "string": T.StringType, "enum": T.StringType, "null": T.NullType}
    if kind not in plain:
        raise TypeError(f"unknown type {kind}")
    return plain[kind]()


def avro_schema(dtype: T.DataType, name: str = "row") -> dict | str:
    """The Avro schema of a Spark type; every field may be null."""
    if isinstance(dtype, T.StructType):
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": ["null", avro_schema(f.dataType, f"{name}_{f.name}")]} for f in dtype.fields]}
    if isinstance(dtype, T.ArrayType):
        return {"type": "array", "items": ["null", avro_schema(dtype.elementType, f"{name}_item")]}
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        return {"type": "map", "values": ["null", avro_schema(dtype.valueType, f"{name}_value")]}
    if isinstance(dtype, T.DecimalType):
        return {"type": "bytes", "logicalType": "decimal", "precision": dtype.precision, "scale": dtype.scale}
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return {"type": "long", "logicalType": "timestamp-micros"}
    if isinstance(dtype, T.DateType):
        return {"type": "int", "logicalType": "date"}
    plain = {"boolean": "boolean", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "float": "float", "double": "double", "binary": "bytes", "string": "string"}
    if dtype.simpleString() not in plain:
        raise TypeError(f"no schema for {dtype.simpleString()}")
    return plain[dtype.simpleString()]


# values


def _long(read: Callable[[int], bytes]) -> int:
    out = shift = 0
    while True:
        b = read(1)[0]
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return (out >> 1) ^ -(out & 1)
        shift += 7


def _bytes(read) -> bytes:
    return read(_long(read))


def _blocks(read) -> Iterator[None]:
    """Once for each item of an array or a map."""
    while n := _long(read):
        if n < 0:
            n = -n
            _long(read)  # the bytes of the block
        for _ in range(n):
            yield


def decoder(schema, names: dict | None = None) -> Callable:
    """A function that reads one value. Maps are lists of pairs; times are micros, dates days."""
    names = {} if names is None else names
    s = _known(schema, names)
    if isinstance(s, list):
        every = [decoder(x, names) for x in s]
        return lambda read: every[_long(read)](read)
    kind, logical = s["type"], s.get("logicalType")
    if isinstance(kind, (dict, list)):
        return decoder(kind, names)
    if kind == "record":
        fields = [(f["name"], decoder(f["type"], names)) for f in s["fields"]]
        return lambda read: {n: d(read) for n, d in fields}
    if kind == "array":
        item = decoder(s["items"], names)
        return lambda read: [item(read) for _ in _blocks(read)]
    if kind == "map":
        value = decoder(s["values"], names)
        return lambda read: [(_bytes(read).decode(), value(read)) for _ in _blocks(read)]
    if kind == "enum":
        return lambda read: s["symbols"][_long(read)]
    raw = (lambda read: read(s["size"])) if kind == "fixed" else _bytes
    if logical == "decimal":
        return lambda read: Decimal(int.from_bytes(raw(read), "big", signed=True)).scaleb(-s.get("scale", 0))
    if logical == "timestamp-millis":
        return lambda read: _long(read) * 1000
    plain = {
        "null": lambda read: None, "boolean": lambda read: read(1) == b"\x01", "int": _long, "long": _long, "float": lambda read: struct.unpack("<f", read(4))[0],
        "double": lambda read: struct.unpack("<d", read(8))[0], "bytes": _bytes, "fixed": raw, "string": lambda read: _bytes(read).decode(),
    }
    return plain[kind]


def _put_long(out: bytearray, n: int) -> None:
    n = (n << 1) ^ (n >> 63)
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def _put_bytes(out: bytearray, b: bytes) -> None:
    _put_long(out, len(b))
    out += b


def encoder(schema) -> Callable[[bytearray, object], None]:
    """A function that writes one value of a schema made by avro_schema."""
    if isinstance(schema, list):
        own = encoder(schema[1])

        def optional(out, v):
            _put_long(out, v is not None)
            if v is not None:
                own(out, v)

        return optional
    s = {"type": schema} if isinstance(schema, str) else schema
    kind = s["type"]
    if kind == "record":
        fields = [(f["name"], encoder(f["type"])) for f in s["fields"]]

        def record(out, v):
            for n, put in fields:
                put(out, v[n])

        return record
    if kind in ("array", "map"):
        put = encoder(s["items"] if kind == "array" else s["values"])

        def items(out, v):
            if len(v):
                _put_long(out, len(v))
            for x in v:
                if kind == "map":
                    _put_bytes(out, x[0].encode())
                    x = x[1]
                put(out, x)
            out.append(0)

        return items
    if s.get("logicalType") == "decimal":

        def decimal(out, v):
            n = int(v.scaleb(s["scale"]))
            _put_bytes(out, n.to_bytes(n.bit_length() // 8 + 1, "big", signed=True))

        return decimal
    plain = {
        "boolean": lambda out, v: out.append(bool(v)), "int": _put_long, "long": _put_long, "float": lambda out, v: out.extend(struct.pack("<f", v)), "double": lambda out, v: out.extend(struct.pack("<d", v)),
        "bytes": _put_bytes, "string": lambda out, v: _put_bytes(out, v.encode()),
    }
    return plain[kind]


# files


def _unpacked(block: bytes, codec: str) -> bytes:
    if codec == "null":
        return block
    if codec == "deflate":
        return zlib.decompress(block, -15)
    if codec == "bzip2":
        return bz2.decompress(block)
    if codec == "xz":
        return lzma.decompress(block)
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(block)
    if codec == "snappy":  # four bytes of a check sum stand behind the block, and the size before it
        size = shift = 0
        for b in block:
            size |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                break
        return pa.decompress(block[:-4], size, "snappy", asbytes=True)
    raise ValueError(f"unknown codec {codec}")


def header(read: Callable[[int], bytes]) -> tuple[dict | list | str, str, bytes]:
    """(schema, codec, marker between blocks) of a file."""
    if read(4) != MAGIC:
        raise ValueError("no Avro container file")
    meta = {_bytes(read).decode(): _bytes(read) for _ in _blocks(read)}
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), read(16)


def records(content: bytes) -> Iterator[object]:
    """The values of a whole file."""
    f = io.BytesIO(content)
    schema, codec, marker = header(f.read)
    value = decoder(schema)
    while f.tell() < len(content):
        n, block = _long(f.read), _bytes(f.read)
        if f.read(16) != marker:
            raise ValueError("a block does not end with the file's marker")
        read = io.BytesIO(_unpacked(block, codec)).read
        for _ in range(n):
            yield value(read)


def _decoded(files: DataFrame, schema: T.StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                rows: list = []
                for r in records(batch.column(0)[i].as_py()):
                    rows.append(r)
                    if len(rows) == BLOCK_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return files.select("content").mapInArrow(run, schema)


def schema_of(spark: SparkSession, path: str) -> T.StructType:
    """The column types of one of the files, from its header."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, HEADER_BYTES)).first()
    if head is None:
        raise FileNotFoundError(f"no file at {path}")
    found = spark_type(header(io.BytesIO(bytes(head[0])).read)[0])
    if not isinstance(found, T.StructType):
        raise TypeError("the values of the file are no records")
    return found


def load_avro(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The records of all files at a path, a task for each file at most. Files must have the fields of `schema` (that of one of
    the files if not given); others are left out. Files of no records give no rows."""
    return _decoded(spark.read.format("binaryFile").load(path), schema or schema_of(spark, path))


def stream_avro(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that come into a folder, as a stream."""
    return _decoded(spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path), schema)


def _file_system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _container(rows: Iterator[dict], schema: dict, codec: str) -> Iterator[bytes]:
    marker, put = uuid.uuid4().bytes, encoder(schema)
    out = bytearray(MAGIC)
    _put_long(out, 2)
    for k, v in (("avro.schema", json.dumps(schema).encode()), ("avro.codec", codec.encode())):
        _put_bytes(out, k.encode())
        _put_bytes(out, v)
    out.append(0)
    yield bytes(out + marker)
    block, n = bytearray(), 0

    def closed() -> bytes:
        whole = bytes(block) if codec == "null" else zlib.compress(block, wbits=-15)
        out = bytearray()
        _put_long(out, n)
        _put_bytes(out, whole)
        return bytes(out + marker)

    for r in rows:
        put(block, r)
        n += 1
        if n == BLOCK_ROWS:
            yield closed()
            block, n = bytearray(), 0
    if n:
        yield closed()


def save_avro(df: DataFrame, path: str, codec: str = "deflate") -> None:
    """Write a file for each partition of df that has rows (one for an empty frame, with the schema alone). codec: deflate or
    null. Files that stand at the path already are replaced."""
    if codec not in ("deflate", "null"):
        raise ValueError(f"codec {codec} is not written")
    schema = avro_schema(df.schema)
    times = [(f.name, isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)), isinstance(f.dataType, T.DateType)) for f in df.schema.fields]
    plain = df.select(*[F.unix_micros(F.col(f"`{n}`").cast("timestamp")).alias(n) if ts else F.unix_date(F.col(f"`{n}`")).alias(n) if day else F.col(f"`{n}`") for n, ts, day in times])
    run_id = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        first = next(rows, None)
        if first is None:
            return
        from itertools import chain

        store, base = _file_system(path)
        name = f"{uuid.uuid4().hex}.avro"
        store.create_dir(f"{base}/_{run_id}", recursive=True)
        with store.open_output_stream(f"{base}/_{run_id}/{name}") as f:
            for part in _container(chain([first], rows), schema, codec):
                f.write(part)
        yield pa.RecordBatch.from_pydict({"name": [name]})

    names = [r["name"] for r in plain.mapInArrow(write, "name string").collect()]
    store, base = _file_system(path)
    store.create_dir(f"{base}/_{run_id}", recursive=True)
    if not names:
        names = ["empty.avro"]
        with store.open_output_stream(f"{base}/_{run_id}/{names[0]}") as f:
            f.write(b"".join(_container(iter(()), schema, codec)))
    from pyarrow import fs

    for old in store.get_file_info(fs.FileSelector(base)):
        if old.type == fs.FileType.File and old.base_name.endswith(".avro"):
            store.delete_file(old.path)
    for i, name in enumerate(sorted(names)):
        store.move(f"{base}/_{run_id}/{name}", f"{base}/part-{i:05d}-{run_id}.avro")
    store.delete_dir(f"{base}/_{run_id}")


def csv_to_avro(spark: SparkSession, source: str, target: str, schema: T.StructType | str, header: bool = True) -> None:
    """A CSV file with a schema as an Avro file."""
    save_avro(spark.read.schema(schema).csv(source, header=header), target)
