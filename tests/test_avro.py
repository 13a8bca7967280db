"""Avro files: round trips of all types, and a file put together byte by byte from the specification."""

import datetime
import json
import zlib
from decimal import Decimal

import pytest

from featherloom.sources import avro

SCHEMA = "a int, b long, c float, d double, e string, f binary, g boolean, h array<string>, i map<string,double>, j struct<x:int,y:array<long>>, k date, l timestamp, m decimal(12,3)"


@pytest.mark.parametrize("codec", ["deflate", "null"])
def test_round_trip(spark, tmp_path, codec):
    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    rows = [
        (1, -(2**62), 1.5, -2.25, "é😀", b"\x00\xff", True, ["a", None], {"k": 1.0, "l": None}, (3, [1, -2]), datetime.date(1969, 1, 2), at, Decimal("-12.345")),
        (None,) * 13,
        (-(2**31), 0, 0.0, float("inf"), "", b"", False, [], {}, (None, None), datetime.date(2030, 1, 1), at, Decimal("0.001")),
    ]
    df = spark.createDataFrame(rows * 3, SCHEMA).repartition(2)
    path = str(tmp_path / "x")
    avro.save_avro(df, path, codec)
    back = avro.load_avro(spark, path)
    assert back.dtypes == df.dtypes
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    avro.save_avro(df.limit(0), path, codec)  # replaces the files
    assert avro.load_avro(spark, path).count() == 0 and avro.load_avro(spark, path).dtypes == df.dtypes


def test_a_file_from_the_specification(spark, tmp_path):
    """A long 64 is 80 01, the string foo is 06 66 6f 6f, an array of 3 and 27 is 04 06 36 00; blocks are deflated."""
    schema = {"type": "record", "name": "r", "namespace": "n", "fields": [
        {"name": "n", "type": "long"}, {"name": "s", "type": "string"}, {"name": "v", "type": {"type": "array", "items": "long"}}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["A", "B"]}},
        {"name": "o", "type": ["int", "null"]}, {"name": "again", "type": ["null", "n.E"]}, {"name": "f", "type": {"type": "fixed", "name": "F", "size": 2}},
    ]}
    text = json.dumps(schema).encode()
    record = bytes.fromhex("8001" "06666f6f" "04063600" "02" "02" "0200" "6162")
    negative = bytes.fromhex("01" "00" "0304063600" "00" "0006" "00" "0000")  # a block with its size in bytes
    whole = zlib.compress(record + negative, wbits=-15)
    out = bytearray(avro.MAGIC)
    out += b"\x04" + bytes([22]) + b"avro.schema"
    avro._put_bytes(out, text)
    out += bytes([20]) + b"avro.codec" + bytes([14]) + b"deflate" + b"\x00" + b"0123456789abcdef" + b"\x04"
    avro._put_bytes(out, whole)
    (tmp_path / "x.avro").write_bytes(bytes(out) + b"0123456789abcdef")
    got = [tuple(r) for r in avro.load_avro(spark, str(tmp_path)).collect()]
    assert got == [(64, "foo", [3, 27], "B", None, "A", bytearray(b"ab")), (-1, "", [3, 27], "A", 3, None, bytearray(2))]


def test_errors(spark, tmp_path):
    with pytest.raises(TypeError):
        avro.spark_type(["null", "int", "string"])
    with pytest.raises(ValueError):
        list(avro.records(b"no file"))
    with pytest.raises(ValueError):
        avro.save_avro(spark.range(1), str(tmp_path), "lzo")
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,\n")
    avro.csv_to_avro(spark, str(tmp_path / "x.csv"), str(tmp_path / "y"), "a long, b string")
    assert sorted(map(tuple, avro.load_avro(spark, str(tmp_path / "y")).collect())) == [(1, "x"), (2, None)]
