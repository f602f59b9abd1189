"""Avro binary messages: records read and written by a schema, with bad ones told apart."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Read = Callable[[bytes, int], tuple[Any, int]]
_PLAIN = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType()}


def _kind(schema: Any) -> str:
    return "union" if isinstance(schema, list) else schema if isinstance(schema, str) else schema["type"] if isinstance(schema["type"], str) else _kind(schema["type"])


def _is_decimal(schema: Any) -> bool:
    return isinstance(schema, dict) and schema.get("logicalType") == "decimal"


def spark_type(schema: Any) -> T.DataType:
    """The type of a schema's values. A union is null and one other type; enums are strings."""
    kind = _kind(schema)
    if kind == "union":
        others = [s for s in schema if _kind(s) != "null"]
        if len(others) != 1:
            raise ValueError("a union must be of null and one other type")
        return spark_type(others[0])
    if kind == "record":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"])) for f in schema["fields"]])
    if kind == "array":
        return T.ArrayType(spark_type(schema["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(schema["values"]))
    if _is_decimal(schema):
        return T.DecimalType(schema.get("precision", 12), schema.get("scale", 2))
    return T.StringType() if kind == "enum" else T.BinaryType() if kind == "fixed" else _PLAIN[kind]


def _long(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            break
        shift += 7
        if shift > 63:
            raise ValueError("a number is too long")
    if value >> 64:
        raise ValueError("a number is too long")
    return (value >> 1) ^ -(value & 1), at


def _take(data: bytes, at: int, n: int) -> tuple[bytes, int]:
    if n < 0 or at + n > len(data):
        raise ValueError("the message ends too early")
    return data[at : at + n], at + n


def reader(schema: Any) -> Read:
    """Reads a value at a place and tells where it ends; raises for what isn't one."""
    kind = _kind(schema)
    if kind == "union":
        parts = [reader(s) for s in schema]

        def union(data: bytes, at: int):
            k, at = _long(data, at)
            if not 0 <= k < len(parts):
                raise ValueError(f"a union has no part {k}")
            return parts[k](data, at)

        return union
    if kind == "record":
        fields = [(f["name"], reader(f["type"])) for f in schema["fields"]]

        def record(data: bytes, at: int):
            out = {}
            for name, read in fields:
                out[name], at = read(data, at)
            return out, at

        return record
    if kind in ("array", "map"):
        item = reader(schema["items"] if kind == "array" else schema["values"])

        def blocks(data: bytes, at: int):
            out: list[Any] = []
            while True:
                n, at = _long(data, at)
                if n < 0:  # with the block's size in bytes
                    n, (_, at) = -n, _long(data, at)
                if not n:
                    return out, at
                if n > len(data):
                    raise ValueError("a block has more items than bytes")
                for _ in range(n):
                    key, at = text(data, at) if kind == "map" else (None, at)
                    value, at = item(data, at)
                    out.append((key, value) if kind == "map" else value)

        return blocks
    if kind == "enum":
        symbols = schema["symbols"]

        def enum(data: bytes, at: int):
            k, at = _long(data, at)
            if not 0 <= k < len(symbols):
                raise ValueError(f"an enum has no symbol {k}")
            return symbols[k], at

        return enum
    if kind in ("bytes", "fixed"):
        size, scale = (schema["size"] if kind == "fixed" else None), (schema.get("scale", 2) if _is_decimal(schema) else None)

        def raw(data: bytes, at: int):
            n, at = (size, at) if size is not None else _long(data, at)
            value, at = _take(data, at, n)
            return (value if scale is None else Decimal(int.from_bytes(value, "big", signed=True)).scaleb(-scale)), at

        return raw
    if kind in ("float", "double"):
        form, width = ("<f", 4) if kind == "float" else ("<d", 8)

        def number(data: bytes, at: int):
            value, at = _take(data, at, width)
            return struct.unpack(form, value)[0], at

        return number
    if kind == "boolean":

        def boolean(data: bytes, at: int):
            value, at = _take(data, at, 1)
            if value[0] > 1:
                raise ValueError("a boolean is neither 0 nor 1")
            return bool(value[0]), at

        return boolean
    return {"null": lambda data, at: (None, at), "string": text, "int": _long, "long": _long}[kind]


def text(data: bytes, at: int) -> tuple[str, int]:
    """A string."""
    n, at = _long(data, at)
    value, at = _take(data, at, n)
    return value.decode(), at


def _zigzag(n: int, out: bytearray) -> None:
    n = n << 1 if n >= 0 else (-n << 1) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def write(schema: Any, value: Any, out: bytearray) -> None:
    """Append a value's bytes. Decimals are rounded to the schema's scale, halves away from zero."""
    kind = _kind(schema)
    if kind == "union":
        k = next(i for i, s in enumerate(schema) if (_kind(s) == "null") == (value is None))
        _zigzag(k, out)
        write(schema[k], value, out)
    elif kind == "record":
        for f in schema["fields"]:
            write(f["type"], value.get(f["name"], f.get("default")), out)
    elif kind in ("array", "map"):
        items = list(value.items()) if isinstance(value, dict) else list(value)
        if items:
            _zigzag(len(items), out)
            for x in items:
                if kind == "map":
                    write("string", x[0], out)
                write(schema["items"] if kind == "array" else schema["values"], x[1] if kind == "map" else x, out)
        out.append(0)
    elif kind == "enum":
        _zigzag(schema["symbols"].index(value), out)
    elif kind in ("bytes", "fixed", "string"):
        if _is_decimal(schema):
            n = int(Decimal(value).scaleb(schema.get("scale", 2)).to_integral_value(ROUND_HALF_UP))
            value = n.to_bytes(schema["size"] if kind == "fixed" else (n + (n < 0)).bit_length() // 8 + 1, "big", signed=True)
        value = value.encode() if isinstance(value, str) else value
        if kind != "fixed":
            _zigzag(len(value), out)
        out += value
    elif kind in ("float", "double"):
        out += struct.pack("<f" if kind == "float" else "<d", value)
    elif kind == "boolean":
        out.append(bool(value))
    elif kind != "null":
        _zigzag(int(value), out)


def encoded(rows: DataFrame, column: str, schema: str, number: int | None = None) -> DataFrame:
    """``rows`` with the struct ``column`` in Avro's binary form; behind a zero byte and a schema's ``number`` if one is given."""
    parsed, kinds = json.loads(schema), rows.schema
    head = b"" if number is None else b"\0" + number.to_bytes(4, "big")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(column).to_pylist():
                body = bytearray(head)
                if value is not None:
                    write(parsed, value, body)
                out.append(None if value is None else bytes(body))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if n == column else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, T.BinaryType() if f.name == column else f.dataType) for f in kinds.fields]))


def decoded(messages: DataFrame, column: str, schema: str, schemas: dict[int, str] | None = None) -> DataFrame:
    """``messages`` with ``record`` and ``error`` in place of the binary ``column``.

    ``schema`` is the record that comes out. With ``schemas`` a message begins with a zero byte and the number of the schema that it
    was written by; fields are matched by name, those that weren't written get their default (null without one), others are
    left out. A message that is null, broken, too long or of an unknown schema has a null record and an error, for a
    dead-letter table. Messages stay where they are."""
    wanted = json.loads(schema)
    kind = spark_type(wanted)
    fields = [(f["name"], f.get("default")) for f in wanted["fields"]]
    kept = [f for f in messages.schema.fields if f.name != column]
    out_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {n: reader(json.loads(s)) for n, s in (schemas or {}).items()}
        plain = reader(wanted)

        def one(data: bytes | None) -> dict[str, Any]:
            if data is None:
                raise ValueError("there is no message")
            read, at = plain, 0
            if schemas is not None:
                if len(data) < 5 or data[0]:
                    raise ValueError("the message has no schema number")
                number, at = int.from_bytes(data[1:5], "big"), 5
                if number not in readers:
                    raise ValueError(f"schema {number} is unknown")
                read = readers[number]
            value, at = read(data, at)
            if at != len(data):
                raise ValueError("bytes are left behind the record")
            return {n: value.get(n, default) for n, default in fields}

        for batch in batches:
            records, errors = [], []
            for data in batch.column(column).to_pylist():
                try:
                    record, error = one(data), None
                except (ValueError, IndexError, TypeError) as problem:
                    record, error = None, str(problem) or type(problem).__name__
                records.append(record)
                errors.append(error)
            try:
                pa.array(records, out_type)
            except (ValueError, TypeError, pa.ArrowException):  # some values don't fit their types: find whose
                for k, record in enumerate(records):
                    try:
                        pa.array([record], out_type)
                    except (ValueError, TypeError, pa.ArrowException) as problem:
                        records[k], errors[k] = None, str(problem)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(records, out_type), pa.array(errors, pa.string())], [*[f.name for f in kept], "record", "error"])

    return messages.mapInArrow(run, T.StructType([*kept, T.StructField("record", kind), T.StructField("error", T.StringType())]))
