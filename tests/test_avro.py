"""Avro's binary form: examples of its specification, round trips and broken messages."""

import json
import random
from decimal import Decimal

import pytest

from tidemark.sources import avro

rng = random.Random(2)


def written(schema, value):
    out = bytearray()
    avro.write(schema, value, out)
    return bytes(out)


@pytest.mark.parametrize(("schema", "value", "data"), [
    ("long", 0, "00"), ("long", -1, "01"), ("long", 1, "02"), ("long", -64, "7f"), ("long", 64, "8001"), ("string", "foo", "06666f6f"), ("boolean", True, "01"), (["null", "string"], None, "00"), (["null", "string"], "a", "020261"),
    ({"type": "array", "items": "long"}, [3, 27], "04063600"), ({"type": "enum", "symbols": ["A", "B"]}, "B", "02"), ({"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}, Decimal("-1.28"), "0280"), ("double", 1.0, "000000000000f03f"),
])
def test_bytes(schema, value, data):
    assert written(schema, value).hex() == data and avro.reader(schema)(bytes.fromhex(data), 0) == (value, len(data) // 2)


def test_blocks_with_sizes():
    assert avro.reader({"type": "array", "items": "long"})(bytes.fromhex("0304063600"), 0)[0] == [3, 27]


SCHEMA = {"type": "record", "name": "R", "fields": [
    {"name": "id", "type": "long"}, {"name": "name", "type": ["null", "string"], "default": None}, {"name": "money", "type": {"type": "bytes", "logicalType": "decimal", "precision": 12, "scale": 2}},
    {"name": "tags", "type": {"type": "map", "values": "int"}}, {"name": "deep", "type": {"type": "record", "name": "D", "fields": [{"name": "flags", "type": {"type": "array", "items": "boolean"}}]}}, {"name": "small", "type": "float"},
]}


def test_round_trip_and_broken_messages(spark):
    rows = [(k, {"id": rng.randrange(-(1 << 62), 1 << 62), "name": rng.choice([None, "", "é🙂"]), "money": Decimal(rng.randrange(-(10**9), 10**9)) / 100, "tags": {f"t{j}": j - 2 for j in range(k % 4)}, "deep": {"flags": [True, False][: k % 3]}, "small": 0.5 * k}) for k in range(60)]
    good = [(k, written(SCHEMA, v)) for k, v in rows]
    bad = [(100, None), (101, b""), (102, good[0][1][:-1]), (103, good[0][1] + b"\0"), (104, b"\xff" * 30), (105, b"\x02\x08")]
    out = avro.decoded(spark.createDataFrame(good + bad, "k int, m binary"), "m", json.dumps(SCHEMA)).collect()
    assert {r["k"]: r["record"].asDict(True) for r in out if r["error"] is None} == dict(rows)
    assert sorted(r["k"] for r in out if r["error"]) == [k for k, _ in bad] and all(r["record"] is None for r in out if r["error"])
    again = avro.encoded(spark.createDataFrame([(1, None)], f"k int, m {avro.spark_type(SCHEMA).simpleString()}"), "m", json.dumps(SCHEMA)).first()
    assert again["m"] is None
