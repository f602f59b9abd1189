"""A merge whose columns are parameters."""

import pytest

from tidemark.operators import merge


def test_merge_into(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 0)], "k int, name string, x int")
    source = spark.createDataFrame([(2, "B", 21), (2, "B", 21), (3, "C", 31), (None, "N", 1)], "k int, name string, x int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(merge.merge_into(target, source, ["k"], ["x"], [])) == sorted([(1, "a", 10), (2, "b", 21), (None, "n", 0)], key=str)
    assert rows(merge.merge_into(target, source, ["k"], ["x"], ["k", "x"])) == sorted([(1, "a", 10), (2, "b", 21), (3, None, 31), (None, "n", 0), (None, None, 1)], key=str)
    assert rows(merge.merge_into(target, source.limit(0), ["k"], ["x"], ["k"])) == rows(target)
    for keys, update, insert, allowed in ((["k"], ["x; drop"], [], None), (["k"], ["y"], [], None), (["k"], ["x"], ["name"], ["k", "x"]), (["k"], ["k"], [], None), ([], ["x"], [], None)):
        with pytest.raises(ValueError):
            merge.merge_into(target, source, keys, update, insert, allowed)


def test_types_of_texts(spark):
    from pyspark.sql import functions as F

    from tidemark.sources import files

    texts = ["1", "+7", " 12 ", "1_000", "1.", ".5", "1e5", "-2.5E-3", "nan", "-Infinity", "TRUE", "false", "", None, "x", "1__0", "_1", "1e", "0x10", "t", "--1", "1 2"]

    def want(s):
        for kind, of in (("int64", int), ("float64", float)):
            try:
                of(s or "x")
                return kind
            except ValueError:
                pass
        return "bool" if (s or "").lower() in ("true", "false") else "string"

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    assert [r["t"] for r in rows.select("i", files.text_type(F.col("s")).alias("t")).orderBy("i").collect()] == [want(s) for s in texts]
    found = files.detected_text_types(rows.filter("i >= 10"), ["s"], "i").collect()
    assert [tuple(r) for r in found] == [("s", "bool", 10)] and files.detected_text_types(rows.limit(0), ["s"], "i").first()["type"] == "string"
