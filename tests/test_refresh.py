"""Refreshed tables against full computations, interrupted refreshes, and what is rewritten."""

from pathlib import Path

from pyspark.sql import functions as F

from tidemark.operators import refresh

def what():
    return refresh.Aggregate(("k",), "at", {"n": F.lit(1), "total": F.col("x")}, {"top": F.col("x")}, {"values": "v"}, buckets=4)


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, at long, x long, v long")


def full(rows):
    out = {}
    for k, _, x, v in rows:
        n, total, top, values = out.get(k, (0, 0, x, set()))
        out[k] = (n + 1, total + x, max(top, x), values | ({v} - {None}))
    return {k: (n, total, top, len(values)) for k, (n, total, top, values) in out.items()}


def shown(spark, folder):
    return {r["k"]: (r["n"], r["total"], r["top"], r["values"]) for r in refresh.current(spark, folder, what()).collect()}


def test_refreshes(spark, tmp_path):
    rows = [(k, i, (i * 7) % 11 - 3, None if i % 5 == 0 else i % 4) for i, k in enumerate(["a", "b", "a", None, "c", "a", "d", "b", "e", "a", "a", "f"] * 3)]
    folder, source = str(tmp_path / "t"), table(spark, rows)
    assert refresh.due(spark, folder, 5, 10)
    for now in (9, 20, 35):
        assert refresh.refreshed(folder, source, what(), now)
        assert shown(spark, folder) == full([r for r in rows if r[1] <= now])
    assert refresh.refreshed(folder, source, what(), 60) == []
    assert not refresh.due(spark, folder, 40, 10) and refresh.due(spark, folder, 45, 10)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    rows = [(k, 1, 1, 1) for k in "abcdefghij"]
    folder = str(tmp_path / "t")
    everything = refresh.refreshed(folder, table(spark, rows), what(), 1)
    before = {p: p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}
    touched = refresh.refreshed(folder, table(spark, [*rows, ("a", 2, 5, 9)]), what(), 2)
    after = {p: p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}
    assert len(touched) == 1 < len(everything)
    assert {p.parent.name for p in before if p not in after} == {f"bucket={touched[0]}"} and all(after[p] == before[p] for p in before if p in after)
    assert shown(spark, folder)["a"] == (2, 6, 5, 2)


def test_a_refresh_run_again_takes_nothing_twice(spark, tmp_path):
    """One bucket of a broken-off refresh was written, the others weren't."""
    old, new = [(k, 1, 1, 1) for k in "abcdefghij"], [(k, 2, 2, 2) for k in "abcdefghij"]
    folder = str(tmp_path / "t")
    refresh.refreshed(folder, table(spark, old), what(), 1)
    half = table(spark, old + new).filter(F.pmod(F.xxhash64("k"), F.lit(4)) == F.pmod(F.xxhash64(F.lit("a")), F.lit(4)))
    refresh.refreshed(folder, half, what(), 2)
    refresh.refreshed(folder, table(spark, old + new), what(), 2)
    assert shown(spark, folder) == full(old + new)
