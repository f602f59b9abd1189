"""Exact similarity links inside large families of candidates, block against block.

Members of a family are dealt into blocks of bounded size; a unit of work holds two blocks. Shared shingles of all
pairs of a unit are counted by multiplying incidence matrices, and only links that join two components leave the task:
no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members, and shingles, of a block.
MEMBERS, SHINGLES = 1024, 1_000_000
COLUMNS = 4096


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all sets of ``right`` (sorted distinct values)."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    owners = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    places = []
    for values, owner in zip((a, b), owners, strict=True):
        at = np.searchsorted(shared, values)
        ok = at < len(shared)
        ok[ok] = shared[at[ok]] == values[ok]
        order = np.argsort(at[ok], kind="stable")
        places.append((at[ok][order], owner[ok][order]))
    for start in range(0, len(shared), COLUMNS):
        mats = []
        for (at, owner), n in zip(places, (len(left), len(right)), strict=True):
            lo, hi = np.searchsorted(at, [start, start + COLUMNS])
            mat = np.zeros((n, min(COLUMNS, len(shared) - start)), np.float32)
            mat[owner[lo:hi], at[lo:hi] - start] = 1
            mats.append(mat)
        out += mats[0] @ mats[1].T
    return out


def spanning(rows: np.ndarray, cols: np.ndarray, component: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links that still join two components, one after the other."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
        a, b = root(int(component[i])), root(int(component[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def units(members: DataFrame) -> DataFrame:
    """Deal ``members`` (``family``, ``rep``, ``n``, ``component``) into units: ``unit``, ``rep``, ``component``.

    Members of a family's largest component are linked already, so their blocks meet only the blocks of the others."""
    sizes = members.groupBy("family", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("family").agg(F.max(F.struct("k", (-F.col("component")).alias("c"))).alias("x")).select(F.col("family").alias("f"), (-F.col("x.c")).alias("main"))
    rows = members.join(main, F.col("family") == F.col("f")).select("family", "rep", "n", "component", (F.col("component") == F.col("main")).alias("is_main"))
    blocks = lambda main: F.ceil(F.greatest(F.count(F.when(main, 1)) / MEMBERS, F.coalesce(F.sum(F.when(main, F.col("n"))), F.lit(0)) / SHINGLES)).cast("int")
    counts = rows.groupBy(F.col("family").alias("f")).agg(blocks(F.col("is_main")).alias("mains"), blocks(~F.col("is_main")).alias("others"))
    rows = rows.join(counts, F.col("family") == F.col("f")).drop("f")
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("block", block).filter("others > 0")
    name = F.concat_ws("-", "family", F.least("block", "j"), F.greatest("block", "j"))
    among = rows.filter("not is_main").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).select(F.concat(F.lit("o"), name).alias("unit"), "rep", "component", (F.col("block") <= F.col("j")).alias("left"), (F.col("block") >= F.col("j")).alias("right"))
    across_o = rows.filter("not is_main and mains > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("mains") - 1))).select(F.concat(F.lit("m"), F.concat_ws("-", "family", "block", "j")).alias("unit"), "rep", "component", F.lit(True).alias("left"), F.lit(False).alias("right"))
    across_m = rows.filter("is_main").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).select(F.concat(F.lit("m"), F.concat_ws("-", "family", "j", "block")).alias("unit"), "rep", "component", F.lit(False).alias("left"), F.lit(True).alias("right"))
    return among.union(across_o).union(across_m)


def block_links(members: DataFrame, text: DataFrame, sets_of: Callable[[list[str]], list[np.ndarray]], percent: int) -> DataFrame:
    """Links (``u``, ``v``) with 100 * intersection >= ``percent`` * union between members of a family.

    ``text`` has ``rep`` and ``text``; of the links, enough to join the components that they join."""
    rows = units(members).join(text.withColumnRenamed("rep", "text_of"), F.col("rep") == F.col("text_of")).select("unit", "rep", "component", "left", "right", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        sets = sets_of(table.column("text").to_pylist())
        rep, component = table.column("rep").to_numpy(), table.column("component").to_numpy()
        left = np.flatnonzero(table.column("left").to_numpy(zero_copy_only=False))
        right = np.flatnonzero(table.column("right").to_numpy(zero_copy_only=False))
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            both = overlaps([sets[i] for i in left], [sets[i] for i in right])
            size = np.array([len(s) for s in sets], np.float32)
            ok = (both > 0) & (100 * both >= percent * (size[left][:, None] + size[right] - both)) & (component[left][:, None] != component[right])
            i, j = np.nonzero(ok)
            found = spanning(left[i], right[j], component)
        u = [min(int(rep[i]), int(rep[j])) for i, j in found]
        v = [max(int(rep[i]), int(rep[j])) for i, j in found]
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.groupBy("unit").applyInArrow(lambda t: pa.Table.from_batches(run(t.to_batches())), "u long, v long")
