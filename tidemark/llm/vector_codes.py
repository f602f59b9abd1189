"""Vector codes: product quantisation whose entries are found by exponion search in exact integers.

A vector's part starts at the entry it had in the round before. An entry at squared distance ``d`` from the part can be
beaten or tied only by entries within twice that distance of it, that is ``4 d`` in squares, by the triangle inequality.
Each entry's neighbours are sorted by their distance from it, so only the head of that list is scanned."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, join_keys, removed, stored, written

#: Components are multiplied by it and floored.
SCALE = 4096
#: Integer components at or beyond this magnitude don't fit the stored form.
WIDE = 1 << 62


@dataclass(frozen=True)
class Codebooks:
    """Integer entries, by part, entry and position within the part."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]

    def digest(self) -> str:
        """Hexadecimal sha256 of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()

    def largest(self) -> int:
        """The largest magnitude of a component."""
        return max((abs(x) for part in self.entries for entry in part for x in entry), default=0)

    def decoded(self, code: str) -> list[float]:
        """The vector that a code stands for."""
        return [x / SCALE for part, k in zip(self.entries, bytes.fromhex(code), strict=True) for x in part[k]]

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Entries replaced by the floored means of their parts, given ``(part, entry) -> (count, sums)``; unused ones stay."""
        return Codebooks(tuple(tuple(tuple(s // sums[p, k][0] for s in sums[p, k][1]) if (p, k) in sums else old for k, old in enumerate(part)) for p, part in enumerate(self.entries)))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` and ``b``."""
    gap = a - b
    return (gap * gap).sum(axis=-1) if gap.dtype == object else np.einsum("...i,...i->...", gap, gap)


def exponion(rows: np.ndarray, entries: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row (ties: the lower index), its squared distance, and how many distances were taken.

    ``last`` holds the entries at which the search starts."""
    best, least, taken = last.copy(), squares(rows, entries[last]), len(rows)
    for k in range(len(entries)):
        mine = np.flatnonzero(last == k)
        if not len(mine):
            continue
        apart = squares(entries, entries[k])
        order = np.argsort(apart, kind="stable")
        order = order[order != k]
        reach = np.searchsorted(apart[order], 4 * least[mine], side="right")
        mine = mine[np.argsort(-reach, kind="stable")]  # those that scan far come first
        scanning = len(mine) - np.cumsum(np.bincount(reach, minlength=len(entries)))  # rows that scan more than m entries
        for j, n in zip(order.tolist(), scanning.tolist(), strict=False):
            if not n:
                break
            some = mine[:n]
            taken += n
            found = squares(rows[some], entries[j])
            better = (found < least[some]) | ((found == least[some]) & (j < best[some]))
            best[some[better]], least[some[better]] = j, found[better]
    return best, least, taken


def _assigned(rows: DataFrame, books: Codebooks, final: bool) -> DataFrame:
    """Rows with their nearest entries, each task's partial sums behind them; or, in the end, codes and errors.

    ``rows`` has ``vec_id``, ``label``, ``ints`` and ``at`` (an entry a part, null: none yet)."""
    shared = rows.sparkSession.sparkContext.broadcast(books)  # as large as the parameters say, whatever the data
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    parts = len(books.entries)
    width = len(books.entries[0][0])
    head = f"vec_id {kinds['vec_id']}, label {kinds['label']}, "
    schema = head + ("code string, error long" if final else "ints array<long>, at binary, part int, entry int, n long, sums array<decimal(38,0)>")
    sum_type = pa.list_(pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        totals: dict[tuple[int, int], tuple[int, list[int]]] = {}
        names = types = None
        for batch in gathered(batches):
            n = batch.num_rows
            whole = batch.column("ints").flatten().to_numpy(zero_copy_only=False).reshape(n, parts * width)
            largest = max(books.largest(), abs(int(whole.max())), abs(int(whole.min()))) if n else 0
            kind = np.int64 if largest <= isqrt(WIDE // (16 * parts * width)) else object  # else Python's integers
            whole = whole.astype(kind, copy=False)
            last = [bytes(parts) if x is None else x for x in batch.column("at").to_pylist()]
            last = np.frombuffer(b"".join(last), np.uint8).reshape(n, parts).astype(np.int64)
            found, error = np.empty((n, parts), np.uint8), np.zeros(n, kind)
            for p, part in enumerate(books.entries):
                mine = np.ascontiguousarray(whole[:, p * width : (p + 1) * width])
                best, least, _ = exponion(mine, np.array(part, kind), last[:, p])
                found[:, p] = best
                error += least
                if not final:
                    for k, count in enumerate(np.bincount(best, minlength=len(part)).tolist()):
                        if count:
                            old = totals.get((p, k), (0, [0] * width))
                            totals[p, k] = old[0] + count, [a + int(b) for a, b in zip(old[1], mine[best == k].sum(axis=0), strict=True)]
            codes = [x.tobytes() for x in found]
            if final:
                errors = pa.array([x if x < 1 << 63 else None for x in error.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([x.hex() for x in codes], pa.string()), errors], ["vec_id", "label", "code", "error"])
                continue
            columns = [batch.column("vec_id"), batch.column("label"), batch.column("ints"), pa.array(codes, pa.binary())]
            nothing = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), sum_type)]
            names = ["vec_id", "label", "ints", "at", "part", "entry", "n", "sums"]
            types = [x.type for x in columns]
            yield pa.RecordBatch.from_arrays([*columns, *nothing], names)
        if totals:
            keys = list(totals)
            sums = pa.array([[Decimal(x) for x in totals[k][1]] for k in keys], sum_type)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(keys), t) for t in types), pa.array([p for p, _ in keys], pa.int32()), pa.array([k for _, k in keys], pa.int32()), pa.array([totals[k][0] for k in keys], pa.int64()), sums], names)

    return rows.select("vec_id", "label", "ints", "at").mapInArrow(run, schema)


def kept(vectors: DataFrame, column: str, parts: int) -> DataFrame:
    """``vec_id``, ``label`` and ``ints`` of the usable rows, all as long as most of those are."""
    x = F.col(column)
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double") * SCALE) < float(WIDE)))
    rows = vectors.filter(fine & (F.size(x) > 0) & (F.size(x) % parts == 0))
    rows = rows.select("vec_id", "label", F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("ints"))
    usual = rows.groupBy(F.size("ints").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.filter(F.size("ints") == (usual["size"] if usual else 0))


def trained(vectors: DataFrame, column: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[Codebooks | None, DataFrame]:
    """Codebooks, and ``vec_id``, ``label``, ``code`` (two hexadecimal digits a part) and ``error`` of all usable rows.

    ``entries`` is at most 256. Rows are left out if the vector is null or empty, holds null, NaN or infinite components
    or any that reach 2^62 when scaled, or hasn't the length that most others have among those that ``parts`` divides.
    Codebooks start as the parts of the rows with the least ``vec_id`` (nulls last; rows that share an id by their
    components), fewer than ``entries`` if there are fewer rows; with no rows at all there are none (``None``). An error
    beyond 64 bits is null. Repeated rows count each. Vectors never move between tasks: a round rewrites each row with
    its entries and adds one partial sum a task and entry, of which Spark makes parts x entries sums; the folder of the
    round before is deleted once the next one is written."""
    if not 0 < entries <= 256:
        raise ValueError("an entry must fit two hexadecimal digits")
    spark = vectors.sparkSession
    rows = kept(vectors, column, parts).withColumn("at", F.lit(None).cast("binary"))
    first = [r["ints"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()]
    if not first:
        return None, rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    width = len(first[0]) // parts
    books = Codebooks(tuple(tuple(tuple(x[p * width : (p + 1) * width]) for x in first) for p in range(parts)))
    path = None
    for _ in range(rounds):
        done = _assigned(rows, books, False)
        before, path = path, written(done)
        if before:
            removed(spark, before)
        table = spark.read.schema(done.schema).parquet(path)
        rows = table.filter(F.col("part").isNull())
        each = table.filter(F.col("part").isNotNull()).select("part", "entry", "n", F.posexplode("sums").alias("place", "x"))
        sums: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for r in each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():  # parts x entries x width rows
            sums.setdefault((r["part"], r["entry"]), (r["n"], [0] * width))[1][r["place"]] = int(r["x"])
        books = books.moved(sums)
    coded = stored(_assigned(rows, books, True))
    if path:
        removed(spark, path)
    return books, coded


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the sum of ``error`` over rows of an equal label (null labels are equal; null if
    it passes 64 bits). Labels are counted before any row moves; rows of frequent labels meet them by broadcast."""
    key = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    rows = coded.withColumn("__td_label", key)
    sums = stored(rows.groupBy("__td_label").agg(F.count("*").alias("n"), F.try_sum("error").alias("label_error")))
    return join_keys(rows, sums, ["__td_label"]).select(*coded.columns, "label_error")


def coded(vectors: DataFrame, column: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of all usable rows (see ``trained``)."""
    books, rows = trained(vectors, column, parts, entries, rounds)
    return with_label_errors(rows).select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))
