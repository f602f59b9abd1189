"""Token ids in patched frame-of-reference pages.

A store is a parquet folder with one row for each page; a page holds whole documents in ascending ``doc_id`` order and
is packed by :func:`pack`. Ids are cut into blocks of ``BLOCK``: the block's minimum is subtracted, the rest is packed
at the width that ``SHARE`` of its values fit into, and the others are written in full to the page's exception lists.
Block starts are indexed, so that one block can be unpacked alone. Pages of one shard follow each other; the shards'
sizes give every document its place among all ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import worker_encoder
from .common import gathered, small_batches, shared_dir, texts

BLOCK = 256
#: Share of a block's values that its width is chosen for.
SHARE = 0.98
#: Ids after which a page is closed.
PAGE = 1 << 16


def pack(ids: np.ndarray) -> bytes:
    """Blocks of ``ids`` (unsigned 32-bit). An empty array gives a page without blocks."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.resize(ids, blocks * BLOCK) if n else ids
    full[n:] = ids[-1:]
    full = full.astype(np.uint32).reshape(blocks, BLOCK)
    least = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = full - least[:, None]
    at = min(BLOCK - 1, int(BLOCK * SHARE))
    chosen = np.partition(rest, at, axis=1)[:, at] if blocks else least
    widths = np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.uint8)
    limit = (np.uint64(1) << widths.astype(np.uint64))[:, None]
    over = rest >= limit
    where = np.flatnonzero(over).astype(np.uint32)
    values = rest[over]
    rest[over] = 0
    sizes = widths.astype(np.int64) * (BLOCK // 8)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if blocks else sizes
    payload = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        if w:
            kind = np.uint16 if w <= 16 else np.uint32
            bits = ((rest[rows].astype(kind)[:, :, None] >> np.arange(w, dtype=kind)) & kind(1)).astype(np.uint8)
            packed = np.packbits(bits.reshape(len(rows), -1), axis=1)
            payload[(starts[rows][:, None] + np.arange(packed.shape[1])).ravel()] = packed.ravel()
    head = struct.pack("<III", n, blocks, len(where))
    return b"".join((head, least.astype("<u4").tobytes(), widths.tobytes(), starts.astype("<u4").tobytes(), where.astype("<u4").tobytes(), values.astype("<u4").tobytes(), payload.tobytes()))


def unpack(page: bytes) -> np.ndarray:
    """The ids that :func:`pack` was given."""
    n, blocks, outliers = struct.unpack_from("<III", page)
    at = 12

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(page, kind, count, at)
        at += out.nbytes
        return out

    least, widths, starts = take("<u4", blocks), take("u1", blocks), take("<u4", blocks)
    where, values = take("<u4", outliers), take("<u4", outliers)
    payload = np.frombuffer(page, "u1", offset=at)
    rest = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        if w:
            packed = payload[starts[rows][:, None].astype(np.int64) + np.arange(int(w) * (BLOCK // 8))]
            whole = 16 if w <= 16 else 32
            bits = np.zeros((len(rows), BLOCK, whole), np.uint8)
            bits[:, :, :w] = np.unpackbits(packed, axis=1).reshape(len(rows), BLOCK, w)
            rest[rows] = np.packbits(bits, axis=2, bitorder="little").view(f"<u{whole // 8}")[:, :, 0]
    flat = rest.ravel()
    flat[where] = values
    return (flat.reshape(blocks, BLOCK) + least[:, None]).ravel()[:n]


def unpack_block(page: bytes, block: int) -> np.ndarray:
    """The ids of one block of a page; only its own bytes and exceptions are read."""
    n, blocks, outliers = struct.unpack_from("<III", page)
    if not 0 <= block < blocks:
        raise IndexError(f"the page has {blocks} blocks")
    widths_at = 12 + 4 * blocks
    starts_at = widths_at + blocks
    where = np.frombuffer(page, "<u4", outliers, starts_at + 4 * blocks)
    lo, hi = np.searchsorted(where, [block * BLOCK, (block + 1) * BLOCK])
    values = np.frombuffer(page, "<u4", hi - lo, starts_at + 4 * blocks + 4 * (outliers + int(lo)))
    (least,) = struct.unpack_from("<I", page, 12 + 4 * block)
    (start,) = struct.unpack_from("<I", page, starts_at + 4 * block)
    width = page[widths_at + block]
    packed = np.frombuffer(page, "u1", width * (BLOCK // 8), starts_at + 4 * blocks + 8 * outliers + start)
    bits = np.unpackbits(packed).reshape(BLOCK, width).astype(np.uint32) if width else np.zeros((BLOCK, 0), np.uint32)
    rest = (bits << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
    rest[where[lo:hi] - block * BLOCK] = values
    return (rest + np.uint32(least))[: max(0, n - block * BLOCK)]


#: Shards whose places may be broadcast (16 bytes each).
BROADCAST_SHARDS = 1_000_000

PAGES = "shard int, before long, doc_ids binary, lengths binary, ids binary, n_ids long"


def write_store(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2) -> None:
    """Encode each row's whole text (null: empty), add ``end_id`` and write the pages to ``path``.

    Rows are dealt by ranges of ``doc_id`` before they are encoded, so the text moves once and the ids not at all.
    Rows with the same ``doc_id`` are all written, in the order of their texts' hashes; a null ``doc_id`` comes first.
    Spark commits the files, so a lost task leaves nothing behind. ``doc_id`` must be an integer."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(spec.value)
        shard, before = TaskContext.get().partitionId(), 0
        names, parts, held = [], [], 0

        def page() -> pa.RecordBatch:
            nonlocal before
            ids = np.frombuffer(b"".join(parts), "<u4")
            known = np.array([x is not None for x in names])
            who = np.array([0 if x is None else x for x in names], "<i8")
            row = [[shard], [before], [known.tobytes() + who.tobytes()], [np.array([len(x) // 4 for x in parts], "<u4").tobytes()], [pack(ids)], [len(ids)]]
            before += len(ids)
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["shard", "before", "doc_ids", "lengths", "ids", "n_ids"])

        for batch in gathered(batches, 16 << 20):
            pa.default_memory_pool().release_unused()
            for who, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                names.append(who)
                parts.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= PAGE:
                    yield page()
                    names, parts, held = [], [], 0
        if names:
            yield page()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(run, PAGES).write.parquet(path)


def read_store(spark, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids before the document), ``n_tokens`` and ``ids`` (little-endian) of each document."""
    pages = spark.read.schema(PAGES).parquet(path)
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each shard (a partition of the writer), however much it holds; pages know their place in the shard
    bases = pages.groupBy("shard").agg(F.sum("n_ids").alias("held")).select(F.col("shard").alias("base_shard"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    if bases.count() <= BROADCAST_SHARDS:
        bases = F.broadcast(bases)
    placed = pages.join(bases, F.col("shard") == F.col("base_shard")).select((F.col("base") + F.col("before")).alias("start"), "doc_ids", "lengths", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, who, lengths, page in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids, lengths = unpack(page), np.frombuffer(lengths, "<u4").astype(np.int64)
                known = np.frombuffer(who, "?", len(lengths))
                names = [x if k else None for x, k in zip(np.frombuffer(who, "<i8", len(lengths), len(lengths)).tolist(), known, strict=True)]
                ends = np.cumsum(lengths)
                cut = [ids[b - n : b].tobytes() for b, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(cut, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def crc(ids: DataFrame) -> DataFrame:
    """``ids`` replaced by ``ids_crc32``."""
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to a fresh store in the shared folder and return what is read back."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    write_store(docs, tokenizer_path, path, end_id)
    return read_store(spark, path)
