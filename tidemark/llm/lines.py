"""Line dedup: explode normalised lines, hash, count documents for each hash, drop common lines, reassemble."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_keys, small_batches, stored

#: White space that a key loses at both ends: fixed value.
WHITE = b" \t\n\x0b\x0c\r"


def keys_of(text: str) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text as they are, and their keys: stripped, with A-Z in lower case."""
    lines = text.encode().split(b"\n")
    return lines, [x.strip(WHITE).lower() for x in lines]


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` cut to the lines that are not common, and ``n_lines``, ``n_dropped`` added.

    A line is common if its key has at least ``min_chars`` code points and stands in at least ``min_docs`` rows of
    ``docs``; all its copies go from every row. Each row counts as a document of its own, also when rows repeat or
    ``doc_id`` is null. A null or empty text is one empty line and comes back empty. Further columns pass through;
    names that begin with ``__td_`` are reserved. Only hashes (128 bits) and counts are shuffled for counting, after a
    partial count in each task, so a line in a third of all rows costs one row a task; frequent hashes then meet their
    rows without a shuffle (``join_keys``). Texts move once, to meet their own dropped hashes."""
    small_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped")
    rows = docs.withColumn("__td_rid", F.xxhash64(F.coalesce("text", F.lit(""))))
    id_type = docs.schema["doc_id"].dataType

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            found: list[bytes] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                digests = {xxhash.xxh3_128_digest(k) for k in keys_of(text or "")[1] if len(k) >= min_chars and (min_chars < 2 or len(k.decode()) >= min_chars)}
                at += [i] * len(digests)
                found += digests
            pair = np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("__td_rid").take(at), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["doc_id", "rid", "h1", "h2"])

    hashes = stored(rows.select("doc_id", "__td_rid", "text").mapInArrow(explode, f"doc_id {id_type.simpleString()}, rid long, h1 long, h2 long"))
    common = stored(hashes.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs))
    dropped = join_keys(hashes, common, ["h1", "h2"]).groupBy(F.col("doc_id").alias("__td_doc"), F.col("rid").alias("__td_of")).agg(F.collect_set(F.struct("h1", "h2")).alias("__td_set"))
    matched = rows.join(dropped, rows["doc_id"].eqNullSafe(F.col("__td_doc")) & (F.col("__td_rid") == F.col("__td_of")), "left")
    matched = matched.select(*docs.columns, F.col("__td_set.h1").alias("__td_h1"), F.col("__td_set.h2").alias("__td_h2"))
    names = docs.columns

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, h1, h2 in zip(batch.column("text").to_pylist(), batch.column("__td_h1").to_pylist(), batch.column("__td_h2").to_pylist(), strict=True):
                lines, keys = keys_of(text or "")
                left = lines
                if h1:
                    raw = np.array([h1, h2], ">i8").T.tobytes()
                    gone = {raw[i : i + 16] for i in range(0, len(raw), 16)}
                    left = [x for x, k in zip(lines, keys, strict=True) if not k or xxhash.xxh3_128_digest(k) not in gone]
                kept.append(b"\n".join(left).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            columns = [pa.array(kept, pa.string()) if name == "text" else batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    fields = [T.StructField(f.name, f.dataType) for f in docs.schema.fields]
    return matched.mapInArrow(reassemble, T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
