"""Substring dedup: units of text that stand earlier in the corpus.

Units are hashed: whole lines of ``MIN_WORDS`` words or more, and stretches of ``MIN_WORDS`` words that begin at places
which the words themselves choose, so that a passage pasted into other text has the same units there. Units are compared
without regard to case and white space. Of each the earliest occurrence, by ``doc_id`` and place, is kept; the others are
removed, with their offsets in the original text. A repeated line of ``MIN_WORDS`` words goes whole. A repeated passage
of at least ``MIN_WORDS + SPREAD - 1`` words inside other text goes but for at most ``SPREAD - 1`` words at each end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import gathered, join_keys, small_batches, stored, texts

#: Words of the shortest passage that is removed; stock lines of a few words stay.
MIN_WORDS = 25
#: A unit begins at the least hash of ``SHORT`` words among ``SPREAD`` neighbouring ones.
SHORT, SPREAD = 8, 9
SPACE = re.compile(r"(\s+)")
BASE = np.uint64(0x9E3779B97F4A7C15)


class Codes(dict):
    """64-bit hashes of words in lower case, kept while there are not too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word.lower())
        return code


def windows(code: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each ``size`` neighbouring codes."""
    n = max(0, len(code) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= BASE
        out += code[k : k + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def _slide(x: np.ndarray, size: int, least) -> np.ndarray:
    """``least`` (minimum or maximum) of each ``size`` neighbours."""
    span = 1
    while span * 2 <= size:
        x = least(x[:-span], x[span:])
        span *= 2
    return least(x[: len(x) - (size - span)], x[size - span :]) if size > span else x


def places(code: np.ndarray) -> np.ndarray:
    """Where units begin: the least hash of ``SHORT`` words among each ``SPREAD`` neighbouring ones, ties included.

    The choice depends on the words of each ``SPREAD + SHORT - 1`` alone, so copies of a passage share its places."""
    if len(code) < SPREAD + SHORT - 1:
        return np.empty(0, np.int64)
    hashed = windows(code, SHORT)
    edge = np.zeros(SPREAD - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([edge, _slide(hashed, SPREAD, np.minimum), edge]), SPREAD, np.maximum) == hashed)


def units(text: str, codes: Codes, min_words: int = MIN_WORDS) -> list[tuple[bytes, int, int]]:
    """The digest, start and end of every unit of a text: lines, and stretches that begin at chosen places."""
    pieces = SPACE.split(text)  # words and the white space between them in turn
    words, gaps = pieces[::2], pieces[1::2]
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = (np.cumsum(lengths) - lengths)[::2]
    ends = starts + lengths[::2]
    at, until = int(not words[0]), len(words) - int(not words[-1])  # white space at either end
    if until - at < min_words:
        return []
    code = np.fromiter(map(codes.__getitem__, words[at:until]), np.uint64, until - at)
    breaks = [0, *(i + 1 - at for i in range(at, until - 1) if "\n" in gaps[i]), until - at]
    found = {(a, b) for a, b in zip(breaks[:-1], breaks[1:], strict=True) if b - a >= min_words}
    found |= {(a, a + min_words) for a in places(code).tolist() if a + min_words <= len(code)}
    raw = memoryview(code.tobytes())
    return [(xxhash.xxh3_128_digest(raw[8 * a : 8 * b]), int(starts[at + a]), int(ends[at + b - 1])) for a, b in sorted(found)]


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``rid`` (hash of the text) and ``runs`` (non-empty, in order) for texts that lose something.

    A unit goes if its digest (96 bits) has an earlier occurrence, by ``doc_id`` and place; one in the same text that
    overlaps it doesn't count. Units that touch or overlap make one run. Offsets are code points of the original text.
    Null and empty texts have no words. Rows with equal ``doc_id`` and text are one document; a null ``doc_id`` ranks
    first. Digests are counted in each task before they are shuffled, and those in many documents are joined back
    without a shuffle, so no task gathers the rows of a frequent passage."""
    small_batches(docs.sparkSession)
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts(docs).withColumn("rid", F.hash("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in gathered(batches):
            found = [units(text, codes, min_words) for text in batch.column("text").to_pylist()]
            bounds = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            flat = [x for unit in found for x in unit]
            whole = np.frombuffer(b"".join(x[0] for x in flat), ">i8").astype(np.int64).reshape(-1, 2)
            columns = (pa.array(whole[:, 0].copy()), pa.array((whole[:, 1] >> 32).astype(np.int32)), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.int32()))
            lists = [pa.ListArray.from_arrays(bounds, x) for x in columns]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), *lists], ["doc_id", "rid", "h1", "h2", "start", "end"])

    marks = stored(rows.mapInArrow(digests, f"doc_id {id_kind}, rid int, h1 array<long>, h2 array<int>, start array<int>, end array<int>").filter(F.size("h1") > 0))
    exploded = marks.select("doc_id", "rid", F.explode(F.arrays_zip("h1", "h2", "start", "end")).alias("x"))
    # packed, as these rows are shuffled: the text and the digest's second half, the start and the end
    two = lambda high, low: F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    placed = exploded.select(F.col("x.h1").alias("h1"), two(F.col("x.h2"), F.col("rid")).alias("h2"), "doc_id", two(F.col("x.start"), F.col("x.end")).alias("place"))
    often = stored(exploded.groupBy(F.col("x.h1").alias("h1")).agg(F.count("*").alias("n")).filter("n > 1"))
    again = stored(join_keys(placed, often, ["h1"]).select("h1", F.shiftright("h2", 32).cast("int").alias("h2"), "doc_id", F.shiftright(F.shiftleft("h2", 32), 32).cast("int").alias("rid"), "place"))
    first = stored(again.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "rid", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("rid") == F.col("first.rid"))
    later = join_keys(again, first, ["h1", "h2"]).filter(~own | (F.shiftright("place", 32) >= F.col("first.place").bitwiseAND(F.lit(0xFFFFFFFF))))
    later = later.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("place", F.col("first.doc_id").alias("first_doc"))).alias("later"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n_units", pa.int32()), ("first_doc", batch_kind)]))
        for batch in batches:
            out = []
            for later in batch.column("later").to_pylist():
                found: list[dict] = []
                for x in sorted(later, key=lambda x: x["place"]):
                    start, end = x["place"] >> 32, x["place"] & 0xFFFFFFFF
                    if found and start <= found[-1]["end"] + 1:
                        found[-1] |= {"end": max(end, found[-1]["end"]), "n_units": found[-1]["n_units"] + 1}
                    else:
                        found.append({"start": start, "end": end, "n_units": 1, "first_doc": x["first_doc"]})
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(out, kind)], ["doc_id", "rid", "runs"])

    batch_kind = to_arrow_type(docs.schema["doc_id"].dataType)
    return later.mapInArrow(runs, f"doc_id {id_kind}, rid int, runs array<struct<start: int, end: int, n_units: int, first_doc: {id_kind}>>")


def removed(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each removed run: ``doc_id``, its ``start``, ``end``, ``n_units`` (its repeated units), and
    ``first_doc``, the document that keeps the first of them."""
    return repeated_runs(docs, min_words).select("doc_id", F.explode("runs").alias("x")).select("doc_id", "x.*")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``text`` with its runs cut out, ``runs`` (empty if none) for every row."""
    small_batches(docs.sparkSession)
    found = repeated_runs(docs, min_words).select(F.col("doc_id").alias("d"), F.col("rid").alias("r"), "runs")
    rows = texts(docs).withColumn("rid", F.hash("text"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rid") == F.col("r")), "left").select("doc_id", "text", "runs")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, x["start"] - a["at"])).alias("out"), x["end"].alias("at"))
    cut = F.aggregate("runs", start, step, lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1)))
    return joined.select("doc_id", F.coalesce(cut, F.col("text")).alias("text"), F.coalesce("runs", F.array()).alias("runs"))
