"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

A sketch has ``SIZE`` coordinates. In round *i* below ``SIZE`` every shingle is hashed to one coordinate and offers a
value between *i* and *i* + 1; in the later rounds every shingle offers a value to coordinate *i* - ``SIZE``. The least
offer stays, rounds end when all coordinates are filled, which for large sets takes a few rounds and for any set at
most 2 ``SIZE``. Two sets of similarity 0.75 share none of ``BANDS`` bands of ``ROWS`` coordinates with a chance near
one in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_links
from .common import small_batches, stored, texts
from .components import components

WORDS = 5
BANDS, ROWS = 36, 4
SIZE = BANDS * ROWS
#: Link sets with 100 * intersection >= 75 * union.
PERCENT = 75
#: Rounds in which each bucket's members are compared with one centre.
STARS = 2
#: Members of a bucket whose pairs across components are compared one by one.
SMALL = 24

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode().lower().split()


def shingle_set(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``WORDS`` words; of all words where there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, min(len(h), WORDS), np.uint64)
    for i in range(min(len(h), WORDS)):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``SIZE`` coordinates for each set; sets must not be empty."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    out = np.full(len(sets) * SIZE, _FULL)
    for i in range(2 * SIZE):
        if not len(values):
            break
        x = mix(values + np.uint64((i + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        place = (x >> np.uint64(40)) % np.uint64(SIZE) if i < SIZE else np.full(len(x), i - SIZE, np.uint64)
        offer = (np.uint64(i) << np.uint64(48)) | (mix(x) >> np.uint64(16))
        np.minimum.at(out, owner * SIZE + place.astype(np.int64), offer)
        open_ = (out.reshape(-1, SIZE) == _FULL).any(axis=1)[owner]
        owner, values = owner[open_], values[open_]
    return out.reshape(-1, SIZE)


def band_hashes(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band of each sketch; bands differ in their start value."""
    parts = sketch.reshape(-1, BANDS, ROWS)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for i in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return out.view(np.int64)


def _features(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, a 128-bit key of the word sequence and the band hashes (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            words = [words_of(x) for x in batch.column("text").to_pylist()]
            sets = [shingle_set(w, known) for w in words]
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words), ">i8").astype(np.int64).reshape(-1, 2)
            filled = np.array([len(s) > 0 for s in sets], bool)
            bands = band_hashes(sketches([s for s in sets if len(s)]))
            offsets = np.concatenate(([0], np.cumsum(filled) * BANDS)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), lists], ["doc_id", "n_shingles", "k1", "k2", "bands"])

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def _linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (``u``, ``v``) whose whole shingle sets are similar enough."""
    text = texts(docs)
    # both sides of both joins can be split where one document is in many pairs
    with_u = pairs.join(text.select(F.col("doc_id").alias("u"), F.col("text").alias("u_text")), "u")
    with_both = with_u.join(text.select(F.col("doc_id").alias("v"), F.col("text").alias("v_text")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        last: dict[str, np.ndarray] = {}

        def of(text: str) -> np.ndarray:
            if (found := last.get(text)) is None:
                if len(last) > 256:
                    last.clear()
                found = last[text] = shingle_set(words_of(text), known)
            return found

        for batch in batches:
            keep = []
            for a, b in zip(batch.column("u_text").to_pylist(), batch.column("v_text").to_pylist(), strict=True):
                a, b = of(a), of(b)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(bool(both) and 100 * both >= PERCENT * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return with_both.select("u", "v", "u_text", "v_text").mapInArrow(run, "u long, v long")


def _sets(texts_: list[str]) -> list[np.ndarray]:
    known = _WordHashes()
    return [shingle_set(words_of(x), known) for x in texts_]


def _pairs(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Distinct pairs of a bucket's members and centres that are in different components and of similar size."""
    different = F.expr("a.bucket = b.bucket AND a.component <> b.component AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)")
    return rows.alias("a").join(centres.alias("b"), different).selectExpr("least(a.rep, b.rep) AS u", "greatest(a.rep, b.rep) AS v").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (least linked ``doc_id``), ``kept`` for every row of ``docs``.

    Rows with the same words are one class, whose least ``doc_id`` stands for it. Classes that share a band hash are
    candidates. First each bucket's most connected member is compared with its others. Then only members that are still
    in different components are compared: pair by pair in buckets of at most ``SMALL``, and block by block in families
    of larger buckets. Every comparison is on whole sets and no candidate pair across components is skipped. A
    document without words is linked with nothing and kept. Rows that share a ``doc_id`` count as one document. A null
    ``doc_id`` can't name a component: null ``component_id``, not kept. An empty table gives no rows."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = stored(_features(docs))
    usable = features.filter("doc_id is not null and n_shingles > 0")
    classes = stored(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    bands = classes.select(F.explode("bands").alias("bucket"), F.struct("rep", "n").alias("x"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    found = bands.join(shared, "bucket").select("bucket", "x.rep", "x.n", "size")
    members = stored(found)
    degrees = members.groupBy("rep").agg(F.sum("size").alias("degree")).withColumnRenamed("rep", "degree_of")

    links = None
    live = members.join(degrees, F.col("rep") == F.col("degree_of")).select("bucket", "rep", "n", "size", F.col("rep").alias("component"), F.struct((-F.col("degree")).alias("order"), "rep").alias("order"))
    for turn in range(STARS):
        centres = live.groupBy("bucket").agg(F.min(F.struct("order", "rep", "n", "component")).alias("c")).select("bucket", "c.rep", "c.n", "c.component")
        pairs = stored(_pairs(live, centres))
        links_now = _linked(pairs, docs)
        links = stored(links_now if links is None else links.union(links_now))
        groups = components(links)
        placed = members.join(groups, members["rep"] == groups["node"], "left").select("bucket", "rep", "n", "size", F.coalesce("component", "rep").alias("component"))
        split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
        live = stored(placed.join(split, "bucket").withColumn("order", F.struct(F.xxhash64("component", "rep", F.lit(turn)).alias("order"), "rep")))
    small, large = live.filter(F.col("size") <= SMALL), live.filter(F.col("size") > SMALL)
    more = _linked(stored(_pairs(small, small)), docs)
    if not large.isEmpty():
        heads = large.groupBy("bucket").agg(F.min("rep").alias("head"))
        family = components(large.join(heads, "bucket").select(F.col("rep").alias("u"), F.col("head").alias("v")))
        dealt = large.select("rep", "n", F.col("component").alias("now")).distinct().join(family, F.col("rep") == F.col("node"))
        text = texts(docs).select(F.col("doc_id").alias("rep"), "text")
        more = more.union(block_links(dealt.select(F.col("component").alias("family"), "rep", "n", F.col("now").alias("component")), text, _sets, PERCENT))
    groups = components(stored(links.union(more)))

    rows = features.select("doc_id", "n_shingles", "k1", "k2")
    out = rows.join(classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "rep"), (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), "left")
    out = out.join(groups.select("node", "component"), F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
