"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words and their five-letter beginnings, hashed. Beside a weight, each term has a
vector of ``FACTORS`` numbers; the products of two terms' vectors weigh the pair, so that words which are harmful only
together count. Training keeps the terms whose rates differ between the labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .langid import letters, remainder

BUCKETS = 1 << 20
PREFIX = 5
FACTORS = 4
#: Labelled documents that training sees at most (those least by a hash of ``doc_id``).
SAMPLE = 12_000
#: Least documents with a term, and least difference of its rates in standard errors, for a term to be kept.
LEAST, ERRORS = 4, 4.0
#: Pairs are looked for among so many terms, those in most documents; least documents with both, and least difference
#: in standard errors (there are some two million pairs).
PAIR_TERMS, PAIR_LEAST, PAIR_ERRORS = 2048, 16, 6.0
STEPS, RATE, DECAY = 300, 0.05, 1e-4


def terms(word: str) -> tuple[int, ...]:
    """Hashed terms of one word; none without letters."""
    w = letters(word)
    if not w:
        return ()
    whole = xxhash.xxh3_64_intdigest(w) % BUCKETS
    return (whole,) if len(w) <= PREFIX else (whole, xxhash.xxh3_64_intdigest("^" + w[:PREFIX]) % BUCKETS)


class _Terms(dict):
    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = terms(word)
        return value


class Machine:
    """``place`` maps a bucket to its row of ``weights`` and ``factors``, or to -1."""

    def __init__(self, kept: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.kept, self.bias, self.weights, self.factors = kept, bias, weights, factors

    def place(self) -> np.ndarray:
        out = np.full(BUCKETS, -1, np.int32)
        out[self.kept] = np.arange(len(self.kept))
        return out

    def raw(self, at: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """The machine's value for ``n`` documents; ``at`` and ``doc`` pair rows of terms with documents."""
        out = np.full(n, self.bias) + np.bincount(doc, self.weights[at], n)
        for k in range(self.factors.shape[1]):
            v = self.factors[at, k]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out


def probability(x: np.ndarray) -> np.ndarray:
    """Logistic function without overflow."""
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def paired(flat: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The terms of pairs whose rate of ones differs from what the terms' own rates, added as log odds, lead to."""
    every = np.bincount(flat, minlength=BUCKETS)
    common = np.sort(np.argsort(-every, kind="stable")[:PAIR_TERMS])
    common = common[every[common] >= PAIR_LEAST]
    place = np.full(BUCKETS, -1, np.int64)
    place[common] = np.arange(len(common))
    has = np.zeros((len(labels), len(common)), np.float32)
    at = place[flat]
    has[doc[at >= 0], at[at >= 0]] = 1
    both, ones = has.T @ has, (has * labels[:, None].astype(np.float32)).T @ has
    odds = lambda one, n: np.log((one + 0.5) / (n - one + 0.5))
    alone = odds(np.diag(ones).astype(float), np.diag(both).astype(float))
    due = probability(alone[:, None] + alone[None, :] - odds(labels.sum(), len(labels)))
    error = np.sqrt(due * (1 - due) / np.maximum(both, 1))
    odd = (both >= PAIR_LEAST) & (np.abs(ones / np.maximum(both, 1) - due) >= PAIR_ERRORS * error)
    # a term that comes only with the other one tells nothing more
    odd &= both <= 0.9 * np.minimum(np.diag(both)[:, None], np.diag(both)[None, :])
    return common[odd.any(axis=1)]


def train(found: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Fit on the term sets of documents and their 0/1 labels; without both labels, a constant."""
    n, ones = len(labels), float(labels.sum())
    if not n or ones in (0.0, float(n)):
        return Machine(np.zeros(0, np.int64), 0.0 if not n else (-2.0 if not ones else 2.0), np.zeros(0), np.zeros((0, FACTORS)))
    doc = np.repeat(np.arange(n), [len(x) for x in found])
    flat = np.concatenate(found).astype(np.int64)
    one, every = np.bincount(flat, labels[doc], BUCKETS), np.bincount(flat, minlength=BUCKETS).astype(float)
    base = ones / n
    error = np.sqrt(base * (1 - base) / np.maximum(every, 1))
    kept = np.flatnonzero((every >= LEAST) & (np.abs(one / np.maximum(every, 1) - base) >= ERRORS * error))
    kept = np.union1d(kept, paired(flat, doc, labels))
    place = np.full(BUCKETS, -1, np.int64)
    place[kept] = np.arange(len(kept))
    at = place[flat]
    at, doc = at[at >= 0], doc[at >= 0]
    rng = np.random.default_rng(9)
    machine = Machine(kept, float(np.log(ones / (n - ones))), np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), FACTORS)))
    moments = [[np.zeros(s), np.zeros(s)] for s in ((1,), (len(kept),), (len(kept), FACTORS))]
    for step in range(1, STEPS + 1):
        miss = (probability(machine.raw(at, doc, n)) - labels) / n
        of = miss[doc]
        slope = np.empty_like(machine.factors)
        for k in range(FACTORS):
            v = machine.factors[at, k]
            slope[:, k] = np.bincount(at, of * (np.bincount(doc, v, n)[doc] - v), len(kept))
        slopes = (np.array([miss.sum()]), np.bincount(at, of, len(kept)) + DECAY * machine.weights, slope + DECAY * machine.factors)
        moves = []
        for (m, s), g in zip(moments, slopes, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            moves.append(RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8))
        machine.bias -= float(moves[0][0])
        machine.weights -= moves[1]
        machine.factors -= moves[2]
    return machine


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """Train on at most ``SAMPLE`` labelled documents; null labels don't count, of repeated ids one row does.

    The sample is drawn from the labels alone, so that texts don't move; its ids are broadcast (at most ``SAMPLE``), and
    only hashed terms of that many documents reach the driver."""
    marks = labels.filter("toxic is not null and doc_id is not null").select(F.xxhash64("doc_id").alias("order"), F.col("doc_id").alias("label_of"), F.col("toxic").cast("int").alias("toxic"))
    drawn = marks.orderBy("order", "label_of", "toxic").limit(SAMPLE).select("label_of", "toxic")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("label_of")).select("label_of", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms()
        for batch in batches:
            sets = [sorted({t for w in set(x.split()) for t in known[w]}) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label_of"), batch.column("toxic"), pa.array(sets, pa.list_(pa.int32()))], ["label_of", "toxic", "terms"])

    kind = labels.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"label_of {kind}, toxic int, terms array<int>").groupBy("label_of").agg(F.min(F.struct("toxic", "terms")).alias("x"))
    got = found.select("label_of", "x.toxic", "x.terms").toArrow().sort_by("label_of")
    sets = [x.values.to_numpy(zero_copy_only=False) for x in got.column("terms")]
    return train(sets, (got.column("toxic").to_numpy() > 0).astype(float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id``, ``score`` for each row's whole text; null and empty texts have no terms and get the base rate."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        place = machine.place()

        class Kept(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                if len(self) > 300_000:
                    self.clear()
                value = self[word] = tuple(int(p) for t in terms(word) if (p := place[t]) >= 0)
                return value

        known = Kept()
        for batch in batches:
            sets = [{t for x in map(known.__getitem__, (text or "").split()) if x for t in x} for text in batch.column("text").to_pylist()]
            doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            at = np.array([t for s in sets for t in sorted(s)], np.int64)
            value = probability(machine.raw(at, doc, len(sets)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def scored(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5) -> DataFrame:
    """Fit on the labelled rows outside fold ``held_out``, score every row; adds ``held_out`` and ``predicted``."""
    fold = F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False))
    small_batches(docs.sparkSession)
    out = score(docs, fit(docs, labels.filter(~fold)))
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
