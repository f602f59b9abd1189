"""Language identification as inference of a multilingual mixture.

Each language has a distribution of character n-grams. A document's words are drawn from an unknown mixture of
languages; expectation-maximisation estimates the proportions from the words' n-gram likelihoods. Languages join the
set one by one while the likelihood gains more than ``PENALTY`` times the logarithm of the number of words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, small_batches

#: n-gram lengths and the number of hashed n-grams.
SIZES, BUCKETS = (1, 2, 3), 1 << 17
SMOOTH = 0.5
PENALTY = 2.0
#: Documents of each language (about so many, chosen by a hash of ``doc_id``) that the n-grams are counted over.
SAMPLE = 3000
#: A word's likelihood counts as this much of its n-grams', which overlap.
TEMPER = 0.5
UNDEFINED = "und"


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, by ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' letters in lower case, in order: for each, its word's place and its three n-grams (hashed).

    An n-gram is a letter, with the one before it, and with the ones on both sides; a mark stands at words' ends. Words
    must not hold white space; other characters than letters don't count."""
    mark = 10
    points = np.frombuffer("\n".join(words).lower().encode("utf-32-le"), "<u4")
    points = points[_is_letter()[points] | (points == mark)]
    x = np.concatenate(([mark], points, [mark])).astype(np.uint64)
    at = np.flatnonzero(x != mark)
    word = np.cumsum(x == mark)[at] - 1
    out = np.empty((len(SIZES), len(at)), np.int32)
    left, here, right = x[at - 1], x[at], x[at + 1]
    for i, parts in enumerate(((here,), (left, here), (left, here, right))):
        h = np.full(len(at), i + 1, np.uint64)
        for part in parts:
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ part
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xD6E8FEB86659FD93)
        out[i] = (h >> np.uint64(40)) % np.uint64(BUCKETS)
    return word, out


def letters(word: str) -> str:
    """The letters of a word, in lower case."""
    return word.lower() if word.isalpha() else "".join(c for c in word if c.isalpha()).lower()


class Model:
    """Log likelihoods of n-grams: a row for each bucket, a column for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, n_docs: int = 0):
        self.languages, self.n_docs = languages, n_docs
        self.logs = (np.log(counts + SMOOTH) - np.log(counts.sum(axis=0) + SMOOTH * BUCKETS)).astype(np.float32)
        #: Mean log likelihood of an n-gram of each language in its own text, each n-gram left out of the counts in turn.
        total = counts.sum(axis=0)
        self.usual = (counts * np.log(np.maximum(counts - 1, 0) + SMOOTH)).sum(axis=0) / np.maximum(total, 1) - np.log(np.maximum(total - 1, 0) + SMOOTH * BUCKETS)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods of words in each language, NaN for words without letters; and the words' letters."""
        at, found = grams(words)
        out = np.empty((len(words), len(self.languages)), np.float32)
        for i in range(len(self.languages)):
            column = self.logs[:, i]
            out[:, i] = TEMPER * np.bincount(at, column[found[0]] + column[found[1]] + column[found[2]], len(words))
        n = np.bincount(at, minlength=len(words))
        out[n == 0] = np.nan
        return out, n


def mixture(logs: np.ndarray, start: np.ndarray | None = None, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``logs`` (words by languages) and the log likelihood at them."""
    top = logs.max(axis=1, keepdims=True)
    like = np.exp(logs - top)
    share = np.full(logs.shape[1], 1 / logs.shape[1]) if start is None else start
    for _ in range(rounds):
        part = like * share
        part /= part.sum(axis=1, keepdims=True)
        new = part.mean(axis=0)
        if np.abs(new - share).max() < 1e-3:
            share = new
            break
        share = new
    return share, float(np.log(like @ share).sum() + top.sum())


def infer(logs: np.ndarray) -> np.ndarray:
    """The proportion of each language (0 outside the chosen set) for a document's words."""
    n, size = logs.shape
    single = logs.sum(axis=0, dtype=np.float64)
    chosen, best = [int(single.argmax())], float(single.max())
    share = np.ones(1)
    cost = PENALTY * np.log(max(n, 2))
    bound = float(logs.max(axis=1).sum(dtype=np.float64))
    while len(chosen) < size and bound - best > cost:
        gains = [(np.maximum(logs[:, i], logs[:, chosen].max(axis=1)).sum(dtype=np.float64), -i) for i in range(size) if i not in chosen]
        reach, i = max(gains)
        if reach - best <= cost:
            break
        new, value = mixture(logs[:, [*chosen, -i]])
        if value - best <= cost:
            break
        chosen.append(-i)
        share, best = new, value
    out = np.zeros(size)
    out[chosen] = share
    return out


def fit(labelled: DataFrame) -> Model:
    """Count n-grams over about ``SAMPLE`` documents of each value of ``lang``; null texts and languages don't count.

    Each task counts its words, then the n-grams of its distinct words; counts are summed by language and n-gram, so
    at most ``BUCKETS`` rows a language reach the driver."""
    labelled = labelled.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)))
    spark = labelled.sparkSession
    rates = spark.createDataFrame([(k, min(1.0, SAMPLE / n)) for k, n in sizes.items()], "lang string, rate double")
    draw = (F.xxhash64("doc_id", F.lit(7)) % 1_000_000 + 1_000_000) % 1_000_000
    # a row for each language
    drawn = labelled.join(F.broadcast(rates), "lang").filter(draw < F.col("rate") * 1_000_000).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(text.split())
        for lang, words in found.items():
            at, hashed = grams(list(words))
            times = np.fromiter(words.values(), np.float64, len(words))[at]
            total = sum(np.bincount(row, times, BUCKETS) for row in hashed).astype(np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "gram", "n"])

    rows = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    counts = np.zeros((BUCKETS, len(languages)))
    counts[rows["gram"], rows["lang"].map(languages.index)] = rows["n"]
    return Model(languages, counts, sum(sizes.values()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its proportion), ``languages`` (proportions of the chosen set), ``n_letters``
    (of words; 0 if no language was learned) and ``surprise``: by how much the mean log likelihood of an n-gram under the
    chosen set falls below that of the languages' own text.

    Texts that are null or have no letter get ``und`` and score 0, as does every text if no language was learned; their
    ``surprise`` is null. Ties
    go to the language first in the alphabet. Each row is judged by itself, so repeated rows get the same answer."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "languages", "n_letters", "surprise")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        size = len(model.languages)
        for batch in gathered(batches):
            # each distinct word of the batch is looked at once
            pieces = pc.utf8_split_whitespace(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))
            ends = pieces.offsets.to_numpy()
            coded = pieces.flatten().dictionary_encode()
            at = coded.indices.to_numpy()
            table, letters_of = model.words(coded.dictionary.to_pylist()) if size and len(at) else (np.zeros((0, max(size, 1)), np.float32), np.zeros(0, np.int64))
            pred, score, all_, n_letters, surprise = [], [], [], [], []
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                logs = table[at[lo:hi]] if size else table
                logs = logs[~np.isnan(logs[:, 0])]
                n_letters.append(int(letters_of[at[lo:hi]].sum()) if size else 0)
                if not len(logs):
                    pred.append(UNDEFINED)
                    score.append(0.0)
                    all_.append([])
                    surprise.append(None)
                    continue
                share = infer(logs)
                top = logs.max(axis=1)
                value = np.log(np.maximum(np.exp(logs - top[:, None]) @ share, 1e-300)).sum() + top.sum(dtype=np.float64)
                surprise.append(float(share @ model.usual - value / (TEMPER * len(SIZES) * n_letters[-1])))
                i = int(share.argmax())
                pred.append(model.languages[i])
                score.append(min(1.0, float(share[i])))
                all_.append([{"lang": model.languages[j], "share": float(share[j])} for j in np.flatnonzero(share)])
            more = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(all_, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))), pa.array(n_letters, pa.int64()), pa.array(surprise, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *more], [*names, "lang_pred", "score", "languages", "n_letters", "surprise"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])
    schema.add("lang_pred", "string").add("score", "double").add("languages", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))).add("n_letters", "long").add("surprise", "double")
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, held_out: int | None = 2, folds: int = 4) -> DataFrame:
    """Fit on the rows outside fold ``held_out`` (null: on all) and predict every row; adds ``held_out``."""
    fold = F.coalesce(remainder(F.col("doc_id"), folds) == F.lit(held_out), F.lit(False)) if held_out is not None else F.lit(False)
    train = docs.filter(~fold) if held_out is not None else docs
    model = fit(train.select("doc_id", "text", "lang"))
    return predict(docs.drop("held_out").withColumn("held_out", fold), model)
