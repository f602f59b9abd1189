"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns that they got, as they were but for ``text`` and ``n_chars`` after line dedup, also
where names are those of an operator's results. Decisions are joined back to rows by ``doc_id``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, lines, minhash
from .common import table

#: Texts of at least so many letters go if the mean log likelihood of an n-gram is by SURPRISE lower than usual in their
#: languages. Of the 10,000 documents of sf0.1 none is so far off; texts of shuffled letters are, by 2.7 at least.
LEAST_LETTERS, SURPRISE = 80, 1.5
#: With fewer labelled documents than this nothing is known of what is usual, and all texts with letters stay.
LEAST_DOCS = 100
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


#: Put before the names of columns that an operator doesn't read while it runs.
ASIDE = "__td_own_"


def _aside(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with all columns but ``used`` renamed, so that they can't clash with an operator's."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in used else ASIDE + c) for c in docs.columns])


def _back(rows: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` under their own names."""
    return rows.select(*[F.col(f"`{c}`") if c in used else F.col(f"`{ASIDE}{c}`").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, or in several; those without letters, garbled ones and those in other languages
    go. Texts of under ``LEAST_LETTERS`` letters can't be told to be garbled and stay, as do all with letters if
    fewer than ``LEAST_DOCS`` documents have a language. ``lang`` stays as it was."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    if model.n_docs < LEAST_DOCS:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    odd = (F.col("n_letters") >= LEAST_LETTERS) & (F.col("surprise") > SURPRISE)
    return _back(langid.predict(_aside(docs, "text"), model).filter((F.col("lang_pred") != langid.UNDEFINED) & ~odd), docs, "text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without common lines; some are left empty. ``n_chars`` follows the text."""
    kept = _back(lines.drop_common_lines(_aside(docs, "doc_id", "text")), docs, "doc_id", "text")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    gone = minhash.near_duplicates(docs).filter(~F.col("kept") & F.col("component_id").isNotNull()).select(F.col("doc_id").alias("__td_gone"))
    return docs.join(gone, docs["doc_id"] == F.col("__td_gone"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and checksums of the kept documents."""
    return bpe.encode_documents(docs, TOKENIZER)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]
