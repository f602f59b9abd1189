"""Fill-in-middle transformation in Spark SQL functions: cuts from hashes, arrangements from slices, sentinels read back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of letters and single other characters, over code points.
UNITS = "[A-Za-z]+|[^A-Za-z]"


@dataclass(frozen=True)
class Sentinels:
    """The marks before prefix, suffix and middle. No mark may hold another one, nor begin with the end of one."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        for a in marks:
            for b in marks:
                if not a or (a in b and a is not b) or any(a[:k] == b[-k:] for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"{marks} cannot be told apart in every text")
        if len(set(marks)) < 3:
            raise ValueError("three different marks are needed")


def _draws(seed: int, doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit integers from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, sentinels: Sentinels = Sentinels(), percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """``doc_id``, ``n`` (units), ``form``, ``prefix``, ``middle``, ``suffix`` and ``output`` of each row's whole text.

    ``percent`` of the documents are rearranged, ``spm_percent`` of these with the suffix first (``spm``), the others
    with the prefix first (``psm``); ``plain`` texts stay as they are, with null parts: also empty ones and those that
    hold a sentinel. Draws depend on ``seed`` and ``doc_id`` alone, so a lost task gives the same rows again; rows with
    one id share their draws. A null text counts as empty, a null id as an empty string. Other columns are left out.
    Nothing is shuffled, and each row's units live as long as the row."""
    s, i = sentinels, F.col("n") + 1
    marked = [F.contains(F.col("text"), F.lit(x)) for x in (s.prefix, s.suffix, s.middle)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(_draws(seed, F.col("doc_id")), 1)))
    rows = rows.select("*", F.regexp_extract_all("text", F.lit(UNITS), F.lit(0)).alias("units")).withColumn("n", F.size("units").cast("long"))
    form = F.when((F.col("n") == 0) | marked[0] | marked[1] | marked[2] | (F.col("h3") % 100 >= percent), "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "n", "units", form.alias("form"), F.least(F.col("h1") % i, F.col("h2") % i).cast("int").alias("a"), F.greatest(F.col("h1") % i, F.col("h2") % i).cast("int").alias("b"))

    def part(begin: Column, count: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", begin + 1, count), ""))

    rows = rows.select("doc_id", "n", "form", "text", part(F.lit(0), F.col("a")).alias("prefix"), part(F.col("a"), F.col("b") - F.col("a")).alias("middle"), part(F.col("b"), F.col("n").cast("int") - F.col("b")).alias("suffix"))
    psm = F.concat(F.lit(s.prefix), "prefix", F.lit(s.suffix), "suffix", F.lit(s.middle), "middle")
    spm = F.concat(F.lit(s.suffix), "suffix", F.lit(s.prefix), "prefix", F.lit(s.middle), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text behind ``output``, read at its sentinels; null where they don't stand as ``form`` tells."""
    s = sentinels

    def between(first: str, second: str) -> Column:
        """What stands between two marks, which occur once each."""
        return F.substring_index(F.substring_index(output, second, 1), first, -1)

    def ordered(first: str, second: str) -> Column:
        at = [F.locate(x, output) for x in (first, second, s.middle)]
        return (at[0] == 1) & (at[1] > 0) & (at[2] > at[1])

    middle = F.substring_index(output, s.middle, -1)
    psm = F.when(ordered(s.prefix, s.suffix), F.concat(between(s.prefix, s.suffix), middle, between(s.suffix, s.middle)))
    spm = F.when(ordered(s.suffix, s.prefix), F.concat(between(s.prefix, s.middle), middle, between(s.suffix, s.prefix)))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def digests(rows: DataFrame, sentinels: Sentinels = Sentinels()) -> DataFrame:
    """Lengths of the parts and digests of what ``transformed`` gave, with the text rebuilt from ``output`` and ``form``."""
    text = restored(F.col("output"), F.col("form"), sentinels)
    return rows.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(text.cast("binary"), 256).alias("restored_sha256"),
    )
