"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document; a ledger row holds the measurements and one failure bit a rule. A
policy is a versioned set of rules: a document passes if none of its bits is set. Policies and ablations (what a
policy would keep without one of its rules) read the ledger alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \\t\\n\\x0B\\f\\r"
#: Characters counted as symbols: fixed value.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rule -> failure, over the measurements; the place in this mapping is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 4 * n_full_lines",
    "word_length": "word_chars > 25 * n_words or word_chars < 2 * n_words",
}
BASE = ("few_words", "repeated_words")
#: Policy version -> its rules.
POLICIES: dict[str, tuple[str, ...]] = {"v1": BASE, "v2": (*BASE, "symbols", "duplicate_lines"), "v3": tuple(RULES)}


def mask(rules: tuple[str, ...]) -> int:
    """The bits of ``rules``."""
    return sum(1 << list(RULES).index(r) for r in rules)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever the optimiser moves the expression to."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that occur twice or more in the text, the first included."""

    def covered(s: Column) -> Column:  # windows with their places, in order: keep places whose neighbour is equal
        last = F.size(s) - 1
        equal = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["k"] == s[j]["k"])) | ((j < last) & (s[F.least(j + 1, last)]["k"] == s[j]["k"])))
        start = F.struct(F.lit(-WINDOW).alias("before"), F.lit(0).alias("n"))
        return F.aggregate(F.array_sort(F.transform(equal, lambda j: s[j]["p"])), start, lambda a, p: F.struct(p.alias("before"), (a["n"] + F.least(F.lit(WINDOW), p - a["before"])).alias("n")), lambda a: a["n"])

    def counted(w: Column) -> Column:  # most texts repeat no window and are not sorted
        placed = F.transform(w, lambda k, i: F.struct(k.alias("k"), i.alias("p")))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(F.array_sort(placed), covered)).otherwise(0)

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.when(F.size(h) >= WINDOW, let(F.transform(starts, lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)])), counted)).otherwise(0)

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = reduce(lambda x, c: F.replace(x, F.lit(c)), SYMBOLS, text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
    rows = docs.select(
        "doc_id",
        F.array_remove(F.split(text, f"[{WHITE}]+"), "").alias("words"),
        (F.length(text) - F.length(bare)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    return rows.select(
        "doc_id",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_full_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failures`` (one bit a rule) of each row of ``docs``; no row moves.

    A null or empty text has no words and fails ``few_words``. Repeated rows give repeated rows, an empty table none;
    columns other than ``doc_id`` and ``text`` are left out."""
    bits: Column = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())))
    return _measured(docs).withColumn("failures", bits)


def passes(version: str) -> Column:
    """Whether a ledger row has none of a policy's bits."""
    return F.col("failures").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0


def judged(docs: DataFrame, version: str = "v3") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    base_failed = F.col("failures").bitwiseAND(F.lit(mask(BASE))) != 0
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & passes(version)).alias("kept"), "failures")


def ablations(rows: DataFrame) -> DataFrame:
    """``policy``, ``without`` (a rule, or null for none), ``kept``: documents each policy keeps less one of its rules.

    Documents are counted by their bits first, so at most one row for each combination of failures is aggregated."""
    counts = rows.groupBy("failures").agg(F.count("*").alias("n"))
    cases = [(v, r, mask(tuple(x for x in rules if x != r))) for v, rules in POLICIES.items() for r in (None, *rules)]
    spark = rows.sparkSession
    table = spark.createDataFrame(cases, "policy string, without string, bits int")
    kept = F.when(F.col("failures").bitwiseAND(F.col("bits")) == 0, F.col("n")).otherwise(F.lit(0))
    # at most 2 ** len(RULES) rows meet the few cases
    return counts.withColumn("one", F.lit(1)).join(F.broadcast(table.withColumn("one", F.lit(1))), "one").groupBy("policy", "without").agg(F.sum(kept).alias("kept"))
