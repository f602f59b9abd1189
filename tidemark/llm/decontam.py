"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask fixes which of ``SPAN`` neighbouring words count; the others may differ. Every benchmark item and every document
is hashed under the masks for the item's length at every word. Where a document's hash meets an item's, the two are laid side by side and
the aligned words around the hit are compared: a run of ``RUN`` words (or the whole item, if shorter) of which at
least ``PERCENT`` per cent agree is a leak. Items of fewer than ``SPAN`` words are looked for as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 7
RUN = 13
#: Places that count, for each mask: one at least fits every allowed pattern of differing words in ``RUN`` words.
MASKS = ((0, 1, 3, 4, 6), (0, 1, 2, 5, 6), (0, 2, 3, 5, 6), (0, 1, 2, 3, 5), (0, 1, 2, 3, 4), (0, 1, 2, 4, 6))
#: The same for items of ``SPAN`` to ``RUN`` - 1 words.
SHORT_MASKS = ((0, 1, 2, 4), (0, 3, 4, 5), (0, 1, 3, 6))
PERCENT = 75
#: Words compared before and behind a hit.
REACH = 20
#: Bytes that a benchmark's seeds and words may take to be broadcast, each row counted with ROW_BYTES of overhead.
BROADCAST_BYTES, ROW_BYTES = 256 << 20, 64


def _words(text: Column) -> Column:
    """Hashes of the lower-case runs of letters and digits."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), ""), lambda w: F.xxhash64(w))


def masks_for(n_words: int) -> tuple[tuple[int, ...], ...]:
    """The masks for an item of so many words."""
    return MASKS if n_words >= RUN else SHORT_MASKS if n_words >= SPAN else (tuple(range(n_words)),)


def _seeds(rows: DataFrame, masks: list[tuple[int, ...]], *carried: str, fits=lambda mask: F.lit(True)) -> DataFrame:
    """A row for each place ``p`` and mask of the hash array ``h``; ``seed`` tells the masks apart."""
    places = rows.filter(F.size("h") > 0).select(*carried, "h", F.explode(F.sequence(F.lit(0), F.size("h") - 1)).alias("p"))
    hashes = [F.when((F.col("p") + mask[-1] < F.size("h")) & fits(mask), F.xxhash64(F.lit(str(mask)), *[F.get("h", F.col("p") + k) for k in mask])) for mask in masks]
    return places.select(*carried, "h", "p", F.explode(F.array(*hashes)).alias("seed")).filter("seed is not null")


def leaks(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id``, ``item_id``, ``matched`` (agreeing words of the best run), ``run`` (its length) and ``at`` (the word of
    the document where the item would begin, negative if it begins earlier) for each leaked item and document.

    Null and empty texts have no words and leak nothing; all words of an item of fewer than ``SPAN`` words must agree.
    Repeated rows give one row; rows of one ``item_id`` with other words are items of their own that share it. If the
    benchmark's seeds and words take at most ``broadcast_bytes`` they are broadcast, words once an item and not once a
    seed, and documents are read once and never shuffled. If they take more, seeds are shuffled alone (``doc_id``, place
    and hash), and the documents' words are read again and move once, to meet their hits."""
    items = benchmark.select("item_id", _words(F.col("text")).alias("h")).distinct().withColumn("version", F.xxhash64("h"))
    id_bytes = F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0))
    taken = items.groupBy(F.least(F.size("h"), F.lit(RUN)).alias("n")).agg(F.sum(ROW_BYTES + id_bytes + 8 * F.size("h")).alias("bytes")).collect()  # at most RUN + 1 rows
    sizes = sorted(r["n"] for r in taken if r["n"])
    masks = list(dict.fromkeys(m for n in sizes for m in masks_for(n))) or [MASKS[0]]
    fits = lambda mask: F.least(F.size("h"), F.lit(RUN)).isin([n for n in sizes if mask in masks_for(n)])
    seeds = _seeds(items, masks, "item_id", "version", fits=fits).select("seed", "item_id", "version", F.col("p").alias("q"))
    whole = items.select(F.col("item_id").alias("hit_item"), F.col("version").alias("hit_version"), F.col("h").alias("item"))
    of_item = F.col("item_id").eqNullSafe(F.col("hit_item")) & (F.col("version") == F.col("hit_version"))
    all_bytes = sum(r["bytes"] for r in taken) + (seeds.agg(F.sum(ROW_BYTES + id_bytes)).first()[0] or 0)
    words = docs.select("doc_id", _words(F.col("text")).alias("h"))
    if all_bytes <= broadcast_bytes:
        hits = _seeds(words, masks, "doc_id").join(F.broadcast(seeds), "seed").join(F.broadcast(whole), of_item)
    else:
        met = _seeds(words, masks, "doc_id").select("doc_id", "p", "seed").join(seeds, "seed")
        shifts = met.groupBy(F.col("doc_id").alias("hit"), "item_id", "version", (F.col("p") - F.col("q")).alias("shift"), "q").agg(F.count("*").alias("n"))
        hits = words.join(shifts, F.col("doc_id").eqNullSafe(F.col("hit"))).join(whole, of_item)
        hits = hits.select("doc_id", "item_id", (F.col("q") + F.col("shift")).alias("p"), "q", "h", "item")
    # the aligned stretch: item words [lo, hi) stand at document words [lo + shift, hi + shift)
    shift = F.col("p") - F.col("q")
    hits = hits.select("doc_id", "item_id", shift.alias("at"), F.greatest(F.col("q") - REACH, -shift, F.lit(0)).alias("lo"), F.least(F.col("q") + SPAN + REACH, F.size("item"), F.size("h") - shift).alias("hi"), "h", "item")
    hits = hits.filter("hi > lo")  # rows of one id may differ in length
    length = F.col("hi") - F.col("lo")
    run = F.least(F.lit(RUN), F.size("item"))
    hits = hits.select("doc_id", "item_id", "at", run.alias("run"), F.slice("h", F.col("lo") + F.col("at") + 1, length).alias("a"), F.slice("item", F.col("lo") + 1, length).alias("b"))
    hits = hits.filter(F.size("a") >= F.col("run")).dropDuplicates(["doc_id", "item_id", "at", "a", "b"])
    agree = F.zip_with("a", "b", lambda x, y: (x == y).cast("int"))
    hits = hits.select("doc_id", "item_id", "at", "run", agree.alias("m"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("m") - F.col("run") + 1), lambda s: F.aggregate(F.slice("m", s, F.col("run")), F.lit(0), lambda x, y: x + y)))
    found = hits.select("doc_id", "item_id", "at", "run", best.alias("matched")).filter(100 * F.col("matched") >= F.when(F.col("run") < SPAN, 100).otherwise(PERCENT) * F.col("run"))
    top = F.max(F.struct("matched", "run", (-F.col("at")).alias("back")))
    return found.groupBy("doc_id", "item_id").agg(top.alias("x")).select("doc_id", "item_id", F.col("x.matched").cast("long").alias("matched"), F.col("x.run").cast("long").alias("run"), (-F.col("x.back")).cast("long").alias("at"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item. Rows with a null ``doc_id`` can't be named by a leak and stay."""
    gone = leaks(docs, benchmark).select(F.col("doc_id").alias("__td_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__td_gone"), "left_anti")
