"""Repeated byte strings by suffix sorting.

A window is a string of ``LENGTH`` bytes. Its anchor is its ``GRAM``-byte string with the least hash (the leftmost of
equals), which depends on the window's bytes alone, so equal windows have equal anchors at the same place. Suffixes
are therefore sorted only among occurrences of one anchor: to the right of it, and (reversed) to the left of it. Two
windows are equal if the right parts and the left parts share long enough prefixes.

Sorting is deep-shallow: a multikey quicksort over 8-byte characters to depth ``SHALLOW``, then a blind trie for each
group that still shares its prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_keys, small_batches, stored, texts

LENGTH, GRAM = 400, 32
#: Hashed bytes that windows are cut into at once; also fixes the bits that hold a place.
CHUNK, PLACE_BITS = 1 << 22, 23
SHALLOW = 32
#: Occurrences of one anchor that are sorted in one task; windows of more frequent anchors are counted by hash.
GROUP_ROWS = 1 << 16
#: Elements of a table of window classes.
CELLS = 1 << 21


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM`` bytes from each place on; ``data`` is unsigned bytes."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    d = 1
    while d < GRAM:
        h = h[:-d] * np.uint64(0xD6E8FEB86659FD93) + h[d:]
        h ^= h >> np.uint64(29)
        d *= 2
    return h


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours."""
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.concatenate((x, np.full(pad, x.max(), x.dtype))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``at``, ``first``, ``last``, ``hash``: an anchor's place, the first and last window that it is the anchor of."""
    h = gram_hashes(data)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    at = (least & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    return at[first], first, last, h[at[first]].view(np.int64)


def common(a: bytes, b: bytes, least: int = 0) -> int:
    """Length of the common prefix, known to be at least ``least``."""
    lo, hi = least, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """Orders strings while reading few of their bytes: nodes hold a depth and the bytes that follow there."""

    def __init__(self, strings: list[bytes], first: int, shared: int):
        self.strings, self.shared = strings, shared
        self.root: int | tuple[int, dict] = first

    def add(self, new: int) -> None:
        s = self.strings[new]
        node = self.root
        while not isinstance(node, int):  # down by the bytes at branches alone
            depth, below = node
            node = below.get(s[depth] if depth < len(s) else -1)
            if node is None:
                node = next(iter(below.values()))
        other = self.strings[node]
        same = common(s, other, self.shared)
        key = s[same] if same < len(s) else -1
        above, branch, node = None, None, self.root
        while not isinstance(node, int) and node[0] < same:
            above, branch = node, s[node[0]]
            node = node[1][branch]
        if not isinstance(node, int) and node[0] == same:
            node[1][key] = new
            return
        fork = (same, {other[same] if same < len(other) else -1: node, key: new})
        if above is None:
            self.root = fork
        else:
            above[1][branch] = fork

    def order(self) -> tuple[list[int], list[int]]:
        """Strings in order, and the prefix that each shares with the one before."""
        out, lcp, stack = [], [], [(self.root, self.shared)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, int):
                out.append(node)
                lcp.append(shared)
            else:
                depth, below = node
                keys = sorted(below, reverse=True)
                stack += [(below[k], depth) for k in keys[:-1]]
                stack.append((below[keys[-1]], shared))
        return out, lcp


def sort_strings(strings: list[bytes], skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``strings`` and the prefix that each shares with the one before it (0 for the first).

    The first ``skip`` bytes are known to agree. Equal strings share their length."""
    place: dict[bytes, int] = {}
    own = [place.setdefault(s, len(place)) for s in strings]
    distinct = list(place)
    n = len(distinct)
    words = np.frombuffer(b"".join(s[skip : skip + SHALLOW].ljust(SHALLOW, b"\0") for s in distinct), ">u8").reshape(n, -1)
    order, group = np.arange(n), np.zeros(n, np.int64)
    for d in range(words.shape[1]):  # a multikey quicksort's pass: only groups of equals go on
        again = np.concatenate(([False], group[1:] == group[:-1]))
        open_ = np.flatnonzero(again | np.concatenate((again[1:], [False])))  # groups lie in a row, and stay where they are
        if not len(open_):
            break
        key = words[order[open_], d]
        move = np.lexsort((key, group[open_]))
        order[open_], key = order[open_][move], key[move]
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        new[open_[1:]] |= key[1:] != key[:-1]
        group = np.cumsum(new) - 1
    ends = np.flatnonzero(np.concatenate((group[1:] != group[:-1], [True]))) + 1
    out: list[int] = []
    lcp: list[int] = []
    start = 0
    for end in ends.tolist():
        run = order[start:end].tolist()
        if len(run) > 1:
            trie = BlindTrie(distinct, run[0], min(skip, len(distinct[run[0]])))
            for i in run[1:]:
                trie.add(i)
            run, inner = trie.order()
        else:
            inner = [0]
        inner[0] = common(distinct[out[-1]], distinct[run[0]], 0) if out else 0
        out += run
        lcp += inner
        start = end
    rank = np.empty(n, np.int64)
    rank[out] = np.arange(n)
    ranks = rank[own]
    full = np.argsort(ranks, kind="stable")
    sorted_ranks = ranks[full]
    again = np.concatenate(([False], sorted_ranks[1:] == sorted_ranks[:-1]))
    lengths = np.array([len(s) for s in strings])
    return full, np.where(again, lengths[full], np.array(lcp)[sorted_ranks])


def repeated_starts(segments: list[bytes], left: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For occurrences of one anchor, the runs of window starts (counted in the segment) whose window is repeated.

    ``left`` is the number of bytes before the anchor; a segment ends with its last window."""
    m = len(segments)
    tail = [s[k:] for s, k in zip(segments, left, strict=True)]
    head = [s[:k][::-1] for s, k in zip(segments, left, strict=True)]
    most = np.array(left)
    least = np.array([length - len(t) for t in tail])
    if m == 2:
        r, k = common(*tail), common(*head)
        lo, hi = max(length - r, int(least.max())), min(k, int(most.min()))
        return [[(n - hi, n - lo)] if lo <= hi else [] for n in left]
    order_r, lcp_r = sort_strings(tail, GRAM)
    order_l, lcp_l = sort_strings(head)
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    columns = np.arange(int(least.min()), int(most.max()) + 1)
    step = max(1, CELLS // m)
    flags = np.zeros((m, len(columns)), bool)
    for at in range(0, len(columns), step):
        j = columns[at : at + step]
        code = np.empty((m, len(j)), np.int64)
        code[order_l] = np.cumsum(lcp_l[:, None] < j, axis=0) * (m + 1)
        right = np.empty_like(code)
        right[order_r] = np.cumsum(lcp_r[:, None] < length - j, axis=0)
        code += right
        off = (j < least[:, None]) | (j > most[:, None])
        code[off] = (-1 - np.arange(m))[:, None].repeat(len(j), axis=1)[off]
        order = np.argsort(code, axis=0)
        ranked = np.take_along_axis(code, order, axis=0)
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros((m, len(j)), bool)
        twice[1:] |= same
        twice[:-1] |= same
        block = np.zeros_like(twice)
        np.put_along_axis(block, order, twice, axis=0)
        flags[:, at : at + step] = block & ~off
    for i in np.flatnonzero(flags.any(axis=1)).tolist():
        edges = np.flatnonzero(np.diff(np.concatenate(([0], flags[i].view(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            lo, hi = int(columns[a]), int(columns[b - 1])
            out[i].append((left[i] - hi, left[i] - lo))
    return out


def _anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """``doc_id``, ``rid``, ``at``, ``first``, ``last``, ``h`` for every window of every text."""

    def flush(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        sizes = np.array([len(x) for _, _, x in held])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        at, first, last, h = anchors(np.frombuffer(b"".join(x for _, _, x in held), np.uint8), length)
        # windows across two texts don't count: cut each anchor's range at the ends of its own text
        piece = np.searchsorted(ends, at, side="right")
        first, last = np.maximum(first, begins[piece]), np.minimum(last, ends[piece] - length)
        ok = first <= last
        piece, at, first, last, h = piece[ok], at[ok], first[ok], last[ok], h[ok]
        shift = np.array([o for _, o, _ in held]) - begins
        return np.array([i for i, _, _ in held])[piece], at + shift[piece], first + shift[piece], last + shift[piece], h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, parts = [], 0, []
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = text.encode()
                for o in range(0, len(raw) - length + 1, CHUNK // 2):
                    piece = raw[o : o + CHUNK // 2 + length - 1]
                    if size + len(piece) > CHUNK:
                        parts.append(flush(held))
                        held, size = [], 0
                    held.append((i, o, piece))
                    size += len(piece)
            if held:
                parts.append(flush(held))
            if parts:
                who, at, first, last, h = (np.concatenate(x) for x in zip(*parts, strict=True))
                who = pa.array(who)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(who), batch.column("rid").take(who), *map(pa.array, (at, first, last, h))], ["doc_id", "rid", "at", "first", "last", "h"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, rid long, at long, first long, last long, h long")


def _segments(joined: DataFrame, length: int) -> DataFrame:
    """The bytes of each anchor's windows, cut from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, at, first, h, hot, seg = [], [], [], [], [], []
            for i, (text, found) in enumerate(zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True)):
                raw = text.encode()
                for x in found:
                    who.append(i)
                    at.append(x["at"])
                    first.append(x["first"])
                    h.append(x["h"])
                    hot.append(x["hot"])
                    seg.append(raw[x["first"] : x["last"] + length])
            who = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(who), batch.column("rid").take(who), *(pa.array(x, pa.int64()) for x in (at, first, h)), pa.array(hot, pa.bool_()), pa.array(seg, pa.binary())], ["doc_id", "rid", "at", "first", "h", "hot", "seg"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, rid long, at long, first long, h long, hot boolean, seg binary")


def _sorted_repeats(segments: DataFrame, length: int) -> DataFrame:
    """``doc_id``, ``rid``, ``lo``, ``hi``: byte ranges of repeated windows, from sorting each anchor's occurrences."""
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(rows: pa.Table) -> list[pa.RecordBatch]:
            h = rows.column("h").to_numpy()
            at, first = rows.column("at").to_numpy(), rows.column("first").to_numpy()
            seg = rows.column("seg").to_pylist()
            cuts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True]))).tolist()
            who, lo, hi = [], [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2:
                    continue
                runs = repeated_starts(seg[a:b], (at[a:b] - first[a:b]).tolist(), length)
                for i, found in enumerate(runs, a):
                    for x, y in found:
                        who.append(i)
                        lo.append(int(first[i]) + x)
                        hi.append(int(first[i]) + y + length)
            who = pa.array(who, pa.int64())
            ids = rows.select(["doc_id", "rid"]).combine_chunks().take(who)
            return [pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (*ids.columns, pa.array(lo, pa.int64()), pa.array(hi, pa.int64()))], ["doc_id", "rid", "lo", "hi"])]

        for batch in batches:
            held.append(batch)
            h = batch.column("h").to_numpy()
            if len(h) and h[0] != h[-1] and sum(len(x) for x in held) >= 2048:
                cut = int(np.searchsorted(h, h[-1]))  # rows come sorted: the last anchor may go on in the next batch
                yield from work(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held = [batch.slice(cut)]
        if held:
            yield from work(pa.Table.from_batches(held))

    kind = segments.schema["doc_id"].dataType.simpleString()
    dealt = segments.select("doc_id", "rid", "at", "first", "h", "seg").repartition(n, "h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, f"doc_id {kind}, rid long, lo long, hi long")


def _counted_repeats(segments: DataFrame, length: int) -> DataFrame:
    """The same ranges from counting window hashes (128 bits), for anchors with any number of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (first, seg) in enumerate(zip(batch.column("first").to_pylist(), batch.column("seg").to_pylist(), strict=True)):
                n = len(seg) - length + 1
                pair = np.frombuffer(b"".join(xxhash.xxh3_128_digest(seg[k : k + length]) for k in range(n)), ">i8").astype(np.int64).reshape(-1, 2)
                who = pa.array([i] * n, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(who), batch.column("rid").take(who), pa.array(np.arange(first, first + n)), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["doc_id", "rid", "lo", "w1", "w2"])

    kind = segments.schema["doc_id"].dataType.simpleString()
    windows = stored(segments.select("doc_id", "rid", "first", "seg").mapInArrow(run, f"doc_id {kind}, rid long, lo long, w1 long, w2 long"))
    again = stored(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1"))
    return join_keys(windows, again, ["w1", "w2"]).select("doc_id", "rid", "lo", (F.col("lo") + length).alias("hi"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlap; ranges that touch become one."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` and ``kept`` (binary) for each row's whole text.

    A byte goes if a string of ``length`` bytes over it starts anywhere else, in the same text or another row's; a
    repeated row counts as another row. Null and empty texts, and texts under ``length`` bytes, lose nothing. Anchors
    that occur once are dropped before any text moves; texts move once, anchors' windows once. Anchors with more
    than ``group_rows`` occurrences are not gathered in a task: their windows are counted by hash instead."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = texts(docs).withColumn("rid", F.xxhash64("text")).select("doc_id", "rid", "text")
    found = stored(_anchor_rows(rows, length))
    often = stored(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", "n", (F.col("n") > group_rows).alias("hot")))
    live = join_keys(found, often, ["h"]).groupBy(F.col("doc_id").alias("d"), F.col("rid").alias("r")).agg(F.collect_set(F.struct("at", "first", "last", "h", "hot")).alias("found"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("rid").eqNullSafe(F.col("r"))
    segments = _segments(rows.join(live, same).select("doc_id", "rid", "text", "found"), length)
    if often.filter("hot").isEmpty():
        ranges = _sorted_repeats(segments, length)
    else:
        ranges = _sorted_repeats(segments.filter("not hot"), length).union(_counted_repeats(segments.filter("hot"), length))
    per_doc = ranges.groupBy(F.col("doc_id").alias("d"), F.col("rid").alias("r")).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    joined = rows.join(per_doc, same, "left").select("doc_id", "text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, spans, kept = [], [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                raw = text.encode()
                gone = merged([(x["lo"], x["hi"]) for x in ranges or []])
                n_bytes.append(len(raw))
                removed.append(sum(b - a for a, b in gone))
                spans.append([{"start": a, "end": b} for a, b in gone])
                starts, ends = [0, *(b for _, b in gone)], [*(a for a, _ in gone), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(starts, ends, strict=True)))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary")

