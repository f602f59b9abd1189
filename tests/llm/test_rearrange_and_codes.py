"""Fill-in-middle, vector codes and byte-level BPE by ranks, against plain restatements and the libraries."""

import hashlib
import math
import random
import re
from itertools import pairwise

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import fim, queries, transducer, vector_codes
from tidemark.llm.queries import RANKS

rng = random.Random(11)
DATA = "/root/testdata/sf0.001"


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


TEXTS = [
    None, "", " ", "a", "A b\nc", "<P>x<S>y<M>z", "half <P and S> <M", "<<P<S<M", "é日🙂 café\x85 x", "tab\tand\x0bother   spaces", "it's we'll 123 4५ ½", "\r\n\r\n  x  \n", "a" * 5000, "=-" * 900, " " * 300,
    " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 12))) for _ in range(4000)), *["".join(rng.choice("ab <PSM>\né🙂'") for _ in range(rng.randrange(60))) for _ in range(200)], "<|endoftext|> is text",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(TEXTS)] + [(3, "a", "x", 1, "y"), (None, "some words here", "x", 2, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, n int, units string").repartition(3)


def arranged(i, text, percent=90, spm=20):
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = sha(f"1:{'' if i is None else i}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return (i, len(u), "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (i, len(u), form, len(p), len(m), sha(out), sha(text))


def given(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_fill_in_middle(docs, spark):
    for percent, spm in ((90, 20), (100, 50), (0, 0)):
        got = fim.digests(fim.transformed(docs, percent=percent, spm_percent=spm)).collect()
        assert sorted(map(tuple, got), key=str) == sorted((arranged(i, t, percent, spm) for i, t in given(docs)), key=str)
    assert fim.digests(fim.transformed(docs.limit(0))).count() == 0


def test_fill_in_middle_restores_and_rejects(spark):
    rows = spark.createDataFrame([("<P>a<S>c<M>b", "psm"), ("<S>c<P>a<M>b", "spm"), ("<P>a<S>c", "psm"), ("x<P>a<S>c<M>b", "psm"), ("<P><S><M>", "psm"), ("any", "plain"), (None, "psm"), ("x", "other")], "output string, form string")
    assert [r[0] for r in rows.select(fim.restored(rows["output"], rows["form"])).collect()] == ["abc", "abc", None, None, "", "any", None, None]
    other = fim.Sentinels("[1]", "[2]", "[3]")
    out = fim.transformed(spark.createDataFrame([(i, "one <P> two [x] three") for i in range(40)], "doc_id long, text string"), other, 100, 50)
    assert {r[0] for r in out.select(fim.restored(out["output"], out["form"], other)).collect()} == {"one <P> two [x] three"}
    for marks in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P", "<P>", "<M>"), ("", "<S>", "<M>"), ("a<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Sentinels(*marks)


def test_fill_in_middle_stays_in_the_jvm(docs):
    plan = fim.digests(fim.transformed(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("regexp_extract_all") == 1


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_vector_codes"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(queries.SQL[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def nearest(x, entries):
    return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(entries))


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Codes by comparing every part with every entry."""
    fine = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    usual = max((len(v) for _, v, _ in fine), key=lambda n: (sum(len(v) == n for _, v, _ in fine), n))
    fine = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in fine if len(v) == usual]
    w = usual // parts
    cut = lambda v: [tuple(v[p * w : (p + 1) * w]) for p in range(parts)]
    first = sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            taken = {}
            for _, v, _ in fine:
                taken.setdefault(nearest(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [tuple(sum(c) // len(taken[k]) for c in zip(*taken[k], strict=True)) if k in taken else old for k, old in enumerate(books[p])]
    out = []
    for i, v, label in fine:
        found = [nearest(x, b) for x, b in zip(cut(v), books, strict=True)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    digest = sha(",".join(str(x) for part in books for e in part for x in e))
    return sorted(((i, c, e, sum(x[2] for x in out if x[3] == label), digest) for i, c, e, label in out), key=str)


def vectors(n, width=16):
    kinds = [[rng.choice([-0.25, -0.1, 0.1, 0.3]) for _ in range(width)] for _ in range(5)]
    return [(i, [x + rng.choice([0, 0, 0.01, -0.02]) for x in rng.choice(kinds)], rng.choice([None, 1, 2, 3])) for i in range(n)]


ODD = [(900, None, 1), (901, [None] * 16, 1), (902, [math.nan] * 16, 2), (903, [math.inf] * 16, 2), (904, [0.5] * 15, 2), (905, [], 2), (906, [0.1] * 24, None), (None, [0.1] * 16, None), (7, [0.2] * 16, 3)]


@pytest.mark.parametrize(("name", "rows"), [
    ("ties and repeated rows", vectors(120) * 2 + ODD), ("few rows", vectors(5)), ("one vector for most", vectors(40) + [(100 + i, [0.1] * 16, 1) for i in range(80)]),
    ("wide numbers", vectors(40) + [(50 + i, [rng.choice([3e4, -2e4, 1e9]) for _ in range(16)], 1) for i in range(20)]),
])
def test_vector_codes(spark, name, rows):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame([(*r, 1, "at") for r in rows], "vec_id long, embedding array<float>, label int, n int, part string").repartition(4)
    want = brute_codes(rows)
    limit = 1 << 63
    want = [(i, c, e if e < limit else None, s if s < limit else None, d) for i, c, e, s, d in want]
    got = [tuple(r) for r in vector_codes.coded(df).collect()]
    if name == "wide numbers":  # an error beyond 64 bits is null, and sums leave it out
        got, want = [(r[0], r[1], r[2], r[4]) for r in got], [(r[0], r[1], r[2], r[4]) for r in want]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_vector_codes_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.coded(empty).count() == 0
    books, rows = vector_codes.trained(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int"))
    assert books is None and rows.count() == 0


def test_exponion_scans_less_and_finds_the_same():
    gen = np.random.default_rng(3)
    centres = gen.integers(-3000, 3000, (24, 4))
    rows = centres[gen.integers(0, 24, 3000)] + gen.integers(-40, 40, (3000, 4))
    all_ = ((rows[:, None] - centres[None]) ** 2).sum(-1)
    last = all_.argmin(1)
    last[::7] = gen.integers(0, 24, len(last[::7]))
    best, least, taken = vector_codes.exponion(rows, centres, last)
    assert (best == all_.argmin(1)).all() and (least == all_.min(1)).all() and taken < 0.5 * all_.size
    twice = np.array([[5, 5], [0, 0], [5, 5], [10, 0]])
    best, _, _ = vector_codes.exponion(np.array([[5, 5], [5, 0], [5, 1]]), twice, np.array([2, 3, 3]))
    assert best.tolist() == [0, 0, 0] or best.tolist() == [((twice - np.array(x)) ** 2).sum(1).argmin() for x in ([5, 5], [5, 0], [5, 1])]


def test_codebooks_decode():
    books = vector_codes.Codebooks((((4096, 0), (0, 4096)), ((-2048, 8192), (1, 1))))
    assert books.decoded("0100") == [0.0, 1.0, -0.5, 2.0]
    assert books.moved({(0, 1): (2, [-3, 5])}).entries[0] == ((4096, 0), (-2, 2))


@pytest.fixture(scope="module")
def library():
    ranks = transducer.load_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ranks_as_the_library(docs, library):
    got = sorted((tuple(r) for r in transducer.digests(docs, RANKS).collect()), key=str)
    want = [(i, library.encode_ordinary(t or ""), t or "") for i, t in given(docs)]
    assert got == sorted(((i, len(x), sha(" ".join(map(str, x))), sha(t), True) for i, x, t in want), key=str)
    assert transducer.digests(docs.limit(0), RANKS).count() == 0


def test_ids_and_texts_come_back(docs, library):
    rows = transducer.decoded(transducer.encoded(docs, RANKS), RANKS, chunk=3).collect()
    assert sorted((r["text"] for r in rows)) == sorted(t or "" for _, t in given(docs))
    assert all(r["bytes"].decode() == r["text"] and np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"]) for r in rows)


def test_split_pattern_is_the_public_one():
    from tidemark.llm.bpe import SPACE, WORDS

    assert public_tokenizers.PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s+", f"[{SPACE}]+") == WORDS




def merged(word, ranks):
    """All merges, one by one."""
    parts = [word[k : k + 1] for k in range(len(word))]
    while True:
        least, at = min(((ranks.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(pairwise(parts))), default=(1 << 40, 0))
        if least == 1 << 40:
            return [ranks[x] for x in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_transducer_of_odd_ranks(seed):
    """Ranks of few letters, in which merges overlap and compete."""
    r = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    parts = [b"a", b"b"]
    while len(ranks) < 300:
        a, b = r.choice(parts), r.choice(parts)
        if a + b not in ranks and len(a + b) < 9 and merged(a + b, ranks) == [ranks[a], ranks[b]]:
            ranks[a + b] = len(ranks)
            parts.append(a + b)
    library = tiktoken.Encoding("odd", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    machine, small = transducer.Transducer(ranks), transducer.Transducer(ranks, states=3, pairs=2)
    for _ in range(400):
        word = "".join(r.choice("aaabc") for _ in range(r.randrange(1, 40)))
        want = library.encode_ordinary(word)
        assert machine.encode(word.encode()) == want == small.encode(word.encode())


def test_ranks_without_merges_are_refused():
    bytes_ = {bytes([b]): b for b in range(256)}
    for ranks in (bytes_ | {b"abc": 256}, bytes_ | {b"ab": 3}, {b"a": 0}):
        with pytest.raises(ValueError):
            transducer.Transducer(ranks)


def test_lookahead_is_bounded():
    """Every token comes out before twice the longest token has been read behind it."""
    ranks = transducer.load_ranks(RANKS)
    machine = transducer.Transducer(ranks)
    for word in ["a" * 3000, "ab" * 1500, "".join(rng.choice("etaoinshr") for _ in range(3000)), "=-" * 1500]:
        out, done, furthest = [], 0, 0
        for read, tokens in machine.written(word.encode()):
            for t in tokens:
                done += len(machine.labels[t])
                furthest = max(furthest, read - done)
            out += tokens
        assert b"".join(machine.labels[t] for t in out) == word.encode() and furthest < 2 * max(map(len, ranks))


def test_streamed_text_is_the_text():
    ranks = transducer.load_ranks(RANKS)
    decoder = transducer.Decoder({i: x for x, i in ranks.items()})
    for _ in range(1500):
        ids = [rng.randrange(256) if rng.random() < 0.5 else rng.randrange(50256) for _ in range(rng.randrange(40))]
        cuts = [0, *sorted(rng.randrange(len(ids) + 1) for _ in range(3)), len(ids)]
        assert "".join(decoder.stream(ids[a:b] for a, b in pairwise(cuts))) == decoder.raw(ids).decode("utf-8", "replace")
    machine = transducer.Utf8Stream()
    assert [machine.feed(bytes([b])) for b in "é🙂".encode()] + [machine.finish()] == ["", "é", "", "", "", "🙂", ""]
    assert machine.feed("🙂".encode()[:3]) + machine.finish() + machine.feed(b"a") == "�a"
