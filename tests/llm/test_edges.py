"""All operators on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random
from collections import Counter
from itertools import combinations

import brute
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import blocks, bpe, decontam, langid, lines, minhash, quality, stages, substring, suffix, token_store, toxicity
from tidemark.llm.queries import TOKENIZER

rng = random.Random(5)
WORDS = [f"{a}{b}{c}" for a in "bdfg" for b in "aeio" for c in ("na", "ro", "st", "li", "Q", "é")]


def prose(n: int) -> str:
    return " ".join(rng.choice(WORDS) + (".\n" if rng.random() < 0.02 else "." if rng.random() < 0.08 else "") for _ in range(n))


PASSAGE = prose(90)
TEXTS = [
    None, "", " ", "\n\n", "a", "A b c", "a B  c", "x" * 30_000, prose(9000), PASSAGE, PASSAGE, PASSAGE + " end", prose(40) + " " + PASSAGE + " " + prose(40), prose(30) + " " + PASSAGE + "\n" + prose(5),
    "<|endoftext|> is special", "tab\tand\x0bother\x1cspaces here  two", "日本語 🙂 café", "same line\nsame line\n same LINE \nother", *[f"{prose(12)}\nStock line.\n{prose(6)}" for _ in range(11)], "ab " * 400,
]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(TEXTS))


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, rng.choice(["en", "de", None]), None, 1, "x", 2, 3) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, rid string, h int, n_lines int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_bpe(docs, rows, empty):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    assert listed(bpe.encode_documents(docs, TOKENIZER), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == brute.op1(rows, tokenizer)
    assert bpe.encode_documents(empty, TOKENIZER).count() == 0


def test_automaton_and_library_agree_on_odd_strings():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    automaton = bpe.Automaton.load(TOKENIZER)
    first, second = bpe.automaton_encoder(automaton), bpe.library_encoder(tokenizer, automaton.special)
    letters = "abcdeéñ  \n\t\r'st.,!?=-_0123<|endoftext|>日🙂  \x1c\x85ßǺaaaa"
    some = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["=" * 300, "a" * 300, " " * 50, "", "ab" * 200]
    want = [b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(x, add_special_tokens=False).ids) for x in some]
    assert first(some) == want and second(some) == want
    labels = automaton.labels | {i: s.encode() for s, i in automaton.special.items()}
    assert [b"".join(labels[i] for i in memoryview(x).cast("I")).decode() if x else "" for x in want] == some


def test_token_store(docs, rows, empty):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = token_store.crc(token_store.round_trip(docs, TOKENIZER))
    assert sorted(listed(got, "doc_id", "start", "n_tokens", "ids_crc32")) == brute.op2(rows, tokenizer)
    assert token_store.round_trip(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("ids", [[], [7], [5] * 700, [0, 50_256, 1, 2] * 300, [2**32 - 1, 0], list(range(1000)) + [2**31] * 3])
def test_pages(ids):
    import numpy as np

    page = token_store.pack(np.array(ids, np.uint32))
    assert token_store.unpack(page).tolist() == ids
    size = token_store.BLOCK
    assert [token_store.unpack_block(page, k).tolist() for k in range(-(-len(ids) // size))] == [ids[k : k + size] for k in range(0, len(ids), size)]
    with pytest.raises(IndexError):
        token_store.unpack_block(page, -(-len(ids) // size))


def test_near_duplicates(docs, rows, empty):
    assert set(listed(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")) == brute.op3(rows)
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_large_families(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "STARS", 1)
    monkeypatch.setattr(blocks, "MEMBERS", 5)
    some = []
    for _ in range(3):
        base = [rng.choice(WORDS) for _ in range(100)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(8)):
                w[rng.randrange(100)] = rng.choice(WORDS)
            some.append(" ".join(w))
    rows = list(enumerate(some + [some[0], some[0].upper()]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert set(listed(minhash.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept")) == brute.op3(rows)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, PASSAGE), (3, PASSAGE), (3, PASSAGE), (4, PASSAGE)], "doc_id long, text string")
    assert listed(minhash.near_duplicates(df), "doc_id", "component_id", "kept") == [(3, 3, True), (3, 3, True), (4, 3, False), (None, None, False)]
    assert lines.drop_common_lines(df, min_docs=4).filter("n_dropped = n_lines").count() == 4
    assert suffix.remove_repeats(df).filter("n_removed = n_bytes").count() == 4
    assert quality.judged(df).count() == 4 and toxicity.scored(df, df.selectExpr("doc_id", "1 as toxic")).count() == 4
    assert langid.identify(df.withColumn("lang", F.lit("en"))).count() == 4


def test_line_dedup(docs, rows, empty):
    got = lines.drop_common_lines(docs).withColumn("kept", F.sha2(F.col("text").cast("binary"), 256))
    assert listed(got, "doc_id", "n_lines", "n_dropped", "kept") == brute.op4(rows)
    assert lines.drop_common_lines(empty).count() == 0
    assert set(docs.columns) <= set(got.columns)


def test_repeated_bytes(docs, rows, empty):
    for limit in (suffix.GROUP_ROWS, 2):  # by sorting, and by counting
        got = suffix.remove_repeats(docs, group_rows=limit).withColumn("sha", F.sha2("kept", 256))
        assert listed(got, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == brute.op6(rows)
    assert suffix.remove_repeats(empty).count() == 0


def test_a_window_of_many_places_stays_in_its_tasks(spark):
    """Rows of one frequent window aren't gathered in a task, where windows are too many for Spark to broadcast them."""
    seg = bytes(range(40, 80)).decode()
    rows = spark.range(4000).repartition(4).select(F.col("id").alias("doc_id"), F.col("id").alias("rid"), F.lit(0).cast("long").alias("first"), F.lit(seg).cast("binary").alias("seg"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = suffix._counted_repeats(rows, 40).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(key, before)
    assert len(got) == 4000 == len({r["doc_id"] for r in got}) and {(r["lo"], r["hi"]) for r in got} == {(0, 40)}
    assert max(Counter(r["task"] for r in got).values()) <= 2000


def test_sorting_matches_sorted():
    for _ in range(200):
        some = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(90))) for _ in range(rng.randrange(1, 30))]
        some += [b"a" * 60 + x for x in some] + some[:3]
        order, lcp = suffix.sort_strings(some)
        in_order = [some[i] for i in order]
        assert in_order == sorted(some)
        assert lcp[1:].tolist() == [suffix.common(a, b) for a, b in zip(in_order[:-1], in_order[1:], strict=True)]


def test_quality(docs, rows, empty):
    got = quality.judged(docs)
    assert listed(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == brute.op10(rows)
    assert got.filter("kept and base_failed").count() == 0
    kept = {(r["policy"], r["without"]): r["kept"] for r in quality.ablations(got).collect()}
    for version, rules in quality.POLICIES.items():
        assert kept[version, None] == quality.ledger(docs).filter(quality.passes(version)).count()
        assert all(kept[version, r] >= kept[version, None] for r in rules)
    assert quality.judged(empty).count() == 0


def test_language(spark, empty):
    kinds = {"aa": "bada bidi bodo", "oo": "grost flint krumm"}
    some = [(i, " ".join(rng.choice(kinds[k].split()) + rng.choice("xyz") for _ in range(30)), k) for i in range(60) for k in [rng.choice(["aa", "oo"])]]
    some += [(100, None, "aa"), (101, "", None), (102, "123 !!", "oo"), (103, some[0][1] + " " + some[1][1], None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(some, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in some[:60])
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values()) and any(r["held_out"] for r in got.values())
    assert langid.identify(empty).count() == 0
    mixed = spark.createDataFrame([(900, "bada bidi bodo " * 20 + "grost flint krumm " * 20, None)], "doc_id long, text string, lang string")
    model = langid.fit(spark.createDataFrame(some, "doc_id long, text string, lang string"))
    shares = langid.predict(mixed, model).first()["languages"]
    assert {x["lang"] for x in shares} == {"aa", "oo"} and all(0.4 < x["share"] < 0.6 for x in shares)


def test_substrings(docs, empty):
    got = {(r["doc_id"], r["start"], r["end"]): r for r in substring.removed(docs).collect()}
    caught = {i for i, *_ in got}
    assert {10, 11, 12, 13} <= caught and not caught & set(range(9))
    cut = {r["doc_id"]: r["text"] for r in substring.without_repeats(docs).collect()}
    assert cut[9] == PASSAGE and len(cut) == len(TEXTS) and cut[0] == ""
    assert substring.removed(empty).count() == 0 and substring.without_repeats(empty).count() == 0


def test_substrings_against_brute_force(spark, rows):
    """Passages pasted into other text, of every length around the limits, and self-repeats: nothing goes that brute force
    keeps, a line goes whole, and a passage keeps at most ``SPREAD - 1`` words at each end."""
    own = [f"w{i}" for i in range(200)]
    some = list(enumerate([t for _, t in rows] + [" ".join(own)]))
    pasted = {}
    for n in (24, 25, 36, 51, 70):
        for at in (0, 33, 120):
            before = prose(15)
            pasted[len(some)] = (len(before.split()), n)
            some.append((len(some), f"{before} {' '.join(own[at : at + n]).upper()}  {prose(15)}"))
    line = len(some)
    some += [(line, "one\n " + " ".join(own[:60]) + "\nother"), (line + 1, " two\n" + " ".join(own[:60]) + "\nmore"), (line + 2, "Z. " * 60), (line + 3, " ".join(own[:80] * 2))]
    got = {}
    for r in substring.removed(spark.createDataFrame(some, "doc_id long, text string").repartition(3)).collect():
        text = some[r["doc_id"]][1]
        at = len(text[: r["start"]].split())
        got.setdefault(r["doc_id"], set()).update(range(at, at + len(text[r["start"] : r["end"]].split())))
    want = brute.op7(some)
    assert all(places <= want[i] for i, places in got.items())
    for i, (at, n) in pasted.items():
        gone = got.get(i, set())
        assert gone <= set(range(at, at + n)) and (n < 33 or len(gone) >= n - 2 * (substring.SPREAD - 1)) and (n > 24 or not gone)
    assert got[line + 1] == set(range(1, 61)) and set(range(88, 152)) <= got[line + 3]


def test_frequent_keys_are_set_apart(spark, rows, monkeypatch):
    """Joins that broadcast frequent keys give the same rows."""
    from tidemark.llm import common

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = [listed(f(df), "doc_id", c) for f, c in ((substring.without_repeats, "text"), (lines.drop_common_lines, "text"), (suffix.remove_repeats, "kept"))]
    monkeypatch.setattr(common, "SELDOM", 1)
    assert before == [listed(f(df), "doc_id", c) for f, c in ((substring.without_repeats, "text"), (lines.drop_common_lines, "text"), (suffix.remove_repeats, "kept"))]


def test_decontamination(spark, docs, empty):
    words = [f"{rng.choice(WORDS)}{rng.choice(WORDS)}".lower() for _ in range(40)]
    changed = [w if i % 9 else "other" for i, w in enumerate(words)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "short one")], "item_id long, text string")
    some = spark.createDataFrame([(1, prose(20) + " " + " ".join(words) + " " + prose(20)), (2, " ".join(changed).upper()), (3, prose(200)), (4, None), (5, " ".join(words[:6])), (6, " ".join(reversed(words)))], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(some, bench).collect()} == {(1, 1), (2, 1)}
    assert sorted(r["doc_id"] for r in decontam.clean(some, bench).collect()) == [3, 4, 5, 6]
    assert decontam.leaks(docs, bench).count() == 0 and decontam.leaks(empty, bench).count() == 0 and decontam.leaks(some, bench.limit(0)).count() == 0


def test_toxicity_learns_pairs():
    """Each of two words alone is harmless: only the machine's pairs can tell."""
    import numpy as np

    found, labels = [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        noise = {toxicity.terms(rng.choice(WORDS))[0] for _ in range(3)}
        found.append(np.array(sorted(noise | ({11} if a else set()) | ({12} if b else set()))))
        labels.append(float(a and b))
    machine = toxicity.train(found, np.array(labels))
    place = machine.place()
    score = toxicity.probability(machine.raw(np.array([place[11], place[12], place[11], place[12]]), np.array([0, 0, 1, 2]), 3))
    assert score[0] > 0.5 > max(score[1:])


def test_toxicity_on_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.scored(docs, none)
    assert got.count() == len(TEXTS) and got.filter("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.scored(empty, none).count() == 0


def test_pipeline(spark, tmp_path, docs):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not out & {0, 1, 2, 3, 9, 10, 11, 12, 13} and {8, 16} <= out
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "decontaminate", "encode"]


def test_language_stage_rejects_by_likelihood(spark):
    """Garbled and foreign text goes, short and mixed text stays, and nothing with letters goes if no language is known."""
    a, b = ([f"{x}{y}" for x in first for y in second] for first, second in ((("ba", "di", "go"), ("na", "ro", "le")), (("schu", "ver", "ein"), ("ung", "keit", "lich"))))
    some = [(i, " ".join(rng.choice(v) for _ in range(200)), k) for i in range(60) for v, k in ((a, "aa"), (b, "bb"))]
    some = [(n, t, k) for n, (_, t, k) in enumerate(some)]
    garbled = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600))
    some += [(500, garbled, "aa"), (501, "\u043f\u0440\u0438\u0432\u0435\u0442 " * 40, None), (502, "xq zj", None), (503, " ".join(a * 8 + b * 8), None), (504, "12 !", "aa"), (505, None, "aa")]
    df = spark.createDataFrame(some, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in stages.language(spark, df, "").collect()}
    assert kept == {*range(120), 502, 503}
    kept = {r["doc_id"] for r in stages.language(spark, df.withColumn("lang", F.lit(None).cast("string")), "").collect()}
    assert kept == {*range(120), 500, 501, 502, 503}


def test_line_stage_returns_every_row(spark):
    """Ten equal documents lose their lines, not their rows."""
    df = spark.createDataFrame([(i, "same\ntext", 9) for i in range(10)] + [(10, "same\nown", 8), (11, None, 0)], "doc_id long, text string, n_chars int")
    assert sorted(tuple(r) for r in stages.line_dedup(spark, df, "").collect()) == [(i, "", 0) for i in range(10)] + [(10, "own", 3), (11, "", 0)]


def test_masks_fit_every_allowed_pattern(spark):
    """Every set of differing words that the rule allows, by enumeration; some of them and short items through Spark."""
    for n in range(1, decontam.RUN + 1):
        bad = n - -(-decontam.PERCENT * n // 100) if n >= decontam.SPAN else 0
        for gone in combinations(range(n), bad):
            assert any(not {p + k for k in m} & set(gone) for m in decontam.masks_for(n) for p in range(n - m[-1])), (n, gone)
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (3, 7, 8, 12, 13)}
    some = [(13, {1, 6, 8}), (13, {4, 5, 6}), (12, {2, 5, 8}), (8, {0, 4}), (7, {0}), (7, {6}), (3, set()), (3, {1}), (13, {0, 1, 2, 3})]
    rows = [(i, " ".join(["before", *("other" if k in gone else w for k, w in enumerate(items[n])), "after"])) for i, (n, gone) in enumerate(some)]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(i, n) for i, (n, _) in enumerate(some[:7])}


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_decontamination_against_all_alignments(spark, limit):
    """Items of 1 to 30 words pasted with substitutions, and cut at either end, by broadcast and by shuffle."""
    items = [(n, " ".join(f"{rng.choice(WORDS)}{rng.choice(WORDS)}" for _ in range(n))) for n in (1, 2, 5, 6, 7, 9, 12, 13, 14, 20, 30)]
    rows = [(0, None), (1, "")]
    for _, text in items:
        for share in (0, 0.1, 0.2, 0.3):
            w = [x if rng.random() >= share else "zz" for x in text.split()]
            lo, hi = rng.choice([(0, len(w)), (len(w) // 3, len(w)), (0, 2 * len(w) // 3 + 1)])
            rows.append((len(rows), f"{prose(9)} {' '.join(w[lo:hi])} {prose(9)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench, limit).collect()}
    assert got == brute.op8(rows, items)


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_decontamination_of_repeated_rows_and_ids(spark, limit):
    """Items that share an id, a null item id, repeated rows on both sides and documents without an id."""
    one, two = (" ".join(f"{rng.choice(WORDS)}{rng.choice(WORDS)}{n}{k}" for k in range(20)) for n in "ab")
    bench = spark.createDataFrame([(1, one), (1, two), (1, one), (None, two)], "item_id long, text string")
    docs = spark.createDataFrame([(1, one), (1, one), (2, f"{prose(9)} {two}"), (None, one), (None, prose(30)), (3, prose(30))], "doc_id long, text string")
    got = decontam.leaks(docs, bench, limit)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, 13, 13, 0), (2, 1, 13, 13, 9), (2, None, 13, 13, 9), (None, 1, 13, 13, 0)], key=str)
    kept = decontam.clean(docs, bench).select("doc_id", "text")
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.filter("doc_id is null or doc_id = 3").collect()))


def test_toxicity_learns_pairs_of_neutral_terms():
    """Two words of which exactly one makes a text toxic: neither tells anything by itself, and both are kept."""
    import numpy as np

    found, labels = [], []
    for _ in range(2000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        noise = {toxicity.terms(rng.choice(WORDS))[0] for _ in range(3)}
        found.append(np.array(sorted(noise | ({11} if a else set()) | ({12} if b else set()))))
        labels.append(float(a != b))
    machine = toxicity.train(found, np.array(labels))
    place = machine.place()
    assert place[11] >= 0 and place[12] >= 0
    score = toxicity.probability(machine.raw(np.array([place[11], place[12], place[11], place[12]]), np.array([0, 1, 2, 2]), 4))
    assert min(score[0], score[1]) > 0.5 > max(score[2], score[3])


def test_toxicity_scores_equal_the_sum_over_pairs(spark):
    """The machine's value by its definition, pair by pair, under a fixed model."""
    import numpy as np

    words = ["alpha", "bravo", "charliedelta", "echo"]
    kept = np.array(sorted({t for w in words for t in toxicity.terms(w)}))
    gen = np.random.default_rng(3)
    machine = toxicity.Machine(kept, -0.3, gen.normal(size=len(kept)), gen.normal(size=(len(kept), toxicity.FACTORS)))
    rows = [(0, None), (1, ""), (2, "alpha"), (3, "Alpha bravo, bravo!"), (4, "charliedelta echo other alpha bravo")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), machine).collect()}
    for i, text in rows:
        at = sorted({kept.tolist().index(t) for w in (text or "").split() for t in toxicity.terms(w) if t in kept})
        value = machine.bias + sum(machine.weights[k] for k in at) + sum(float(machine.factors[a] @ machine.factors[b]) for a, b in combinations(at, 2))
        assert abs(got[i] - 1 / (1 + np.exp(-value))) < 1e-9


def test_mixture_against_a_grid():
    """The chosen languages and shares against a search of all sets and a grid of shares."""
    import numpy as np

    gen = np.random.default_rng(4)
    for true in ((1, 0, 0), (0.5, 0.5, 0), (0, 0.3, 0.7)):
        logs = gen.normal(-8, 1, (300, 3))
        logs[np.arange(300), gen.choice(3, 300, p=true)] += 6
        best = max((np.log(np.exp(logs) @ np.array([a, b, 1 - a - b]).clip(0)).sum() - langid.PENALTY * np.log(300) * (sum(x > 0 for x in (a, b, 1 - a - b)) - 1), (a, b, 1 - a - b)) for a in np.linspace(0, 1, 21) for b in np.linspace(0, 1 - a, round((1 - a) * 20) + 1))[1]
        assert np.abs(langid.infer(logs) - np.array(best)).max() < 0.06


def test_stages_alone(spark, docs, tmp_path):
    """Each stage keeps the columns' values, also under names that operators use, and takes empty tables and null languages."""
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = docs.select("*", *[F.lit(42).alias(c) for c in ("score", "n_dropped", "lang_pred", "kept", "component_id", "hit", "seed", "p", "q")]).drop("n_lines").withColumn("n_lines", F.lit(77))
    values = {c: own.first()[c] for c in ("score", "n_lines", "n_dropped", "lang_pred", "kept", "component_id", "hit", "seed", "p", "q", "rid", "h")}
    for name, stage in stages.STAGES[:-1]:
        for some in (own, own.withColumn("lang", F.lit(None).cast("string"))):
            got = stage(spark, some, str(tmp_path))
            assert got.columns == own.columns
            found = got.collect()
            assert 10 < len(found) <= len(TEXTS) and all(r[c] == v for r in found for c, v in values.items()), name
        assert stage(spark, own.limit(0), str(tmp_path)).count() == 0
    assert stages.encode(spark, own.limit(0), str(tmp_path)).count() == 0
