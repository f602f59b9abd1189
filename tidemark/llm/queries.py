"""Queries of this package: ``(spark, sf_dir) -> DataFrame`` each, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fim, langid, lines, minhash, quality, substring, suffix, token_store, toxicity, transducer, vector_codes
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and their decoding for every document."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' places and checksums, read back from the packed store."""
    return token_store.crc(token_store.round_trip(table(spark, sf_dir, "documents"), TOKENIZER))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more documents share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "languages")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their repeated 400-byte strings."""
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages removed because they stand earlier in the corpus."""
    return substring.removed(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdict of every document."""
    return quality.judged(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrangement of every document, and the text rebuilt from it."""
    return fim.digests(fim.transformed(table(spark, sf_dir, "documents")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every usable vector."""
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by ranks, and their decoding, for every document."""
    return transducer.digests(table(spark, sf_dir, "documents"), RANKS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_token_store": op2_token_store,
    "op3_minhash": op3_minhash,
    "op4_line_dedup": op4_line_dedup,
    "op5_language": op5_language,
    "op6_suffix": op6_suffix,
    "op7_substring": op7_substring,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_vector_codes": op12_vector_codes,
    "op13_byte_bpe": op13_byte_bpe,
}

#: Characters that keys and words are stripped of or split at, and the letters that are lowered: fixed values.
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = f"translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds of ``op12_vector_codes``, one after the other."""
    near = """SELECT vec_id, part, entry, d FROM (SELECT v.vec_id, v.part, b.entry, d, row_number() OVER (PARTITION BY v.vec_id, v.part ORDER BY d, b.entry) AS r
        FROM v JOIN b{r} b USING (part), LATERAL (SELECT list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))::BIGINT AS d)) WHERE r = 1"""
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda e: floor(4096 * e::DOUBLE)::BIGINT) AS ints FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"v AS (SELECT vec_id, part, ints[part * len(ints) // {parts} + 1:(part + 1) * len(ints) // {parts}] AS x FROM kept, range({parts}) AS p(part))",
        f"b0 AS (SELECT part, entry, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id))",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED ({near.format(r=r)})",
            f"s{r} AS (SELECT part, entry, place, sum(x[place])::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id, part), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS place) GROUP BY ALL)",
            f"m{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS x FROM s{r} GROUP BY part, entry)",
            f"b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (part, entry))",
        ]
    steps += [
        f"last AS MATERIALIZED ({near.format(r=rounds)})",
        "coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM last GROUP BY vec_id)",
        f"books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books"


SQL: dict[str, str] = {
    "op11_fill_in_middle": """
        WITH units AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
        drawn AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units),
        cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
        parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
        FROM parts""",
    "op12_vector_codes": _vector_codes_sql(),
    "op4_line_dedup": f"""
        WITH lines AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
        keyed AS (SELECT doc_id, pos, line, {_KEY} AS key FROM lines),
        common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN common c USING (key) GROUP BY doc_id""",
    "op10_quality": r"""
        WITH words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS p FROM words),
        grams AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS g FROM starts),
        again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
        covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM again, range(8) AS r(k) GROUP BY doc_id),
        measured AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
            len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_full_lines,
            len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM words LEFT JOIN covered c USING (doc_id)),
        based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 4 * n_full_lines OR word_chars > 25 * n_words OR word_chars < 2 * n_words) AS kept,
          CAST(n_words < 20 AS INTEGER) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS INTEGER) + 4 * CAST(10 * n_symbols > 3 * n_words AS INTEGER) + 8 * CAST(10 * n_dup_lines > 4 * n_full_lines AS INTEGER) + 16 * CAST(word_chars > 25 * n_words OR word_chars < 2 * n_words AS INTEGER) AS failures
        FROM based""",
}
