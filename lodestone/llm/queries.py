"""Registered queries of this subpackage: thin digests of the operators' outputs, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, language, lines, mixing, packing, quality, repeats, similarity, token_file, winnow
from .common import table

END_ID, PACK_END_ID = 0, 2


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = winnow.compared_with_next(table(spark, sf_dir, "documents"))
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), winnow.as_string(F.col("sel")).alias("fingerprint"),
        winnow.as_string(F.col("edited_sel")).alias("edited_fingerprint"), "near_edited", "near_next",
        winnow.positions(F.col("sel")).alias("positions"), winnow.positions(F.col("edited_sel")).alias("edited_positions"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_file.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return token_file.read_token_files(manifest)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "web-1")
    failed = F.col("failed_bits").bitwiseAND(quality.mask(quality.BASE)) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "failed_bits")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), packing.CAPACITY, PACK_END_ID, bound="lower_bound")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return docs.drop("_row")


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "text", "n_lines", "n_dropped")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_winnowing": op1_winnowing,
    "op2_token_file": op2_token_file,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_source_mix": op7_source_mix,
    "op8_repeated_strings": op8_repeated_strings,
    "op9_line_dedup": op9_line_dedup,
    "op10_html_extraction": op10_html_extraction,
}

#: Words in 3-word windows found twice or more, and the other measurements, of table {docs}.
QUALITY_SQL = r"""
w AS (SELECT k, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) AS i FROM src),
g AS (SELECT k, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
d AS (SELECT k, i, count(*) OVER (PARTITION BY k, w, w2, w3) AS c FROM g WHERE w3 IS NOT NULL),
p AS (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) - i AS gap FROM d WHERE c > 1),
rep AS (SELECT k, sum(least(3, coalesce(gap, 3))) AS n FROM p GROUP BY k),
ln AS (SELECT k, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM src),
dl AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (SELECT src.*, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words,
  length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS n_symbols,
  coalesce(dl.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(dl.n_lines, 0) AS n_lines
  FROM src LEFT JOIN rep USING (k) LEFT JOIN dl USING (k)),
led AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN word_chars < 3 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 12 * n_words THEN 32 ELSE 0 END) AS bits FROM m)
"""

ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": "WITH src AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents), " + QUALITY_SQL + """
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, bits::INTEGER AS failed_bits FROM led""",
    "op6_jaccard_join": r"""
WITH RECURSIVE src AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT k, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM src),
n AS MATERIALIZED (SELECT k, count(*) AS n FROM sh GROUP BY k),
l AS MATERIALIZED (SELECT a.k AS a, b.k AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.k <> b.k GROUP BY a.k, b.k),
e AS MATERIALIZED (SELECT a, b FROM l JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT k, k AS t FROM src UNION SELECT r.k, e.b FROM r JOIN e ON r.t = e.a)
SELECT src.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM r JOIN src ON src.k = r.k JOIN src o ON o.k = r.t LEFT JOIN n ON n.k = r.k GROUP BY src.k, src.doc_id""",
    "op9_line_dedup": r"""
WITH src AS (SELECT row_number() OVER () AS k, doc_id, source, text FROM documents),
ln AS (SELECT k, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM src),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM ln),
c AS (SELECT source, key, count(DISTINCT k) AS n FROM t WHERE key <> '' GROUP BY source, key),
s AS (SELECT source, count(*) AS n FROM src GROUP BY source),
b AS (SELECT c.source, c.key FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source WHERE c.n >= 5 AND 100 * c.n > 5 * s.n),
f AS (SELECT t.*, b.key IS NOT NULL AS gone FROM t LEFT JOIN b ON b.key = t.key AND b.source IS NOT DISTINCT FROM t.source),
a AS (SELECT k, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS text, count(*) FILTER (key <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped FROM f GROUP BY k)
SELECT src.doc_id, CASE WHEN src.text IS NOT NULL THEN coalesce(a.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped FROM src LEFT JOIN a USING (k)""",
}
