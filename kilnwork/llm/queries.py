"""The registered queries of this package: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kilnwork.llm import decontaminate, langid, licenses, linededup, neardup, packing, quality, substrings, tokenfiles, urlfilter
from kilnwork.llm.shared import new_path, table


def tokenizer_path(name: str) -> str:
    """Where the machine's public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.Rule(shingle=3, numerator=85, denominator=100))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    tokenfiles.write(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 0, path)
    return tokenfiles.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), {rule: verdict == "block" for verdict, rule in urlfilter.RULES})


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round("containment", 6))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = linededup.bitmaps(docs)
    return linededup.apply(docs, runs).select("doc.doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("line_dedup.kept_text", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_near_dedup": op3_near_dedup,
    "op4_token_files": op4_token_files,
    "op5_url_filter": op5_url_filter,
    "op6_decontamination": op6_decontamination,
    "op7_license_scan": op7_license_scan,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_rules": op10_quality_rules,
}

_HOST, _PATH = r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)", r"regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fits(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"(host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '{slash}{path}')"


_RULE_CASE = "CASE " + " ".join(f"WHEN {_fits(r)} THEN '{r}'" for _, r in sorted(urlfilter.RULES, key=lambda x: -len(x[1]))) + " END"


def _shingles(name: str, table_name: str) -> str:
    """Distinct five-word shingles of a table's texts, as text."""
    return f"""SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN ['#' || array_to_string(w, ' ')] ELSE [] END) AS s
        FROM (SELECT {name} AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {table_name})"""


ORACLES: dict[str, str] = {
    "op5_url_filter": f"""
        WITH parts AS (SELECT page_id, coalesce(translate({_HOST}, '{_UPPER}', '{_LOWER}'), '') AS host, coalesce({_PATH}, '') AS path FROM pages),
        ruled AS (SELECT page_id, host, path, {_RULE_CASE} AS rule FROM parts)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ({", ".join(f"'{r}'" for v, r in urlfilter.RULES if v == "block")}) THEN 'block' ELSE 'allow' END AS verdict FROM ruled""",
    "op6_decontamination": f"""
        WITH d AS ({_shingles("doc_id", "documents")}), b AS ({_shingles("item_id", "benchmark")}), n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
        SELECT d.id AS doc_id, b.id AS item_id, any_value(n) AS n_item_shingles, count(*) AS n_shared, round(count(*) / any_value(n), 6) AS containment
        FROM d JOIN b ON d.s = b.s JOIN n ON b.id = n.id GROUP BY d.id, b.id HAVING 5 * count(*) >= 4 * any_value(n)""",
    "op9_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
        keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM lines),
        repeated AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        judged AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
}
