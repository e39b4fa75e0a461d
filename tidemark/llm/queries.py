"""Thin queries that apply the operators of this subpackage, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, fingerprints, html_text, licenses, mixing, ngram_join, quality, secrets, substring_dedup, token_counts
from tidemark.session import ship


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(text: Column | str) -> Column:
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encoded(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    ids = F.btrim(F.replace(F.col("ids").cast("string"), F.lit(", "), F.lit(" ")), F.lit("[]"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256(ids).alias("ids_sha256"), sha256("decoded").alias("decoded_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scheduled(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", sha256("kept").alias("kept_sha256"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.edited(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", sha256("edited").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.secrets(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        "doc_id", count("assign"), count("access"), count("hex"), sha256(secrets.listed(F.col("base"))).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"), "n_live", "n_copied"
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *[F.col(f"m.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", F.array_join("failed", ",").alias("failed_rules"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_mixing, op3_html, op4_token_counts, op5_substring_dedup, op6_ngram_join, op7_fingerprints, op8_secrets, op9_licenses, op10_quality)}


def _secrets_sql() -> str:
    """The scan in SQL, with patterns of its own: pieces between matches and the matches themselves give the positions."""
    more = {
        "jwt": r"eyJ[-_A-Za-z0-9]{8,}[.][-_A-Za-z0-9]{8,}[.][-_A-Za-z0-9]{8,}",
        "bearer": r"(?:B|b)earer [-~+/._A-Za-z0-9]{20,}",
        "hosting": r"gh(?:p|o|u|s|r)_[0-9A-Za-z]{36,}",
        "chat": r"xox(?:a|b|p|r|s)-[-0-9A-Za-z]{10,}",
        "payment": r"(?:s|r)k_live_[0-9A-Za-z]{16,}",
        "cloud": r"AIza[-_0-9A-Za-z]{35}",
        "private_key": r"-----BEGIN [ A-Z]{0,20}PRIVATE KEY-----[0-9A-Za-z+/=\x20\x09\x0A\x0C\x0D]*",
        "url_login": r"://[^:/@\x20\x09\x0A\x0C\x0D]{1,64}:[^:/@\x20\x09\x0A\x0C\x0D]{1,64}@",
    }

    def part(pattern: str, no: str, kind: str, group: int, least: int) -> str:
        return f"""SELECT rid, {no} AS kind_no, {kind} AS kind, value, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s, length(hit) AS n
FROM (SELECT rid, gaps, hits, unnest(hits) AS hit, unnest(vals) AS value, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT rid, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals FROM docs WHERE regexp_matches(t, '{pattern}'))) WHERE length(value) >= {least}"""

    def which(values: list[str]) -> str:
        return "CASE " + " ".join(f"WHEN regexp_matches(hit, '^(?:{p})') THEN {v}" for p, v in zip(more.values(), values, strict=True)) + " END"

    parts = [
        part(r"""(?:(?i)password|passwd|secret|token|api_?key)[""\x27]?\x20*[:=]\x20*[""\x27]?([-A-Za-z0-9+/_.=]+)""".replace('""', '"'), "0", "'assign'", 1, 8), part("AKIA[0-9A-Z]{12,}", "1", "'access'", 0, 16), part("[a-f0-9]{32,}", "2", "'hex'", 0, 32),
        part("|".join(f"(?:{p})" for p in more.values()), which([str(k) for k in range(3, 11)]), which([f"'{name}'" for name in more]), 0, 0),
    ]
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
owners AS (SELECT value, count(DISTINCT coalesce('=' || source, 'null')) AS n_owners, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'null')) AS n_repos FROM found JOIN docs USING (rid) GROUP BY value),
listed AS (SELECT rid, kind_no, kind || ':' || s || ':' || (s + n) AS span, s, s + n AS e, n_owners = 1 OR n_owners = 2 AND n_repos < 20 AS live FROM found JOIN owners USING (value)),
by_row AS (SELECT rid, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
string_agg(span, ',' ORDER BY s, kind_no, e) FILTER (kind_no < 3) AS base, string_agg(span, ',' ORDER BY s, kind_no, e) FILTER (kind_no < 3 OR live) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM listed GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM docs LEFT JOIN by_row USING (rid)"""


SQL: dict[str, str] = {
    "op5_substring_dedup": r"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) > 12)),
m AS (SELECT k, min(doc_id) AS d FROM g GROUP BY k),
p AS (SELECT rid, list(DISTINCT i + j) AS ps FROM (SELECT rid, i FROM g JOIN m USING (k) WHERE doc_id > d), range(13) AS t(j) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(coalesce(array_to_string(list_filter(ws, lambda x, n: NOT list_contains(coalesce(ps, []), n)), ' '), '')) AS kept_sha256 FROM w LEFT JOIN p USING (rid)""",
    "op8_secrets": _secrets_sql(),
}
