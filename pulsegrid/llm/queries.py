"""The registered queries of this package, one per operator.

Each takes (spark, sf_dir), applies its operator with production parameters to
the whole table and returns the digest columns of its contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_labeller, importance, line_dedup, mixing, periodic, secrets, set_join, sharding, simhash, tokens, toxicity, winnow
from .shared import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables name no repository, so each document stands for one, and its
    source for the owner."""
    return secrets.secret_report(_table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("source"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated_lines(_table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprint_report(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in four arrivals of unlike sizes, compacted as they come."""
    out = sharding.sharded(_table(spark, sf_dir, "documents"), arrivals=4)
    return out.select("doc_id", "n_chars", "shard", "shard_row")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "coverage", "kind")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return tokens.token_report(_table(spark, sf_dir, "documents"), str(tokenizer_path), new_path(spark, "tokens"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_labeller.extracted(_table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.similar_sets(_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_sharding": op4_sharding,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_token_files": op7_token_files,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_toxicity": op10_toxicity,
    "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_periodic_runs": op13_periodic_runs,
}


#: Fixed patterns and thresholds of op1, written out again so that its SQL does
#: not follow a mistake in the operator.
_SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]{16,}"),
    ("vendor", r"(?:gh[pousr]_|xox[abprs]-|sk-|eyJ)[A-Za-z0-9_.-]{16,}"),
    ("opaque", r"[A-Za-z0-9+/_=-]{20,}"),
)


def _secret_sql() -> str:
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def found(kind: int) -> str:
        name, pattern = _SECRETS[kind]
        return f"""SELECT doc_id, source, {kind} AS ord, '{name}' AS kind, m[i] AS match,
            cast(list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS bigint) AS start
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, source, regexp_extract_all(t, {quoted(pattern)}) AS m, string_split_regex(t, {quoted(pattern)}) AS g
            FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)))"""

    listed = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord)"
    return f"""WITH raw AS ({" UNION ALL ".join(map(found, range(len(_SECRETS))))}),
        cand AS (SELECT *, start + length(match) AS stop FROM (SELECT *, CASE WHEN ord = 0 THEN regexp_extract(match, {quoted(_SECRETS[0][1])}, 2) ELSE match END AS value FROM raw)
            WHERE (ord <> 0 OR length(value) >= 12) AND (ord <> 1 OR length(match) >= 18) AND (ord <> 4 OR (regexp_matches(match, '[0-9]') AND regexp_matches(match, '[A-Za-z]')))),
        held AS (SELECT value, CASE WHEN owners >= 3 OR owners > 1 AND repos >= 10 THEN 'copied' WHEN owners > 1 THEN 'shared' ELSE 'owned' END AS standing
            FROM (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repos FROM cand GROUP BY 1)),
        judged AS (SELECT * FROM cand JOIN held USING (value)),
        stays AS (SELECT * FROM judged j WHERE ord < 3 OR ((ord = 3 AND standing <> 'copied' OR ord = 4 AND standing = 'owned')
            AND NOT EXISTS (SELECT 1 FROM cand b WHERE b.doc_id = j.doc_id AND b.ord < 3 AND b.start < j.stop AND j.start < b.stop)))
        SELECT d.doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
            sha256({listed} FILTER (ord < 3), '')) AS base_sha256, {listed}, '') AS spans, count(*) FILTER (standing = 'owned') AS n_owned, count(*) FILTER (standing = 'copied') AS n_copied
        FROM documents d LEFT JOIN stays s ON s.doc_id = d.doc_id GROUP BY 1"""


#: DuckDB forms of the queries that SQL can express. The others use a trained
#: model, a hash that DuckDB lacks, files, or more than SQL does in time.
ORACLE_SQL: dict[str, str] = {"op1_secret_scan": _secret_sql()}
