"""Scalar text functions, all as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed stop list of the lexical tokeniser.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "do", "for", "from", "has", "have", "in", "is", "it", "its",
    "not", "of", "on", "or", "that", "the", "this", "to", "was", "were", "which", "with", "you", "your",
)
#: Fixed: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EMAIL = r"[\w._%+\-]+@[\w.\-]+\.[a-zA-Z]{2,}"
TEST_CASE = r"(?i)\bTC_[A-Z][A-Za-z0-9_]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_email(c: Column | str) -> Column:
    """First address in the text, lower-cased (unwraps markdown links); else the
    trimmed text; '' for nothing."""
    c = F.coalesce(_col(c), F.lit(""))
    found = F.regexp_extract(c, EMAIL, 0)
    return F.lower(F.when(found != "", found).otherwise(F.trim(c)))


def parse_issue_time(c: Column | str) -> Column:
    """ISO-8601 with or without fraction and offset, as UTC; null if unparsable."""
    c = F.trim(_col(c))
    forms = ("yyyy-MM-dd'T'HH:mm:ss.SSSXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ssXXX")
    bare = ("yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in (*forms, *bare)])


def parse_report_time(c: Column | str) -> Column:
    """Test-report time stamps, with or without milliseconds."""
    c = _col(c)
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyyMMdd HH:mm:ss.SSS")), F.try_to_timestamp(c, F.lit("yyyyMMdd HH:mm:ss")))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds, to three places; 0.0 where either end is missing."""
    return F.coalesce(F.bround((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6), 3), F.lit(0.0))


def days_between(a: Column, b: Column) -> Column:
    """Absolute difference in fractional days."""
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(86_400e6)


def tokens(c: Column | str) -> Column:
    """Set of lower-case alphanumeric tokens of two or more letters without the
    stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_except(F.filter(found, lambda t: F.length(t) >= 2), F.array(*map(F.lit, STOP_WORDS)))


def stem_tokens(test_name: Column | str) -> Column:
    """Tokens of a test name's parts, without the TC prefix."""
    parts = F.array_remove(F.split(F.lower(_col(test_name)), "_+"), "tc")
    return tokens(F.array_join(parts, " "))


def preprocess_message(c: Column | str) -> Column:
    """Messages made comparable: punctuation off, lone numbers NUM, single
    letters dropped; _empty_ if nothing is left."""
    c = _col(c)
    t = F.translate(F.lower(c), "—–", "  ")
    t = F.translate(t, PUNCTUATION, "")
    t = F.regexp_replace(t, r"(?U)\b\d+\b", "NUM")
    t = F.regexp_replace(t, r"(?U)\b\w\b", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(c.isNull() | (t == ""), "_empty_").otherwise(t)


def tag_at(tags: Column | str, position: int) -> Column:
    """Element of a JSON array, null where there is none."""
    parsed = F.from_json(_col(tags), "array<string>")
    return F.get(parsed, position)


def json_list(c: Column | str) -> Column:
    return F.coalesce(F.from_json(_col(c), "array<string>"), F.array().cast("array<string>"))


def reason_tags(c: Column | str) -> Column:
    """Parts of a match reason."""
    return F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")


def test_case_names(c: Column | str) -> Column:
    """Set of test-case names mentioned in a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(TEST_CASE), F.lit(0)), lambda t: F.lower(t)))


def defect_embed_text(summary: Column, description: Column) -> Column:
    """Summary, a blank line, the first 512 code points of the description."""
    cut = F.trim(F.substring(F.coalesce(description, F.lit("")), 1, 512))
    return F.concat_ws("\n\n", F.nullif(F.trim(F.coalesce(summary, F.lit(""))), F.lit("")), F.nullif(cut, F.lit("")))


def result_embed_text(test_name: Column, keyword: Column, message: Column) -> Column:
    keyword = F.nullif(keyword, F.lit(""))
    return F.concat_ws(" | ", F.nullif(test_name, F.lit("")), F.concat(F.lit("keyword: "), keyword), F.nullif(message, F.lit("")))


def build_suffix(run_id: Column | str) -> Column:
    """Trailing number of a run id, null where there is none."""
    return F.nullif(F.regexp_extract(_col(run_id), r"(\d+)$", 1), F.lit("")).cast("double")


def short_run(run_id: Column | str) -> Column:
    n = F.nullif(F.regexp_extract(_col(run_id), r"(\d+)$", 1), F.lit("")).cast("long").cast("string")
    return F.coalesce(n, _col(run_id))


def issue_url(base: str, key: Column | str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/browse/"), _col(key))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """The vector at length 1; zeros stay zeros. Once per row, so that a pair's
    cosine is one product."""
    made = F.transform(F.array(F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("n"))), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] == 0, 0.0).otherwise(x.cast("double") / s["n"])))
    return F.get(made, 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors, 0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)
