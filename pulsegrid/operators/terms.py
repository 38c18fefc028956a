"""TF-IDF of failure messages as a long table (doc, term, weight)."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def english_stop_words() -> list[str]:
    """Spark's own list; the reference's library has another, so the vocabulary
    may differ in function words."""
    return StopWordsRemover.loadDefaultStopWords("english")


def _counts(docs: DataFrame, stop_words: list[str] | None) -> DataFrame:
    """(doc, term, tf) of words of two or more letters without stop words, and of
    their neighbouring pairs."""
    stop = english_stop_words() if stop_words is None else stop_words
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    if stop:
        words = F.filter(words, lambda w: ~F.array_contains(F.array(*map(F.lit, stop)), w))
    t = docs.select("doc", words.alias("w"))
    pairs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(F.col("w"), i + 1)))
    return t.select("doc", F.explode(F.concat("w", pairs)).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def _idf(docs: DataFrame, tf: DataFrame, max_features: int, min_df: int) -> DataFrame:
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    n = F.broadcast(docs.agg(F.countDistinct("doc").alias("n")))
    chosen = df.orderBy(F.desc("total"), "term").limit(max_features).crossJoin(n)  # n is one row
    return chosen.select("term", (F.ln((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def vocabulary(docs: DataFrame, max_features: int = 500, min_df: int = 2, stop_words: list[str] | None = None) -> DataFrame:
    """(term, idf): the ``max_features`` most frequent terms (ties by term) of at
    least ``min_df`` documents, idf ln((1+n)/(1+df))+1."""
    return _idf(docs, _counts(docs, stop_words), max_features, min_df)


def tfidf(docs: DataFrame, max_features: int = 500, min_df: int = 2, sublinear: bool = True, stop_words: list[str] | None = None) -> DataFrame:
    """``docs`` (doc, text) to (doc, term, weight) over :func:`vocabulary`; rows
    have unit length."""
    tf = _counts(docs, stop_words)
    known = F.broadcast(_idf(docs, tf, max_features, min_df))  # a bound by construction
    count = (F.lit(1.0) + F.ln("tf")) if sublinear else F.col("tf").cast("double")
    raw = tf.join(known, "term").select("doc", "term", (count * F.col("idf")).alias("raw"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", (F.col("raw") / length).alias("weight"))


def top_terms(weights: DataFrame, groups: DataFrame, n: int = 8) -> DataFrame:
    """Per group of documents the terms of the largest mean weight above 0;
    ``groups`` is (doc, grp)."""
    size = groups.groupBy("grp").agg(F.countDistinct("doc").alias("size"))
    t = weights.join(groups, "doc").groupBy("grp", "term").agg(F.sum("weight").alias("s")).join(size, "grp")
    t = t.withColumn("score", F.col("s") / F.col("size")).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(F.round("score", 9)), "term"))
    return t.withColumn("rank", rank).filter(F.col("rank") <= n).select("grp", "rank", "term", "score")
