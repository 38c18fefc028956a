"""The corpus pipeline: five stages from raw documents to shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes every stage's rows as Parquet below ``spark.checkpoint.dir`` and rereads
them as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import decontaminate, mixing, near_copies, sharding, toxicity
from pulsegrid.llm.shared import keep


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that are more likely toxic than not go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of copies stays."""
    return near_copies.without_near_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: each document as often as the mix takes it."""
    return mixing.mixed(docs)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the mix as a compacted, versioned set of shards, and where
    each row lies in it. The set stands in a new folder below the one named by
    ``spark.pulsegrid.shards``; where none is named, it goes with the session."""
    kept = spark.conf.get("spark.pulsegrid.shards", None)
    out = sharding.sharded(docs, destination=f"{kept}/{uuid.uuid4().hex}" if kept else None)
    return out.select("doc_id", "source", "n_chars", "shard", "shard_row")


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", write_shards),
]

#: SQL expresses neither the trained model nor the bit-sliced comparison; the
#: stages are tested against brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
