"""The embedding cache: one vector for each entity and model, made in batches by
an encoder of the caller's, again only where it is missing or its text has
changed."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import ship
from .state import insert_replace

#: Texts to vectors, in order; runs in the Python workers.
Encoder = Callable[[list[str]], np.ndarray]
BATCH = 64


def hashing_encoder(texts: list[str], dim: int = 64) -> np.ndarray:
    """Unit vectors of hashed words; stands in where no model is at hand."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, t in zip(out, texts, strict=True):
        for word in t.lower().split():
            h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
            row[h % dim] += 1 if h & 1 << 31 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def entities(defects: DataFrame, results: DataFrame) -> DataFrame:
    """(entity_id, entity_type, source_text) of all defects and failures; those
    without any text have an empty one."""
    d = defects.select(F.col("defect_id").alias("entity_id"), F.lit("jira_defect").alias("entity_type"), text.defect_embed_text(F.col("summary"), F.col("description")).alias("source_text"))
    failed = results.filter("status = 'FAIL'")
    words = text.result_embed_text(F.col("test_name"), F.col("failure_kw"), F.col("failure_msg"))
    return d.unionByName(failed.select(F.col("result_id").alias("entity_id"), F.lit("test_result").alias("entity_type"), words.alias("source_text")))


def pending(wanted: DataFrame, cache: DataFrame, model_name: str, force: bool = False, stale: bool = True) -> DataFrame:
    """Rows of ``wanted`` that ``cache`` has no vector for by this model; with
    ``stale`` also those whose text has changed, with ``force`` all."""
    if force:
        return wanted
    keys = ["entity_id", "entity_type", *(["source_text"] if stale else [])]
    return wanted.join(cache.filter(F.col("model_name") == model_name).select(*keys).distinct(), keys, "left_anti")


def attempted(rows: DataFrame, encoder: Encoder = hashing_encoder, batch: int = BATCH) -> DataFrame:
    """(entity_id, entity_type, source_text, vector, error): ``encoder`` is given at
    most ``batch`` texts at a time. Where it raises, the batch's texts are tried
    one by one, and those that fail have an error and no vector."""
    ship(rows.sparkSession)

    def tried(texts: list[str]) -> list[tuple[np.ndarray | None, str | None]]:
        try:
            return [(np.asarray(v, np.float32), None) for v in encoder(texts)]
        except Exception as e:  # noqa: BLE001  an encoder may fail on some texts
            if len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            return [x for t in texts for x in tried([t])]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, batch):
                some = b.slice(at, batch)
                vectors, errors = zip(*tried([t or "" for t in some.column(2).to_pylist()]), strict=True)
                made = [pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays([*some.columns, *made], ["entity_id", "entity_type", "source_text", "vector", "error"])

    made = rows.select("entity_id", "entity_type", F.coalesce("source_text", F.lit("")).alias("source_text"))
    return made.mapInArrow(run, "entity_id string, entity_type string, source_text string, vector array<float>, error string")


def encoded(rows: DataFrame, model_name: str, encoder: Encoder = hashing_encoder, batch: int = BATCH) -> DataFrame:
    """Rows of the embeddings table; texts that the encoder fails on are not among
    them and are pending still (:func:`attempted` has their errors)."""
    made = attempted(rows, encoder, batch).filter("error is null")
    return made.select("entity_id", "entity_type", F.lit(model_name).alias("model_name"), "vector", "source_text", F.current_timestamp().alias("created_at"))


def refreshed(cache: DataFrame, wanted: DataFrame, model_name: str, encoder: Encoder = hashing_encoder, force: bool = False, batch: int = BATCH) -> DataFrame:
    """The cache with a vector for every row of ``wanted``, of which only the
    pending ones are encoded."""
    new = encoded(pending(wanted, cache, model_name, force), model_name, encoder, batch)
    return insert_replace(cache, new, ["entity_id", "model_name"])
