"""Plumbing that the corpus operators share: durable scratch tables, joins that
survive hot keys, and Arrow helpers.

Scratch tables are Parquet folders below the session's ``spark.checkpoint.dir``,
which every executor can read, so a lost executor costs a re-read and never a
re-computation of the lineage.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship  # noqa: F401  for the operators

#: A key is hot when it holds more than one row in HOT_SHARE; there can be at
#: most HOT_SHARE such keys, which is what bounds their broadcast.
HOT_SHARE = 1000

#: White space of the byte-level contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one is
    set only where a session in one process names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="pulsegrid-")
        spark.sparkContext.setCheckpointDir(base)
    root = f"{base.rstrip('/')}/pulsegrid-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_forget, spark, root)
    return root


_roots: set[str] = set()


def _forget(spark: SparkSession, root: str) -> None:
    try:
        if not spark.sparkContext._jsc.sc().isStopped():
            drop(spark, root)
    except Exception:  # the session is gone, and with it the right to clean up
        return


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the Hadoop file system that owns it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str = "t", codec: str = "zstd") -> DataFrame:
    """Writes ``df`` as a scratch table and returns the table; the path is at
    ``.scratch_path`` for those who want to drop it early."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    for t in tables:
        drop(t.sparkSession, t.scratch_path)


def join_counted(rows: DataFrame, stats: DataFrame, key: str, count: str, how: str = "left") -> DataFrame:
    """``rows`` joined to ``stats`` (one row per ``key``) where a key may hold any
    share of the rows.

    ``stats[count]`` is the number of rows with the key. Keys above one row in
    HOT_SHARE number at most HOT_SHARE, so their stats are broadcast; all other
    keys meet in a shuffled join of evenly small groups. Both inputs are read
    twice, so pass scratch tables. ``count`` is dropped from the result.
    """
    total = stats.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > F.lit(total / HOT_SHARE)
    few, many = F.broadcast(stats.filter(hot).drop(count)), stats.filter(~hot).drop(count)
    return rows.join(few, key).unionByName(
        rows.join(F.broadcast(stats.filter(hot).select(key)), key, "left_anti").join(many, key, how)
    )


#: Bits of a bitmap over hashes: its size does not grow with what it holds.
FILTER_BITS = 1 << 26


def hash_bitmap(wanted: DataFrame, column: str) -> np.ndarray:
    """Bitmap of a column of 64-bit hashes, put together on the executors; at most
    FILTER_BITS / 32 words reach the driver."""
    h = F.col(column)
    word = F.shiftright(h.bitwiseAND(F.lit(FILTER_BITS - 1)), 5).alias("word")
    bit = F.expr(f"shiftleft(1L, cast({column} & 31 as int))")
    found = wanted.groupBy(word).agg(F.bit_or(bit).alias("mask")).toArrow()
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    table[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.uint32)
    return table


def in_bitmap(table: np.ndarray, h: int) -> bool:
    low = h & FILTER_BITS - 1
    return bool(int(table[low >> 5]) >> (low & 31) & 1)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def columns_only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else the table carries."""
    return df.select(*[df[n] for n in names])


def batches(it: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Arrow batches gathered to at least ``rows`` rows each."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in it:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


#: Rows that a part of ascending ids is meant to hold.
PART_ROWS = 250_000


def id_parts(docs: DataFrame, parts: int | None = None) -> np.ndarray:
    """Ascending first ids of parts 1 and on, near the quantiles of doc_id, of as
    many parts as the session has shuffle partitions, or more where a part would
    hold more than PART_ROWS; the scans read the id column only."""
    n = parts or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PART_ROWS))
    at = [k / n for k in range(1, n)]
    found = (docs.agg(F.percentile_approx("doc_id", at, 10 * n)).first()[0] or []) if at else []
    return np.array(sorted(set(found)), np.int64)


def part_of(ids: pa.Array, first: np.ndarray) -> np.ndarray:
    """The part of each id; nulls belong to the last."""
    at = np.searchsorted(first, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
    return np.where(np.asarray(ids.is_valid()), at, len(first)).astype(np.int32)
