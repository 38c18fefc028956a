"""Pairs of two sides in cells. A cell's left rows are held while its right rows
stream past them, and numpy decides a block of pairs at a time. Pairs come out of
the last step: none is shuffled, and what is shuffled are the rows of both sides.
Where a key may have very many rows on both sides, they are packed into blocks that
meet in a cross join instead (:func:`crossed`), so no row is shuffled more than twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Rows of each side in a block of pairs, and pairs in a batch that is handed on.
LEFT, RIGHT, OUT = 512, 1024, 32_768
#: Left rows that a cell holds at most.
HELD = 32_768
#: Bytes of a packed block at most (but one row at least), blocks that a side has
#: at least and the rows these need, and blocks of a partition.
PACKED_BYTES, SOME, WORTH, TOGETHER = 4 << 20, 32, 256, 8
#: Words in fewer than one of so many pairs of a block are counted pair by pair.
RARE = 200

Kernel = Callable[[pa.RecordBatch, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def met(left: DataFrame, right: DataFrame, kernel: Kernel, schema: str, order: str | None = None) -> DataFrame:
    """``kernel`` over the left and the right rows of every ``cell`` (string) that
    has both; a cell has at most about HELD left rows, and any number of right ones.
    The rows of either side come by ``order``, if it is given."""
    spark = left.sparkSession
    ship(spark)

    def side(df: DataFrame, own: str) -> DataFrame:
        rows = {k: F.struct(*[c for c in d.columns if c != "cell"]) for k, d in (("l", left), ("r", right))}
        empty = {k: F.lit(None).cast(d.drop("cell").schema) for k, d in (("l", left), ("r", right))}
        return df.select("cell", F.lit(own == "r").alias("side"), *[(rows[k] if k == own else empty[k]).alias(k) for k in "lr"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    dealt = side(left, "l").union(side(right, "r")).repartition(n, "cell").sortWithinPartitions("cell", "side", *([F.coalesce(f"l.{order}", f"r.{order}")] if order else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in groupby(_pieces(batches), key=lambda p: p[0]):
            held = []
            for _, is_right, rows in pieces:
                if not is_right:
                    held.append(rows)
                    continue
                if held:
                    yield from kernel(pa.Table.from_batches(held).combine_chunks().to_batches()[0], chain([rows], (p[2] for p in pieces)))
                break

    return dealt.mapInArrow(run, schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bool, pa.RecordBatch]]:
    """(cell, is it the right side, rows) in order."""
    for b in batches:
        if not b.num_rows:
            continue
        runs, start = pc.run_end_encode(b["cell"]), 0
        for end, cell in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
            middle = end - (pc.sum(b["side"].slice(start, end - start)).as_py() or 0)
            for k, at, to in (("l", start, middle), ("r", middle, end)):
                if to > at:
                    rows = b[k].slice(at, to - at)
                    yield cell, k == "r", pa.RecordBatch.from_arrays(rows.flatten(), [f.name for f in rows.type])
            start = end


def dealt(left: DataFrame, right: DataFrame, keys: list[str], by: str, held: int | None = None, few_keys: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides with their ``cell``: the left rows of a key are dealt by a column
    to parts of about ``held`` (HELD), the right ones go to all parts. ``few_keys``
    says that the numbers of parts may be broadcast."""
    parts = left.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(held or HELD)).cast("int").alias("_parts"))
    parts = F.broadcast(parts) if few_keys else parts
    cell = F.concat_ws("\x01", *[F.col(k).cast("string") for k in keys], F.col("_part").cast("string")).alias("cell")
    a = left.join(parts, keys).withColumn("_part", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"))
    b = right.join(parts, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return a.select(cell, *[c for c in left.columns if c not in keys]), b.select(cell, *[c for c in right.columns if c not in keys])


def crossed(left: DataFrame, right: DataFrame, meets: Column | None, kernel: Kernel, schema: str, order: tuple[list[str], list[str]], rows: int) -> DataFrame:
    """``kernel`` over blocks of at most ``rows`` rows that ``meets`` lets meet. The
    rows of each side are packed by its ``order``; of a block ``meets`` sees, with l_
    or r_ before it, the least and the last ``at`` (lo and hi, rows without one
    being before all others), whether any row has none (untimed), and the first and
    the last ``name``, if there is one. Blocks are read anew by each task of the
    cross join and never copied to disk, so what is shuffled grows with the rows of
    both sides."""
    ship(left.sparkSession)
    packed = [_packed(left, order[0], rows)]
    packed.append(packed[0] if left is right and order[0] == order[1] else _packed(right, order[1], rows))
    a, b = (t.select(*[F.col(c).alias(f"{k}_{c}") for c in PACK_COLUMNS]) for k, t in zip("lr", packed, strict=True))
    pairs = a.hint("shuffle_replicate_nl").join(b, F.lit(True) if meets is None else meets).select("l_id", "l_rows", "r_rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = ((i, b["l_rows"][k], b["r_rows"][k]) for b in batches for k, i in enumerate(b["l_id"].to_pylist()))
        for _, same in groupby(met, key=lambda p: p[0]):
            _, first, other = next(same)
            yield from kernel(_unpacked(first), chain([_unpacked(other)], (_unpacked(p[2]) for p in same)))

    return pairs.mapInArrow(run, schema)


PACK_COLUMNS = ("id", "lo", "hi", "untimed", "first", "last", "rows")
PACK_SCHEMA = "id long, lo double, hi double, untimed boolean, first string, last string, rows binary"


def _packed(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Blocks of rows that follow each other, dealt evenly; few rows make smaller blocks."""
    total = df.count()
    rows = min(rows, max(WORTH, -(-total // SOME)))
    n = -(-total // rows)
    together = min(TOGETHER, max(1, n // (2 + int((4 * df.sparkSession.sparkContext.defaultParallelism) ** 0.5))))
    n = max(1, -(-n // together))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(partial(_pack, rows), PACK_SCHEMA).repartition(n)


def _pack(rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n, size, number = [], 0, 0.0, TaskContext.get().partitionId() << 32
    for b in batches:
        at, each = 0, b.nbytes / max(1, b.num_rows)
        while at < b.num_rows:
            if n and (n >= rows or size + each > PACKED_BYTES):
                yield _pack_of(held, number)
                held, n, size, number = [], 0, 0.0, number + 1
            take = min(b.num_rows - at, rows - n, max(1, int((PACKED_BYTES - size) / max(1.0, each))))
            held.append(b.slice(at, take))
            at, n, size = at + take, n + take, size + take * each
    if n:
        yield _pack_of(held, number)


def _pack_of(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    at = micros(t["at"])
    untimed = bool(np.isnan(at).any())
    at = np.nan_to_num(at, nan=-np.inf)
    first, last = (t["name"][0].as_py(), t["name"][-1].as_py()) if "name" in t.column_names else (None, None)
    row = [[number], [at.min()], [at.max()], [untimed], pa.array([first], pa.string()), pa.array([last], pa.string()), pa.array([out.getvalue().to_pybytes()], pa.binary())]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in row], list(PACK_COLUMNS))


def _unpacked(rows: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(rows.as_buffer()).read_next_batch()


def everyone(c: str) -> Column:
    """One key for all rows, which the optimiser does not see as a constant, so that
    joins on it stay hash joins."""
    return F.pmod(F.xxhash64(c), F.lit(1)).alias("all")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = RIGHT) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def spans(n: int, rows: int = LEFT) -> Iterator[slice]:
    return (slice(at, min(n, at + rows)) for at in range(0, n, rows))


class Overlap:
    """How many words the lists of two sides share, by blocks of left rows. Words
    of many pairs are counted as a product of matrices, the others one by one."""

    def __init__(self, left: pa.ListArray, right: pa.ListArray):
        words = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False)
        sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (left, right)]
        self.row_a, self.row_b = (np.repeat(np.arange(len(s)), s) for s in sizes)
        a, b = code[: len(self.row_a)], code[len(self.row_a) :]
        self.starts = np.concatenate([[0], np.cumsum(sizes[0])])
        in_a, in_b = (np.bincount(x, minlength=len(words.dictionary)).astype(float) for x in (a, b))
        self.n_b = len(right)
        dense = (in_a * in_b > len(left) * len(right) / RARE).nonzero()[0]
        at = np.full(len(words.dictionary), -1)
        at[dense] = np.arange(len(dense))
        self.a, self.b = (np.zeros((n, len(dense)), np.float32) for n in (len(left), len(right)))
        for m, rows, c in ((self.a, self.row_a, a), (self.b, self.row_b, b)):
            k = at[c] >= 0
            m[rows[k], at[c[k]]] = 1
        # the others: of each word its right rows, one after another
        order = np.argsort(b, kind="stable")
        self.right = self.row_b[order]
        self.first = np.searchsorted(b[order], np.arange(len(words.dictionary)))
        self.times = np.where(at >= 0, 0, in_b).astype(np.int64)
        self.code = a
        self.any = bool((in_a * in_b).any())

    def block(self, span: slice) -> np.ndarray:
        if not self.any:
            return np.zeros((span.stop - span.start, self.n_b), np.float32)
        found = self.a[span] @ self.b.T
        tokens = slice(self.starts[span.start], self.starts[span.stop])
        code, row = self.code[tokens], self.row_a[tokens] - span.start
        times = self.times[code]
        total = int(times.sum())
        if total:
            ahead = np.repeat(np.cumsum(times) - times, times)
            right = self.right[np.arange(total) - ahead + np.repeat(self.first[code], times)]
            np.add.at(found.ravel(), np.repeat(row, times) * self.n_b + right, np.float32(1))
        return found


def matrices(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length of vectors the rows that have it and the vectors at unit
    length; zeros stay zeros, and rows without a vector are in none."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat, starts = vectors.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(size) - size
    found = {}
    for n in np.unique(size[size > 0]).tolist():
        rows = (size == n).nonzero()[0]
        v = flat[starts[rows][:, None] + np.arange(n)]
        length = np.sqrt((v * v).sum(1, keepdims=True))
        found[n] = rows, np.divide(v, length, out=np.zeros_like(v), where=length != 0)
    return found


def rows_in(found: dict[int, tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Which of ``n`` rows have a vector."""
    has = np.zeros(n, bool)
    for rows, _ in found.values():
        has[rows] = True
    return has


def dots(a: dict[int, tuple[np.ndarray, np.ndarray]], b: dict[int, tuple[np.ndarray, np.ndarray]], span: slice, n_b: int) -> np.ndarray:
    """Cosines of left rows in ``span`` and all right rows; NaN where their
    vectors have no common length."""
    found = np.full((span.stop - span.start, n_b), np.nan)
    for n, (rows, v) in a.items():
        if n in b:
            lo, hi = np.searchsorted(rows, (span.start, span.stop))
            if hi - lo == len(found) and len(b[n][0]) == n_b:
                return v[lo:hi] @ b[n][1].T
            found[np.ix_(rows[lo:hi] - span.start, b[n][0])] = v[lo:hi] @ b[n][1].T
    return found


def micros(times: pa.Array) -> np.ndarray:
    """Microseconds as doubles, which hold them exactly; NaN where there is none."""
    return np.asarray(times.to_numpy(zero_copy_only=False), float)
