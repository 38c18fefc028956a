"""SimHash near-duplicates with bit-sliced comparison.

Fingerprint: XXH64 (seed 42) of every word shingle, majority per bit. Distinct
fingerprints are bucketed by every pair of r + 2 bit blocks: fingerprints within
r bits leave at least two of the blocks untouched, so each linked pair meets in
some bucket and no link is lost. Inside a bucket the bit planes are stored
vertically, one machine word per 64 fingerprints; distances of 64 lanes are
added at once by carry-save counters, and blocks whose lanes have all passed the
radius are abandoned.

Buckets of any size are dealt to cells of bounded size, a bucket emits a
spanning forest and never its pairs, and only distinct fingerprints take part,
so copies cost nothing beyond their fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import as_bytes, batches, columns_only, join_counted, keep, ship

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Rows of a bucket that meet in one task; larger buckets are dealt to cells.
CELL = 2048
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(data: bytes, words: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one UTF-8 text, as an unsigned integer."""
    parts = data.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        h = [digest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        end = np.cumsum(sizes + 1) - 1
        start = end - sizes
        h = [digest(joined[a:b], SEED) for a, b in zip(start.tolist(), end[words - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        bits = np.unpackbits(np.array(h[k : k + 4096], "<u8").view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer; null and
    empty texts have fp 0."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.array([simhash(x, words) for x in as_bytes(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    ship(docs.sparkSession)
    return columns_only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def hex_digits(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- bit-sliced distances -------------------------------------------------


def planes(fp: np.ndarray) -> np.ndarray:
    """64 rows of bit planes; bit i of word j is that bit of fingerprint 64j+i."""
    words = -(-len(fp) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8), bitorder="little").reshape(-1, 64)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


class _Counter:
    """Vertical carry-save counters with a sticky overflow, as wide as the radius
    needs."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.radius = radius
        self.c = [np.zeros(shape, np.uint64) for _ in range(radius.bit_length())]
        self.over = np.zeros(shape, np.uint64)

    def add(self, bit: np.ndarray) -> None:
        for c in self.c:
            carry = c & bit
            c ^= bit
            bit = carry
        self.over |= bit

    def beyond(self) -> np.ndarray:
        """Lanes that have passed the radius."""
        more = np.zeros_like(self.over)
        equal = np.full_like(self.over, _ONES)
        for k in reversed(range(len(self.c))):
            if self.radius >> k & 1:
                equal &= self.c[k]
            else:
                more |= equal & self.c[k]
                equal &= ~self.c[k]
        return more | self.over

    def take(self, at: np.ndarray) -> None:
        self.c = [c[at] for c in self.c]
        self.over = self.over[at]


def _lanes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bit position of every set bit of a vector of words."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little").reshape(len(words), 64)
    return np.nonzero(bits)


def near_within(fp: np.ndarray, radius: int = RADIUS, queries: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of one bucket that differ in at most ``radius``
    bits: 256 queries at a time against all words of the planes. With ``queries``,
    only those whose i is less."""
    stored = planes(fp)
    ends = len(fp) if queries is None else queries
    for q in range(0, ends, 256):
        asked = fp[q : min(q + 256, ends)]
        first = q // 64
        rows, word = (x.ravel() for x in np.meshgrid(np.arange(len(asked)), np.arange(first, stored.shape[1]), indexing="ij"))
        count = _Counter(rows.shape, radius)
        for p in range(64):
            flip = np.where(asked >> np.uint64(p) & np.uint64(1), _ONES, np.uint64(0))
            count.add(stored[p][word] ^ flip[rows])
            if p % 8 == 7 and p < 63:
                left = np.nonzero(count.beyond() != _ONES)[0]
                if len(left) < 0.75 * len(rows):
                    rows, word = rows[left], word[left]
                    count.take(left)
                if not len(rows):
                    break
        if len(rows):
            at, lane = _lanes(~count.beyond())
            i, j = rows[at] + q, word[at] * 64 + lane
            ok = (i < j) & (j < len(fp))
            yield i[ok], j[ok]


def near_shifted(fp: np.ndarray, group: np.ndarray, most: int, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for many small groups at once: rows are sorted by group and lane
    i is compared to lane i + d for d below the largest group size ``most``
    (at most 64)."""
    stored = np.pad(planes(fp), ((0, 0), (0, 1)))
    n = len(fp)
    for d in range(1, min(most, n)):
        same = np.zeros(stored.shape[1] * 64 - 64, bool)
        same[: n - d] = group[: n - d] == group[d:]
        valid = np.packbits(same, bitorder="little").view(np.uint64)
        word = np.nonzero(valid)[0]
        if not len(word):
            return
        count = _Counter(word.shape, radius)
        for p in range(64):
            a, b = stored[p][word], stored[p][word + 1]
            moved = b if d == 64 else (a >> np.uint64(d)) | (b << np.uint64(64 - d))
            count.add(a ^ moved)
            if p % 8 == 7 and p < 63:
                left = np.nonzero(valid[word] & ~count.beyond())[0]
                if len(left) < 0.75 * len(word):
                    word = word[left]
                    count.take(left)
                if not len(word):
                    break
        if len(word):
            at, lane = _lanes(valid[word] & ~count.beyond())
            i = word[at] * 64 + lane
            yield i, i + d


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Labels of the components that the pairs make of 0..n-1, smallest first."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            low = np.minimum(label[i], label[j])
            if (label[i] == label[j]).all():
                break
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def bucket_links(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp) that connect what the buckets of sorted ``group`` connect."""
    edge = np.nonzero(np.diff(group))[0] + 1
    start, stop = np.concatenate([[0], edge]), np.concatenate([edge, [len(group)]])
    size = stop - start
    out: list[tuple[np.ndarray, np.ndarray]] = []
    small = np.repeat((size > 1) & (size <= 64), size)
    if small.any():
        f, g = fp[small], group[small]
        label = forest(len(f), near_shifted(f, g, int(size[(size > 1) & (size <= 64)].max()), radius))
        moved = np.nonzero(label != np.arange(len(f)))[0]
        out.append((f[moved], f[label[moved]]))
    for a, b in zip(start[size > 64], stop[size > 64], strict=True):
        f = fp[a:b]
        label = forest(len(f), near_within(f, radius))
        moved = np.nonzero(label != np.arange(len(f)))[0]
        out.append((f[moved], f[label[moved]]))
    if not out:
        return fp[:0], fp[:0]
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _link_partition(radius: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, fp) sorted by key and cell: bounded runs of whole groups."""
    held: tuple[np.ndarray, np.ndarray] | None = None

    def links(fp: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        a, b = bucket_links(fp.view(np.uint64), group, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    last = 0
    for t in batches(it, 1 << 17):
        key, cell, fp = (t.column(k).to_numpy() for k in range(3))
        new = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(cell) != 0)])
        if held is not None:
            new[0] = (key[0], cell[0]) != held_key
        group = np.cumsum(new) + last
        last = int(group[-1])
        if held is not None:
            fp, group = np.concatenate([held[0], fp]), np.concatenate([held[1], group])
        held_key = (key[-1], cell[-1])
        cut = int(np.searchsorted(group, last))
        if cut:
            yield links(fp[:cut], group[:cut])
        held = (fp[cut:], group[cut:])
    if held is not None:
        yield links(*held)


def blocks(radius: int) -> list[tuple[int, int]]:
    """(start, width) of radius + 2 bit blocks."""
    cut = [round(64 * k / (radius + 2)) for k in range(radius + 3)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def link_forest(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose components
    are those of all pairs within ``radius`` bits."""

    def block(at: int, width: int) -> Column:
        return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))

    keys = [
        F.lit(t << 32) + F.shiftleft(block(*x), 16) + block(*y) for t, (x, y) in enumerate(combinations(blocks(radius), 2))
    ]
    met = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    size = met.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # buckets above CELL rows become a triangle of cells of bounded size
    size = keep(size.withColumn("parts", F.ceil(F.col("n") / CELL).cast("int")), "buckets", "lz4_raw")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    placed = join_counted(met, size, "key", "n", "inner").withColumn("part", part)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.least("part", "other").cast("long") * F.lit(1 << 31) + F.greatest("part", "other")
    dealt = placed.select("key", cell.alias("cell"), "fp").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(partial(_link_partition, radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id whose fingerprint can be reached over
    links of at most RADIUS differing bits, the document's own included. Null
    and empty texts share fingerprint 0; repeated rows give repeated rows; rows
    of null doc_id are linked like any other, but a null is never the smallest
    id unless the component has no other; an empty table gives an empty result;
    other columns are ignored.
    """
    fps = keep(fingerprints(docs), "fp", "lz4_raw")
    distinct = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "distinct", "lz4_raw")
    roots = keep(connected_components(link_forest(distinct)), "roots", "lz4_raw").select(F.col("node").alias("fp"), "root")
    placed = keep(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed", "lz4_raw")
    least = keep(placed.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("m")), "least", "lz4_raw")
    known = keep(join_counted(placed.select("fp", "n", "root"), least, "root", "m").select("fp", "n", "component_id"), "known", "lz4_raw")
    return join_counted(fps, known, "fp", "n").select("doc_id", "fp", "component_id")
