"""Removal of near copies: one document of each group stays.

Texts are sets of word 5-shingles. Those that are at least SIMILARITY alike meet
in a bucket: a bucket holds the texts that agree in one of BANDS bands of ROWS
min-hashes, which a pair of similarity 0.8 does with probability 0.998 and one
of 0.9 with 0.9999999. Inside a bucket the bit-sliced comparison of
:mod:`.simhash` passes over the fingerprints of the shingles, at a radius that
spares pairs of that similarity. Odd sketches of the shingle sets decide what is
clearly alike or clearly not; what lies between is decided on the whole sets.

A bucket emits a spanning forest of its links, never its pairs, and a group is
what the links connect. Larger buckets than a cell lose no link: all rows are
first compared to a few leaders; those like the leader that most rows are like
are linked by that already, and need not be compared to each other. What is left
is compared to all rows of the bucket, dealt to cells of bounded size. So a
bucket of copies of one text costs as much as it has rows.

A cell names the texts of its open pairs, once each, and no pairs. Once the clear
links are known, cells whose open texts they have connected are done with; the
texts of the others meet again with their whole sets, and a second forest joins
the groups of the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import as_bytes, batches, columns_only, hash_bitmap, in_bitmap, join_counted, keep, ship
from .simhash import SEED, forest, near_shifted, near_within

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 5
#: Differing bits of two fingerprints that the sketches still look at: shingle
#: sets that are 0.8 alike differ in 9.7 of 64 bits, unlike ones in 32.
RADIUS = 22
#: Smallest shingle hashes that a sketch stands for, and its bits.
SKETCH, SKETCH_BITS = 512, 1024
#: Rows of a bucket that meet in one task, and leaders of a larger bucket.
CELL, LEADERS = 512, 16
#: Words, and described texts, that a Python worker remembers.
CACHE, TEXTS = 300_000, 10_000
#: Shingles that are hashed at a time.
CHUNK = 1 << 14
#: How far from SIMILARITY an estimate is clear: of sets that a sketch holds whole
#: (more for small ones, where one collision of bits counts), and of larger ones,
#: over three standard errors each.
MARGIN, SAMPLED_MARGIN = 0.03, 0.08
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_SEEDS = np.array([xxhash.xxh64_intdigest(str(k), SEED) | 1 for k in range(BANDS * ROWS)], np.uint64)


class _Words(dict):
    """word -> its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(data: bytes, known: dict[bytes, int]) -> np.ndarray:
    """Hashes of a text's word 5-shingles, in order; a text of fewer words is one
    shingle."""
    parts = data.lower().split()
    words = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    n = max(1, len(parts) - WORDS + 1)
    with np.errstate(over="ignore"):
        h = np.full(n, min(len(parts), WORDS), np.uint64)
        for k in range(min(len(parts), WORDS)):
            h = _mixed((h + words[k : k + n]) * _STEP)
    return h


def fingerprint(h: np.ndarray) -> int:
    """SimHash of shingle hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key for each band of min-hashes."""
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(h), CHUNK):
            x = h[None, k : k + CHUNK] * _SEEDS[:, None]
            np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1), out=least)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for x in least.reshape(BANDS, ROWS).T:
            key = _mixed((key + x) * _STEP)
    return key


def odd_sketch(distinct: np.ndarray) -> bytes:
    """Parities of the bits that the SKETCH smallest of the sorted hashes fall on."""
    odd = np.bincount((distinct[:SKETCH] & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def likeness(odd_a: np.ndarray, odd_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarities of shingle sets, from rows of sketch words and the
    sets' sizes. The parities that differ tell how many hashes only one of two
    sketches has; a sketch of a larger set is a sample of it. The standard error
    is below 0.01 for sets of up to SKETCH shingles and 0.024 beyond."""
    apart = np.bitwise_count(odd_a ^ odd_b).sum(axis=1, dtype=np.int64)
    only_one = -SKETCH_BITS / 2 * np.log1p(-2 * np.minimum(apart, SKETCH_BITS // 2 - 1) / SKETCH_BITS)
    both = (np.minimum(size_a, SKETCH) + np.minimum(size_b, SKETCH) - only_one) / 2
    both = np.maximum(both, 0) * np.maximum(1, np.maximum(size_a, size_b) / SKETCH)
    return np.where(apart == 0, np.minimum(size_a, size_b) / np.maximum(size_a, size_b), both / np.maximum(size_a + size_b - both, 1e-9))


def judged(odd_a: np.ndarray, odd_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs are clearly alike, and which are open."""
    less, more = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    margin = np.where(more > SKETCH, SAMPLED_MARGIN, MARGIN + 2 / np.maximum(more, 1))
    found = likeness(odd_a, odd_b, size_a, size_b)
    possible = less >= SIMILARITY * more
    sure = possible & (found >= SIMILARITY + margin)
    return sure, possible & ~sure & (found >= SIMILARITY - margin)


_TEXT = "node long, fp long, size int, odd binary, keys array<long>"


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, node, fp, size, odd, keys) of every row: node stands for its text."""
    ship(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, texts = _Words(), {}
        for b in it:
            rows = []
            for data in as_bytes(b.column(1)):
                node = xxhash.xxh64_intdigest(data, SEED)
                row = texts.get(node)
                if row is None:
                    if len(texts) >= TEXTS:
                        texts.clear()
                    h = shingles(data, known)
                    distinct = np.unique(h)
                    row = texts[node] = (node, fingerprint(h), len(distinct), odd_sketch(distinct), band_keys(distinct))
                rows.append(row)
            node, fp, size, odd, keys = zip(*rows, strict=True) if rows else [()] * 5
            flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
            columns = [
                b.column(0).cast(pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)), pa.array(size, pa.int32()),
                pa.array(odd, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), pa.array(flat)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "fp", "size", "odd", "keys"])

    return columns_only(docs, "doc_id", "text").mapInArrow(run, f"doc_id long, {_TEXT}")


def cell_links(fp: np.ndarray, size: np.ndarray, odd: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices (i, j) of a spanning forest of what is clearly alike within the
    groups of sorted ``group``, and the sorted indices that stand in an open pair
    of two trees."""
    edge = np.nonzero(np.diff(group))[0] + 1
    start, stop = np.concatenate([[0], edge]), np.concatenate([edge, [len(group)]])
    count = stop - start
    parts: list[tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]] = []
    small = np.flatnonzero(np.repeat((count > 1) & (count <= 64), count))
    if len(small):
        parts.append((small, near_shifted(fp[small], group[small], int(count[(count > 1) & (count <= 64)].max()), RADIUS)))
    parts += [(np.arange(a, b), near_within(fp[a:b], RADIUS)) for a, b in zip(start[count > 64].tolist(), stop[count > 64].tolist(), strict=True)]
    links, unsettled = [(small[:0], small[:0])], [small[:0]]
    for base, pairs in parts:
        label = np.arange(len(base))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in pairs:
            for k in range(0, len(i), 1 << 15):
                x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
                a, b = base[x], base[y]
                sure, unclear = judged(odd[a], odd[b], size[a], size[b])
                held.append((x[unclear], y[unclear]))
                label[:] = forest(len(label), iter([(label[x[sure]], label[y[sure]])]))[label]
        moved = np.flatnonzero(label != np.arange(len(base)))
        links.append((base[moved], base[label[moved]]))
        for x, y in held:
            apart = label[x] != label[y]
            unsettled += [base[x[apart]], base[y[apart]]]
    return np.concatenate([x for x, _ in links]), np.concatenate([x for _, x in links]), np.unique(np.concatenate(unsettled))


def _groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of whole groups of rows sorted by key and cell, the first columns."""
    held: pa.Table | None = None
    for t in batches(it, 1 << 14):
        t = pa.concat_tables([held, t]) if held is not None else t
        key, cell = t.column(0).to_numpy(), t.column(1).to_numpy()
        end = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
        cut = int(end[-1]) + 1 if len(end) else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).combine_chunks()
    if held is not None and len(held):
        yield held


def _columns(t: pa.Table) -> tuple[np.ndarray, ...]:
    """key, group number, node, fp, size, odd of rows (key, cell, node, fp, size,
    odd, ...)."""
    key, cell, node, fp, size = (t.column(k).to_numpy() for k in range(5))
    odd = np.frombuffer(b"".join(t.column(5).to_pylist()), "<u8").reshape(len(t), -1)
    group = np.cumsum(np.concatenate([[0], (np.diff(key) != 0) | (np.diff(cell) != 0)]))
    return key, group, node, fp.view(np.uint64), size.astype(np.int64), odd


def _cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and cell: links (a, b) that connect what is clearly alike
    in a cell, and the texts (a, again) of its open pairs; cells of the same open
    texts have the same ``again``."""
    for t in _groups(it):
        _, group, node, fp, size, odd = _columns(t)
        i, j, unsettled = cell_links(fp, size, odd, group)
        yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.nulls(len(i), pa.int64())], ["a", "b", "again"])
        for some in np.split(unsettled, np.flatnonzero(np.diff(group[unsettled])) + 1):
            named = np.sort(node[some])
            again = np.full(len(named), xxhash.xxh64_intdigest(named.tobytes(), SEED), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(named), pa.nulls(len(named), pa.int64()), pa.array(again)], ["a", "b", "again"])


def _led(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and cell, with whether they are there as leaders: (key,
    node, leader) where a row is clearly like a leader of its bucket."""
    for t in _groups(it):
        key, group, node, fp, size, odd = _columns(t)
        leads = t.column(6).to_numpy()
        edge = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(group)], strict=True):
            order = a + np.argsort(~leads[a:b], kind="stable")
            for i, j in near_within(fp[order], RADIUS, int(leads[a:b].sum())):
                x, y = order[i], order[j]
                ok = ~leads[y] & (node[x] != node[y]) & judged(odd[x], odd[y], size[x], size[y])[0]
                x, y = x[ok], y[ok]
                yield pa.RecordBatch.from_arrays([pa.array(key[y]), pa.array(node[y]), pa.array(node[x])], ["key", "node", "leader"])


def _dealt(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (key, cell, node, ...) with what describes the texts, whole cells to a
    task."""
    met = rows.join(texts.select("node", "fp", "size", "odd"), "node")
    more = [c for c in rows.columns if c not in ("key", "cell", "node")]
    return met.select("key", "cell", "node", "fp", "size", "odd", *more).repartition("key", "cell").sortWithinPartitions("key", "cell")


_CELL = 1 << 31
_FOUND = "a long, b long, again long"


def _large(met: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, again): what the cells of the buckets of several parts (key, node,
    parts) find."""

    def sized(rows: DataFrame, n: str) -> DataFrame:
        return rows.groupBy("key").agg(F.count("*").alias(n))

    def numbers(upto: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(upto) - 1))

    def part(parts: str):
        return F.pmod(F.xxhash64("node"), F.col(parts))

    met = keep(met.select("key", "node", F.col("parts").cast("long").alias("parts")), "large", "lz4_raw")
    leaders = met.groupBy("key", F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(LEADERS)).alias("slot")).agg(F.min("node").alias("node"), F.max("parts").alias("parts"))
    rows = met.select("key", part("parts").alias("cell"), "node", F.lit(False).alias("leads"))
    rows = rows.unionByName(leaders.select("key", numbers("parts").alias("cell"), "node", F.lit(True).alias("leads")))
    led = keep(_dealt(rows, texts).mapInArrow(_led, "key long, node long, leader long"), "led", "lz4_raw")
    most = led.groupBy("key", "leader").agg(F.count("*").alias("m")).groupBy("key")
    most = keep(most.agg(F.max(F.struct("m", "leader"))["leader"].alias("main"), F.sum("m").alias("n")), "main", "lz4_raw")
    like = join_counted(led, most, "key", "n", "inner").filter("leader = main").select("key", "node")
    like = keep(like.unionByName(most.select("key", F.col("main").alias("node"))), "like", "lz4_raw")
    rest = keep(met.select("key", "node").join(like, ["key", "node"], "left_anti"), "rest", "lz4_raw")
    sizes = sized(rest, "n").join(sized(like, "m"), "key", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    sizes = keep(sizes.withColumns({"parts": F.ceil(F.col("n") / CELL), "others": F.ceil(F.col("m") / CELL)}), "sizes", "lz4_raw")
    ours = join_counted(rest, sizes, "key", "n", "inner").withColumn("part", part("parts"))
    among = ours.select("key", "node", "part", numbers("parts").alias("other"))
    among = among.select("key", (F.least("part", "other") * _CELL + F.greatest("part", "other")).alias("cell"), "node")
    across = ours.filter("others > 0").select("key", "node", "part", numbers("others").alias("other"))
    theirs = join_counted(like, sizes.drop("n"), "key", "m", "inner").withColumn("other", part("others"))
    theirs = theirs.select("key", "node", "other", numbers("parts").alias("part"))
    across = across.unionByName(theirs).select("key", (-1 - (F.col("part") * _CELL + F.col("other"))).alias("cell"), "node")
    rest_links = _dealt(among.unionByName(across), texts).mapInArrow(_cells, _FOUND)
    return rest_links.unionByName(led.select(F.col("node").alias("a"), F.col("leader").alias("b"), F.lit(None).cast("long").alias("again")))


def links(texts: DataFrame) -> DataFrame:
    """(a, b, again) of distinct texts (a scratch table of node, fp, size, odd,
    keys): links (a, b) that connect what is clearly alike, and the texts a that
    are to meet in the cell ``again``."""
    bands = texts.select("node", F.explode("keys").alias("key"))
    several = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    several = keep(several.withColumn("parts", F.ceil(F.col("n") / CELL).cast("int")), "buckets", "lz4_raw")
    met = keep(join_counted(bands, several, "key", "n", "inner").select("key", "node", "parts"), "met", "lz4_raw")
    found = _dealt(met.filter("parts = 1").select("key", F.lit(0).alias("cell"), "node"), texts).mapInArrow(_cells, _FOUND)
    large = met.filter("parts > 1")
    return (found if large.isEmpty() else found.unionByName(_large(large, texts))).distinct()


def whole_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, odd, hashes) of the texts that ``nodes`` names: sorted shingle hashes
    as bytes. Texts are told by a bitmap, those it lets through in vain are left
    to the join."""
    wanted = docs.sparkSession.sparkContext.broadcast(hash_bitmap(nodes, "node"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _Words(), set()
        for b in it:
            for data in as_bytes(b.column(0)):
                node = xxhash.xxh64_intdigest(data, SEED)
                if node in seen or not in_bitmap(wanted.value, node):
                    continue
                if len(seen) >= TEXTS:
                    seen.clear()
                seen.add(node)
                distinct = np.unique(shingles(data, known))
                columns = [pa.array(np.array([node], np.uint64).view(np.int64)), pa.array([odd_sketch(distinct)], pa.binary()), pa.array([distinct.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "odd", "hashes"])

    ship(docs.sparkSession)
    made = columns_only(docs, "text").mapInArrow(run, "node long, odd binary, hashes binary")
    one = made.groupBy("node").agg(F.first(F.struct("odd", "hashes")).alias("s")).select("node", "s.*")
    return keep(one, "sets", "zstd")


def _settled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (again, root, node, odd, hashes) sorted by again: links (a, b) of a
    forest over the roots, each of a pair whose whole sets are alike."""

    def cells() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        held: pa.Table | None = None
        for b in it:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            again = t.column(0).to_numpy()
            edge = np.flatnonzero(np.diff(again)) + 1
            ends = [0, *edge.tolist()]
            for k, m in zip(ends, ends[1:]):
                yield unpacked(t.slice(k, m - k))
            held = t.slice(ends[-1])
        if held is not None and len(held):
            yield unpacked(held)

    def unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        odd = np.frombuffer(b"".join(t.column(3).to_pylist()), "<u8").reshape(len(t), -1)
        return t.column(1).to_numpy(), t.column(2).to_numpy(), odd, [np.frombuffer(x, "<u8") for x in t.column(4).to_pylist()]

    for root, node, odd, sets in cells():
        size = np.array([len(x) for x in sets], np.int64)
        _, label = np.unique(root, return_inverse=True)
        a, b = [], []
        for x in range(len(node) - 1):
            y = np.arange(x + 1, len(node))
            _, unclear = judged(odd[x][None, :], odd[y], np.full(len(y), size[x]), size[y])
            for k in y[unclear & (label[y] != label[x])].tolist():
                if label[k] == label[x]:
                    continue
                both = len(np.intersect1d(sets[x], sets[k], assume_unique=True))
                if both >= SIMILARITY * (size[x] + size[k] - both):
                    label[label == label[k]] = label[x]
                    a.append(node[x])
                    b.append(node[k])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def settled(docs: DataFrame, unsettled: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): links by whole sets between the ``groups`` (node, root), from cells
    (again, node) of texts in open pairs."""
    placed = keep(unsettled.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed", "lz4_raw")
    split = placed.groupBy("again").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("again")
    split = keep(placed.join(split, "again", "left_semi"), "split", "lz4_raw")
    sets = whole_sets(docs, split.select("node").distinct())
    met = split.join(sets, "node").select("again", "root", "node", "odd", "hashes")
    return met.repartition("again").sortWithinPartitions("again").mapInArrow(_settled, "a long, b long")


def near_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows are (doc_id, node) of every document, node standing
    for its text; groups are (node, root) of the texts that are linked to others."""
    seen = keep(described(docs), "described", "lz4_raw")
    first = F.first(F.struct("fp", "size", "odd", "keys"))
    texts = keep(seen.groupBy("node").agg(first.alias("d")).select("node", "d.*"), "texts", "lz4_raw")
    found = keep(links(texts), "found", "lz4_raw")
    groups = keep(connected_components(found.filter("b is not null").select("a", "b")), "groups", "lz4_raw")
    more = keep(settled(docs, found.filter("b is null").select("again", F.col("a").alias("node")), groups), "more", "lz4_raw")
    if not more.isEmpty():
        groups = connected_components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return seen.select("doc_id", "node"), groups


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of exact and near copies, the one
    of the smallest doc_id. Columns are unchanged. Null and empty texts are
    copies of each other; of rows that repeat in doc_id and text one stays; a
    null doc_id is kept only where its group has no other; texts of any length
    are compared whole; an empty table stays empty; other columns may have any
    name."""
    seen, groups = near_copies(docs)
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    ids = seen.groupBy("node", "doc_id").agg(F.count("*").alias("rows"))
    least = ids.groupBy("node").agg(F.min(F.struct(last.alias("o"), "rows", "doc_id")).alias("f"))
    placed = least.join(groups, "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct("f", "node").alias("s"))
    stay = placed.groupBy("root").agg(F.min("s").alias("s"))
    stay = keep(stay.select(F.col("s.node").alias("_node"), F.col("s.f.doc_id").alias("_id"), (F.col("s.f.rows") > 1).alias("_more")), "stay", "lz4_raw")
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))

    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")

    def kept(some: DataFrame) -> DataFrame:
        met = docs.join(some, (text == some["_node"]) & docs["doc_id"].cast("long").eqNullSafe(some["_id"]))
        return met.select(row, some["_node"].alias("node"))

    once, again = kept(stay.filter("not _more")), stay.filter("_more")
    if not again.isEmpty():  # a doc_id and text that stand on several rows
        once = once.unionByName(kept(again).dropDuplicates(["node"]))
    return once.select("row.*")
