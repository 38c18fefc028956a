"""Joins of texts whose sets of word n-grams are alike, without losing a link.

Two texts link when their distinct n-grams have a Jaccard similarity of at least
NUM / DEN. Equal sets are one node. The hash space is cut into more parts than
linked sets of a size can differ in n-grams, so linked sets hold the same n-grams
in one part at least, and links are sought among the sets of a size band that
share such a part, which unlike sets with a passage in common do not. What
meets there is compared in tiles: the sets of a tile have sizes within a factor
that allows the similarity or little more; hashed bitmaps (parities of n-grams by
bit) are as wide as their sets need, the bits in which two of them differ bound
the overlap from above, and only pairs within the bound are decided by the
intersection of the sorted arrays.

Groups of many like sets would meet under every part they share. So a first
pass links each set with the first one under each of a few bands of min-hashes,
exactly and in linear time; after it, a tile whose sets all hang together already
is passed over, and inside a tile only sets of different
components are compared. All links between components are among these, so the
components are those of all links.

Tiles of any size are dealt to cells of bounded size, of which those among the
sets of the tile's largest component are left out. A cell names the sets that the
bitmaps leave a partner, never their pairs; a pair that shares several tiles
counts in the least of them. The arrays of the named sets then meet
in the cell, and it emits a spanning forest of the links that join components. In
the first pass, pairs are decided by hubs: the bitmap of one set stands in a task
before the bitmaps of its partners, a hub with many partners in several tasks, and
for the pairs that this leaves so do the arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import batches, columns_only, hash_bitmap, join_counted, keep, release, ship
from .words import distinct, mixed, shingled

WORDS = 3
#: Sets link when DEN * intersection >= NUM * union.
NUM, DEN = 90, 100
#: Part hashes that meet in one task, and that a task deals out at a time.
MEET, DEALT = 1 << 20, 1 << 20
#: Min-hash bands of the first pass, and min-hashes of a band.
BANDS, ROWS = 4, 2
#: Sets, and n-grams of them, of a tile's part that meets another in one task, and
#: partners of a hub in one task.
CELL, CELL_ITEMS, PARTNERS = 1024, 1 << 22, 256
#: Factor between the sizes of neighbouring bands; it is above DEN / NUM, so that
#: sets that link lie in one band or in neighbouring ones.
BAND = 1.5
_SEEDS = np.array([xxhash.xxh64_intdigest(f"band {k}", 42) | 1 for k in range(BANDS * ROWS)], np.uint64)


def least_overlap(size: np.ndarray) -> np.ndarray:
    """The smallest intersection of linked sets whose sizes add up to ``size``."""
    return -(-NUM * size // (NUM + DEN))


def apart_at_most(size: int) -> int:
    """The n-grams, of one set only, by which a set of ``size`` and a linked one of
    no smaller size can differ."""
    return (size + size * DEN // NUM) * (DEN - NUM) // (DEN + NUM)


@cache
def parts_of(band: int) -> tuple[int, int, np.ndarray]:
    """(least, spare, starts) of a band of sizes: its least size, the parts that may
    be empty in both sets besides those in which they differ, and where the
    parts of the hash space start, with numbers for each band and part."""
    least, most = band_start(band), band_start(band + 1) - 1
    low, spare = least * NUM // DEN, 1
    for _ in range(3):
        n = apart_at_most(most) + 1 + spare
        empty = (apart_at_most(low) + 1 + spare) * math.exp(-low / n)
        spare = 1 + int(empty + 2 * math.sqrt(empty))
    n = apart_at_most(most) + 1 + spare
    return least, spare, np.array([(p << 64) // n for p in range(n)], np.uint64)


def band_start(band: int) -> int:
    return math.ceil(BAND**band)


def band_of(size: int) -> int:
    band = int(math.log(size) / math.log(BAND))
    while band_start(band) > size:
        band -= 1
    while band_start(band + 1) <= size:
        band += 1
    return band


def part_hashes(own: np.ndarray) -> np.ndarray:
    """Hashes of the first parts of a sorted set, in its band and, where sets that
    link with it reach into it, the next one; two sets that link have one in common.

    Of the first d + 1 + spare parts, d being the n-grams by which the smaller set
    and a linked one can differ, 1 + spare hold the same in both. An empty part
    has no hash, unless the set has more than ``spare`` of them: of two sets, either
    one has no more, and a part that is not empty is the same, or both have."""
    size, out = len(own), []
    if not apart_at_most(size):
        return np.zeros(0, np.uint64)  # no other set is alike enough
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(own * _SEEDS[0]))])
        home = band_of(size)
        for band in (home, home + 1):
            least, spare, starts = parts_of(band)
            if band > home and size * DEN // NUM < least:
                break
            n = apart_at_most(size) + 1 + spare
            edge = np.searchsorted(own, starts[: n + 1])
            if n == len(starts):
                edge = np.append(edge, size)
            number = np.arange(1, n + 1, dtype=np.uint64) * _SEEDS[1] + np.uint64(band) * _SEEDS[2]
            h = mixed(mixed(sums[edge[1:]] - sums[edge[:-1]]) + number)
            empty = edge[1:] == edge[:-1]
            out.append(h if empty.sum() > spare else h[~empty])
    return np.concatenate(out)


def bitmap(h: np.ndarray) -> np.ndarray:
    """Parities of a set's n-grams by hashed bit, as 64-bit words: a power of two of
    bits, at least twice as many as n-grams."""
    bits = max(64, 1 << (2 * len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """A bitmap brought to ``width`` 64-bit words."""
    return words if len(words) == width else np.bitwise_xor.reduce(words.reshape(-1, width), axis=0)


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key for each band of min-hashes."""
    least = np.empty(len(_SEEDS), np.uint64)
    with np.errstate(over="ignore"):
        for k, seed in enumerate(_SEEDS):
            x = h * seed
            least[k] = (x ^ (x >> np.uint64(32))).min()
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for x in least.reshape(BANDS, ROWS).T:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + x)
    return key


def node_of(h: np.ndarray) -> int:
    """The signed 64-bit number that stands for a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 42)).view(np.int64))


_SEEN = "doc_id long, hash long, node long, size int, bits binary, bands array<long>, parts array<long>"


def _longs(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    flat = np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _described(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.uint64)
    for b in it:
        h, bounds = shingled(b.column(2), WORDS)
        node, size, bits, bands, parts = [], [], [], [], []
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = distinct(h[a:z])
            node.append(node_of(own))
            size.append(len(own))
            bits.append(bitmap(own).tobytes() if len(own) else b"")
            bands.append(band_keys(own) if len(own) else none)
            parts.append(part_hashes(own) if len(own) else none)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), b.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(bits, pa.binary()), _longs(bands), _longs(parts)],
            ["doc_id", "hash", "node", "size", "bits", "bands", "parts"],
        )


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, text): hash is that of id and text."""
    return columns_only(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).alias("hash"), "text"
    )


def arrays_of(docs: DataFrame, seen: DataFrame, nodes: DataFrame) -> DataFrame:
    """Scratch table (node, items): the sorted sets of ``nodes``, read again from one
    row of each. A bitmap of fixed size picks the rows; what it picks besides
    does no harm."""
    ship(docs.sparkSession)
    rows = seen.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("hash").alias("hash"))
    wanted = hash_bitmap(rows, "hash")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()  # of rows that repeat, one is enough
        for b in it:
            key = b.column(0).to_numpy()
            low = key.view(np.uint64) & np.uint64(len(wanted) * 32 - 1)
            hit = np.flatnonzero(wanted[low >> np.uint64(5)] >> (low & np.uint64(31)).astype(np.uint32) & 1)
            hit = hit[[k for k, x in enumerate(key[hit].tolist()) if x not in given]] if len(hit) else hit
            if not len(hit):
                continue
            given = set() if len(given) > 100_000 else given
            given.update(key[hit].tolist())
            h, bounds = shingled(b.column(1).take(pa.array(hit)), WORDS)
            own = [distinct(h[a:z]) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["node", "items"])

    found = _hashed(docs).select("hash", "text").mapInArrow(run, "node long, items binary")
    return keep(found.dropDuplicates(["node"]), "arrays")


Held = tuple[int, np.ndarray]


def _may_link(a: Held, b: Held) -> bool:
    """Whether sizes and bitmaps let two sets link."""
    total, width = a[0] + b[0], min(len(a[1]), len(b[1]))
    least = -(-NUM * total // (NUM + DEN))
    if min(a[0], b[0]) < least:
        return False
    return total - int(np.bitwise_count(folded(a[1], width) ^ folded(b[1], width)).sum()) >= 2 * least


def _link(a: Held, b: Held) -> bool:
    least = -(-NUM * (a[0] + b[0]) // (NUM + DEN))
    return min(a[0], b[0]) >= least and len(np.intersect1d(a[1], b[1], assume_unique=True)) >= least


def _decided(links: Callable[[Held, Held], bool], it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, part, kind, node, size, held) sorted so that what a hub holds is in
    front of what its partners hold: the pairs for which ``links`` is true."""
    hub, mine = None, (0, np.zeros(0, np.uint64))
    for b in it:
        left, right = [], []
        for at, kind, node, size, held in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
            own = (size, np.frombuffer(held, "<u8"))
            if kind == 0:
                hub, mine = at, own
            elif hub == at and links(mine, own):
                left.append(hub)
                right.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def at_hubs(pairs: DataFrame, held: DataFrame, links: Callable[[Held, Held], bool]) -> DataFrame:
    """Scratch table (a, b): those of ``pairs`` (a scratch table of nodes a, b) for
    which ``links`` is true of what ``held`` (node, size, held) has of them. The
    end with more partners is the hub."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    degree = keep(ends.groupBy("node").agg(F.count("*").alias("n")), "degree")
    of_a, of_b = (degree.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("n").alias(f"m_{c}")) for c in ("a", "b"))
    both = join_counted(keep(join_counted(pairs, of_a, "a", "m_a", "inner"), "pairs"), of_b, "b", "m_b", "inner")
    swap = (F.col("n_b") > F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a")))
    hub, node = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    met = keep(both.select(hub.alias("hub"), node.alias("node")).distinct(), "met")
    parts = keep(met.groupBy("hub").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"), F.count("*").alias("m")), "hubs")
    rows = join_counted(met, parts, "hub", "m", "inner").select("hub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "node")
    own = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("hub").alias("node"))
    dealt = rows.unionByName(own).join(held, "node").select("hub", "part", "kind", "node", "size", "held")
    dealt = dealt.repartition("hub", "part").sortWithinPartitions("hub", "part", "kind")
    return keep(dealt.mapInArrow(partial(_decided, links), "a long, b long"), "links")


def decided(docs: DataFrame, seen: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scratch table (a, b): those of ``pairs`` (a scratch table of nodes a, b) that
    link. Arrays are fetched for those only that the bitmaps let link."""
    likely = at_hubs(pairs, texts.select("node", "size", F.col("bits").alias("held")), _may_link)
    nodes = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    items = arrays_of(docs, seen, nodes)
    return at_hubs(likely, items.select("node", (F.octet_length("items") / 8).cast("int").alias("size"), F.col("items").alias("held")), _link)


def starred(texts: DataFrame) -> DataFrame:
    """Scratch table (a, b): every set and the least one under each of its bands."""
    rows = texts.select("node", F.explode("bands").alias("key"))
    lead = keep(rows.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).filter("n > 1"), "lead")
    met = join_counted(rows, lead, "key", "n", "inner").filter("node <> lead")
    return keep(met.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "starred")


def _several(rows: DataFrame, key: str, *more) -> DataFrame:
    """Scratch table of the keys that hold more than one component."""
    found = rows.groupBy(key).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), *more)
    return keep(found.filter("lo <> hi").drop("lo", "hi"), "several")


_PARTS = 1 << 31


def _dealt(buckets: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, parts) to rows (bucket, low, node) with the part hashes of many
    sets: the bucket comes from a hash's upper half, ``low`` are lower halves."""

    def packed(node: list[np.ndarray], h: list[np.ndarray]) -> pa.RecordBatch:
        n, x = np.concatenate(node), np.concatenate(h)
        bucket = ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, n, low = bucket[order], n[order], x[order].astype(np.uint32)
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        ends = [*at[1:].tolist(), len(bucket)]
        lows, nodes = ([v[a:z].tobytes() for a, z in zip(at.tolist(), ends)] for v in (low, n))
        return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(lows, pa.binary()), pa.array(nodes, pa.binary())], ["bucket", "low", "node"])

    node, h, size = [], [], 0
    for b in it:
        parts = b.column(1)
        node.append(np.repeat(b.column(0).to_numpy(), parts.value_lengths().to_numpy()))
        h.append(parts.flatten().to_numpy().view(np.uint64))
        size += len(h[-1])
        if size >= DEALT:
            yield packed(node, h)
            node, h, size = [], [], 0
    if size:
        yield packed(node, h)


def _meeting(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`_dealt` by bucket: (tile, node) of part hashes that several sets
    have. A tile is a bucket and a lower half."""

    def met(bucket: int, lows: list[bytes], nodes: list[bytes]) -> pa.RecordBatch:
        low, node = np.frombuffer(b"".join(lows), np.uint32), np.frombuffer(b"".join(nodes), np.int64)
        order = np.argsort(low, kind="stable")
        low, node = low[order], node[order]
        same = low[1:] == low[:-1]
        ok = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        return pa.RecordBatch.from_arrays([pa.array((bucket << 32) + low[ok].astype(np.int64)), pa.array(node[ok])], ["tile", "node"])

    at, lows, nodes = None, [], []
    for b in it:
        for bucket, low, node in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if bucket != at and lows:
                yield met(at, lows, nodes)
                lows, nodes = [], []
            at = bucket
            lows.append(low)
            nodes.append(node)
    if lows:
        yield met(at, lows, nodes)


def meetings(texts: DataFrame) -> DataFrame:
    """(tile, node): the sets of each tile of two or more. ``texts`` is a scratch table
    of node, parts."""
    total = texts.agg(F.sum(F.size("parts"))).first()[0] or 0
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // MEET))
    dealt = texts.select("node", "parts").mapInArrow(partial(_dealt, buckets), "bucket long, low binary, node binary")
    dealt = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_meeting, "tile long, node long")


def tiles(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """(cell, key, node, root, main) of the tiles in which sets of several components
    meet. ``texts`` is a scratch table of node, parts, ``placed`` of node, root, size.
    A key stands for a tile."""
    both = keep(meetings(texts).join(placed, "node"), "shared")
    # tiles of the same sets do the same work: the least one stays
    same = [F.bit_xor(F.xxhash64(*c)).alias(f"same{k}") for k, c in enumerate((("node",), ("size", "node")))]
    found = _several(both, "tile", F.sum("size").alias("items"), *same)
    found = found.groupBy("same0", "same1", "n").agg(F.min(F.struct("tile", "items")).alias("t")).select("t.tile", "n", "t.items")
    found = keep(found, "found")

    def parts(n, items):
        return F.greatest(F.ceil(n / CELL), F.ceil(items / CELL_ITEMS)).cast("long")

    held = keep(join_counted(both, found.withColumn("all", F.col("n")), "tile", "n", "inner"), "tiles")
    small = parts(F.col("all"), F.col("items")) == 1
    plain = held.filter(small).select(F.col("tile").alias("cell"), F.col("tile").alias("key"), "node", "root", F.lit(False).alias("main"))
    large = held.filter(~small)
    if large.isEmpty():
        return plain
    # the largest component's sets need not meet each other
    most = large.groupBy("tile", "root").agg(F.count("*").alias("m"), F.sum("size").alias("s"), F.max("all").alias("all"), F.max("items").alias("items"))
    most = most.groupBy("tile").agg(F.max(F.struct("m", "root", "s")).alias("t"), F.max("all").alias("w"), F.max("items").alias("items"))
    most = most.select(
        "tile", "w", F.col("t.root").alias("top"), parts(F.col("t.m"), F.col("t.s")).alias("tops"),
        parts(F.col("w") - F.col("t.m"), F.col("items") - F.col("t.s")).alias("others"),
    )
    dealt = join_counted(large.drop("all", "items"), keep(most, "most"), "tile", "w", "inner").withColumn("main", F.col("root") == F.col("top"))
    dealt = keep(dealt, "dealt").withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("tops")).otherwise(F.col("others"))))

    def numbers(upto: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(upto) - 1)).alias("other")

    def cells(some: DataFrame, cell) -> DataFrame:
        return some.select(F.xxhash64("tile", cell).alias("cell"), F.col("tile").alias("key"), "node", "root", "main")

    rest, main = dealt.filter("not main"), dealt.filter("main")
    among = cells(rest.select("*", numbers("others")), F.least("part", "other") * _PARTS + F.greatest("part", "other"))
    ours = cells(rest.select("*", numbers("tops")), -1 - (F.col("part") * _PARTS + F.col("other")))
    theirs = cells(main.select("*", numbers("others")), -1 - (F.col("other") * _PARTS + F.col("part")))
    return plain.unionByName(among).unionByName(ours).unionByName(theirs)


def _allowed(size: np.ndarray, bits: list[np.ndarray], root: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js) of sets sorted by size: the larger ones of another root that sizes
    and bitmaps let link with i."""
    width = min(map(len, bits))
    held = np.stack([folded(x, width) for x in bits])
    upto = np.searchsorted(size, size * DEN // NUM, "right")
    for i in range(len(size)):
        j = np.arange(i + 1, upto[i])
        j = j[root[j] != root[i]]
        if len(j):
            total = size[j] + size[i]
            apart = np.bitwise_count(held[j] ^ held[i]).sum(axis=1, dtype=np.int64)
            j = j[total - apart >= 2 * least_overlap(total)]
            if len(j):
                yield i, j


def _cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole cells of rows sorted by cell, the first column, one after the other."""
    held: pa.Table | None = None
    for t in batches(it, 1 << 12):
        t = pa.concat_tables([held, t]) if held is not None else t
        cell = t.column(0).to_numpy()
        edge = (np.flatnonzero(np.diff(cell)) + 1).tolist()
        for a, z in zip([0, *edge], edge):
            yield t.slice(a, z - a).combine_chunks()
        held = t.slice(edge[-1] if edge else 0)
    if held is not None and len(held):
        yield held.combine_chunks()


def _narrowed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps at a quarter of their width, which tells unlike sets apart and is
    shuffled with every row of a cell; the arrays have theirs whole."""
    for b in it:
        held = [np.frombuffer(x, "<u8") for x in b.column(2).to_pylist()]
        bits = [folded(x, max(1, len(x) // 4)).tobytes() for x in held]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], ["node", "size", "bits"])


def _named(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, node, root, size, bits, keys) by cell: those (cell, node, root) that
    have a partner whose least common key is the cell's. ``keys`` are a set's
    lesser tiles."""
    out: list[list] = [[], [], []]

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["cell", "node", "root"])
        for x in out:
            x.clear()
        return made

    for t in _cells(it):
        if len(t) < 2:
            continue
        size = t.column(3).to_numpy().astype(np.int64)
        order = np.argsort(size, kind="stable")
        node, root = (t.column(k).to_numpy()[order] for k in (1, 2))
        bits = t.column(4).to_pylist()
        keys = t.column(5)
        below: dict[int, set[int]] = {}

        def before(k: int) -> set[int]:
            if k not in below:
                below[k] = set(keys[int(order[k])].as_py())
            return below[k]

        partnered = np.zeros(len(size), bool)
        for i, js in _allowed(size[order], [np.frombuffer(bits[k], "<u8") for k in order.tolist()], root):
            for j in js.tolist():
                if not (partnered[i] and partnered[j]) and before(i).isdisjoint(before(j)):
                    partnered[[i, j]] = True
        at = np.flatnonzero(partnered)
        for x, values in zip(out, (np.full(len(at), t.column(0)[0].as_py()), node[at], root[at]), strict=True):
            x.extend(values.tolist())
        if len(out[0]) >= 1 << 14:
            yield batch()
    yield batch()


def _joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, node, root, items) by cell: links that connect the components
    that any link of the cell connects."""
    for t in _cells(it):
        own = [np.frombuffer(x, "<u8") for x in t.column(3).to_pylist()]
        size = np.array([len(x) for x in own])
        order = np.argsort(size, kind="stable")
        own, size, node = [own[k] for k in order.tolist()], size[order], t.column(1).to_numpy()[order]
        _, label = np.unique(t.column(2).to_numpy()[order], return_inverse=True)
        left, right = [], []
        for i, js in _allowed(size, [bitmap(x) for x in own], label.copy()):
            for j in js.tolist():
                if label[i] != label[j] and len(np.intersect1d(own[i], own[j], assume_unique=True)) >= least_overlap(size[i] + size[j]):
                    label[label == label[j]] = label[i]
                    left.append(node[i])
                    right.append(node[j])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def joined(docs: DataFrame, seen: DataFrame, texts: DataFrame, placed: DataFrame) -> DataFrame:
    """Scratch table (a, b): links that, with those behind ``placed`` (node, root,
    size), connect all that any link connects."""
    dealt = keep(tiles(texts, placed), "cells")
    keys = dealt.select("node", "key").distinct().groupBy("node").agg(F.collect_list("key").alias("keys"))  # no more than a set's parts
    known = texts.select("node", "size", "bits").mapInArrow(_narrowed, "node long, size int, bits binary").join(keys, "node")
    before = F.filter("keys", lambda k: k < F.col("key")).alias("keys")
    met = dealt.join(known, "node").select("cell", "node", "root", "size", "bits", before)
    met = met.repartition("cell").sortWithinPartitions("cell")
    named = keep(met.mapInArrow(_named, "cell long, node long, root long"), "named")
    items = arrays_of(docs, seen, named.select("node").distinct())
    met = named.join(items, "node").select("cell", "node", "root", "items").repartition("cell").sortWithinPartitions("cell")
    return keep(met.mapInArrow(_joined, "a long, b long"), "joined")


def distinct_sets(filled: DataFrame) -> DataFrame:
    """Scratch table: one row of each node. Rows that are surely alone, by a bitmap of
    fixed size, are not shuffled."""
    names = ["node", "size", "bits", "bands", "parts"]
    several = hash_bitmap(filled.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "node")

    def run(wanted: bool, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            low = b.column(0).to_numpy().view(np.uint64) & np.uint64(len(several) * 32 - 1)
            hit = (several[low >> np.uint64(5)] >> (low & np.uint64(31)).astype(np.uint32) & 1).astype(bool)
            yield b.filter(pa.array(hit == wanted))

    alone, rest = (filled.select(*names).mapInArrow(partial(run, x), "node long, size int, bits binary, bands array<long>, parts array<long>") for x in (False, True))
    return keep(alone.unionByName(rest.groupBy("node").agg(F.first(F.struct(*names[1:])).alias("d")).select("node", "d.*")), "texts")


def similar_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    component_id is the smallest doc_id that links reach, the document's own
    included. A null, empty or blank text has no n-grams and links with nothing:
    its component_id is its own doc_id. Repeated rows give repeated rows and
    equal sets are linked; a null doc_id is never the smallest unless the
    component has no other; texts of any length are taken whole; an empty table
    gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    whole = keep(_hashed(docs).mapInArrow(_described, _SEEN), "whole")
    texts = distinct_sets(whole.filter("size > 0"))
    seen = keep(whole.select("doc_id", "hash", "node", "size"), "seen")
    release(whole)
    filled = seen.filter("size > 0")
    links = decided(docs, filled.select("node", "hash"), texts, starred(texts))
    roots = keep(connected_components(links), "roots")
    placed = keep(texts.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size"), "placed")
    links = links.unionByName(joined(docs, filled.select("node", "hash"), texts, placed))
    roots = keep(connected_components(links), "roots")
    nodes = keep(filled.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    rooted = keep(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = keep(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), "least")
    known = keep(join_counted(rooted.select("node", "n", "root"), least, "root", "m").select("node", "n", "component_id"), "known")
    linked = join_counted(filled.select("doc_id", "node", "size"), known, "node", "n").select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id")
    alone = seen.filter("size = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
