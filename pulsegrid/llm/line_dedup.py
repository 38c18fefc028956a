"""Near-duplicate lines by a segment-partition edit join (Li, Deng, Wang, Feng,
VLDB 2011).

A line of l code points may be up to tau(l) edits away: it is cut into
tau + 1 segments, of which a line within tau edits must hold one unchanged, near
its place. Segments are indexed by length, number and content; longer lines
probe with the few substrings that can stand for a segment. Lines that meet are
compared by the parity of their letter pairs, a bound on the edit distance that
costs one word a line; where that leaves any, the group's lines are brought
together with their texts and verified by a banded bit-parallel edit distance.

Groups of any size are dealt to cells of bounded size. A cell emits a spanning
forest of its links and each line's number of links, never its pairs; a pair
that meets in several groups is verified and counted in the least of them only.

Lines that are equal are one line throughout; links are between different texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import as_text, batches, columns_only, hash_bitmap, in_bitmap, join_counted, keep, ship
from .simhash import forest, near_shifted, near_within

TAU = 2
#: Least lengths for one and for two edits; shorter lines are only ever equal.
#: A parameter of the operator: any lengths from (2, 3) on lose no link.
LEAST = (16, 32)
#: Rows, and code points, of a group that meet in one task; larger groups are
#: dealt to cells.
CELL, CELL_SIZE = 4096, 1 << 23
#: Lines, and code points, that are taken at a time.
LINES, CHUNK = 4096, 1 << 19
#: Lines that a task remembers, so as not to repeat them.
SEEN = 500_000
SEED = 42
#: One edit changes the parity of at most this many letter pairs.
PARITIES = 4


def tau(length: int, least: tuple[int, int] = LEAST) -> int:
    """Edits that a line of this length, the shorter of two, may be away."""
    return sum(length >= x for x in least)


def segments(length: int, t: int) -> list[tuple[int, int]]:
    """(start, length) of t + 1 segments whose lengths differ by at most one."""
    size, long = divmod(length, t + 1)
    out, at = [], 0
    for k in range(t + 1):
        n = size + (k > t - long)
        out.append((at, n))
        at += n
    return out


def probes(length: int, least: tuple[int, int] = LEAST) -> list[tuple[int, int, int, int, int]]:
    """(role, l, segment, start, size) of a line: role 0 are its own segments,
    roles 1 to 3 the substrings that may stand for a segment of a line of equal
    length or one or two code points shorter."""
    out = []
    for d in range(TAU + 1):
        l = length - d
        t = tau(l, least)
        if t < max(1, d):
            continue
        for k, (p, n) in enumerate(segments(l, t)):
            lo, hi = max(0, p - k, p + d - (t - k)), min(length - n, p + k, p + d + (t - k))
            for at in range(lo, hi + 1):
                out.append((0 if d == 0 and at == p else d + 1, l, k, at, n))
    return out


class _Plans(dict):
    """length -> its probes."""

    def __init__(self, least: tuple[int, int]):
        self.least = least

    def __missing__(self, length: int) -> list[tuple[int, int, int, int, int]]:
        got = probes(length, self.least)
        if length < 1 << 12:
            self[length] = got
        return got


def keys_of(line: str, plan: list[tuple[int, int, int, int, int]]) -> list[int]:
    """The keys of a line's probes; the two low bits are the role."""
    digest = xxhash.xxh64_intdigest
    return [digest(line[at : at + n].encode("utf-8", "surrogatepass"), l * 4 + k) & ~3 | role for role, l, k, at, n in plan]


def parity(lines: list[bytes]) -> np.ndarray:
    """64 parities of a line's byte pairs, which any edit of a code point of up
    to two bytes changes in few places; longer code points are folded first."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    data = np.frombuffer(b"".join(lines), np.uint8).astype(np.uint32)
    line = np.repeat(np.arange(len(lines)), size)
    same = line[1:] == line[:-1]
    pair = ((data[:-1] * np.uint32(2654435761) ^ data[1:] * np.uint32(2246822519)) >> np.uint32(26)).astype(np.int64)
    odd = np.bincount((line[1:] * 64 + pair)[same], minlength=64 * len(lines)).reshape(-1, 64) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


def _folded(line: str) -> bytes:
    """One byte a code point, so that an edit changes one byte."""
    return line.encode("latin-1") if line.isascii() else bytes([c if c < 128 else 128 | (c * 40503 >> 4) & 127 for c in map(ord, line)])


def _runs(lines: list[str]) -> Iterator[list[str]]:
    """Bounded runs of lines."""
    run: list[str] = []
    size = 0
    for x in lines:
        run.append(x)
        size += len(x)
        if len(run) >= LINES or size >= CHUNK:
            yield run
            run, size = [], 0
    if run:
        yield run


def _signatures(least: tuple[int, int], it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, line, parity) of every line that may have links; the two low bits
    of key are the role. A line that a task has just seen is not repeated."""
    seen: set[int] = set()
    plans = _Plans(least)
    for b in it:
        if len(seen) > SEEN:
            seen.clear()
        for run in _runs([x for text in as_text(b.column(0)) for x in text.split("\n") if len(x) >= least[0]]):
            new, ids = [], []
            for x in run:
                h = xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), SEED)
                if h not in seen:
                    seen.add(h)
                    new.append(x)
                    ids.append(h)
            if not new:
                continue
            keys: list[int] = []
            count = []
            for x in new:
                plan = plans[len(x)]
                keys += keys_of(x, plan)
                count.append(len(plan))
            columns = [
                np.array(keys, np.uint64),
                np.repeat(np.array(ids, np.uint64), count),
                np.repeat(parity([_folded(x) for x in new]), count),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["key", "line", "parity"])


def _near(word: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the groups of sorted ``group`` whose parities allow TAU
    edits, a bounded number at a time."""
    edge = np.nonzero(np.diff(group))[0] + 1
    start, stop = np.concatenate([[0], edge]), np.concatenate([edge, [len(group)]])
    size = stop - start
    small = np.flatnonzero(np.repeat((size > 1) & (size <= 64), size))
    if len(small):
        for i, j in near_shifted(word[small], group[small], int(size[(size > 1) & (size <= 64)].max()), PARITIES * TAU):
            yield small[i], small[j]
    for a, b in zip(start[size > 64].tolist(), stop[size > 64].tolist(), strict=True):
        for i, j in near_within(word[a:b], PARITIES * TAU):
            for k in range(0, len(i), 1 << 16):
                yield i[k : k + (1 << 16)] + a, j[k : k + (1 << 16)] + a


def _whole_groups(it: Iterator[pa.RecordBatch], rows: int, keys: int, size: int | None = None) -> Iterator[pa.Table]:
    """Runs of whole groups: rows are sorted by the first ``keys`` columns, of the
    first without its two low bits. Where a group has more than ``size`` rows it
    comes in several runs, each longer than ``size``."""

    def ends(t: pa.Table) -> np.ndarray:
        out = np.diff(t.column(0).to_numpy() >> 2) != 0
        for k in range(1, keys):
            out |= np.diff(t.column(k).to_numpy()) != 0
        return np.flatnonzero(out) + 1

    held: pa.Table | None = None
    for t in batches(it, rows):
        t = pa.concat_tables([held, t]) if held is not None else t
        at = ends(t)
        last = int(at[-1]) if len(at) else 0
        if size and len(t) - last > 2 * size + 1:
            last = len(t) - size - 1  # what is left of the group is still above size
        if last:
            yield t.slice(0, last)
        held = t.slice(last).combine_chunks()
    if held is not None and len(held):
        yield held


def _meeting(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, line, parity) sorted by group, those that may have a link
    within their group; groups of more than CELL rows pass as a whole."""
    for t in _whole_groups(it, 1 << 17, 1, CELL):
        key, line, word = (t.column(k).to_numpy() for k in range(3))
        group = np.cumsum(np.concatenate([[0], np.diff(key >> 2) != 0]))
        count = np.bincount(group)[group]
        large = count > CELL
        few = np.flatnonzero((count > 1) & ~large)
        meets = large.copy()
        if len(few):
            k, own = line[few], key[few] & 3 == 0
            for i, j in _near(word[few].view(np.uint64), group[few]):
                ok = (own[i] | own[j]) & (k[i] != k[j])
                meets[few[i[ok]]] = meets[few[j[ok]]] = True
        if meets.any():
            yield from t.filter(pa.array(meets)).to_batches()


def within_edits(a: list[str], b: list[str], limit: np.ndarray) -> np.ndarray:
    """Whether a[k] and b[k] are at most limit[k] <= TAU edits apart, for all k at
    once. Bit d of a word stands for the diagonal d - TAU of the band; word e
    holds the diagonals that are reached with e edits."""
    n, width = len(a), 2 * TAU + 1
    la, lb = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
    most = int(la.max(initial=0))
    x, y = np.zeros((n, most + 1), np.uint32), np.full((n, most + 2 * width + 2), 0xFFFFFFFF, np.uint32)
    for k in range(n):
        x[k, : la[k]] = np.frombuffer(a[k].encode("utf-32-le", "surrogatepass"), "<u4")
        end = min(lb[k], y.shape[1] - TAU)
        y[k, TAU : TAU + end] = np.frombuffer(b[k].encode("utf-32-le", "surrogatepass"), "<u4")[:end]
    full = np.uint8((1 << width) - 1)
    reached = [np.full(n, 1 << TAU, np.uint8)]
    for _ in range(TAU):
        reached.append(reached[-1] | (reached[-1] << np.uint8(1)) & full)  # code points of b before any of a
    final = [r.copy() for r in reached]
    alive = np.ones(n, bool)
    for i in range(most):
        same = np.zeros(n, np.uint8)
        for d in range(width):
            same |= (x[:, i] == y[:, i + d]).astype(np.uint8) << np.uint8(d)
        before = reached
        reached = [before[0] & same]
        for e in range(1, TAU + 1):
            # matched; replaced; a's code point left out; b's code point put in
            reached.append(before[e] & same | before[e - 1] | before[e - 1] >> np.uint8(1) | (reached[-1] << np.uint8(1)) & full)
        alive = la > i + 1
        ends = la == i + 1
        for e in range(TAU + 1):
            final[e] = np.where(ends, reached[e], final[e])
        if not alive.any():
            break
    at = lb - la + TAU
    inside = (at >= 0) & (at < width)
    bit = np.where(inside, at, 0).astype(np.uint8)
    ok = np.zeros(n, bool)
    for e in range(TAU + 1):
        ok |= (final[e] >> bit & 1 == 1) & (e <= limit)
    return ok & inside


def _alike(a: list[str], b: list[str], least: tuple[int, int]) -> np.ndarray:
    """Whether a[k] and b[k] are within their edits."""
    ok = np.zeros(len(a), bool)
    order = sorted(range(len(a)), key=lambda k: len(a[k]))
    at = 0
    while at < len(order):
        size = max(1, min(2048, (1 << 20) // (len(a[order[min(at + 2047, len(order) - 1)]]) + 1)))
        some = order[at : at + size]
        limit = np.array([tau(min(len(a[k]), len(b[k])), least) for k in some])
        ok[some] = within_edits([a[k] for k in some], [b[k] for k in some], limit)
        at += size
    return ok


class _Keys(dict):
    """text -> its own segments' keys and all of its keys, without roles."""

    def __init__(self, plans: _Plans):
        self.plans = plans

    def __missing__(self, x: str) -> tuple[frozenset[int], frozenset[int]]:
        keys = keys_of(x, self.plans[len(x)])
        got = self[x] = frozenset(k >> 2 for k in keys if k & 3 == 0), frozenset(k >> 2 for k in keys)
        return got


def _cells(least: tuple[int, int], it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, part, line, parity, text) sorted by group and cell: (a, b)
    links that connect what a cell's links connect, and (a, null, links) the
    number of links of a line that are counted here."""
    plans = _Plans(least)
    for t in _whole_groups(it, 1 << 14, 2):
        key, cell, part, line = (t.column(k).to_numpy() for k in range(4))
        word, text = t.column(4).to_numpy().view(np.uint64), t.column(5).to_pylist()
        group = np.cumsum(np.concatenate([[0], (np.diff(key >> 2) != 0) | (np.diff(cell) != 0)]))
        bare, own, inner = (key.view(np.uint64) >> np.uint64(2)).tolist(), key & 3 == 0, cell >> 31 == cell & (1 << 31) - 1
        known = _Keys(plans)
        label, links = np.arange(len(key)), np.zeros(len(key), np.int64)
        for i, j in _near(word, group):
            ok = (own[i] | own[j]) & (line[i] != line[j]) & (inner[i] | (part[i] != part[j]))
            first = []
            for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                (o, p), (q, r) = known[text[x]], known[text[y]]
                if bare[x] == min(o & r | p & q):  # the least group in which the two meet
                    first.append((x, y))
            if not first:
                continue
            x, y = np.array(first).T
            ok = _alike([text[k] for k in x], [text[k] for k in y], least)
            x, y = x[ok], y[ok]
            links += np.bincount(x, minlength=len(key)) + np.bincount(y, minlength=len(key))
            label = forest(len(key), iter([(label[x], label[y])]))[label]
        moved, counted = np.flatnonzero(label != np.arange(len(key))), np.flatnonzero(links)
        none = pa.nulls(len(counted), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(line[moved]), pa.array(line[label[moved]]), pa.array(np.zeros(len(moved), np.int64))], ["a", "b", "links"])
        yield pa.RecordBatch.from_arrays([pa.array(line[counted]), none, pa.array(links[counted])], ["a", "b", "links"])


def _texts(docs: DataFrame, wanted: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(line, text) of the lines in ``wanted``: a bitmap of fixed size keeps most
    other lines from being dealt out at all."""
    shared = docs.sparkSession.sparkContext.broadcast(hash_bitmap(wanted, "line"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for b in it:
            found: dict[int, str] = {}
            for text in as_text(b.column(0)):
                for x in text.split("\n"):
                    if len(x) >= least[0]:
                        h = xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), SEED)
                        if in_bitmap(table, h) and h not in seen:
                            found[h] = x
            seen = seen | found.keys() if len(seen) < SEEN else set(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(found), np.uint64).view(np.int64)), pa.array(list(found.values()), pa.string())], ["line", "text"])

    lines = columns_only(docs, "text").mapInArrow(run, "line long, text string")
    return lines.join(wanted, "line", "left_semi").groupBy("line").agg(F.first("text").alias("text"))


def line_links(docs: DataFrame, least: tuple[int, int] = LEAST) -> tuple[DataFrame, DataFrame]:
    """(a, b): links between different lines, by their hashes, that connect what
    all links connect; and (line, links): how many links a line has."""
    ship(docs.sparkSession)
    group = F.shiftright("key", 2)
    sigs = columns_only(docs, "text").mapInArrow(partial(_signatures, least), "key long, line long, parity long")
    met = sigs.repartition(group).sortWithinPartitions(group).mapInArrow(_meeting, "key long, line long, parity long")
    # a line holds a key once; its own segment comes before other roles
    met = keep(met.groupBy(group.alias("group"), "line", "parity").agg(F.min(F.col("key").bitwiseAND(F.lit(3))).alias("role")), "met", "lz4_raw")
    wanted = keep(met.select("line").distinct(), "wanted", "lz4_raw")
    texts = met.join(_texts(docs, wanted, least), "line")
    key = F.shiftleft("group", 2).bitwiseOR(F.col("role")).alias("key")
    texts = keep(texts.select("group", key, "line", "parity", "text"), "texts")
    size = texts.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"))
    parts = F.ceil(F.greatest(F.col("n") / CELL, F.col("size") / CELL_SIZE)).cast("int")
    size = keep(size.select("group", "n", parts.alias("parts")), "sizes", "lz4_raw")
    cells = join_counted(texts, size, "group", "n", "inner").withColumn("part", F.pmod("line", "parts").cast("long"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    cell = F.least("part", "other") * F.lit(1 << 31) + F.greatest("part", "other")
    cells = cells.select("group", "key", cell.alias("cell"), "part", "line", "parity", "text")
    cells = cells.repartition("group", "cell").sortWithinPartitions("group", "cell").drop("group")
    found = keep(cells.mapInArrow(partial(_cells, least), "a long, b long, links long"), "found", "lz4_raw")
    links = found.filter("b is not null").select("a", "b")
    return links, found.filter("b is null").groupBy(F.col("a").alias("line")).agg(F.sum("links").alias("links"))


def deduplicated_lines(docs: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines (lines that are not empty),
    n_kept (those that are the first of their class in ascending doc_id and line
    order), n_links (links of its lines to different line texts) and class_ids
    (per line the smallest doc_id that holds a line of its class).

    Lines end at U+000A and are taken as they are. A class is what links connect;
    a line links to another that is at most 2 edits away (from least[1] code
    points of the shorter), 1 edit (from least[0]), or equal. Null and empty texts have no lines;
    rows equal in doc_id and text have equal results; a null doc_id counts as -1;
    an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"), F.xxhash64(text).alias("_text"), text.alias("text"))
    lines = keep(
        rows.select("_id", "_text", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
        .filter("line <> ''")
        .select("_id", "_text", "at", F.xxhash64("line").alias("line")),
        "lines",
        "zstd",
    )
    links, degree = line_links(docs, least)
    roots = keep(connected_components(links), "roots", "lz4_raw").select(F.col("node").alias("line"), "root")
    place = F.struct("_id", "at", "_text")
    stats = lines.groupBy("line").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    linked = roots.join(degree, "line")
    stats = keep(stats.join(linked, "line", "left").filter("n > 1 or root is not null").withColumn("root", F.coalesce("root", "line")), "stats", "lz4_raw")
    least = keep(stats.groupBy("root").agg(F.min("first").alias("lead"), F.count("*").alias("m")), "least", "lz4_raw")
    known = keep(join_counted(stats, least, "root", "m").select("line", "n", "lead", F.coalesce("links", F.lit(0)).alias("links")), "known", "lz4_raw")
    placed = join_counted(lines, known, "line", "n")
    alone = F.col("lead").isNull()
    per_doc = placed.groupBy("_id", "_text").agg(
        F.sort_array(
            F.collect_set(F.struct("at", F.when(alone, F.col("_id")).otherwise(F.col("lead._id")).alias("c"), (alone | (F.col("lead") == place)).alias("kept"), F.coalesce("links", F.lit(0)).alias("links")))
        ).alias("x")
    )
    per_doc = per_doc.select("_id", "_text", F.size("x").cast("long").alias("n_lines"), F.size(F.filter("x", lambda s: s["kept"])).cast("long").alias("n_kept"),
        F.aggregate("x", F.lit(0).cast("long"), lambda acc, s: acc + s["links"]).alias("n_links"), F.transform("x", lambda s: s["c"]).alias("class_ids"))
    none = F.lit(0).cast("long")
    return rows.select("doc_id", "_id", "_text").join(per_doc, ["_id", "_text"], "left").select(
        "doc_id", *[F.coalesce(c, none).alias(c) for c in ("n_lines", "n_kept", "n_links")], F.coalesce("class_ids", F.array().cast("array<long>")).alias("class_ids")
    )
