"""An exact range join on the cosine of vectors: pivots and the triangle
inequality of angles rule out what cannot be near, blocked products decide the rest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import ship

#: Cells that the right side falls into, rows that each is chosen among, and rows
#: of a side that meet in one task.
PIVOTS, AMONG, BLOCK = 64, 16, 4096
#: Beyond the error of an angle from a product of doubles near 1.
SLACK = 1e-6


@dataclass
class Cells:
    """Both sides by cell: (cell, key, v); a left row is in every cell that may
    hold a near row, a right row in that of its nearest pivot. ``sizes`` has the
    rows of both sides for each cell."""

    left: DataFrame
    right: DataFrame
    sizes: dict[int, tuple[int, int]]


def angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def spread(vectors: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` of the rows, each the farthest from those before it."""
    chosen, far = [0], angles(vectors, vectors[:1])[:, 0]
    while len(chosen) < min(n, len(vectors)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, angles(vectors, vectors[chosen[-1:]])[:, 0])
    return vectors[chosen]


def _unit(side: DataFrame) -> DataFrame:
    """Distinct keys with vectors at unit length; null and zero vectors are near nothing."""
    t = side.filter("v is not null").dropDuplicates(["key"]).select("key", text.unit(F.col("v")).alias("v"))
    return t.filter(F.exists("v", lambda x: x != 0))


def cells(left: DataFrame, right: DataFrame, least: float, pivots: int = PIVOTS) -> Cells:
    """The pivots are spread over AMONG times as many rows of the right side, the
    first by a hash of their keys; the driver holds these, and a radius and two
    counts for each cell."""
    ship(left.sparkSession)
    a, b = _unit(left), _unit(right)
    found = b.orderBy(F.xxhash64("key"), "key").limit(pivots * AMONG).collect()
    if not found:
        none = left.sparkSession.createDataFrame
        return Cells(none([], "cell int, key string, v array<double>"), none([], "cell int, key string, v array<double>"), {})
    p = spread(np.array([r.v for r in found]), pivots)

    def nearest(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in it:
            if len(t):
                far = angles(np.stack(t["v"].to_numpy()), p)
                yield t.assign(cell=far.argmin(1).astype("int32"), far=far.min(1))[["cell", "key", "v", "far"]]

    b = b.mapInPandas(nearest, "cell int, key string, v array<double>, far double")
    seen = {r.cell: (r.n, r.far) for r in b.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    reach = np.full(len(p), -np.inf)
    for c, (_, far) in seen.items():
        reach[c] = far + np.arccos(min(1.0, least)) + SLACK

    def within(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in it:
            if len(t):
                row, cell = np.nonzero(angles(np.stack(t["v"].to_numpy()), p) <= reach)
                if len(row):
                    yield pd.DataFrame({"cell": cell.astype("int32"), "key": pd.Series(list(t["key"].to_numpy()[row]), dtype=object), "v": pd.Series(list(t["v"].to_numpy()[row]), dtype=object)})

    a = a.mapInPandas(within, "cell int, key string, v array<double>")
    met = {r.cell: r.n for r in a.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    return Cells(a, b.drop("far"), {c: (met.get(c, 0), n) for c, (n, _) in seen.items()})


def similar(left: DataFrame, right: DataFrame, least: float, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(left_key, right_key, similarity) of all rows of ``left`` and ``right``
    (key string, v) with a cosine of ``least`` or more, which is above 0. Rows of
    one key have one vector. A cell's rows are dealt to parts of about ``block``,
    and every part of one side meets every part of the other once."""
    if least <= 0:
        raise ValueError("a cosine of 0 or less rules out nothing")
    t = cells(left, right, least, pivots)
    spark = left.sparkSession
    rows = [(c, max(1, -(-m // block)), max(1, -(-n // block))) for c, (m, n) in t.sizes.items()]
    parts = F.broadcast(spark.createDataFrame(rows, "cell int, a_parts int, b_parts int"))  # a row for each pivot

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        d = side.join(parts, "cell")
        return d.select("cell", "key", "v", F.pmod(F.xxhash64("key"), F.col(f"{own}_parts")).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1)).alias(other))

    def pairs(a, b, similarity: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"left_key": pd.Series(list(a), dtype=object), "right_key": pd.Series(list(b), dtype=object), "similarity": similarity})

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pairs([], [], np.empty(0))
        dots = np.stack(a["v"].to_numpy()) @ np.stack(b["v"].to_numpy()).T
        i, j = np.nonzero(dots >= least)
        return pairs(a["key"].to_numpy()[i], b["key"].to_numpy()[j], dots[i, j])

    keys = ("cell", "a", "b")
    met = dealt(t.left, "a", "b").groupBy(*keys).cogroup(dealt(t.right, "b", "a").groupBy(*keys))
    return met.applyInPandas(near, "left_key string, right_key string, similarity double")
