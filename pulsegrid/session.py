"""Session defaults: UTC, adaptive execution."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch, unless the session sets its own: rows may be long
#: texts, of which a batch lies in the executor's and in the worker's memory.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES, SPARKS_BYTES = 8 << 20, 64 << 20


def ship(spark: SparkSession) -> None:
    """Readies a session for Python workers: their batches are bounded, and this
    package's sources are sent to them, once, so that no executor needs it
    installed."""
    if spark.conf.get(BATCH).lower() in (str(SPARKS_BYTES), f"{SPARKS_BYTES}b", "64m", "64mb"):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="pulsegrid-code-")  # served from here until the driver ends
    atexit.register(shutil.rmtree, folder, True)
    at = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)


def build(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("pulsegrid").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
