"""What the corpus operators share: table access, importability on executors, durable cuts of lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import dropped_at_end, is_local, new_folder, shared_dir

__all__ = ["BROADCAST_IDS", "cut", "dropped_at_end", "fresh", "keeps", "new_folder", "plain", "release", "shared_dir", "ship", "sized", "table", "tidied", "trim", "working"]


#: Ids that are broadcast at most (8 bytes each, counted first); more are joined by shuffling.
BROADCAST_IDS = 1_000_000


#: What Python workers keep between tasks, and how it is dropped; the operator that ran last.
_kept: dict[str, Callable[[], None]] = {}
_last: list[str] = [""]


def keeps(name: str, drop: Callable[[], None]) -> None:
    """Tells of a cache that a worker keeps between tasks."""
    _kept[name] = drop


def working(name: str = "") -> None:
    """Called where an operator's code starts in a worker: caches of other operators go, for workers are shared."""
    if _last[0] == name:
        return
    for other, drop in _kept.items():
        if other != name:
            drop()
    _last[0] = name
    trim()


def trim() -> None:
    """Gives freed memory back to the system, as far as the C library and Arrow can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """run, a function for mapInArrow, whose worker gives memory back when its task ends: workers stay on idle."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return tidy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that goes to Python: texts are long, and a worker holds a batch or two.
BATCH_ROWS = 512


def plain(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def fresh(docs: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to clash with no column of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, and keeps batches of texts small.

    Locally, workers look where the driver found the package; a cluster gets it as a zip file from Spark. The
    size of batches is the session's; it is only changed where it is Spark's default.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    package = Path(__file__).resolve().parent.parent
    root = str(package.parent)
    if not is_local(spark):
        if sc.applicationId not in _sent:
            sc.addPyFile(_zipped(package))
            _sent.add(sc.applicationId)
        return
    env = sc.environment
    have = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])


def _zipped(package: Path) -> str:
    """A zip file of the package's modules, on the driver, which serves it to the executors."""
    files = sorted(package.rglob("*.py"))
    digest = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:16]
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), f"lodestone-{digest}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for f in files:
            out.write(f, str(f.relative_to(package.parent)))
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder; Spark drops the files with the last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has the driver look now for tables and shuffles that nothing refers to, whose files Spark then drops."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def sized(df: DataFrame, rows: int, each: int = 200_000) -> DataFrame:
    """df in as many partitions as its rows need, if it has more: a small table in hundreds makes thousands of files."""
    return df.coalesce(max(2, -(-rows // each)))
