"""Session helpers: where tables in the shared folder go and when they end, and how workers get this package."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import sys
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to remove a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the bytes of a batch of rows sent to a Python worker, and the most that is left there: texts may be long.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
_own: dict[str, str] = {}
_paths: set[str] = set()
_sent: weakref.WeakSet[SparkContext] = weakref.WeakSet()
#: Tables written within scratch(), by how deep it is nested.
_open: list[list[DataFrame]] = []
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where a local session (tests, a laptop) leaves it unset, a temporary folder of
    this process is used instead, until it ends; on a cluster it must be set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="lexgraph-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return _own["dir"]


def own_folder(spark: SparkSession, label: str) -> str:
    """The path of a new folder in the shared one, which ends with this process."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(_end)
    _paths.add(path)
    return path


def _end() -> None:
    """Delete what this process has left in the shared folder, if its JVM is still there."""
    try:
        jvm = SparkContext._jvm
        for path in _paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except Exception as e:
        print(f"left in the shared folder: {len(_paths)} folders ({e})", file=sys.stderr)


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The shuffle files of the write go when it ends: what comes after reads the table.
    The table goes by drop_tables(), at the end of a scratch(), or with this process.
    """
    spark = df.sparkSession
    path = own_folder(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    if _open:
        _open[-1].append(out)
    return out


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` itself if it is a written table, else written."""
    return df if df in _written else write_table(df, label)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _paths.discard(path)


def drop_tables(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        if path := _written.pop(df, None):
            delete_path(df.sparkSession, path)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written within are deleted at the end: what is wanted of them must have been written, or collected, elsewhere by then.

    write_table() calls within may themselves be results: take them out by ``keep()``.
    """
    _open.append([])
    try:
        yield
    finally:
        drop_tables(*_open.pop())


def keep(df: DataFrame) -> DataFrame:
    """Let a written table outlive the scratch() it was written in."""
    for tables in _open:
        tables[:] = [x for x in tables if x is not df]
    return df


def _archive() -> str:
    """This package's modules as one archive, made once by this process."""
    if "zip" not in _own:
        root = Path(__file__).resolve().parent
        _own["zip"] = f"{tempfile.mkdtemp(prefix='lexgraph-')}/lexgraph.zip"
        atexit.register(shutil.rmtree, os.path.dirname(_own["zip"]), True)
        with zipfile.ZipFile(_own["zip"], "w", zipfile.ZIP_DEFLATED) as out:
            for f in sorted(root.rglob("*.py")):
                out.write(f, f.relative_to(root.parent))
    return _own["zip"]


def ensure_importable(spark: SparkSession) -> None:
    """Send this package to all Python workers, wherever the driver has it, and give them batches of BATCH_BYTES at most."""
    context = spark.sparkContext
    if context not in _sent:
        _sent.add(context)
        context.addPyFile(_archive())
    if re.fullmatch(r"\d+b?", now := spark.conf.get(BATCH)) and int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt anew among tasks if it has fewer than two parts for each core: a small file is one part, whatever its rows cost."""
    want = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
