"""Input tables and intermediate tables in storage that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_written: dict[str, list[str]] = {}


#: Rows of a batch that goes to Python; texts are long, so Spark's own number would take tens of MB a task on both sides.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, and lower the default size of batches."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    key, default, rows = BATCH
    if spark.conf.get(key) == default:
        spark.conf.set(key, rows)
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()).resolve() / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset, as
    in local tests, a local folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession) -> str:
    """A new folder's name in the shared folder."""
    return f"{shared_dir(spark)}/palimpsest/{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts lineage in storage that outlives executors, and makes a result
    that depends on how rows were dealt out the same for each later reader.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{folder(spark)}/{name}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote and that nothing reads any more; others are left alone."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            _written[df.sparkSession.sparkContext.applicationId].remove(path)
            _delete(df.sparkSession, path)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes what ``materialize`` writes within, but for the tables that are put into the list.

    Results that are read later have to be in the list, or written elsewhere.
    """
    written = _written.setdefault(spark.sparkContext.applicationId, [])
    before, kept = set(written), []
    try:
        yield kept
    finally:
        keep = before | {_paths.get(df) for df in kept}
        for path in [p for p in written if p not in keep]:
            written.remove(path)
            _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes all that ``materialize`` wrote in this application, once its results are no longer read."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that a table doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
