"""Session factory and session-level helpers shared by every module."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def local_session(cpus: int | str = "*", app: str = "thicket", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the cluster names in spark.checkpoint.dir; below a temporary one where the master is local
    and none is set (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="thicket-scratch-"))
    path = f"{shared.rstrip('/')}/thicket-{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table in the shared folder: what it took to make them is done once, however often they are used, and a lost executor costs a read.
    What was shuffled for it goes as soon as it is written."""
    path = scratch(rows.sparkSession, name)
    with shuffles_cleaned(rows.sparkSession):
        rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def bucketed(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """rows as a table in the shared folder that is divided by key into n buckets: windows, groups and joins by it shuffle nothing. Rows that lie in n partitions
    by key are written as they are."""
    spark, table = rows.sparkSession, f"thicket_{uuid.uuid4().hex}"
    with shuffles_cleaned(spark):
        rows.write.bucketBy(n, key).options(path=scratch(spark, name), compression="zstd").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"drop table {table}")  # of the catalog; its files stay
    return out


@contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Files that a query shuffled go when it ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(rows: DataFrame) -> None:
    """Deletes the files of a written table that nothing needs any more."""
    spark = rows.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def grouped(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table], schema: str, parts: int | None = None) -> DataFrame:
    """work on the rows of each key, as an Arrow table. Keys are sorted within partitions, so that many small groups share a batch and cost no message each."""

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            if held.num_rows == 0:
                continue
            differs = np.zeros(held.num_rows - 1, bool)
            for k in keys:
                codes = np.asarray(held[k].combine_chunks().dictionary_encode().indices.fill_null(-1))
                differs |= codes[1:] != codes[:-1]
            cuts = [0, *(np.flatnonzero(differs) + 1).tolist()]
            done = [work(held.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            held = held.slice(cuts[-1])
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if held is not None and held.num_rows:
            yield from work(held).combine_chunks().to_batches()

    dealt = rows.repartition(parts, *keys) if parts else rows.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per application.

    Functions in mapInArrow are pickled by reference, so the workers must be able to import
    the package whatever their PYTHONPATH is. Where the session has no own setting, Arrow batches
    are kept to some hundred rows, as rows here are whole texts.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "500")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="thicket-"), "thicket.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
