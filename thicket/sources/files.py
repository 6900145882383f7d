"""Readers and writers of the pipeline's files. Everything goes through Spark's own readers, so any store will do."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from thicket.operators.views import shuffled
from thicket.schema import RAW_METHOD, RAW_SAMPLE

_PARTITION = r"/([^/]+)/(train|valid|test)/"


def read_json_lines(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """Raw functions (func_name, docstring, code) of JSON-lines files, gzipped or not, with the partition from the path.

    A gzip file is one task, so rows are dealt out anew when there are fewer files than cores.
    """
    out = spark.read.schema(RAW_SAMPLE).json(path).withColumn("partition", F.nullif(F.regexp_extract(F.input_file_name(), _PARTITION, 2), F.lit("")))
    out = out.withColumn("language", F.lit(language) if language else F.nullif(F.regexp_extract(F.input_file_name(), _PARTITION, 1), F.lit("")))
    cores = spark.sparkContext.defaultParallelism
    return out.repartition(cores) if out.rdd.getNumPartitions() < cores else out


def read_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Raw methods of files that hold one JSON array each; a missing doc is null."""
    rows = spark.read.schema(RAW_METHOD).option("multiLine", True).json(path)
    return rows.select(F.col("name").alias("func_name"), F.col("doc").alias("docstring"), "code")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, stem, size, modified) of all files below a path; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _text(data: bytes | None) -> str | None:
    if data is None:
        return None
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", errors="replace")


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8 text, or windows-1252 where the bytes aren't UTF-8 (Spark's own decoder doesn't have that one)."""
    return content.map(_text)


def read_code_files(spark: SparkSession, path: str, pattern: str = "*.java") -> DataFrame:
    """(path, stem, project, size, content) of source files; the project is the first folder below the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    rest = F.element_at(F.split(F.col("path"), F.lit(r"\Q" + path.rstrip("/").split("://")[-1].replace("file:", "") + r"\E")), -1)
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"), F.split_part(rest, F.lit("/"), F.lit(2)).alias("project"), F.col("length").alias("size"), decoded(F.col("content")).alias("content"))


def write_samples(rows: DataFrame, path: str, per_file: int = 5_000) -> None:
    """Samples partitioned by language and partition, some thousand to a file; other partitions stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", per_file).partitionBy("language", "partition").parquet(path)


def read_samples(spark: SparkSession, path: str, language: str | list[str] | None = None, partition: str | None = None) -> DataFrame:
    """Samples of some languages and a partition: other folders aren't listed as input."""
    rows = spark.read.parquet(path)
    if language is not None:
        rows = rows.where(F.col("language").isin([language] if isinstance(language, str) else language))
    return rows if partition is None else rows.where(F.col("partition") == partition)


def combined(sources: dict[str, DataFrame], seed: int | None = None, *ids: str) -> DataFrame:
    """Several languages with a tag; with a seed, in an order of hashes of the seed, the tag and the ids."""
    out = None
    for name, rows in sources.items():
        tagged = rows.withColumn("language", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out if seed is None else shuffled(out, seed, "language", *ids)


def save_table(rows: DataFrame, path: str) -> None:
    """Small tables: vocabularies, counters, dictionaries."""
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def save_config(spark: SparkSession, config: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_config(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a sample table: Parquet's footers have them, no row is read."""
    return spark.read.parquet(path).count()


def write_lines(rows: DataFrame, path: str, column: str = "value") -> None:
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def read_json_trees(spark: SparkSession, path: str) -> DataFrame:
    """One tree a line: (sample_id, ast); lines that aren't JSON are left out."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("sample_id"), F.col("value").alias("ast"))
    return rows.where(F.try_parse_json("ast").isNotNull())


def append_metrics(rows: DataFrame, path: str) -> None:
    """(run, step, name, value) rows appended to a log."""
    rows.select("run", "step", "name", "value").write.mode("append").parquet(path)


def latest_snapshot(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The path of the file that was changed last."""
    return listing(spark, path, pattern).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def next_run(spark: SparkSession, path: str, prefix: str) -> int:
    """One more than the highest number among files or folders named prefix-N."""
    row = listing(spark, path).select(F.max(F.try_to_number(F.nullif(F.regexp_extract("path", rf"/{prefix}-(\d+)[/.]?", 1), F.lit("")), F.lit("999999999"))).alias("n")).first()
    return int(row["n"] or 0) + 1


def external_parser(rows: DataFrame, command: list[str], code: str = "code", timeout: float = 600.0) -> DataFrame:
    """rows with ast: what a command prints for each text given to its standard input; null where it fails.

    The command is started once for each text in the tasks, so it must be installed where the executors run.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", ast string"

    def parse(text: str) -> str | None:
        try:
            return subprocess.run(command, input=text or "", capture_output=True, text=True, timeout=timeout, check=True).stdout
        except (OSError, subprocess.SubprocessError):
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(ast=[parse(x) for x in frame[code]])

    return rows.mapInPandas(run, schema)


def epochs(rows: DataFrame, n: int, seed: int, *ids: str) -> Iterator[DataFrame]:
    """The rows in a new order for each of n epochs, by hashes of the ids."""
    for k in range(n):
        yield shuffled(rows, seed + k, *ids)


def samples_in_order(rows: DataFrame, *order: str) -> Iterator:
    """Rows one by one at the driver, a partition at a time, the next one fetched ahead."""
    return (rows.orderBy(*order) if order else rows).toLocalIterator(prefetchPartitions=True)
