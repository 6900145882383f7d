"""Incremental counters and event-time windows as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from thicket.operators.vocab import counts
from thicket.session import scratch


def table_glob(path: str) -> str:
    """The path as a pattern that matches it alone: a stream's source may then be a single file as well as a folder."""
    return f"{path[:-1]}[{path[-1]}]"


def events(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """The events table as a stream, with ts as a zoned timestamp."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(table_glob(path)).withColumn("ts", F.col("ts").cast("timestamp"))


def word_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """Running word counts of a stream of texts (update or complete mode)."""
    return counts(texts.select(F.explode(F.split(column, " ")).alias("word")))


def tumbling(rows: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in windows; what comes later than `late` is dropped."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user: runs of events without a longer gap."""
    return rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def merge_counts(spark: SparkSession, path: str, key: str = "word") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: counts of each batch are written under its number, so a batch that runs twice counts once."""

    def merge(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.count("*").alias("cnt")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return merge


def merged_counts(spark: SparkSession, path: str, key: str = "word") -> DataFrame:
    return spark.read.parquet(path).groupBy(key).agg(F.sum("cnt").alias("cnt"))


def sink(path: str, after: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the rows of a batch as files under its number. A batch that runs again after a failure replaces what it wrote before.
    after: called when a batch is written, before the stream notes it as done (tests stop a stream there)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        if after:
            after(number)

    return write


def durable(rows: DataFrame, path: str, mode: str = "update", after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Starts a stream of aggregates into files below a path, with its checkpoint beside them: started anew on the same path it goes on
    where it stopped. With `update` a batch holds the groups that it changed, with `complete` all of them."""
    spark = rows.sparkSession
    spark.createDataFrame([], rows.schema).write.mode("ignore").parquet(f"{path}/data/batch=-1")
    return rows.writeStream.foreachBatch(sink(path, after)).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, *keys: str, mode: str = "update") -> DataFrame:
    """The groups as the last batch left them: of each key the row of its last batch, or all rows of the last batch."""
    rows = spark.read.parquet(f"{path}/data")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(last), "batch", "left_semi").drop("batch")  # one row
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")


def run_to_end(rows: DataFrame, name: str, *keys: str, mode: str = "update") -> DataFrame:
    """Runs a stream over all input that is there, and gives its groups then. State and results are in the shared folder."""
    path = scratch(rows.sparkSession, name)
    durable(rows, path, mode).awaitTermination()
    return latest(rows.sparkSession, path, *keys, mode=mode).select(*rows.columns)
