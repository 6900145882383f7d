"""Named queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Columns given to six decimals on both sides: their last bits depend on the order of summation.
ROUNDED: dict[str, tuple[str, ...]] = {
    "adj_normalized": ("value",),
    "area_bins": ("edge",),
    "bleu": ("precision", "brevity_penalty", "bleu"),
    "binary_prf": ("precision", "recall", "f1"),
    "count_bins": ("edge",),
    "distance_bins": ("edge",),
    "context_stats": ("mean_contexts", "mean_sampled"),
    "label_smoothing": ("loss",),
    "macro_f1": ("precision", "recall", "f1"),
    "macro_precision_recall": ("precision", "recall"),
    "metric_registry": ("value",),
    "micro_prf": ("precision", "recall", "f1"),
    "non_trivial_accuracy": ("accuracy",),
    "per_language_metrics": ("mean_tokens",),
    "per_language_rollup": ("precision", "recall", "f1"),
    "pointer_probability": ("p",),
    "positional_encoding": ("v",),
    "project_overlap": ("overlap",),
    "rouge_1": ("p", "r", "f"),
    "rouge_2": ("p", "r", "f"),
    "rouge_empty": ("p", "r"),
    "stream_tumbling": ("total",),
    "top1_accuracy": ("accuracy",),
    "topk_accuracy": ("accuracy",),
}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) under a name; sql: DuckDB text for the same rows, where it can be said."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        columns = ROUNDED.get(name, ())

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})

        QUERIES[name] = run if columns else f
        if sql:
            replaced = ", ".join(f"round({c}::double, 6) as {c}" for c in columns)
            SQL[name] = f"select * replace ({replaced}) from ({sql})" if columns else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed(seed: int, *keys: str) -> str:
    """SQL of `operators.views.hashed`."""
    return f"md5(concat_ws(':', '{seed}', {', '.join(keys)}))"


def uniform(seed: int, *keys: str) -> str:
    """SQL of `operators.views.uniform`."""
    return f"('0x' || substr({hashed(seed, *keys)}, 1, 13))::bigint / 4503599627370496.0"
