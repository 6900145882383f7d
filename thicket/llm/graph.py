"""Connected components of a link table, distributed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm._store import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some links, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        rx, ry = up[x], up[y]
        apart = rx != ry
        if not apart.any():
            return nodes, nodes[up]
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(up, np.maximum(rx, ry), np.minimum(rx, ry))
        while (up != up[up]).any():
            up = up[up]


def _labels(batches):
    links = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    nodes, roots = _roots(links["a"].to_numpy(), links["b"].to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "label"])


def components(links: DataFrame, most: int = 1 << 20) -> DataFrame:
    """links (a, b) -> (node, label): the smallest node of the component, for every node that has a link.

    At most `most` links (16 MB) are solved in one task. More alternate large-star and small-star steps. Each groups by a node only to
    take a minimum, which is pre-aggregated, and joins it back, so a node with very many links is split like any skewed join key.
    Both ends of a link get larger-to-smaller edges; the steps end when the edges no longer change.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(edges)
    if before[0] <= most:
        return written(edges.repartition(1).mapInArrow(_labels, "node bigint, label bigint"), "labels")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour of a node points to the node's smallest neighbour
        star = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(low.withColumnRenamed("a", "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        least = star.groupBy("a").agg(F.min("b").alias("m"))
        joined = star.join(least, "a")
        edges = written(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "star")
        after = _state(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
        before = after
