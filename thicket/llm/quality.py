"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in Arrow batches; the trees are fitted in numpy on a sample of labelled
rows bounded by `max_train_rows` (a documented parameter, 20,000 by default: some MB on the driver) and flattened
into heap-ordered arrays, which every task traverses for all its rows and all trees at once.

Defined cases: a null text counts as empty and is scored like any other; a null doc_id is scored and counts as
not held out (crc32 of null is null); repeated rows give repeated results; labels with a null quality or
doc_id, or whose document is missing, are not learnt from; with no labelled row of both kinds the score is the
share of label 1 (0.5 without labels); extra columns are dropped; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import _words as W
from thicket.session import ship

_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 11, 12, 13), "line": (10,), "end": b".?;:", "comma": b",", "bang": b"!", "sign": b"#*$%&@^~", "bar": b"|<>{}[]()=_\\/+-", "high": range(128, 256)}
_KIND_OF = np.full(256, len(_KINDS), np.int64)
for _k, _v in enumerate(_KINDS.values()):
    _KIND_OF[list(_v)] = _k
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False
FEATURES = [*(f"share_{k}" for k in [*_KINDS, "other"]), "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "words_bare", "log_lines", "line_words", "distinct_lines", "top_line"]


def _repeats(first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: distinct values, and occurrences of the commonest one."""
    n = len(first) - 1
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    key = np.sort((row << np.uint64(44)) | (h >> np.uint64(20)))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    owner, runs = (key[at] >> np.uint64(44)).astype(np.int64), np.diff(np.append(at, len(key)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, runs)
    return np.bincount(owner, minlength=n), top


def statistics(texts: pa.Array) -> np.ndarray:
    """(rows, FEATURES) of whole texts."""
    raw, offs = W.text_bytes(texts)
    n, size = len(offs) - 1, np.diff(offs)
    k = len(_KINDS) + 1
    row = np.repeat(np.arange(n) * k, size)
    row += _KIND_OF[raw]
    counts = np.bincount(row, minlength=n * k).reshape(n, k)
    del row
    first, h, starts, ends = W.split_words(raw, offs, W.IS_TOKEN, spans=True)
    words = np.diff(first)
    distinct, top = _repeats(first, h)
    plain = (_KIND_OF[raw[ends - 1]] <= 2) | (_KIND_OF[raw[ends - 1]] == len(_KINDS) - 1) if len(ends) else np.zeros(0, bool)
    bare = W.row_sums(plain, first)
    length = W.row_sums(ends - starts, first)
    lfirst, lh = W.split_words(raw, offs, _NOT_NEWLINE)
    lines = np.diff(lfirst)
    ldistinct, ltop = _repeats(lfirst, lh)
    one = lambda x: np.maximum(x, 1)
    return np.column_stack([counts / one(size)[:, None], np.log1p(size), np.log1p(words), length / one(words), distinct / one(words), top / one(words), bare / one(words), np.log1p(lines), words / one(lines), ldistinct / one(lines), ltop / one(lines)]).astype(np.float32)


@dataclass(frozen=True)
class BoostParams:
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    l2: float = 1.0
    min_hessian: float = 2.0
    max_train_rows: int = 20_000


@dataclass(frozen=True)
class Trees:
    """Complete binary trees in heap order: node k has children 2k+1 (value <= threshold) and 2k+2."""

    base: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray  # the same shape
    value: np.ndarray  # (trees, 2**depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; all trees of all rows descend level by level together."""
        n_trees, inner = self.feature.shape
        rows, tree = np.arange(len(x))[:, None], np.arange(n_trees)[None, :]
        at = np.zeros((len(x), n_trees), np.int64)
        while n_trees and inner and at.size and at.flat[0] < inner:
            at = 2 * at + 1 + (x[rows, self.feature[tree, at]] > self.threshold[tree, at])
        margin = self.base + (self.value[tree, at - inner].sum(axis=1) if n_trees else np.zeros(len(x)))
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, p: BoostParams = BoostParams()) -> Trees:
    """Second-order boosting of the logistic loss on binned features, one level of a tree at a time."""
    inner = (1 << p.depth) - 1
    share = float(y.mean()) if len(y) else 0.5
    if len(np.unique(y)) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int32), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins + 1)[1:-1]).astype(np.float32)) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]).astype(np.int64)  # bin b: x <= edges[b]
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        feat, thr = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
        node = np.zeros(n, np.int64)
        for level in range(p.depth):
            width, start = 1 << level, (1 << level) - 1
            local = node - start
            best, best_f, best_b = np.zeros(width), np.zeros(width, np.int64), np.full(width, -1)
            sum_g, sum_h = np.bincount(local, g, width), np.bincount(local, h, width)
            for j in range(f):
                if not len(edges[j]):
                    continue
                key = local * p.bins + binned[j]
                left_g = np.cumsum(np.bincount(key, g, width * p.bins).reshape(width, -1), axis=1)[:, : len(edges[j])]
                left_h = np.cumsum(np.bincount(key, h, width * p.bins).reshape(width, -1), axis=1)[:, : len(edges[j])]
                right_g, right_h = sum_g[:, None] - left_g, sum_h[:, None] - left_h
                gain = left_g**2 / (left_h + p.l2) + right_g**2 / (right_h + p.l2) - (sum_g**2 / (sum_h + p.l2))[:, None]
                gain[(left_h < p.min_hessian) | (right_h < p.min_hessian)] = 0
                b = gain.argmax(axis=1)
                top = gain[np.arange(width), b]
                better = top > best + 1e-9
                best[better], best_f[better], best_b[better] = top[better], j, b[better]
            for k in np.flatnonzero(best_b >= 0):
                feat[start + k], thr[start + k] = best_f[k], edges[best_f[k]][best_b[k]]
            node = 2 * node + 1 + (x[np.arange(n), feat[node]] > thr[node])
        leaf = node - inner
        value = -p.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + p.l2)
        margin += value[leaf]
        features.append(feat)
        thresholds.append(thr)
        values.append(value)
    return Trees(base, np.stack(features), np.stack(thresholds), np.stack(values))


def held_out(doc_id):
    """Rows that are never learnt from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, p: BoostParams = BoostParams()) -> Trees:
    """Fits the trees on at most max_train_rows labelled rows of docs, chosen by a hash of their ids."""
    ship(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") > 0).cast("double").alias("y"))
        .join(ids, "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(p.max_train_rows)
    )
    # max_train_rows ids at most: broadcast by that bound
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def run(batches):
        for batch in batches:
            for part in W.slices(batch):
                x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "y", "x"])

    # repeated ids give more rows than there are ids, so the bound is kept once more
    got = rows.mapInArrow(run, "doc_id bigint, y double, x array<float>").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(p.max_train_rows).toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0), p)
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    y = got["y"].to_numpy()
    order = np.lexsort([*x.T[::-1], y, got["doc_id"].to_numpy()])  # reruns agree whatever the order of arrival
    return fit(x[order], y[order], p)


def scored(docs: DataFrame, trees: Trees, name: str = "score", keep: bool = False) -> DataFrame:
    """doc_id and the score (in a column of that name) of every row; with keep, all columns of docs before it."""
    ship(docs.sparkSession)
    if not keep:
        docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    columns = [c for c in docs.columns if keep or c != "text"]

    def run(batches):
        for batch in batches:
            for part in W.slices(batch):
                s = np.round(trees.score(statistics(part.column("text"))), 9)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(s, pa.float64())], names=[*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema) + f", {name} double"
    return docs.mapInArrow(run, schema)


THRESHOLD = 0.7


def classify(docs: DataFrame, labels: DataFrame, p: BoostParams = BoostParams()) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from THRESHOLD on) of every document."""
    out = scored(docs, train(docs, labels, p))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, p: BoostParams = BoostParams()) -> DataFrame:
    """The rows of docs that the classifier predicts as good, with their columns."""
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    return scored(docs, train(docs, labels, p), name, keep=True).where(F.col(name) >= THRESHOLD).drop(name)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
