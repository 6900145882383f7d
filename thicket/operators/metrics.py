"""Evaluation of predicted against true parts of names: column expressions over two arrays, and their aggregates.

pred and label are arrays of equal length, padded with `pad`; `unk` marks unknown parts. Without pad or unk their rules
don't apply. Aggregates are avg and sum, so they are pre-aggregated, per group or with rollup.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def _all(a: Column, f) -> Column:
    return F.forall(a, f)


def _only(a: Column, value) -> Column:
    return F.forall(a, lambda x: x == value)


def _kept(a: Column, *gone) -> Column:
    return F.filter(a, lambda x: ~x.isin(*gone)) if gone else a


def _hits(a: Column, b: Column) -> Column:
    """Elements of a that occur in b, repeats counted."""
    return F.size(F.filter(a, lambda x: F.array_contains(b, x)))


def counts_for_metrics(label: Column, pad=None, unk=None) -> Column:
    """Whether a row takes part: rows whose label is only unknown parts (and padding) don't."""
    if unk is None:
        return F.lit(True)
    return ~F.forall(label, lambda x: (x == unk) | (x == pad)) | _only(label, pad)


def exact(pred: Column, label: Column, unk=None) -> Column:
    """All parts agree; unknown parts of the label agree with anything."""
    same = lambda a, b: (a == b) if unk is None else (a == b) | (b == unk)
    return _all(F.zip_with(pred, label, same), lambda x: x)


def exact_at(ranked: Column, label: Column, unk=None) -> Column:
    """ranked: the best k predictions of each part; each must hold the label's."""
    same = lambda r, b: F.array_contains(r, b) if unk is None else F.array_contains(r, b) | (b == unk)
    return _all(F.zip_with(ranked, label, same), lambda x: x)


def top1_accuracy(pred: Column, label: Column, pad=None, unk=None) -> Column:
    return F.avg(F.when(counts_for_metrics(label, pad, unk), exact(pred, label, unk).cast("double")))


def topk_accuracy(ranked: Column, label: Column, pad=None, unk=None) -> Column:
    return F.avg(F.when(counts_for_metrics(label, pad, unk), exact_at(ranked, label, unk).cast("double")))


def non_trivial_accuracy(pred: Column, label: Column, pad, unk=None) -> Column:
    """Over labels of two parts and more; null without any."""
    takes_part = (F.size(_kept(label, pad)) >= 2) & counts_for_metrics(label, pad, unk)
    return F.avg(F.when(takes_part, exact(pred, label, unk).cast("double")))


def row_precision(pred: Column, label: Column, pad=None) -> Column:
    if pad is None:
        return _hits(pred, label) / F.size(pred)
    real = _kept(pred, pad)
    return F.when(F.size(real) == 0, _only(label, pad).cast("double")).otherwise(F.try_divide(_hits(real, label), F.size(real)))


def row_recall(pred: Column, label: Column, pad=None, unk=None) -> Column:
    if pad is None:
        real = _kept(label, *([unk] if unk is not None else []))
        return F.try_divide(_hits(real, pred), F.size(real))
    real = _kept(label, pad, *([unk] if unk is not None else []))
    return F.when(_only(label, pad), _only(pred, pad).cast("double")).otherwise(F.try_divide(_hits(real, pred), F.size(real)))


def precision(pred: Column, label: Column, pad=None, unk=None) -> Column:
    return F.avg(F.when(counts_for_metrics(label, pad, unk), row_precision(pred, label, pad)))


def recall(pred: Column, label: Column, pad=None, unk=None) -> Column:
    return F.avg(F.when(counts_for_metrics(label, pad, unk), row_recall(pred, label, pad, unk)))


def true_false(pred: Column, label: Column, pad=None, unk=None, joined: bool = False) -> Column:
    """struct(tp, fp, fn) of a row. joined: also equal if the parts spell the same word together."""
    gone = [x for x in (pad, unk) if x is not None]
    p, l = _kept(pred, *gone), _kept(label, *gone)  # noqa: E741
    same = (p == l) | ((F.array_join(p, "") == F.array_join(l, "")) if joined else F.lit(False))
    both_empty = (_only(pred, pad) & _only(label, pad)) if pad is not None else F.lit(False)
    tp = F.when(both_empty, 1).when(same, F.size(l)).otherwise(_hits(p, l))
    fp = F.when(both_empty | same, 0).otherwise(F.size(p) - _hits(p, l))
    fn = F.when(both_empty | same, 0).otherwise(F.size(l) - _hits(l, p))
    return F.struct(tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"), fn.cast("bigint").alias("fn"))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 from counts; 0 where there is nothing to divide by."""
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def micro(rows: DataFrame, *keys: str, pad=None, unk=None, joined: bool = False, rollup: bool = False) -> DataFrame:
    """Corpus precision, recall and F1 from summed counts, per group; with rollup, totals too (null keys)."""
    c = rows.withColumn("_c", true_false(F.col("pred"), F.col("label"), pad, unk, joined))
    groups = c.rollup(*keys) if rollup else c.groupBy(*keys)
    sums = groups.agg(F.sum("_c.tp").alias("tp"), F.sum("_c.fp").alias("fp"), F.sum("_c.fn").alias("fn"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select(*keys, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def macro(rows: DataFrame, *keys: str, pad=None, unk=None) -> DataFrame:
    """Means of the rows' own precision, recall and F1."""
    c = rows.withColumn("_c", true_false(F.col("pred"), F.col("label"), pad, unk))
    p, r, f = prf(F.col("_c.tp"), F.col("_c.fp"), F.col("_c.fn"))
    return c.groupBy(*keys).agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f).alias("f1"))


def ngrams(a: Column, n: int) -> Column:
    """Distinct runs of n parts, joined."""
    starts = F.when(F.size(a) >= n, F.sequence(F.lit(1), F.size(a) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(a, i, F.lit(n)), " ")))


def rouge_n(pred: Column, label: Column, n: int) -> Column:
    """struct(p, r, f) by overlap of distinct n-grams."""
    a, b = ngrams(pred, n), ngrams(label, n)
    both = F.size(F.array_intersect(a, b))
    p, r = F.coalesce(F.try_divide(both, F.size(a)), F.lit(0.0)), F.coalesce(F.try_divide(both, F.size(b)), F.lit(0.0))
    return F.struct(p.alias("p"), r.alias("r"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f"))


@F.pandas_udf(IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence; a row of the usual table is the bits of one integer."""

    def one(x, y):
        if x is None or y is None:
            return None
        at: dict = {}
        for k, w in enumerate(y):
            at[w] = at.get(w, 0) | 1 << k
        every = (1 << len(y)) - 1
        row = every
        for w in x:
            same = row & at.get(w, 0)
            row = (row + same | row - same) & every
        return len(y) - row.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def rouge_l(pred: Column, label: Column) -> Column:
    both = lcs(pred, label)
    p, r = F.coalesce(F.try_divide(both, F.size(pred)), F.lit(0.0)), F.coalesce(F.try_divide(both, F.size(label)), F.lit(0.0))
    return F.struct(p.alias("p"), r.alias("r"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f"))


def or_empty(words: Column) -> Column:
    """A name without parts is the one word EMPTY."""
    return F.when(F.size(words) == 0, F.array(F.lit("EMPTY"))).otherwise(words)


def rouge_1(pred: Column, label: Column) -> Column:
    return rouge_n(or_empty(pred), or_empty(label), 1)


def rouge_2(pred: Column, label: Column) -> Column:
    return rouge_n(or_empty(pred), or_empty(label), 2)


#: Metrics of (pred, label) by name, as aggregates; see `metric` for the names with _no_unk.
METRICS: dict = {
    "top1_accuracy": top1_accuracy,
    "non_trivial_accuracy": non_trivial_accuracy,
    "precision": precision,
    "recall": recall,
    "micro_precision": lambda p, l, pad=None, unk=None: F.try_divide(F.sum(true_false(p, l, pad, unk)["tp"]), F.sum(true_false(p, l, pad, unk)["tp"] + true_false(p, l, pad, unk)["fp"])),
    "micro_recall": lambda p, l, pad=None, unk=None: F.try_divide(F.sum(true_false(p, l, pad, unk)["tp"]), F.sum(true_false(p, l, pad, unk)["tp"] + true_false(p, l, pad, unk)["fn"])),
}


def metric(name: str, pred: Column, label: Column, pad=None, unk=None, best=None) -> Column:
    """A registered metric by name. name_no_unk: of predictions of which the best known part was taken (`best`) where the first is unknown."""
    if name.endswith("_no_unk"):
        return METRICS[name.removesuffix("_no_unk")](pred if best is None else best, label, pad, unk)
    return METRICS[name](pred, label, pad, unk)


def same_name(pred: Column, label: Column) -> Column:
    """Equal lists, equal sets, or the same word when joined."""
    return (pred == label) | (F.array_sort(F.array_distinct(pred)) == F.array_sort(F.array_distinct(label))) | (F.array_join(pred, "") == F.array_join(label, ""))


def best_known(scores: DataFrame, *keys: str, token: str = "token", score: str = "score", unk=0) -> DataFrame:
    """The best-scored token of each group that isn't unknown; the unknown one where it is alone."""
    w = Window.partitionBy(*keys).orderBy((F.col(token) == unk).cast("int"), F.col(score).desc(), token)
    return scores.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def smoothed_loss(scores: Column, target: Column, smoothing: float = 0.0) -> Column:
    """Cross-entropy of a row of scores with label smoothing."""
    top = F.array_max(scores)
    total = F.log(F.reduce(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top
    n = F.size(scores)
    hit = F.element_at(scores, target + 1) - total
    every = F.reduce(scores, F.lit(0.0), lambda s, x: s + x) - n * total
    rest = F.lit(smoothing) / (n - 1)
    return -((1 - smoothing) * hit + rest * (every - hit))


#: Words whose n-grams a task counts.
GRAMS = 200_000


def bleu(rows: DataFrame, key: str, references: str = "references", candidate: str = "candidate", most: int = 4) -> DataFrame:
    """(order, matches, total, precision, brevity_penalty, bleu): corpus BLEU of candidates (words) against one or more references each.

    An n-gram of a candidate counts as often as it is in that reference which has it most; counts are summed over the corpus. The length to compare with
    is that of the closest reference, the shorter on ties. A corpus without a match of some order has BLEU 0; empty candidates and references
    add their lengths alone. Rows that share a key are one text, so keys have to differ.

    Texts are dealt out by key, in as many partitions as their words want; their n-grams are made and counted there, and only sums leave.
    """
    held = F.size(F.coalesce(F.flatten(F.filter(references, lambda w: w.isNotNull())), F.array())) + F.size(F.coalesce(candidate, F.array()))
    total = rows.agg(F.sum(held)).first()[0] or 0
    rows = rows.repartition(max(1, -(-total // GRAMS)), key)
    grams = lambda words, n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda at: F.slice(words, at, n)))
    sides = F.concat(F.array(F.struct(F.lit(-1).alias("side"), F.col(candidate).alias("words"))), F.transform(references, lambda w, k: F.struct(k.cast("int").alias("side"), w.alias("words"))))
    texts = rows.select(key, F.explode(sides).alias("x")).select(key, "x.side", "x.words").where("words is not null")
    flat = texts.select(key, "side", F.explode(F.array(*(F.struct(F.lit(n).alias("order"), grams(F.col("words"), n).alias("grams")) for n in range(1, most + 1)))).alias("g"))
    flat = flat.select(key, "side", "g.order", F.explode("g.grams").alias("gram"))
    counts = flat.groupBy(key, "order", "gram", "side").agg(F.count("*").alias("n"))
    both = counts.groupBy(key, "order", "gram").agg(F.coalesce(F.max(F.when(F.col("side") < 0, F.col("n"))), F.lit(0)).alias("c"), F.coalesce(F.max(F.when(F.col("side") >= 0, F.col("n"))), F.lit(0)).alias("r"))
    orders = both.groupBy("order").agg(F.sum(F.least("c", "r")).alias("matches"), F.sum("c").alias("total"))
    size = F.coalesce(F.size(candidate), F.lit(0))
    near = F.array_min(F.transform(F.filter(references, lambda w: w.isNotNull()), lambda w: F.struct(F.abs(F.size(w) - size).alias("off"), F.size(w).alias("n"))))["n"]
    lengths = rows.agg(F.sum(F.greatest(size, F.lit(0))).alias("c"), F.sum(F.coalesce(near, F.lit(0))).alias("r"))
    every = rows.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("order"))
    scored = every.join(orders, "order", "left").select("order", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("matches", "total")))
    scored = scored.withColumn("precision", F.when(F.col("total") > 0, F.col("matches") / F.col("total")).otherwise(0.0))
    penalty = F.when((F.col("c") == 0) | F.col("c").isNull(), 0.0).when(F.col("c") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("c")))
    whole = lengths.select(penalty.alias("brevity_penalty"))
    mean = Window.partitionBy("brevity_penalty")  # one row an order
    log = F.when(F.min("precision").over(mean) > 0, F.exp(F.avg(F.ln(F.when(F.col("precision") > 0, F.col("precision")))).over(mean))).otherwise(0.0)
    return scored.join(F.broadcast(whole)).select("order", "matches", "total", "precision", "brevity_penalty", (F.col("brevity_penalty") * log).alias("bleu"))
