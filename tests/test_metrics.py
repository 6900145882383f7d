"""Metrics on small predictions: ids padded with 3, 0 is unknown."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from thicket.operators import metrics as M

PAD, UNK = 3, 0
def P():
    return F.col("pred")


def L():
    return F.col("label")



def pad(x, n=5):
    return [*x, *[PAD] * (n - len(x))]


def frame(spark, pairs):
    return spark.createDataFrame([(pad(p), pad(l)) for p, l in pairs], "pred array<int>, label array<int>")  # noqa: E741


def value(spark, pairs, metric):
    return frame(spark, pairs).agg(metric.alias("v")).first()["v"]


def mean(*x):
    return sum(x) / len(x)


def test_precision(spark):
    assert value(spark, [([10, 11, 12], [11, 10]), ([10, 10, 10, 11], [10, 11, 12, 13, 14])], M.precision(P(), L(), PAD)) == pytest.approx(5 / 6)
    assert value(spark, [([10, 11, 12], [11, 10, 12]), ([13, 14], [15, 16, 17])], M.precision(P(), L(), PAD)) == pytest.approx(1 / 2)
    rows = [([10, 11, 12], [11, 10, 12]), ([13, 14], []), ([], []), ([], [15])]
    assert value(spark, rows, M.precision(P(), L(), PAD)) == pytest.approx(1 / 2)
    assert value(spark, rows, M.precision(P(), L())) == pytest.approx(mean(1, 3 / 5, 1, 1))


def test_recall(spark):
    rows = [([10, 11], [11, 10, 12]), ([10, 11, 12, 13], [11, 10, 12]), ([], []), ([], [15]), ([10, 11], []), ([10, 11], [15])]
    assert value(spark, rows, M.recall(P(), L(), PAD)) == pytest.approx(mean(2 / 3, 1, 1, 0, 0, 0))


def test_top1(spark):
    rows = [([10, 11], [10, 11]), ([10, 11], [10, 11, 12]), ([], []), ([], [15]), ([10, 11], []), ([10, 11], [10])]
    assert value(spark, rows, M.top1_accuracy(P(), L())) == pytest.approx(mean(1, 0, 1, 0, 0, 0))


def test_topk(spark):
    ranked = [[10, 20, 30], [11, 21, 31], [3], [3], [3]]
    df = spark.createDataFrame([(ranked, pad(x)) for x in ([10, 11], [20, 31], [15, 21])], "r array<array<int>>, label array<int>")
    assert df.agg(M.topk_accuracy(F.col("r"), L()).alias("v")).first()["v"] == pytest.approx(2 / 3)


def test_non_trivial_is_null_without_any(spark):
    assert value(spark, [([10, 11], [10]), ([10, 11], [20])], M.non_trivial_accuracy(P(), L(), PAD)) is None


def test_unknown_labels(spark):
    rows = [([10, 12, 11], [11, 10, 9, UNK]), ([13, 14], [UNK, 14]), ([], []), ([], [UNK]), ([10, 10, 10], [10]), ([10, 10], [UNK, UNK, 10])]
    assert value(spark, rows, M.precision(P(), L(), PAD, UNK)) == pytest.approx(mean(2 / 3, 1 / 2, 1, 1, 1))
    assert value(spark, rows, M.recall(P(), L(), PAD, UNK)) == pytest.approx(mean(2 / 3, 1, 1, 1, 1))
    rows = [([10, 11, 13], [10, 11, UNK]), ([10, 11, 12], [10, 11, 12]), ([10, 11, 22], [30, 31, 32]), ([10], [UNK]), ([20], [20]), ([], [])]
    assert value(spark, rows, M.top1_accuracy(P(), L(), PAD, UNK)) == pytest.approx(mean(1, 1, 0, 1, 1))
    assert value(spark, rows, M.non_trivial_accuracy(P(), L(), PAD, UNK)) == pytest.approx(mean(1, 1, 0))


def test_best_known(spark):
    s = spark.createDataFrame([(1, 0, 9.0), (1, 30, 5.0), (1, 31, 2.0), (2, 0, 1.0)], "k int, token int, score double")
    assert {(r.k, r.token) for r in M.best_known(s, "k").collect()} == {(1, 30), (2, 0)}


def test_micro_and_macro(spark):
    rows = frame(spark, [([10, 11], [10, 11]), ([10, 12, 12], [10, 11]), ([], []), ([UNK], [10])])
    r = M.micro(rows, pad=PAD, unk=UNK).first()
    assert (r.tp, r.fp, r.fn) == (2 + 1 + 1, 2, 1 + 1)
    assert r.f1 == pytest.approx(2 * r.precision * r.recall / (r.precision + r.recall))
    assert M.macro(rows, pad=PAD, unk=UNK).first()["f1"] == pytest.approx(mean(1, 2 * (1 / 3) * (1 / 2) / (5 / 6), 1, 0))


def test_rouge(spark):
    df = spark.createDataFrame([("a b c d".split(), "a c d e".split()), ([], ["x"])], "pred array<string>, label array<string>")
    two, l = df.select(M.rouge_n(P(), L(), 2).alias("s")).collect()[0].s, df.select(M.rouge_l(P(), L()).alias("s")).collect()  # noqa: E741
    assert two.p == pytest.approx(1 / 3) and two.r == pytest.approx(1 / 3)
    assert l[0].s.p == pytest.approx(3 / 4) and l[1].s.f == 0


def test_smoothing(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.5],)], "s array<double>")
    plain, smooth = df.select(M.smoothed_loss(F.col("s"), F.lit(1), 0.0), M.smoothed_loss(F.col("s"), F.lit(1), 0.1)).first()
    z = sum(math.exp(x) for x in (1.0, 2.0, 0.5))
    assert plain == pytest.approx(-math.log(math.exp(2) / z)) and smooth > plain


def test_rouge_l_takes_whole_turns(spark, small):
    from thicket.plans import QUERIES

    text = {(r.conv_id, r.turn): r.text.lower().split(" ") for r in spark.read.parquet(f"{small}/conversations.parquet").collect() if r.text is not None}
    rows = [r for r in QUERIES["rouge_l"](spark, small).collect() if (r.conv_id, r.turn) in text and (r.conv_id, r.turn + 1) in text]
    longest = sorted(rows, key=lambda r: -len(text[r.conv_id, r.turn]))[:5]
    assert len(text[longest[0].conv_id, longest[0].turn]) > 12
    for r in longest:
        a, b = text[r.conv_id, r.turn], text[r.conv_id, r.turn + 1]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert (r.p, r.r) == pytest.approx((t[-1][-1] / len(a), t[-1][-1] / len(b)))
