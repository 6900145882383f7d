import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import edge_rows, prose, table
from thicket.llm import quality as Q


def test_trees_split_what_a_stump_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    t = Q.fit(x[:1500], y[:1500])
    assert ((t.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_flat_traversal_equals_walking():
    rng = np.random.default_rng(2)
    x = rng.random((300, 4)).astype(np.float32)
    t = Q.fit(x, (x[:, 2] > x[:, 1]).astype(float), Q.BoostParams(trees=7, depth=3))
    for row, s in zip(x[:50], t.score(x[:50]), strict=True):
        margin = t.base
        for f, thr, v in zip(t.feature, t.threshold, t.value, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > thr[k])
            margin += v[k - len(f)]
        assert s == pytest.approx(1 / (1 + np.exp(-margin)))


def test_statistics_of_one_text():
    x = dict(zip(Q.FEATURES, Q.statistics(pa.array(["Ab cd, cd cd\nAb cd, cd cd\n"]))[0], strict=True))
    assert x["share_upper"] == pytest.approx(2 / 26) and x["distinct_words"] == pytest.approx(3 / 8)
    assert x["top_word"] == pytest.approx(4 / 8) and x["distinct_lines"] == pytest.approx(1 / 2) and x["words_bare"] == pytest.approx(6 / 8)


def test_edge_cases_and_missing_labels(spark):
    docs = table(spark, edge_rows())
    for labels in ([], [(1, 1, 0)], [(None, 1, 0), (4, None, 0), (99, 1, 0)], [(4, 1, 0), (4, 1, 0), (5, 0, 0), (2, 0, 0)]):
        got = Q.classify(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
        assert len(got) == len(edge_rows())
        for r in got:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert Q.classify(table(spark, []), spark.createDataFrame([], "doc_id bigint, quality int")).count() == 0


def test_accepts_by_score_and_keeps_columns(spark):
    rows = [(k, prose(k, 80)) for k in range(60)] + [(100 + k, "!! ".join(prose(k, 80).upper().split())) for k in range(60)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(d, int(d < 100)) for d, _ in rows], "doc_id bigint, quality int")
    out = Q.accepted(docs, labels)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == set(range(60))
    assert {r.quality_score for r in out.collect()} == {"q"}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = Q.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toArrow()
    assert (out["predicted"].to_numpy() == out["quality"].to_numpy()).mean() > 0.97
