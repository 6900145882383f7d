"""The pipeline against each stage's plain version, on what the stage before kept."""

import pytest

import __spark_entry__
import corpus_pipeline as P
from tests.llm.helpers import alnum, edge_rows, prose, table
from tests.llm.test_contamination import plain as hits
from tests.llm.test_mixing import fill
from tests.llm.test_neardup import groups
from tests.llm.test_substrings import plain as repeats
from thicket.llm import quality
from thicket.llm._store import written


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, f in P.STAGES:
        docs = written(f(spark, docs, small), "test")
        out.append(docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "near-duplicates", "substring dedup", "decontamination", "mixing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_keeps_what_it_predicts(spark, stages, small):
    out = quality.classify(stages[0], spark.read.parquet(f"{small}/labels.parquet"))
    assert ids(stages[1]) == {r.doc_id for r in out.where("predicted = 1").collect()} != ids(stages[0])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    good = [d for d in ids(stages[0]) if labels.get(d) == 1]
    assert sum(d in ids(stages[1]) for d in good) >= 0.97 * len(good)


def test_one_near_duplicate_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert ids(stages[2]) == set(groups(rows).values())


def test_repeats_go_decontamination_and_mix(spark, stages, small):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = {d: (t if not g else kept) for (d, t), (_, _, g, _, kept) in zip(rows, repeats(rows), strict=True)}
    assert {r.doc_id: r.text for r in stages[3].collect()} == want
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    assert min(len(alnum(t)) for _, t in items) >= 10
    clean = {d for d, *_, bad in hits(list(want.items()), items) if not bad}
    assert ids(stages[4]) == clean
    size = {}
    for r in stages[4].collect():
        size[r.source] = size.get(r.source, 0) + len(r.text.split())
    target = fill({s: size[s] for s in sorted(size)})
    taken = {}
    for r in stages[5].collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert ids(stages[5]) == clean and all(abs(taken[s] - target[s]) <= 1 for s in size)


def test_run_equals_the_stages(spark, stages, small):
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(P.run(spark, small)) == key(stages[-1])
    assert "pipeline" in __spark_entry__.queries()


@pytest.fixture
def folder(spark, tmp_path):
    """Small labels and a benchmark, with nulls."""
    spark.createDataFrame([(k, k % 2, 0) for k in range(200, 260)] + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i1", prose(900, 12)), (None, "no id"), ("i2", None), ("i3", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def through(spark, docs, folder):
    for _, f in P.STAGES[:-1]:
        after = written(f(spark, docs, folder), "edge")
        assert after.columns == docs.columns
        docs = after
    return docs, P.STAGES[-1][1](spark, docs, folder)


def test_edge_rows_go_through_every_stage(spark, folder):
    good = [(k, prose(k, 80), "a") for k in range(201, 260, 2)]
    bad = [(k, "buy now !!! " * 30, None) for k in range(200, 260, 2)]
    rows = edge_rows() + good + bad + good[:3] + [(201, prose(5000, 60), "a"), (None, prose(6000, 60), None), (300, prose(900, 12) + " " + prose(7000, 40), "b")]
    docs, mixed = through(spark, table(spark, rows), folder)
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(kept) == len(set(kept))
    assert {(d, t) for d, t, _ in good} <= set(kept) and (201, prose(5000, 60)) in kept and (None, prose(6000, 60)) in kept
    assert not any(d in {b[0] for b in bad} for d, _ in kept) and 300 not in {d for d, _ in kept}
    assert mixed.count() == len(kept)


def test_empty_documents(spark, folder):
    docs, mixed = through(spark, table(spark, []), folder)
    assert docs.count() == mixed.count() == 0
