"""Texts are dealt out by what they hold before they become many rows."""

from __future__ import annotations

import pytest

from thicket.operators import metrics as M
from thicket.plans import QUERIES


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("name", ["lm_view", "pointer_ids", "pointer_mask"])
def test_samples_of_a_language_model_are_shuffled_as_texts(name, spark, small):
    assert shuffles(QUERIES[name](spark, small)) == 1


def test_bleu_counts_where_its_texts_are(spark, monkeypatch):
    rows = [(k, [f"a b c d {k % 3} e".split(), None, f"b c d {k} e".split()], None if k == 5 else f"b c d {k % 2} e f".split()) for k in range(30)]
    rows = spark.createDataFrame([*rows, (99, None, []), (98, [], ["a"])], "key int, references array<array<string>>, candidate array<string>")
    want = sorted(map(tuple, M.bleu(rows, "key").collect()))
    monkeypatch.setattr(M, "GRAMS", 20)
    out = M.bleu(rows, "key")
    assert sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(key" in plan and "gram" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


@pytest.mark.parametrize("name", ["coverage", "dense_contexts"])
def test_contexts_are_made_once(name, spark, small):
    """What vocabularies and columns share is read from a table, not made again for each."""
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "conversations.parquet" not in plan


def test_a_clean_text_is_lexed_once(monkeypatch):
    X = pytest.importorskip("thicket.functions.lexing")
    if X.pygments is None:
        pytest.skip("no lexer package")
    for text in ("a = 1", "\n\na\r\nb\n\n", "﻿x = 'y'\n", "", "a\tb \n  c"):
        clean = X.collapse_empty_lines(X.blank_comments(text, "python"))
        if clean == "".join(t.text for t in X.lex(text, "python")):
            assert X.lex(clean, "python") == X.lex(text, "python")


def test_a_view_reads_its_vocabulary_and_words_from_tables(spark, small):
    plan = QUERIES["summarisation_view"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "view-vocabulary" in plan and "view-words" in plan
