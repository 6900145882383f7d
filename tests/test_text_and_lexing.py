"""Splitting rules against a plain restatement, and the lexer's filters."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from thicket.functions import lexing as X
from thicket.functions import text as T


def by_rules(s: str) -> list[str]:
    """Character by character: classes are upper, digit, special and lower."""
    kind = lambda c: "U" if "A" <= c <= "Z" else "D" if "0" <= c <= "9" else "l" if "a" <= c <= "z" else "S"
    out: list[str] = []
    for k, c in enumerate(s):
        before = kind(s[k - 1]) if k else None
        if before is None or (kind(c) != before and not (before == "U" and kind(c) == "l")):
            out.append(c)
        elif before == "U" and kind(c) == "l" and len(out[-1]) > 1:
            out[-1], last = out[-1][:-1], out[-1][-1]
            out.append(last + c)
        else:
            out[-1] += c
    return out


def test_camel_case(spark):
    random.seed(3)
    words = ["".join(random.choice("aBcD12$#") for _ in range(random.randrange(1, 12))) for _ in range(2000)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.split_camel_case(F.col("w")).alias("p")).collect()
    for r in got:
        assert r.p == by_rules(r.w), r.w


@pytest.mark.parametrize(
    ("name", "parts"),
    [("get_HTTPResponse2Code", ["get", "http", "response", "2", "code"]), ("__init__", ["init"]), ("___", ["___"]), ("aB", ["a", "b"])],
)
def test_identifiers(spark, name, parts):
    row = spark.createDataFrame([(name,)], "n string").select(T.split_identifier(F.col("n")).alias("p")).first()
    assert row.p == parts == X.split_identifier(name)


def test_comments_and_blank_lines(spark):
    code = 'a = "// no"; // yes\n/* x\n y */b\n'
    assert spark.range(1).select(T.remove_comments(F.lit(code)).alias("c")).first().c == 'a = "// no"; \nb\n'
    lines = "a\n\n  \n\nb\n"
    assert spark.range(1).select(T.collapse_blank_lines(F.lit(lines)).alias("c")).first().c == X.collapse_empty_lines(lines) == "a\n\nb\n"


def test_pad_strict(spark):
    df = spark.createDataFrame([(["a"],)], "a array<string>")
    assert df.select(T.pad_strict(F.col("a"), 2, F.lit("p")).alias("x")).first().x == ["a", "p"]
    with pytest.raises(Exception, match="longer"):
        df.select(T.pad_strict(F.col("a"), 0, F.lit("p")).alias("x")).collect()


pygments = pytest.importorskip("pygments")


def test_lexer_spans():
    code = "def f(x):\n    return x\n"
    lines = code.split("\n")
    for t in X.lex(code, "python"):
        if "\n" not in t.text:
            assert lines[t.start[0] - 1][t.start[1] - 1 : t.end[1] - 1] == t.text


def samples(spark, *codes):
    return spark.createDataFrame(list(enumerate(codes)), "sample_id bigint, code string")


def test_strings_numbers_and_indent(spark):
    code = "def f(x):\n    y = 'a' \"b\"\n    if y:\n        return 12\n    return y\n"
    row = X.tokenized(samples(spark, code), X.LexConfig("python")).first()
    words = [w for t in row.tokens for w in t.sub_tokens]
    assert words.count("[MASK_NUMBER]") == 1 and words.count("[INDENT]") == 2 and words.count("[DEDENT]") == 1
    assert "[MASK_STRING]" in words and " " not in words and row.clean_code == code
    assert row.tokens[0].span == ((1, 1), (1, 4)) and row.tokens[0].sub_tokens == ["def"]


def test_flat_and_faulty_texts(spark):
    df = samples(spark, "def f():\n    return 1\n", "x = 1\n", None)
    got = {r.sample_id: r for r in X.tokenized(df, X.LexConfig("python")).collect()}
    assert got[0].tokens and got[0].error is None and got[1].tokens is None and got[1].error and got[2].error
    flat = {r.sample_id: r for r in X.tokenized(df, X.LexConfig("python", allow_flat=True)).collect()}
    assert flat[0].tokens == got[0].tokens and flat[1].tokens and len(flat[2].tokens) <= 1 and not any(r.error for r in flat.values())


def test_own_filters(spark):
    upper = lambda code: code.upper()
    no_names = lambda rows: rows.where("text <> 'Y'")
    row = X.tokenized(samples(spark, "y\n  z\n"), X.LexConfig("python", code_filters=(upper,), token_filters=(no_names,))).first()
    assert row.clean_code == "Y\n  Z\n" and [w for t in row.tokens for w in t.sub_tokens if w.isalpha()] == ["z"]
