"""Tokenizers as plug-ins: any function from a text to tokens becomes a table function, called by lateral join.

A tokenizer gives (text, kind, (line, column), (line, column)) tuples, lines and columns from 1, the end open. A text that it can't read
(any exception) gives one token of kind Token.Error with the reason, so it harms no other, and the filter on errors finds it.
"""

from __future__ import annotations

import io
import re
import tokenize as py
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from thicket.session import ship

Place = tuple[int, int]
Tokenizer = Callable[[str], Iterable[tuple[str, str, Place, Place]]]
TOKENIZERS: dict[str, Tokenizer] = {}
ROWS = "idx bigint, text string, kind string, start struct<line: int, col: int>, `end` struct<line: int, col: int>"


def tokenizer(name: str):
    """Registers a tokenizer under a name."""

    def add(f: Tokenizer) -> Tokenizer:
        if name in TOKENIZERS:
            raise ValueError(f"two tokenizers are named {name}")
        TOKENIZERS[name] = f
        return f

    return add


def from_python(token: py.TokenInfo) -> tuple[str, str, Place, Place]:
    """A token of Python's own tokenizer, whose columns count from 0."""
    (a, b), (c, d) = token.start, token.end
    return token.string, f"Token.Python.{py.tok_name[token.type]}", (a, b + 1), (c, d + 1)


def from_semantic(symbol: dict) -> tuple[str, str, Place, Place]:
    """A symbol of a parser's JSON: {"symbol", "kind", "span": {"start": {"line", "column"}, "end": ...}}."""
    place = lambda p: (p["line"], p["column"])
    return symbol["symbol"], symbol.get("kind", ""), place(symbol["span"]["start"]), place(symbol["span"]["end"])


@tokenizer("python")
def python_tokens(text: str):
    """Python's own tokenizer: code only."""
    return map(from_python, py.tokenize(io.BytesIO(text.encode()).readline))


@tokenizer("words")
def words(text: str):
    """Runs of characters without white space."""
    for n, line in enumerate(text.split("\n"), 1):
        for m in re.finditer(r"[^ \t\r]+", line):
            yield m[0], "Token.Text", (n, m.start() + 1), (n, m.end() + 1)


def table_function(tokenize: Tokenizer):
    """The table function of a tokenizer; it goes to the workers with it."""

    class Rows:
        def eval(self, code: str):
            if code is None:
                return
            place = lambda p: {"line": p[0], "col": p[1]}
            try:
                found = [(k, text, kind, place(a), place(b)) for k, (text, kind, a, b) in enumerate(tokenize(code))]
            except Exception as e:  # a plug-in's: any
                found = [(0, str(e), "Token.Error", place((1, 1)), place((1, 1)))]
            yield from found

    return udtf(Rows, returnType=ROWS)


def tokenized(rows: DataFrame, name: str, code: str = "code", key: str = "sample_id") -> DataFrame:
    """(key, idx, text, kind, start, end) of the named tokenizer for every row; null texts have no tokens."""
    spark: SparkSession = rows.sparkSession
    ship(spark)
    function = f"thicket_tokens_{re.sub('[^a-z0-9]', '_', name.lower())}"
    spark.udtf.register(function, table_function(TOKENIZERS[name]))
    return spark.sql(f"select s.`{key}`, t.* from {{rows}} s, lateral {function}(s.`{code}`) t", rows=rows)
