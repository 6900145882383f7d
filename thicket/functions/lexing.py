"""Code text to tokens: lexing with spans, cleaning, masking, indentation, sub-tokens.

A lexer's own rules are sequential, so `lexed` runs them in Arrow-backed batches; what follows (masks, indentation, parts of
names) are windows and columns over rows of lexemes, in `operators.lexemes`. The lexer package is optional.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.text import sub_tokens
from thicket.operators import lexemes as L
from thicket.schema import NUM_SUB_TOKENS
from thicket.session import bucketed

try:
    import pygments
    import pygments.lexers
except ImportError:  # lexing is then not available; everything else is
    pygments = None

COMMENT, DOC, BLOCK = "Token.Comment", "Token.Literal.String.Doc", "Token.Comment.Multiline"
_CAMEL = re.compile("[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")


class PreprocessingError(ValueError):
    """A text that can't become a sample."""


def is_kind(token_type: str, kind: str) -> bool:
    """Whether a type is the kind or one of its sub-kinds."""
    return token_type == kind or token_type.startswith(kind + ".")


@dataclass(frozen=True)
class Lexeme:
    """Text, its type, and where it starts and ends: (line, column) from 1, the end open."""

    text: str
    kind: str
    start: tuple[int, int]
    end: tuple[int, int]


@cache
def _lexer(language: str):
    return pygments.lexers.get_lexer_by_name(language)


def lex(code: str, language: str) -> list[Lexeme]:
    """Tokens of the lexer of that name, with spans."""
    if pygments is None:
        raise PreprocessingError("the lexer package isn't installed")
    out, line, col = [], 1, 1
    for kind, text in pygments.lex(code, _lexer(language)):
        start = (line, col)
        breaks = text.count("\n")
        line += breaks
        col = len(text) - text.rfind("\n") if breaks else col + len(text)
        out.append(Lexeme(text, str(kind), start, (line, col)))
    return out


def blank_comments(code: str, language: str) -> str:
    """Block comments and documentation strings become a space. A line comment goes before a line end, becomes a line
    end before anything else, and stays where it is the last token."""
    return _without_comments(lex(code, language))


def _without_comments(tokens: list[Lexeme]) -> str:
    parts = []
    for k, t in enumerate(tokens):
        if is_kind(t.kind, BLOCK) or is_kind(t.kind, DOC):
            parts.append(" ")
        elif is_kind(t.kind, COMMENT) and k + 1 < len(tokens):
            parts.append("" if tokens[k + 1].text == "\n" else "\n")
        else:
            parts.append(t.text)
    return "".join(parts)


def collapse_empty_lines(code: str) -> str:
    lines = code.splitlines(keepends=True)
    return "".join(x for k, x in enumerate(lines) if not (k and x.isspace() and lines[k - 1].isspace()))


def split_identifier(name: str) -> list[str]:
    """Parts of a name, lower-cased; the name itself where there are none."""
    return [w.lower() for part in name.split("_") if part for w in _CAMEL.findall(part)] or [name]


@dataclass(frozen=True)
class LexConfig:
    """code_filters: text -> text, in the workers, after cleaning. token_filters: rows of lexemes -> rows, as `operators.lexemes` has them."""

    language: str
    allow_flat: bool = False
    num_sub_tokens: int = NUM_SUB_TOKENS
    code_filters: tuple[Callable[[str], str], ...] = ()
    token_filters: tuple[Callable[[DataFrame], DataFrame], ...] = field(default=())


LEXEMES = "array<struct<text: string, kind: string, start: struct<line: int, col: int>, end: struct<line: int, col: int>>>"


def lexed(rows: DataFrame, config: LexConfig, code: str = "code") -> DataFrame:
    """rows with clean_code and lexemes. This is all that needs the lexer's own rules, and so Python."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", clean_code string, lexemes {LEXEMES}"
    place = lambda p: {"line": p[0], "col": p[1]}

    def run(frames):
        for frame in frames:
            out = []
            for text in frame[code]:
                tokens = lex(text or "", config.language)
                clean = collapse_empty_lines(_without_comments(tokens))
                for f in config.code_filters:
                    clean = f(clean)
                # the lexer puts line ends in order and drops a leading mark before it begins; a text that it left and cleaning didn't change has the same tokens
                if clean.startswith("\ufeff") or clean != "".join([t.text for t in tokens]):
                    tokens = lex(clean, config.language)
                out.append((clean, [{"text": t.text, "kind": t.kind, "start": place(t.start), "end": place(t.end)} for t in tokens]))
            done = pd.DataFrame(out, columns=["clean_code", "lexemes"], index=frame.index)
            yield pd.concat([frame, done], axis=1)

    return rows.mapInPandas(run, schema)


def lexed_by_sample(rows: DataFrame, config: LexConfig, code: str = "code") -> DataFrame:
    """`lexed`, written in buckets by sample: texts are shuffled, their lexemes, which take many times as much, aren't."""
    spark = rows.sparkSession
    n = max(-(-(rows.agg(F.sum(F.octet_length(code))).first()[0] or 0) // L.DEALT), spark.sparkContext.defaultParallelism)
    return bucketed(lexed(rows.repartition(n, L.S), config, code), L.S, n, "lexed")


def tokenized(rows: DataFrame, config: LexConfig, code: str = "code", done: DataFrame | None = None) -> DataFrame:
    """rows (by sample_id) with clean_code, tokens and error: string runs and numbers masked, indentation marked, names in parts.
    A text without a change of indentation has null tokens and the reason, unless allow_flat, and harms no other. done: the rows lexed and written, if the caller
    wants to discard them."""
    done = lexed_by_sample(rows, config, code) if done is None else done
    lexemes = done.select(L.S, F.posexplode("lexemes").alias("idx", "t")).select(L.S, F.col("idx").cast("bigint").alias("idx"), "t.text", "t.kind", "t.start", "t.end")
    styles = L.indent_styles(done.select(L.S, "clean_code"), "clean_code")
    out = L.drop_spaces(L.indented(L.mask_numbers(L.mask_strings(lexemes)), styles, allow_flat=config.allow_flat))
    for g in config.token_filters:
        out = g(out)
    token = F.struct(sub_tokens(F.col("text"), F.col("kind"), config.num_sub_tokens).alias("sub_tokens"), F.col("kind").alias("token_type"), F.struct("start", "end").alias("span"))
    lists = out.select(L.S, F.struct("idx", token.alias("t")).alias("x")).groupBy(L.S).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]).alias("_tokens"))
    joined = done.drop("lexemes").join(lists, L.S, "left").join(styles.withColumnRenamed("style", "_style"), L.S, "left")
    fails = F.col("_style").isNull() & F.lit(not config.allow_flat)
    none = F.array().cast(TOKENS)
    return joined.withColumns({"tokens": F.when(~fails, F.coalesce("_tokens", none)), "error": F.when(fails, "no indentation to tell the style from")}).drop("_tokens", "_style")


TOKENS = "array<struct<sub_tokens: array<string>, token_type: string, span: struct<start: struct<line: int, col: int>, end: struct<line: int, col: int>>>>"
