"""Tokens of code as rows: lexing by rules, string runs, numbers and indentation, all as columns and windows.

Rows are (sample_id, idx, text, kind, start, end): idx orders the tokens of a sample; start and end are (line, col) from 1,
the end open. Windows are within a sample, so one shuffle on sample_id serves them all: that of the texts, if `dealt` deals them out
before they are cut. A sample is bounded by the token limit of its methods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

S = "sample_id"
# Kinds that the rules look for, as the lexer names them.
STRING, NUMBER, NAME, WHITE, PUNCTUATION = "Token.Literal.String", "Token.Literal.Number", "Token.Name", "Token.Text.Whitespace", "Token.Punctuation"
# Texts of masks and marks.
MASK_STRING, MASK_NUMBER, INDENT, DEDENT = "[MASK_STRING]", "[MASK_NUMBER]", "[INDENT]", "[DEDENT]"
COLUMNS = [S, "idx", "text", "kind", "start", "end"]

#: (kind, pattern) of a small lexer for any language with quoted strings; the first that matches counts. Together they match every character.
RULES = ((STRING, r'"[^"\n]*"'), (WHITE, r"\n[ \t]*|[ \t]+"), (NUMBER, r"[0-9]+"), (NAME, r"[A-Za-z0-9_]+"), (PUNCTUATION, r"[^\n]"))
#: Ends of lines, as text is cut into lines.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
_SPACES = r"(?U)^[\s\x1C-\x1F]+$"
_LEADING = r"(?U)^[\s\x1C-\x1F]*"


def _in_order() -> Window:
    return Window.partitionBy(S).orderBy("idx")


#: Bytes of text whose tokens a task holds: they take hundreds of times as much once they are sorted for windows.
DEALT = 1 << 19


def dealt(rows: DataFrame, text: str = "code", sample: str = S, held: int = DEALT) -> DataFrame:
    """rows in partitions by sample of about `held` bytes of text: their number follows the text, so what a task holds doesn't grow with the
    input. Texts are shuffled here, before they become tokens; windows and groups of a sample need no other shuffle."""
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return rows.repartition(max(1, -(-total // held)), sample)


def is_kind(kind: Column, wanted: str) -> Column:
    """Whether a kind is the wanted one or one of its sub-kinds."""
    return (kind == wanted) | kind.startswith(wanted + ".")


def is_space(text: Column) -> Column:
    """Only white space, and some of it."""
    return text.rlike(_SPACES)


def by_rules(rows: DataFrame, code: str = "code", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Lexemes of (sample_id, code) by a list of (kind, pattern). What no pattern matches is left out."""
    whole = "|".join(f"(?:{p})" for _, p in rules)
    found = rows.select(S, F.posexplode(F.regexp_extract_all(code, F.lit(whole), F.lit(0))).alias("idx", "text"))
    kind = F.coalesce(*(F.when(F.col("text").rlike(f"^(?:{p})$"), k) for k, p in rules), F.lit("Token.Error"))
    return placed(found.select(S, F.col("idx").cast("bigint").alias("idx"), "text", kind.alias("kind")))


def placed(tokens: DataFrame) -> DataFrame:
    """Spans of tokens that cover their text without gaps: lines by counting line feeds, columns from the last one."""
    before, upto = (_in_order().rowsBetween(Window.unboundedPreceding, e) for e in (-1, 0))
    n = F.length("text")
    tail = n - F.length(F.substring_index("text", "\n", -1))  # characters up to the last line feed
    rows = tokens.withColumns({"_n": n.cast("bigint"), "_breaks": (n - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("bigint"), "_off": F.coalesce(F.sum(n).over(before), F.lit(0))})
    rows = rows.withColumn("_line_at", F.when(F.col("_breaks") > 0, F.col("_off") + tail))

    def place(w: Window, offset: Column) -> Column:
        line = F.coalesce(F.sum("_breaks").over(w), F.lit(0)) + 1
        col = offset - F.coalesce(F.max("_line_at").over(w), F.lit(0)) + 1
        return F.struct(line.cast("int").alias("line"), col.cast("int").alias("col"))

    return rows.withColumns({"start": place(before, F.col("_off")), "end": place(upto, F.col("_off") + F.col("_n"))}).select(*COLUMNS)


def mask_strings(tokens: DataFrame, mask: str = MASK_STRING) -> DataFrame:
    """Islands of neighbouring string tokens become one token over their span, in the place of the first. An island that ends the sample goes."""
    inside = is_kind(F.col("kind"), STRING)
    w = _in_order()
    rows = tokens.withColumn("_in", inside).withColumn("_first", F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)))
    rows = rows.withColumns({"_run": F.when(F.col("_in"), F.sum(F.col("_first").cast("int")).over(w)), "_more": F.lead("idx").over(w).isNotNull()})
    runs = Window.partitionBy(S, "_run").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_stop": F.last("end").over(runs), "_goes_on": F.last("_more").over(runs)})
    kept = rows.where(~F.col("_in") | (F.col("_first") & F.col("_goes_on")))
    one = lambda new, old: F.when(F.col("_in"), new).otherwise(F.col(old))
    return kept.select(S, "idx", one(F.lit(mask), "text").alias("text"), one(F.lit(STRING), "kind").alias("kind"), "start", one(F.col("_stop"), "end").alias("end"))


def mask_numbers(tokens: DataFrame, mask: str = MASK_NUMBER) -> DataFrame:
    return tokens.withColumn("text", F.when(is_kind(F.col("kind"), NUMBER), F.lit(mask)).otherwise(F.col("text")))


def indent_changes(rows: DataFrame, code: str = "code") -> DataFrame:
    """(sample_id, change, cnt): how often the indentation of neighbouring lines differs by so much. Lines of white space alone are left
    out; an empty line has indentation 0."""
    lines = rows.select(S, F.posexplode(F.split(F.regexp_replace(code, rf"(?:{LINE_END})\z", ""), LINE_END)).alias("line", "text")).where(~is_space(F.col("text")))
    depth = F.length(F.regexp_extract("text", _LEADING, 0))
    steps = lines.select(S, F.abs(depth - F.lag(depth).over(Window.partitionBy(S).orderBy("line"))).alias("change"))
    return steps.where("change > 0").groupBy(S, "change").agg(F.count("*").alias("cnt"))


def indent_styles(rows: DataFrame, code: str = "code") -> DataFrame:
    """(sample_id, style): the commonest change of indentation, the smallest on ties; samples without any have no row."""
    return indent_changes(rows, code).groupBy(S).agg(F.min_by("change", F.struct(-F.col("cnt"), "change")).alias("style"))


def indented(tokens: DataFrame, styles: DataFrame, fix_first: bool = True, allow_flat: bool = False, indent: str = INDENT, dedent: str = DEDENT) -> DataFrame:
    """Tokens with a mark for every step of indentation before the first token of a line, and without white space but line ends.

    A line's indentation is what follows the last line feed before it, and the spaces up to its first token. Lines that don't stand at a
    whole number of steps change nothing; as the level starts at 0, it is always the last whole one before. fix_first: the first such line
    below line 1 is one step in, wherever it stands. Samples without a style are left out, or keep their tokens without marks if allow_flat.
    """
    w = _in_order()
    space, broken = is_space(F.col("text")), F.contains("text", F.lit("\n"))
    pieces = F.split(F.regexp_replace("text", rf"(?:{LINE_END})\z", ""), LINE_END)
    rows = tokens.join(styles, S, "left" if allow_flat else "inner").withColumns({"_space": space, "_end": space & broken})
    rows = rows.withColumns({"_line": F.sum(F.col("_end").cast("int")).over(w), "_width": F.when(F.col("_end"), F.length(F.element_at(pieces, -1))).otherwise(F.length("text"))})
    of_line = Window.partitionBy(S, "_line").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_opens": ~F.col("_space") & ~F.coalesce(F.bool_or(~F.col("_space")).over(of_line), F.lit(False)), "_depth": F.coalesce(F.sum("_width").over(of_line), F.lit(0))})
    rows = rows.withColumn("_whole", F.col("_opens") & (F.col("_depth") % F.col("style") == 0))
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_whole") & (F.col("start.line") > 1)
    rows = rows.withColumns({"_level": F.coalesce(F.last(F.when(F.col("_whole"), F.col("_depth")), ignorenulls=True).over(earlier), F.lit(0)), "_is_first": below & ~F.coalesce(F.bool_or(below).over(earlier), F.lit(False))})
    steps = F.expr("(_depth - _level) div style")
    steps = F.when(F.col("_whole"), F.when(F.col("_is_first"), F.lit(1)).otherwise(steps) if fix_first else steps).otherwise(F.lit(0)).cast("int")
    ends = F.when(F.col("style").isNull() | (F.size(pieces) < 2), F.lit("\n")).otherwise(F.concat(F.array_join(F.slice(pieces, F.lit(1), F.size(pieces) - 1), "\n"), F.lit("\n")))
    rows = rows.where(~F.col("_space") | F.col("_end")).withColumns({"_steps": steps, "text": F.when(F.col("_end"), ends).otherwise(F.col("text"))})

    at = lambda col: F.struct(F.col("start.line").alias("line"), col.cast("int").alias("col"))

    def mark(k: Column) -> Column:
        kind = F.when(F.col("_steps") > 0, F.lit(indent)).otherwise(F.lit(dedent))
        near, far = (F.when(F.col("_steps") > 0, (k - 1 + j) * F.col("style") + 1).otherwise(F.lit(1)) for j in (0, 1))
        return F.struct(kind.alias("text"), kind.alias("kind"), at(near).alias("start"), at(far).alias("end"))

    marks = F.transform(F.slice(F.sequence(F.lit(0), F.abs("_steps")), 2, F.abs("_steps")), mark)
    out = rows.select(S, "idx", F.posexplode(F.concat(marks, F.array(F.struct("text", "kind", "start", "end")))).alias("_k", "_t"))
    return out.select(S, F.struct("idx", "_k").alias("place"), "_t.text", "_t.kind", "_t.start", "_t.end").withColumn("idx", (F.row_number().over(Window.partitionBy(S).orderBy("place")) - 1).cast("bigint")).select(*COLUMNS)


def drop_spaces(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("text") != " ")
