"""String functions as native column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from thicket.schema import NUM_LABEL_TOKENS

CAMEL = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"
#: Between a lower and an upper case letter, and before the last upper case letter of a run that a word follows.
CAMEL_EDGE = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
SUBTOKEN_EDGE = r"(?<=[a-z])(?=[A-Z])|_|[0-9]|(?<=[A-Z])(?=[A-Z][a-z])|\s+"
LEGAL_IDENTIFIER = "^[a-zA-Z0-9_?$@!*`&~:/'.]+$"
#: Numeric literals that keep their text in paths.
NUMERIC_LITERALS_KEPT = ("0", "1", "2", "3", "4", "5", "10")


def _nonempty(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def split_camel_case(s: Column) -> Column:
    """Runs of one class of characters: Upper (with the lower case letters behind its last one), digits, others."""
    return F.regexp_extract_all(s, F.lit(CAMEL), F.lit(0))


def split_identifier(s: Column) -> Column:
    """Lower-cased parts by underscores and camel case; the identifier itself where nothing is left."""
    parts = F.flatten(F.transform(_nonempty(F.split(s, "_")), split_camel_case))
    return F.when(F.size(parts) == 0, F.array(s)).otherwise(F.transform(parts, F.lower))


def label_tokens(name: Column, most: int = NUM_LABEL_TOKENS) -> Column:
    """Parts of the last dotted part of a method's name."""
    return F.slice(split_identifier(F.substring_index(name, ".", -1)), 1, most)


def sub_tokens(text: Column, token_type: Column, most: int) -> Column:
    """Parts of a name, or the text itself for tokens that aren't names; `most` at most."""
    return F.slice(F.when(token_type.startswith("Token.Name"), split_identifier(text)).otherwise(F.array(text)), 1, most)


def path_name(name: Column) -> Column:
    """A name in a path context: parts at underscores and camel-case edges, lower-cased, joined by pipes."""
    parts = F.flatten(F.transform(F.split(name, "_"), lambda b: _nonempty(F.split(b, CAMEL_EDGE))))
    return F.when(name.isin("METHODNAME", "NUM"), name).otherwise(F.array_join(F.transform(parts, F.lower), "|"))


def normalize_name(s: Column, default: str = "BLANK") -> Column:
    """Letters of a name, lower-cased; without letters, the name with spaces as underscores, or the default.

    The second pattern is two slashes and the letter s, as the original has it: it isn't white space.
    """
    t = F.lower(s)
    for pattern in (r"\\\\n", "//s+", "[\"',]", r"\P{Print}"):
        t = F.regexp_replace(t, pattern, "")
    letters, careful = F.regexp_replace(t, "[^A-Za-z]", ""), F.regexp_replace(t, " ", "_")
    return F.when(letters != "", letters).when(careful != "", careful).otherwise(F.lit(default))


def split_to_subtokens(s: Column) -> Column:
    """Normalised parts of a name, as the Java extractor has them."""
    parts = _nonempty(F.split(F.trim(F.replace(s, F.lit("|"), F.lit(" "))), SUBTOKEN_EDGE))
    return _nonempty(F.transform(parts, lambda w: normalize_name(w, "")))


def normalize_name_cs(s: Column) -> Column:
    """As the C# extractor has it: literal replacements of texts that look like patterns, ASCII only, kept numerals."""
    t = F.replace(F.replace(F.lower(s), F.lit("\\\\n"), F.lit("")), F.lit("[\"',]"), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(t, r"\s", ""), r"[^\x00-\x7F]", "")
    t = F.replace(t, F.lit(","), F.lit("C"))
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    digits = F.when(t.isin(*NUMERIC_LITERALS_KEPT), t).otherwise(F.lit("NUM"))
    return F.when(letters != "", letters).when(t.rlike("^[0-9]+$"), digits).otherwise(F.lit(""))


def split_name_unless_empty(s: Column) -> Column:
    """Parts of a name joined by pipes; SPACE where nothing is left of it."""
    parts = _nonempty(F.transform(_nonempty(F.split(F.trim(s), SUBTOKEN_EDGE)), normalize_name_cs))
    joined = F.array_join(parts, "|")
    name = F.when(joined != "", joined).otherwise(normalize_name_cs(s))
    return F.when(s == "METHOD_NAME", s).when(F.trim(name) == "", F.lit("SPACE")).otherwise(name)


def letters_only(s: Column) -> Column:
    """Lower-cased letters of a word; words without letters are lower-cased as they are."""
    kept = F.regexp_replace(s, "[^a-zA-Z]", "")
    return F.lower(F.when(kept == "", s).otherwise(kept))


def split_verbose(s: Column) -> Column:
    """Words, numbers, then whatever is left, without lone underscores; case is kept."""
    return F.filter(F.regexp_extract_all(s, F.lit(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+|.+"), F.lit(0)), lambda w: w != "_")


def normalize_word(s: Column) -> Column:
    """A counter's key: stripped of blanks, tabs and carriage returns, lower-cased."""
    return F.lower(F.btrim(s, F.lit(" \t\r")))


def collapse_blank_lines(code: Column) -> Column:
    """Runs of blank lines become their first one."""
    return F.regexp_replace(code, r"(?m)(^[^\S\n]*\n)(?:[^\S\n]*\n)+", "$1")


def remove_comments(code: Column) -> Column:
    """Block and line comments go; quoted strings stay as they are."""
    return F.regexp_replace(code, r"""(?ms)("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(/\*.*?\*/|//[^\r\n]*$)""", "$1")


def pad_or_truncate(a: Column, n: int, pad: Column) -> Column:
    return F.slice(F.concat(a, F.array_repeat(pad, n)), 1, n)


def pad_strict(a: Column, n: int, pad: Column) -> Column:
    """Padded to n; an error for longer ones."""
    message = F.concat(F.lit("list of "), F.size(a).cast("string"), F.lit(f" is longer than {n}"))
    return F.when(F.size(a) > n, F.raise_error(message).cast("array<string>")).otherwise(pad_or_truncate(a, n, pad))


def chunks(a: Column, k: int) -> Column:
    """Consecutive runs of k elements."""
    n = F.ceil(F.size(a) / k).cast("int")
    return F.when(F.size(a) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(a, i * k + 1, F.lit(k))))


def span_contains(outer: Column, inner: Column) -> Column:
    return (outer["start"] <= inner["start"]) & (outer["end"] >= inner["end"])


def span_intersects(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def span_size(span: Column) -> Column:
    """Lines, then columns: comparable."""
    return F.struct((span["end"]["line"] - span["start"]["line"]).alias("lines"), (span["end"]["col"] - span["start"]["col"]).alias("cols"))


def substring_by_span(code: Column, span: Column) -> Column:
    """The text of a span: lines and columns count from 1, the end is open; line ends are kept."""
    lines = F.slice(F.split(code, "\n"), span["start"]["line"], span["end"]["line"] - span["start"]["line"] + 1)
    n = F.size(lines)

    def cut(line: Column, i: Column) -> Column:
        left = F.when(i == 0, span["start"]["col"]).otherwise(F.lit(1))
        right = F.when(i == n - 1, span["end"]["col"]).otherwise(F.length(line) + 1)
        return F.substr(line, left, F.greatest(right - left, F.lit(0)))

    return F.array_join(F.transform(lines, cut), "\n")


def reconstruct(tokens: Column) -> Column:
    """Sub-tokens joined by underscores, tokens by spaces."""
    return F.array_join(F.transform(tokens, lambda t: F.array_join(t["sub_tokens"], "_")), " ")
