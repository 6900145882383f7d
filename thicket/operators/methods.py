"""Methods of source files in a language with braces: names, bounds and bodies by matching brackets.

Files are lexed by rules (`lexemes.by_rules`), so brackets in comments, strings and characters are no brackets. Brackets are matched by running depth:
an opening one and the next closing one of the same depth are a pair. A body is a brace whose head is a list of
parameters behind a name, with or without a throws clause; what the head begins with, and which class it is in, are the last such things before it.
All that is windows over the tokens of a file; texts are cut out last, of the methods that are left by their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators import lexemes as L

S = L.S
COMMENT, OPEN, CLOSE, WORD, TEXT = "comment", "open", "close", "word", "text"
# Words before a bracket that make no method, and words that begin the name of a type.
CONTROL = ("if", "for", "while", "switch", "catch", "synchronized", "try", "do", "else", "return", "throw", "new", "super", "this", "assert", "case")
TYPES = ("class", "interface", "enum", "record")
#: What a file is cut into; the first kind that matches counts, and every character is in some token.
RULES = (
    (COMMENT, r"/\*(?s:.*?)(?:\*/|\z)|//[^\n]*"),
    (TEXT, r'"""(?s:.*?)"""|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|\'[^\'\\\n]*(?:\\.[^\'\\\n]*)*\''),
    (L.WHITE, r"\s+"),
    (WORD, r"[\p{L}_$][\p{L}\p{N}_$]*"),
    (L.NUMBER, r"[0-9][0-9A-Za-z_.]*"),
    (OPEN, r"[({]"),
    (CLOSE, r"[)}]"),
    (L.PUNCTUATION, r"(?s:.)"),
)


def _numbered(files: DataFrame) -> DataFrame:
    """Tokens but for space and comments, numbered (k), with their place in the text and the comment right before them."""
    w = Window.partitionBy(S).orderBy("idx")
    rows = L.by_rules(files, "code", RULES)
    rows = rows.withColumn("off", F.sum(F.length("text")).over(w) - F.length("text")).where(F.col("kind") != L.WHITE)
    rows = rows.withColumn("doc", F.when(F.lag("kind").over(w) == COMMENT, F.lag("text").over(w))).where(F.col("kind") != COMMENT)
    return rows.select(S, "text", "kind", "off", "doc", F.col("start.line").alias("line"), F.row_number().over(w).alias("k"))


def _matched(rows: DataFrame, opening: str, closing: str, name: str) -> DataFrame:
    """rows with the depth of such brackets around a token (a bracket itself is outside), and the token of its partner."""
    w = Window.partitionBy(S).orderBy("k")
    step = F.when(F.col("text") == opening, 1).when(F.col("text") == closing, -1).otherwise(0)
    bracket = F.col("kind").isin(OPEN, CLOSE) & F.col("text").isin(opening, closing)
    upto = F.sum(F.when(bracket, step).otherwise(0)).over(w)
    rows = rows.withColumn(f"{name}_depth", upto - F.when(bracket & (F.col("text") == opening), 1).otherwise(0))
    pair = Window.partitionBy(S, f"{name}_depth", bracket).orderBy("k")
    ahead, back = (f(F.struct("k", "text", "off", "line")).over(pair) for f in (F.lead, F.lag))
    other = F.when(bracket & (F.col("text") == opening) & (ahead["text"] == closing), ahead).when(bracket & (F.col("text") == closing) & (back["text"] == opening), back)
    return rows.withColumn(name, other)


def found(files: DataFrame) -> DataFrame:
    """(sample_id, name, kind, class_name, doc, first_line, body_line, last_line, at, body_at, stop) of the methods and constructors with a body: where
    they begin, where the body begins and where it ends (characters from 0)."""
    w = Window.partitionBy(S).orderBy("k")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    is_one = lambda t, kind: (F.col("text") == t) & (F.col("kind") == kind)
    latest = lambda cond, value, over: F.last(F.when(cond, value), ignorenulls=True).over(over)
    rows = _matched(_matched(_numbered(files), "(", ")", "round"), "{", "}", "brace")

    # a head begins behind the last statement or block; the braces of arrays are no blocks
    block = ~F.coalesce(F.lag("text").over(w), F.lit(";")).isin("(", "=", ",", "[", "]")
    braces = Window.partitionBy(S, "brace_depth", F.col("text").isin("{", "}") & F.col("kind").isin(OPEN, CLOSE)).orderBy("k")
    rows = rows.withColumn("block", is_one("{", OPEN) & block)
    rows = rows.withColumn("ends", is_one(";", L.PUNCTUATION) | F.col("block") | (is_one("}", CLOSE) & F.coalesce(F.lag("block").over(braces), F.lit(True))))
    rows = rows.withColumns({"head": F.coalesce(latest(F.col("ends"), F.col("k"), earlier), F.lit(0)), "opens": F.coalesce(F.lag("ends").over(w), F.lit(True))})
    rows = rows.withColumn("begin", latest(F.col("opens"), F.struct("off", "line", "doc"), w))

    # the name before a list of parameters and what stands before it, known at the list's end
    word = lambda n: F.lag(F.struct("k", "text", "kind"), n).over(w)
    rows = rows.withColumn("called", F.when(is_one("(", OPEN), F.struct(word(1).alias("name"), word(2).alias("prior"))))
    lists = Window.partitionBy(S, "round_depth", F.col("text").isin("(", ")") & F.col("kind").isin(OPEN, CLOSE)).orderBy("k")
    rows = rows.withColumn("listed", F.when(is_one(")", CLOSE), F.lag("called").over(lists)))

    # between the list and the body is nothing, or a throws clause
    filler = (F.col("kind") == WORD) | is_one(".", L.PUNCTUATION) | is_one(",", L.PUNCTUATION)
    rows = rows.withColumns({"solid": latest(~filler, F.struct("k", "listed"), earlier), "clause": latest(F.col("text") == "throws", F.col("k"), w)})

    # the type that a head declares, and that around a brace: the last brace before it that opens one level further out
    declares = (F.col("kind") == WORD) & F.col("text").isin(*TYPES) & (F.coalesce(F.lag("text").over(w), F.lit("")) != ".")
    rows = rows.withColumn("type", latest(declares, F.struct("k", F.lead("text").over(w).alias("name")), w))
    heads = rows.where(is_one("{", OPEN)).withColumn("of", F.struct(F.when(F.col("type.k") > F.col("head"), F.col("type.name")).alias("name")))
    inner = heads.select("*", (F.col("brace_depth") + 1).alias("level"), F.lit(1).alias("own"))
    outer = heads.withColumn("of", F.lit(None).cast("struct<name: string>")).select("*", F.col("brace_depth").alias("level"), F.lit(0).alias("own"))
    around = F.last("of", ignorenulls=True).over(Window.partitionBy(S, "level").orderBy("k", "own").rowsBetween(Window.unboundedPreceding, -1))
    heads = outer.unionByName(inner).withColumn("class_name", around["name"]).where("own = 0")

    name, prior = F.col("solid.listed.name"), F.col("solid.listed.prior")
    follows = (F.col("solid.k") == F.col("k") - 1) | ((F.col("clause") == F.col("solid.k") + 1) & (F.col("clause") < F.col("k") - 1))
    named = (name["kind"] == WORD) & ~name["text"].isin(*CONTROL) & (name["k"] > F.col("head")) & F.col("brace").isNotNull()
    returns = (prior["k"] > F.col("head")) & (((prior["kind"] == WORD) & ~prior["text"].isin(*CONTROL, *TYPES)) | prior["text"].isin(">", "]"))
    constructs = F.coalesce(F.col("class_name") == name["text"], F.lit(False))
    good = heads.where(follows & named & (constructs | F.coalesce(returns, F.lit(False))))
    return good.select(
        S, name["text"].alias("name"), F.when(constructs, "constructor").otherwise("method").alias("kind"), "class_name", F.col("begin.doc").alias("doc"), F.col("begin.line").alias("first_line"), F.col("line").alias("body_line"),
        F.col("brace.line").alias("last_line"), F.col("begin.off").alias("at"), F.col("off").alias("body_at"), (F.col("brace.off") + 1).alias("stop"),
    )


def code_lines(body: Column) -> Column:
    """Lines of a body in braces, without those that look like comments; blank ones inside it count."""
    inner = F.regexp_replace(F.substring(body, F.lit(2), F.length(body) - 2), r"^[\x00-\x20]+|[\x00-\x20]+\z", "")
    return F.when(inner == "", 0).otherwise(F.size(F.filter(F.split(inner, "\n"), lambda x: ~x.rlike(r"^[\x00-\x20]*[/*]"))))


def methods(files: DataFrame, least: int = 0, most: int | None = None, constructors: bool = False) -> DataFrame:
    """(sample_id, name, kind, class_name, doc, code, body, first_line, last_line, n_lines) of (sample_id, code). Bounds hold for lines of code in the
    body; a body of too few lines at all is left out before any text is cut."""
    bounds = found(files)
    bounds = bounds if constructors else bounds.where("kind = 'method'")
    if least > 1:
        bounds = bounds.where(F.col("last_line") - F.col("body_line") + 1 >= least)
    cut = lambda a: F.substring(F.col("code"), (F.col(a) + 1).cast("int"), (F.col("stop") - F.col(a)).cast("int"))
    doc = F.regexp_replace(F.regexp_replace("doc", r"^/\*\*?|\*/$|^//", ""), r"(?m)^\s*\*?[ \t]?|\s+$", "")
    rows = bounds.join(files.select(S, "code"), S).select(S, "name", "kind", "class_name", F.trim(doc).alias("doc"), cut("at").alias("code"), cut("body_at").alias("body"), "first_line", "last_line")
    rows = rows.withColumn("n_lines", code_lines(F.col("body")))
    return rows.where((F.col("n_lines") >= least) & (F.lit(True) if most is None else F.col("n_lines") <= most))
