"""Path contexts: pairs of leaves of a tree and the way between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.text import LEGAL_IDENTIFIER, path_name
from thicket.operators.tree import common_prefix
from thicket.schema import MAX_PATH_LENGTH, MAX_PATH_WIDTH

S = "sample_id"
# Node types of identifiers and numbers.
IDENTIFIERS = ("Identifier", "Boolean", "Null")
IDENTIFIERS_JAVA = ("ThisExpr", "SuperExpr", "BooleanLiteralExpr")
NUMBERS = ("Integer", "Float")
NUMBERS_JAVA = ("IntegerLiteralExpr", "DoubleLiteralExpr", "LongLiteralExpr")


def is_identifier(language: Column, node_type: Column) -> Column:
    return F.when(language == "java-small", F.contains(node_type, F.lit("Name")) | node_type.isin(*IDENTIFIERS_JAVA)).otherwise(node_type.isin(*IDENTIFIERS))


def is_number(language: Column, node_type: Column) -> Column:
    return F.when(language == "java-small", node_type.isin(*NUMBERS_JAVA)).otherwise(node_type.isin(*NUMBERS))


def terminals(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Leaves of a path context: (sample_id, node_id, value, path). nodes: sample_id, language, node_id, node_type, value,
    name_node (the node with the method's name). Samples with an identifier of other characters are left out whole."""
    name = F.col("node_id") == F.col("name_node")
    word = is_identifier(F.col("language"), F.col("node_type"))
    value = F.when(name, F.lit("METHODNAME")).when(word, F.col("value")).when(is_number(F.col("language"), F.col("node_type")), F.lit("NUM"))
    flagged = nodes.withColumn("illegal", word & ~name & ~F.col("value").rlike(LEGAL_IDENTIFIER))
    bad = flagged.where("illegal").select(S).distinct()
    out = flagged.join(bad, S, "left_anti").select(S, "node_id", value.alias("value")).where("value is not null")
    return out.join(paths.withColumnRenamed("node", "node_id"), [S, "node_id"])


def leaf_pairs(leaves: DataFrame, max_length: int = MAX_PATH_LENGTH, max_width: int = MAX_PATH_WIDTH) -> DataFrame:
    """Pairs of leaves in node order whose way is short and even enough: values, up, lca and down.

    The join is within a sample; a sample's leaves are bounded by the token limit. Where the leaves have the types of their root
    paths, the pairs have `steps`: the types on the way.
    """
    typed = "types" in leaves.columns
    a = leaves.select(S, F.col("node_id").alias("v"), F.col("value").alias("start"), F.col("path").alias("vp"), *([F.col("types").alias("vt")] if typed else []))
    b = leaves.select(S, F.col("node_id").alias("u"), F.col("value").alias("finish"), F.col("path").alias("up"), *([F.col("types").alias("ut")] if typed else []))
    both = a.join(b, S).where("v < u").withColumn("k", common_prefix(F.col("vp"), F.col("up")))
    n_up, n_down = F.size("vp") - F.col("k"), F.size("up") - F.col("k")
    both = both.where((n_up + 1 + n_down <= max_length) & (F.abs(n_up - n_down) <= max_width))
    return both.select(S, "v", "u", "start", "finish", F.reverse(F.slice("vp", F.col("k") + 1, n_up)).alias("climb"), F.element_at("vp", F.col("k")).alias("lca"), F.slice("up", F.col("k") + 1, n_down).alias("descent"), *([F.concat(F.reverse(F.slice("vt", F.col("k"), n_up + 1)), F.slice("ut", F.col("k") + 1, n_down)).alias("steps")] if typed else []))


def rendered(pairs: DataFrame) -> DataFrame:
    """(sample_id, v, u, context): start,types,finish, the types joined by pipes. pairs: with steps."""
    return pairs.select(S, "v", "u", F.concat_ws(",", path_name(F.col("start")), F.array_join("steps", "|"), path_name(F.col("finish"))).alias("context"))


def lines(contexts: DataFrame, targets: DataFrame) -> DataFrame:
    """One text line for each sample with a context: the target, then its contexts."""
    all_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", "u", "context"))), lambda x: x["context"]), " ")
    return contexts.groupBy(S).agg(all_of.alias("contexts")).join(targets, S).select(S, F.concat_ws(" ", path_name(F.col("target")), "contexts").alias("value"))


def sampled(contexts: Column, most: int, seed: Column) -> Column:
    """`most` contexts of a row, chosen by hash and so the same in every run; in their order."""
    ranked = F.array_sort(F.transform(contexts, lambda c, i: F.struct(F.md5(F.concat_ws(":", seed.cast("string"), i.cast("string"), c)).alias("h"), i.alias("i"), c.alias("c"))))
    return F.transform(F.array_sort(F.transform(F.slice(ranked, 1, most), lambda x: F.struct(x["i"].alias("i"), x["c"].alias("c")))), lambda x: x["c"])


def parsed(rows: DataFrame, line: str = "value") -> DataFrame:
    """Text lines as target parts and (ctx_idx, src, path, dst) arrays."""
    parts = F.split(line, " ")
    ctx = rows.select("*", F.split(F.element_at(parts, 1), r"\|").alias("target"), F.posexplode_outer(F.slice(parts, F.lit(2), F.size(parts))).alias("ctx_idx", "ctx"))
    piece = lambda k: F.split(F.try_element_at(F.split("ctx", ","), F.lit(k)), r"\|")
    return ctx.select(*[c for c in rows.columns if c != line], "target", "ctx_idx", piece(1).alias("src"), piece(2).alias("path"), piece(3).alias("dst"))


# Types whose children show their number in a path.
NUMBERED_PARENTS = ("AssignExpr", "ArrayAccessExpr", "FieldAccessExpr", "MethodCallExpr")


def with_signed_width(pairs: DataFrame, child_numbers: DataFrame, max_length: int, max_width: int, absolute: bool = False) -> DataFrame:
    """Pairs whose steps (without the common node) are at most max_length, and whose branches below the common node are at
    most max_width apart: later minus earlier, so that it has a sign unless `absolute`.

    child_numbers: sample_id, node_id, child_no (not saturated).
    """
    top = lambda c: F.when(F.size(c) > 0, F.element_at(c, -1))
    out = pairs.where(F.size("climb") + F.size("descent") <= max_length)
    out = out.withColumn("_a", top(F.col("climb"))).withColumn("_b", F.when(F.size("descent") > 0, F.element_at("descent", 1)))
    a, b = child_numbers.select(S, F.col("node_id").alias("_a"), F.col("child_no").alias("_ca")), child_numbers.select(S, F.col("node_id").alias("_b"), F.col("child_no").alias("_cb"))
    width = F.col("_cb") - F.col("_ca")
    out = out.join(a, [S, "_a"], "left").join(b, [S, "_b"], "left")
    return out.where(width.isNull() | ((F.abs(width) if absolute else width) <= max_width)).drop("_a", "_b", "_ca", "_cb")


def rendered_with_numbers(pairs: DataFrame, nodes: DataFrame, most: int = 3, parents: tuple[str, ...] = NUMBERED_PARENTS, short: DataFrame | None = None) -> DataFrame:
    """(sample_id, v, u, path): types joined by pipes; the ends, and children of the listed types, show their number, at
    most `most`. nodes: sample_id, node_id, node_type, parent_type, child_no; short: node_type, name (shorter names)."""
    steps = pairs.select(S, "v", "u", F.posexplode(F.concat("climb", F.array("lca"), "descent")).alias("pos", "node_id"))
    named = steps.join(nodes.select(S, "node_id", "node_type", "parent_type", "child_no"), [S, "node_id"])
    name = F.col("node_type")
    if short is not None:
        named = named.join(short.select("node_type", "name"), "node_type", "left")
        name = F.coalesce("name", "node_type")
    ends = (F.col("node_id") == F.col("v")) | (F.col("node_id") == F.col("u"))
    number = F.when(ends | F.coalesce(F.col("parent_type").isin(*parents), F.lit(False)), F.least("child_no", F.lit(most)).cast("string"))
    named = named.withColumn("step", F.concat(name, F.coalesce(number, F.lit(""))))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "step"))), lambda x: x["step"]), "|")
    return named.groupBy(S, "v", "u").agg(path.alias("path"))


def dense(parsed_rows: DataFrame, key: str, subtokens: DataFrame, node_types: DataFrame, most: int = 200, name_parts: int = 5, path_parts: int = MAX_PATH_LENGTH + 1) -> DataFrame:
    """Contexts as arrays of ids of fixed lengths: (key, ctx_idx, src, path, dst, lengths, valid).

    parsed_rows as `parsed` gives them; vocabularies: word, id, with 0 for padding and unknown parts. A context is
    valid if any of its ids isn't 0.
    """
    rows = parsed_rows.where(F.col("ctx_idx") < most)
    kinds = (("src", name_parts, subtokens), ("path", path_parts, node_types), ("dst", name_parts, subtokens))
    out = rows.select(key, "ctx_idx")
    for name, n, table in kinds:
        flat = rows.select(key, "ctx_idx", F.posexplode(F.slice(name, 1, n)).alias("pos", "word")).join(table.select("word", "id"), "word", "left")
        ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(0)).alias("id")))), lambda x: x["id"])
        coded = flat.groupBy(key, "ctx_idx").agg(ids.alias(name))
        padded = F.slice(F.concat(F.coalesce(name, F.array().cast("array<int>")), F.array_repeat(F.lit(0), n)), 1, n)
        out = out.join(coded, [key, "ctx_idx"], "left").withColumn(f"{name}_length", F.coalesce(F.size(name), F.lit(0))).withColumn(name, padded)
    valid = F.array_max("src") + F.array_max("path") + F.array_max("dst") != 0
    return out.withColumn("valid", valid)
