"""Path-context files: lines of a target and a fixed number of contexts, read with the text reader, so that columns are pruned and any store will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.text import pad_or_truncate

#: What a field that isn't there holds.
BLANK = ""


def fields(line: Column, n: int, blank: str = BLANK) -> tuple[Column, Column]:
    """The target, and exactly n contexts: short lines are filled with blanks, those of overlong ones are cut."""
    parts = F.split(line, " ", -1)
    return F.element_at(parts, 1), pad_or_truncate(F.slice(parts, F.lit(2), F.size(parts)), n, F.lit(blank))


def n_valid(contexts: Column, blank: str = BLANK) -> Column:
    """Contexts before the first blank."""
    at = F.array_position(contexts, F.lit(blank))
    return F.when(at > 0, at - 1).otherwise(F.size(contexts)).cast("int")


def random_contexts(contexts: Column, valid: Column, n: int, seed: int, key: Column) -> Column:
    """n of the contexts before the first blank, in a seeded random order; of fewer than n all, in a random order together with blanks, n in all. The order is that of
    hashes of the seed, the row's key and the place, so it is the same in every run."""
    places = F.sequence(F.lit(0), F.greatest(valid, F.lit(n)) - 1)
    mixed = F.array_sort(F.transform(places, lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key, i.cast("string"))).alias("h"), i.alias("i"))))
    return F.transform(F.slice(mixed, 1, n), lambda x: F.element_at(contexts, x["i"] + 1))


def read_path_contexts(spark: SparkSession, path: str, n: int = 200, stored: int = 1000, seed: int | None = None, pattern: str = "*") -> DataFrame:
    """(language, target, contexts, n_valid) of all files below a path whose last folder names the language (`python` or `language=python`). A line has a target and `stored` contexts, fewer or more; n are
    kept: the first ones, or with a seed random ones of those before the first blank."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    rows = rows.select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -2), "^language=", "").alias("language"), "value")
    target, contexts = fields(F.col("value"), max(stored, n))
    rows = rows.withColumns({"target": target, "_all": contexts, "n_valid": n_valid(contexts)})
    chosen = F.slice("_all", 1, n) if seed is None else random_contexts(F.col("_all"), F.col("n_valid"), n, seed, F.col("target"))
    return rows.select("language", "target", chosen.alias("contexts"), F.least("n_valid", F.lit(n)).alias("n_valid"))


def write_path_contexts(lines: DataFrame, path: str, stored: int = 1000) -> None:
    """(language, value) as text files in a folder for each language; each line has `stored` contexts, blank ones at its end."""
    parts = F.split("value", " ", -1)
    padded = F.array_join(pad_or_truncate(parts, stored + 1, F.lit(BLANK)), " ")
    lines.select("language", padded.alias("value")).write.mode("overwrite").partitionBy("language").text(path)


def parts_of(contexts: Column) -> Column:
    """Contexts as structs (source, path, target) of arrays of parts; blank ones have empty arrays."""
    piece = lambda c, k: F.filter(F.split(F.coalesce(F.try_element_at(F.split(c, ","), F.lit(k)), F.lit("")), r"\|"), lambda x: x != "")
    return F.transform(contexts, lambda c: F.struct(piece(c, 1).alias("source"), piece(c, 2).alias("path"), piece(c, 3).alias("target")))
