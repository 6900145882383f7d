"""Corpus statistics, vocabularies, encoding and decoding: joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import normalize_word
from thicket.schema import SPECIAL_SYMBOLS


def counts(words: DataFrame, word: str = "word", *keys: str) -> DataFrame:
    """Occurrences of normalised words; empty ones aren't counted. The map side pre-aggregates."""
    key = normalize_word(F.col(word))
    return words.select(*keys, key.alias("word")).where("word <> ''").groupBy(*keys, "word").agg(F.count("*").alias("cnt"))


def counts_of_kinds(rows: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """Several counters in one pass: kinds gives each kind an array of words."""
    parts = F.array(*(F.struct(F.lit(k).alias("kind"), w.alias("words")) for k, w in kinds.items()))
    flat = rows.select(F.explode(parts).alias("p")).select("p.kind", F.explode("p.words").alias("word"))
    return counts(flat, "word", "kind")


def combined_counts(by_language: DataFrame, min_frequency: int) -> DataFrame:
    """Counts over all languages of the words that are more frequent than min_frequency in any of them."""
    return by_language.groupBy("word").agg(F.sum("cnt").alias("cnt"), F.max("cnt").alias("top")).where(F.col("top") > min_frequency).select("word", "cnt")


def vocabulary(cnt: DataFrame, limit: int | None = 32_000, min_frequency: int = 100, special: list[str] = SPECIAL_SYMBOLS, *keys: str) -> DataFrame:
    """Dense ids after the special symbols, by falling count, then by word.

    Words equal to a special symbol in lower case are left out. The limit counts the special symbols, and one more
    if the unknown symbol isn't among them. A limit is taken as a top-k before ids are given, so that no task sorts the whole corpus.
    """
    low = [s.lower() for s in special]
    kept = cnt.where((F.col("cnt") >= min_frequency) & ~F.col("word").isin(*low)) if special else cnt.where(F.col("cnt") >= min_frequency)
    order = [F.col("cnt").desc(), F.col("word")]
    room = None if limit is None else max(limit - len(special) - (0 if "<unk>" in special else 1), 0)
    if room is not None and not keys:
        kept = kept.orderBy(*order).limit(room)
    out = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if room is not None and keys:
        out = out.where(F.col("rank") <= room)  # Spark takes each task's top ranks before it shuffles
    return out.select(*keys, (F.col("rank") - 1 + len(special)).cast("int").alias("id"), "word", "cnt")


def with_specials(vocab: DataFrame, special: list[str] = SPECIAL_SYMBOLS) -> DataFrame:
    """The whole bijection: special symbols and words."""
    head = vocab.sparkSession.createDataFrame([(i, s, True) for i, s in enumerate(special)], "id int, word string, is_special boolean")
    return head.unionByName(vocab.select("id", "word", F.lit(False).alias("is_special")))


def encode(words: DataFrame, vocab: DataFrame, column: str = "word", unknown: int = 0) -> DataFrame:
    """words with a column id: a left join on the normalised word, unknown ones get the unknown id.

    Special symbols are looked up as they are. Spark broadcasts the vocabulary while it is below its threshold.
    """
    key = F.when(F.col(column).isin(*SPECIAL_SYMBOLS), F.col(column)).otherwise(normalize_word(F.col(column)))
    table = vocab.select(F.col("word").alias("_w"), "id")
    return words.withColumn("_k", key).join(table, F.col("_k") == F.col("_w"), "left").withColumn("id", F.coalesce("id", F.lit(unknown))).drop("_k", "_w")


def decode(ids: DataFrame, vocab: DataFrame, column: str = "id", unknown: str = "<unk>") -> DataFrame:
    table = vocab.select(F.col("id").alias("_i"), F.col("word").alias("decoded"))
    return ids.join(table, F.col(column) == F.col("_i"), "left").withColumn("decoded", F.coalesce("decoded", F.lit(unknown))).drop("_i")


def extended_ids(tokens: DataFrame, size: int, sample: str = "sample_id", pos: str = "pos", word: str = "word", ident: str = "id", unknown: int = 0) -> DataFrame:
    """Pointer vocabulary: each unknown word of a sample gets size + its rank by first occurrence there."""
    firsts = tokens.where(F.col(ident) == unknown).groupBy(sample, word).agg(F.min(pos).alias("first"))
    ranked = firsts.withColumn("ext_id", (F.row_number().over(Window.partitionBy(sample).orderBy("first")) - 1 + size).cast("int"))
    return ranked.select(sample, word, "ext_id")
