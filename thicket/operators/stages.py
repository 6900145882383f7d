"""The two preprocessing stages as functions over DataFrames, and samples for one text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.lexing import LexConfig, lexed_by_sample, tokenized
from thicket.functions.text import label_tokens, span_size
from thicket.operators import binning, tree, vocab
from thicket.operators.views import within_limit
from thicket.schema import MAX_TOKENS
from thicket.session import discard, written

S = "sample_id"
#: Pairs of nodes of whole trees whose distances a task bins.
PAIRS = 1 << 15


def token_map(samples: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sample_id, token_idx, node_id): the node that the descent from the root ends in. Spans are shuffled as lists, one row a sample."""
    number = lambda p: p["line"].cast("bigint") * F.lit(1 << 32) + p["col"]
    tokens = F.transform("tokens", lambda t, k: F.struct(k.alias("token_idx"), number(t["span"]["start"]).alias("start"), number(t["span"]["end"]).alias("stop")))
    size, place = span_size(F.col("span")), F.coalesce("child_idx", "node_id")
    node = F.struct("node_id", "parent_id", place.alias("place"), number(F.col("span.start")).alias("lo"), number(F.col("span.end")).alias("hi"), size["lines"].alias("lines"), size["cols"].alias("cols"))
    lists = nodes.groupBy(S).agg(F.collect_list(node).alias("nodes"))
    return tree.descents(samples.select(F.col(S).cast("bigint").alias(S), tokens.alias("tokens")).join(lists, S))


@dataclass
class Stage1:
    """Samples (sample_id, func_name, tokens, label, ...), token rows, nodes and the map between them."""

    samples: DataFrame
    tokens: DataFrame
    nodes: DataFrame
    token_map: DataFrame


def stage1(methods: DataFrame, asts: DataFrame, config: LexConfig, limit: int = MAX_TOKENS, nested: bool = False) -> Stage1:
    """methods: sample_id, func_name, code; asts: sample_id, ast (JSON of either dialect).

    Order of work: lex, drop long and faulty samples, then parse trees, prune them and map the tokens.
    """
    lexemes = lexed_by_sample(methods, config)
    samples = written(within_limit(tokenized(methods, config, done=lexemes), limit=limit).where("func_name <> ''").withColumn("label", label_tokens(F.col("func_name"))), "stage1-samples")
    discard(lexemes)
    kept = asts.join(samples.select(S), S, "left_semi")
    nodes = written(tree.from_nested(kept) if nested else tree.from_vertices(kept), "stage1-nodes")
    parsed = nodes.select(S).distinct()
    samples = samples.join(parsed, S, "left_semi")
    tokens = samples.select(S, F.posexplode("tokens").alias("token_idx", "t")).select(S, "token_idx", "t.sub_tokens", "t.token_type", "t.span")
    mapping = token_map(samples, nodes) if not nested else tokens.select(S, "token_idx", F.lit(0).alias("node_id"))
    return Stage1(samples, tokens, nodes, mapping)


def counters(stage: Stage1) -> DataFrame:
    """Counts of tokens, token types, node types and labels in one table (kind, word, cnt)."""
    kinds = stage.samples.select(F.explode("tokens").alias("t")).select(F.explode(F.array(F.struct(F.lit("token").alias("kind"), F.col("t.sub_tokens").alias("words")), F.struct(F.lit("token_type").alias("kind"), F.array("t.token_type").alias("words")))).alias("p"))
    words = kinds.select("p.kind", F.explode("p.words").alias("word"))
    words = words.unionByName(stage.nodes.select(F.lit("node_type").alias("kind"), F.col("node_type").alias("word")))
    words = words.unionByName(stage.samples.select(F.lit("label").alias("kind"), F.explode("label").alias("word")))
    return vocab.counts(words, "word", "kind")


def distances(nodes: DataFrame, max_depth: int = 64, ppr: bool = True, parts: int | None = None) -> DataFrame:
    """(sample_id, metric, i, j, value) of the four tree distances."""
    up = tree.closure(nodes, max_depth)
    tag = lambda df, m: df.select(S, F.lit(m).alias("metric"), "i", "j", F.col("value").cast("double").alias("value"))
    out = tag(tree.ancestor_distances(up), "ancestor_sp").union(tag(tree.sibling_distances(nodes), "sibling_sp")).union(tag(tree.shortest_paths(up), "shortest_paths"))
    return out.union(tag(tree.pagerank_distances(nodes, threshold=2.718281828459045**-5, parts=parts), "ppr")) if ppr else out


def stage2(stage: Stage1, words: DataFrame, n_bins: int = 32, fixed: int = 9, max_depth: int = 64) -> tuple[DataFrame, DataFrame]:
    """Encoded tokens (sample_id, token_idx, sub_idx, id) and binned distances of the trees."""
    flat = stage.tokens.select(S, "token_idx", F.posexplode("sub_tokens").alias("sub_idx", "word"))
    pairs = stage.nodes.groupBy(S).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    parts = max(1, -(-pairs // PAIRS))
    dist = distances(stage.nodes, max_depth, parts=parts)
    # a sample's distances are made by long plans: its bins are found where they are, in one group, rather than by more passes over them
    discrete = binning.binned(dist.where("metric <> 'ppr'"), n_bins, fixed, binning.exponential(1.3), parts=parts)
    return vocab.encode(flat, words), discrete.unionByName(binning.binned(dist.where("metric = 'ppr'"), n_bins, discrete=False, parts=parts))
