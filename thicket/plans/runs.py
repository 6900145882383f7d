"""Queries over streams, and the two preprocessing stages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from thicket.functions.lexing import LexConfig
from thicket.operators import stages, vocab
from thicket.plans.registry import query, table
from thicket.plans.trees import _NODES
from thicket.streaming import counts as C


def _vertices(code: str) -> str:
    """A small tree in the vertex dialect: a module, its function, and one node a line."""
    lines = code.splitlines()
    width = max(map(len, lines), default=0) + 1
    span = lambda a, b: {"start": {"line": a, "column": 1}, "end": {"line": b, "column": width}}
    vertices = [{"vertexId": 10, "term": "Module", "span": span(1, len(lines))}, {"vertexId": 11, "term": "Function", "span": span(1, len(lines))}]
    vertices += [{"vertexId": 12 + k, "term": "Statement", "span": span(k + 1, k + 1)} for k in range(len(lines))]
    edges = [{"source": 10, "target": 11}] + [{"source": 11, "target": 12 + k} for k in range(len(lines))]
    return json.dumps({"files": [{"path": "f", "vertices": vertices, "edges": edges, "errors": []}]})


@F.pandas_udf(StringType())
def vertices(code: pd.Series) -> pd.Series:
    return code.map(_vertices)


def sample_stage(spark, d: str) -> stages.Stage1:
    """Turns of conversations as methods, with a small tree each."""
    # a lexer's work is much for a row's bytes, so rows are dealt out to all cores
    turns = table(spark, d, "conversations").where("text is not null").repartition(spark.sparkContext.defaultParallelism, "conv_id", "turn")
    methods = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("sample_id"), F.concat("role", F.lit("_turn"), "turn").alias("func_name"), F.col("text").alias("code"))
    return stages.stage1(methods, methods.select("sample_id", vertices("code").alias("ast")), LexConfig("python", allow_flat=True))


@query("stage1_tokens")
def stage1_tokens(spark, d):
    return sample_stage(spark, d).tokens


@query("stage1_map")
def stage1_map(spark, d):
    return sample_stage(spark, d).token_map


@query("stage2_ids")
def stage2_ids(spark, d):
    s = sample_stage(spark, d)
    words = vocab.vocabulary(stages.counters(s).where("kind = 'token'").select("word", "cnt"), 1000, 1)
    return stages.stage2(s, words, 8, 3, 4)[0]


@query("stage2_bins")
def stage2_bins(spark, d):
    s = sample_stage(spark, d)
    words = vocab.vocabulary(stages.counters(s).where("kind = 'token'").select("word", "cnt"), 1000, 1)
    return stages.stage2(s, words, 8, 3, 4)[1]


@query("java_ast_nodes", f"with {_NODES} select sample_id, node_id, parent_id, case when parent_id is not null then (row_number() over (partition by sample_id, parent_id order by node_id) - 1)::int end as child_idx, case node_type when 'Empty' then 'Sentence' else node_type end as node_type from nodes")
def java_ast_nodes(spark, d):
    """The recursive dialect: a dialogue with its turns and sentences as nested JSON."""
    from thicket.operators.tree import from_nested

    leaf = F.struct(F.lit("Sentence").alias("type"))
    t = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.array_repeat(leaf, F.size(F.split("text", r"\. "))).alias("childNodes"))
    turns = t.groupBy(F.col("conv_id").alias("sample_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.lit("Turn").alias("type"), "childNodes"))).alias("c"))
    tree = F.struct(F.lit("Dialogue").alias("type"), F.transform("c", lambda x: F.struct(x["type"].alias("type"), x["childNodes"].alias("childNodes"))).alias("childNodes"))
    return from_nested(turns.select("sample_id", F.to_json(tree).alias("ast")))


@query("stream_tumbling", "select date_trunc('hour', ts)::timestamp as start, event_type, count(*) as n, sum(value) as total from events group by 1, 2")
def stream_tumbling(spark, d):
    return C.run_to_end(C.tumbling(C.events(spark, f"{d}/events.parquet")), "stream_tumbling", "start", "event_type")


@query("stream_word_counts", "select lower(trim(w, ' ' || chr(9) || chr(13))) as word, count(*) as cnt from (select unnest(string_split(text, ' ')) as w from conversations) where trim(w, ' ' || chr(9) || chr(13)) <> '' group by 1")
def stream_word_counts(spark, d):
    path = f"{d}/conversations.parquet"
    texts = spark.readStream.schema(spark.read.parquet(path).schema).parquet(C.table_glob(path))
    return C.run_to_end(C.word_counts(texts), "stream_word_counts", "word")


@query("stream_sessions", "with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as k from e) select min(ts)::timestamp as start, user_id, count(*) as n from s group by user_id, k")
def stream_sessions(spark, d):
    """Sessions of a stream of events, read to its end."""
    return C.run_to_end(C.sessions(C.events(spark, f"{d}/events.parquet")), "stream_sessions", mode="complete")


@query("session_windows", "with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as k from e) select min(ts)::timestamp as start, user_id, count(*) as n from s group by user_id, k")
def session_windows(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "user_id", "n")
