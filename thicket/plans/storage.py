"""Queries that write files of every kind to the shared folder and read them back with the sources' readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions import text as X
from thicket.operators import views as V
from thicket.plans.registry import query, table, uniform
from thicket.plans.vocab import _VOCAB, small_vocab
from thicket.session import scratch
from thicket.sources import files as S

_PARTITIONS = ("train", "valid", "test")
_PARTITION = "case turn % 3 when 0 then 'train' when 1 then 'valid' else 'test' end"


def json_lines(spark, d: str) -> str:
    """A folder language/partition/*.gz of JSON lines: turns as functions, some without a docstring."""
    root = scratch(spark, "json-lines")
    turns = table(spark, d, "conversations")
    value = F.to_json(F.struct(F.col("role").alias("func_name"), F.when(F.col("turn") % 2 == 0, F.lit("d")).alias("docstring"), F.col("text").alias("code"), "conv_id"))
    for k, part in enumerate(_PARTITIONS):
        turns.where(F.col("turn") % 3 == k).select(value.alias("value")).write.option("compression", "gzip").text(f"{root}/en/{part}")
    return root


@query("source_json_lines", f"select 'en' as language, {_PARTITION} as partition, role as func_name, count(*) as n, count(*) filter (where turn % 2 = 0) as n_docs, sum(length(text))::bigint as n_chars from conversations group by 2, 3")
def source_json_lines(spark, d):
    """All shards of all partitions."""
    rows = S.read_json_lines(spark, f"{json_lines(spark, d)}/*/*/*.gz")
    return rows.groupBy("language", "partition", "func_name").agg(F.count("*").alias("n"), F.count("docstring").alias("n_docs"), F.sum(F.length("code")).alias("n_chars"))


@query("source_json_shard", f"select role as func_name, text as code from conversations where {_PARTITION} = 'valid'")
def source_json_shard(spark, d):
    """One partition, two of its columns: others aren't parsed."""
    return S.read_json_lines(spark, f"{json_lines(spark, d)}/en/valid", "en").select("func_name", "code")


@query("source_json_arrays", "select p_name as func_name, case when p_size % 3 = 0 then p_type end as docstring, p_brand as code from part")
def source_json_arrays(spark, d):
    """Files that hold one array each; a missing doc is null."""
    root = scratch(spark, "json-arrays")
    row = F.struct(F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("doc"), F.col("p_brand").alias("code"))
    table(spark, d, "part").groupBy(F.col("p_brand").alias("shard")).agg(F.to_json(F.collect_list(row)).alias("value")).write.partitionBy("shard").text(root)
    return S.read_json_arrays(spark, f"{root}/*")


@query("source_listing", "select p_brand as shard, sum(octet_length(encode(p_name)) + 1)::bigint as n_bytes from part group by 1")
def source_listing(spark, d):
    """Sizes of files by their folder; what is in them isn't read."""
    root = scratch(spark, "listing")
    table(spark, d, "part").select("p_name", F.col("p_brand").alias("shard")).write.partitionBy("shard").text(root)
    folder = F.regexp_replace(F.url_decode(F.regexp_extract("path", "/shard=([^/]+)/", 1)), "%23", "#")
    return S.listing(spark, root, "*.txt").groupBy(folder.alias("shard")).agg(F.sum("size").alias("n_bytes"))


def sample_store(spark, d: str) -> str:
    root = scratch(spark, "samples")
    part = F.element_at(F.array(*map(F.lit, _PARTITIONS)), (F.col("doc_id") % 3 + 1).cast("int"))
    S.write_samples(table(spark, d, "documents").select("doc_id", F.length("text").alias("n_chars"), F.col("lang").alias("language"), part.alias("partition")), root, 100)
    return root


@query("sample_store", "select doc_id, length(text)::int as n_chars, lang as language from documents where doc_id % 3 = 0 and lang in ('en', 'de')")
def sample_store_query(spark, d):
    """Slices of samples of two languages and one partition: the other folders aren't read."""
    return S.read_samples(spark, sample_store(spark, d), ["en", "de"], "train").select("doc_id", "n_chars", "language")


@query("sample_count", "select count(*) as n from documents")
def sample_count(spark, d):
    return spark.createDataFrame([(S.row_count(spark, sample_store(spark, d)),)], "n bigint")


@query("vocab_store", f"with {_VOCAB} select id, word, cnt from v")
def vocab_store(spark, d):
    """A vocabulary written and loaded."""
    root = scratch(spark, "vocabulary")
    S.save_table(small_vocab(spark, d), root)
    return spark.read.parquet(root)


@query("config_store", "select * from (values ('limit', '512'), ('name', 'stage 1'), ('none', null)) t(key, value)")
def config_store(spark, d):
    root = scratch(spark, "config")
    S.save_config(spark, {"name": "stage 1", "limit": 512, "none": None}, root)
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in S.load_config(spark, root).items()], "key string, value string")


@query("code_files", "select n_name || ' café' as line from nation union all select r_name || ' café' from region")
def code_files(spark, d):
    """Files in UTF-8 and in a one-byte encoding, told apart by their bytes."""
    root = scratch(spark, "code")
    for name, column, encoding in (("nation", "n_name", "ISO-8859-1"), ("region", "r_name", "UTF-8")):
        table(spark, d, name).select(F.concat(column, F.lit(" café"))).write.option("encoding", encoding).option("quote", "").csv(f"{root}/{name}")
    return S.read_code_files(spark, root, "*.csv").select(F.explode(F.split("content", "\n")).alias("line")).where("line <> ''")


@query("json_trees", "select 'Nation' as kind, count(*) as n from nation")
def json_trees(spark, d):
    """Lines of JSON; those that aren't are left out."""
    root = scratch(spark, "trees")
    good = table(spark, d, "nation").select(F.to_json(F.struct(F.lit("Nation").alias("type"), "n_name")).alias("value"))
    S.write_lines(good.union(table(spark, d, "region").select(F.concat(F.lit("{broken "), "r_name"))), root)
    return S.read_json_trees(spark, root).groupBy(F.get_json_object("ast", "$.type").alias("kind")).agg(F.count("*").alias("n"))


@query("metric_log", "select event_type as run, count(*) as n, max(event_id) as last_step from events group by 1")
def metric_log(spark, d):
    """Scalars appended to a log in two runs."""
    root, rows = scratch(spark, "metrics"), table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.lit("value").alias("name"), "value")
    S.append_metrics(rows.where("step % 2 = 0"), root)
    S.append_metrics(rows.where("step % 2 = 1"), root)
    return spark.read.parquet(root).groupBy("run").agg(F.count("*").alias("n"), F.max("step").alias("last_step"))


@query("run_numbers", "select 12::bigint as next, 'ct-11' as newest")
def run_numbers(spark, d):
    """The next run's number, and the folder of the file that was written last."""
    root = scratch(spark, "runs")
    for k in (3, 11):
        S.write_lines(table(spark, d, "region").select(F.col("r_name").alias("value")), f"{root}/ct-{k}")
    newest = S.latest_snapshot(spark, root, "*.txt").select(F.regexp_extract("path", "/(ct-[0-9]+)/", 1).alias("newest"))
    return newest.select(F.lit(S.next_run(spark, root, "ct")).cast("bigint").alias("next"), "newest")


@query("combined_sources", "select lang as language, doc_id from documents where lang in ('en', 'fr')")
def combined_sources(spark, d):
    """Languages with their tag, in a seeded order."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return S.combined({x: docs.where(F.col("lang") == x).drop("lang") for x in ("en", "fr")}, 7, "doc_id").select("language", "doc_id")


@query("epochs", "select k::int as epoch, count(*) as n, sum(doc_id)::bigint as ids from documents cross join (select unnest(range(3)) as k) group by 1")
def epochs(spark, d):
    """Every row once an epoch, each in another order."""
    out = None
    for k, rows in enumerate(S.epochs(table(spark, d, "documents").select("doc_id"), 3, 5, "doc_id")):
        one = rows.select(F.lit(k).alias("epoch"), "doc_id")
        out = one if out is None else out.union(one)
    return out.groupBy("epoch").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("full_shuffle", f"select doc_id, row_number() over (order by {uniform(9, 'doc_id')}, doc_id) - 1 as place from documents")
def full_shuffle(spark, d):
    """All rows in a seeded order, with their places."""
    rows = V.preceding(table(spark, d, "documents").select("doc_id", F.lit(0).alias("all"), V.uniform(9, "doc_id").alias("h")), "all", F.lit(1), "h", "doc_id")
    return rows.select("doc_id", F.col("_before").alias("place"))


@query("snippets", "select p_partkey, replace(p_name, ' ', '_') || ' ' || p_type as snippet from part")
def snippets(spark, d):
    """Texts put together again from sub-tokens."""
    tokens = F.array(F.struct(F.split("p_name", " ").alias("sub_tokens")), F.struct(F.array("p_type").alias("sub_tokens")))
    return table(spark, d, "part").select("p_partkey", X.reconstruct(tokens).alias("snippet"))


@query("word_totals", "select sum(n)::bigint as words, count(*) as rows from (select len(string_split(replace(text, chr(10), ' '), ' ')) as n from conversations)")
def word_totals(spark, d) -> DataFrame:
    """Rows written as text lines, one a row, and read again."""
    root = scratch(spark, "lines")
    S.write_lines(table(spark, d, "conversations").select(F.regexp_replace("text", "\n", " ").alias("value")), root)
    n = F.size(F.split("value", " "))
    return spark.read.text(root).agg(F.sum(n).alias("words"), F.count("*").alias("rows"))
