"""Queries over names and texts: splitting, normalising, padding, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions import text as X
from thicket.plans.registry import query, table

#: Identifiers of several kinds from the driver's tables.
_NAMES = """names as (
  select distinct p_brand as name from part union select distinct p_type from part union select distinct c_name from customer
  union select distinct o_orderpriority from orders union select distinct s_name from supplier
  union select 'get_HTTPResponse2Code' union select '__init__' union select '___' union select 'myVar.getXMLName' union select 'aB_cD9e' union select 'METHODNAME')"""
_EDGE = r"regexp_replace(regexp_replace({}, '([a-z])([A-Z])', '\1' || chr(1) || '\2', 'g'), '([A-Z])([A-Z][a-z])', '\1' || chr(1) || '\2', 'g')"
_CAMEL = "regexp_extract_all(regexp_replace({}, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9_]+')"
_SPLIT = f"list_transform({_CAMEL.format('name')}, lambda w: lower(w))"


def names(spark, d: str) -> DataFrame:
    """One column of identifiers; distinct before any expression is computed, as a memo of the work."""
    out = table(spark, d, "part").select(F.col("p_brand").alias("name"))
    for t, c in (("part", "p_type"), ("customer", "c_name"), ("orders", "o_orderpriority"), ("supplier", "s_name")):
        out = out.union(table(spark, d, t).select(c))
    more = ["get_HTTPResponse2Code", "__init__", "___", "myVar.getXMLName", "aB_cD9e", "METHODNAME"]
    return out.union(spark.createDataFrame([(x,) for x in more], "name string")).distinct()


_RUNS = "regexp_extract_all(regexp_replace({}, '([A-Z]+)([A-Z][a-z])', '\\1' || chr(1) || '\\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9\x01]+')"


@query("camel_split", f"with {_NAMES} select name, array_to_string({_RUNS.format('name')}, '|') as parts from names")
def camel_split(spark, d):
    return names(spark, d).select("name", F.array_join(X.split_camel_case(F.col("name")), "|").alias("parts"))


@query("snake_camel_split", f"with {_NAMES} select name, case when len({_SPLIT}) = 0 then name else array_to_string({_SPLIT}, '|') end as parts from names")
def snake_camel_split(spark, d):
    return names(spark, d).select("name", F.array_join(X.split_identifier(F.col("name")), "|").alias("parts"))


@query("label_tokens", f"with {_NAMES}, n as (select name as full_name, list_last(string_split(name, '.')) as name from names) select full_name as name, case when len({_SPLIT}) = 0 then name else array_to_string(({_SPLIT})[1:6], '|') end as label from n")
def label_tokens(spark, d):
    return names(spark, d).select("name", F.array_join(X.label_tokens(F.col("name")), "|").alias("label"))


@query("path_name", f"with {_NAMES} select name, case when name in ('METHODNAME', 'NUM') then name else array_to_string(list_transform(list_filter(string_split(replace({_EDGE.format('name')}, '_', chr(1)), chr(1)), lambda w: w <> ''), lambda w: lower(w)), '|') end as path_name from names")
def path_name(spark, d):
    return names(spark, d).select("name", X.path_name(F.col("name")).alias("path_name"))


@query(
    "java_subtokens",
    rf"""with {_NAMES}, p as (select name, list_filter(regexp_split_to_array(replace({_EDGE.format("trim(replace(name, '|', ' '))")}, chr(1), ' '), '_|[0-9]|\s+'), lambda w: w <> '') as ws from names)
    select name, array_to_string(list_filter(list_transform(ws, lambda w: case when regexp_replace(lower(w), '[^a-z]', '', 'g') <> '' then regexp_replace(lower(w), '[^a-z]', '', 'g') else replace(regexp_replace(lower(w), '["'',]', '', 'g'), ' ', '_') end), lambda w: w <> ''), '|') as parts from p""",
)
def java_subtokens(spark, d):
    return names(spark, d).select("name", F.array_join(X.split_to_subtokens(F.col("name")), "|").alias("parts"))


@query(
    "csharp_name",
    rf"""with {_NAMES}, p as (select name, list_filter(regexp_split_to_array(replace({_EDGE.format("trim(name)")}, chr(1), ' '), '_|[0-9]|\s+'), lambda w: w <> '') as ws from names),
    q as (select name, array_to_string(list_filter(list_transform(ws, lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g')), lambda w: w <> ''), '|') as parts, regexp_replace(lower(name), '[^a-z]', '', 'g') as whole from p)
    select name, case when parts <> '' then parts when whole <> '' then whole else 'SPACE' end as parts from q""",
)
def csharp_name(spark, d):
    return names(spark, d).select("name", X.split_name_unless_empty(F.col("name")).alias("parts"))


@query("letters_only", f"with {_NAMES} select name, lower(case when regexp_replace(name, '[^a-zA-Z]', '', 'g') = '' then name else regexp_replace(name, '[^a-zA-Z]', '', 'g') end) as word from names")
def letters_only(spark, d):
    return names(spark, d).select("name", X.letters_only(F.col("name")).alias("word"))


@query("verbose_split", f"with {_NAMES}, p as (select name, list_transform(regexp_extract_all(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1' || chr(1) || '\\2', 'g'), '\x01?([A-Z]?[a-z]+|[A-Z]+|[0-9]+|.+)', 1), lambda w: replace(w, chr(1), '')) as ws from names) select name, array_to_string(list_filter(ws, lambda w: w <> '_'), '|') as parts from p")
def verbose_split(spark, d):
    return names(spark, d).select("name", F.array_join(X.split_verbose(F.col("name")), "|").alias("parts"))


@query(
    "pad_truncate",
    "select conv_id, turn, array_to_string((list_concat(string_split(text, ' '), list_transform(range(5), lambda x: '[PAD]')))[1:5], ' ') as tokens from conversations",
)
def pad_truncate(spark, d):
    words = F.split("text", " ")
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.pad_or_truncate(words, 5, F.lit("[PAD]")), " ").alias("tokens"))


@query(
    "chunk_words",
    "select conv_id, turn, k::bigint as chunk, array_to_string(ws[k * 5 + 1:k * 5 + 5], ',') as words from (select conv_id, turn, ws, unnest(range(0, (len(ws) + 4) // 5)) as k from (select conv_id, turn, string_split(text, ' ') as ws from conversations))",
)
def chunk_words(spark, d):
    out = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(X.chunks(F.split("text", " "), 5)))
    return out.select("conv_id", "turn", F.col("pos").cast("bigint").alias("chunk"), F.array_join("col", ",").alias("words"))


@query("distinct_words", "select conv_id, turn, array_to_string(list_transform(list_sort(list_transform(list_distinct(string_split(text, ' ')), lambda w: {'p': list_position(string_split(text, ' '), w), 'w': w})), lambda x: x.w), ' ') as words from conversations")
def distinct_words(spark, d):
    """Duplicates go, the first occurrence stays in its place."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@query("drop_impossible", "select conv_id, turn, array_to_string(list_filter(string_split(lower(text), ' '), lambda w: w not in ('the', 'of', 'and')), ' ') as words from conversations")
def drop_impossible(spark, d):
    """Listed words go; order and duplicates of the others stay."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.filter(F.split(F.lower("text"), " "), lambda w: ~w.isin("the", "of", "and")), " ").alias("words"))


@query("identifier_filter", "select source, count(*) as docs, bool_and(n_illegal = 0) as all_legal, count(*) filter (where n_illegal = 0) as legal, sum(n_illegal)::bigint as n_illegal from (select source, len(list_filter(string_split(text, ' '), lambda w: not regexp_matches(w, '^[a-zA-Z0-9_?$@!*`&~:/''.]+$'))) as n_illegal from documents where text is not null) group by source")
def identifier_filter(spark, d):
    """Texts all of whose words are legal identifiers: one that isn't rejects its whole text."""
    illegal = F.size(F.filter(F.split("text", " "), lambda w: ~w.rlike(X.LEGAL_IDENTIFIER))).alias("n_illegal")
    rows = table(spark, d, "documents").where("text is not null").select("source", illegal)
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.bool_and(F.col("n_illegal") == 0).alias("all_legal"), F.count_if(F.col("n_illegal") == 0).alias("legal"), F.sum("n_illegal").alias("n_illegal"))


_LINES = r"array_to_string(list_transform(list_filter(list_zip(ls, list_concat([NULL], ls[:-2])), lambda x: not (trim(x[1]) = '' and x[2] is not null and trim(x[2]) = '')), lambda x: x[1]), chr(10))"


@query("substring_span", "select doc_id, case when l2 is null then substr(l1, 3) when len(l1) < 3 then '' || chr(10) || substr(l2, 1, 9) else substr(l1, 3) || chr(10) || substr(l2, 1, 9) end as part from (select doc_id, (string_split(text, chr(10)))[1] as l1, (string_split(text, chr(10)))[2] as l2 from documents) where l2 is not null")
def substring_span(spark, d):
    """The text from line 1, column 3 up to line 2, column 10."""
    pos = lambda line, col: F.struct(F.lit(line).alias("line"), F.lit(col).alias("col"))
    span = F.struct(pos(1, 3).alias("start"), pos(2, 10).alias("end"))
    docs = table(spark, d, "documents").where(F.contains("text", F.lit("\n")))
    return docs.select("doc_id", X.substring_by_span(F.col("text"), span).alias("part"))


@query("span_predicates", "select count(*) filter (where a.n <= b.n and a.m >= b.m) as contains_n, count(*) filter (where a.n < b.m and b.n < a.m) as meets_n, count(*) filter (where a.m - a.n < b.m - b.n) as smaller_n from (select s_suppkey, s_nationkey as n, s_nationkey + 1 + s_suppkey % 5 as m from supplier) a join (select s_suppkey, s_nationkey as n, s_nationkey + 1 + s_suppkey % 3 as m from supplier) b on a.s_suppkey % 7 = b.s_suppkey % 7")
def span_predicates(spark, d):
    def spans(k, name):
        at = lambda c: F.struct(F.lit(1).alias("line"), c.cast("int").alias("col"))
        lo, hi = F.col("s_nationkey"), F.col("s_nationkey") + 1 + F.col("s_suppkey") % k
        return table(spark, d, "supplier").select((F.col("s_suppkey") % 7).alias("k"), F.struct(at(lo).alias("start"), at(hi).alias("end")).alias(name))

    both = spans(5, "a").join(spans(3, "b"), "k")
    a, b = F.col("a"), F.col("b")
    return both.agg(F.count_if(X.span_contains(a, b)).alias("contains_n"), F.count_if(X.span_intersects(a, b)).alias("meets_n"), F.count_if(X.span_size(a) < X.span_size(b)).alias("smaller_n"))


@query("path_hash", "select page_id, md5(url) as path_hash from pages")
def path_hash(spark, d):
    """Paths as hashes."""
    return table(spark, d, "pages").select("page_id", F.md5("url").alias("path_hash"))


@query("method_length", "select doc_id, n_lines from (select doc_id, len(list_filter(string_split(text, chr(10)), lambda l: not starts_with(trim(l), '//') and not starts_with(trim(l), '/*') and not starts_with(trim(l), '*')))::bigint as n_lines from documents) where n_lines between 2 and 20")
def method_length(spark, d):
    """Lines but for those that look like comments, between two bounds."""
    line = lambda s: ~(F.trim(s).startswith("//") | F.trim(s).startswith("/*") | F.trim(s).startswith("*"))
    n = F.size(F.filter(F.split("text", "\n"), line)).cast("bigint")
    return table(spark, d, "documents").select("doc_id", n.alias("n_lines")).where("n_lines between 2 and 20")
