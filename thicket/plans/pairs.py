"""Queries over path contexts, de-duplication between corpora, and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators import dedup as D
from thicket.operators import paths as P
from thicket.operators import tree as T
from thicket.plans.registry import query, table
from thicket.plans.trees import _UP, _WITH, nodes, numbered
from thicket.session import written

#: Leaves: sentences, named by their key in a camel-case name; every fifth is a number.
_LEAVES = f"""{_UP.replace("select a.sample_id::bigint as sample_id, a.node_id, b.node_id as parent_id, a.node_type", "select a.sample_id::bigint as sample_id, a.node_id, b.node_id as parent_id, a.node_type, a.s")},
leaves as (select sample_id, node_id, case when s % 5 = 0 then 'NUM' else 'sentence|key|' || node_type_l || s end as value from (select *, lower(node_type) as node_type_l from nodes where s is not null)),
lca as (select a.sample_id, a.node as v, b.node as u, arg_min(a.ancestor, a.height) as lca, min(a.height) as hv, arg_min(b.height, a.height) as hu from up a join up b using (sample_id, ancestor) join leaves x on x.sample_id = a.sample_id and x.node_id = a.node join leaves y on y.sample_id = b.sample_id and y.node_id = b.node where a.node < b.node group by 1, 2, 3),
ctx as (select l.sample_id, v, u, x.value || ',' || case when hv = 1 then 'leaf|Turn|leaf' else 'leaf|Turn|Dialogue|Turn|leaf' end || ',' || y.value as context from lca l join leaves x on x.sample_id = l.sample_id and x.node_id = v join leaves y on y.sample_id = l.sample_id and y.node_id = u where hv + 1 + hu <= 8 and abs(hv - hu) <= 2)"""


def named_nodes(spark, d: str) -> DataFrame:
    """The dialogues' trees as syntax trees: sentences are identifiers or numbers."""
    tree, ranked = nodes(spark, d), numbered(spark, d)
    both = tree.join(ranked.select("sample_id", "node_id", "s"), ["sample_id", "node_id"])
    kind = F.when(F.col("s").isNull(), F.col("node_type")).when(F.col("s") % 5 == 0, "Integer").otherwise("Identifier")
    value = F.when(F.col("s").isNotNull(), F.concat(F.lit("sentenceKey_"), F.lower("node_type"), F.col("s").cast("string")))
    return both.select("sample_id", "node_id", "parent_id", F.lit("python").alias("language"), kind.alias("node_type"), value.alias("value"), F.lit(0).alias("name_node"))


def contexts(spark, d: str) -> DataFrame:
    n = named_nodes(spark, d)
    shown = n.withColumn("node_type", F.when(F.col("value").isNotNull(), "leaf").otherwise(F.col("node_type")))
    leaves = P.terminals(n.where("value is not null"), T.root_paths(T.closure(n, 4), shown))
    return P.rendered(P.leaf_pairs(leaves))


@query("leaf_pairs", f"{_WITH}{_LEAVES} select sample_id, v, u, context from ctx")
def leaf_pairs(spark, d):
    return contexts(spark, d)


@query("path_hist", f"{_WITH}{_LEAVES} select kind, word, count(*) as cnt from (select 'node' as kind, unnest(string_split(string_split(context, ',')[2], '|')) as word from ctx union all select 'subtoken', unnest(list_concat(string_split(string_split(context, ',')[1], '|'), string_split(string_split(context, ',')[3], '|'))) from ctx) group by 1, 2")
def path_hist(spark, d):
    """Histograms of path nodes and of the parts of leaf names."""
    parts = F.split("context", ",")
    kinds = F.array(F.struct(F.lit("node").alias("kind"), F.split(parts[1], r"\|").alias("words")), F.struct(F.lit("subtoken").alias("kind"), F.concat(F.split(parts[0], r"\|"), F.split(parts[2], r"\|")).alias("words")))
    flat = contexts(spark, d).select(F.explode(kinds).alias("k")).select("k.kind", F.explode("k.words").alias("word"))
    return flat.groupBy("kind", "word").agg(F.count("*").alias("cnt"))


@query("context_stats", f"{_WITH}{_LEAVES}, n as (select sample_id, count(*) as n from ctx group by 1) select count(*) as samples, avg(n) as mean_contexts, avg(least(n, 200)) as mean_sampled, max(n) as most from n")
def context_stats(spark, d):
    """Contexts of a sample before and after the cap of 200."""
    n = contexts(spark, d).groupBy("sample_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("samples"), F.avg("n").alias("mean_contexts"), F.avg(F.least("n", F.lit(200))).alias("mean_sampled"), F.max("n").alias("most"))


@query("context_lines", f"{_WITH}{_LEAVES}, k as (select sample_id, v, u, context, row_number() over (partition by sample_id order by v, u) - 1 as i from ctx), h as (select *, row_number() over (partition by sample_id order by md5(concat_ws(':', '239', i, context)), i) as r from k) select sample_id, 'dialogue' || sample_id || ' ' || string_agg(context, ' ' order by i) as value from h where r <= 50 group by sample_id")
def context_lines(spark, d):
    """Text lines of target and contexts, sampled by hash to 50 each."""
    ctx = written(contexts(spark, d).select("sample_id", "v", "u", "context"), "contexts")
    targets = ctx.select("sample_id", F.concat(F.lit("dialogue"), F.col("sample_id").cast("string")).alias("target")).distinct()
    line = P.lines(ctx, targets)
    parts = F.split("value", " ")
    return line.select("sample_id", F.array_join(F.concat(F.slice(parts, 1, 1), P.sampled(F.slice(parts, F.lit(2), F.size(parts)), 50, F.lit(239))), " ").alias("value"))


def pairs_of(spark, d: str) -> tuple[DataFrame, DataFrame]:
    n = named_nodes(spark, d)
    leaves = P.terminals(n.where("value is not null"), T.root_paths(T.closure(n, 4)))
    return P.leaf_pairs(leaves, 100, 100), n


_KIDS_NO = "kn as (select sample_id, node_id, (row_number() over (partition by sample_id, parent_id order by node_id)) - 1 as child_no from nodes where parent_id is not null)"


@query(
    "signed_width_pairs",
    f"""{_WITH}{_LEAVES}, {_KIDS_NO}, top as (select l.sample_id, l.v, l.u, l.hv, l.hu, a.ancestor as ta, b.ancestor as tb from lca l join up a on a.sample_id = l.sample_id and a.node = l.v and a.height = l.hv - 1 join up b on b.sample_id = l.sample_id and b.node = l.u and b.height = l.hu - 1)
    select t.sample_id, v, u from top t join kn x on x.sample_id = t.sample_id and x.node_id = ta join kn y on y.sample_id = t.sample_id and y.node_id = tb where hv + hu <= 8 and y.child_no - x.child_no <= 2""",
)
def signed_width_pairs(spark, d):
    """Pairs whose branches are at most two children apart, as the Java extractor counts them."""
    pairs, n = pairs_of(spark, d)
    return P.with_signed_width(pairs, T.child_number(n, 1_000_000), 8, 2).select("sample_id", "v", "u")


@query(
    "numbered_paths",
    f"""{_WITH}{_LEAVES}, {_KIDS_NO}, ty as (select n.sample_id, n.node_id, case when n.s is null then n.node_type when n.s % 5 = 0 then 'Integer' else 'Identifier' end as t, least(coalesce(child_no, 0), 3) as c from nodes n left join kn using (sample_id, node_id)),
    st as (select l.sample_id, l.v, l.u, l.hv, a.height as pos, a.ancestor as node_id from lca l join up a on a.sample_id = l.sample_id and a.node = l.v and a.height <= l.hv union all select l.sample_id, l.v, l.u, l.hv, l.hv + l.hu - b.height, b.ancestor from lca l join up b on b.sample_id = l.sample_id and b.node = l.u and b.height < l.hu)
    select sample_id, v, u, string_agg(t || case when node_id in (v, u) or (t = 'Turn') then c::varchar else '' end, '|' order by pos) as path from st join ty using (sample_id, node_id) group by 1, 2, 3""",
)
def numbered_paths(spark, d):
    """Paths that show the numbers of their ends and of the children of dialogues."""
    pairs, n = pairs_of(spark, d)
    parent = n.select("sample_id", F.col("node_id").alias("parent_id"), F.col("node_type").alias("parent_type"))
    shown = n.join(parent, ["sample_id", "parent_id"], "left").join(T.child_number(n, 1_000_000), ["sample_id", "node_id"], "left").withColumn("child_no", F.coalesce("child_no", F.lit(0)))
    return P.rendered_with_numbers(pairs, shown, 3, ("Dialogue",))


@query("dense_contexts")
def dense_contexts(spark, d):
    """Context lines read back as arrays of ids with lengths and a mask."""
    rows = P.parsed(written(context_lines(spark, d), "context-lines"))  # vocabularies and columns read them
    words = lambda *c: rows.select(F.explode(F.concat(*c)).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))
    ids = lambda cnt: cnt.orderBy(F.col("cnt").desc(), "word").limit(100).select("word", (F.row_number().over(Window.orderBy(F.col("cnt").desc(), "word")) + 1).alias("id"))
    return P.dense(rows, "sample_id", ids(words("src", "dst")), ids(words("path")), 20)


@query("variable_pairs", "select a.l_orderkey, count(*) as pairs from (select distinct l_orderkey, l_suppkey from lineitem) a join (select distinct l_orderkey, l_suppkey from lineitem) b on a.l_orderkey = b.l_orderkey and a.l_suppkey <= b.l_suppkey group by 1")
def variable_pairs(spark, d):
    """Unordered pairs of an order's distinct variables, each with itself too."""
    v = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    both = v.join(v.select("l_orderkey", F.col("l_suppkey").alias("other")), "l_orderkey").where("l_suppkey <= other")
    return both.groupBy("l_orderkey").agg(F.count("*").alias("pairs"))


@query("group_by_first_seen", "select l_orderkey, l_suppkey, min(l_linenumber) as first_line, string_agg(l_partkey::varchar, ' ' order by l_linenumber, l_partkey) as parts from lineitem group by 1, 2")
def group_by_first_seen(spark, d):
    """Leaves grouped by their variable's name, with the place it is seen first."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("first_line"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return g.select("l_orderkey", "l_suppkey", "first_line", F.array_join(F.transform("x", lambda v: v["l_partkey"].cast("string")), " ").alias("parts"))


@query("coverage", f"{_WITH}{_LEAVES}, k as (select word from (select unnest(string_split(string_split(context, ',')[1], '|')) as word, context from ctx) group by word having count(*) > 20), c as (select sample_id, string_split(context, ',')[1] as s, string_split(context, ',')[3] as f from ctx) select sample_id, count(*) filter (where a and b) as full_found, count(*) filter (where a or b) as partial_found from (select sample_id, list_last(string_split(s, '|')) in (select word from k) as a, list_last(string_split(f, '|')) in (select word from k) as b from c) group by 1")
def coverage(spark, d):
    """Contexts of which both, or either, end is in a vocabulary."""
    parts = F.split("context", ",")
    ctx = written(contexts(spark, d).select("sample_id", F.split(parts[0], r"\|").alias("s"), F.split(parts[2], r"\|").alias("f")), "context-ends")
    known = ctx.select(F.explode("s").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 20")
    a, b = known.select(F.col("word").alias("a")), known.select(F.col("word").alias("b"))
    out = ctx.join(a, F.element_at("s", -1) == F.col("a"), "left").join(b, F.element_at("f", -1) == F.col("b"), "left")
    x, y = F.col("a").isNotNull(), F.col("b").isNotNull()
    return out.groupBy("sample_id").agg(F.count_if(x & y).alias("full_found"), F.count_if(x | y).alias("partial_found"))


# Files: a document's stem is its first word, its project the source, its size the characters.
_FILES = "f as (select doc_id, source as project, lower(split_part(text, ' ', 1)) as stem, n_chars as size, text from documents where text is not null)"


def files(spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.col("source").alias("project"), F.lower(F.substring_index("text", " ", 1)).alias("stem"), F.col("n_chars").alias("size"), "text")


@query("dedup_exact", "select min(doc_id) as doc_id, count(*) as copies from documents group by text having count(*) > 1")
def dedup_exact(spark, d):
    """Groups of equal texts; texts are compared by a 128-bit hash, so they aren't shuffled."""
    docs = table(spark, d, "documents").select("doc_id", F.xxhash64("text").alias("h"), F.md5("text").alias("m"))
    return docs.groupBy("h", "m").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").select("doc_id", "copies")


def near_sizes(spark, d: str) -> DataFrame:
    """(a, b) for files with equal stems and sizes within five percent of b's. A band of sizes is part of the key, so that a
    common stem doesn't meet itself whole: sizes within the ratio are in the same or neighbouring bands."""
    f = files(spark, d).where("size > 0").select("stem", "doc_id", "size", F.floor(F.ln("size") / F.ln(F.lit(1.06))).cast("int").alias("band"))
    a = f.select("stem", F.col("doc_id").alias("a"), F.col("size").alias("size_a"), F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"))
    b = f.select("stem", F.col("doc_id").alias("b"), F.col("size").alias("size_b"), "band")
    r = D.size_ratio(F.col("size_a"), F.col("size_b"))
    return a.join(b, ["stem", "band"]).where("a <> b").where((r > 0.95) & (r < 1.05)).select("a", "b")


@query("dedup_band", f"with {_FILES} select a.doc_id as a, b.doc_id as b from f a join f b on a.stem = b.stem and a.doc_id < b.doc_id where a.size::double / b.size > 0.95 and a.size::double / b.size < 1.05")
def dedup_band(spark, d):
    return near_sizes(spark, d).where("a < b")


@query("project_overlap", f"with {_FILES}, k as (select project, count(*) as n_files from f group by 1), p as (select distinct a.project, b.project as candidate, a.doc_id as file from f a join f b on a.stem = b.stem and a.project <> b.project where a.size::double / b.size > 0.95 and a.size::double / b.size < 1.05) select p.project, candidate, count(distinct file) as n_shared, n_files, count(distinct file) / n_files as overlap from p join k using (project) group by 1, 2, 4 having count(distinct file) / n_files > 0.05 and n_files > 10")
def project_overlap(spark, d):
    # the texts are read once, for their stems
    f = written(files(spark, d).select("project", F.col("doc_id").alias("file"), "stem", "size"), "files")
    sizes = f.groupBy("project").agg(F.count("*").alias("n_files"))
    return D.project_overlap(D.shared_files(f, "stem"), sizes, 0.05, 10).select("project", "candidate", "n_shared", "n_files", "overlap")


@query("similar_files")
def similar_files(spark, d):
    """Documents with the same stem that are similar: pairs of the first ones of equal texts, and each copy with that of its text."""
    f = files(spark, d).withColumn("path", F.col("doc_id")).withColumn("content", F.col("text"))
    out = D.similar_files(f, f, "stem", within=True)
    return out.withColumns({c: F.col(c).cast("string") for c in ("a", "b")})


@query("antijoin_delete", "select doc_id, source from documents where text not in (select text from (select text, count(*) as c from documents group by text) where c > 1)")
def antijoin_delete(spark, d):
    """Rows but for those of duplicated texts."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    twice = docs.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    return D.without(docs, twice, "h").select("doc_id", "source")


@query("semijoin_projects", "select doc_id from documents where source in (select source from documents where lang = 'de' group by source having count(*) > 5)")
def semijoin_projects(spark, d):
    docs = table(spark, d, "documents")
    listed = docs.where("lang = 'de'").groupBy("source").agg(F.count("*").alias("c")).where("c > 5")
    return docs.join(listed, "source", "left_semi").select("doc_id")


@query("setops", "select 'union' as op, count(*) as n from (select c_nationkey from customer union select s_nationkey from supplier) union all select 'intersect', count(*) from (select c_nationkey from customer intersect select s_nationkey from supplier) union all select 'except', count(*) from (select n_nationkey from nation except select s_nationkey from supplier) union all select 'union_all', count(*) from (select c_nationkey from customer union all select s_nationkey from supplier)")
def setops(spark, d):
    c, s, n = table(spark, d, "customer").select("c_nationkey"), table(spark, d, "supplier").select("s_nationkey"), table(spark, d, "nation").select("n_nationkey")
    named = {"union": c.union(s).distinct(), "intersect": c.intersect(s), "except": n.subtract(s), "union_all": c.union(s)}
    out = None
    for op, df in named.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
        out = row if out is None else out.union(row)
    return out


@query("triple_lookup", "select a.l_returnflag, count(*) as n from lineitem a join (select l_orderkey, l_partkey, l_suppkey from lineitem where l_quantity > 45) b on a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey group by 1")
def triple_lookup(spark, d):
    li = table(spark, d, "lineitem")
    return li.join(li.where("l_quantity > 45").select("l_orderkey", "l_partkey", "l_suppkey"), ["l_orderkey", "l_partkey", "l_suppkey"]).groupBy("l_returnflag").agg(F.count("*").alias("n"))
