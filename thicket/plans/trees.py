"""Queries over trees: a dialogue with its turns and their sentences is one tree, so trees grow in number with the data, not in size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators import tree as T
from thicket.plans.registry import query, table

_NODES = """sentences as (select conv_id, turn, generate_subscripts(string_split(text, '. '), 1) as k from conversations where text is not null),
raw as (
  select distinct conv_id as sample_id, null::int as n, null::bigint as s, 'Dialogue' as node_type from conversations where text is not null
  union all select conv_id, turn::int, null, 'Turn' from conversations where text is not null
  union all select conv_id, turn::int, turn * 100000 + k, case when (turn + k) % 4 = 0 then 'Empty' else 'Sentence' end from sentences),
ids as (select *, ((row_number() over (partition by sample_id order by n nulls first, s nulls first)) - 1)::int as node_id from raw),
nodes as (select a.sample_id::bigint as sample_id, a.node_id, b.node_id as parent_id, a.node_type from ids a left join ids b on b.sample_id = a.sample_id and a.n is not null and case when a.s is null then b.n is null else b.n = a.n and b.s is null end)"""
_UP = f"""{_NODES}, up as (select sample_id, node_id as ancestor, node_id as node, 0 as height from nodes union all
  select u.sample_id, n.parent_id, u.node, u.height + 1 from up u join nodes n on n.sample_id = u.sample_id and n.node_id = u.ancestor where n.parent_id is not null)"""
_SP = f"{_UP}, sp as (select a.sample_id, a.node as i, b.node as j, min(a.height + b.height)::int as value from up a join up b using (sample_id, ancestor) group by 1, 2, 3)"
_WITH = "with recursive "


def numbered(spark, d: str) -> DataFrame:
    """(sample_id, n, s, node_type, node_id): dialogues, turns n and sentences s of them, in pre-order."""
    t = table(spark, d, "conversations").where("text is not null").select(F.col("conv_id").alias("sample_id"), F.col("turn").cast("int").alias("n"), "turn", "text")
    no_n, no_s = F.lit(None).cast("int").alias("n"), F.lit(None).cast("bigint").alias("s")
    raw = t.select("sample_id", no_n, no_s, F.lit("Dialogue").alias("node_type")).distinct().union(t.select("sample_id", "n", no_s, F.lit("Turn")))
    line = t.select("sample_id", "n", "turn", F.posexplode(F.split("text", r"\. ")).alias("k", "line")).withColumn("k", F.col("k") + 1)
    raw = raw.union(line.select("sample_id", "n", F.col("turn") * 100_000 + F.col("k"), F.when((F.col("turn") + F.col("k")) % 4 == 0, "Empty").otherwise("Sentence")))
    return T.preorder(raw, "sample_id", ["n", "s"])


def nodes(spark, d: str) -> DataFrame:
    ids = numbered(spark, d)
    # the parent's number: of the last turn above, in pre-order
    w = Window.partitionBy("sample_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.last(F.when(F.col("s").isNull() & F.col("n").isNotNull(), F.col("node_id")), ignorenulls=True).over(w)
    parent = F.when(F.col("s").isNotNull(), turn).when(F.col("n").isNotNull(), F.lit(0))
    return ids.withColumn("parent_id", parent).select("sample_id", "node_id", "parent_id", "node_type")


def up(spark, d: str) -> DataFrame:
    return T.closure(nodes(spark, d), 4)


@query("tree_nodes", f"with {_NODES} select sample_id, node_id, parent_id, node_type from nodes")
def tree_nodes(spark, d):
    return nodes(spark, d)


@query("tree_closure", f"{_WITH}{_UP} select sample_id, ancestor, node, height from up")
def tree_closure(spark, d):
    return up(spark, d)


@query("tree_closure_recursive", f"{_WITH}{_UP} select sample_id, ancestor, node, height from up")
def tree_closure_recursive(spark, d):
    return T.closure_recursive(nodes(spark, d))


@query("tree_sp", f"{_WITH}{_SP} select sample_id, i, j, value from sp")
def tree_sp(spark, d):
    return T.shortest_paths(up(spark, d))


@query("tree_sp_threshold", f"{_WITH}{_SP} select sample_id, value, count(*) as pairs from sp where value <= 3 group by 1, 2")
def tree_sp_threshold(spark, d):
    return T.shortest_paths(up(spark, d), 3).groupBy("sample_id", "value").agg(F.count("*").alias("pairs"))


@query("graph_hops", f"with {_NODES} select sample_id, value, count(*) as pairs from (select sample_id, i, j, min(v) as value from (select sample_id, node_id as i, node_id as j, 0 as v from nodes union all select sample_id, node_id, parent_id, 1 from nodes where parent_id is not null union all select sample_id, parent_id, node_id, 1 from nodes where parent_id is not null union all select a.sample_id, a.node_id, b.node_id, 2 from nodes a join nodes b using (sample_id) where a.parent_id = b.parent_id and a.node_id <> b.node_id union all select a.sample_id, a.node_id, b.parent_id, 2 from nodes a join nodes b on a.sample_id = b.sample_id and a.parent_id = b.node_id where b.parent_id is not null union all select a.sample_id, b.parent_id, a.node_id, 2 from nodes a join nodes b on a.sample_id = b.sample_id and a.parent_id = b.node_id where b.parent_id is not null) group by 1, 2, 3) group by 1, 2")
def graph_hops(spark, d):
    """All-pairs shortest paths of the undirected graph, up to two edges."""
    e = nodes(spark, d).where("parent_id is not null").select("sample_id", F.col("parent_id").alias("i"), F.col("node_id").alias("j"))
    both = e.union(e.select("sample_id", "j", "i"))
    return T.hop_distances(both, 2).groupBy("sample_id", "value").agg(F.count("*").alias("pairs"))


@query("ancestor_dist", f"{_WITH}{_UP} select sample_id, ancestor as i, node as j, height as value from up union all select sample_id, node, ancestor, -height from up where height > 0")
def ancestor_dist(spark, d):
    return T.ancestor_distances(up(spark, d))


@query("ancestor_dist_back", f"{_WITH}{_UP} select sample_id, node as i, ancestor as j, height as value from up where height <= 1")
def ancestor_dist_back(spark, d):
    """Backward only, up to one step."""
    return T.ancestor_distances(up(spark, d), forward=False, threshold=1)


@query("sibling_next", f"with {_NODES} select * from (select sample_id, node_id as node, lead(node_id) over (partition by sample_id, parent_id order by node_id) as next_node from nodes where parent_id is not null) where next_node is not null")
def sibling_next(spark, d):
    return T.next_siblings(nodes(spark, d))


_KIDS = "kids as (select sample_id, parent_id, node_id, row_number() over (partition by sample_id, parent_id order by node_id) as k from nodes where parent_id is not null)"
_SIB = f"{_NODES}, {_KIDS}"


@query("sibling_dist", f"with {_SIB} select sample_id, node_id as i, node_id as j, 0 as value from nodes union all select a.sample_id, a.node_id, b.node_id, (b.k - a.k)::int from kids a join kids b using (sample_id, parent_id) where a.k <> b.k")
def sibling_dist(spark, d):
    return T.sibling_distances(nodes(spark, d))


@query("token_dist", f"with {_NODES} select a.sample_id, a.node_id as i, b.node_id as j, b.node_id - a.node_id as value from nodes a join nodes b using (sample_id)")
def token_dist(spark, d):
    return T.sequence_distances(nodes(spark, d), "node_id")


@query("node_degree", f"with {_NODES} select n.sample_id, n.node_id, count(c.node_id) as n_children from nodes n left join nodes c on c.sample_id = n.sample_id and c.parent_id = n.node_id group by 1, 2")
def node_degree(spark, d):
    return T.degrees(nodes(spark, d))


@query("adj_normalized", f"with {_NODES}, e as (select sample_id, parent_id as i, node_id as j from nodes where parent_id is not null union all select sample_id, node_id, parent_id from nodes where parent_id is not null union all select sample_id, node_id, node_id from nodes), g as (select sample_id, i, count(*) as d from e group by 1, 2) select e.sample_id, e.i, e.j, 1 / sqrt(a.d * b.d) as value from e join g a on a.sample_id = e.sample_id and a.i = e.i join g b on b.sample_id = e.sample_id and b.i = e.j")
def adj_normalized(spark, d):
    return T.normalized_adjacency(nodes(spark, d))


@query("tree_prune", f"with {_NODES}, l as (select *, ((row_number() over (partition by sample_id order by node_id)) - 1)::int as new_id from nodes where not (node_type = 'Empty')) select a.sample_id, a.new_id as node_id, b.new_id as parent_id, a.node_type from l a left join l b on b.sample_id = a.sample_id and b.node_id = a.parent_id")
def tree_prune(spark, d):
    return T.prune(nodes(spark, d))


_SPANS = f"{_UP}, spans as (select sample_id, ancestor as node_id, min(node) as lo, max(node) + 1 as hi from up group by 1, 2), tok as (select sample_id, node_id as token_idx, node_id as start, node_id + 1 + (case when node_id % 5 = 0 then 1 else 0 end) as stop from nodes)"


def spans(spark, d: str) -> DataFrame:
    """A node's span: the pre-order numbers of its subtree."""
    n = nodes(spark, d)
    reach = T.closure(n, 4).groupBy("sample_id", F.col("ancestor").alias("node_id")).agg(F.min("node").alias("lo"), (F.max("node") + 1).alias("hi"))
    return reach.join(n.select("sample_id", "node_id", "parent_id"), ["sample_id", "node_id"])


def token_spans(spark, d: str) -> DataFrame:
    return nodes(spark, d).select("sample_id", F.col("node_id").alias("token_idx"), F.col("node_id").alias("start"), (F.col("node_id") + 1 + (F.col("node_id") % 5 == 0).cast("int")).alias("stop"))


@query("token_node_map", f"{_WITH}{_SPANS} select t.sample_id, t.token_idx, coalesce(arg_min(s.node_id, (s.hi - s.lo) * 1000000 - s.node_id), 0) as node_id from tok t left join spans s on s.sample_id = t.sample_id and s.lo <= t.start and s.hi >= t.stop group by 1, 2")
def token_node_map(spark, d):
    return T.tightest_node(token_spans(spark, d), spans(spark, d))


@query("node_tokens", f"{_WITH}{_SPANS}, m as (select t.sample_id, t.token_idx, coalesce(arg_min(s.node_id, (s.hi - s.lo) * 1000000 - s.node_id), 0) as node_id from tok t left join spans s on s.sample_id = t.sample_id and s.lo <= t.start and s.hi >= t.stop group by 1, 2) select sample_id, node_id, string_agg(token_idx::varchar, ' ' order by token_idx) as tokens from m group by 1, 2")
def node_tokens(spark, d):
    out = T.tokens_of_nodes(T.tightest_node(token_spans(spark, d), spans(spark, d)))
    return out.select("sample_id", "node_id", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("tokens"))


@query("best_token", "select sample_id, node_id, token_idx, sub from (select l_orderkey as sample_id, l_linenumber as node_id, token_idx, string_split(p_type, ' ') as w, list_slice(string_split(p_type, ' '), 1, 1 + token_idx % 3) as sub_l, array_to_string(list_slice(string_split(p_type, ' '), 1, 1 + token_idx % 3), ' ') as sub, token_idx % 7 = 0 as special from (select l_orderkey, l_linenumber, l_partkey, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)) - 1 as token_idx from lineitem ) join part on l_partkey = p_partkey) qualify row_number() over (partition by sample_id, node_id order by special, len(sub_l) desc, length(sub_l[1]) desc, token_idx) = 1")
def best_token(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, d, "lineitem").withColumn("token_idx", (F.row_number().over(w) - 1).cast("bigint"))
    rows = rows.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    tokens = rows.select(F.col("l_orderkey").alias("sample_id"), "token_idx", F.slice(F.split("p_type", " "), F.lit(1), (1 + F.col("token_idx") % 3).cast("int")).alias("sub_tokens"), (F.col("token_idx") % 7 == 0).alias("special"))
    mapping = rows.select(F.col("l_orderkey").alias("sample_id"), "token_idx", F.col("l_linenumber").alias("node_id"))
    return T.best_tokens(tokens, mapping).select("sample_id", "node_id", "token_idx", F.array_join("sub_tokens", " ").alias("sub"))


@query("nearest_ancestor", f"{_WITH}{_UP} select u.sample_id, u.node, arg_min(n.node_type, u.height) as found, min(u.height) as height from up u join nodes n on n.sample_id = u.sample_id and n.node_id = u.ancestor where n.node_type <> 'Empty' group by 1, 2")
def nearest_ancestor(spark, d):
    """The closest node above (or the node itself) whose type is a word that counts."""
    n = nodes(spark, d)
    kinds = n.where("node_type <> 'Empty'").select("sample_id", F.col("node_id").alias("ancestor"), "node_type")
    return T.closure(n, 4).join(kinds, ["sample_id", "ancestor"]).groupBy("sample_id", "node").agg(F.min_by("node_type", "height").alias("found"), F.min("height").alias("height"))


@query("ast_only", f"with {_NODES} select n.sample_id, n.node_id, case when count(c.node_id) = 0 then n.node_type else '[DUMMY]' end as token from nodes n left join nodes c on c.sample_id = n.sample_id and c.parent_id = n.node_id group by n.sample_id, n.node_id, n.node_type")
def ast_only(spark, d):
    """A tree as a sequence: leaves show their token, inner nodes a dummy."""
    n = nodes(spark, d)
    return n.join(T.degrees(n), ["sample_id", "node_id"]).select("sample_id", "node_id", F.when(F.col("n_children") == 0, F.col("node_type")).otherwise("[DUMMY]").alias("token"))


@query("matrix_reindex", f"{_WITH}{_SP}, m as (select sample_id, node_id as token_idx, coalesce(parent_id, 0) as node_id from nodes) select s.sample_id, a.token_idx as i, b.token_idx as j, s.value from sp s join m a on a.sample_id = s.sample_id and a.node_id = s.i join m b on b.sample_id = s.sample_id and b.node_id = s.j")
def matrix_reindex(spark, d):
    n = nodes(spark, d)
    mapping = n.select("sample_id", F.col("node_id").alias("token_idx"), F.coalesce("parent_id", F.lit(0)).alias("node_id"))
    return T.reindexed(T.shortest_paths(T.closure(n, 4)), mapping)


@query("matrix_submatrix", f"{_WITH}{_SP}, k as (select sample_id, node_id, ((row_number() over (partition by sample_id order by node_id)) - 1)::int as new from nodes where node_id % 3 = 0) select s.sample_id, a.new as i, b.new as j, s.value from sp s join k a on a.sample_id = s.sample_id and a.node_id = s.i join k b on b.sample_id = s.sample_id and b.node_id = s.j")
def matrix_submatrix(spark, d):
    n = nodes(spark, d)
    return T.submatrix(T.shortest_paths(T.closure(n, 4)), n.where("node_id % 3 = 0"), "node_id")


@query("edge_types", f"{_WITH}{_SP}, {_KIDS} select sample_id, 'child' as edge_type, ancestor as src, node as dst from up where height = 1 union all select sample_id, 'parent', node, ancestor from up where height = 1 union all select sample_id, 'neighbour', i, j from sp where value = 1 union all select a.sample_id, case when b.k > a.k then 'next_sibling' else 'previous_sibling' end, a.node_id, b.node_id from kids a join kids b using (sample_id, parent_id) where abs(b.k - a.k) = 1")
def edge_types(spark, d):
    return T.edge_types(metrics(spark, d))


def metrics(spark, d: str) -> DataFrame:
    n = nodes(spark, d)
    u = T.closure(n, 4)
    tag = lambda df, m: df.select("sample_id", F.lit(m).alias("metric"), "i", "j", "value")
    return tag(T.ancestor_distances(u), "ancestor_sp").union(tag(T.sibling_distances(n), "sibling_sp")).union(tag(T.shortest_paths(u), "shortest_paths"))


#: SQL of `metrics`.
_TREE_METRICS = f"""{_WITH}{_SP}, {_KIDS}, dist as (select sample_id, 'ancestor_sp' as metric, ancestor as i, node as j, height as value from up union all select sample_id, 'ancestor_sp', node, ancestor, -height from up where height > 0
    union all select sample_id, 'sibling_sp', node_id, node_id, 0 from nodes union all select a.sample_id, 'sibling_sp', a.node_id, b.node_id, (b.k - a.k)::int from kids a join kids b using (sample_id, parent_id) where a.k <> b.k
    union all select sample_id, 'shortest_paths', i, j, value from sp)"""


@query("max_dist_mask", f"{_WITH}{_SP}, {_KIDS}, f as (select sample_id, i, j, value > 2 as far from sp union all select a.sample_id, a.node_id, b.node_id, abs(b.k - a.k) > 1 from kids a join kids b using (sample_id, parent_id) union all select sample_id, 0, 0, false from nodes where node_id = 0) select sample_id, i, j, bool_or(far) as masked from f group by 1, 2, 3")
def max_dist_mask(spark, d):
    """Pairs further apart than 2 edges or 1 sibling; ancestor distances are left out by -1."""
    return T.far_pairs(nodes(spark, d), {"shortest_paths": 2, "sibling_sp": 1, "ancestor_sp": -1}, max_depth=4)


@query("child_saturate", f"with {_NODES} select sample_id, node_id, least((row_number() over (partition by sample_id, parent_id order by node_id)) - 1, 3)::int as child_no from nodes where parent_id is not null")
def child_saturate(spark, d):
    return T.child_number(nodes(spark, d))


@query("root_path", f"{_WITH}{_UP} select sample_id, node, string_agg(ancestor::varchar, ' ' order by height desc) as path from up group by 1, 2")
def root_path(spark, d):
    return T.root_paths(up(spark, d)).select("sample_id", "node", F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path"))


@query("lca_split", f"{_WITH}{_UP}, c as (select a.sample_id, a.node as v, b.node as u, arg_min(a.ancestor, a.height) as lca, min(a.height) as v_tail, min(b.height) as u_tail from up a join up b using (sample_id, ancestor) where a.node < b.node group by 1, 2, 3) select sample_id, v, u, lca, v_tail, u_tail from c")
def lca_split(spark, d):
    """Two root paths cut at their last common node."""
    p = T.root_paths(up(spark, d))
    a, b = p.select("sample_id", F.col("node").alias("v"), F.col("path").alias("vp")), p.select("sample_id", F.col("node").alias("u"), F.col("path").alias("up"))
    k = T.common_prefix(F.col("vp"), F.col("up"))
    out = a.join(b, "sample_id").where("v < u").withColumn("k", k)
    return out.select("sample_id", "v", "u", F.element_at("vp", F.col("k")).alias("lca"), (F.size("vp") - F.col("k")).alias("v_tail"), (F.size("up") - F.col("k")).alias("u_tail"))


@query("coo_roundtrip", "with c as (select s_nationkey as i, (s_suppkey % 12)::int as j, count(*) as value from supplier group by 1, 2) select n_nationkey as i, g.j, coalesce(value, 0) as value from nation cross join (select unnest(range(12))::int as j) g left join c on c.i = n_nationkey and c.j = g.j")
def coo_roundtrip(spark, d):
    """A dense matrix from (i, j, v) of its nonzero cells."""
    sparse = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("i"), (F.col("s_suppkey") % 12).cast("int").alias("j")).agg(F.count("*").alias("value"))
    grid = table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("j"))
    return grid.join(sparse, ["i", "j"], "left").select("i", "j", F.coalesce("value", F.lit(0)).alias("value"))


@query("ppr_distances")
def ppr_distances(spark, d):
    """Personalised PageRank of whole trees."""
    return T.pagerank_distances(nodes(spark, d), threshold=float(2.718281828459045**-5))


def html_nodes(pages: DataFrame) -> DataFrame:
    """The tag tree of each page, by the standard library's parser: void and unclosed tags end with their parent."""
    import pandas as pd

    def run(frames):
        from html.parser import HTMLParser

        void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
        for frame in frames:
            rows = []
            for page, html in zip(frame["page_id"], frame["html"], strict=True):
                stack, out = [], []

                class Tags(HTMLParser):
                    def handle_starttag(self, tag, attrs, stack=stack, out=out):
                        out.append((len(out), stack[-1][0] if stack else None, tag))
                        if tag not in void:
                            stack.append((len(out) - 1, tag))

                    def handle_endtag(self, tag, stack=stack):
                        if any(t == tag for _, t in stack):
                            while stack.pop()[1] != tag:
                                pass

                Tags().feed(html or "")
                rows += [(page, n, p, t) for n, p, t in out]
            x = pd.DataFrame(rows, columns=["sample_id", "node_id", "parent_id", "node_type"])
            x["parent_id"] = x["parent_id"].astype("Int32")
            yield x

    return pages.select("page_id", "html").mapInPandas(run, "sample_id bigint, node_id int, parent_id int, node_type string")


@query("tree_surroundings", f"{_WITH}{_UP}, l as (select n.sample_id, n.node_id, count(c.node_id) = 0 as leaf from nodes n left join nodes c on c.sample_id = n.sample_id and c.parent_id = n.node_id group by 1, 2) select u.sample_id, u.ancestor as node, (select count(*) - 1 from up a where a.sample_id = u.sample_id and a.node = u.ancestor) as n_ancestors, count(*) - 1 as n_descendants, count(*) filter (where leaf) as n_leaves from up u join l on l.sample_id = u.sample_id and l.node_id = u.node group by u.sample_id, u.ancestor")
def tree_surroundings(spark, d):
    """Nodes above and below each node, and leaves below it."""
    n = nodes(spark, d)
    return T.surroundings(T.closure(n, 4), n)


@query("tree_size_filter", f"with {_NODES} select sample_id, count(*) as n from nodes group by 1 having count(*) <= 40")
def tree_size_filter(spark, d):
    """Trees of at most 40 nodes."""
    from thicket.operators import views as V

    n = nodes(spark, d)
    return V.small_trees(n, n, 40).groupBy("sample_id").agg(F.count("*").alias("n"))


@query("tree_dot", f"with {_NODES} select sample_id, 'digraph {{' || chr(10) || string_agg('  n' || node_id || ' [label=\"' || node_type || '\"];' || case when parent_id is not null then chr(10) || '  n' || parent_id || ' -> n' || node_id || ';' else '' end, chr(10) order by node_id) || chr(10) || '}}' as dot from nodes group by 1")
def tree_dot(spark, d):
    return T.dot(nodes(spark, d))


@query("html_tag_tree")
def html_tag_tree(spark, d):
    return html_nodes(table(spark, d, "pages"))
