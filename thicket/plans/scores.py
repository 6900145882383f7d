"""Queries over binning and evaluation metrics.

Predictions and labels: the names of the parts of consecutive lines of an order, as arrays of words padded to five (the longest name
has as many); some are empty; words that begin with "b" count as unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.text import pad_or_truncate
from thicket.operators import binning as B
from thicket.operators import metrics as M
from thicket.plans.registry import query, table
from thicket.plans.trees import _TREE_METRICS
from thicket.plans.trees import metrics as tree_metrics
from thicket.plans.trees import nodes

PAD, UNK = "[PAD]", "<unk>"
_NAME = "case p_size % 4 when 0 then [] when 1 then string_split(p_name, ' ') when 2 then string_split(p_name || ' ' || p_type, ' ') else string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ') end"
_CLEAN = f"list_transform((list_concat({_NAME}, list_transform(range(5), lambda x: '[PAD]')))[1:5], lambda w: case when starts_with(w, 'b') then '<unk>' else w end)"
_PAIRS = f"t as (select l_orderkey, l_linenumber, l_returnflag as role, {_CLEAN} as ws from lineitem join part on l_partkey = p_partkey), pairs as (select a.role, a.ws as pred, b.ws as label from t a join t b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1)"
_KEPT = "list_filter({}, lambda x: x not in ('[PAD]', '<unk>'))"
_PART = "not (len(list_filter(label, lambda x: x <> '<unk>' and x <> '[PAD]')) = 0 and len(list_filter(label, lambda x: x <> '[PAD]')) > 0)"
_EXACT = "len(list_filter(range(1, 6), lambda i: pred[i] = label[i] or label[i] = '<unk>')) = 5"
_COUNTED = f"""{_PAIRS}, f as (select *, {_KEPT.format('pred')} as p, {_KEPT.format('label')} as l, len(list_filter(pred, lambda x: x <> '[PAD]')) = 0 and len(list_filter(label, lambda x: x <> '[PAD]')) = 0 as none from pairs),
c as (select *, case when none then 1 when p = l then len(l) else len(list_filter(p, lambda x: list_contains(l, x))) end as tp, case when none or p = l then 0 else len(list_filter(p, lambda x: not list_contains(l, x))) end as fp, case when none or p = l then 0 else len(list_filter(l, lambda x: not list_contains(p, x))) end as fn from f)"""
_PRF = "coalesce(tp / nullif(tp + fp, 0), 0)::double as precision, coalesce(tp / nullif(tp + fn, 0), 0)::double as recall"


def pairs(spark, d: str) -> DataFrame:
    name = F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 4 >= 2, F.col("p_type")), F.when(F.col("p_size") % 4 == 3, F.col("p_brand")))
    words = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.split(name, " "))
    words = F.transform(pad_or_truncate(words, 5, F.lit(PAD)), lambda w: F.when(w.startswith("b"), UNK).otherwise(w))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), words.alias("ws"))
    t = table(spark, d, "lineitem").join(parts, "l_partkey").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("role"), "ws")
    after = t.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("ws").alias("label"))
    return t.withColumnRenamed("ws", "pred").join(after, ["l_orderkey", "l_linenumber"])


@query("top1_accuracy", f"with {_PAIRS} select role, avg(case when {_PART} then ({_EXACT})::int end) as accuracy from pairs group by role")
def top1_accuracy(spark, d):
    return pairs(spark, d).groupBy("role").agg(M.top1_accuracy(F.col("pred"), F.col("label"), PAD, UNK).alias("accuracy"))


@query("non_trivial_accuracy", f"with {_PAIRS} select role, avg(case when {_PART} and len(list_filter(label, lambda x: x <> '[PAD]')) >= 2 then ({_EXACT})::int end) as accuracy from pairs group by role")
def non_trivial_accuracy(spark, d):
    return pairs(spark, d).groupBy("role").agg(M.non_trivial_accuracy(F.col("pred"), F.col("label"), PAD, UNK).alias("accuracy"))


@query("topk_accuracy", "select count(*) as n, avg((list_contains([string_split(a.p_name, ' ')[1], string_split(b.p_name, ' ')[1], string_split(c.p_name, ' ')[1]], string_split(p.p_name, ' ')[1]) and list_contains([string_split(a.p_name, ' ')[2], string_split(b.p_name, ' ')[2], string_split(c.p_name, ' ')[2]], string_split(p.p_name, ' ')[2]))::int) as accuracy from part p join part a on a.p_partkey = p.p_partkey + 1 join part b on b.p_partkey = p.p_partkey + 2 join part c on c.p_partkey = p.p_partkey + 3")
def topk_accuracy(spark, d):
    """Three ranked guesses for each of the two words of a part's name: the names of the next three parts."""
    w = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("label"))
    rows = w
    for k in (1, 2, 3):
        rows = rows.join(w.select((F.col("p_partkey") - k).alias("p_partkey"), F.col("label").alias(f"g{k}")), "p_partkey")
    ranked = F.arrays_zip("g1", "g2", "g3")
    rows = rows.select("label", F.transform(ranked, lambda x: F.array(x["g1"], x["g2"], x["g3"])).alias("ranked"))
    return rows.agg(F.count("*").alias("n"), M.topk_accuracy(F.col("ranked"), F.col("label")).alias("accuracy"))


@query(
    "macro_precision_recall",
    f"""with {_PAIRS}, r as (select role, {_PART} as ok, list_filter(pred, lambda x: x <> '[PAD]') as p, {_KEPT.format('label')} as l, len(list_filter(label, lambda x: x <> '[PAD]')) = 0 as lp, pred, label from pairs)
    select role, avg(case when ok then case when len(p) = 0 then lp::int else len(list_filter(p, lambda x: list_contains(label, x))) / len(p) end end) as precision, avg(case when ok then case when lp then (len(p) = 0)::int else len(list_filter(l, lambda x: list_contains(pred, x))) / nullif(len(l), 0) end end) as recall from r group by role""",
)
def macro_precision_recall(spark, d):
    p, l = F.col("pred"), F.col("label")  # noqa: E741
    return pairs(spark, d).groupBy("role").agg(M.precision(p, l, PAD, UNK).alias("precision"), M.recall(p, l, PAD, UNK).alias("recall"))


@query("micro_prf", f"with {_COUNTED}, s as (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from c), q as (select *, {_PRF} from s) select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from q")
def micro_prf(spark, d):
    return M.micro(pairs(spark, d), pad=PAD, unk=UNK)


@query("macro_f1", f"with {_COUNTED}, q as (select *, {_PRF} from c) select role, avg(precision) as precision, avg(recall) as recall, avg(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)) as f1 from q group by role")
def macro_f1(spark, d):
    return M.macro(pairs(spark, d), "role", pad=PAD, unk=UNK)


@query("per_language_rollup", f"with {_COUNTED}, s as (select role, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from c group by rollup (role)), q as (select *, {_PRF} from s) select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from q")
def per_language_rollup(spark, d):
    """Each group's figures and the total in one pass."""
    return M.micro(pairs(spark, d), "role", pad=PAD, unk=UNK, rollup=True)


@query("joined_prf", f"with {_COUNTED.replace('p = l', chr(40) + 'p = l or array_to_string(p, ' + chr(39) * 2 + ') = array_to_string(l, ' + chr(39) * 2 + '))')} select role, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from c group by role")
def joined_prf(spark, d):
    """Parts that spell the same word together count as equal."""
    return M.micro(pairs(spark, d), "role", pad=PAD, unk=UNK, joined=True).select("role", "tp", "fp", "fn")


@query("same_name", "select l_shipdate::date as day, count(*) as n, count(*) filter (where a = b or list_sort(list_distinct(a)) = list_sort(list_distinct(b)) or array_to_string(a, '') = array_to_string(b, '')) as same from (select l_shipdate, [l_returnflag, l_linestatus] as a, [l_linestatus, case when l_linenumber % 2 = 0 then l_returnflag else 'F' end] as b from lineitem) group by 1")
def same_name(spark, d):
    rows = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.array("l_returnflag", "l_linestatus").alias("a"), F.array("l_linestatus", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise("F")).alias("b"))
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.count_if(M.same_name(F.col("a"), F.col("b"))).alias("same"))


@query("rouge_2", "with t as (select conv_id, turn, string_split(lower(text), ' ') as ws from conversations), p as (select a.conv_id, a.turn, list_distinct(list_transform(range(1, len(a.ws)), lambda i: a.ws[i] || ' ' || a.ws[i + 1])) as x, list_distinct(list_transform(range(1, len(b.ws)), lambda i: b.ws[i] || ' ' || b.ws[i + 1])) as y from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1), s as (select conv_id, turn, coalesce(len(list_intersect(x, y)) / nullif(len(x), 0), 0)::double as p, coalesce(len(list_intersect(x, y)) / nullif(len(y), 0), 0)::double as r from p) select conv_id, turn, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) as f from s")
def rouge_2(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("ws"))
    both = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ws").alias("label")), ["conv_id", "turn"])
    return both.select("conv_id", "turn", M.rouge_n(F.col("ws"), F.col("label"), 2).alias("s")).select("conv_id", "turn", "s.p", "s.r", "s.f")


@query("rouge_l")
def rouge_l(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("ws"))
    both = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ws").alias("label")), ["conv_id", "turn"])
    return both.select("conv_id", "turn", M.rouge_l(F.col("ws"), F.col("label")).alias("s")).select("conv_id", "turn", "s.p", "s.r", "s.f")


@query("rouge_1", "with t as (select conv_id, turn, list_distinct(string_split(lower(text), ' ')) as ws from conversations), s as (select a.conv_id, a.turn, len(list_intersect(a.ws, b.ws)) / len(a.ws)::double as p, len(list_intersect(a.ws, b.ws)) / len(b.ws)::double as r from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1) select conv_id, turn, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) as f from s")
def rouge_1(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("ws"))
    both = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ws").alias("label")), ["conv_id", "turn"])
    return both.select("conv_id", "turn", M.rouge_1(F.col("ws"), F.col("label")).alias("s")).select("conv_id", "turn", "s.p", "s.r", "s.f")


@query(
    "bleu",
    """with t as (select conv_id, turn, string_split(lower(text), ' ') as ws from conversations),
    p as (select b.conv_id, b.turn, b.ws as c, a.ws as r1, z.ws as r2 from t b join t a on a.conv_id = b.conv_id and a.turn = b.turn - 1 left join t z on z.conv_id = b.conv_id and z.turn = b.turn - 2),
    s as (select conv_id, turn, -1 as side, c as w from p union all select conv_id, turn, 0, r1 from p union all select conv_id, turn, 1, r2 from p where r2 is not null),
    g as (select conv_id, turn, side, o, array_to_string(list_slice(w, i, i + o - 1), ' ') as gram from (select *, unnest(range(1, len(w) - o + 2)) as i from s, (select unnest(range(1, 5))::int as o) where len(w) >= o)),
    n as (select conv_id, turn, o, gram, side, count(*) as n from g group by all),
    m as (select o, least(coalesce(max(n) filter (where side < 0), 0), coalesce(max(n) filter (where side >= 0), 0)) as hit, coalesce(max(n) filter (where side < 0), 0) as c from n group by conv_id, turn, o, gram),
    q as (select o as "order", sum(hit)::bigint as matches, sum(c)::bigint as total, sum(hit) / sum(c) as precision from m group by o),
    l as (select sum(len(c)) as c, sum(case when r2 is null or (abs(len(r1) - len(c)), len(r1)) <= (abs(len(r2) - len(c)), len(r2)) then len(r1) else len(r2) end) as r from p)
    select q.*, case when c >= r then 1 else exp(1 - r / c) end as brevity_penalty, case when c >= r then 1 else exp(1 - r / c) end * case when min(precision) over () > 0 then exp(avg(ln(case when precision > 0 then precision end)) over ()) else 0 end as bleu from q, l""",
)
def bleu(spark, d):
    """Each turn as a candidate for what the one and the two turns before it say."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("ws"))
    one, two = (t.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("ws").alias(f"r{k}")) for k in (1, 2))
    rows = t.join(one, ["conv_id", "turn"]).join(two, ["conv_id", "turn"], "left")
    rows = rows.select(F.struct("conv_id", "turn").alias("key"), F.filter(F.array("r1", "r2"), lambda w: w.isNotNull()).alias("references"), F.col("ws").alias("candidate"))
    return M.bleu(rows, "key")


@query("rouge_empty", "with t as (select l_returnflag as role, case p_size % 4 when 0 then ['EMPTY'] when 1 then list_distinct(string_split(p_name, ' ')) when 2 then list_distinct(string_split(p_name || ' ' || p_type, ' ')) else list_distinct(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')) end as ws, ['EMPTY', 'red', 'widget'] as label from lineitem join part on l_partkey = p_partkey) select role, avg(len(list_intersect(ws, label)) / len(ws)::double) as p, avg(len(list_intersect(ws, label)) / 3.0::double) as r from t group by role")
def rouge_empty(spark, d):
    """Names without parts count as the word EMPTY."""
    name = F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 4 >= 2, F.col("p_type")), F.when(F.col("p_size") % 4 == 3, F.col("p_brand")))
    words = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.split(name, " "))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), words.alias("ws"))
    rows = table(spark, d, "lineitem").join(parts, "l_partkey").select(F.col("l_returnflag").alias("role"), M.rouge_1(F.col("ws"), F.array(*map(F.lit, ("EMPTY", "red", "widget")))).alias("s"))
    return rows.groupBy("role").agg(F.avg("s.p").alias("p"), F.avg("s.r").alias("r"))


@query(
    "metric_registry",
    f"""with {_COUNTED},
    s as (select role, sum(tp)::double as tp, sum(fp) as fp, sum(fn) as fn, avg(case when {_PART} then ({_EXACT})::int end) as top1 from c group by role)
    select role, 'micro_precision' as name, tp / (tp + fp) as value from s union all select role, 'micro_recall', tp / (tp + fn) from s union all select role, 'top1_accuracy', top1 from s""",
)
def metric_registry(spark, d):
    """Metrics called by their names, in one pass, as (role, name, value)."""
    names = ("micro_precision", "micro_recall", "top1_accuracy")
    row = pairs(spark, d).groupBy("role").agg(*(M.metric(n, F.col("pred"), F.col("label"), PAD, UNK).cast("double").alias(n) for n in names))
    return row.select("role", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names))).alias("x")).select("role", "x.name", "x.value")


@query("binary_prf", "with c as (select count(*) filter (where quality = 1 and toxic = 1) as tp, count(*) filter (where quality = 1 and toxic = 0) as fp, count(*) filter (where quality = 0 and toxic = 1) as fn from labels), q as (select *, coalesce(tp / nullif(tp + fp, 0), 0)::double as precision, coalesce(tp / nullif(tp + fn, 0), 0)::double as recall from c) select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from q")
def binary_prf(spark, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    c = table(spark, d, "labels").agg(F.count_if(q & t).alias("tp"), F.count_if(q & ~t).alias("fp"), F.count_if(~q & t).alias("fn"))
    p, r, f = M.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


@query("best_non_unk", "select conv_id, turn, token, score from (select conv_id, turn, case when starts_with(word, 'th') then '<unk>' else word end as token, length(word)::int as score from (select conv_id, turn, unnest(string_split(lower(text), ' ')) as word from conversations)) qualify row_number() over (partition by conv_id, turn order by token = '<unk>', score desc, token) = 1")
def best_non_unk(spark, d):
    """The longest word of each turn that isn't unknown; an unknown one only where there is no other."""
    w = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    scored = w.select("conv_id", "turn", F.when(F.col("word").startswith("th"), UNK).otherwise(F.col("word")).alias("token"), F.length("word").alias("score"))
    return M.best_known(scored, "conv_id", "turn", unk=UNK)


@query("topk_per_group", "select l_orderkey, l_partkey, l_suppkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey, l_suppkey, l_linenumber) as r from lineitem) where r <= 2")
def topk_per_group(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc(), "l_partkey", "l_suppkey", "l_linenumber")
    return table(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 2").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


@query("hit_at_k", "select k, count(*) filter (where r <= k) as hits, count(*) as n from (select doc_id, case when list_position(ws, 'the') = 0 or list_position(ws, 'the') is null then 1000000 else list_position(ws, 'the') end as r from (select doc_id, string_split(lower(text), ' ') as ws from documents)) cross join (select unnest([1, 5, 10]) as k) group by k")
def hit_at_k(spark, d):
    """Rank of the true answer in each list, accumulated."""
    r = table(spark, d, "documents").select(F.array_position(F.split(F.lower("text"), " "), "the").alias("r"))
    hits = r.agg(F.count("*").alias("n"), *(F.count_if((F.col("r") > 0) & (F.col("r") <= k)).alias(f"k{k}") for k in (1, 5, 10)))
    return hits.select("n", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("hits")) for k in (1, 5, 10)))).alias("x")).select("x.k", "x.hits", "n")


@query("pointer_probability", "select conv_id, turn, word, sum(p) as p from (select conv_id, turn, unnest(string_split(lower(text), ' ')) as word, 1.0::double / len(string_split(text, ' ')) as p from conversations) group by 1, 2, 3")
def pointer_probability(spark, d):
    """Attention over positions summed per vocabulary word."""
    w = F.split(F.lower("text"), " ")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.explode(w).alias("word"), (F.lit(1.0) / F.size(w)).alias("p"))
    return rows.groupBy("conv_id", "turn", "word").agg(F.sum("p").alias("p"))


@query("label_smoothing", "select vec_id, -(0.9::double * hit + 0.1::double / (len(e) - 1) * (every - hit)) as loss from (select vec_id, e, e[1 + label % len(e)]::double - z as hit, list_sum(e::double[]) - len(e) * z as every from (select vec_id, label, embedding as e, ln(list_sum(list_transform(embedding::double[], lambda x: exp(x)))) as z from embeddings))")
def label_smoothing(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", e.alias("e"), F.col("label"))
    return rows.select("vec_id", M.smoothed_loss(F.col("e"), (F.col("label") % F.size("e")).cast("int"), 0.1).alias("loss"))


@query("positional_encoding", "select k::int as k, x::int as x, case when k < 4 then sin(x / pow(10000, 2 * k / 8.0)) else cos(x / pow(10000, 2 * (k - 4) / 8.0)) end as v from (select unnest(range(8)) as k) cross join (select distinct l_linenumber - 3 as x from lineitem)")
def positional_encoding(spark, d):
    """Sines, then cosines, of places at geometric wave lengths."""
    x = table(spark, d, "lineitem").select((F.col("l_linenumber") - 3).alias("x")).distinct()
    angle = lambda f: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: f(F.col("x") / F.pow(F.lit(10000.0), 2 * k / 8)))
    return x.select("x", F.posexplode(F.concat(angle(F.sin), angle(F.cos))).alias("k", "v")).select(F.col("k").cast("int").alias("k"), "x", "v")


@query(
    "area_bins",
    """with x as (select distinct l_returnflag as flag, l_quantity as x from lineitem), a as (select *, sum(sqrt(x - p)) over (partition by flag order by x) as area from (select *, coalesce(lag(x) over (partition by flag order by x), x) as p from x)),
    b as (select *, lead(x) over (partition by flag order by x) as nx, lead(area) over (partition by flag order by x) as na, max(area) over (partition by flag) as total from a)
    select flag, k::int as k, case when nx is null then x else x + (k * total / 8 - area) / (na - area) * (nx - x) end as edge from b cross join (select unnest(range(9)) as k) where (k < 8 and k * total / 8 >= area and k * total / 8 < na) or (nx is null and (k = 8 or total = 0))""",
)
def area_bins(spark, d):
    return B.area_edges_of(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag"), "flag", "l_quantity", 8)


@query(
    "count_bins",
    """with x as (select l_returnflag as flag, l_quantity as x, row_number() over (partition by l_returnflag order by l_quantity) - 1 as rn, count(*) over (partition by l_returnflag) as n, lead(l_quantity) over (partition by l_returnflag order by l_quantity) as nx from lineitem)
    select flag, k::int as k, case when nx is null then x else x + (k * n / 8.0 - rn) * (nx - x) end as edge from x cross join (select unnest(range(9)) as k) where rn = least(floor(k * n / 8.0), n - 1)""",
)
def count_bins(spark, d):
    """Edges with equal numbers of values between them."""
    return B.count_edges_of(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag"), "flag", "l_quantity", 8)


@query(
    "bin_assign_cont",
    """with x as (select distinct l_returnflag as flag, l_quantity as x from lineitem), a as (select *, sum(sqrt(x - p)) over (partition by flag order by x) as area from (select *, coalesce(lag(x) over (partition by flag order by x), x) as p from x)),
    b as (select *, lead(x) over (partition by flag order by x) as nx, lead(area) over (partition by flag order by x) as na, max(area) over (partition by flag) as total from a),
    e as (select flag, case when nx is null then x else x + (k * total / 8 - area) / (na - area) * (nx - x) end as edge from b cross join (select unnest(range(9)) as k) where (k < 8 and k * total / 8 >= area and k * total / 8 < na) or (nx is null and (k = 8 or total = 0)))
    select flag, bin, count(*) as n from (select l.rowid, l_returnflag as flag, count(*) filter (where edge < l_quantity - 0.25) as bin from (select *, row_number() over () as rowid from lineitem) l join e on e.flag = l.l_returnflag group by 1, 2) group by 1, 2""",
)
def bin_assign_cont(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity"), (F.col("l_quantity") - 0.25).alias("q"))
    edges = B.area_edges_of(rows, "flag", "l_quantity", 8)
    return B.bins_of(rows, edges, "flag", "q").groupBy("flag", F.col("bin").cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@query(
    "distance_bins",
    f"""{_TREE_METRICS},
    v as (select sample_id, metric, value as v, count(*) as c from dist where abs(value) < 1000 group by all),
    g as (select *, count(*) over gr as distinct_n, min(v) over gr as least, sum(case when v < -1 or v >= 2 then c else 0 end) over gr as outside from v window gr as (partition by sample_id, metric)),
    s as (select *, case when distinct_n + 1 < 8 then 'few' when least >= 0 then case when v > 3 then 'tail' end when v < -1 then 'below' when v >= 2 then 'above' end as side from g),
    x as (select *, (case side when 'below' then -v else v end)::double as x from s where side is not null),
    a as (select *, sum(sqrt(x - p)) over w as area, lead(x) over w as nx from (select *, coalesce(lag(x) over w, x) as p from x window w as (partition by sample_id, metric, side order by x)) window w as (partition by sample_id, metric, side order by x)),
    t as (select *, lead(area) over (partition by sample_id, metric, side order by x) as na, max(area) over ws as total, case side when 'tail' then 3 when 'below' then floor(sum(c) over ws * 4 / outside) when 'above' then ceil(sum(c) over ws * 4 / outside) end::int as parts from a window ws as (partition by sample_id, metric, side)),
    j as (select *, unnest(range(case side when 'tail' then 0 else 1 end, parts + 1)) as j from t where side <> 'few' and parts >= 1),
    q as (select *, case when j = parts then total when side = 'tail' then j * total / parts else total * (pow(1.3, j) - 1) / (pow(1.3, parts) - 1) end as at_ from j),
    e as (select sample_id, metric, case side when 'below' then -1 else 1 end * case when nx is null then x else x + (at_ - area) / (na - area) * (nx - x) end as edge from q where at_ >= area and (nx is null or at_ < na)
      union all select sample_id, metric, x from t where side = 'few' union all select sample_id, metric, (case when least >= 0 then 0 else -1 end + k)::double from (select distinct sample_id, metric, least from g where distinct_n + 1 >= 8), (select unnest(range(3)) as k)),
    o as (select sample_id, metric, list(edge::float order by edge) as edges from e group by all),
    b as (select d.*, edges, case when abs(value) >= 1000 then 0 when value < 0 then len(list_filter(edges, lambda z: z < 0 and z <= value::float)) else len(list_filter(edges, lambda z: z < 0 or z < value::float)) + 1 end::int as bin from dist d left join o using (sample_id, metric))
    select sample_id, metric, bin, case when bin = 0 then 10000.0 else edges[bin]::double end as edge, count(*) as pairs from b group by all""",
)
def distance_bins(spark, d):
    """Ancestor, sibling and shortest-path distances in 8 bins, three of them around zero, the others growing away from it."""
    return B.binned_distances(tree_metrics(spark, d), 8, 3, 1.3).groupBy("sample_id", "metric", "bin", "edge").agg(F.count("*").alias("pairs"))


@query("ppr_bins")
def ppr_bins(spark, d):
    from thicket.operators import tree as T

    dist = T.pagerank_distances(nodes(spark, d), threshold=0.0067).withColumn("metric", F.lit("ppr"))
    return B.binned(dist.select("sample_id", "metric", "i", "j", "value"), 8, discrete=False)
