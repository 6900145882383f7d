"""Queries over dataset views. Samples are the turns of conversations, tokens their words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators import lexemes as L
from thicket.operators import views as V
from thicket.plans.registry import hashed as _hashed
from thicket.plans.registry import query, table
from thicket.plans.registry import uniform as _uniform

_TOKENS = "t as (select conv_id * 100 + turn as sample_id, unnest(range(len(string_split(text, ' '))))::int as pos, unnest(string_split(text, ' ')) as word from conversations)"


def turns(spark, d: str) -> DataFrame:
    return table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("sample_id"), "conv_id", "turn", "role", F.split("text", " ").alias("words"))


def tokens(spark, d: str) -> DataFrame:
    return turns(spark, d).select("sample_id", F.posexplode("words").alias("pos", "word"))


def dealt_tokens(spark, d: str) -> DataFrame:
    """The same, in partitions by sample that follow the bytes of the texts."""
    t = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("sample_id"), "text")
    return L.dealt(t, "text").select("sample_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))


@query("token_limit", "select sample_id, n from (select conv_id * 100 + turn as sample_id, len(string_split(text, ' ')) as n, string_split(text, ' ') as ws from conversations) where n <= 30 and not list_contains(ws, 'is')")
def token_limit(spark, d):
    """Samples within the limit and without an error token (here: the word "is")."""
    t = turns(spark, d).withColumn("tokens", F.transform("words", lambda w: F.struct(w.alias("text"), F.when(w == "is", "Token.Error").otherwise("Token.Name").alias("token_type"))))
    return V.within_limit(t, limit=30).select("sample_id", F.size("tokens").cast("bigint").alias("n"))


@query("oversample_det", "select lang, sum(case lang when 'en' then 1 when 'fr' then 2 else 3 end)::bigint as n from documents group by lang")
def oversample_det(spark, d):
    """Languages repeated by whole factors."""
    factors = spark.createDataFrame([("en", 1.0), ("fr", 2.0), ("de", 3.0), ("es", 3.0)], "lang string, factor double")
    return V.oversampled(table(spark, d, "documents").select("doc_id", "lang"), factors, "lang", 7, "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@query("oversample_fraction", f"with n as (select lang, count(*) as n, sqrt(max(count(*)) over () / count(*)) as factor from documents group by lang), d as (select lang, factor, {_uniform(7, 'doc_id')} as u from documents join n using (lang)) select lang, sum(floor(factor)::bigint + (u < factor - floor(factor))::int)::bigint as n from d group by lang")
def oversample_fraction(spark, d):
    """Factors by the imbalance of languages, with a seeded coin for the fraction."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    n = docs.groupBy("lang").agg(F.count("*").alias("n"))
    factors = n.select("lang", F.sqrt(F.max("n").over(Window.partitionBy()) / F.col("n")).alias("factor"))  # a row for each language
    return V.oversampled(docs, factors, "lang", 7, "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@query("batch_assign", "select role, conv_id, turn, (((row_number() over (partition by role order by conv_id, turn)) - 1) // 8)::int as batch from conversations")
def batch_assign(spark, d):
    return V.batches(table(spark, d, "conversations").select("role", "conv_id", "turn"), "role", 8, "conv_id", "turn")


@query("batch_padding", "with b as (select role, conv_id, turn, len(string_split(text, ' ')) as n, (((row_number() over (partition by role order by conv_id, turn)) - 1) // 8)::int as batch from conversations) select role, conv_id, turn, (max(n) over (partition by role, batch))::bigint as width, ((max(n) over (partition by role, batch)) - n)::bigint as padding from b")
def batch_padding(spark, d):
    """Each batch is padded to its longest sample."""
    rows = V.batches(turns(spark, d), "role", 8, "conv_id", "turn").withColumn("batch_key", F.concat_ws("-", "role", "batch"))
    out = V.padded_to_batch(rows, "batch_key", "words", F.lit("</s>"))
    return out.select("role", "conv_id", "turn", F.size("words").cast("bigint").alias("width"), F.aggregate("pad_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("padding"))


@query("accumulate_window", "select role, win::int as win, count(*) as samples, sum(n)::bigint as tokens from (select role, n, coalesce(sum(n) over (partition by role order by conv_id, turn rows between unbounded preceding and 1 preceding), 0) // 500 as win from (select role, conv_id, turn, len(string_split(text, ' ')) as n from conversations)) group by 1, 2")
def accumulate_window(spark, d):
    """Windows of samples of about 500 tokens."""
    t = turns(spark, d).withColumn("n", F.size("words").cast("bigint"))
    out = V.accumulated(t, "role", "n", 500, "conv_id", "turn")
    return out.groupBy("role", F.col("window").alias("win")).agg(F.count("*").alias("samples"), F.sum("n").alias("tokens"))


@query("chunk_shuffle", f"with t as (select role, conv_id * 100 + turn as sample_id, len(string_split(text, ' '))::int as n from conversations), c as (select *, ((row_number() over (partition by role order by n + {_uniform(5, 'sample_id')}, sample_id) - 1) // 16)::int as chunk, row_number() over (partition by role order by n + {_uniform(5, 'sample_id')}, sample_id) as rn from t) select role, sample_id, n, chunk, (row_number() over (partition by role order by {_uniform(5, 'chunk')}, chunk, rn) - 1)::int as place from c")
def chunk_shuffle(spark, d):
    """Samples sorted by length, in chunks, the chunks in a seeded order."""
    t = turns(spark, d).withColumn("n", F.size("words"))
    return V.chunk_shuffled(t, "role", "n", 16, 5, "sample_id").select("role", "sample_id", "n", "chunk", "place")


@query("sort_by_length", "select conv_id, turn, len(string_split(text, ' '))::bigint as n from conversations order by n, conv_id, turn limit 100")
def sort_by_length(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.size("words").cast("bigint").alias("n")).orderBy("n", "conv_id", "turn").limit(100)


@query("token_offsets", f"with {_TOKENS} select sample_id, pos, coalesce(sum(length(word)) over (partition by sample_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as offs from t")
def token_offsets(spark, d):
    """Flat position of each token's first part."""
    t = tokens(spark, d).withColumn("n", F.length("word").cast("bigint"))
    return V.with_offsets(t, "sample_id", "pos", "n").select("sample_id", "pos", F.col("offset").alias("offs"))


@query("drop_punctuation", f"with {_TOKENS} select sample_id, ((row_number() over (partition by sample_id order by pos)) - 1)::int as new_pos, word from t where regexp_matches(word, '[A-Za-z]') or contains(word, '_') or word = '<unk>'")
def drop_punctuation(spark, d):
    return V.without_punctuation(tokens(spark, d)).select("sample_id", "new_pos", "word")


@query(
    "label_position",
    "with s as (select conv_id * 100 + turn as sample_id, string_split(text, ' ') as ws from conversations), p as (select sample_id, ws, list_filter(range(1, len(ws)), lambda i: ws[i] = ws[3] and ws[i + 1] = ws[4]) as hits from s where len(ws) >= 4) select sample_id, (hits[1] - 1)::int as at, array_to_string(list_concat(list_concat(ws[1:hits[1] - 1], ['[CLS_10]']), ws[hits[1] + 2:len(ws)]), ' ') as masked from p",
)
def label_position(spark, d):
    """The first place of a two-part label in its sample, and the sample with it masked."""
    t = turns(spark, d).where(F.size("words") >= 4).withColumn("label", F.slice("words", 3, 2))
    t = t.withColumn("at", V.label_position(F.col("words"), F.col("label")))
    return t.select("sample_id", "at", F.array_join(V.masked_label(F.col("words"), F.col("at"), F.size("label")), " ").alias("masked"))


@query("with_cls", "select conv_id * 100 + turn as sample_id, '[CLS_1] [CLS_2] [CLS_3] [CLS_4] [CLS_5] ' || text as tokens from conversations")
def with_cls(spark, d):
    return turns(spark, d).select("sample_id", F.array_join(V.with_cls(F.col("words")), " ").alias("tokens"))


@query("pad_mask", "select conv_id, turn, repeat('1', n) || repeat('0', width - n) as mask from (select conv_id, turn, len(string_split(text, ' ')) as n, max(len(string_split(text, ' '))) over (partition by conv_id) as width from conversations)")
def pad_mask(spark, d):
    """The turns of a conversation are a batch: every position of it, as wide as the longest turn."""
    n = turns(spark, d).select("conv_id", "turn", F.size("words").alias("n")).withColumn("width", F.max("n").over(Window.partitionBy("conv_id")))
    return n.select("conv_id", "turn", F.array_join(V.pad_mask(F.col("n"), F.col("width")), "").alias("mask"))


@query(
    "perm_mask",
    f"""with {_TOKENS}, s as (select sample_id, pos, case when pos = 0 then 4 when pos % 9 = 5 then 5 else 30 + length(word) end as token, pos % 4 = 1 as target, (pos * 7 + 3) % 31 as perm from t),
    r as (select *, target or token in (4, 5) as hidden, case when target or token in (4, 5) then perm else -1 end as rev from s), o as (select *, case when target then rev else rev + 1 end as own from r)
    select a.sample_id, a.pos as i, string_agg((a.own <= b.rev and b.hidden)::int::varchar, '' order by b.pos) as mask from o a join o b using (sample_id) group by 1, 2""",
)
def perm_mask(spark, d):
    """The mask of every position of every turn, a text of 0 and 1 over the positions it may not attend."""
    token = lambda w, pos: F.struct(F.when(pos == 0, 4).when(pos % 9 == 5, 5).otherwise(30 + F.length(w)).alias("token"), (pos % 4 == 1).alias("is_target"), ((pos * 7 + 3) % 31).alias("perm"))
    masks = V.permutation_mask(turns(spark, d).select("sample_id", F.transform("words", token).alias("tokens"))).select("sample_id", F.posexplode("blocked").alias("i", "mask"))
    return masks.select("sample_id", "i", F.array_join("mask", "").alias("mask"))


@query("long_enough", "select conv_id, turn from conversations where len(string_split(text, ' ')) >= 12 and len(string_split(role, 's')) >= 2")
def long_enough(spark, d):
    """Samples of twelve words and more with a label of two parts and more."""
    return V.long_enough(turns(spark, d).withColumn("label", F.split("role", "s")), "words", 12, "label", 2).select("conv_id", "turn")


@query("lm_without_punctuation", f"with {_TOKENS}, k as (select sample_id, ((row_number() over (partition by sample_id order by pos)) - 1)::int as new_pos, word from t where regexp_matches(word, '[A-Za-z]') or contains(word, '_') or word = '<unk>') select sample_id, string_agg(word, ' ' order by new_pos) as words from k group by 1 having count(*) >= 5")
def lm_without_punctuation(spark, d):
    """Turns without punctuation as samples of a language model: those of five words and more."""
    kept = V.without_punctuation(tokens(spark, d)).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("new_pos", "word"))).alias("x"))
    return V.long_enough(kept.select("sample_id", F.col("x.word").alias("words")), "words", 5).select("sample_id", F.array_join("words", " ").alias("words"))


@query("attention_view", "with s as (select conv_id, turn, len(string_split(text, ' '))::int as n from conversations), w as (select conv_id, turn, n, max(n) over (partition by conv_id) as width, 5 + turn % 3 as place from s) select conv_id, turn, 'blocked' as kind, unnest(range(n, width))::int as i from w union all select conv_id, turn, 'target', unnest(list_distinct([0, 1, 2, 3, 4, place]))::int from w")
def attention_view(spark, d):
    """The turns of a conversation are a batch: which positions are padding, and which are targets."""
    n = turns(spark, d).select("conv_id", "turn", F.size("words").alias("n"), (5 + F.col("turn") % 3).cast("int").alias("at"))
    n = n.withColumn("width", F.max("n").over(Window.partitionBy("conv_id"))).withColumn("sample_id", F.struct("conv_id", "turn"))
    return V.attention_view(n).select("sample_id.conv_id", "sample_id.turn", "kind", "i")


@query("reservoir_sample", f"select day, l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by day order by {_hashed(3, 'day', 'l_orderkey', 'l_linenumber', 'l_partkey')}, l_orderkey, l_linenumber, l_partkey) as r from (select l_shipdate::date as day, l_orderkey, l_linenumber, l_partkey from lineitem)) where r <= 10")
def reservoir_sample(spark, d):
    """At most ten lines of each day, by hash."""
    rows = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", "l_partkey")
    return V.reservoir(rows, "day", 10, 3, "l_orderkey", "l_linenumber", "l_partkey")


@query("lm_view", f"with {_TOKENS}, r as (select *, row_number() over (partition by sample_id order by {_hashed(11, 'sample_id', 'pos')}, pos) <= 5 as is_target, (row_number() over (partition by sample_id order by {_hashed(12, 'sample_id', 'pos')}, pos) - 1)::int as perm from t) select sample_id, pos, is_target, perm, case when is_target then word end as label from r")
def lm_view(spark, d):
    """Five targets of each sample with their labels and a seeded permutation."""
    t = dealt_tokens(spark, d).withColumn("token", F.col("word"))
    return V.language_model_view(t, 5, 11).select("sample_id", "pos", "is_target", "perm", "label")


_PARTS = f"with {_TOKENS}, r as (select *, row_number() over (partition by sample_id order by {_hashed(11, 'sample_id', 'pos')}, pos) <= 5 as is_target, list_transform(regexp_extract_all(word, '.{{1,4}}'), lambda x, i: case when i % 3 = 0 then 3 else 10 * pos + length(x) end) as ids from t)"


def with_parts(spark, d: str) -> DataFrame:
    """Samples of a language model whose words have parts of four letters; every third part is padding."""
    part = lambda x, i: F.when(i % 3 == 2, 3).otherwise(10 * F.col("pos") + F.length(x)).cast("int")
    t = dealt_tokens(spark, d).withColumn("token", F.col("word"))
    return V.language_model_view(t, 5, 11).withColumn("ids", F.transform(F.regexp_extract_all("word", F.lit(".{1,4}"), F.lit(0)), part))


@query("pointer_ids", f"{_PARTS}, f as (select sample_id, pos, is_target, list_filter(ids, lambda x: x <> 3 and not is_target) as kept from r) select sample_id, coalesce(string_agg(array_to_string(kept, ' '), ' ' order by pos) filter (where len(kept) > 0), '') as ids from f group by sample_id")
def pointer_ids(spark, d):
    """What a pointer may point at: parts of tokens that aren't to be predicted."""
    out = V.pointer_view(with_parts(spark, d))[0]
    return out.select("sample_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("pointer_mask", f"{_PARTS} select sample_id, pos, array_to_string(list_transform(ids, lambda x: case when x <> 3 and not is_target then '1' else '0' end), '') as mask from r")
def pointer_mask(spark, d):
    out = V.pointer_view(with_parts(spark, d))[1]
    return out.select("sample_id", "pos", F.array_join(F.transform("mask", lambda x: x.cast("int").cast("string")), "").alias("mask"))


@query("target_sample", f"with {_TOKENS} select sample_id, n, pos from (select sample_id, pos, (count(*) over (partition by sample_id))::int as n, row_number() over (partition by sample_id order by {_hashed(3, 'sample_id', 'pos')}, pos) as r from t) where r <= 5")
def target_sample(spark, d):
    n = turns(spark, d).select("sample_id", F.size("words").alias("n"))
    return V.sampled_positions(n, "sample_id", 5, 3)


@query("hash_split", f"select case when {_uniform(1, 'doc_id')} < 0.8 then 'train' else 'valid' end as partition, count(*) as n from documents group by 1")
def hash_split(spark, d):
    return V.split_by_hash(table(spark, d, "documents").select("doc_id", "source"), 0.8, 1, "doc_id").groupBy("partition").agg(F.count("*").alias("n"))


@query(
    "early_stopping",
    """with s as (select c_nationkey as run, c_custkey as step, c_acctbal as score from customer), b as (select *, max(score) over (partition by run order by step) as best, row_number() over (partition by run order by step) as rn from s),
    n as (select *, max(case when prev is null or prev < best then rn end) over (partition by run order by step) as hit from (select *, lag(best) over (partition by run order by step) as prev from b))
    select run, step, score, best, rn - hit as waited, rn - hit >= 5 as stop, rank() over (partition by run order by score desc) as snapshot_rank from n""",
)
def early_stopping(spark, d):
    s = table(spark, d, "customer").select(F.col("c_nationkey").alias("run"), F.col("c_custkey").alias("step"), F.col("c_acctbal").alias("score"))
    out = V.best_so_far(s, "run", "step", "score", 5)
    return out.withColumn("waited", F.col("waited").cast("bigint")).withColumn("snapshot_rank", F.col("snapshot_rank").cast("bigint"))


@query("batch_select", "select vec_id, embedding[1]::double as a, embedding[1 + label % 8]::double as b from embeddings")
def batch_select(spark, d):
    """Elements of an array by an array of indices."""
    picked = F.transform(F.array(F.lit(0), F.col("label") % 8), lambda i: F.element_at("embedding", (i + 1).cast("int")).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", picked.alias("x")).select("vec_id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))


@query("per_language_metrics", "select role, avg(len(string_split(text, ' '))) as mean_tokens, max(len(string_split(text, ' '))) as most from conversations group by rollup (role)")
def per_language_metrics(spark, d):
    n = F.size(F.split("text", " ")).cast("bigint")
    return table(spark, d, "conversations").select("role", n.alias("n")).rollup("role").agg(F.avg("n").alias("mean_tokens"), F.max("n").alias("most"))


@query("summarisation_view")
def summarisation_view(spark, d):
    """Samples with two words as their label, masked, encoded, with pointers for unknown words."""
    from thicket.plans.vocab import small_vocab

    t = turns(spark, d).where(F.size("words") >= 4).withColumn("label", F.slice("words", 3, 2))
    return V.summarisation_view(t.select("sample_id", "words", "label"), small_vocab(spark, d), 1000)
