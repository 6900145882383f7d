"""Queries over corpus statistics and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import normalize_word
from thicket.operators import vocab as V
from thicket.plans.registry import query, table
from thicket.schema import SPECIAL_SYMBOLS

_SPECIALS = ", ".join(f"'{s.lower()}'" for s in SPECIAL_SYMBOLS)
_WORD = "lower(trim(w, ' ' || chr(9) || chr(13)))"
_WORDS = "w as (select doc_id, lang, source, unnest(string_split(text, ' ')) as w from documents)"
_COUNTS = f"{_WORDS}, c as (select {_WORD} as word, count(*) as cnt from w where {_WORD} <> '' group by 1)"
_VOCAB = f"{_COUNTS}, v as (select word, cnt, ((row_number() over (order by cnt desc, word)) - 1 + 24)::int as id from c where cnt >= 5 and word not in ({_SPECIALS}) qualify id < 1000)"


def words(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", " ")).alias("pos", "word"))


def small_vocab(spark, d: str) -> DataFrame:
    return V.vocabulary(V.counts(words(spark, d)), limit=1000, min_frequency=5)


@query("vocab_topk", f"with {_VOCAB} select id, word, cnt from v")
def vocab_topk(spark, d):
    return small_vocab(spark, d)


@query("word_counts", f"with {_COUNTS} select word, cnt from c")
def word_counts(spark, d):
    return V.counts(words(spark, d))


@query(
    "counter_multi",
    f"""with {_WORDS} select kind, word, count(*) as cnt from (
    select 'token' as kind, {_WORD} as word from w union all select 'lang', lang from documents union all select 'source', source from documents) where word <> '' group by kind, word""",
)
def counter_multi(spark, d):
    return V.counts_of_kinds(table(spark, d, "documents"), {"token": F.split("text", " "), "lang": F.array("lang"), "source": F.array("source")})


@query(
    "counter_labels",
    "select word, count(*) as cnt from (select unnest(string_split(lower(p_type), ' ')) as word from part) group by word",
)
def counter_labels(spark, d):
    return V.counts(table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("word")))


@query("counter_merge_any", f"with {_WORDS}, c as (select lang, {_WORD} as word, count(*) as cnt from w where {_WORD} <> '' group by 1, 2) select word, sum(cnt)::bigint as cnt from c group by word having max(cnt) > 20")
def counter_merge_any(spark, d):
    return V.combined_counts(V.counts(words(spark, d), "word", "lang"), 20)


@query(
    "counter_pivot",
    f"""with {_WORDS}, c as (select {_WORD} as word, lang from w) select word, count(*) filter (where lang = 'en') as en, count(*) filter (where lang = 'de') as de, count(*) filter (where lang = 'fr') as fr, count(*) filter (where lang = 'es') as es from c where word <> '' group by word""",
)
def counter_pivot(spark, d):
    """Counters of several languages side by side, missing ones 0."""
    cnt = V.counts(words(spark, d), "word", "lang")
    return cnt.groupBy("word").agg(*(F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("cnt"))), F.lit(0)).alias(x) for x in ("en", "de", "fr", "es")))


@query("vocab_per_language", f"with {_WORDS}, c as (select lang, {_WORD} as word, count(*) as cnt from w where {_WORD} <> '' group by 1, 2) select lang, ((row_number() over (partition by lang order by cnt desc, word)) - 1 + 24)::int as id, word, cnt from c where cnt >= 3 and word not in ({_SPECIALS}) qualify id < 500")
def vocab_per_language(spark, d):
    return V.vocabulary(V.counts(words(spark, d), "word", "lang"), 500, 3, SPECIAL_SYMBOLS, "lang")


@query("vocab_reserved", f"with {_COUNTS} select ((row_number() over (order by cnt desc, word)) - 1 + 3)::int as id, word, cnt from c where cnt >= 1 qualify row_number() over (order by cnt desc, word) <= 200")
def vocab_reserved(spark, d):
    """Ids behind a reserved prefix of three symbols, by a histogram's top 200."""
    cnt = V.counts(words(spark, d)).orderBy(F.col("cnt").desc(), "word").limit(200)
    ids = F.row_number().over(Window.orderBy(F.col("cnt").desc(), "word")) - 1 + 3
    return cnt.select(ids.cast("int").alias("id"), "word", "cnt")


@query("histogram_topk", f"with {_COUNTS} select word, cnt from c order by cnt desc, word limit 100")
def histogram_topk(spark, d):
    return V.counts(words(spark, d)).orderBy(F.col("cnt").desc(), "word").limit(100)


@query("encode_left_join", f"with {_VOCAB} select doc_id, count(*) as n, count(*) filter (where v.id is null) as n_unk, sum(coalesce(v.id, 0))::bigint as id_sum from w left join v on {_WORD} = v.word group by doc_id")
def encode_left_join(spark, d):
    """Every word of every document looked up; unknown ones get 0."""
    coded = V.encode(words(spark, d), small_vocab(spark, d))
    return coded.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("id") == 0).alias("n_unk"), F.sum("id").cast("bigint").alias("id_sum"))


@query("encode_conversations", f"with {_VOCAB}, t as (select conv_id, turn, unnest(string_split(text, ' ')) as w, unnest(range(1, len(string_split(text, ' ')) + 1)) as p from conversations) select conv_id, turn, string_agg(coalesce(v.id, 0)::varchar, ' ' order by p) as ids from t left join v on {_WORD} = v.word group by conv_id, turn")
def encode_conversations(spark, d):
    """Texts as ids, in order."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    coded = V.encode(turns, small_vocab(spark, d)).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("x"))
    return coded.select("conv_id", "turn", F.array_join(F.transform("x", lambda x: x["id"].cast("string")), " ").alias("ids"))


@query("decode_ids", f"with {_VOCAB}, i as (select l_orderkey, l_linenumber, (l_partkey % 1200)::int as id from lineitem) select i.id, coalesce(v.word, case when i.id < 24 then ([{', '.join(chr(39) + s + chr(39) for s in SPECIAL_SYMBOLS)}])[i.id + 1] end, '<unk>') as decoded, count(*) as n from i left join v on i.id = v.id group by 1, 2")
def decode_ids(spark, d):
    ids = table(spark, d, "lineitem").select((F.col("l_partkey") % 1200).cast("int").alias("id"))
    return V.decode(ids, V.with_specials(small_vocab(spark, d))).groupBy("id", "decoded").agg(F.count("*").alias("n"))


@query("vocab_membership", f"with {_VOCAB} select doc_id, count(*) as n from w where {_WORD} in (select word from v) group by doc_id")
def vocab_membership(spark, d):
    known = small_vocab(spark, d).select(F.col("word").alias("key"))
    rows = words(spark, d).withColumn("key", normalize_word(F.col("word")))
    return rows.join(known, "key", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    "ext_vocab",
    f"with {_VOCAB}, t as (select conv_id, turn, unnest(string_split(text, ' ')) as w, unnest(range(len(string_split(text, ' ')))) as p from conversations), u as (select conv_id, turn, w as word, min(p) as f from t where {_WORD} not in (select word from v) group by 1, 2, 3) select conv_id, turn, word, ((row_number() over (partition by conv_id, turn order by f)) - 1 + 1000)::int as ext_id from u",
)
def ext_vocab(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("sample_id"), F.posexplode(F.split("text", " ")).alias("pos", "word"))
    out = V.extended_ids(V.encode(turns, small_vocab(spark, d)), 1000)
    return out.select("sample_id.conv_id", "sample_id.turn", "word", "ext_id")


@query(
    "pointer_resolve",
    f"""with {_VOCAB}, t as (select conv_id, turn, unnest(string_split(text, ' ')) as w, unnest(range(len(string_split(text, ' ')))) as p from conversations),
    e as (select conv_id, turn, word, (row_number() over (partition by conv_id, turn order by f)) - 1 + 1000 as ext_id from (select conv_id, turn, w as word, min(p) as f from t where {_WORD} not in (select word from v) group by 1, 2, 3))
    select t.conv_id, t.turn, t.p::int as pos, coalesce(v.id, e.ext_id, 0)::int as id from t left join v on {_WORD} = v.word left join e on e.conv_id = t.conv_id and e.turn = t.turn - 1 and e.word = t.w where t.turn > 0""",
)
def pointer_resolve(spark, d):
    """A turn is the label of the one before: its words as vocabulary id, else as pointer to the sample's unknown words, else unknown."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    coded = V.encode(turns, small_vocab(spark, d))
    ext = V.extended_ids(coded.withColumn("sample_id", F.struct("conv_id", "turn")), 1000)
    label = coded.where("turn > 0").withColumn("sample_id", F.struct("conv_id", (F.col("turn") - 1).alias("turn"))).join(ext, ["sample_id", "word"], "left")
    return label.select("conv_id", "turn", F.col("pos").cast("int").alias("pos"), F.when(F.col("id") > 0, F.col("id")).otherwise(F.coalesce("ext_id", F.lit(0))).cast("int").alias("id"))


@query("word_hist", "select source, min(n) as lo, max(n) as hi, sum(n)::bigint as total, count(*) as docs from (select source, len(string_split(text, ' ')) as n from documents) group by source")
def word_hist(spark, d):
    n = F.size(F.split("text", " ")).cast("bigint")
    return table(spark, d, "documents").select("source", n.alias("n")).groupBy("source").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n").alias("total"), F.count("*").alias("docs"))
