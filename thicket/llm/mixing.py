"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Sources in code point order (null last) take the weights in turn. Their targets share `share` of all words by
weight; a target stops at `most` times its source's words, and the excess goes to the others by weight
(water-filling, solved in closed form over the sorted sources).

A source's weight changes linearly over the training time 0..1, from weight * start to weight * end. Its integral, inverted,
tells when the source's demand reaches a number of words; a document that starts after so many words of its source's
sequence gets that time as its training position. The sequence of a source is the order of md5(doc_id), run
through as often as the target asks for; the last document taken may be taken in part, so a source's words
meet its rounded target.

Word counts are taken in one scan, and only (id, source, size, hash) are kept, in a table in the shared folder. The running
words of a source are sums in two levels: sums of hash ranges of some hundred thousand words, whose number
grows with the source, and a window within each range. So no task holds a source. Sources themselves are
one aggregated row each; Spark broadcasts their table only while it is below its own threshold.

Defined cases: a null text has size 0 and takes nothing; a null source is a source; a null doc_id is ordered first; rows
with the same id and size are interchangeable; sources of no words have target 0; extra columns are dropped;
an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm._store import written


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5
    most: float = 2.0
    #: Start and end of a source's weight, as multiples of it, taken in turn like the weights; their mean is 1.
    schedule: tuple[tuple[float, float], ...] = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
    range_words: int = 250_000


WORD = r"[^\x20\x09-\x0D]+"


def _turn(values, k):
    """values[k mod n] as a double."""
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (k % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """sizes (skey, source, source_size, ...) with target, weight, begin and end: one row for each source."""
    one = Window.partitionBy()
    out = sizes.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    out = out.withColumn("weight", _turn(p.weights, F.col("rank"))).withColumn("begin", _turn([a for a, _ in p.schedule], F.col("rank"))).withColumn("end", _turn([b for _, b in p.schedule], F.col("rank")))
    order = one.orderBy(F.col("source_size") / F.col("weight"), "rank")
    below = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    # the level if all sources before this one are full; it rises up to the first that isn't, then falls
    level = (F.lit(p.share) * F.sum("source_size").over(one) - F.lit(p.most) * below) / rest
    out = out.withColumn("level", level).withColumn("level", F.max("level").over(one))
    return out.withColumn("target", F.least(F.lit(p.most) * F.col("source_size"), F.col("weight") * F.col("level"))).drop("rank", "level")


def mixed(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, position (of its first use; null: not used)
    and before (words of its source before it in one run of the sequence)."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
    )
    rows = rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    rows = written(rows, "sizes")
    by_source = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = targets(by_source, p).withColumn("ranges", F.ceil((F.col("source_size") + 64 * F.col("docs")) / F.lit(p.range_words)))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    sources = sources.withColumn("times", times).withColumn("extra", F.round("target").cast("bigint") - F.col("times") * F.col("source_size"))
    sources = written(sources.drop("source", "docs", "weight"), "sources")
    place = F.floor(F.conv(F.substring("h", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48)) * F.col("ranges")).cast("bigint")
    placed = rows.join(sources, "skey").withColumn("range", place)
    sums = placed.groupBy("skey", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.select("skey", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base")), "ranges")
    within = Window.partitionBy("skey", "range").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(sums, ["skey", "range"]).withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = out.withColumn("taken", F.col("times") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("extra") - F.col("before"), F.col("size"))))
    out = out.withColumn("position", F.when(F.col("taken") > 0, _position(F.col("before") / F.col("target"))))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "position", "before", "times", "extra", "begin", "end")


def _position(y):
    """The time at which the share y of a source's demand is reached: the inverse of its integrated linear weight."""
    a, b = F.col("begin"), F.col("end")
    y = F.least(y, F.lit(1.0))
    return F.when(a == b, y).otherwise((F.sqrt(a * a + (b * b - a * a) * y) - a) / (b - a))


def curriculum(rows: DataFrame) -> DataFrame:
    """What `mixed` gave, once for each use of a document, range-sorted by position: doc_id, use, words, position."""
    uses = F.col("times") + (F.col("extra") > F.col("before")).cast("bigint")
    out = rows.where("taken > 0").withColumn("use", F.explode(F.sequence(F.lit(0).cast("bigint"), uses - 1)))
    words = F.when(F.col("use") < F.col("times"), F.col("size")).otherwise(F.least(F.col("extra") - F.col("before"), F.col("size")))
    size = F.col("source_size").cast("double")
    out = out.withColumn("words", words).withColumn("position", _position((F.col("use") * size + F.col("before")) / F.col("target")))
    return out.where("words > 0").select("doc_id", "source", "use", "words", "position").orderBy("position", "doc_id")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    out = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


ORACLE_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(doc_id::varchar, '')) as h from documents),
s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last)) - 1 as rank from d group by source),
w as (select *, ([3, 1, 2])[1 + rank % 3]::double as weight, ([1.5, 0.5, 1.0])[1 + rank % 3]::double as a, ([0.5, 1.5, 1.0])[1 + rank % 3]::double as b from s),
l as (select *, (1.5::double * (sum(source_size) over ())::double - 2::double * coalesce(sum(source_size) over (order by source_size / weight, rank rows between unbounded preceding and 1 preceding), 0)::double) / sum(weight) over (order by source_size / weight, rank rows between current row and unbounded following) as level from w),
t as (select *, least(2::double * source_size, weight * max(level) over ()) as target from l),
x as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as times from t),
o as (select d.doc_id, d.size, x.source_size, x.target, x.times, x.a, x.b, round(x.target)::bigint - x.times * x.source_size as extra, coalesce(sum(d.size) over (partition by d.source order by h, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as before from d join x on d.source is not distinct from x.source),
k as (select *, times * size + greatest(0, least(extra - before, size)) as taken, least(before / target, 1::double) as y from o)
select doc_id, size, source_size, target, taken::bigint as taken, case when taken > 0 then case when a = b then y else (sqrt(a * a + (b * b - a * a) * y) - a) / (b - a) end end as position from k
"""
