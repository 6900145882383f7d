"""Phrases by pivot partitioning: contiguous n-grams, each counted where its rarest word is.

Texts are packed once into chunks: the distinct words of a chunk with their counts, and the texts as numbers of these. Counts are added up over chunks
and words below `least` are blanked, as no phrase with them can be frequent. What is left has a number by frequency, the
rarer word the larger one, which goes back to the chunks: a word is counted together with the list of its places, one for each chunk, and tasks pack the
numbers of many words for a chunk into one row.

Each occurrence of a word w is then a pivot: its fragment is what stands around it, as far as words are at most as rare as w (to the
left rarer or equal ones end it, to the right rarer ones alone) and as a phrase with w can reach. Equal fragments of a
chunk are one, with a count. Fragments are routed to their pivot's shard, as one packed message from a chunk; the shard counts the n-grams
that hold the pivot's place. So an n-gram's occurrence is in one fragment only, that of the first occurrence of its rarest word; no other shard
emits it, and what is frequent is known without further exchange. Frequent words have short fragments, as few words
are more frequent, so the many occurrences of a hot word cost little.

The number of shards follows the bytes of text, and a chunk sends at most one message for each of its pivots, however many shards there are. A task counts
`HELD` fragments at once. Pivots with more than `SPLIT` occurrences, which are dealt to several shards, and shards that would
hold more than `MOST` n-grams give partial counts, which are added up before the threshold holds.

A candidate's score compares its count with those of its two parts at the weakest cut; candidates inside a longer one that
is (nearly) as frequent are dropped. Products are decimals of 38 digits, so they are exact.

Defined cases: null texts are empty, a null lang is `und` (and is counted with documents of that lang); empty texts have no words. Very
long texts are chunks of their own. Repeated rows count as often as they are there. Ties of cuts go to the earliest one, ties of ranks to the larger count, then
to the bytes of the phrase. Extra columns are dropped; an empty table gives no phrases.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm import _chunks as C
from thicket.llm import _words as W
from thicket.llm._store import discard, written
from thicket.session import ship

#: Fragments that a mining task counts at once, n-grams that it holds, and occurrences from which a pivot is dealt to several tasks.
HELD = 100_000
MOST = 4_000_000
SPLIT = 1 << 22
#: Places of frequent words that a task packs at once.
PACKED = 2_000_000
#: Bytes of text whose fragments are a shard's.
SHARD_BYTES = 16 << 20

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_IS_WORD = ~_ENDS
_IS_WORD[[0x20, 0x09]] = False


@dataclass(frozen=True)
class PhraseParams:
    least: int = 100
    longest: int = 5
    covered_percent: int = 100  # a longer phrase with this share of the count covers a shorter one
    top: int = 2000


def numbered(langs: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, dict[str, int]]:
    """The distinct words of rows as structs (lang, word, cnt); the rows as numbers of words from 1, with 0 between pieces; words of each lang."""
    raw, offs = W.text_bytes(texts)
    first, _, starts, ends = W.split_words(raw, offs, _IS_WORD, W.LOWER, spans=True)
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    low = W.LOWER[raw]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(low[_IS_WORD[low]]))).dictionary_encode()
    names = langs.fill_null("und").dictionary_encode()
    row = np.repeat(np.arange(len(langs)), np.diff(first))
    lang = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
    code, inverse, counts = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(names.dictionary)) + lang, return_inverse=True, return_counts=True)
    which, of = np.divmod(code, max(1, len(names.dictionary)))
    table = pa.StructArray.from_arrays([names.dictionary.take(pa.array(of)).cast(pa.string()), words.dictionary.take(pa.array(which)).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "word", "cnt"])
    stops = np.concatenate([[0], np.cumsum(_ENDS[raw])])
    apart = np.zeros(len(starts), bool)
    apart[1:] = (stops[starts[1:]] > stops[ends[:-1]]) | (row[1:] != row[:-1])
    sequence = np.zeros(len(starts) + int(apart.sum()), np.uint32)
    sequence[np.arange(len(starts)) + np.cumsum(apart)] = inverse.ravel() + 1
    totals = np.bincount(of, counts, minlength=len(names.dictionary)).astype(np.int64)
    return table, sequence, dict(zip(names.dictionary.to_pylist(), totals.tolist(), strict=True))


def chunks_of(docs: DataFrame, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """A written table of chunks: chunk, n_bytes, words (lang, word, cnt), totals (lang, n), size and sequence."""

    def run(batches):
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out():
            nonlocal k, held, size
            rows = pa.Table.from_batches(held).combine_chunks()
            words, sequence, totals = numbered(rows.column("lang").combine_chunks(), rows.column("text").combine_chunks())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.array([[{"lang": x, "n": n} for x, n in totals.items()]], pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])))]
            row = [pa.array([part << 32 | k], pa.int64()), pa.array([size], pa.int64()), *lists, pa.array([len(sequence)], pa.int64()), pa.array([C.pack_plain(sequence) if len(sequence) else b""], pa.binary())]
            k, held, size = k + 1, [], 0
            return pa.RecordBatch.from_arrays(row, names=["chunk", "n_bytes", "words", "totals", "size", "sequence"])

        for batch in batches:
            for piece in W.slices(batch, chunk_bytes):
                held.append(piece)
                size += int(W.text_bytes(piece.column("text"))[1][-1])
                if size >= chunk_bytes:
                    yield out()
        if held:
            yield out()

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    schema = "chunk bigint, n_bytes bigint, words array<struct<lang: string, word: string, cnt: bigint>>, totals array<struct<lang: string, n: bigint>>, size bigint, sequence binary"
    return written(rows.mapInArrow(run, schema), "phrase-chunks", "zstd", {"parquet.block.size": str(16 << 20)})


def vocabulary(chunks: DataFrame, least: int) -> tuple[DataFrame, list[int]]:
    """A written table (place, lang, word, n, at) of the frequent words in the order of falling counts, and for each partition of that order how
    many words come before it. at: the chunks that hold a word and where; each chunk is there once, as its words are distinct."""
    words = chunks.select("chunk", F.posexplode("words").alias("pos", "w"))
    # counts and places in one pass: what is frequent needs no join to go back to its chunks
    counts = words.groupBy("w.lang", "w.word").agg(F.sum("w.cnt").alias("n"), F.collect_list(F.struct("chunk", "pos")).alias("at")).where(F.col("n") >= least)
    counts = written(counts, "phrase-counts")  # the sort reads them twice
    placed = written(counts.orderBy(F.col("n").desc(), "word", "lang").select(F.monotonically_increasing_id().alias("place"), "lang", "word", "n", "at"), "phrase-words", "zstd", {"parquet.block.size": str(16 << 20)})
    discard(counts)
    sizes = dict(tuple(r) for r in placed.groupBy(F.shiftright("place", 33).cast("int")).agg(F.count("*")).collect())  # a row for each partition
    before = [0]
    for p in range(max(sizes, default=-1) + 1):
        before.append(before[-1] + sizes.get(p, 0))
    if before[-1] >= 1 << 31:
        raise ValueError("more than 2**31 frequent words")
    return placed, before


def number_of(before: list[int]) -> Column:
    """A word's number, from 1, by its place."""
    base = F.element_at(F.lit(before), (F.shiftright("place", 33) + 1).cast("int"))
    return (base + F.col("place").bitwiseAND((1 << 33) - 1) + 1).cast("int")


def answers(placed: DataFrame, before: list[int], split: int, held: int) -> DataFrame:
    """(chunk, size, blob): where the frequent words of a chunk are, their numbers and the shards that they are dealt to, three arrays in one. A task packs
    the words that it reads, `held` places at once, so a chunk gets few rows of many words."""

    def run(batches):
        held_now, size = [], 0

        def out():
            nonlocal held_now, size
            chunk, *columns = (np.concatenate(c) for c in zip(*held_now, strict=True))
            held_now, size = [], 0
            order = np.argsort(chunk, kind="stable")
            chunk, data = chunk[order], np.stack([c[order] for c in columns])
            found = C.cuts(chunk)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in found], pa.int64()), pa.array([b - a for _, a, b in found], pa.int64()), pa.array([C.pack_plain(data[:, a:b].ravel()) for _, a, b in found], pa.binary())], names=["chunk", "size", "blob"])

        for batch in batches:
            ids, salts, at = (batch.column(c) for c in ("id", "salts", "at"))
            n = np.diff(at.offsets.to_numpy())
            chunk, pos = (at.flatten().field(k).to_numpy() for k in ("chunk", "pos"))
            held_now.append([chunk, pos.astype(np.int32), np.repeat(ids.to_numpy(), n), np.repeat(salts.to_numpy(), n)])
            size += len(chunk)
            if size >= held:
                yield from out()
        if size:
            yield from out()

    rows = placed.select(number_of(before).alias("id"), (1 + F.floor(F.col("n") / split)).cast("int").alias("salts"), "at")
    return rows.mapInArrow(run, "chunk bigint, size bigint, blob binary")


def fragments(sequence: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fragments (a row each, the pivot in the middle, 0 outside) of numbers by rarity (0: blank), in the order of pivots; and their counts."""
    reach = longest - 1
    s = np.concatenate([np.zeros(reach, np.int32), sequence.astype(np.int32), np.zeros(reach, np.int32)])
    at = np.flatnonzero(s)
    pivot = s[at]
    columns: list[np.ndarray] = [np.zeros(0, np.int32)] * (2 * reach + 1)
    columns[reach] = pivot
    for step, rarer_ends in ((-1, pivot - 1), (1, pivot)):
        on = np.ones(len(at), bool)
        for j in range(1, reach + 1):
            word = s[at + step * j]
            on &= (word > 0) & (word <= rarer_ends)
            columns[reach + step * j] = np.where(on, word, 0)
    some = (columns[reach - 1] > 0) | (columns[reach + 1] > 0)
    names = [f"c{k}" for k in range(2 * reach + 1)]
    table = pa.table([c[some] for c in columns], names=names).append_column("n", pa.array(np.ones(int(some.sum()), np.int32)))
    found = table.group_by(names).aggregate([("n", "sum")])
    matrix = np.stack([found.column(c).to_numpy() for c in names], axis=1) if found.num_rows else np.zeros((0, len(names)), np.int32)
    order = np.argsort(matrix[:, reach], kind="stable")
    return matrix[order], found.column("n_sum").to_numpy()[order].astype(np.int32)


def mined(rows: np.ndarray, counts: np.ndarray, longest: int) -> pa.Table:
    """(w0, w1, ..., pivot, f): counts of the n-grams of 2 words and more around the pivots of fragments; unused columns are 0."""
    reach = longest - 1
    grams, weights, pivots = [], [], []
    for left in range(reach + 1):
        for right in range(reach - left + 1):
            if left + right:
                there = (rows[:, reach - left] > 0) & (rows[:, reach + right] > 0)
                part = np.zeros((int(there.sum()), longest), np.int32)
                part[:, : left + right + 1] = rows[there, reach - left : reach + right + 1]
                grams.append(part)
                weights.append(counts[there])
                pivots.append(rows[there, reach])
    all_of = np.concatenate(grams)
    names = [f"w{k}" for k in range(longest)]
    table = pa.table([np.ascontiguousarray(all_of[:, k]) for k in range(longest)] + [np.concatenate(pivots), np.concatenate(weights).astype(np.int64)], names=[*names, "pivot", "n"])
    out = table.group_by([*names, "pivot"]).aggregate([("n", "sum")])
    return out.rename_columns([{"n_sum": "f"}.get(c, c) for c in out.column_names])


def _shard(pivot: np.ndarray, salt: np.ndarray | int, n: int) -> np.ndarray:
    return (W.mix(pivot.astype(np.uint64) | np.asarray(salt).astype(np.uint64) << np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _route(answered: DataFrame, p: PhraseParams, n: int) -> DataFrame:
    """(shard, whole, size, blob): the fragments of a chunk for each shard; those of pivots that are dealt to several shards apart."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                size, chunk, got = (row.column(c)[0].as_py() for c in ("size", "chunk", "got"))
                pos, ids, salts = np.concatenate([C.unpack_plain(g["blob"], 3 * g["size"], np.int32).reshape(3, -1) for g in got], axis=1)
                local = C.unpack_plain(row.column("sequence")[0].as_py(), size, np.uint32) if size else np.zeros(0, np.uint32)
                number = np.zeros(max(int(local.max(initial=0)), int(pos.max(initial=-1)) + 1) + 1, np.int32)
                number[pos + 1] = ids
                matrix, counts = fragments(number[local], p.longest)
                if not len(matrix):
                    continue
                pivot = matrix[:, p.longest - 1]
                order = np.argsort(ids)
                dealt = salts[order][np.searchsorted(ids[order], pivot)]
                salt = W.mix(np.array([chunk], np.uint64))[0] % dealt.astype(np.uint64)
                key = _shard(pivot, salt, n) * 2 + (dealt == 1)
                order = np.argsort(key, kind="stable")
                data = np.concatenate([matrix, counts[:, None]], axis=1)[order]
                found = C.cuts(key[order])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k // 2 for k, _, _ in found], pa.int64()), pa.array([k % 2 == 1 for k, _, _ in found]), pa.array([b - a for _, a, b in found], pa.int64()), pa.array([C.pack_plain(data[a:b].T.ravel()) for _, a, b in found], pa.binary())],
                    names=["shard", "whole", "size", "blob"],
                )

    return answered.mapInArrow(run, "shard bigint, whole boolean, size bigint, blob binary")


def _mine(routed: DataFrame, p: PhraseParams, held: int, most: int) -> DataFrame:
    """(g, f): the frequent n-grams of each shard; of pivots in several shards, and of a shard with more than `most` n-grams, partial counts."""
    width = 2 * p.longest
    names = [f"w{k}" for k in range(p.longest)]

    def run(batches):
        rows, size, table, partial, last = [], 0, None, False, None

        def add() -> None:
            nonlocal rows, size, table
            if rows:
                data = np.concatenate(rows)
                new = mined(data[:, :-1], data[:, -1], p.longest)
                if table is not None:
                    new = pa.concat_tables([table, new]).group_by([*names, "pivot"]).aggregate([("f", "sum")]).rename_columns([*names, "pivot", "f"])
                rows, size, table = [], 0, new

        def out(every: bool):
            nonlocal table
            f = table.column("f").to_numpy()
            keep = np.ones(len(f), bool) if every else f >= p.least
            matrix = np.stack([table.column(c).to_numpy() for c in names], axis=1)[keep]
            table = None
            for k in range(0, len(matrix), 50_000):
                some = matrix[k : k + 50_000]
                offsets = np.concatenate([[0], np.cumsum((some > 0).sum(axis=1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(some[some > 0], pa.int32())), pa.array(f[keep][k : k + 50_000])], names=["g", "f"])

        for batch in batches:
            for shard, whole, n, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "whole", "size", "blob")), strict=True):
                if (shard, whole) != last:
                    add()
                    if table is not None:
                        yield from out(partial)
                    last, partial = (shard, whole), not whole
                rows.append(C.unpack_plain(blob, n * width, np.int32).reshape(width, n).T)
                size += n
                if size >= held:
                    add()
                    if table.num_rows > most:
                        partial = True
                        yield from out(True)
        add()
        if table is not None:
            yield from out(partial)

    return routed.mapInArrow(run, "g array<int>, f bigint")


def counted(docs: DataFrame, p: PhraseParams = PhraseParams(), chunk_bytes: int = C.CHUNK_BYTES, shard_bytes: int = SHARD_BYTES, held: int = HELD, most: int = MOST, split: int = SPLIT, packed: int = PACKED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent n-grams (g: ids of words, f), the frequent words (id, lang, word, n), and the words of each lang (lang, total)."""
    spark = docs.sparkSession
    ship(spark)
    chunks = chunks_of(docs, chunk_bytes)
    total = chunks.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    placed, before = vocabulary(chunks, p.least)
    words = written(placed.select(number_of(before).alias("id"), "lang", "word", "n"), "phrase-vocabulary")
    got = answers(placed, before, split, packed).groupBy("chunk").agg(F.collect_list(F.struct("size", "blob")).alias("got"))
    n = max(1, -(-total // shard_bytes))
    # a merge join at every size: chunks are too many to be sent to every task
    routed = _route(chunks.select("chunk", "size", "sequence").hint("merge").join(got, "chunk"), p, n)
    dealt = routed.repartition(n, "shard").sortWithinPartitions("shard", "whole")
    grams = _mine(dealt, p, held, most).groupBy("g").agg(F.sum("f").alias("f")).where(F.col("f") >= p.least)
    out = written(grams, "phrase-grams")
    totals = written(chunks.select(F.explode("totals").alias("t")).groupBy("t.lang").agg(F.sum("t.n").alias("total")), "phrase-totals")
    discard(chunks, placed)
    return out, words, totals


def _big(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def phrases(docs: DataFrame, p: PhraseParams = PhraseParams(), **sizes: int) -> DataFrame:
    """lang, phrase, a, l, r, n and score of every candidate that no longer one covers."""
    grams, words, totals = counted(docs, p, **sizes)
    of = grams.unionByName(words.select(F.array("id").alias("g"), F.col("n").alias("f")))
    # the longest frequent phrases around each candidate
    size = F.size("g")
    inner = grams.where(size > 2).select("g", "f", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inner = inner.select("f", F.explode(F.transform(F.sequence(F.lit(1), F.size("g") - F.col("m") + 1), lambda at: F.slice("g", at, F.col("m")))).alias("g"))
    around = inner.groupBy("g").agg(F.max("f").alias("around"))
    left = grams.join(around, "g", "left").where(F.col("around").isNull() | (100 * F.col("around") < p.covered_percent * F.col("f"))).drop("around")
    # spelled out
    spelled = left.select("g", F.posexplode("g").alias("pos", "id")).join(words.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("g").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = left.withColumnRenamed("f", "a").join(spelled, "g").join(totals.withColumnRenamed("total", "n"), "lang")
    cuts = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("g") - 1)))
    cuts = cuts.withColumns({"gl": F.slice("g", F.lit(1), F.col("k")), "gr": F.slice("g", F.col("k") + 1, F.size("g") - F.col("k"))})
    cuts = cuts.join(of.select(F.col("g").alias("gl"), F.col("f").alias("l")), "gl").join(of.select(F.col("g").alias("gr"), F.col("f").alias("r")), "gr")
    top = F.lit(1000).cast("decimal(4,0)") * _big(F.col("a"))
    cuts = cuts.withColumns({"_top": (top * _big(F.col("n"))).cast("decimal(38,0)"), "_below": (_big(F.col("l")) * _big(F.col("r"))).cast("decimal(38,0)")})
    cuts = cuts.withColumn("score", F.expr("_top div _below"))
    best = cuts.groupBy("g").agg(F.min(F.struct("score", "k", "lang", "phrase", "a", "l", "r", "n")).alias("x"))
    return best.select("x.lang", "x.phrase", "x.a", "x.l", "x.r", "x.n", "x.score")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first `top` of each lang; each task keeps as many before they meet."""
    w = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    out = found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    p = PhraseParams()
    return ranked(phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"), p), p.top)


ORACLE_SQL = r"""
with t as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from t),
n as (select lang, sum(len(w))::bigint as n from w group by lang),
g as materialized (select lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') as phrase, count(*) as f
  from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from w, (select unnest(range(1, 6)) as m) where len(w) >= m) group by all having count(*) >= 100),
c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as x from g where m > 1),
s as (select lang, array_to_string(list_slice(x, i, i + j - 1), ' ') as phrase, max(a) as around
  from (select lang, x, a, m, j, unnest(range(1, m - j + 2)) as i from c, (select unnest(range(2, 5)) as j) where j < m) group by all),
k as (select c.*, n.n, unnest(range(1, c.m)) as k from c left join s using (lang, phrase) join n using (lang) where s.around is null or 100 * s.around < 100 * c.a),
q as (select k.lang, k.phrase, k.a, k.k, l.f as l, r.f as r, k.n, ((1000::hugeint * k.a * k.n) // (l.f::hugeint * r.f))::bigint as score
  from k join g l on l.lang = k.lang and l.phrase = array_to_string(list_slice(x, 1, k.k), ' ') join g r on r.lang = k.lang and r.phrase = array_to_string(list_slice(x, k.k + 1, k.m), ' ')),
b as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as first from q) where first = 1)
select * from (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from b) where rank <= 2000
"""
