"""Benchmark decontamination by suffix arrays of the training texts.

Every batch of documents is a shard. Its suffix array holds the word positions sorted by the words that follow.
Every suffix of every benchmark item is looked up by binary search; the two neighbours give its longest verbatim
match, and the range of suffixes that agree with it on a window's length gives the places where the window occurs.

The array is sparse and complete: a suffix that isn't followed by as many benchmark words as the shortest window has
can't match one, and is left out. Words are compared by 64-bit hashes.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased. A window is `window` (10) consecutive words of
an item; an item with fewer words, but not none, is one window.

The benchmark is sent to the tasks in blocks of at most `block_bytes` of text, chosen by a hash of the item id;
each block is one more pass in the same stage over the same rows, so its size is not limited and nothing is
shuffled. (An item longer than a block makes that block longer.)

Defined cases: a null text has no words; items with a null item_id or text are ignored; items with the same id
count once; documents without words are clean; repeated rows give repeated results; a null doc_id stays null; extra
columns are dropped; empty tables give an empty result, an empty benchmark only clean documents.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import _words as W
from thicket.session import ship

U64 = np.uint64


@dataclass(frozen=True)
class DecontaminationParams:
    window: int = 10
    block_bytes: int = 16 << 20
    shard_bytes: int = 4 << 20


class TestSuffixes:
    """All suffixes of a block of items, with dense word numbers of the block's vocabulary (0: no benchmark word)."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        raw, offs = W.text_bytes(pa.array(texts, pa.string()))
        first, h = W.split_words(raw, offs, W.IS_ALNUM, W.LOWER)
        self.ids = np.array(ids, dtype=object)
        self.vocabulary = np.sort(h)
        if len(h):
            self.vocabulary = self.vocabulary[np.concatenate([[True], self.vocabulary[1:] != self.vocabulary[:-1]])]
        self.words = (np.searchsorted(self.vocabulary, h) + 1).astype(np.int32)
        n = np.diff(first)
        self.item = np.repeat(np.arange(len(n)), n)
        self.end = first[1:][self.item]  # where the suffix's item ends
        self.at = np.arange(len(h))
        need = np.minimum(n, window)[self.item]
        self.need = np.where(self.at + need <= self.end, need, 0)  # words of the window that starts here; 0: none does
        self.shortest = int(need.min()) if len(need) else 0

    def numbers(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int32)
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == h, at + 1, 0).astype(np.int32)


def suffix_array(words: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The positions `at` sorted by the words that follow them up to ends[position], by prefix doubling.

    words: 0 ends a suffix too (nothing matches beyond it). Ranks of positions outside `at` aren't needed: a
    position is compared by its own ranks at growing distances, taken from the words of the whole shard.
    """
    n = len(words)
    rank = words.astype(np.int64)  # of the first `width` words from each position
    width = 1
    longest = int((ends[at] - at).max()) if len(at) else 0
    while True:
        key = rank[at]
        order = np.argsort(key, kind="stable")
        if width >= longest or len(at) < 2:
            return at[order]
        sorted_ = key[order]
        if (sorted_[1:] != sorted_[:-1]).all():
            return at[order]
        ahead = np.zeros(n, np.int64)
        if n > width:
            ahead[: n - width] = rank[width:]
        ahead[np.arange(n) + width >= ends] = 0
        ahead[rank == 0] = 0
        pair = np.lexsort((ahead, rank))
        new = np.concatenate([[0], np.cumsum((rank[pair][1:] != rank[pair][:-1]) | (ahead[pair][1:] != ahead[pair][:-1]))])
        fresh = np.empty(n, np.int64)
        fresh[pair] = new + 1
        fresh[words == 0] = 0
        rank = fresh
        width *= 2


def _agree(words: np.ndarray, ends: np.ndarray, pos: np.ndarray, t: TestSuffixes, q: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words on which suffix pos[i] and test suffix q[i] agree, at most most[i]; and -1, 0 or 1 as pos sorts before, with or after."""
    n = len(q)
    length, sign, live, k = np.zeros(n, np.int64), np.zeros(n, np.int8), np.arange(n), 0
    while len(live):
        live = live[most[live] > k]
        p, s = pos[live] + k, q[live] + k
        inside = p < ends[pos[live]]
        a = np.where(inside, words[np.minimum(p, len(words) - 1)], 0)
        b = t.words[s]
        equal = a == b
        sign[live[~equal]] = np.where(a[~equal] < b[~equal], -1, 1)
        live = live[equal]
        length[live] += 1
        k += 1
    return length, sign


def _bound(words, ends, sa, t: TestSuffixes, q: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
    """First place in sa whose suffix sorts not before (after: behind) the first most[i] words of test suffix q[i]."""
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(sa), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        _, sign = _agree(words, ends, sa[mid], t, q[open_], most[open_])
        right = (sign <= 0) if after else (sign < 0)
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]
    return lo


def search(h: np.ndarray, first: np.ndarray, t: TestSuffixes):
    """Searches one shard. Returns the occurrences (start, words, item) of windows, and the longest
    matches (item, start in the item, start in the shard, words) of the test suffixes with an occurrence."""
    words = t.numbers(h)
    n = len(words)
    none = np.zeros(0, np.int64)
    if not n or not len(t.words):
        return (none, none, none), (none, none, none, none)
    stop = np.repeat(first[1:], np.diff(first))
    # words until the next one that no item has
    breaks = np.where(words == 0, np.arange(n), n)
    until = np.minimum(np.minimum.accumulate(breaks[::-1])[::-1], stop)
    at = np.flatnonzero(until - np.arange(n) >= t.shortest)
    at = at[words[at] > 0]
    if not len(at):
        return (none, none, none), (none, none, none, none)
    # the stretches that hold these suffixes, alone: the rest of the shard takes no part in sorting
    inside = W.covered(n, at, until[at])
    packed = np.cumsum(inside) - 1
    small, ends, back = words[inside], packed[until[inside] - 1] + 1, np.flatnonzero(inside)
    sa = suffix_array(small, ends, packed[at])
    q = np.flatnonzero(t.need > 0)
    need = t.need[q].astype(np.int64)
    lo = _bound(small, ends, sa, t, q, need, False)
    hi = _bound(small, ends, sa, t, q, need, True)
    found = np.flatnonzero(hi > lo)
    place = W.ranges(lo[found], hi[found])
    who = np.repeat(found, (hi - lo)[found])
    start = back[sa[place]]
    full = (t.end - t.at)[q[found]]
    spot = _bound(small, ends, sa, t, q[found], full, False)
    best_n, best_at = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    for near in (spot - 1, spot):
        near = np.clip(near, 0, len(sa) - 1)
        length, _ = _agree(small, ends, sa[near], t, q[found], full)
        better = length > best_n
        best_n[better], best_at[better] = length[better], sa[near][better]
    item = t.item[q]
    return (start, need[who], item[who]), (item[found], (q - np.searchsorted(t.item, item))[found], back[best_at], best_n)


_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))
_PASS = "doc_id bigint, text string, n_words bigint, spans array<bigint>, items array<string>, matches array<struct<item_id: string, item_word: bigint, doc_word: bigint, n_words: bigint>>"


def _lists(values, rows: np.ndarray, n: int, kind) -> pa.Array:
    """A list column: values[i] belongs to row rows[i] (sorted)."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _pass(block, p: DecontaminationParams):
    """One block of the benchmark over all rows; what earlier blocks found is carried along."""

    def run(batches):
        ids, texts = block.value
        t = TestSuffixes(ids, texts, p.window)
        for batch in batches:
            for part in W.slices(batch, p.shard_bytes):
                raw, offs = W.text_bytes(part.column("text"))
                first, h = W.split_words(raw, offs, W.IS_ALNUM, W.LOWER)
                n = part.num_rows
                (start, size, item), (m_item, m_in, m_at, m_n) = search(h, first, t)
                row = np.searchsorted(first, start, "right") - 1
                spans = sorted({(r, s - first[r], s - first[r] + k) for r, s, k in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)})
                pairs = sorted({(r, t.ids[i]) for r, i in zip(row.tolist(), item.tolist(), strict=True)})
                m_row = np.searchsorted(first, m_at, "right") - 1
                o = np.lexsort((m_in, m_item, m_row))
                before = [part.column(k).to_pylist() if k in part.schema.names else [None] * n for k in ("spans", "items", "matches")]
                new: list[list] = [[[] for _ in range(n)] for _ in range(3)]
                for r, a, b in spans:
                    new[0][r] += [a, b]
                for r, i in pairs:
                    new[1][r].append(i)
                for k in o.tolist():
                    r = int(m_row[k])
                    new[2][r].append({"item_id": t.ids[m_item[k]], "item_word": int(m_in[k]), "doc_word": int(m_at[k] - first[r]), "n_words": int(m_n[k])})
                both = [[(x or []) + y for x, y in zip(old, add, strict=True)] for old, add in zip(before, new, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(np.diff(first), pa.int64()), pa.array(both[0], pa.list_(pa.int64())), pa.array(both[1], pa.list_(pa.string())), pa.array(both[2], _MATCH)], names=["doc_id", "text", "n_words", "spans", "items", "matches"])

    return run


def _digest(batches):
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for spans, items, n in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), batch.column("n_words").to_pylist(), strict=True):
            hit = int(W.covered(n, np.array(spans[::2], np.int64), np.array(spans[1::2], np.int64)).sum()) if spans else 0
            ids = sorted(set(items))
            for c, v in zip(out, (hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True)), batch.column("matches")], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches"])


def _blocks(benchmark: DataFrame, p: DecontaminationParams) -> list:
    """The benchmark as broadcast blocks of bounded size: lists of item ids and texts."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = max(1, -(-total * 2 // p.block_bytes)) if total > p.block_bytes else 1
    out = []
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).toArrow()
        out.append(spark.sparkContext.broadcast((rows["item_id"].to_pylist(), rows["text"].to_pylist())))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """Per document: hits and items as op4's contract has them, and `matches`: for each test suffix with an
    occurrence in the shard, its longest verbatim match and where it lies, at the document that holds it."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for block in _blocks(benchmark, p):
        rows = rows.mapInArrow(_pass(block, p), _PASS)
    return rows.drop("text").mapInArrow(_digest, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, matches array<struct<item_id: string, item_word: bigint, doc_word: bigint, n_words: bigint>>")


def clean(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with their columns. Nothing is shuffled."""
    ship(docs.sparkSession)
    schema = docs.schema
    for block in _blocks(benchmark, p):

        def run(batches, block=block):
            ids, texts = block.value
            t = TestSuffixes(ids, texts, p.window)
            for batch in batches:
                for part in W.slices(batch, p.shard_bytes):
                    raw, offs = W.text_bytes(part.column("text"))
                    first, h = W.split_words(raw, offs, W.IS_ALNUM, W.LOWER)
                    (start, _, _), _ = search(h, first, t)
                    keep = np.ones(part.num_rows, bool)
                    keep[np.searchsorted(first, start, "right") - 1] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("matches")


ORACLE_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
i as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where text is not null and item_id is not null),
win as (select distinct item_id, least(10, len(ws)) as k, array_to_string(ws[s:s + least(10, len(ws)) - 1], ' ') as g from (select item_id, ws, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) as s from i where len(ws) > 0)),
ks as (select distinct k from win),
pos as (select doc_id, k, s, array_to_string(ws[s:s + k - 1], ' ') as g from (select doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) as s from w cross join ks where len(ws) >= k)),
hit as (select p.doc_id, p.s, p.k, win.item_id from pos p join win on p.g = win.g and p.k = win.k),
n as (select doc_id, count(distinct u) as n_hit from (select doc_id, unnest(generate_series(s, s + k - 1)) as u from hit) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from hit) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join n using (doc_id) left join it using (doc_id)
"""
