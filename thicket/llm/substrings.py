"""Substring dedup by fixed-block anchors.

A passage of `window` (35) words that occurs twice holds, in one of its places, a whole block of (window+1)//2 (18)
words of that document's division into consecutive blocks. So:

1. Index and probe. Every document is cut into non-overlapping blocks; every rolling window of a block's length
   of every document is a probe. Both go to shards by their hash, packed (see _chunks). A probe that meets a
   block elsewhere is a hit, on both sides. False hits of the shortened hashes are harmless.
2. Extend. Around each hit the windows of `window` words that contain it are the possible extensions. Their
   96-bit hashes are counted over the corpus; those that occur twice are repeats, and adjoining ones
   make up the maximal exact repeats.
3. Remove. Words inside a repeat are removed from every place it occurs in.

Words are `[^\x20\x09-\x0D]+`, unchanged. Windows lie within one document.

Defined cases: a null text has no words; a document of fewer words than a window keeps all; repeated rows
are copies of each other; doc_id may be null; extra columns are dropped by `repeats` and kept by `without_repeats`; empty
tables give empty ones.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import _chunks as C
from thicket.llm import _words as W
from thicket.llm._store import written
from thicket.session import ship

U64 = np.uint64
_SALT = 0x3C79AC492BA7B653
_BITS = 38  # of an anchor's hash, beside its shard; two flags below make 5 bytes


@dataclass(frozen=True)
class SubstringParams:
    window: int = 35

    @property
    def block(self) -> int:
        return (self.window + 1) // 2


def _words_of(blob: bytes):
    batch = C.opened(blob)
    raw, offs = W.text_bytes(batch.column("text"))
    first, h = W.split_words(raw, offs, W.IS_TOKEN)
    return batch, first, h


def _anchor_keys(h: np.ndarray, first: np.ndarray, size: int, n_shards: int):
    """Starts, shards and shortened hashes of all rolling windows of a block's length."""
    at = W.window_rows(first, size)
    x = W.windows(h, size)[at] if len(at) else np.zeros(0, U64)
    return at, C.shard_of(x, n_shards), x & U64((1 << _BITS) - 1)


def _probe(p: SubstringParams, n_shards: int):
    """Messages of step 1: distinct hashes of a chunk's windows; bit 1: more than once here, bit 0: a block."""

    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                _, first, h = _words_of(blob.as_py())
                at, shard, key = _anchor_keys(h, first, p.block, n_shards)
                row = np.searchsorted(first, at, "right") - 1
                block = (at - first[row]) % p.block == 0
                # shard above the key: some bits of room each
                both = (shard << U64(_BITS + 1)) | (key << U64(1)) | block.astype(U64)
                both.sort()
                bare = both >> U64(1)
                new = np.flatnonzero(np.concatenate([[True], bare[1:] != bare[:-1]])) if len(bare) else np.zeros(0, np.int64)
                count = np.diff(np.append(new, len(bare)))
                last = new + count - 1
                value = (bare[new] << U64(2)) | ((count > 1).astype(U64) << U64(1)) | (both[last] & U64(1))
                runs = C.cuts(bare[new] >> U64(_BITS))
                mask = U64((1 << (_BITS + 2)) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in runs], pa.int64()), pa.array([chunk] * len(runs), pa.int64()), pa.array([C.pack(value[a:b] & mask, 5) for _, a, b in runs], pa.binary())],
                    names=["shard", "chunk", "data"],
                )

    return run


def _hits(table: pa.Table) -> pa.Table:
    """A shard of step 1: to each chunk, those of its hashes that are a block's and occur at two places or more."""
    shard, chunks = table["shard"][0].as_py(), table["chunk"].to_pylist()
    values = [C.unpack(d.as_py(), 5) for d in table["data"]]
    both = np.sort(np.concatenate(values))
    key = both >> U64(2)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    many = np.add.reduceat(1 + ((both >> U64(1)) & U64(1)).astype(np.int64), new) > 1
    block = np.bitwise_or.reduceat(both & U64(1), new) > 0
    hot = key[new][many & block]
    out = [(c, C.pack(own[C.member(hot, own)], 5)) for c, v in zip(chunks, values, strict=True) for own in [v >> U64(2)]]
    out = [(c, d) for c, d in out if int.from_bytes(d[:8], "little")]
    return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "shard": pa.array([shard] * len(out), pa.int64()), "data": pa.array([d for _, d in out], pa.binary())})


def _candidates(p: SubstringParams, n_shards: int):
    """Messages of step 2: hashes of the windows that contain a hit."""

    def run(batches):
        for batch in batches:
            for chunk, blob, got in zip(batch.column("chunk").to_pylist(), batch.column("blob"), batch.column("got"), strict=True):
                if not got.is_valid:
                    continue
                _, first, h = _words_of(blob.as_py())
                at, shard, key = _anchor_keys(h, first, p.block, n_shards)
                hot = np.sort(np.concatenate([(U64(g["shard"]) << U64(_BITS)) | C.unpack(g["data"], 5) for g in got.as_py()]))
                hits = at[C.member(hot, (shard << U64(_BITS)) | key)]
                near = W.covered(len(h), np.maximum(hits - (p.window - p.block), 0), hits + 1)
                starts = W.window_rows(first, p.window)
                starts = starts[near[starts]]
                x, y = W.windows(h, p.window)[starts], W.windows(h, p.window, _SALT)[starts] >> U64(32)
                order = np.argsort(x, kind="stable")
                x, y = x[order], y[order]
                new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)
                count = np.diff(np.append(new, len(x)))
                x, y = x[new], (y[new] & U64(0x7FFFFFFF)) | ((count > 1).astype(U64) << U64(31))
                runs = C.cuts(C.shard_of(x, n_shards))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in runs], pa.int64()), pa.array([chunk] * len(runs), pa.int64()), pa.array([C.pack(x[a:b]) for _, a, b in runs], pa.binary()), pa.array([C.pack_plain(y[a:b].astype(np.uint32)) for _, a, b in runs], pa.binary())],
                    names=["shard", "chunk", "data", "more"],
                )

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """A shard of step 2: to each chunk, those of its windows that occur at two places or more."""
    shard, chunks = table["shard"][0].as_py(), table["chunk"].to_pylist()
    xs = [C.unpack(d.as_py()) for d in table["data"]]
    ys = [C.unpack_plain(d.as_py(), len(x), np.uint32) for d, x in zip(table["more"], xs, strict=True)]
    x, y = np.concatenate(xs), np.concatenate(ys)
    owner = np.repeat(np.arange(len(xs)), [len(v) for v in xs])
    order = np.lexsort((y & 0x7FFFFFFF, x))
    x, y, owner = x[order], y[order], owner[order]
    bare = y & np.uint32(0x7FFFFFFF)
    new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (bare[1:] != bare[:-1])])) if len(x) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(x)))
    many = np.repeat(np.add.reduceat(1 + (y >> np.uint32(31)).astype(np.int64), new) > 1, size) if len(x) else np.zeros(0, bool)
    x, owner = x[many], owner[many]
    order = np.argsort(owner, kind="stable")
    x, owner = x[order], owner[order]
    runs = C.cuts(owner)
    return pa.table({"chunk": pa.array([chunks[k] for k, _, _ in runs], pa.int64()), "shard": pa.array([shard] * len(runs), pa.int64()), "data": pa.array([C.pack(np.sort(x[a:b])) for _, a, b in runs], pa.binary())})


def _marked(p: SubstringParams, blob: bytes, got) -> tuple:
    """The chunk's rows, word bounds and the mask of words to remove."""
    batch, first, h = _words_of(blob)
    if not got.is_valid:
        return batch, first, np.zeros(len(h), bool)
    repeated = np.sort(np.concatenate([C.unpack(g["data"]) for g in got.as_py()]))
    starts = W.window_rows(first, p.window)
    starts = starts[C.member(repeated, W.windows(h, p.window)[starts])]
    return batch, first, W.covered(len(h), starts, starts + p.window)


def _rounds(rows: DataFrame, p: SubstringParams) -> DataFrame:
    """Chunks of rows with the windows that are repeated in each."""
    chunks, total = C.chunked(rows, "chunks")
    n = C.shards(total)
    probes = chunks.select("chunk", "blob").mapInArrow(_probe(p, n), "shard bigint, chunk bigint, data binary")
    hits = written(probes.groupBy("shard").applyInArrow(_hits, "chunk bigint, shard bigint, data binary"), "hits", "none")
    possible = C.answered(chunks.select("chunk", "blob"), hits).mapInArrow(_candidates(p, n), "shard bigint, chunk bigint, data binary, more binary")
    repeats = written(possible.groupBy("shard").applyInArrow(_repeated, "chunk bigint, shard bigint, data binary"), "repeats", "none")
    return C.answered(chunks.select("chunk", "blob"), repeats)


def repeats(docs: DataFrame, p: SubstringParams = SubstringParams()) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256 (of the words that stay, joined by one space) and the
    maximal repeats as an array of word spans (from, to)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for blob, got in zip(batch.column("blob"), batch.column("got"), strict=True):
                part, first, gone = _marked(p, blob.as_py(), got)
                shas, spans = [], []
                removed = W.row_sums(gone, first)
                for k, text in enumerate(part.column("text").to_pylist()):
                    words = (text or "").encode().split()
                    if removed[k]:
                        mask = gone[first[k] : first[k + 1]]
                        words = [w for w, g in zip(words, mask.tolist(), strict=True) if not g]
                        spans.append(np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist())
                    else:
                        spans.append([])
                    shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, pa.list_(pa.int64()))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return _rounds(rows, p).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<bigint>")


def without_repeats(docs: DataFrame, p: SubstringParams = SubstringParams()) -> DataFrame:
    """docs with repeated passages removed from text (other texts stay as they are); n_chars, if there as a whole number, follows."""
    ship(docs.sparkSession)
    names = docs.columns

    def run(batches):
        for batch in batches:
            for blob, got in zip(batch.column("blob"), batch.column("got"), strict=True):
                part, first, gone = _marked(p, blob.as_py(), got)
                removed = W.row_sums(gone, first)
                texts = part.column("text").to_pylist()
                for k in np.flatnonzero(removed).tolist():
                    mask = gone[first[k] : first[k + 1]].tolist()
                    texts[k] = b" ".join(w for w, g in zip(texts[k].encode().split(), mask, strict=True) if not g).decode()
                columns = {c: part.column(c) for c in names}
                columns["text"] = pa.array(texts, pa.string())
                if "n_chars" in columns and len(texts) and pa.types.is_integer(part.column("n_chars").type):
                    old = part.column("n_chars").to_pylist()
                    columns["n_chars"] = pa.array([len(t) if r else o for t, r, o in zip(texts, removed.tolist(), old, strict=True)], part.column("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return _rounds(docs, p).mapInArrow(run, docs.schema)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


ORACLE_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select r, s, md5(array_to_string(ws[s:s + 34], ' ')) as g from (select r, ws, unnest(generate_series(1, len(ws) - 34)) as s from d where len(ws) >= 35)),
rep as (select g from w group by g having count(*) > 1),
gone as (select distinct r, unnest(generate_series(s, s + 34)) as k from w semi join rep using (g)),
kept as (select r, doc_id, k, wd from (select r, doc_id, unnest(generate_series(1, len(ws))) as k, unnest(ws) as wd from d) x anti join gone using (r, k)),
j as (select r, count(*) as n, string_agg(wd, ' ' order by k) as t from kept group by r)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join j using (r)
"""
