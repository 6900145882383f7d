"""Token ids as flat binary files that are memory-mapped, in the order of the documents.

A corpus is a folder of parts. A part has three files: `.bin`, the ids of its documents one behind the other as unsigned
little-endian integers (16 bits if the vocabulary allows it, else 32); `.idx`, the unsigned 64-bit offsets (in ids) at which its
documents begin, and its end; `.keys`, an Arrow stream of the documents' other columns. A Parquet table `manifest` beside them lists the
parts in order, with the ids and documents before each: prefix sums over the parts, in two levels, so that no task sees more
than some thousand parts. `TokenFiles` maps parts into memory and gives any document, or any window of ids across parts.

Documents are dealt to parts by ranges of their key, and by the hash and place of the row behind it, so a key that a third of the
rows share is divided. A task encodes its rows in order and appends them to its part; what it holds is a slice of some MB of
text. Every attempt of a task writes files of its own, and the manifest names those of the attempts that Spark counts, so
lost executors and speculative attempts leave no trace in the corpus.

Words: with `by_word`, a text is encoded as its words between ASCII white space, each distinct word once, and letters apart
from the punctuation behind them. That is the same for a tokenizer that drops white space, joins nothing across it and parts letters from
punctuation, as that of `VOCABULARY`; without `by_word` whole texts are encoded. Encoded words are kept between batches, up to `cache`.

Defined cases: null and empty texts are documents of the end id alone. Null keys come first; rows that share a key are
in the order of their texts' hashes, and equal texts are alike whatever their order. Very long texts are whole; of a
single long word nothing is cut. Extra columns are dropped, or kept as keys if named; an empty table gives an empty manifest.
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm import _words as W
from thicket.llm._store import delete_on_exit, shared_dir, written
from thicket.session import ship

VOCABULARY = "word_bpe_49k.json"
#: Words that are encoded in one go stand between these; the mark is a token of its own, and words that hold it go alone.
_MARK = "~"
_BUNDLE = 512
_PUNCTUATION = ".,;:!?"
#: Bytes of text that are encoded at once.
SLICE = 8 << 20
_ENCODERS: dict[tuple, Encoder] = {}


@dataclass(frozen=True)
class TokenParams:
    vocabulary: str | None = None  # path of a tokenizers file; None: VOCABULARY of the public ones
    end_id: int = 2
    by_word: bool = True
    part_bytes: int = 32 << 20  # of text in a part
    cache: int = 1_000_000  # words

    def path(self) -> str:
        if self.vocabulary:
            return self.vocabulary
        import public_tokenizers

        return public_tokenizers.path(VOCABULARY)


class Encoder:
    """A tokenizer with a memory of words."""

    def __init__(self, p: TokenParams):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        self.p = p
        self.tokenizer = Tokenizer.from_file(p.path())
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size() - 1, p.end_id) < 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        mark = self.ids(_MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = None  # of each id, whether it ends a word
        if suffix:
            self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bundles(self, words: list[str], between: str):
        """Words encoded in one text, many at once: (words, ids)."""
        bundles = [words[k : k + _BUNDLE] for k in range(0, len(words), _BUNDLE)]
        done = self.tokenizer.encode_batch_fast([between.join(b) for b in bundles], add_special_tokens=False)
        return ((b, np.array(e.ids, self.dtype)) for b, e in zip(bundles, done, strict=True))

    def learn(self, words: list[str]) -> None:
        """Encodes words into the memory. A word of letters gives one ending id at least, so in a bundle with as many ending ids as words each
        word ends at one. Of other words, the ids between two marks are those of a word. A word whose bundle doesn't fit goes alone."""
        size = self.dtype.itemsize
        rest = words
        if self.last is not None:
            rest = [w for w in words if not w.isalpha()]
            for bundle, got in self._bundles([w for w in words if w.isalpha()], " "):
                at = np.flatnonzero(self.last[got]) + 1
                if len(at) != len(bundle) or at[-1] != len(got):
                    rest += bundle
                    continue
                data, at = got.tobytes(), [0, *(at * size).tolist()]
                self.known.update((w, data[a:b]) for w, a, b in zip(bundle, at[:-1], at[1:], strict=True))
        alone = rest
        if self.mark is not None:
            alone = [w for w in rest if _MARK in w]
            for bundle, got in self._bundles([w for w in rest if _MARK not in w], f" {_MARK} "):
                at = np.flatnonzero(got == self.mark)
                if len(at) != len(bundle) - 1:
                    alone += bundle
                    continue
                data = got.tobytes()
                self.known.update((w, data[a:b]) for w, a, b in zip(bundle, [0, *((at + 1) * size).tolist()], [*(at * size).tolist(), len(data)], strict=True))
        for w in alone:
            self.known[w] = np.array(self.ids(w), self.dtype).tobytes()

    def codes(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words. The memory is two generations: when the younger is full it takes the place of the older, so words in use stay."""
        if len(self.known) > self.p.cache // 2:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        out = list(map(known.get, words))
        lacking = [k for k, c in enumerate(out) if c is None]
        for k in lacking:
            if words[k] in older:
                known[words[k]] = older[words[k]]
        fresh = [words[k] for k in lacking if words[k] not in known]
        cores = [w.rstrip(_PUNCTUATION) for w in fresh]
        ended = {w: c for w, c in zip(fresh, cores, strict=True) if len(c) < len(w) and _letters(c)}
        new = {w for w in fresh if w not in ended} | {x for w, c in ended.items() for x in (c, w[len(c) :])}
        self.learn([w for w in new if w not in known])
        known.update((w, known[c] + known[w[len(c) :]]) for w, c in ended.items())
        for k in lacking:
            out[k] = known[words[k]]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind it, and the n+1 offsets."""
        if not self.p.by_word:
            rows = [np.array([*e.ids, self.p.end_id], self.dtype) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return (np.concatenate(rows) if rows else np.zeros(0, self.dtype)), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        raw, offs = W.text_bytes(texts)
        first, _, starts, ends = W.split_words(raw, offs, W.IS_TOKEN, spans=True)
        at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        data = np.ascontiguousarray(raw[W.IS_TOKEN[raw]])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = self.codes(distinct)
        size = np.fromiter(map(len, codes), np.int64, len(codes)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(codes), self.dtype)
        begin = np.cumsum(size) - size
        index = words.indices.to_numpy(zero_copy_only=False)
        n = size[index] if len(index) else np.zeros(0, np.int64)
        of_rows = W.row_sums(n, first)
        offsets = np.concatenate([[0], np.cumsum(of_rows + 1)]).astype(np.int64)
        out = np.full(int(offsets[-1]), self.p.end_id, self.dtype)
        if len(index):
            row = np.repeat(np.arange(len(of_rows)), np.diff(first))
            to = np.cumsum(n) - n + row  # each document before has added one end id
            out[W.ranges(to, to + n)] = flat[W.ranges(begin[index], begin[index] + n)]
        return out, offsets


def _letters(word: str) -> bool:
    """Whether a word is of letters, and still is when it is composed and lower-cased: a mark that comes off would join the punctuation behind it."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


def encoder(p: TokenParams) -> Encoder:
    """The encoder of this Python worker: it outlives a task, and so do the words it knows."""
    if p not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[p] = Encoder(p)
    return _ENCODERS[p]


def _at(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write(docs: DataFrame, folder: str, p: TokenParams = TokenParams(), key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encodes docs into the folder (a URI that executors can write to) and gives the manifest: part, name, n_docs, n_ids, docs_before, ids_before, dtype."""
    spark = docs.sparkSession
    ship(spark)
    names = [key, *keep]
    rows = docs.select(*names, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    if len(set(names) | {"_text", "_hash", "_place"}) < len(names) + 3:
        raise ValueError("columns _text, _hash and _place can't be kept")
    n = rows.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    order = [F.col(key).asc_nulls_first(), F.col("_hash").asc(), F.col("_place").asc()]
    dealt = rows.withColumns({"_hash": F.xxhash64("_text"), "_place": F.monotonically_increasing_id()}).repartitionByRange(max(1, -(-n // p.part_bytes)), *order).sortWithinPartitions(*order)
    dealt = dealt.select(*names, "_text")
    keys = pa.schema([pa.field(f.name, a.type) for f, a in zip(dealt.select(*names).schema, _arrow(dealt.select(*names)), strict=True)])

    def run(batches):
        store, base = _at(folder)
        store.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:08d}-{uuid.uuid4().hex}"
        enc = encoder(p)
        total = documents = 0
        with store.open_output_stream(f"{base}/{name}.bin") as ids, store.open_output_stream(f"{base}/{name}.idx") as idx, store.open_output_stream(f"{base}/{name}.keys") as k, pa.ipc.new_stream(k, keys) as key_rows:
            idx.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                for piece in W.slices(batch, SLICE, "_text"):
                    out, offsets = enc.encode(piece.column("_text"))
                    ids.write(out.tobytes())
                    idx.write((offsets[1:] + total).astype("<u8").tobytes())
                    key_rows.write_batch(pa.RecordBatch.from_arrays([piece.column(c).cast(keys.field(c).type) for c in names], schema=keys))
                    total, documents = total + len(out), documents + piece.num_rows
        if documents:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([documents]), pa.array([total]), pa.array([enc.dtype.str])], names=["part", "name", "n_docs", "n_ids", "dtype"])
        else:
            for end in ("bin", "idx", "keys"):
                store.delete_file(f"{base}/{name}.{end}")

    parts = written(dealt.mapInArrow(run, "part bigint, name string, n_docs bigint, n_ids bigint, dtype string"), "parts")
    manifest = with_bases(parts)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def _arrow(df: DataFrame) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(df.schema))


def with_bases(parts: DataFrame, block: int = 4096) -> DataFrame:
    """parts with docs_before and ids_before: sums over the parts before, first by blocks of parts, then within a block."""
    parts = parts.withColumn("block", F.floor(F.col("part") / block))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    sums = parts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_ids").alias("i"))
    sums = sums.select("block", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_base") for c in "di"))
    within = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = {f"{n}_before": F.coalesce(F.sum(f"n_{n}").over(within), F.lit(0)) + F.col(f"{n[0]}_base") for n in ("docs", "ids")}
    return parts.join(sums, "block").withColumns(before).select("part", "name", "n_docs", "n_ids", "docs_before", "ids_before", "dtype")


class Part:
    """One part: ids and offsets mapped into memory where the store is a file system, else fetched."""

    def __init__(self, folder: str, name: str, dtype: str):
        self.store, self.base, self.name = *_at(folder), name
        self.ids, self.offsets = self._array("bin", np.dtype(dtype)), self._array("idx", np.dtype("<u8"))

    def _array(self, end: str, dtype: np.dtype) -> np.ndarray:
        path = f"{self.base}/{self.name}.{end}"
        if isinstance(self.store, fs.LocalFileSystem):
            return np.memmap(path, dtype, "r")
        with self.store.open_input_stream(path) as f:
            return np.frombuffer(f.read(), dtype)

    def keys(self):
        """Batches of the documents' keys."""
        with self.store.open_input_stream(f"{self.base}/{self.name}.keys") as f, pa.ipc.open_stream(f) as rows:
            yield from rows

    def document(self, k: int) -> np.ndarray:
        return self.ids[int(self.offsets[k]) : int(self.offsets[k + 1])]


class TokenFiles:
    """A corpus for training loops: documents and windows of ids by their number."""

    def __init__(self, folder: str, manifest: list):
        """manifest: the rows of `write` (or of the folder's manifest table) in any order."""
        self.folder, self.rows = folder, sorted(manifest, key=lambda r: r["part"])
        self.docs = np.array([r["docs_before"] for r in self.rows] + [sum(r["n_docs"] for r in self.rows)], np.int64)
        self.first = np.array([r["ids_before"] for r in self.rows] + [sum(r["n_ids"] for r in self.rows)], np.int64)
        self.parts: dict[int, Part] = {}

    def __len__(self) -> int:
        return int(self.docs[-1])

    def part(self, k: int) -> Part:
        if k not in self.parts:
            self.parts[k] = Part(self.folder, self.rows[k]["name"], self.rows[k]["dtype"])
        return self.parts[k]

    def __getitem__(self, doc: int) -> np.ndarray:
        if not 0 <= doc < len(self):
            raise IndexError(doc)
        k = int(np.searchsorted(self.docs, doc, "right")) - 1
        return self.part(k).document(doc - int(self.docs[k]))

    def window(self, start: int, length: int) -> np.ndarray:
        """Ids start .. start+length-1 of the whole corpus."""
        out, at, stop = [], start, min(start + length, int(self.first[-1]))
        while at < stop:
            k = int(np.searchsorted(self.first, at, "right")) - 1
            to = min(stop, int(self.first[k + 1]))
            out.append(self.part(k).ids[at - int(self.first[k]) : to - int(self.first[k])])
            at = to
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def documents(manifest: DataFrame, folder: str, key_type: str = "bigint", key: str = "doc_id") -> DataFrame:
    """Reads the files back, a part in a task: key, start, n_tokens and ids_crc32 of every document."""
    ship(manifest.sparkSession)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                part, k = Part(folder, r["name"], r["dtype"]), 0
                if int(part.offsets[-1]) != r["n_ids"] or len(part.offsets) != r["n_docs"] + 1 or len(part.ids) != r["n_ids"]:
                    raise ValueError(f"{r['name']} isn't what the manifest says")
                for rows in part.keys():
                    at = part.offsets[k : k + rows.num_rows + 1].astype(np.int64)
                    crc = [zlib.crc32(part.ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(at[:-1] + r["ids_before"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])
                    k += rows.num_rows

    n = max(1, manifest.count())
    spread = manifest.repartition(min(n, 1 << 14), "part")
    return spread.mapInArrow(run, f"`{key}` {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op11_token_files(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/thicket-tokens-{uuid.uuid4().hex}"
    delete_on_exit(spark, folder)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return documents(write(docs, folder), folder)
