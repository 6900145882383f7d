"""Token counts by trie-shared dynamic programming.

Texts are cut into pre-tokens (runs of characters that aren't space, each led by U+2581), and a pre-token into the
pieces of a public vocabulary with the largest sum of log probabilities (unigram segmentation). The vocabulary file is
read, never trained: a piece's probability is Zipf's, one over its rank in the file.

The distinct pre-tokens of a batch are inserted in a trie of arrays, a level at a time: a node has its parent, its character, the
hash of its prefix, and its forward score and tokens, so a prefix that many pre-tokens share is scored once. The pieces that end
at the nodes of a level are looked up for all of them at once, by the hashes of the nodes and of their ancestors. The count at a
terminal node is the pre-token's; documents add up the counts of their pre-tokens in numpy. Counts of recent
pre-tokens are kept between batches, `cache` of them. Pre-tokens of more than `LONGEST` characters, whose levels would have few
nodes, take a depth-first walk in sorted order instead, with the scores of the current path on a stack.

A character that no piece covers falls back to its UTF-8 bytes, one token each. Among equal scores fewer tokens win.

Defined cases: null and empty texts have 0 words and tokens; a null doc_id stays null; repeated rows give repeated
results; extra columns are dropped; an empty table gives an empty one. Long texts are hashed piece by piece.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import _words as W
from thicket.session import ship

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LEAD = "▁"
#: Characters of a pre-token that goes into the trie of arrays.
LONGEST = 64
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.multiply.accumulate(np.array([1] + [_BASE] * 64, U64))


def _key(h: np.ndarray, n: int) -> np.ndarray:
    """The key of a piece of n characters with a rolling hash; never 0."""
    return W.mix(h ^ U64(n * 0xD6E8FEB86659FD93 % (1 << 64))) | U64(1)


@dataclass
class Unigram:
    """Log probabilities of pieces, and that of a byte of a character that no piece covers."""

    pieces: dict[str, float]
    byte_score: float
    lengths: dict[str, tuple[int, ...]] = field(init=False)  # lengths of the pieces that end in a character
    ends: np.ndarray = field(init=False)  # the same for each code point, as bits
    slots: np.ndarray = field(init=False)  # an open hash table of pieces: hashes (0: free), and scores
    scores: np.ndarray = field(init=False)

    def __post_init__(self):
        by_last: dict[str, set[int]] = {}
        for piece in self.pieces:
            by_last.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {c: tuple(sorted(n)) for c, n in by_last.items()}
        self.ends = np.zeros(0x110000, U64)
        for c, n in by_last.items():
            self.ends[ord(c)] = sum(1 << k for k in n if k < 64)
        self.slots = np.zeros(1 << max(4, (len(self.pieces) * 8).bit_length()), U64)
        self.scores = np.zeros(len(self.slots))
        for piece, p in self.pieces.items():
            if len(piece) < 64:
                h = 0
                for c in piece:
                    h = (h * _BASE + ord(c) + 1) % (1 << 64)
                key = int(_key(np.array([h], U64), len(piece))[0])
                at = key % len(self.slots)
                while self.slots[at]:
                    at = (at + 1) % len(self.slots)
                self.slots[at], self.scores[at] = key, p

    def find(self, key: np.ndarray) -> np.ndarray:
        """Scores of pieces by their keys; minus infinity where there is none."""
        out = np.full(len(key), -np.inf)
        open_, at = np.arange(len(key)), key & U64(len(self.slots) - 1)
        while len(open_):
            there = self.slots[at]
            hit = there == key[open_]
            out[open_[hit]] = self.scores[at[hit]]
            on = ~hit & (there != 0)
            open_, at = open_[on], (at[on] + U64(1)) & U64(len(self.slots) - 1)
        return out

    def step(self, text: str, end: int, score: list[float], count: list[int]) -> tuple[float, int]:
        """Best score and tokens of text[:end], from those of all shorter prefixes."""
        last = text[end - 1]
        best, tokens = -math.inf, 0
        for n in self.lengths.get(last, ()):
            if n > end:
                break
            p = self.pieces.get(text[end - n : end])
            if p is not None:
                s = score[end - n] + p
                if s > best or (s == best and count[end - n] + 1 < tokens):
                    best, tokens = s, count[end - n] + 1
        if 1 not in self.lengths.get(last, ()):
            n = len(last.encode())
            s = score[end - 1] + n * self.byte_score
            if s > best:
                best, tokens = s, count[end - 1] + n
        return best, tokens


def load_unigram(path: str = VOCABULARY) -> Unigram:
    """Pieces of a sentencepiece file in the order of their scores; control, unknown and byte pieces left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    ids.sort(key=lambda i: (-sp.get_score(i), i))
    total = math.log(sum(1 / (k + 1) for k in range(len(ids))))
    pieces = {sp.id_to_piece(i): -math.log(k + 1) - total for k, i in enumerate(ids)}
    return Unigram(pieces, min(pieces.values()) - math.log(256))


def walk(words: list[str], model: Unigram) -> tuple[list[int], int]:
    """Tokens of each word of a sorted list of distinct words, depth first; and the trie nodes scored."""
    if not words:
        return [], 0
    score, count = [0.0], [0]
    s, c = model.step(LEAD, 1, score, count)
    score, count = [0.0, s], [0, c]
    before, out, nodes = "", [], 1
    for word in words:
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del score[shared + 2 :], count[shared + 2 :]
        text = LEAD + word
        for end in range(shared + 2, len(text) + 1):
            s, c = model.step(text, end, score, count)
            score.append(s)
            count.append(c)
            nodes += 1
        out.append(count[-1])
        before = word
    return out, nodes


def _levels(words: list[str], model: Unigram) -> tuple[np.ndarray, int]:
    """The same as `walk`, for words of at most LONGEST characters: the trie level by level."""
    out = np.zeros(len(words), np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size) - size
    widest = min(63, max(map(len, model.pieces), default=0))
    # of each level: hash of the prefix, best score, its tokens, the parent's number in the level above
    hashes, scores, tokens, parents = [np.zeros(1, U64)], [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    live, node, nodes = np.arange(len(words)), np.zeros(len(words), np.int64), 0
    for level in range(1, LONGEST + 2):
        if level > 1:
            live = live[size[live] >= level - 1]
        if not len(live):
            break
        char = codes[begin[live] + level - 2] if level > 1 else np.full(len(live), ord(LEAD), np.uint32)
        above = node[live]
        new = np.concatenate([[True], (above[1:] != above[:-1]) | (char[1:] != char[:-1])])
        node[live] = np.cumsum(new) - 1
        up, char = above[new], char[new]
        nodes += len(up)
        h = hashes[-1][up] * U64(_BASE) + char.astype(U64) + U64(1)
        best, count = np.full(len(up), -np.inf), np.zeros(len(up), np.int64)
        ends, at = model.ends[char], up
        for n in range(1, min(level, widest) + 1):
            k = np.flatnonzero((ends >> U64(n)) & U64(1))
            if len(k):
                s = scores[-n][at[k]] + model.find(_key(h[k] - hashes[-n][at[k]] * _POWERS[n], n))
                c = tokens[-n][at[k]] + 1
                better = (s > best[k]) | ((s == best[k]) & (s > -np.inf) & (c < count[k]))
                best[k[better]], count[k[better]] = s[better], c[better]
            if n < level:
                at = parents[-n][at]
        k = np.flatnonzero(((ends >> U64(1)) & U64(1)) == 0)
        width = 1 + (char[k] > 0x7F) + (char[k] > 0x7FF).astype(np.int64) + (char[k] > 0xFFFF)
        s = scores[-1][up[k]] + width * model.byte_score
        better = s > best[k]
        best[k[better]], count[k[better]] = s[better], (tokens[-1][up[k]] + width)[better]
        for column, values in ((hashes, h), (scores, best), (tokens, count), (parents, up)):
            column.append(values)
            if len(column) > widest + 1:
                del column[0]
        done = live[size[live] == level - 1]
        out[done] = count[node[done]]
    return out, nodes


def trie_counts(words: list[str], model: Unigram) -> tuple[np.ndarray, int]:
    """Tokens of each word of a sorted list of distinct words; and the trie nodes scored."""
    short = np.fromiter((len(w) <= LONGEST for w in words), bool, len(words))
    out = np.zeros(len(words), np.int64)
    out[short], nodes = _levels([w for w, s in zip(words, short.tolist(), strict=True) if s], model)
    out[~short], more = walk([w for w, s in zip(words, short.tolist(), strict=True) if not s], model)
    return out, nodes + more


def batch_counts(texts: pa.Array, model: Unigram, cache: dict[bytes, int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each text."""
    raw, offs = W.text_bytes(texts)
    first, h, starts, ends = W.split_words(raw, offs, W.IS_TOKEN, spans=True)
    order = np.argsort(h, kind="stable")
    sorted_ = h[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(h) else np.zeros(0, bool)
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.cumsum(new) - 1
    some = order[new]
    data = raw.tobytes()
    words = [data[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
    if len(cache) + len(words) > most:
        cache.clear()
    fresh = sorted({w for w in words if w not in cache})
    counts, _ = trie_counts([w.decode() for w in fresh], model)  # the order of UTF-8 bytes is that of code points
    cache.update(zip(fresh, counts.tolist(), strict=True))
    per_word = np.fromiter((cache[w] for w in words), np.int64, len(words))
    return np.diff(first), W.row_sums(per_word[inverse] if len(h) else np.zeros(0, np.int64), first)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, cache: int = 300_000) -> DataFrame:
    """doc_id, n_words (pre-tokens) and n_tokens of every document. Nothing is shuffled."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(load_unigram(vocabulary))  # one vocabulary file: some 32,000 pieces

    def run(batches):
        seen: dict[bytes, int] = {}
        for batch in batches:
            for part in W.slices(batch, 4 << 20):
                words, tokens = batch_counts(part.column("text"), model.value, seen, cache)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
