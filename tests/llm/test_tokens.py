import functools
import math

import pytest

from tests.llm.helpers import edge_rows, prose, table, tokens
from thicket.llm import tokens as T

model = T.load_unigram()


def viterbi(word, m):
    """Best segmentation, from the left, over all cuts."""
    text = T.LEAD + word
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(text)
    for e in range(1, len(text) + 1):
        options = [(best[b][0] + m.pieces[text[b:e]], best[b][1] + 1) for b in range(max(0, e - 64), e) if text[b:e] in m.pieces]
        if text[e - 1] not in m.pieces:
            n = len(text[e - 1].encode())
            options.append((best[e - 1][0] + n * m.byte_score, best[e - 1][1] + n))
        best[e] = max(options, key=lambda x: (x[0], -x[1]))
    return best[-1][1]


def test_trie_equals_each_word_alone():
    words = sorted({*tokens(prose(1, 300)), *"the theme thematic them then internationalization Grüße № 𝔘nicode aaaa aaaaaa zzzzzzzzzz".split()})
    prefixes = {T.LEAD + w[:k] for w in words for k in range(len(w) + 1)}
    for scored in (T.trie_counts, T.walk):
        counts, nodes = scored(words, model)
        assert list(counts) == [viterbi(w, model) for w in words]
        assert nodes == len(prefixes)  # each trie node once


def test_ties_long_words_and_characters_without_a_piece():
    small = T.Unigram({T.LEAD: -1.0, "a": -2.0, "aa": -4.0, "ab": -3.0, "b": -1.0, T.LEAD + "aab": -6.0}, -3.0)
    words = sorted(["a", "aa", "aab", "aabb", "ab" * 80, "a" * 200, "b\u00e9", "\u20ac", "\U0001f600a", "x" * 64, "x" * 65])
    assert list(T.trie_counts(words, small)[0]) == [viterbi(w, small) for w in words] == T.walk(words, small)[0]
    assert list(T.trie_counts([], small)[0]) == []


def test_edge_cases(spark):
    rows = edge_rows()
    got = T.token_counts(table(spark, rows)).collect()
    best = functools.cache(lambda x: viterbi(x, model))
    for r, (d, t, *_) in zip(got, rows, strict=True):
        w = tokens(t)
        assert (r.doc_id, r.n_words) == (d, len(w))
        assert r.n_tokens == sum(map(best, w))
    assert T.token_counts(table(spark, [])).count() == 0


def test_a_small_cache_changes_nothing(spark):
    rows = [(k, prose(k, 200, 5000)) for k in range(30)]
    a, b = (sorted(map(tuple, T.token_counts(table(spark, rows), cache=c).collect())) for c in (10, 300_000))
    assert a == b


@pytest.mark.parametrize("text", ["", " ", "\t\n"])
def test_blank(spark, text):
    assert tuple(T.token_counts(table(spark, [(1, text)])).first()) == (1, 0, 0)
