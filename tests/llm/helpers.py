"""Small tables with the cases that every operator must handle, and plain versions of word rules."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_words bigint, chunk string, held_out string, rep string, _kept string, quality_score string"
EXTRA = (1.5, 7, "c", "h", "r", "k", "q")


def table(spark, rows):
    """rows: (doc_id, text[, source]); further columns clash with names that operators use inside."""
    return spark.createDataFrame([(d, t, "en", s[0] if s else "s", None if t is None else len(t), *EXTRA) for d, t, *s in rows], SCHEMA)


def words_of(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def prose(seed, n, vocabulary=400):
    return " ".join(words_of(seed, n, vocabulary))


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows and ties."""
    return [
        (None, "a null id has words"),
        (None, None),
        (1, None, None),
        (2, ""),
        (3, " \n\t "),
        (4, prose(4, 60_000)),
        (5, "same text here, five words and more"),
        (6, "same text here, five words and more"),
        (7, "repeated row"),
        (7, "repeated row"),
        (8, "Grüße, señor! ÀÉ № 42 — “quoted” \U0001f600 end"),
        (9, "x" * 70_000),
        (10, "UPPER lower\r\nlines\x0band\x0ctabs\tend"),
    ]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
