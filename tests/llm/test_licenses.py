import math

import pytest

from tests.llm.helpers import alnum, edge_rows, prose, table
from thicket.llm import licenses as K

ROWS = edge_rows() + [
    (20, prose(1, 30) + "\nReleased under the MIT License.\n" + prose(2, 30)),
    (21, "This work is licensed under the GNU General Public License, version 3. All rights reserved."),
    (22, "All rights\nreserved! " + prose(3, 20) + " CC-BY, cc by and cc  BY 4.0"),
    (23, "mit " + prose(4, 20) + " license released"),
    (24, "Licensed under CC BY-NC 4.0."),
    (25, "all all rights reserved general public general public license"),
    (26, "rights reserved"),
    (27, "Licensed under the Apache License, Version 2.0 and licensed under the Apache License, Version 2.0"),
]


def plain(t):
    w = alnum(t)
    at = [(k, label) for phrase, label in K.BASE for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
    places = [k for k, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_base_equals_brute_force(spark):
    got = K.license_scan(table(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    for r, (d, t, *_) in zip(got, ROWS, strict=True):
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (d, *plain(t))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_template_labels(spark):
    got = {r.doc_id: r for r in K.license_scan(table(spark, ROWS)).collect()}
    assert got[20].labels == "mit" and got[20].score == 1
    assert got[21].labels == "gpl,gpl-3.0,reserved" and got[24].labels == "cc-by,cc-by-nc-4.0"
    assert got[27].labels == "apache-2.0" and got[23].labels == "" and got[4].score == 0


def by_alignment(t, p=K.LicenseParams()):
    """Every template at every start, word by word: labels and the best share that is enough."""
    w = alnum(t)
    labels, score = set(filter(None, plain(t)[4].split(","))), 0
    texts = [x.text.split() for x in p.templates]
    idf = {v: math.log((len(texts) + 1) / sum(v in y for y in texts)) for y in texts for v in y}
    for x, own in zip(p.templates, texts, strict=True):
        total = sum(idf[v] for v in own)
        for s in range(-len(own) + 1, len(w)):
            share = sum(idf[v] for i, v in enumerate(own) if 0 <= s + i < len(w) and w[s + i] == v) / total
            if share >= p.accept:
                score = max(score, share)
                span = range(max(s, 0), min(s + len(own), len(w)))
                if any(w[k : k + len(y)] == y for key in x.key for y in [key.split()] for k in span):
                    labels.add(x.label)
    return ",".join(sorted(labels)), score


def scattered(k, t):
    """The template without its four rarest words, which stand elsewhere."""
    own = t.text.split()
    texts = [x.text.split() for x in K.TEMPLATES]
    rare = set(sorted(set(own), key=lambda v: (sum(v in y for y in texts), v))[:4])
    return " ".join(sorted(rare)) + " " + prose(k, 3) + " " + " ".join("other" if v in rare else v for v in own)


def test_index_equals_trying_every_alignment(spark):
    rows = ROWS + [(60 + k, f"{prose(k, 5)} {t.text[k:]} {t.text[: 40 + k]} {prose(k, 4)} {' '.join(t.text.split()[::2])}") for k, t in enumerate(K.TEMPLATES)]
    rows += [(200 + k, scattered(k, t)) for k, t in enumerate(K.TEMPLATES)]
    rows = [r for r in rows if r[1] is None or len(r[1]) < 5000]
    found = 0
    for r, (_, t, *_) in zip(K.license_scan(table(spark, rows)).collect(), rows, strict=True):
        labels, score = by_alignment(t)
        assert r.labels == labels and r.score == pytest.approx(score, abs=1e-6)
        found += (r.doc_id or 0) >= 200 and r.score >= 0.6
    assert found >= 5


def test_whole_texts(spark):
    """Each whole text is found with its own label, wrapped in comments and with a holder's name in between."""
    rows = []
    for k, t in enumerate(K.TEMPLATES):
        w = t.text.split()
        lines = [" * " + " ".join(w[a : a + 11]) for a in range(0, len(w), 11)]
        rows.append((k, "/*\n * Copyright (c) 2020 Some One\n" + "\n".join(lines) + "\n */\n" + prose(k, 50)))
    for r, t in zip(K.license_scan(table(spark, rows)).collect(), K.TEMPLATES, strict=True):
        assert t.label in r.labels.split(",") and r.score > 0.99


def test_empty(spark):
    assert K.license_scan(table(spark, [])).count() == 0
