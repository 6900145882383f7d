"""License scans by a positional index of rare words.

The index holds, for each word of the licence templates, the templates and positions it stands at, and its IDF over the
templates. Templates are whole texts of the short licences, the notices that files carry for the long ones, and one-line
mentions. A template comes into question for a file whose words could make up `accept` of its IDF weight. Of its words
that the file has, those with the highest IDF are looked up, one after the other until what the rest weighs is below `accept`; so an alignment that
reaches `accept` agrees in one of them at least, and none is missed. Their postings, shifted by the positions in the file, are
intersected: each (template, start) that they point at is an alignment, whose other words are compared at the same
relative positions. An alignment counts if the IDF-weighted share of its words that agree is `accept` or more and
one of the template's mandatory key phrases stands there whole. score: the largest share of an alignment that reaches `accept`, else 0. Words of equal IDF
are looked up in the order of the words; that doesn't change what is found.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased. Base phrases are found wherever their words
stand consecutively, and keep their labels whatever the templates say.

Defined cases: a null or empty text has no words, labels '' and score 0; first_word and last_word are null without a base
phrase; a null doc_id stays null; repeated rows give repeated results; extra columns are dropped; an empty table gives an
empty one. Whole texts are read, piece by piece; rows are independent and nothing is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import _words as W
from thicket.session import ship

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: tuple[str, ...]


# Public licence texts, in words of the pattern above.
_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_MIT = f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_WARRANTY}"
_BSD_OPEN = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_THIRD = "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_CLOSE = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_ZLIB = "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"
_UNLICENSE = "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"
_BOOST = "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part"
_APACHE = "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
_MPL = "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"


def _gnu(name: str, version: str) -> str:
    """The notice of a GNU licence of that name and version."""
    license_ = f"gnu {name} general public license".replace("  ", " ")
    return f"this program is free software you can redistribute it and or modify it under the terms of the {license_} as published by the free software foundation either version {version} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {license_} for more details you should have received a copy of the {license_} along with this program if not see https www gnu org licenses"


TEMPLATES = (
    Template("mit", _MIT, ("permission is hereby granted free of charge to any person obtaining a copy of this software",)),
    Template("bsd", f"{_BSD_OPEN} {_BSD_CLOSE}", ("redistribution and use in source and binary forms",)),
    Template("bsd", f"{_BSD_OPEN} {_BSD_THIRD} {_BSD_CLOSE}", ("redistribution and use in source and binary forms",)),
    Template("isc", _ISC, ("permission to use copy modify",)),
    Template("zlib", _ZLIB, ("must not be misrepresented",)),
    Template("unlicense", _UNLICENSE, ("free and unencumbered software",)),
    Template("bsl-1.0", _BOOST, ("use reproduce display distribute execute and transmit the software",)),
    Template("apache-2.0", _APACHE, ("apache license version 2",)),
    Template("mpl-2.0", _MPL, ("mozilla public license v 2",)),
    *(Template(f"gpl-{v}.0", _gnu("", v), (f"version {v} of the license",)) for v in ("2", "3")),
    *(Template(label, _gnu(name, v), (f"{name} general public license",)) for label, name, v in (("lgpl", "lesser", "2 1"), ("lgpl", "lesser", "3"), ("agpl", "affero", "3"))),
    # one-line mentions, as files and pages have them
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge to any person obtaining a copy of this software",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3", "general public license v3")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2", "general public license v2")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    Template("proprietary", "copyright all rights reserved unauthorized copying is prohibited", ("all rights reserved",)),
)


@dataclass(frozen=True)
class LicenseParams:
    templates: tuple[Template, ...] = TEMPLATES
    base: tuple[tuple[str, str], ...] = BASE
    accept: float = 0.6


class Index:
    """Word numbers, postings by relative position and IDF weights of the templates."""

    def __init__(self, p: LicenseParams = LicenseParams()):
        self.p = p
        texts = [t.text for t in p.templates]
        words = sorted({w for t in [*texts, *(k for x in p.templates for k in x.key), *(b for b, _ in p.base)] for w in t.split()})
        raw, offs = W.text_bytes(pa.array(words))
        _, h = W.split_words(raw, offs, W.IS_ALNUM, W.LOWER)
        order = np.argsort(h)
        self.hashes = h[order]
        self.number = {words[k]: i for i, k in enumerate(order.tolist())}
        df = {w: sum(w in t.split() for t in texts) for w in words}
        self.idf = {w: math.log((len(texts) + 1) / max(n, 1)) for w, n in df.items()}
        self.templates = []  # word numbers, their IDF, key phrases, and distinct words by falling IDF with their positions
        self.weights = np.zeros((len(words), len(texts)))  # share of a word in each template
        for k, t in enumerate(p.templates):
            own = t.text.split()
            ids, idf = np.array([self.number[w] for w in own]), np.array([self.idf[w] for w in own])
            np.add.at(self.weights[:, k], ids, idf / idf.sum())
            rare = sorted(set(own), key=lambda w: (-self.idf[w], w))
            self.templates.append((ids, idf, [self._ids(x) for x in t.key], [(self.number[w], np.flatnonzero(ids == self.number[w])) for w in rare]))
        self.base = [(self._ids(x), label) for x, label in p.base]

    def _ids(self, phrase: str) -> list[int]:
        return [self.number[w] for w in phrase.split()]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, at, -1).astype(np.int32)


def places(w: np.ndarray, stop: np.ndarray, phrase: list[int], at: np.ndarray | None = None) -> np.ndarray:
    """Starts at which the phrase's words stand consecutively within one row."""
    at = np.flatnonzero(w == phrase[0]) if at is None else at
    at = at[at + len(phrase) <= stop[at]]
    for i, word in enumerate(phrase):
        at = at[w[at + i] == word]
    return at


def scan(texts: pa.Array, index: Index) -> dict[str, list]:
    """The result columns of a batch of texts."""
    raw, offs = W.text_bytes(texts)
    first, h = W.split_words(raw, offs, W.IS_ALNUM, W.LOWER)
    n = len(first) - 1
    w = index.numbers(h) if len(h) else np.zeros(0, np.int32)
    stop = np.repeat(first[1:], np.diff(first))
    row_of = lambda x: np.searchsorted(first, x, "right") - 1
    base: list[set] = [set() for _ in range(n)]
    count, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    for phrase, label in index.base:
        at = places(w, stop, phrase)
        row = row_of(at)
        np.add.at(count, row, 1)
        np.minimum.at(low, row, at - first[row])
        np.maximum.at(high, row, at - first[row])
        for r in np.unique(row).tolist():
            base[r].add(label)
    labels, score = [set(b) for b in base], np.zeros(n)
    known = np.flatnonzero(w >= 0)
    present = np.zeros((n, len(index.hashes)), np.float32)
    present[row_of(known), w[known]] = 1
    bound = present @ index.weights
    for r, k in np.argwhere(bound >= index.p.accept - 1e-6).tolist():
        ids, weight, keys, rare = index.templates[k]
        mine, lo, hi = w[first[r] : first[r + 1]], int(first[r]), int(first[r + 1])
        chosen, left = [], bound[r, k]
        for word, at in rare:
            if left < index.p.accept - 1e-6:
                break
            if present[r, word]:
                chosen.append((word, at))
                left -= index.weights[word, k]
        # of the template, in the words of the file; its ends may lie outside
        starts = np.unique(np.concatenate([(np.flatnonzero(mine == word)[:, None] - at[None, :]).ravel() for word, at in chosen]))
        for some in np.array_split(starts, len(starts) // 4096 + 1):
            where = some[:, None] + np.arange(len(ids))[None, :]
            same = (where >= 0) & (where < len(mine)) & (mine[np.clip(where, 0, len(mine) - 1)] == ids[None, :])
            share = (same * weight).sum(axis=1) / weight.sum()
            score[r] = max(score[r], share.max() if share.max() >= index.p.accept else 0)
            for s in some[share >= index.p.accept].tolist():
                # a key may run over the template's end, as "version 3" does, by its own length at most
                span = np.arange(max(lo, lo + s), min(hi, lo + s + len(ids)))
                if any(len(places(w, stop, key, span)) for key in keys):
                    labels[r].add(index.p.templates[k].label)
    none = count == 0
    mask = lambda v: [None if m else x for x, m in zip(v.tolist(), none.tolist(), strict=True)]
    join = lambda sets: [",".join(sorted(s)) for s in sets]
    return {"n_words": np.diff(first).tolist(), "n_base": count.tolist(), "first_word": mask(low), "last_word": mask(high), "base_labels": join(base), "labels": join(labels), "score": np.minimum(score, 1).tolist()}


_KINDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


def license_scan(docs: DataFrame, p: LicenseParams = LicenseParams()) -> DataFrame:
    """Base phrases and labels of every document: see the module's notes and op10's contract."""
    ship(docs.sparkSession)

    def run(batches):
        index = Index(p)
        for batch in batches:
            for part in W.slices(batch):
                out = scan(part.column("text"), index)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(out[c], k) for c, k in _KINDS.items())], names=["doc_id", *_KINDS])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
