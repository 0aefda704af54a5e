"""License scan: which licence texts or notices a document holds, and where.

Method: a positional index of rare words.  Templates are word sequences with postings (template, place) by word; a word's weight is
its inverse document frequency over all scanned documents.  Every place of a file that holds one of its highest-weighted
licence words (those that make up ``RARE`` of a template's weight, none left out) is looked up; a posting names the start that the
template would have.  Starts are intersected: only where postings that agree on a start, up to a small drift, hold as much
weight as a match of ``LEAST`` must have among them, is the template verified.  Verification aligns the template with the
file there (a weighted longest common subsequence), so that inserted, dropped and replaced words cost their own weight
and no more, and every mandatory key phrase must stand near the place.

Fixed phrases (base) are found everywhere by comparing word hashes at consecutive places; their labels always stay.

Defined results: null texts are empty; texts without words have no label and score 0; a template that occurs several
times gives one label and the span of its best place; ties between places go to the earliest; repeated rows scan alike; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import bytetext as bt
from tidemark.llm.textmap import over_texts, total_counts

# Phrases and labels of the base scan.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Public licence texts, their opening words, and notices, with the phrases that must be there.
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    "apache-2": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2",)),
    "apache-2-short": ("licensed under the apache license version 2 0", ("apache license version 2",)),
    "mit-notice": ("released under the mit license", ("mit license",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    "cc-by-nc": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike license", ("attribution sharealike",)),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights "
                 "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
                 "permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
                 "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
                 "arising from out of or in connection with the software or the use or other dealings in the software", ("permission is hereby granted free of charge", "the software is provided as is")),
    "isc-text": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is "
                 "provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or "
                 "consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of "
                 "this software", ("with or without fee is hereby granted",)),
    "bsd-text": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list "
                 "of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided "
                 "with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a "
                 "particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of "
                 "substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any "
                 "way out of the use of this software even if advised of the possibility of such damage", ("redistribution and use in source and binary forms",)),
    "apache-2-notice": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
                        "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific "
                        "language governing permissions and limitations under the license", ("apache license version 2",)),
    "gpl-notice": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any "
                   "later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public "
                   "license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses", ("gnu general public license",)),
    "all-rights-reserved": ("copyright all rights reserved", ("all rights reserved",)),
}
#: Labels that a notice shares with the full text.
SAME = {"apache-2-short": "apache-2", "mit-notice": "mit", "mit-text": "mit", "isc-text": "isc", "bsd-text": "bsd", "apache-2-notice": "apache-2", "gpl-notice": "gpl"}

#: Share of a template's weight that must match, and share that the words looked up have at least.
LEAST, RARE = 0.8, 0.6
#: Places by which postings of one start may drift apart, for short templates, and a longer one's share of its length.
DRIFT, DRIFT_SHARE = 4, 0.1


def word_hashes(words: list[str]) -> np.ndarray:
    return bt.split(pa.array([" ".join(words)])).hashes()


class Index:
    """Words, codes and key phrases of all templates, by word hash."""

    def __init__(self):
        self.names = list(TEMPLATES)
        self.words = [t.split() for t, _ in TEMPLATES.values()]
        self.hashes = [word_hashes(w) for w in self.words]
        self.vocabulary = np.unique(np.concatenate(self.hashes))
        self.codes = [np.searchsorted(self.vocabulary, h) for h in self.hashes]
        self.keys = [[(k, word_hashes(k.split())) for k in keys] for _, keys in TEMPLATES.values()]
        self.phrases = [(label, word_hashes(p.split())) for p, label in PHRASES.items()]

    def rarest(self, t: int, idf: np.ndarray) -> list[tuple[int, int]]:
        """(code, place) of the template's highest-weighted words, as many as make up ``RARE`` of it; words of equal weight all."""
        w = idf[self.codes[t]]
        order = np.argsort(-w, kind="stable")
        n = int(np.searchsorted(np.cumsum(w[order]), RARE * w.sum())) + 1
        return [(int(self.codes[t][q]), int(q)) for q in np.flatnonzero(w >= w[order[min(n, len(order)) - 1]] * (1 - 1e-12))]

    def code(self, h: np.ndarray) -> np.ndarray:
        """Number of each word in the vocabulary, -1 for other words."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, -1)


def stands_at(h: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the phrase's words stand consecutively."""
    at = np.flatnonzero(h[:max(0, len(h) - len(phrase) + 1)] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[h[at + k] == phrase[k]]
    return at


def aligned(own: np.ndarray, weight: np.ndarray, codes: np.ndarray) -> float:
    """Greatest weight of template words that stand in the file's words in the template's order."""
    best = np.zeros(len(codes) + 1)
    for c, w in zip(own, weight):
        best[1:] = np.maximum(best[1:], np.maximum.accumulate(np.where(codes == c, best[:-1] + w, 0.0)))
    return float(best[-1])


def document_frequency(df: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many of them each template word occurs; a table of fixed size."""
    index = Index()

    size = len(index.vocabulary)

    def count(texts):
        words = bt.split(texts, bt.ALNUM, lower=True)
        code = index.code(words.hashes())
        has = bt.distinct(words.doc[code >= 0].astype(np.int64) * size + code[code >= 0]) % size
        return np.append(np.bincount(has, minlength=size), len(texts))
    n = total_counts(df, text, size + 1, count)
    return int(n[-1]), n[:-1]


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans (label, word, words, score)."""
    total, frequency = document_frequency(df, text)
    idf = np.log((total + 1.0) / (frequency + 0.5))

    def prepare():
        index = Index()
        weights = [idf[c] for c in index.codes]
        sums = [float(w.sum()) for w in weights]

        rarest = [index.rarest(t, idf) for t in range(len(index.names))]

        def templates(words: bt.Words, h: np.ndarray, code: np.ndarray) -> dict[int, list[tuple[str, int, int, float]]]:
            """label, place, words and score of the best start of each template, by text."""
            places = np.flatnonzero(code >= 0)
            places = places[np.argsort(code[places], kind="stable")]
            bounds = np.searchsorted(code[places], np.arange(len(index.vocabulary) + 1))
            found: dict[int, list[tuple[str, int, int, float]]] = {}
            for t, own in enumerate(index.codes):
                drift = max(DRIFT, int(DRIFT_SHARE * len(own)))
                at = [(places[bounds[v]:bounds[v + 1]], q) for v, q in rarest[t]]
                # a start may lie before its text; texts follow one another, so text and start are told apart by one number
                wide = len(code) + 2 * len(own)
                starts = np.concatenate([words.doc[x].astype(np.int64) * wide + x - q + len(own) for x, q in at])
                held = np.repeat([weights[t][q] for _, q in at], [len(x) for x, _ in at])
                order = np.argsort(starts, kind="stable")
                starts, held = starts[order], held[order]
                upto = np.append(0, np.cumsum(held))
                agree = upto[np.searchsorted(starts, starts + drift, "right")] - upto[:-1]
                need = (LEAST - 1) * sums[t] + sum(weights[t][q] for _, q in rarest[t])
                some = np.flatnonzero(agree >= need * (1 - 1e-9))
                if not len(some):
                    continue
                # starts that lie within a drift of one another are one place, of half a template at most
                cut = np.append(True, np.diff(starts[some]) > drift)
                cut |= np.append(False, np.diff((starts[some] - np.maximum.accumulate(np.where(cut, starts[some], 0))) // max(drift, len(own) // 2)) > 0)
                good = []
                for lo, hi in zip(np.flatnonzero(cut), np.append(np.flatnonzero(cut)[1:], len(some))):
                    near = np.arange(some[lo], np.searchsorted(starts, starts[some[hi - 1]] + drift, "right"))
                    names, which = np.unique(starts[near], return_inverse=True)
                    best = int(names[np.argmax(np.bincount(which, weights=held[near]))])
                    d, s = best // wide, best % wide - len(own)
                    first, end = int(words.first[d]), int(words.first[d + 1])
                    a, z = max(first, int(names[0] % wide) - len(own) - drift), min(end, int(names[-1] % wide) - len(own) + len(own) + drift)
                    rigid = s >= first and s + len(own) <= end and (code[s:s + len(own)] == own).all()
                    share = 1.0 if rigid else aligned(own, weights[t], code[a:z]) / sums[t]
                    if share >= LEAST and all(len(stands_at(h[max(first, a - 8):min(end, z + 8)], k)) for _, k in index.keys[t]):
                        good.append((d, -min(share, 1.0), max(s, first)))
                done = -1
                for d, less, s in sorted(good):
                    if d != done:
                        done = d
                        found.setdefault(d, []).append((SAME.get(index.names[t], index.names[t]), s - int(words.first[d]), len(own), -less))
            return found

        def work(texts):
            words = bt.split(texts, bt.ALNUM, lower=True)
            h = words.hashes()
            code = index.code(h)
            n = len(texts)
            base = [(label, at[words.doc[at] == words.doc[at + len(p) - 1]]) for label, p in index.phrases for at in [stands_at(h, p)]]
            doc_of = words.doc
            own: list[list[tuple[str, int]]] = [[] for _ in range(n)]
            for label, at in base:
                for a in at.tolist():
                    own[doc_of[a]].append((label, a - int(words.first[doc_of[a]])))
            placed = templates(words, h, code)
            rows = []
            for d in range(n):
                a, b = words.first[d], words.first[d + 1]
                more = placed.get(d, [])
                starts = [s for _, s in own[d]]
                plain = sorted({x for x, _ in own[d]})
                spans = sorted([*((x, s, len(next(p for p, y in PHRASES.items() if y == x).split()), 1.0) for x, s in own[d]), *more], key=lambda r: (r[1], r[0]))
                rows.append((int(b - a), len(own[d]), min(starts, default=None), max(starts, default=None), ",".join(plain), ",".join(sorted({*plain, *(r[0] for r in more)})),
                             max([0.0, *(r[3] for r in spans)]), [dict(zip(("label", "word", "words", "score"), r)) for r in spans]))
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("score", pa.float64())]))]
            return [pa.array(c, k) for c, k in zip(cols, kinds)]
        return work
    new = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label: string, word: bigint, words: bigint, score: double>>"
    return over_texts(df, text, list(keep), new, prepare)
