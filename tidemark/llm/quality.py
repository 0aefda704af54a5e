"""Quality rules: gradient-boosted trees over document statistics.

Method: statistics of a whole text are features; trees of logistic loss are grown on histograms of their quantiles, with
monotonic constraints on the features whose direction is known (repetition, symbols and repeated lines never raise the
verdict).  The trees are flattened into numpy node arrays and all rows of a slice walk down together.

The fit takes at most ``SAMPLE`` labelled rows of each class (documented bound, in order of a hash of the key).

Defined results: null and word-less texts have zeros everywhere and fail the base rules; without labels of both classes
the base rules alone decide; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import bytetext as bt, labelled
from tidemark.llm.textmap import over_texts

SAMPLE = 8000
_SLICE = 1 << 18
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Feature and direction: -1 where more of it may only lower the verdict, 0 where the trees are free.
FEATURES = {"symbol_share": -1, "duplicate_line_share": -1, "repeat_share": -1, "upper_share": 0, "mark_share": 0, "digit_share": 0, "mean_word": 0, "distinct_share": 0, "words_a_line": 0, "log_words": 0}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _table(member) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[b for b in range(256) if member(b)]] = True
    return t


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The columns COUNTS (integers) and FEATURES of each text."""
    words = bt.split(texts)
    data, offsets, n = words.data, words.offsets, len(words.counts)
    total = lambda flag: np.diff(np.append(0, np.cumsum(flag))[offsets])
    starts_char = (data & 0xC0) != 0x80
    word_chars = total(starts_char & bt.NOT_SPACE[data])
    symbols = total(_table(lambda b: b in SYMBOLS)[data])
    # lines
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    begin = begin[begin < len(data)]
    doc = np.searchsorted(offsets, begin, "right") - 1
    nxt = np.append(breaks, len(data))
    end = np.minimum(nxt[np.searchsorted(nxt, begin)], offsets[doc + 1])
    has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    begin, end, doc = begin[has_word], end[has_word], doc[has_word]
    lines = np.bincount(doc, minlength=n)
    h = bt.run_hashes(bt._BYTE_CODE[data], begin, end, bt._BASE)
    order = np.lexsort((h, doc))
    again = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    dup = np.bincount(doc[order][1:][again], minlength=n)
    # windows
    wh = words.hashes()
    w, at, wdoc = bt.windows(words, WINDOW, wh)
    order = np.lexsort((w, wdoc))
    same = (w[order][1:] == w[order][:-1]) & (wdoc[order][1:] == wdoc[order][:-1])
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hidden = bt.covered(len(wh), at[twice], WINDOW)
    count = words.counts
    repeat = np.diff(np.append(0, np.cumsum(hidden))[words.first])
    order = np.lexsort((wh, words.doc))
    d = words.doc[order]
    distinct = np.bincount(d[np.append(True, (wh[order][1:] != wh[order][:-1]) | (d[1:] != d[:-1]))] if len(d) else d, minlength=n)
    one, chars = np.maximum(count, 1), np.maximum(word_chars, 1)
    upper = total(_table(lambda b: 65 <= b <= 90)[data])
    digits = total(_table(lambda b: 48 <= b <= 57)[data])
    marks = total(_table(lambda b: 33 <= b < 127 and not chr(b).isalnum())[data])
    f = np.column_stack([symbols / chars, dup / np.maximum(lines, 1), repeat / one, upper / chars, marks / chars, digits / chars, word_chars / one, distinct / one, count / np.maximum(lines, 1), np.log1p(count)])
    return np.column_stack([count, word_chars, symbols, dup, repeat]).astype(np.int64), f


@dataclass
class Trees:
    """Flattened nodes of all trees: a leaf has feature -1. roots: the first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                f = np.where(inner, self.feature[at], 0)
                down = np.where(x[row, f] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(inner, down, at)
            out += self.value[at]
        return out


def grow(x: np.ndarray, y: np.ndarray, direction: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, leaf: int = 20, ridge: float = 1.0) -> Trees:
    """Newton boosting of logistic loss on quantile histograms, with monotonic constraints."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin, nodes, roots = np.full(len(y), base), [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([-1, 0.0, -1, -1, 0.0])
        todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, low, high = todo.pop()
            total_g, total_h = g[rows].sum(), h[rows].sum()
            value = float(np.clip(-total_g / (total_h + ridge), low, high))
            best = None
            if level < depth and len(rows) >= 2 * leaf:
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    k = code[rows, f]
                    gl, hl, nl = (np.cumsum(np.bincount(k, weights=v, minlength=len(c) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                    vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(total_g - gl) / (total_h - hl + ridge), low, high)
                    gain = -(gl * vl + 0.5 * (hl + ridge) * vl ** 2) - ((total_g - gl) * vr + 0.5 * (total_h - hl + ridge) * vr ** 2) + total_g * value + 0.5 * (total_h + ridge) * value ** 2
                    gain[(nl < leaf) | (len(rows) - nl < leaf) | (direction[f] * (vr - vl) < 0)] = 0
                    s = int(gain.argmax())
                    if gain[s] > 1e-6 and (best is None or gain[s] > best[0]):
                        best = (gain[s], f, s, vl[s], vr[s])
            if best is None:
                nodes[node][4] = rate * value
                margin[rows] += rate * value
                continue
            _, f, s, vl, vr = best
            mid = (vl + vr) / 2
            a, b = len(nodes), len(nodes) + 1
            nodes[node][:4] = [f, float(cuts[f][s]), a, b]
            nodes += [[-1, 0.0, -1, -1, 0.0], [-1, 0.0, -1, -1, 0.0]]
            go = code[rows, f] <= s
            lows, highs = ((low, mid), (mid, high)) if direction[f] > 0 else ((mid, high), (low, mid)) if direction[f] < 0 else ((low, high), (low, high))
            todo += [(a, rows[go], level + 1, *lows), (b, rows[~go], level + 1, *highs)]
    columns = list(zip(*nodes))
    return Trees(*(np.array(c) for c in columns), np.array(roots), base)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Trees | None:
    chosen, sizes = labelled.sample(docs, labels, label, rows, key, text)
    if not all(sizes.values()):
        return None

    def work(texts):
        f = statistics(texts)[1]
        return [pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), f.shape[1]).cast(pa.list_(pa.float64()))]
    table = over_texts(chosen, text, [key, "label"], "f array<double>", lambda: work).orderBy(key).toArrow()  # at most 2 x rows short vectors
    x = np.asarray(table.column("f").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = np.asarray(table.column("label").combine_chunks()).astype(float)
    if not 0 < y.mean() < 1:
        return None
    trees = grow(x, y, list(FEATURES.values()))
    trees.base += float(np.log(sizes[1] / sizes[0]) - np.log(y.mean() / (1 - y.mean())))
    return trees


def judge(df: DataFrame, trees: Trees | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """Columns ``keep``, COUNTS, score (probability of good quality), base_failed and kept."""
    def work(texts):
        counts, f = statistics(texts)
        margin = np.zeros(len(f)) if trees is None else trees.margin(f)
        return [*(np.ascontiguousarray(counts[:, i]) for i in range(len(COUNTS))), 1.0 / (1 + np.exp(-margin))]
    out = over_texts(df, text, list(keep), ", ".join(f"{c} bigint" for c in COUNTS) + ", score double", lambda: work, limit=_SLICE)
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))
