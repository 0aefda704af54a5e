"""Suffixes are told apart by their words: equal hashes neither make nor hide a repeat."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import bytetext as bt, substrings


def repeated(texts, keys, size):
    """Per text the first words of windows that a smaller key has too."""
    words = [t.split() for t in texts]
    least = {}
    for w, k in zip(words, keys):
        for i in range(len(w) - size + 1):
            least[tuple(w[i:i + size])] = min(k, least.get(tuple(w[i:i + size]), k))
    return [{i for i in range(len(w) - size + 1) if least[tuple(w[i:i + size])] < k} for w, k in zip(words, keys)]


def some_texts(seed, vocabulary):
    draw = random.Random(seed)
    texts = [" ".join(draw.choices(vocabulary, k=draw.randint(0, 60))) for _ in range(40)]
    for _ in range(40):
        a, b = draw.choice(texts).split(), draw.choice(texts).split()
        texts.append(" \n".join(a[5:40] + b[3:30]))
    return texts


@pytest.mark.parametrize("vocabulary", [["a", "b"], ["a", "ab", "abc", "é", "漢字"], [f"w{i}" for i in range(300)]])
def test_nodes_in_suffix_order(vocabulary):
    texts, size = some_texts(len(vocabulary), vocabulary), 13
    words = bt.split(pa.array(texts))
    data, begin = substrings._spaced(words)
    name, names = substrings._names(data, begin)
    _, at, doc = bt.windows(words, size)
    keys = np.arange(len(texts)) // 2
    late = substrings._late(name, names, at, keys[doc], size)
    got = [set((at[late & (doc == d)] - words.first[d]).tolist()) for d in range(len(texts))]
    assert got == repeated(texts, keys.tolist(), size)
    by_name = [words.data[words.start[i]:words.end[i]].tobytes() for i in np.argsort(name, kind="stable")]
    assert by_name == sorted(by_name) and names == len(set(by_name))


def test_equal_hashes_within_a_slice(monkeypatch):
    """With one hash for all words only windows of equal words are known as repeats."""
    monkeypatch.setattr(bt.Words, "hashes", lambda self: np.full(len(self.start), 7, np.uint64))
    texts = some_texts(3, [f"w{i}" for i in range(40)])
    keys = list(range(len(texts)))
    w, at, doc, known = (substrings._suffixes(pa.array(texts), pa.array(keys), 13, True)[i] for i in (1, 2, 3, 5))
    assert len(set(w.tolist())) == 1
    truth = repeated(texts, keys, 13)
    first = bt.split(pa.array(texts)).first
    for d, i in zip(doc[known], at[known]):
        assert i - first[d] in truth[d]


def test_equal_hashes_within_a_group(spark, monkeypatch):
    """Every suffix in one group, its hashes equal: the nodes are those of the words."""
    texts = some_texts(5, [f"w{i}" for i in range(60)])
    parcels = []
    work = {}
    monkeypatch.setattr(bt.Words, "hashes", lambda self: np.full(len(self.start), 7, np.uint64))
    monkeypatch.setattr(substrings, "over_texts", lambda df, text, keep, new, prepare, **_: work.setdefault("f", prepare()) and df)
    try:
        substrings._rows(spark.createDataFrame([], "g array<int>, parcel array<binary>"), "parcel", "g", 13, (), 3)
    except Exception as e:  # noqa: BLE001
        raise AssertionError("rows are planned without reading") from e
    for d, t in enumerate(texts):  # each text a slice of its own, so that nothing is merged before
        parcels += work["f"](pa.array([t]), pa.array([d]))[1].flatten().to_pylist()
    nodes = substrings._nodes(pa.table({"parcel": pa.array(parcels, pa.binary())})).to_pylist()
    got = [set() for _ in texts]
    for n in nodes:
        got[n["key"]] |= {(n["place"] & (1 << 40) - 1) + j for j in range(12) if n["mask"] >> j & 1}
    assert got == repeated(texts, list(range(len(texts))), 13)


def test_counters_follow_the_rows():
    run = bt.mix(np.arange(1000, dtype=np.uint64))
    for bits in (16, 18, 22):
        assert substrings._counter(run, 1 << bits).max() < 1 << bits
        assert (substrings._counter(run, 1 << bits) == (run >> np.uint64(64 - bits)).astype(np.int64)).all()


@pytest.mark.parametrize("size", [3, 8, 13, 16, 25])
def test_other_sizes_and_crowded_groups(spark, monkeypatch, size):
    monkeypatch.setattr(substrings, "GROUP_ROWS", 20)  # most runs are too frequent, some longer ones as well
    texts = some_texts(size, ["a", "b", "c"])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["n_removed"] for r in substrings.without_repeats(df, size).collect()}
    for d, places in enumerate(repeated(texts, list(range(len(texts))), size)):
        assert got[d] == len({i + k for i in places for k in range(size)})
