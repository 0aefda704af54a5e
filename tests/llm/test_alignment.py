"""Token alignment of two vocabularies against brute force with the libraries themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment

A, RANKS, B = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


def rows():
    r = random.Random(4)
    some = lambda n: " ".join("".join(r.choice(["th", "er", "ing", "é", "ß", "on", "1"]) for _ in range(r.randrange(1, 5))) + r.choice(["", ".", ",", "\n"]) for _ in range(n))
    out = [(i, some(r.randrange(1, 60))) for i in range(40)]
    out += [(100, None), (101, ""), (102, " "), (103, "\n\t "), (104, "<|endoftext|> </s> <s> <0x41> <unk>"), (105, "日本語 😀 x"), (106, "▁ rewritten"), (107, "é decomposed"), (108, "a\x00b"), (None, "null key"), (None, None)]
    out += [(200, "the the the, the. " * 400), (201, " " * 2000 + "x"), (202, "w" * 3000)] + [(300, "same text twice")] * 2 + [(400 + i, ". . . the") for i in range(30)]
    return out


def brute(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {c: i for i, c in enumerate(alignment._byte_alphabet())}
    docs, counts = [], Counter()
    for t in texts:
        links, groups, n_a, n_b = [], [], 0, 0
        if t:
            ea = a.encode(" " + t, add_special_tokens=False)
            x, y = [(i, bytes(letters[c] for c in p)) for i, p in zip(ea.ids, ea.tokens)], []
            for i in b.encode(t):
                p = b.id_to_piece(i)
                y.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
            want = (" " + t).encode()
            if b"".join(s for _, s in x) == want == b"".join(s for _, s in y):
                n_a, n_b = len(x), len(y)
                ends = [np.cumsum([len(s) for _, s in z]).tolist() for z in (x, y)]
                p = [0, 0]
                for e in sorted(set(ends[0]) & set(ends[1])):
                    q = [ends[0].index(e) + 1, ends[1].index(e) + 1]
                    groups.append(",".join(str(i) for i, _ in x[p[0]:q[0]]) + "|" + ",".join(str(i) for i, _ in y[p[1]:q[1]]))
                    links.append((x[q[0] - 1][0], y[q[1] - 1][0]))
                    p = q
        counts.update(links)
        docs.append((n_a, n_b, links, ";".join(groups)))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return [(n_a, n_b, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), g) for n_a, n_b, links, g in docs], counts, most


@pytest.mark.parametrize("group, fan, piece", [(1_000_000, 16, 2 << 20), (40, 2, 600)])
def test_alignment_equals_brute_force(spark, monkeypatch, group, fan, piece):
    """With tiny groups every radix is split by slice and merged in levels; results do not change."""
    for name, v in (("GROUP", group), ("FAN", fan), ("SLICE", piece), ("BLOCK", 64 if group < 100 else alignment.BLOCK)):
        monkeypatch.setattr(alignment, name, v)
    data = rows()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, n_a int, slice string").repartition(3)
    got = alignment.align(df, A, B, RANKS, spell=True).collect()
    want, counts, most = brute([t for _, t in data])
    key = lambda x: str(x)
    assert sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in got), key=key) == sorted(((i, *w) for (i, _), w in zip(data, want)), key=key)
    if group < 100:
        table = {(r["a"], r["b"]): (r["n"], r["best"]) for r in alignment.pair_counts(df, A, B).collect()}
        assert table == {k: (n, n == most[k[1]]) for k, n in counts.items()}


def test_digest_and_empty_table(spark):
    df = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in alignment.align(df, A, B, RANKS).collect()}
    want = brute(["some words"])[0][0]
    assert out[1]["groups"] == hashlib.sha256(want[-1].encode()).hexdigest() and out[2]["groups"] == "" and out[2]["count_sum"] == 0
    assert alignment.align(df.where("doc_id > 5"), A, B, RANKS).collect() == []


def test_merge_of_runs():
    r = np.random.default_rng(1)
    runs, want = [], Counter()
    for _ in range(30):
        k = np.unique(r.integers(0, 5000, r.integers(1, 2000)))
        n = r.integers(1, 9, len(k))
        runs.append(alignment._run(k, n))
        for x, y in zip(k.tolist(), n.tolist()):
            want[x] += y
    keys, counts = (np.concatenate(x) for x in zip(*alignment.merge_counts(runs)))
    assert (np.diff(keys) > 0).all() and dict(zip(keys.tolist(), counts.tolist())) == want
