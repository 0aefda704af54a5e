"""Conversation trie by the Euler tour against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import ordered, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth int, n_convs string"


def rows(seed=3, convs=150):
    r = random.Random(seed)
    out = []
    for c in range(convs):
        if r.random() < 0.1:
            continue
        for t in range(r.randrange(1, 7)):
            text = "hot first turn" if t == 0 and r.random() < 0.4 else f"{r.choice('abc')} {t} words" if r.random() < 0.6 else f"only {c} {t}"
            out.append((c, t, r.choice(["user", None]), r.choice([text, text, None])))
    out += [(500, t, "u", f"long {t}") for t in range(400)] + [(501, t, "u", f"long {t}") for t in range(300)] + [(c, t, "u", "copy") for c in range(600, 700) for t in range(4)]
    out += [(701, None, "u", "null turn"), (701, 0, "u", "zero"), (701, 0, "u", "zero"), (None, 0, "u", "no conversation"), (702, 5, None, None), (703, 1, "", "")]
    return out


def brute(data):
    name = lambda x: hashlib.md5(f"{len(x[0])}:{x[0]}{x[1]}".encode()).digest()
    by = defaultdict(list)
    for c, t, role, text in data:
        if c is not None:
            by[c].append((t is not None, t or 0, name((role or "", text or "")), (role or "", text or "")))
    by = {c: [x[3] for x in sorted(v)] for c, v in by.items()}
    nodes, ends = defaultdict(set), defaultdict(list)
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        full = tuple(by.get(c - c % 20, [])[:h] + own[h:])
        for d in range(len(full) + 1):
            nodes[full[:d]].add(c)
        ends[full].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    for k, v in nodes.items():
        s = (len(v) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += s
    return sorted((min(v), len(k), min(nodes[k[:-1]]) if k else None, len(v), children.get(k, 0), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, v in nodes.items())


@pytest.mark.parametrize("size", [200_000, 40, 3])
def test_trie_equals_brute_force(spark, monkeypatch, size):
    """With 40 rows a range chains cross ranges; with 3 the ranges stop shortening the list and pointers are doubled."""
    doubled = []
    plain = trie._doubled
    monkeypatch.setattr(ordered, "ROWS", size)
    monkeypatch.setattr(trie, "_doubled", lambda left: doubled.append(1) or plain(left))
    data = rows() if size > 3 else [x for x in rows(convs=40) if (x[0] or 0) < 100 or (x[0] or 0) >= 690]
    df = spark.createDataFrame([(*x, 7, "clash") for x in data], SCHEMA).repartition(3)
    got = trie.trie(df).collect()
    assert sorted((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got) == brute(data)
    assert sorted(x for r in got for x in (r["enter"], r["exit"])) == list(range(2 * len(got)))
    assert bool(doubled) == (size == 3)


def test_empty_and_turnless(spark):
    df = spark.createDataFrame([(None, 0, "u", "x", 1, "y")], SCHEMA)
    assert trie.trie(df).collect() == []
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    out = trie.trie(spark.createDataFrame([(c, 0, "u", "skipped", 1, "y")], SCHEMA)).collect()
    assert [(r["conv_id"], r["depth"], r["n_convs"], r["n_leaves"], r["ends_sha256"]) for r in out] == [(c, 0, 1, 1, hashlib.sha256(str(c).encode()).hexdigest())]
