"""Benchmark windows by suffix automaton against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate

WORD = re.compile(r"[0-9a-z\x80-\U0010FFFF]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, size):
    w, hit, named = words(text), set(), set()
    for i, t in items:
        b = words(t)
        n = min(size, len(b))
        windows = {tuple(b[k:k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1) if n else ():
            if tuple(w[k:k + n]) in windows:
                hit |= set(range(k, k + n))
                if i is not None:
                    named.add(str(i))
    return len(w), len(hit), sorted(named)


def tables(seed):
    r = random.Random(seed)
    some = lambda n: " ".join(r.choice("abcd") + r.choice(["", "'", "1"]) for _ in range(n))
    items = [(i, some(r.choice([1, 2, 3, 5, 9, 10, 11, 30]))) for i in range(40, 70)] + [(1, None), (2, ""), (3, "... !"), (40, some(12)), (None, "zz yy xx"), (9, "Déjà vu — ÉTÉ")]
    docs = [(i, some(r.randrange(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, " \n"), (103, items[4][1]), (103, items[4][1]), (None, "ZZ yy, xx"), (104, "x " * 3000 + "zz yy xx"), (105, "déjà VU ÉTÉ")]
    docs += [(200 + k, "q " + t + " q") for k, (_, t) in enumerate(items) if t]
    return docs, items


@pytest.mark.parametrize("seed, size, part", [(0, 10, None), (1, 4, None), (2, 10, 60)])
def test_windows_equal_brute_force(spark, monkeypatch, seed, size, part):
    if part:  # several automata: items longer than a part are cut, results do not change
        monkeypatch.setattr(decontaminate, "PART_WORDS", part)
    docs, items = tables(seed)
    d = spark.createDataFrame([(i, t, 5, ["x"]) for i, t in docs], "doc_id long, text string, n_words int, items array<string>").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.scan(d, b, size).collect()), key=str)
    want = sorted(((i is None, i, *brute(t, items, size)) for i, t in docs), key=str)
    assert got == want


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id string, text string")
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.scan(d, b).collect()) == [(1, 3, 0, []), (2, 0, 0, [])]
    assert decontaminate.scan(d.where("doc_id > 5"), spark.createDataFrame([("x", "a b")], b.schema)).collect() == []


def test_a_common_passage_of_all_items_names_them_all(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    b = spark.createDataFrame([(i, f"start{i} {passage} end{i}") for i in range(300)], "item_id long, text string")
    d = spark.createDataFrame([(i, f"before {passage.upper()} after") for i in range(50)], "doc_id long, text string")
    rows = decontaminate.scan(d, b).collect()
    assert len(rows) == 50 and all(r["n_hit"] == 12 and len(r["items"]) == 300 and r["spans"][0].asDict() == {"from": 1, "to": 13, "longest": 12} for r in rows)


def test_words_are_compared_not_only_hashed(spark, monkeypatch):
    """All words of equal length get one hash: only the right spelling may hit."""
    item = " ".join(f"ab{i}" for i in range(4))
    built = decontaminate.Automaton.build([[w.encode() for w in item.split()]], ["1"], 4)
    text = "xy0 ab1 ab2 ab3 ab0 ab1 ab2 ab3"
    import numpy as np
    import pyarrow as pa
    w = decontaminate.bt.split(pa.array([text]), decontaminate.bt.ALNUM)
    monkeypatch.setattr(decontaminate.Automaton, "_numbers", lambda self, h: np.array([0, 1, 2, 3, 0, 1, 2, 3]))
    state, longest = built.stream(w)
    assert built.occurrences(state, longest)[0].tolist() == [7]


def test_removal_by_length_and_coverage(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    b = spark.createDataFrame([(1, passage), (2, "tiny item")], "item_id long, text string")
    d = spark.createDataFrame([(1, f"Some words, {passage.upper()}! And a TINY item, " + "more " * 30), (2, passage), (3, None), (4, "clean")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.without_leaks(d, b).collect()}
    assert rows[1]["text"] == "Some words! And a TINY item, " + "more " * 30 and rows[1]["n_removed"] == 12 and rows[1]["n_hit"] == 14 and rows[1]["kept"]
    assert rows[2]["text"] == "" and not rows[2]["kept"] and rows[3]["text"] is None and rows[3]["kept"] and rows[4]["text"] == "clean"


def test_the_digest_of_no_items_is_that_of_an_empty_string(spark):
    from tidemark.llm.queries import QUERIES
    rows = QUERIES["op11_benchmark_decontamination"](spark, "/root/testdata/sf0.001").where("NOT contaminated").collect()
    assert rows and all(r["items_sha256"] == hashlib.sha256(b"").hexdigest() and r["n_items"] == 0 for r in rows)
