"""Buckets of many members that are not linked: no pairs of all of them, no link lost."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import components_by_hand
from tidemark.llm import minhash, spread


def family(n, own, seed=0):
    """Texts of one template of 100 words, of which ``own`` are replaced by words no other text has."""
    r = random.Random(seed)
    base = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(n):
        at = r.randrange(100 - own)
        rows.append((i, " ".join(base[:at] + [f"u{i}x{j}" for j in range(own)] + base[at + own:])))
    return rows


def met(spark, rows):
    """Pairs that one bucket of all these texts compares."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    s = minhash.materialise(minhash.sketches(df, "text", "doc_id", 2, True), "sketches")
    members = s.select("node", F.col("node").alias("label"))
    nodes = s.select("node", "doc_id")
    pairs, common = minhash.meetings(members, minhash.prefixes(df, nodes, nodes.select("node"), "text", "doc_id", 2, True, 80))
    n = common.count()
    return pairs.count() + n * (n - 1) // 2


def test_pairs_of_an_unlinked_bucket_grow_no_faster_than_it(spark):
    assert met(spark, family(1250, 30)) <= 1250 and met(spark, family(5000, 30)) <= 5000


@pytest.mark.parametrize("small", [1, 32])
def test_links_over_the_threshold_are_found_in_large_buckets(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    rows = [(i + 1000 * k, t) for k, own in enumerate((5, 8, 10, 11, 12, 30)) for i, t in family(25, own, k)] + [(9000, None), (9001, ""), (9002, "t1"), (9003, "t1")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == components_by_hand(rows, 2)


@pytest.mark.parametrize("small", [1, 32])
def test_pairs_over_the_threshold_share_a_prefix(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    for own in (1, 5, 10, 11):
        base = [f"t{i}" for i in range(100)]
        pair = [(1, " ".join(base)), (2, " ".join(base[:50] + [f"u{j}" for j in range(own)] + base[50 + own // 2:]))]
        assert met(spark, pair) == 1


def test_left_join_of_frequent_and_null_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else 1 if i % 2 else i) for i in range(4000)], "i long, k long")
    table = spark.createDataFrame([(1, "one"), (2, "two"), (5, "five")], "k long, v string")
    rows = minhash.materialise(rows, "rows")
    assert sorted(map(tuple, spread.left_join(rows, table, "k").collect()), key=str) == sorted(map(tuple, rows.join(table, "k", "left").select("i", "k", "v").collect()), key=str)
    assert spread.left_join(rows.where("i < 0"), table, "k").count() == 0
