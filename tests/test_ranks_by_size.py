"""Ranks and positions: groups sorted whole and groups cut by value agree; a day of equal values is no error."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import relational as RL, research_stats as RS


def _rows(spark):
    rows = [(g, i, float((i * 7 + g) % 5) if i % 11 else None, float((i * 13) % 9) if i % 17 else float("nan")) for g, n in ((1, 12), (2, 60), (3, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "g long, name long, x double, y double")


@pytest.mark.parametrize("descending", [False, True])
def test_positions_do_not_depend_on_the_size_of_a_group(spark, monkeypatch, descending):
    got = []
    for limit in (0, 20, 1000):
        monkeypatch.setattr(RL, "SORTED_ROWS", limit)
        got.append(sorted(map(tuple, RL.position_within(_rows(spark), ["g"], "x", "name", "p", descending).select("g", "name", "x", "p", "p_of").collect())))
    assert got[0] == got[1] == got[2]
    rows = [(r.g, r.x, r.name) for r in _rows(spark).collect() if r.x is not None]
    want = {(g, name): i for k in (1, 2, 3) for i, (g, x, name) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1] if descending else r[1], r[2])), 1)}
    assert {(g, name): p for g, name, _, p, _ in got[0]} == want


def test_ranks_do_not_depend_on_the_size_of_a_group(spark, monkeypatch):
    got = []
    for limit in (0, 20, 1000):
        monkeypatch.setattr(RL, "SORTED_ROWS", limit)
        got.append(sorted(map(tuple, RL.average_ranks(_rows(spark).where("x is not null"), ["g"], {"x": "rx", "y": "ry"}).where(~F.isnan("y")).select("g", "name", "x", "y", "rx", "ry").collect())))
    assert got[0] == got[1] == got[2]


def test_small_groups_are_ranked_by_one_shuffle(spark):
    plan = RL.average_ranks(_rows(spark), ["g"], {"x": "rx", "y": "ry"})._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "LeftAnti" in plan


def test_a_day_of_equal_values_is_no_error(spark):
    rows = [(dt.date(2020, 1, d), float(i if d > 1 else 1), float(i * i % 7)) for d in range(1, 8) for i in range(6)]
    got = RS.spearman(spark.createDataFrame(rows, "date date, v double, f double"), ["date"], "v", "f", 5).orderBy("date").collect()
    assert [r.ic is None for r in got] == [True] + [False] * 6 and got[0].reason == "no variance"
