"""Words are added up where a text is read, and heads of aliases come from the text by one pattern each."""

import random
import re

from tidemark.operators import text as TX


def test_no_row_a_word_is_dealt(spark):
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, -1)  # at size the planner cannot see that a side is small
    try:
        lex = spark.createDataFrame([("up", 2.0), ("down", -1.0)], "word string, valence double")
        tx = spark.createDataFrame([(1, "Up up and down", None), (2, "", "none here"), (3, "--", "DOWN")], "id long, h string, s string")
        out = TX.score_texts(tx, "id", {"h": "h", "s": "s"}, lex)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning(word" not in plan and not re.search(r"hashpartitioning\([^)]*word", plan)
        assert {(r.id, r.part): (r.valence, r.words, r.hits) for r in out.collect()} == {(1, "h"): (3.0, 4, 3), (2, "s"): (0.0, 2, 0), (3, "s"): (-1.0, 1, 1)}
    finally:
        spark.conf.set(key, before)


def test_mentions_equal_a_plain_search(spark):
    rnd = random.Random(9)
    words, gaps = ["ab", "é", "x_1", "b", "ß9", "ab"], [" ", "  ", "-", "$", ". ", "\n"]
    make = lambda n: "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(n)).rstrip("-$. \n")
    aliases = [(f"A{i}", a) for i, a in enumerate(sorted({make(rnd.choice([1, 2, 2, 3, 5])) for _ in range(60)} | {"ab.", "(é b", "x_1 $b"}))]
    texts = [(i, rnd.choice(["", "$", "-"]) + make(rnd.randrange(0, 14)) + rnd.choice(["", "$", " !"])) for i in range(150)] + [(200, None), (201, "q" * 300_000), (202, "b" + " " * 300_000), (203, "AB" + " " * 5 + "É")]
    want = {(i, s) for i, t in texts if t for s, a in aliases if re.search(r"(?<![\w$])" + re.escape(a.lower()) + r"(?!\w)", t.lower())}
    got = TX.mentions(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame(aliases, "symbol string, alias string"))
    assert {(r.id, r.symbol) for r in got.collect()} == want and len(want) > 300
