"""Licences of long files: no number of places bounds the search."""

import pytest

from tidemark.llm import licenses

FULL = {licenses.SAME.get(n, n) for n in licenses.TEMPLATES}


def test_every_template_of_a_long_file_is_found(spark):
    texts = [t for t, _ in licenses.TEMPLATES.values()]
    mit, gpl = licenses.TEMPLATES["mit"][0], licenses.TEMPLATES["gpl"][0]
    rows = [(0, (" filler" * 40 + " ").join(texts)), (1, "sharealike " * 65 + "unencumbered " * 65 + gpl), (2, (mit + " ") * 30 + gpl), (3, "sharealike unencumbered " * 200), (4, None), (5, "")]
    rows += [(10 + i, "plain words of the day") for i in range(20)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert set(got[0]["labels"].split(",")) == FULL
    words, at = rows[0][1].split(), {}
    for x in got[0]["spans"]:
        at.setdefault(x["label"], set()).add(x["word"])
    for name, (t, _) in licenses.TEMPLATES.items():
        w = t.split()
        assert at[licenses.SAME.get(name, name)] & {i for i in range(len(words)) if words[i:i + len(w)] == w}
    assert got[1]["labels"] == "gpl" and got[1]["spans"][0]["word"] == 130 and got[1]["score"] == pytest.approx(1)
    assert got[2]["labels"] == "gpl,mit"
    assert got[3]["labels"] == got[4]["labels"] == got[5]["labels"] == got[10]["labels"] == ""


def test_best_start_and_text_bounds(spark):
    body = licenses.TEMPLATES["bsd"][0]
    head, tail = body.split()[:10], body.split()[10:]
    rows = [(0, " ".join(head)), (1, " ".join(tail)), (2, body.replace("permitted", "allowed") + " x " + body)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got[0]["labels"] == got[1]["labels"] == ""  # neighbours in a slice do not complete one another
    assert got[2]["labels"] == "bsd" and [x["word"] for x in got[2]["spans"]] == [len(body.split()) + 1]


def scanned(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, "plain words of the day") for i in range(20)]
    return {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_each_template_is_found_whole_and_with_a_name_put_in(spark, name):
    text, keys = licenses.TEMPLATES[name]
    label, words = licenses.SAME.get(name, name), text.split()
    spoiled = [i for i in range(1, len(words)) if all(" ".join([*words[:i], "zyx", *words[i:]]).find(k) >= 0 for k in keys)]
    got = scanned(spark, ["before " + text + " after", *("x " + " ".join([*words[:i], "zyx", *words[i:]]) + " y" for i in spoiled)])
    assert label in got[0]["labels"].split(",") and got[0]["score"] == pytest.approx(1)
    assert all(label in got[1 + j]["labels"].split(",") for j in range(len(spoiled)))


def test_inserted_dropped_and_replaced_words(spark):
    words = licenses.TEMPLATES["mit"][0].split()
    cases = [[*words[:6 + 10], "really", *words[16:]], [w for i, w in enumerate(words) if i != 12], [*words[:12], "acquiring", *words[13:]], [*words[:9], "one", "two", "three", *words[9:]], words[:12], words[::-1]]
    got = scanned(spark, [" ".join(c) for c in cases])
    assert [got[i]["labels"] for i in range(6)] == ["mit", "mit", "mit", "mit", "", ""]
    assert 0.8 <= got[1]["score"] < 1 and got[0]["score"] == pytest.approx(1)


def test_two_licences_and_a_repeated_one(spark):
    mit, bsd = licenses.TEMPLATES["mit-text"][0], licenses.TEMPLATES["bsd-text"][0]
    got = scanned(spark, [mit.replace("the authors", "jane doe and the authors") + " filler " * 30 + bsd.upper(), (mit + "\n") * 12, mit.replace("permission is hereby granted", "permission is granted")])
    assert got[0]["labels"] == "bsd,mit" and got[1]["labels"] == "mit" and "mit" not in got[2]["labels"]
    assert min(x["word"] for x in got[1]["spans"]) == 0
