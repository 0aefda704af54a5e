"""Operators on whole texts against brute force, with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import bpe, htmltext, importance, labelled, licenses, minhash, packing, quality, substrings, toxicity

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def messy():
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(VOCABULARY) + str(r.randrange(40)) for _ in range(n))
    base, passage = text(120), text(40)
    near = base.split()
    near[50] = "changed"
    rows = [(0, base), (1, None), (2, ""), (3, " \t\n "), (4, text(20_000)), (5, base), (5, base), (6, " ".join(near)), (7, "one"), (8, "ONE"), (9, text(30) + "\n" + passage + "  " + text(20)),
            (10, passage + " " + text(25)), (11, "x" * 3000), (12, "<|endoftext|> It's “naïve” ΑΣ 日本語 ½ İ\u0085"), (13, text(60) + " Under the MIT-License. " + text(5) + " cc by nc, CC BY NC"),
            (14, "a b c d " * 40), (15, "Same line here\nSame line here\n\n\nSame line here"), (None, base), (None, None), (16, text(12)), (17, text(13))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 0.5, True, 7, "x") for i, t in messy()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, ids int, decoded string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# -- tokens and packing ------------------------------------------------------------------------------------------------


def test_ids_equal_the_library(docs):
    library = Tokenizer.from_file(PATH)
    got = bpe.encode(docs, PATH, keep=("doc_id", "text"), decoded=True).collect()
    assert len(got) == len(messy())
    for r in got:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_decoding_restores_words(docs):
    coded = bpe.encode(docs.where("doc_id IN (0, 12)"), PATH)
    out = {r["doc_id"]: r["decoded"] for r in bpe.decode(coded, PATH).collect()}
    assert out[0].replace(" ", "") == messy()[0][1].replace(" ", "")  # letters and digits are words of their own
    assert "<|endoftext|>" in out[12] and "日本語" in out[12]


@pytest.mark.parametrize("text", ["''s 's's x's 'll'll o'clock's", "a\x1cb\x1f c", "ŉ ǅ ǆ ß ẞ", "… — “q” ’s", "é é", "1234 5.6", "​ x 　 y", "w" * 200 + " " + "ab" * 60])
def test_odd_texts_encode_like_the_library(text):
    ids, at = bpe.load(PATH).encode(pa.array([text, None, text]))
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert ids[at[0]:at[1]].tolist() == want == ids[at[2]:at[3]].tolist() and at[1] == at[2]


def check_packing(rows, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return by_doc, len(by_sequence)


def test_packing_places_every_piece(docs):
    capacity = 256
    rows = packing.pack_documents(docs, PATH, capacity).collect()
    library = Tokenizer.from_file(PATH)
    _, sequences = check_packing(rows, capacity)
    want = Counter()
    for i, t in messy():
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[s:s + capacity], "<u4")
            want[i, p, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert sequences <= 1.02 * -(-sum(r["length"] for r in rows) // capacity) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_complete_and_tight(seed):
    r = np.random.default_rng(seed)
    counts = Counter(np.clip(r.lognormal(5, 1.2, 4000).astype(int), 1, 1024).tolist())
    table = packing.plan(counts, 1024)
    seen, places = Counter(), {}
    for length, first, n, each, sequence, offset in table.tolist():
        for k in range(n):
            seen[length, first + k] += 1
            places.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
    assert seen == Counter({(s, k): 1 for s, n in counts.items() for k in range(n)})
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(p, p[1:])) and sum(p[-1]) <= 1024
    assert len(places) <= 1.01 * sum(s * n for s, n in counts.items()) / 1024 + 1


def test_plan_of_few_or_equal_lengths():
    assert len(packing.plan({}, 64)) == 0
    assert packing.plan({64: 3}, 64)[:, 2].sum() == 3
    sequences = {int(s) + k // int(e) for _, _, n, e, s, _ in packing.plan({33: 5, 1: 200}, 64) for k in range(int(n))}
    assert len(sequences) == 6  # five that hold one of 33 and 31 ones each take 155; the other 45 need one more


# -- near duplicates -----------------------------------------------------------------------------------------------------


def components_by_hand(rows, size):
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return Counter((i, len(s), least.get(x)) for (i, _), s, x in zip(rows, sets, label))


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, size):
    got = minhash.near_duplicates(docs, size=size).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components_by_hand(messy(), size)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chain_of_near_copies_is_one_component(spark):
    r = random.Random(1)
    text = [f"w{r.randrange(10 ** 6)}" for _ in range(200)]
    rows = []
    for i in range(60):
        text = list(text)
        text[r.randrange(200)] = f"n{i}"
        rows.append((100 - i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df, size=2).collect()
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == components_by_hand(rows, 2)


def test_estimate_is_close(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i * 25, i * 25 + 400))) for i in range(8)]
    s = minhash.sketches(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id", 1, True)
    p = s.alias("p").join(s.alias("q"), F.col("p.doc_id") < F.col("q.doc_id")).select((F.col("q.doc_id") - F.col("p.doc_id")).alias("d"), minhash.estimate("p", "q").alias("e"), minhash.near("p", "q", 80).alias("near"))
    for x in p.collect():
        true = (400 - 25 * x["d"]) / (400 + 25 * x["d"])
        assert abs(x["e"] - true) < 0.2 and (true < 0.8 or x["near"])


# -- repeated passages -----------------------------------------------------------------------------------------------------


def without_repeats_by_hand(rows, size=13):
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            if i is not None:
                x = tuple(w[k:k + size])
                least[x] = min(i, least.get(x, i))
    out = Counter()
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - size + 1):
            if i is not None and least[tuple(w[k:k + size])] < i:
                gone |= set(range(k, k + size))
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


def test_repeated_passages(docs):
    got = substrings.without_repeats(docs, joined=True).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == without_repeats_by_hand(messy())


@pytest.mark.parametrize("still", ["every", "none", "some"])
def test_crowded_runs_are_lengthened(spark, docs, still):
    every = np.ones(1 << 16, bool)
    some = {"every": every, "none": ~every, "some": np.arange(1 << 16) % 2 == 0}[still]
    rows = substrings._rows(docs.select("doc_id", "text"), "text", "doc_id", 13, (every if still != "some" else np.arange(1 << 16) % 3 > 0, some), 4)
    nodes = rows.groupBy("g").applyInArrow(substrings._nodes, "key bigint, place bigint, mask int")
    plain = substrings.repeats(docs, 13)
    covers = lambda df: {(r["key"], (r["place"] & (1 << 40) - 1) + j) for r in df.collect() for j in range(12) if r["mask"] >> j & 1}
    assert covers(nodes) == covers(plain) != set()


def test_spans_and_plain_text_keep_the_rest(docs):
    rows = {r["doc_id"]: r for r in substrings.without_repeats(docs.where("doc_id IN (9, 10)")).collect()}
    passage = messy()[11][1].split()[:40]
    assert rows[10]["spans"][0]["from"] == 0 and rows[10]["spans"][0]["to"] == 40 and rows[10]["n_removed"] == 40
    assert not set(passage) <= set(rows[10]["text"].split()) and rows[9]["text"] == dict(messy())[9]


# -- statistics, licences, classifiers ---------------------------------------------------------------------------------


def test_statistics(docs):
    got = quality.judge(docs, None, keep=("doc_id", "text")).collect()
    assert len(got) == len(messy())
    for r in got:
        t = r["text"] or ""
        w, seen, dup = words(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        hidden = {k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hidden))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(hidden) > 30 * len(w)) and r["kept"] == (not r["base_failed"])


def test_trees_keep_their_directions_and_learn():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.2) ^ (r.random(4000) < 0.03)).astype(float)
    trees = quality.grow(x, y, [-1, 0, -1])
    assert ((trees.margin(x) > 0) == y).mean() > 0.95
    for f in (0, 2):
        grid = np.tile(r.random((200, 1, 3)), (1, 50, 1))
        grid[:, :, f] = np.linspace(0, 1, 50)
        assert (np.diff(trees.margin(grid.reshape(-1, 3)).reshape(200, 50), axis=1) <= 1e-9).all()


def test_license_phrases(docs):
    got = licenses.scan(docs, keep=("doc_id", "text")).collect()
    for r in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r["text"]))
        found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(found), ",".join(sorted({x for _, x in found})))
        assert (r["first_word"], r["last_word"]) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_license_templates_are_placed(spark):
    body = licenses.TEMPLATES["bsd"][0]
    changed = body.replace("permitted", "allowed")
    rows = [(0, "foo bar " * 30 + body + " tail"), (1, "Intro. " + changed.title()), (2, " ".join(reversed(body.split()))), (3, "redistribution of source"), (4, None)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["labels"] == "bsd" and got[0]["spans"][0]["word"] == 60 and got[0]["score"] == pytest.approx(1)
    assert got[1]["labels"] == "bsd" and 0.8 <= got[1]["score"] < 1
    assert got[2]["labels"] == got[3]["labels"] == got[4]["labels"] == ""


def labels_of(spark, n):
    return spark.range(n).selectExpr("id AS doc_id", "cast(id % 3 = 0 as int) AS toxic", "cast(id % 3 != 0 as int) AS quality")


def test_toxicity_generalises_and_ignores_other_columns(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(VOCABULARY) for _ in range(60)) + (" vile scum" if i % 3 == 0 else " kind words"), "en", i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source int")
    model = toxicity.fit(df, labels_of(spark, 600))
    out = toxicity.score(df, model).withColumn("held", labelled.held_out()).collect()
    held = [x for x in out if x["held"]]
    assert len(held) > 60 and all((x["score"] >= 0.5) == (x["doc_id"] % 3 == 0) for x in held)
    moved = toxicity.score(df.selectExpr("doc_id + 1000 AS doc_id", "text", "'xx' AS lang", "9 AS source"), model).collect()
    assert {x["doc_id"] - 1000: x["score"] for x in moved} == {x["doc_id"]: x["score"] for x in out}


def test_classifiers_on_messy_rows_and_without_labels(spark, docs, empty):
    none = labels_of(spark, 0)
    assert toxicity.fit(docs, none) is None and quality.fit(docs, none) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    labels = spark.createDataFrame([(0, 1, 0), (0, None, None), (4, 0, 1), (6, 1, 0), (9, 0, 1), (10, 1, 0), (None, 1, 1), (13, 0, 1), (14, 1, 0), (99, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    scores = [r["score"] for r in toxicity.score(docs, model).collect()]
    assert len(scores) == len(messy()) and all(0 <= s <= 1 for s in scores)
    assert toxicity.fit(empty, labels) is None and toxicity.score(empty, model).count() == 0
    assert quality.judge(docs, quality.fit(docs, labels)).count() == len(messy())


def test_importance_resampling(spark):
    r = random.Random(3)
    good = [(i, " ".join(r.choice(VOCABULARY) for _ in range(50))) for i in range(60)]
    bad = [(100 + i, " ".join(str(r.randrange(50)) for _ in range(50))) for i in range(40)]
    df = spark.createDataFrame([*good, *bad, (200, None), (200, None), (201, "")], "doc_id long, text string")
    out = importance.resample(df, df.where("doc_id < 60"), 0.6).collect()
    kept = {x["doc_id"] for x in out if x["kept"]}
    assert len(out) == 103 and set(range(60)) <= kept and not kept & set(range(100, 140))
    again = importance.resample(df.repartition(5), df.where("doc_id < 60"), 0.6).collect()
    assert sorted((str(x["doc_id"]), x["gumbel_key"]) for x in out) == sorted((str(x["doc_id"]), x["gumbel_key"]) for x in again)
    order = sorted((x["gumbel_key"] for x in out), reverse=True)
    assert {x["gumbel_key"] for x in out if x["kept"]} == set(order[:62])


def test_importance_weights_by_hand(spark):
    df = spark.createDataFrame([(0, "a b a"), (1, "c d"), (2, None)], "doc_id long, text string")
    ratio = importance.model(df, df.where("doc_id = 0"))
    b, d = importance.grams(pa.array(["a b a"]))
    got = {r["doc_id"]: r["log_weight"] for r in importance.resample(df, df.where("doc_id = 0"), 1.0).collect()}
    assert got[0] == pytest.approx(ratio[b].sum()) and got[0] > 0 > got[1] and got[2] == 0 and len(b) == 5
    assert not importance.model(df, df.where("doc_id < 0")).any()


def test_labelled_target_is_bounded_and_repeatable(spark):
    df = spark.range(50).selectExpr("id AS doc_id", "'x' AS text")
    labels = spark.createDataFrame([*((i, i % 2) for i in range(40)), (None, 1), (3, None), (77, 1)], "doc_id long, quality int")
    every = {r["doc_id"] for r in importance.labelled_target(df, labels).collect()}
    some = sorted(r["doc_id"] for r in importance.labelled_target(df, labels, rows=5).collect())
    assert every == set(range(1, 40, 2)) and len(some) <= 5 and set(some) <= every
    assert some == sorted(r["doc_id"] for r in importance.labelled_target(df.repartition(3), labels.repartition(2), rows=5).collect())


@pytest.mark.parametrize("k", [1, 2, 50, 99, 100, 101])
def test_kth_largest(spark, k):
    values = importance._ordered(np.random.default_rng(1).normal(size=100)).tolist()
    got = importance.kth_largest(spark.createDataFrame([(v,) for v in values], "x long"), "x", k)
    assert got == (sorted(values, reverse=True)[k - 1] if k <= 100 else None)


# -- pages -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain & simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br/>c", "a\nb\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"), ("<ol start=9><li>x<li>y", "9. x\n10. y"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"), ("<table><tr><td colspan=2>abcd<td>e<tr><td>x<td>y<td>z</table>", "abcd  e\nx  y  z"),
    ("<style>p{}</style><script>if (a<b) '</p>'</script>x<!-- <p>no -->y", "xy"), ("<div style='DISPLAY : none'>no<p>no</div>yes<span hidden>no</span>", "yes"),
    ("<pre>\n a\n  b</pre>", " a\n  b"), ("<b>x<p>y</b>z</p>", "x\n\nyz"), ("</p></div>x</b>", "x"), ("<a href='a>b'>l</a>", "l"), ("&lt;p&gt; &eacute; &#x41;", "<p> é A"), ("<title>t</title><h1>h</h1>t", "h\n\nt"),
    ("<select><option>a<option>b</select>", "a\nb"), ("<textarea> <b>x</b></textarea>", " <b>x</b>"), ("<dl><dt>k<dd>v<dd>w</dl>", "k\n  v\n  w"), ("a <  b", "a < b"), ("<p", ""), ("<td>x</td>", "x"), ("<p>a\n  b\t c</p>", "a b c"),
])
def test_rendering(html, text):
    assert htmltext.render(html or "") == text


def test_pages_as_rows(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    df = spark.createDataFrame([(1, None, "u"), (1, None, "u"), (2, deep, "u"), (3, "<p>" + "word " * 50_000, "u"), (None, "<" * 2000 + "a", "u")], "page_id long, html string, text string")
    got = htmltext.extract(df).collect()
    assert len(got) == 5 and {r["page_id"]: r["text"][:5] for r in got} == {1: "", 2: "x", 3: "word ", None: "<<<<<"}
    assert htmltext.extract(df.where("page_id > 9"), keep=("page_id", "text")).columns == ["page_id", "text"]


# -- all of them ---------------------------------------------------------------------------------------------------------


def test_empty_tables(spark, empty):
    assert bpe.encode(empty, PATH).count() == packing.pack_documents(empty, PATH).count() == minhash.near_duplicates(empty).count() == 0
    assert substrings.without_repeats(empty).count() == licenses.scan(empty).count() == quality.judge(empty, None).count() == importance.resample(empty, empty, 0.5).count() == 0


def test_pipeline_on_messy_rows(spark, docs, empty, tmp_path):
    labels = spark.createDataFrame([(0, 0, 1)], "doc_id long, toxic int, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table, name in ((docs, "a"), (empty, "b")):
        out = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, out, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{name}{k}")
            out = spark.read.parquet(f"{tmp_path}/{name}{k}")
            if k < 4:
                assert out.columns == corpus_pipeline.COLUMNS
            if name == "a" and k == 2:
                assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] in (0, 5, 6)) == [0]
        assert (out.count() == 0) == (name == "b")


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    judged = quality.judge(docs, None).where("base_failed = false").select("doc_id")
    clean = {r["doc_id"] for r in labels.where("toxic = 0 AND quality = 1").join(judged, "doc_id").collect()}
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    copies = {r["doc_id"] for r in minhash.near_duplicates(docs).where("NOT kept").collect()}
    assert len(clean - copies - kept) <= 0.05 * len(clean) and len(toxic & kept) <= 0.35 * len(toxic)
    check_packing(out.collect(), 4096)


def test_digest_of_the_codec_query(spark):
    from tidemark.llm.queries import QUERIES
    library = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op8_bpe_codec"](spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
