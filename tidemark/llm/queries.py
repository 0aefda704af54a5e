"""Registered queries: every operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import alignment, bpe, decontaminate, hilbert, htmltext, importance, labelled, licenses, minhash, packing, quality, substrings, toxicity, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
VOCABULARY = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path(VOCABULARY), 4096)


@query("op2_minhash_near_dedup")
def op2(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), size=2)


@query("op3_license_scan")
def op3(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir, "doc_id", "text")).drop("spans")


@query("op4_importance_resampling")
def op4(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality IN (0, 1)")
    target = importance.labelled_target(docs, labels)
    share = labels.agg(F.avg("quality").alias("s")).head()["s"]  # as many as the labels say are like the target
    return importance.resample(docs, target, 1.0 if share is None else share)


@query("op5_toxicity")
def op5(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_hilbert_neighbours")
def op6(spark, sf_dir):
    return hilbert.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


@query("op7_quality_rules")
def op7(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    return quality.judge(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op8_bpe_codec")
def op8(spark, sf_dir):
    coded = bpe.encode(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path(VOCABULARY), decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT v, min(doc_id) AS least FROM s GROUP BY v),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT s.doc_id, unnest(range(s.i, s.i + 13)) AS p FROM s JOIN m USING (v) WHERE s.doc_id > m.least)),
k AS (SELECT d.doc_id, d.p, d.x FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d) d ANTI JOIN c ON c.doc_id = d.doc_id AND c.p = d.p),
t AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(t.n, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)""")
def op9(spark, sf_dir):
    left = substrings.without_repeats(documents(spark, sf_dir, "doc_id", "text"), joined=True)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op10_html_extraction")
def op10(spark, sf_dir):
    return htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=("page_id", "url"))


@query("op11_benchmark_decontamination", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS v FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS v FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v))),
h AS (SELECT s.doc_id, s.i, s.n, v.item_id FROM s JOIN v USING (n, v)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)""")
def op11(spark, sf_dir):
    found = decontaminate.scan(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op12_conversation_trie", r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT c, c - c % 20 AS b, n, xor(4294967295, list_reduce(range(0, 8 * len(c::VARCHAR)), lambda a, i: CASE WHEN xor(a, CASE WHEN i % 8 = 0 THEN ascii(substr(c::VARCHAR, (i // 8 + 1)::BIGINT, 1)) ELSE 0 END) % 2 = 1
  THEN xor(xor(a, CASE WHEN i % 8 = 0 THEN ascii(substr(c::VARCHAR, (i // 8 + 1)::BIGINT, 1)) ELSE 0 END) // 2, 3988292384) ELSE xor(a, CASE WHEN i % 8 = 0 THEN ascii(substr(c::VARCHAR, (i // 8 + 1)::BIGINT, 1)) ELSE 0 END) // 2 END, 4294967295::BIGINT)) % 4 AS h
  FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
k AS (SELECT g.c, g.b, g.h, least(g.h, coalesce(o.n, 0)) AS k, least(g.h, coalesce(o.n, 0)) + greatest(g.n - g.h, 0) AS size FROM g LEFT JOIN g o ON o.c = g.b),
r AS (SELECT k.c, t.p AS d, t.role, t.text FROM k JOIN t ON t.c = k.b AND t.p <= k.k UNION ALL SELECT k.c, t.p - k.h + k.k, t.role, t.text FROM k JOIN t ON t.c = k.c AND t.p > k.h),
s AS (SELECT c, d, text, string_agg(len(role)::VARCHAR || ':' || role || len(text)::VARCHAR || ':' || text, '') OVER (PARTITION BY c ORDER BY d) AS v FROM r UNION ALL SELECT c, 0, '', '' FROM k),
v AS (SELECT d, v, min(c) AS c, count(*) AS n, min(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS w FROM s GROUP BY d, v),
e AS (SELECT s.d, s.v, string_agg(s.c::VARCHAR, ',' ORDER BY s.c) AS ids FROM s JOIN k ON k.c = s.c AND k.size = s.d GROUP BY s.d, s.v),
m AS (SELECT s.c, s.d, v.c AS least FROM s JOIN v ON v.d = s.d AND v.v = s.v),
q AS (SELECT v.c, v.d, v.n, v.w, m.least AS parent FROM v LEFT JOIN m ON m.c = v.c AND m.d = v.d - 1),
f AS (SELECT parent AS c, d - 1 AS d, count(*) AS n FROM q WHERE parent IS NOT NULL GROUP BY 1, 2),
x AS (SELECT m.least AS c, m.d, sum((f.n IS NULL)::INT) AS leaves, sum((q.n - 1) * q.w) AS saved FROM q LEFT JOIN f ON f.c = q.c AND f.d = q.d JOIN m ON m.c = q.c AND m.d <= q.d GROUP BY 1, 2)
SELECT q.c AS conv_id, q.d::BIGINT AS depth, q.parent AS parent_conv_id, q.n AS n_convs, coalesce(f.n, 0)::BIGINT AS n_children, x.leaves::BIGINT AS n_leaves, x.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM q LEFT JOIN f ON f.c = q.c AND f.d = q.d JOIN x ON x.c = q.c AND x.d = q.d JOIN v ON v.c = q.c AND v.d = q.d LEFT JOIN e ON e.d = v.d AND e.v = v.v""")
def op12(spark, sf_dir):
    return trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("enter", "exit")


@query("op13_cross_tokenizer_alignment")
def op13(spark, sf_dir):
    a, ranks, b = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
    return alignment.align(documents(spark, sf_dir, "doc_id", "text"), a, b, ranks).withColumnRenamed("groups", "groups_sha256")
