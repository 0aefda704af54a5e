"""Scans, sinks, deduplication, quality and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import dedup as D, quality as V, relational as U
from tidemark.plans.base import query, r
from tidemark.plans.sqlbits import BARS, CONTRACTS, FACTS, HOLDINGS, INSIDER, NEWS, SECURITIES
from tidemark.sources import adapters as A, readers as RD, sinks as SK, snapshots as SN
from tidemark.sources.catalog import Catalog, WAREHOUSE_DATES, WAREHOUSE_KEYS, WAREHOUSE_SYMBOLS, read_drifting
from tidemark.sources.workspace import fresh_path

AS_OF = "2024-02-01"
_NAMES = sorted(WAREHOUSE_KEYS)


@query("S1_scan_drifted_schemas", """
  SELECT CAST(symbol AS BIGINT) AS symbol, name, segment, round(sum(balance), 2) AS balance, count(*) AS n FROM (
    SELECT c_custkey AS symbol, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer
    UNION ALL BY NAME SELECT s_suppkey AS symbol, s_name AS name, s_acctbal AS balance FROM supplier) GROUP BY ALL""")
def _(spark, d):
    base = fresh_path(spark, "drift")
    A.table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_name").alias("name"),
                                         F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")).write.parquet(f"{base}/a")
    A.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_name").alias("name"),
                                         F.col("s_acctbal").alias("balance")).write.parquet(f"{base}/b")
    df = read_drifting(spark, [[f"{base}/a"], [f"{base}/b"]], {"symbol": "bigint"})
    return df.groupBy("symbol", "name", "segment").agg(r(F.sum("balance"), 2).alias("balance"), F.count("*").alias("n"))


@query("S2_prefix_filtered_scan", "SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1")
def _(spark, d):
    from tidemark.sources.catalog import TableSpec
    cat = Catalog(spark, {"nation": TableSpec(d, prefix="nation")})
    return cat.read("nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("n"))


@query("S3_snapshot_preferred", "SELECT o_custkey, count(*) AS n FROM (SELECT DISTINCT ON (o_orderkey) * FROM orders) GROUP BY 1")
def _(spark, d):
    from tidemark.sources.catalog import TableSpec
    curated = fresh_path(spark, "curated-orders")
    SK.write_snapshot(D.dedup(A.table(spark, d, "orders"), ["o_orderkey"]), curated, ["o_custkey", "o_orderdate"])
    cat = Catalog(spark, {"orders": TableSpec(f"{d}/orders.parquet", curated)})
    return cat.load("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("S4_filtered_load", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
  WHERE o_custkey IN (1,2,3,5,8,13,21) AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' AND o_orderstatus IN ('F','O')""")
def _(spark, d):
    return Catalog.warehouse(spark, d).load("orders", symbols=[1, 2, 3, 5, 8, 13, 21], start="1996-01-01", end="1999-12-31",
                                            columns=["o_orderkey", "o_custkey", "o_totalprice"], o_orderstatus=["F", "O"])


_SQL5 = """SELECT n_name, o_orderpriority, count(*) AS n, round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, o_orderpriority"""


@query("S5_raw_sql", _SQL5.replace("round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2)", "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)"))
def _(spark, d):
    return Catalog.warehouse(spark, d).sql(_SQL5).withColumn("total", F.col("total").cast("double"))


@query("S6_catalog_counts", " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS \"rows\" FROM {n}" for n in _NAMES))
def _(spark, d):
    return Catalog.warehouse(spark, d).tables()


_ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@query("S7_describe", " UNION ALL ".join(f"""SELECT {i} AS "position", '{c}' AS "column", '{t}' AS "type", true AS "nullable", count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM orders"""
                                         for i, (c, t) in enumerate(_ORDERS.items())))
def _(spark, d):
    return Catalog.warehouse(spark, d).describe("orders")


@query("S8_symbols", "SELECT DISTINCT l_suppkey AS symbol FROM lineitem")
def _(spark, d):
    return Catalog.warehouse(spark, d).symbols("lineitem")


@query("S9_date_range", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", CAST(min({c}) AS DATE) AS first_date, CAST(max({c}) AS DATE) AS last_date FROM {t}"
    for t, c in (("events", "ts"), ("lineitem", "l_shipdate"), ("orders", "o_orderdate"))))
def _(spark, d):
    return Catalog.warehouse(spark, d).date_range()


@query("S10_partitioned_append", """SELECT '2024' AS year, '01' AS month, event_type, count(*) AS n FROM events GROUP BY 3""")
def _(spark, d):
    path = fresh_path(spark, "raw-events")
    SK.write_partitioned(A.table(spark, d, "events").withColumnRenamed("ts", "fetched_at"), path)
    back = spark.read.option("basePath", path).schema("event_id long, event_type string, year string, month string").parquet(path)
    return back.groupBy("year", "month", "event_type").agg(F.count("*").alias("n"))


@query("S11_curated_snapshot", """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(spark, d):
    path = fresh_path(spark, "curated-events")
    for _i in range(2):  # the second write replaces the first
        SK.write_snapshot(D.keep_latest(A.table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]), path, ["user_id"])
    return SN.read(spark, path).select("user_id", "event_type", "event_id")


@query("S12_replace_slice", f"""WITH {HOLDINGS} SELECT snapshot, count(*) AS n, CAST(sum(market_value) AS DOUBLE) *
  CASE WHEN snapshot = 1997 THEN 2 ELSE 1 END AS total FROM holdings GROUP BY snapshot""")
def _(spark, d):
    path = fresh_path(spark, "holdings")
    h = A.holdings(spark, d)
    SK.replace_slice(h, path, "snapshot")
    SK.replace_slice(h.where("snapshot = 1997").withColumn("market_value", (F.col("market_value") * 2).cast("decimal(28,2)")), path, "snapshot")
    return spark.read.parquet(path).groupBy("snapshot").agg(F.count("*").alias("n"), F.sum("market_value").cast("double").alias("total"))


@query("S13_append_unseen", "SELECT event_type, count(*) AS n, sum(event_id) :: BIGINT AS ids FROM events GROUP BY 1")
def _(spark, d):
    path, e = fresh_path(spark, "feed"), A.table(spark, d, "events").select("event_id", "event_type", "ts")
    e.where("ts < timestamp_ntz'2024-01-20'").write.parquet(path)
    SK.append_unseen(e.where("ts >= timestamp_ntz'2024-01-10'"), path, ["event_id"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("S14_replace_from_snapshot", "SELECT c_mktsegment, count(*) AS n, true AS schema_changed FROM customer GROUP BY 1")
def _(spark, d):
    src, dst = fresh_path(spark, "src"), fresh_path(spark, "dst")
    A.table(spark, d, "supplier").write.parquet(dst)
    A.table(spark, d, "customer").write.parquet(src)
    changed = SK.replace_from(spark, src, dst)
    return SN.read(spark, dst).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.lit(changed).alias("schema_changed"))


@query("S15_delimited_scan", """SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS traded,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS amount FROM orders""")
def _(spark, d):
    path = fresh_path(spark, "pipe")
    o = A.table(spark, d, "orders")
    amount = F.when(F.col("o_orderstatus") == "P", "(D)").otherwise(F.concat(F.lit("$"), F.col("o_totalprice").cast("string")))
    line = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), amount)
    broken = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("broken|line|with|too|many")).otherwise(F.lit(None))
    o.select(F.explode(F.array_compact(F.array(line, broken)))).write.text(path)
    return RD.read_delimited(spark, path, ["order_id", "traded", "amount"], ["amount"], ["traded"], header=False).withColumn(
        "order_id", F.col("order_id").try_cast("bigint"))


_DOC = "cik bigint, name string, facts array<struct<concept:string,end:date,val:double>>"


def _company_docs(spark, d):
    """One JSON document per customer row, facts derived from the row itself."""
    c = A.table(spark, d, "customer")
    fact = lambda name, v, m: F.struct(F.lit(name).alias("concept"), F.make_date(F.lit(2000), F.lit(m), F.lit(28)).alias("end"), v.alias("val"))
    return c.select(F.to_json(F.struct(F.col("c_custkey").alias("cik"), F.col("c_name").alias("name"), F.array(
        fact("Balance", F.col("c_acctbal"), 3), fact("Key", F.col("c_nationkey").cast("double"), 6)).alias("facts"))).alias("value"))


@query("S16_json_documents", """SELECT c_custkey AS cik, c_name AS name, concept, make_date(2000, m, 28) AS "end", val FROM (
  SELECT c_custkey, c_name, 'Balance' AS concept, 3 AS m, c_acctbal AS val FROM customer UNION ALL
  SELECT c_custkey, c_name, 'Key', 6, CAST(c_nationkey AS DOUBLE) FROM customer)""")
def _(spark, d):
    path = fresh_path(spark, "json")
    docs = _company_docs(spark, d)
    docs.unionByName(docs.select(F.lit("not json").alias("value"))).write.text(path)
    return RD.read_documents(spark, path, _DOC).where("cik is not null").select("cik", "name", F.inline("facts"))


@query("S17_xml_scan", "SELECT p_name AS issuer, CAST(p_partkey AS VARCHAR) AS cusip, p_retailprice AS value, CAST(p_size AS BIGINT) AS shares FROM part")
def _(spark, d):
    path = fresh_path(spark, "xml")
    p = A.table(spark, d, "part")
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), F.col(c).cast("string"), F.lit(f"</{n}>"))
    p.select(F.concat(F.lit("<informationTable><infoTable>"), tag("nameOfIssuer", "p_name"), tag("cusip", "p_partkey"), tag("value", "p_retailprice"),
                      F.lit("<shrsOrPrnAmt>"), tag("sshPrnamt", "p_size"), F.lit("</shrsOrPrnAmt></infoTable></informationTable>"))).write.text(path)
    schema = "nameOfIssuer:string,cusip:string,value:double,shrsOrPrnAmt:struct<sshPrnamt:bigint>"
    return RD.read_xml_rows(spark, path, "infoTable", schema).select(
        F.col("nameOfIssuer").alias("issuer"), "cusip", "value", F.col("shrsOrPrnAmt.sshPrnamt").alias("shares"))


@query("S18_form_index_scan", """SELECT CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN 'SC 13D/A' ELSE '4' END AS form,
  'Customer ' || o_custkey || ' Holdings  Inc' AS company, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik,
  CAST(o_orderdate AS DATE) AS date_filed, 'data/' || o_orderkey || '.txt' AS filename FROM orders""")
def _(spark, d):
    o = A.table(spark, d, "orders")
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "SC 13D/A").otherwise("4")
    line = F.concat(F.rpad(form, 17, " "), F.rpad(F.concat(F.lit("Customer "), F.col("o_custkey"), F.lit(" Holdings  Inc")), 62, " "),
                    F.rpad(F.col("o_custkey").cast("string"), 12, " "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("  "),
                    F.concat(F.lit("data/"), F.col("o_orderkey"), F.lit(".txt")))
    return RD.parse_form_index(o.select(line.alias("value")))


# --- deduplication ---------------------------------------------------------------------------

@query("D1_keep_latest", """SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(spark, d):
    return D.keep_latest(A.table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"])


@query("D2_compact_line_items", """SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC,
  l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem) WHERE rn = 1""")
def _(spark, d):
    return D.keep_latest(A.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@query("D3_full_row_fallback", """SELECT text, lang, source, max(doc_id) AS fetched_at FROM documents GROUP BY 1, 2, 3""")
def _(spark, d):
    docs = A.table(spark, d, "documents").select("text", "lang", "source", F.col("doc_id").alias("fetched_at"))
    return D.dedup(docs, ["text", "snapshot_date"])  # the key is incomplete, so all columns decide


@query("D4_canonical_key", """SELECT o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS period_end, max(o_orderkey) AS o_orderkey
  FROM orders GROUP BY 1, 2""")
def _(spark, d):
    mixed = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    o = A.table(spark, d, "orders").select("o_custkey", mixed.alias("period_end"), "o_orderkey")
    return D.keep_latest(o.withColumn("period_end", D.canonical_date("period_end")), ["o_custkey", "period_end"], ["o_orderkey"])


@query("D5_backfill_snapshot_date", """SELECT coalesce(CASE WHEN event_type = 'click' THEN NULL ELSE CAST(ts AS DATE) + 1 END, CAST(ts AS DATE))
  AS snapshot_date, count(*) AS n FROM events GROUP BY 1""")
def _(spark, d):
    e = A.table(spark, d, "events").select(F.col("ts").alias("fetched_at"), F.when(
        F.col("event_type") != "click", F.date_add(F.to_date("ts"), 1)).alias("snapshot_date"))
    return D.backfill_snapshot_date(e).groupBy("snapshot_date").agg(F.count("*").alias("n"))


@query("D6_key_registry", " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", '{','.join(k)}' AS natural_key, (SELECT count(*) FROM {n}) - (SELECT count(*) FROM (SELECT DISTINCT {','.join(k)} FROM {n})) AS duplicates"
    for n, k in sorted(WAREHOUSE_KEYS.items()) if k))
def _(spark, d):
    cat = Catalog.warehouse(spark, d)
    parts = [cat.read(n).groupBy(*k).count().agg((F.sum("count") - F.count("*")).alias("duplicates"))
             .select(F.lit(n).alias("table"), F.lit(",".join(k)).alias("natural_key"), "duplicates") for n, k in WAREHOUSE_KEYS.items() if k]
    return U.union_all(parts)


def _report_sql(t, keys):
    return f"""SELECT '{t}' AS "table", raw_rows, curated_rows, raw_rows - curated_rows AS removed,
      round(100.0::DOUBLE * (raw_rows - curated_rows) / raw_rows, 2) AS pct_removed, 100.0 * (raw_rows - curated_rows) / raw_rows > 5 AS over_gate
      FROM (SELECT (SELECT count(*) FROM {t}) AS raw_rows, (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {t})) AS curated_rows)"""


@query("D7_compaction_report", " UNION ALL ".join([_report_sql("lineitem", "l_orderkey, l_linenumber"), _report_sql("events", "event_id"),
                                                   _report_sql("orders", "o_custkey, o_orderdate")]))
def _(spark, d):
    t = lambda n: A.table(spark, d, n)
    return U.union_all([D.compaction_report(t("lineitem"), ["l_orderkey", "l_linenumber"], "lineitem"),
                        D.compaction_report(t("events"), ["event_id"], "events"),
                        D.compaction_report(t("orders"), ["o_custkey", "o_orderdate"], "orders")])


@query("D8_prefer_first_source", f"""WITH {INSIDER}, {NEWS}, a AS (SELECT symbol, date, max(filing_id) AS id, 'insider' AS src FROM insider GROUP BY 1, 2),
  b AS (SELECT symbol, date, max(article_id) AS id, 'news' AS src FROM news GROUP BY 1, 2)
  SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.symbol = b.symbol AND a.date = b.date)""")
def _(spark, d):
    a = A.insider(spark, d).select("symbol", "date", F.col("filing_id").alias("id"), F.lit("insider").alias("src"))
    b = A.news(spark, d).select("symbol", "date", F.col("article_id").alias("id"), F.lit("news").alias("src"))
    return D.prefer_first(a, b, ["symbol", "date"])


@query("D9_duplicate_rate", """SELECT 'lineitem' AS "table", (SELECT count(*) FROM lineitem) AS "rows", (SELECT count(*) FROM lineitem) -
  (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE l_partkey FROM lineitem)) AS duplicates""")
def _(spark, d):
    return D.duplicate_rate(A.table(spark, d, "lineitem"), ["l_partkey"], "lineitem")


@query("D10_longest_source", f"""WITH {FACTS}, n AS (SELECT symbol, form, count(*) AS n FROM facts GROUP BY 1, 2),
  best AS (SELECT symbol, form FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, form) AS rn FROM n) WHERE rn = 1)
  SELECT f.symbol, f.form, f.accn, f.value FROM facts f JOIN best USING (symbol, form)""")
def _(spark, d):
    f = A.facts(spark, d).select("symbol", "form", "accn", "value")
    pri = F.when(F.col("form") == "10-K", 0).when(F.col("form") == "10-Q", 1).otherwise(2)
    return D.longest_source(f, "symbol", "form", pri).select("symbol", "form", "accn", "value")


@query("D11_source_coverage", """SELECT src, n, row_number() OVER (ORDER BY n DESC, src) AS place FROM (
  SELECT 'lineitem' AS src, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey UNION ALL
  SELECT 'orders', count(DISTINCT o_custkey) FROM orders JOIN supplier ON o_custkey = s_suppkey UNION ALL
  SELECT 'events', count(DISTINCT user_id) FROM events JOIN supplier ON user_id = s_suppkey)""")
def _(spark, d):
    from pyspark.sql import Window as W
    want = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"))
    parts = [A.table(spark, d, t).select(F.col(c).alias("symbol")).distinct().join(want, "symbol", "left_semi")
             .agg(F.count("*").alias("n")).select(F.lit(t).alias("src"), "n") for t, c in (("lineitem", "l_suppkey"), ("orders", "o_custkey"), ("events", "user_id"))]
    # one row per source table, so the unpartitioned window sorts a handful of rows
    return U.union_all(parts).withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "src")).cast("bigint"))


# --- quality ---------------------------------------------------------------------------------

@query("V1_validate_events", """WITH a AS (SELECT count(*) AS n, count(*) FILTER (value IS NULL) AS nv, count(*) FILTER (CASE WHEN event_type <> 'click' THEN user_id END IS NULL) AS nu,
   count(*) FILTER (CAST(ts AS DATE) > DATE '2024-01-25') AS fut, count(*) FILTER (value < 0 OR value > 200) AS o FROM events)
  SELECT 'events' AS "table", 'not_empty' AS "check", 'ok' AS severity, CAST(n AS DOUBLE) AS measure FROM a UNION ALL
  SELECT 'events', 'required_cols', 'error', 1 FROM a UNION ALL
  SELECT 'events', 'nulls:value', CASE WHEN nv > .5*n THEN 'error' WHEN nv > .05*n THEN 'warning' ELSE 'ok' END, nv FROM a UNION ALL
  SELECT 'events', 'nulls:buyer', CASE WHEN nu > .5*n THEN 'error' WHEN nu > .05*n THEN 'warning' ELSE 'ok' END, nu FROM a UNION ALL
  SELECT 'events', 'future_dates', CASE WHEN fut > 0 THEN 'warning' ELSE 'ok' END, fut FROM a UNION ALL
  SELECT 'events', 'range:value', CASE WHEN o > 0 THEN 'warning' ELSE 'ok' END, o FROM a UNION ALL
  SELECT 'events', 'row_count', CASE WHEN n < 50000 THEN 'warning' ELSE 'ok' END, n FROM a""")
def _(spark, d):
    return _checks(spark, d)


def _checks(spark, d):
    e = A.table(spark, d, "events").withColumn("buyer", F.when(F.col("event_type") != "click", F.col("user_id")))
    schema = V.TableSchema(required=("event_id", "ts", "session"), critical=("value", "buyer"), date_col="ts", ranges={"value": (0, 200)})
    return V.validate(e, schema, "events", "2024-01-25", previous_rows=100_000)


@query("V1_ingestion_age", """WITH e AS (SELECT max(ts) AS newest FROM events), h AS (SELECT epoch_us(TIMESTAMP '2024-02-01') - epoch_us(newest) AS us FROM e),
  o AS (SELECT epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(o_orderdate)) AS us FROM orders)
  SELECT 'events' AS "table", CASE WHEN us <= 48 * 3.6e9 THEN 'ok' ELSE 'warning' END AS severity, round(us / 3.6e9::DOUBLE, 6) AS age_hours FROM h UNION ALL
  SELECT 'orders', CASE WHEN us <= 48 * 3.6e9 THEN 'ok' ELSE 'warning' END, round(us / 3.6e9::DOUBLE, 6) FROM o UNION ALL SELECT 'lineitem', CASE WHEN count(*) >= 0 THEN 'warning' END, NULL FROM lineitem UNION ALL SELECT 'part', CASE WHEN count(*) >= 0 THEN 'ok' END, NULL FROM part""")
def _(spark, d):
    """Fresh rows, old rows, rows whose ingestion time does not parse, and a table without one."""
    t = lambda n: A.table(spark, d, n)
    cases = {"events": t("events").withColumnRenamed("ts", "fetched_at"), "orders": t("orders").withColumnRenamed("o_orderdate", "fetched_at"),
             "lineitem": t("lineitem").withColumn("fetched_at", F.concat(F.lit("batch "), F.col("l_orderkey"))), "part": t("part")}
    parts = [V.validate(df, V.TableSchema(), n, AS_OF, max_age_hours=48).where("check = 'fetched_at'") for n, df in cases.items()]
    return U.union_all(parts).select("table", "severity", r("measure").alias("age_hours"))


def _batches(spark, df, cuts):
    """Ingestion folders of a table, one for each range of days, written one after the other."""
    base = fresh_path(spark, "raw-batches")
    for i, cut in enumerate(cuts):
        df.where(cut).write.parquet(f"{base}/batch={i}")
    return base


_EVENT_CUTS = ["ts < timestamp_ntz'2024-01-12'", "ts >= timestamp_ntz'2024-01-20'", "ts >= timestamp_ntz'2024-01-12' AND ts < timestamp_ntz'2024-01-20'"]


@query("V2_latest_file", """SELECT 'events' AS "table", CASE WHEN count(*) = 0 THEN 'NO DATA' ELSE 'PASS' END AS status, CAST(count(*) = 0 AS BIGINT) AS errors,
   CAST(count(*) FILTER (value < 0 OR value > 200) > 0 AS BIGINT) AS warnings, count(*) AS "rows" FROM events WHERE ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-20' UNION ALL
  SELECT 'orders', CASE WHEN count(*) = 0 THEN 'NO DATA' ELSE 'FAIL' END, 1 + CAST(count(*) = 0 AS BIGINT), 0, count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'""")
def _(spark, d):
    """The newest folder of events holds days of the middle; orders lacks a column that its schema asks for."""
    e = spark.read.option("basePath", (b := _batches(spark, A.table(spark, d, "events"), _EVENT_CUTS))).parquet(b)
    o = spark.read.parquet(_batches(spark, A.table(spark, d, "orders"), ["o_orderdate < timestamp_ntz'1997-01-01'", "o_orderdate >= timestamp_ntz'1997-01-01'"]))
    return V.validate_latest({"events": (e, V.TableSchema(("event_id",), ("value",), "ts", ranges={"value": (0, 200)})), "orders": (o, V.TableSchema(("o_orderkey", "o_channel")))}, AS_OF)


@query("V2_verdict", """SELECT 'events' AS "table", 'FAIL' AS status, CAST(1 AS BIGINT) AS errors, 1 + (SELECT CAST(count(*) FILTER (CAST(ts AS DATE) > DATE '2024-01-25') > 0 AS BIGINT)
   + CAST(count(*) FILTER (value < 0 OR value > 200) > 0 AS BIGINT) + CAST(count(*) < 50000 AS BIGINT) FROM events) AS warnings UNION ALL
  SELECT 'orders', 'PASS', 0, 0""")
def _(spark, d):
    o = V.validate(A.table(spark, d, "orders"), V.TableSchema(("o_orderkey",), ("o_totalprice",), "o_orderdate"), "orders", AS_OF)
    return V.verdict(_checks(spark, d).unionByName(o))


# columns and types that queries of this library rely on; ``o_channel`` and a numeric text stand for what an upstream change breaks
SCHEMAS = {"orders": {"o_orderkey": "bigint", "o_totalprice": "double", "o_orderdate": "date", "o_channel": "string"}, "events": {"event_id": "bigint", "value": "double", "ts": "timestamp_ntz"},
           "lineitem": {"l_shipdate": "date", "l_quantity": "double"}, "customer": {"c_custkey": "bigint", "c_phone": "bigint"}, "documents": {"doc_id": "bigint", "text": "string", "lang": "string"},
           "part": {"p_name": "int"}, "conversations": {"conv_id": "bigint", "turn": "int", "role": "string"}}
_DUCK = {"bigint": "BIGINT", "double": "DOUBLE", "date": "DATE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "int": "INTEGER"}


def _schema_sql():
    rows = []
    for t, cols in SCHEMAS.items():
        for c, k in cols.items():
            rows.append(f"SELECT '{t}', '{c}', '{k}', NULL::BIGINT, NULL::BIGINT, 'error'" if c in ("o_channel", "c_phone") else
                        f"SELECT '{t}', '{c}', '{k}', count(*) FILTER ({c} IS NULL), count(*) FILTER ({c} IS NOT NULL AND try_cast({c} AS {_DUCK[k]}) IS NULL), CASE WHEN count(*) FILTER ({c} IS NOT NULL AND try_cast({c} AS {_DUCK[k]}) IS NULL) > 0 THEN 'warning' ELSE 'ok' END FROM {t}")
    return f"""WITH s("table", "column", expected, nulls, bad_casts, status) AS ({" UNION ALL ".join(rows)}) SELECT * FROM s"""


@query("V3_schema_registry", _schema_sql())
def _(spark, d):
    """Every registered column of every hosted table: there, and castable."""
    return V.schema_check({t: A.table(spark, d, t) for t in SCHEMAS}, SCHEMAS).drop("found")


@query("V4_row_count_by_file", """WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), s AS (SELECT count(*) AS snapshots, arg_max(n, day) AS latest, avg(n) AS mean, stddev_pop(n) AS std FROM c)
  SELECT 'events' AS "table", snapshots, latest, round(mean, 6) AS mean, round(std, 6) AS std, round((latest - mean) / std, 6) + 0.0::DOUBLE AS z, CASE WHEN abs((latest - mean) / std) > 3 THEN 'high' WHEN abs((latest - mean) / std) > 2 THEN 'medium' END AS severity FROM s WHERE snapshots >= 5 AND std > 0""")
def _(spark, d):
    """Snapshots are the folders of the scan, one a day; counts come from the files' metadata, no data column is read."""
    base = fresh_path(spark, "daily")
    A.table(spark, d, "events").withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").parquet(base)
    e = spark.read.parquet(base).select(F.lit("events").alias("table"), F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1).alias("folder"))
    return V.row_count_anomaly(e, "table", "folder").select("table", "snapshots", "latest", r("mean").alias("mean"), r("std").alias("std"), r("z").alias("z"), "severity")


@query("V4_row_count_anomaly", """WITH c AS (SELECT event_type, CAST(ts AS DATE) AS snap, count(*) AS n FROM events GROUP BY 1, 2),
  s AS (SELECT event_type, count(*) AS snapshots, arg_max(n, snap) AS latest, avg(n) AS mean, stddev_pop(n) AS std FROM c GROUP BY 1)
  SELECT event_type, snapshots, latest, round(mean, 6) AS mean, round(std, 6) AS std, round((latest - mean) / std, 6) + 0.0::DOUBLE AS z,
   CASE WHEN abs((latest - mean) / std) > 3 THEN 'high' WHEN abs((latest - mean) / std) > 2 THEN 'medium' END AS severity FROM s WHERE snapshots >= 5 AND std > 0""")
def _(spark, d):
    e = A.table(spark, d, "events").select("event_type", F.to_date("ts").alias("snap"))
    return V.row_count_anomaly(e, "event_type", "snap").select("event_type", "snapshots", "latest", r("mean").alias("mean"), r("std").alias("std"), r("z").alias("z"), "severity")


@query("V5_outlier_share", """SELECT 'lineitem' AS "table", c AS "column", o AS outliers, round(100.0::DOUBLE * o / n, 4) AS pct,
  CASE WHEN 100.0 * o / n > 10 THEN 'high' WHEN 100.0 * o / n > 1 THEN 'medium' ELSE 'low' END AS severity FROM (
  SELECT 'l_quantity' AS c, count(*) FILTER (l_quantity < 1 OR l_quantity > 45) AS o, count(*) AS n FROM lineitem UNION ALL
  SELECT 'l_discount', count(*) FILTER (l_discount < 0 OR l_discount > 0.2), count(*) FROM lineitem UNION ALL
  SELECT 'l_extendedprice', count(*) FILTER (l_extendedprice < 0 OR l_extendedprice > 104000), count(*) FROM lineitem) WHERE o > 0""")
def _(spark, d):
    return V.outlier_share(A.table(spark, d, "lineitem"), {"l_quantity": (1, 45), "l_discount": (0, 0.2), "l_extendedprice": (0, 104000)}, "lineitem")


@query("V6_temporal_gaps", """WITH g AS (SELECT l_suppkey AS symbol, dt, dt - lag(dt) OVER (PARTITION BY l_suppkey ORDER BY dt) AS gap FROM
  (SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS dt FROM lineitem))
  SELECT symbol, count(*) FILTER (gap > 14) AS gaps, CAST(max(gap) AS INTEGER) AS max_gap FROM g GROUP BY 1 HAVING count(*) FILTER (gap > 14) > 0""")
def _(spark, d):
    li = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("dt"))
    return V.temporal_gaps(li, "symbol", "dt", 14)


@query("V7_freshness", " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", count(*) AS "rows", CAST(CAST(max({c}) AS DATE) AS VARCHAR) AS latest, 24.0::DOUBLE * (DATE '2024-02-01' - CAST(max({c}) AS DATE)) AS staleness_hours,
    CASE WHEN 24 * (DATE '2024-02-01' - CAST(max({c}) AS DATE)) <= 48 THEN 'FRESH' WHEN 24 * (DATE '2024-02-01' - CAST(max({c}) AS DATE)) <= 168 THEN 'STALE' ELSE 'STALE_CRITICAL' END AS status FROM {t}"""
    for t, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))) + """ UNION ALL
    SELECT 'part', count(*), NULL, NULL, 'NO DATE COL' FROM part""")
def _(spark, d):
    t = lambda n: A.table(spark, d, n)
    return V.freshness({"events": (t("events"), "ts"), "orders": (t("orders"), "o_orderdate"), "lineitem": (t("lineitem"), "l_shipdate"), "part": (t("part"), None)}, AS_OF).withColumn(
        "latest", F.col("latest").cast("string"))


@query("V8_reconcile", """WITH r AS (SELECT event_type, count(*) AS raw_rows FROM events GROUP BY 1),
  c AS (SELECT event_type, count(DISTINCT (user_id, event_type)) AS curated_rows FROM events WHERE event_type <> 'view' GROUP BY 1)
  SELECT event_type, raw_rows, coalesce(curated_rows, 0) AS curated_rows, CASE WHEN curated_rows > raw_rows THEN 'curated_exceeds_raw'
   WHEN coalesce(curated_rows, 0) = 0 THEN 'missing_in_curated' ELSE 'ok' END AS status FROM r LEFT JOIN c USING (event_type)""")
def _(spark, d):
    e = A.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return V.reconcile(e, D.keep_latest(e.where("event_type <> 'view'"), ["user_id", "event_type"], ["ts", "event_id"]), "event_type")


@query("V8_stale_snapshot", """SELECT 'events' AS "table", count(*) AS raw_rows, count(*) FILTER (ts < TIMESTAMP '2024-01-12' OR ts >= TIMESTAMP '2024-01-20') AS curated_rows, true AS stale, 'snapshot_older_than_raw' AS status FROM events UNION ALL
  SELECT 'orders', count(*), count(DISTINCT o_custkey), false, 'ok' FROM orders UNION ALL SELECT 'supplier', count(*), 2 * count(*), false, 'curated_exceeds_raw' FROM supplier""")
def _(spark, d):
    """Events got another raw folder after their snapshot; the snapshot of orders is newer than its files; that of supplier holds rows twice."""
    e, o, p = (A.table(spark, d, t) for t in ("events", "orders", "supplier"))
    raw, snap = _batches(spark, e, _EVENT_CUTS[:2]), [fresh_path(spark, "curated") for _i in range(3)]
    SK.write_snapshot(spark.read.option("basePath", raw).parquet(raw), snap[0])
    e.where(_EVENT_CUTS[2]).write.parquet(f"{raw}/batch=2")
    SK.write_snapshot(D.keep_latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]), snap[1])
    SK.write_snapshot(p.unionAll(p), snap[2])
    return V.stale_snapshots({"events": (spark.read.parquet(raw), SN.read(spark, snap[0])), "orders": (o, SN.read(spark, snap[1])), "supplier": (p, SN.read(spark, snap[2]))})


@query("V9_constant_columns", """SELECT 'event_type' AS "column", count(DISTINCT event_type) AS distinct_values, false AS suspicious FROM events UNION ALL
  SELECT 'year', count(DISTINCT year(ts)), count(DISTINCT year(ts)) <= 2 FROM events UNION ALL SELECT 'month', count(DISTINCT month(ts)), count(DISTINCT month(ts)) <= 2 FROM events""")
def _(spark, d):
    e = A.table(spark, d, "events").select("event_type", F.year("ts").alias("year"), F.month("ts").alias("month"))
    return V.constant_columns(e, ["event_type", "year", "month"])


@query("V10_publication_checks", """WITH a AS (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)) AS dup,
  DATE '2024-02-01' - CAST(max(o_orderdate) AS DATE) AS age FROM orders)
  SELECT 'orders' AS "table", 'min_rows' AS "check", CASE WHEN n < 1000 THEN 'fail' ELSE 'pass' END AS severity, CAST(n AS DOUBLE) AS measure FROM a UNION ALL
  SELECT 'orders', 'null_key', 'pass', 0 FROM a UNION ALL SELECT 'orders', 'duplicate_key', CASE WHEN dup > 0 THEN 'fail' ELSE 'pass' END, dup FROM a UNION ALL
  SELECT 'orders', 'stale', CASE WHEN age > 30 THEN 'fail' ELSE 'pass' END, age FROM a""")
def _(spark, d):
    return V.publication_checks(A.table(spark, d, "orders"), ["o_custkey", "o_orderdate"], "o_orderdate", AS_OF, 1000, 30, "orders")


@query("V10_wide_key", """SELECT 'orders' AS "table", count(*) AS "rows", count(DISTINCT o_custkey) AS symbols, count(*) - count(DISTINCT (o_custkey, o_orderdate)) AS duplicate_keys,
   CASE WHEN count(*) > count(DISTINCT (o_custkey, o_orderdate)) THEN 'fail' ELSE 'pass' END AS status FROM orders UNION ALL
  SELECT 'lineitem', count(*), count(DISTINCT l_suppkey), 0, 'pass' FROM (SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS day FROM lineitem)""")
def _(spark, d):
    days = A.table(spark, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day")).distinct()
    return V.wide_key(A.table(spark, d, "orders"), ["o_custkey", "o_orderdate"], "orders").unionByName(V.wide_key(days, ["l_suppkey", "day"], "lineitem"))


@query("V10_count_coherence", """WITH m AS (SELECT 'orders' AS "table", count(DISTINCT o_orderkey) AS declared FROM orders UNION ALL SELECT 'customer', count(*) + 1 FROM customer UNION ALL SELECT 'parts', count(*) FROM part),
  a AS (SELECT 'orders' AS "table", count(*) AS actual FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part)
  SELECT "table", declared, actual, CASE WHEN declared = actual THEN 'pass' ELSE 'fail' END AS status FROM m FULL JOIN a USING ("table")""")
def _(spark, d):
    """A manifest with one right count, one wrong count and one wrong name."""
    t = lambda n: A.table(spark, d, n)
    manifest = U.union_all([t("orders").agg(F.count_distinct("o_orderkey").alias("rows")).withColumn("table", F.lit("orders")), t("customer").agg((F.count("*") + 1).alias("rows")).withColumn("table", F.lit("customer")),
                            t("part").agg(F.count("*").alias("rows")).withColumn("table", F.lit("parts"))])
    return V.count_coherence(manifest, {n: t(n) for n in ("orders", "customer", "part")})


@query("V11_missing_members", """SELECT s_suppkey AS member, y AS chunk FROM supplier, (VALUES (1995),(1998),(2001),(2002)) v(y)
  WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND year(l_shipdate) = y)""")
def _(spark, d):
    present = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("member"), F.year("l_shipdate").alias("chunk"))
    expected = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("member"))
    return V.missing_members(expected, [1995, 1998, 2001, 2002], present, "member", "chunk")


def _alignment_sql():
    have = {"keys": set(WAREHOUSE_KEYS), "dates": set(WAREHOUSE_DATES), "schemas": set(SCHEMAS), "symbols": set(WAREHOUSE_SYMBOLS)}
    rows = [(n, ",".join(k for k in sorted(have) if n in have[k])) for n in sorted(set().union(*have.values())) if any(n not in have[k] for k in have)]
    return " UNION ALL ".join(f"SELECT '{n}' AS name, '{p}' AS present_in, count(*) AS \"rows\" FROM {n}" for n, p in rows)


@query("V12_registry_alignment", _alignment_sql())
def _(spark, d):
    """Names of the key, date, symbol and schema registries that another registry lacks, with the rows of the table behind each."""
    odd = V.alignment(spark, {"keys": list(WAREHOUSE_KEYS), "dates": list(WAREHOUSE_DATES), "symbols": list(WAREHOUSE_SYMBOLS), "schemas": list(SCHEMAS)})
    sizes = U.union_all([A.table(spark, d, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n in _NAMES])
    return odd.join(sizes, "name")


# --- set operations --------------------------------------------------------------------------

@query("U1_union_by_name", f"""WITH {INSIDER}, {NEWS} SELECT kind, count(*) AS n, count(side) AS sides, count(topic) AS topics FROM (
  SELECT 'insider' AS kind, symbol, side, NULL AS topic FROM insider UNION ALL SELECT 'news', symbol, NULL, topic FROM news) GROUP BY 1""")
def _(spark, d):
    u = U.union_all([A.insider(spark, d).select(F.lit("insider").alias("kind"), "symbol", "side"), A.news(spark, d).select(F.lit("news").alias("kind"), "symbol", "topic")])
    return u.groupBy("kind").agg(F.count("*").alias("n"), F.count("side").alias("sides"), F.count("topic").alias("topics"))


@query("U2_symmetric_difference", """SELECT k, 'left_only' AS side FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT user_id FROM events) UNION ALL
  SELECT k, 'right_only' FROM (SELECT user_id AS k FROM events EXCEPT SELECT o_custkey FROM orders)""")
def _(spark, d):
    return U.symmetric_difference(A.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), A.table(spark, d, "events").select(F.col("user_id").alias("k")))


@query("U3_intersect", "SELECT l_suppkey AS k FROM lineitem INTERSECT SELECT user_id FROM events")
def _(spark, d):
    return A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")).intersect(A.table(spark, d, "events").select(F.col("user_id").alias("k")))


@query("U4_sort_nulls_last", """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal FROM customer ORDER BY bal DESC NULLS LAST, c_custkey""")
def _(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"))
    return c.orderBy(F.col("bal").desc_nulls_last(), "c_custkey")


@query("U5_ordered_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
