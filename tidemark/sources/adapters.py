"""Domain tables (bars, facts, insider trades ...) derived from the warehouse tables.

Every adapter is a projection or a map-side-combined aggregate over the whole table.  Bars are
one row per (symbol, day), so the rows of one symbol are bounded by the calendar however many
trades it has: that bound is what makes later per-symbol windows safe for a hot symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: warehouse code -> domain name
METRIC_OF_PRIORITY = {"1": "eps", "2": "revenue", "3": "net_income", "4": "total_assets", "5": "gross_profit"}
FORM_OF_STATUS = {"F": "10-K", "O": "10-Q", "P": "8-K"}
METRICS = list(METRIC_OF_PRIORITY.values())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(col: Column, mapping: dict, otherwise=None) -> Column:
    """CASE chain over a fixed dictionary."""
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(otherwise) if otherwise is not None else out


def trades(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cents = F.round(F.log(F.col("l_extendedprice") / F.col("l_quantity")) * 1000).cast("bigint")
    return li.select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), cents.alias("cents"),
        F.col("l_quantity").alias("qty"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 32768 + cents).alias("seq"))


def bars(spark, sf_dir) -> DataFrame:
    """Daily open/high/low/close/volume.  First and last trade come from a packed
    (sequence, price) long, so the aggregate stays a hash aggregate with partial combine."""
    px = F.col("cents") / 100.0
    return (trades(spark, sf_dir).groupBy("symbol", "date").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.round(F.max(px * (1 + F.col("d"))), 4).alias("high"),
        F.round(F.min(px * (1 - F.col("t"))), 4).alias("low"),
        F.sum("qty").alias("volume"))
        .select("symbol", "date", ((F.col("first_seq") % 32768) / 100.0).alias("open"), "high", "low",
                ((F.col("last_seq") % 32768) / 100.0).alias("close"), "volume"))


def facts(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    filed = F.to_date("o_orderdate")
    return o.select(
        F.col("o_custkey").alias("symbol"), lookup(F.substring("o_orderpriority", 1, 1), METRIC_OF_PRIORITY).alias("metric"),
        lookup(F.col("o_orderstatus"), FORM_OF_STATUS).alias("form"), F.col("o_orderkey").alias("accn"),
        filed.alias("filed"), F.date_sub(filed, (F.lit(20) + F.col("o_orderkey") % 90).cast("int")).alias("period_end"),
        F.col("o_totalprice").alias("value"))


def stretched_date(ts: Column) -> Column:
    """One day per twenty minutes since 2024-01-01, counted from 1995-01-01."""
    minutes = F.timestamp_diff("MINUTE", F.lit("2024-01-01").cast("timestamp_ntz"), ts)
    return F.date_add(F.lit("1995-01-01").cast("date"), F.floor(minutes / 20).cast("int"))


def news(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("article_id"), F.col("user_id").alias("symbol"), stretched_date(F.col("ts")).alias("date"),
        F.col("event_type").alias("topic"), ((F.col("value") - 50) / (F.col("value") + 50)).alias("score"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"))


def insider(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup", "error"))
    return e.select(
        F.col("event_id").alias("filing_id"), F.col("user_id").alias("symbol"), stretched_date(F.col("ts")).alias("date"),
        F.when(F.col("event_type") == "error", "sell").otherwise("buy").alias("side"),
        F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value")).cast("decimal(18,2)").alias("shares"))


def macro(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return (e.groupBy(F.col("event_type").alias("series_id"), stretched_date(F.col("ts")).alias("date"))
            .agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("value")))


def short_interest(spark, sf_dir) -> DataFrame:
    """Monthly settlement rows: returned quantity as shares short."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_suppkey").alias("symbol"), F.last_day("l_shipdate").alias("settlement_date"))
            .agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("shares_short"),
                 (F.sum("l_quantity") / F.count("*")).alias("avg_volume"))
            .withColumn("days_to_cover", F.col("shares_short") / F.col("avg_volume")))


def securities(spark, sf_dir) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
            .select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("company_name"), F.col("n_name").alias("country"),
                    F.col("r_name").alias("sector"), F.col("s_acctbal").alias("shares_out"),
                    F.when(F.col("s_nationkey") % 5 == 0, "OTC").otherwise("NYSE").alias("exchange")))


def holdings(spark, sf_dir) -> DataFrame:
    """Fund = supplier, ticker = part, snapshot = ship year; market value in exact cents."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_suppkey").alias("fund"), F.col("l_partkey").alias("ticker"), F.year("l_shipdate").alias("snapshot"))
            .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("market_value")))


def contracts(spark, sf_dir) -> DataFrame:
    """Option quotes, one per line item."""
    li = table(spark, sf_dir, "lineitem")
    px = F.log(F.col("l_extendedprice") / F.col("l_quantity")) * 10
    return li.select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("expiration"),
        F.date_sub(F.to_date("l_shipdate"), (F.lit(1) + F.col("l_linenumber") * 13 + F.col("l_partkey") % 60).cast("int")).alias("snapshot_date"),
        F.round(px / 5).cast("bigint").alias("strike5"), F.when(F.col("l_returnflag") == "R", "PUT").otherwise("CALL").alias("put_call"),
        F.col("l_quantity").alias("open_interest"), F.col("l_linenumber").cast("bigint").alias("volume"),
        (F.lit(0.1) + F.col("l_discount") * 3).alias("iv"), F.col("l_tax").alias("delta"), F.round(px, 2).alias("spot"),
        F.col("l_orderkey").alias("order_id"))


def positions(spark, sf_dir) -> DataFrame:
    return positions_of(table(spark, sf_dir, "events"))


def positions_of(events: DataFrame) -> DataFrame:
    """Vessel position reports; works on a batch or a streaming events table."""
    # fixed values: nav status dictionary
    status = {"click": "Under way", "view": "At anchor", "purchase": "Moored", "signup": "Aground", "error": "Undefined"}
    return events.select(
        "event_id", F.col("user_id").alias("mmsi"), "ts", (F.col("value") % 40 + 10).alias("lat"), (F.col("value") % 90 - 45).alias("lon"),
        (F.col("value") % 25).alias("speed"), F.get_json_object("props", "$.k").cast("int").alias("type_code"),
        lookup(F.col("event_type"), status).alias("nav_status"))
