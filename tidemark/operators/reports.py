"""Aggregation reports: conditional aggregates in one pass, latest-per-key by max_by, top-k."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.exprs import clip, ratio, safe_div


def sign_label(x: Column, band: float = 0.0) -> Column:
    return F.when(x > band, "bullish").when(x < -band, "bearish").otherwise("neutral")


def failed_deliveries(df: DataFrame, n: int) -> DataFrame:
    agg = df.groupBy("symbol").agg(F.min("description").alias("description"), F.sum("shares_failed").alias("total_shares_failed"),
                                   F.round(F.avg("price"), 2).alias("avg_price"), F.count_distinct("settlement_date").alias("trading_days"),
                                   F.max("settlement_date").alias("latest_settlement"))
    return agg.orderBy(F.desc("total_shares_failed"), "symbol").limit(n)


def insider_sentiment(df: DataFrame) -> DataFrame:
    return (df.groupBy("symbol").agg(F.count_if(F.lower("side").rlike("buy|purchase")).alias("buy_txns"), F.count_if(F.lower("side").rlike("sell|sale")).alias("sell_txns"),
                                     F.sum("shares").cast("double").alias("net_shares"))
            .withColumn("sentiment", sign_label(F.col("net_shares"))))


def sentiment_summary(df: DataFrame, label: Column) -> DataFrame:
    d = df.withColumn("_l", label)
    return (d.groupBy("symbol").agg(F.count("*").alias("articles"), *[F.count_if(F.col("_l") == v).alias(v) for v in ("bullish", "neutral", "bearish")],
                                    F.round(F.avg("score"), 3).alias("avg_score")).withColumn("net_sentiment", sign_label(F.col("avg_score"), 0.1)))


def daily_signals(news: DataFrame, min_articles: int = 1, floor: float = 0.05) -> DataFrame:
    """Confidence-weighted mean score per (symbol, date)."""
    w = F.greatest(F.coalesce("confidence", F.lit(floor)), F.lit(floor))
    return (news.where("symbol is not null and date is not null and score is not null").groupBy("symbol", "date")
            .agg((F.sum(F.col("score") * w) / F.sum(w)).alias("sent_score"), F.count("*").alias("n_articles")).where(F.col("n_articles") >= min_articles))


def weighted_profile(df: DataFrame, group: str, weight: str, cols: list[str], date: str) -> DataFrame:
    """Weighted mean per column over its own non-NULL rows; plain mean of a date."""
    w = lambda c: F.when(F.col(c).isNotNull(), F.col(weight))
    return df.groupBy(group).agg(*[(F.sum(F.col(c) * F.col(weight)) / F.nullif(F.sum(w(c)), F.lit(0.0))).alias(f"weighted_{c}") for c in cols],
                                 F.date_from_unix_date(F.floor(F.avg(F.unix_date(date))).cast("int")).alias(f"avg_{date}"), F.count("*").alias("n_holdings"))


def put_call_ratio(df: DataFrame, by: list[str]) -> DataFrame:
    side = lambda t: F.sum(F.when(F.col("put_call") == t, F.col("volume")).otherwise(0))
    return (df.groupBy(*by).agg(side("CALL").alias("call_volume"), side("PUT").alias("put_volume"))
            .withColumn("put_call_ratio", F.round(safe_div("put_volume", "call_volume"), 3)))


def filing_sentiment(df: DataFrame, day: str, kind: str) -> DataFrame:
    kinds = ["buy", "sell", "exercise", "grant", "other"]
    agg = df.groupBy(day).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds], F.count("*").alias("n_filings"))
    return agg.withColumns({"buy_sell_ratio": (F.col("buy") + 1) / (F.col("sell") + 1),
                            "net_sentiment": (F.col("buy") - F.col("sell")) / F.greatest(F.col("n_filings"), F.lit(1))})


def series_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Series to columns (mean of duplicates) for a fixed list of series."""
    return df.where(F.col("series_id").isin(list(names))).groupBy("date").agg(
        *[F.avg(F.when(F.col("series_id") == s, F.col("value"))).alias(n) for s, n in names.items()])


def inversion(rates: DataFrame, short: str, long: str) -> DataFrame:
    spread = F.round(F.col(long) - F.col(short), 3)
    return rates.where(F.col(short).isNotNull() & F.col(long).isNotNull()).select("date", short, long, spread.alias("spread"), (spread < 0).alias("inverted"))


def last_non_null(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """Newest non-NULL value of each column on its own."""
    return df.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])


def squeeze_candidates(latest: DataFrame, min_short_pct: float, max_days: float) -> DataFrame:
    return latest.where((F.col("short_pct_float") >= min_short_pct) & (F.coalesce("days_to_cover", F.lit(999.0)) <= max_days))


def snapshot_change(df: DataFrame, key: str, snapshot: str, value: str, periods: int) -> DataFrame:
    """Newest against N snapshots before (or the oldest there is)."""
    # one row per (key, snapshot): the window partition is bounded by the number of snapshots
    w = W.partitionBy(key).orderBy(F.desc(snapshot))
    d = df.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count("*").over(W.partitionBy(key)))
    prior = F.col("_rn") == F.least(F.lit(periods + 1), F.col("_n"))
    out = d.where(F.col("_n") >= 2).groupBy(key).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(snapshot))).alias("latest_date"), F.max(F.when(prior, F.col(snapshot))).alias("prior_date"),
        F.max(F.when(F.col("_rn") == 1, F.col(value))).alias("latest"), F.max(F.when(prior, F.col(value))).alias("prior"))
    return out.where("latest is not null and prior is not null and prior <> 0").withColumns(
        {"change": F.col("latest") - F.col("prior"), "pct_change": F.round((F.col("latest") - F.col("prior")) / F.col("prior") * 100, 2)})


def yoy_growth(facts: DataFrame, metric: str, form: str) -> DataFrame:
    """Newest fiscal year against the one reported before it."""
    per_year = (facts.where((F.col("metric") == metric) & (F.col("form") == form)).groupBy("symbol", F.year("period_end").alias("fiscal_year"))
                .agg(F.max(F.struct("period_end", "accn", "value")).alias("r")))
    w = W.partitionBy("symbol").orderBy("fiscal_year")
    d = per_year.select("symbol", "fiscal_year", F.col("r.value").alias("value"), F.lag("r.value").over(w).alias("prior"),
                        F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("fiscal_year"))).alias("_rn"))
    return d.where("_rn = 1 and prior is not null").select("symbol", "fiscal_year", "value", "prior",
                                                           F.round((F.col("value") - F.col("prior")) / F.col("prior") * 100, 1).alias("yoy_pct"))


def top_by_metric(facts: DataFrame, metric: str, form: str, n: int, ascending: bool = False) -> DataFrame:
    latest = (facts.where((F.col("metric") == metric) & (F.col("form") == form)).groupBy("symbol")
              .agg(F.max(F.struct("period_end", "accn", "value")).alias("r")).select("symbol", "r.period_end", "r.value"))
    return latest.orderBy(F.asc("value") if ascending else F.desc("value"), "symbol").limit(n)


def top_per_group(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The n greatest rows of each group by a tuple of columns.

    A window would sort a hot group in one task.  Instead each group is salted by a hash of the row
    and cut to n per salt before the final n, which is exact because the n greatest rows of a group
    are among the n greatest of their salts."""
    salts = 64
    first = W.partitionBy(group, "_s").orderBy(*[F.desc(o) for o in order])
    final = W.partitionBy(group).orderBy(*[F.desc(o) for o in order])
    part = df.withColumn("_s", F.pmod(F.hash(*order), F.lit(salts))).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n)
    return part.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= n).drop("_r", "_s")


def period_return(bars: DataFrame, key: str = "symbol") -> DataFrame:
    d = bars.groupBy(key).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min_by("close", "date").alias("first_close"),
                              F.max_by("close", "date").alias("last_close"))
    return d.withColumn("total_return_pct", F.round((F.col("last_close") / F.col("first_close") - 1) * 100, 2))


def versus_benchmark(perf: DataFrame, benchmark) -> DataFrame:
    """Each row's return less that of one named row; the single value travels as a scalar subquery."""
    bench = perf.where(F.col("symbol") == benchmark).select("total_return_pct")
    return perf.where(F.col("symbol") != benchmark).withColumn("benchmark_pct", bench.scalar()).withColumn(
        "relative_return_pct", F.round(F.col("total_return_pct") - F.col("benchmark_pct"), 2))


def rotation(bars: DataFrame, n: int) -> DataFrame:
    """Mean log return of the last n bars per symbol and its rank."""
    w = W.partitionBy("symbol").orderBy("date")
    lr = bars.withColumn("lr", F.log(F.col("close") / F.lag("close").over(w)))
    rec = lr.withColumn("_rn", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))).where(F.col("_rn") <= n)
    agg = rec.groupBy("symbol").agg(F.round(F.avg("lr"), 6).alias("avg_log_return"), F.count("date").alias("trading_days"))
    return agg.withColumn("cumulative_return_pct", F.round(F.col("avg_log_return") * F.col("trading_days") * 100, 2))


def level_trend(df: DataFrame, key: str) -> DataFrame:
    """Newest level and its percent change against the value on or before 7 and 30 days earlier."""
    newest = df.groupBy(key).agg(F.max("date").alias("latest"))
    d = df.join(newest, key)
    at = lambda days: F.max_by("value", F.when(F.col("date") <= F.date_sub("latest", days), F.col("date")))
    out = d.groupBy(key).agg(F.max("latest").alias("date"), F.max_by("value", "date").alias("index_level"), at(7).alias("_w"), at(30).alias("_m"))
    chg = lambda c: F.round((F.col("index_level") / F.col(c) - 1) * 100, 2)
    return out.select(key, "date", "index_level", chg("_w").alias("wow_pct_change"), chg("_m").alias("mom_pct_change"))


def mention_counts(posts: DataFrame, list_col: str) -> DataFrame:
    """Explode a comma list and count per (date, topic, ticker)."""
    tickers = F.transform(F.split(F.col(list_col), ","), lambda t: F.trim(t))
    return (posts.where(F.col(list_col).isNotNull()).withColumn("ticker", F.explode(tickers)).where("ticker <> ''")
            .groupBy("date", "topic", "ticker").agg(F.count("*").alias("mention_count"), F.sum("post_score").alias("total_score")))


# fixed values: index codes in metadata priority
INDEX_CODES = ["SPX", "NDX", "RUT3000", "W5000", "RUT2000"]
INDEX_FLAGS = {"SPX": "is_sp500", "NDX": "is_nasdaq100", "RUT3000": "is_russell3000", "RUT2000": "is_russell2000", "W5000": "is_wilshire5000"}


def index_flags(members: DataFrame) -> DataFrame:
    """One row per ticker at the newest snapshot: membership flags, name from the best source."""
    newest = members.join(members.agg(F.max("snapshot_date").alias("snapshot_date")), "snapshot_date", "left_semi")
    of = lambda code, c: F.max(F.when(F.col("index_code") == code, F.col(c)))
    return newest.groupBy("ticker").agg(F.coalesce(*[of(c, "company_name") for c in INDEX_CODES]).alias("company_name"), of("SPX", "gics_sector").alias("gics_sector"),
                                        *[F.coalesce(F.bool_or(F.col("index_code") == c), F.lit(False)).alias(f) for c, f in INDEX_FLAGS.items()])


def overlap_matrix(members: DataFrame, codes: list[str]) -> DataFrame:
    """Tickers shared by each pair of indexes, from per-ticker flags: no pairs are emitted."""
    flags = members.groupBy("ticker").agg(*[F.coalesce(F.bool_or(F.col("index_code") == c), F.lit(False)).alias(c) for c in codes])
    pairs = list(combinations_with_replacement(codes, 2))
    agg = flags.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    long = agg.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "n")
    return long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "n")


def chain_metrics(c: DataFrame, key: list[str]) -> DataFrame:
    t = lambda side, x: F.when(F.col("put_call") == side, x)
    agg = c.groupBy(*key).agg(F.count("*").alias("contracts"), F.count_if(F.col("put_call") == "CALL").alias("calls"), F.count_if(F.col("put_call") == "PUT").alias("puts"),
                              F.sum("open_interest").alias("total_open_interest"), F.sum("volume").alias("total_volume"),
                              *[F.coalesce(F.sum(t(s, F.col(v))), F.lit(0)).alias(f"_{s}_{v}") for s in ("CALL", "PUT") for v in ("open_interest", "volume")],
                              F.round(F.avg(t("CALL", F.col("delta"))), 4).alias("avg_call_delta"))
    pc = lambda v: F.when(F.col(f"_CALL_{v}") > 0, F.round(F.col(f"_PUT_{v}") / F.col(f"_CALL_{v}"), 4)).otherwise(0.0)
    return agg.select(*key, "contracts", "calls", "puts", "total_open_interest", "total_volume", pc("open_interest").alias("put_call_ratio_oi"),
                      pc("volume").alias("put_call_ratio_vol"), "avg_call_delta")


def entity_master(facts: DataFrame) -> DataFrame:
    """One row per entity; the distinct lists hold configuration-sized sets (forms, metrics)."""
    lst = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return facts.groupBy("symbol").agg(lst("form").alias("forms"), F.count("*").alias("n_facts"), F.count_distinct("metric").alias("n_metrics"), lst("metric").alias("metrics"),
                                       F.min("filed").alias("first_filed"), F.max("filed").alias("last_filed"), F.max("period_end").alias("last_period_end"))


# fixed values: unit preference
UNIT_RANK = {"USD": 0, "USD/shares": 1, "shares": 2}


def wide_latest_filing(facts: DataFrame, metrics: list[str]) -> DataFrame:
    """(symbol, period) with the values of the newest filing only; one value per metric by unit
    preference.  Both steps are struct maxima in nested aggregates, not windows."""
    rank = F.coalesce(*[F.when(F.col("unit") == u, F.lit(n)) for u, n in UNIT_RANK.items()], F.lit(9))
    per = facts.groupBy("symbol", "period", "accn", "metric").agg(F.max("filed").alias("filed"), F.min(F.struct(rank.alias("r"), "unit", "value")).alias("v"))
    one = per.groupBy("symbol", "period", "accn").agg(F.max("filed").alias("filed"), *[F.max(F.when(F.col("metric") == m, F.col("v.value"))).alias(m) for m in metrics],
                                                      *[F.max(F.when(F.col("metric") == m, F.col("v.unit"))).alias(f"{m}_unit") for m in metrics])
    rest = [c for c in one.columns if c not in ("symbol", "period")]
    best = one.groupBy("symbol", "period").agg(F.max(F.struct("filed", "accn", *[c for c in rest if c not in ("filed", "accn")])).alias("b"))
    return best.select("symbol", "period", *[F.col(f"b.{c}").alias(c) for c in rest])


def zone_summary(p: DataFrame, by: list[str]) -> DataFrame:
    n = F.count("nav_status")
    return p.groupBy(*by).agg(F.count_distinct("mmsi").alias("vessel_count"), F.count("*").alias("position_reports"), F.round(F.avg("speed"), 2).alias("avg_speed"),
                              F.round(100 * F.count_if(F.col("nav_status").isin("At anchor", "Moored")) / n, 1).alias("pct_anchored"),
                              F.round(100 * F.count_if(F.col("nav_status") == "Under way") / n, 1).alias("pct_underway"))


def error_metrics(df: DataFrame, by: list[str], error: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(error)), 4).alias("mae"), F.round(F.avg(error), 4).alias("bias"))


# fixed values: dividend scoring bands, tried in order: (lower, lower closed, upper, upper closed, points)
INF = float("inf")
SCORE_BANDS = {
    "yield_risk": ("yield_ttm", [(12, False, INF, True, -10), (9, False, 12, True, -5)]),
    "growth": ("growth", [(10, True, INF, True, 20), (5, True, 10, False, 12), (2, True, 5, False, 6), (-INF, True, 0, False, -15)]),
    "payout": ("payout", [(0, False, 60, True, 15), (60, False, 80, True, 8), (100, False, INF, True, -10)]),
    "beta": ("beta", [(0, False, 0.7, True, 10), (-INF, True, 1.0, True, 5), (1.5, False, INF, True, -5)]),
    "roe": ("roe", [(15, True, INF, True, 8), (8, True, 15, False, 4)]),
    "margin": ("margin", [(20, True, INF, True, 5), (-INF, True, 0, False, -8)]),
    "dps": ("dps", [(-INF, True, 0, True, -20)]),
}
CATEGORY_POINTS = {"Dividend_Aristocrat": 8, "Covered_Call_ETF": 5, "Dividend_ETF": 5, "REIT": 3, "BDC": 2, "MLP": 2}
NO_PAYOUT_CHECK = ["Covered_Call_ETF", "Dividend_ETF"]


def dividend_score(df: DataFrame) -> DataFrame:
    """Score of each row.  Missing metrics count as 0 and a missing or zero beta as 1, so a missing dividend costs its
    points; payout_annual, where there is such a column, stands in for a missing or zero payout."""
    own = ["yield_ttm", "growth", "payout", "beta", "roe", "margin", "dps"]
    given, nonzero = df, lambda c: F.when(F.col(c) != 0, F.col(c))
    payout = F.coalesce(nonzero("payout"), F.col("payout_annual"), F.lit(0.0)) if "payout_annual" in df.columns else F.coalesce("payout", F.lit(0.0))
    filled = {c: F.coalesce(c, F.lit(0.0)) for c in own} | {"beta": F.coalesce(nonzero("beta"), F.lit(1.0)), "payout": payout}
    df = df.select(*(F.col(c).alias(f"_given_{c}") for c in given.columns), *(filled[c].alias(c) if c in filled else F.col(c) for c in given.columns))
    def band(metric, rules):
        x, out = F.col(metric), None
        for lo, lo_in, hi, hi_in, pts in rules:
            cond = F.lit(True)
            if lo != -INF:
                cond = cond & ((x >= lo) if lo_in else (x > lo))
            if hi != INF:
                cond = cond & ((x <= hi) if hi_in else (x < hi))
            out = F.when(cond, pts) if out is None else out.when(cond, pts)
        return out.otherwise(0)
    s = F.when(F.col("yield_ttm") >= 3, F.least(F.col("yield_ttm") * 3, F.lit(25.0))).otherwise(0.0)
    for name, (metric, rules) in SCORE_BANDS.items():
        part = band(metric, rules)
        s = s + (F.when(F.col("category").isin(NO_PAYOUT_CHECK), 0).otherwise(part) if name == "payout" else part)
    bonus = F.lit(0)
    for c, p in CATEGORY_POINTS.items():
        bonus = F.when(F.col("category") == c, p).otherwise(bonus)
    return df.select(*(F.col(f"_given_{c}").alias(c) for c in given.columns if c != "score"), F.round(s + bonus, 1).alias("score"))
