"""Quantile weights, portfolio returns, costs and performance statistics.

Weights stay long (date, symbol): products are joins by key, sums are grouped with partial combine.
Daily series have one row per (strategy, day), so their windows are bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.features import SD_FLOOR, by_symbol
from tidemark.operators.relational import position_within

ANN = 252


def by_strategy(key: str = "strategy"):
    return W.partitionBy(key).orderBy("date")


def rebalance_dates(days: DataFrame, freq: str) -> DataFrame:
    return days.groupBy(F.date_trunc(freq, "date").alias("_p")).agg(F.max("date").alias("rebal")).select("rebal")


def _asof_days(days: DataFrame, marks: DataFrame, mark: str, strict: bool) -> DataFrame:
    """Each calendar day with the last mark at or before (strictly before) it; one row per day."""
    side = F.lit(2 if strict else 0)
    both = days.select("date", F.lit(None).cast("date").alias("_m"), F.lit(1).alias("_s")).unionByName(
        marks.select(F.col(mark).alias("date"), F.col(mark).alias("_m"), side.alias("_s")))
    # calendar-sized input: an unpartitioned window over days
    w = W.orderBy("date", "_s").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(mark, F.last("_m", ignorenulls=True).over(w)).where("_s = 1").select("date", mark)


def target_weights(scores: DataFrame, rebal: DataFrame, quantiles: int = 5, long_short: bool = True, score: str = "score") -> DataFrame:
    """(rebal, symbol, weight): top 1/q long, bottom 1/q short, by the last scored day at or before the
    rebalance; k = round-half-even(n / q), at least one; a side's weights sum to one."""
    scored = scores.where(F.col(score).isNotNull()).select("date", "symbol", score)
    at = _asof_days(rebal.select(F.col("rebal").alias("date")), scored.select(F.col("date").alias("scored")).distinct(), "scored", strict=False)
    cross = scored.withColumnRenamed("date", "scored").join(at.withColumnRenamed("date", "rebal").where("scored is not null"), "scored")
    pos = position_within(cross, ["rebal"], score, "symbol", "_pos", descending=True)
    k = F.greatest(F.lit(1), F.bround(F.col("_pos_of") / quantiles)).cast("int")
    w = F.when(F.col("_pos") <= k, 1.0 / k).otherwise(0.0)
    if long_short:
        w = w - F.when(F.col("_pos") > F.col("_pos_of") - k, 1.0 / k).otherwise(0.0)
    return pos.where("_pos_of >= 2").select("rebal", "symbol", w.alias("weight")).where("weight <> 0")


def clip_weights(targets: DataFrame, limit: float) -> DataFrame:
    return targets.withColumn("weight", F.greatest(F.lit(-abs(limit)), F.least(F.lit(abs(limit)), F.col("weight"))))


def holdings_by_day(days: DataFrame, targets: DataFrame) -> DataFrame:
    """(date, symbol, weight) held: the target of the last rebalance strictly before the day."""
    at = _asof_days(days, targets.select("rebal").distinct(), "rebal", strict=True).where("rebal is not null")
    return at.join(targets, "rebal").select("date", "symbol", "weight")


def portfolio_returns(days: DataFrame, held: DataFrame, returns: DataFrame) -> DataFrame:
    """Sum of weight x return per day; a missing return counts zero, a day without holdings is zero."""
    gross = held.join(returns, ["date", "symbol"]).groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"))
    return days.join(gross, "date", "left").select("date", F.coalesce("gross", F.lit(0.0)).alias("gross"))


def vol_scale(gross: DataFrame, target: float, n: int = 21, min_n: int = 5, cap: float = 2.0) -> DataFrame:
    """Scale of each day from the volatility known the day before."""
    d = gross.withColumn("_k", F.lit(1))
    w = W.partitionBy("_k").orderBy("date")
    t = w.rowsBetween(-(n - 1), 0)
    vol = F.when(F.count("gross").over(t) >= min_n, F.stddev_samp("gross").over(t)) * ANN ** 0.5
    d = d.withColumn("_vol", vol).withColumn("_v1", F.lag("_vol").over(w))
    scale = F.when(F.col("_v1") > SD_FLOOR, F.least(target / F.col("_v1"), F.lit(cap))).otherwise(1.0)
    return d.select("date", scale.alias("scale"))


def daily_turnover(days: DataFrame, held: DataFrame) -> DataFrame:
    """Sum of absolute weight changes against the day before, and short exposure, per day.  Yesterday's
    weights are shifted to the next calendar day and subtracted: a union and a sum, no window per symbol."""
    cal = days.withColumn("nxt", F.lead("date").over(W.orderBy("date")))  # one row per day
    prev = held.join(cal, "date").where("nxt is not null").select(F.col("nxt").alias("date"), "symbol", (-F.col("weight")).alias("weight"))
    change = held.unionByName(prev).groupBy("date", "symbol").agg(F.sum("weight").alias("d")).groupBy("date").agg(F.sum(F.abs("d")).alias("turnover"))
    short = held.groupBy("date").agg(F.sum(F.when(F.col("weight") < 0, -F.col("weight")).otherwise(0.0)).alias("short_exposure"))
    z = lambda c: F.coalesce(F.when(F.abs(c) > SD_FLOOR, F.col(c)), F.lit(0.0)).alias(c)
    return days.join(change, "date", "left").join(short, "date", "left").select("date", z("turnover"), z("short_exposure"))


def cost_of(turnover: Column, short: Column, commission_bps: float = 0.0, spread_bps: float = 0.0, borrow_bps: float = 0.0, sqrt_impact_bps: float = 0.0) -> Column:
    c = turnover * ((commission_bps + spread_bps / 2) / 1e4)
    if borrow_bps > 0:
        c = c + short * (borrow_bps / (1e4 * ANN))
    if sqrt_impact_bps > 0:
        c = c + F.sqrt(turnover) * (sqrt_impact_bps / 1e4)
    return c


def per_side_rate(commission_bps: float, spread_bps: float, flat_impact_bps: float = 0.0) -> float:
    return (commission_bps + spread_bps / 2 + flat_impact_bps) / 1e4


def equity_curve(series: DataFrame, ret: str = "ret", key: str = "strategy") -> DataFrame:
    w = by_strategy(key).rowsBetween(W.unboundedPreceding, 0)
    d = series.withColumn("equity", F.product(1 + F.col(ret)).over(w))
    return d.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def drawdown_stop(series: DataFrame, limit: float, ret: str = "ret", key: str = "strategy") -> DataFrame:
    """Zero every return after the first day whose drawdown passes the limit."""
    d = equity_curve(series, ret, key)
    first = F.min(F.when(F.col("drawdown") < -abs(limit), F.col("date"))).over(W.partitionBy(key))
    return d.withColumn("_stop", first).withColumn(ret, F.when(F.col("date") > F.col("_stop"), 0.0).otherwise(F.col(ret))).select(*series.columns)


def performance(series: DataFrame, key: str = "strategy", ret: str = "ret", ddof: int = 0) -> DataFrame:
    """Headline and tail statistics of every strategy in one shuffle."""
    x = F.col(ret)
    d = equity_curve(series.where(x.isNotNull()), ret, key)
    sd = F.stddev_pop(x) if ddof == 0 else F.stddev_samp(x)
    # the quantile comes from the same partition as the equity curve, so the tail mean needs no second pass
    d = d.withColumn("_q", F.expr(f"percentile({ret}, 0.05) over (partition by {key})"))
    a = d.groupBy(key).agg(F.count("*").alias("n_days"), F.max_by("equity", "date").alias("_eq"), F.avg(x).alias("_mean"), (sd * ANN ** 0.5).alias("_vol"),
                           F.min("drawdown").alias("_mdd"), F.avg((x > 0).cast("double")).alias("_hit"), F.sqrt(F.avg(F.when(x < 0, x * x))).alias("_down"),
                           F.sum(F.when(x > 0, x).otherwise(0.0)).alias("_gain"), F.sum(F.when(x < 0, -x).otherwise(0.0)).alias("_loss"),
                           F.max("_q").alias("_q05"), F.avg(F.when(x <= F.col("_q"), x)).alias("_tail"))
    cagr = F.when(F.col("_eq") > 0, F.pow("_eq", ANN / F.col("n_days")) - 1)
    pos = lambda c: F.when(F.col(c) > SD_FLOOR, F.col(c))
    enough = lambda n, c: F.when(F.col("n_days") >= n, c)
    out = {"total_return_pct": 100 * (F.col("_eq") - 1), "cagr_pct": 100 * cagr, "ann_vol_pct": 100 * F.col("_vol"), "sharpe": F.col("_mean") * ANN / pos("_vol"),
           "max_drawdown_pct": 100 * F.col("_mdd"), "hit_rate_pct": 100 * F.col("_hit"), "sortino": enough(5, F.col("_mean") * ANN / (pos("_down") * ANN ** 0.5)),
           "calmar": F.when(F.col("_mdd") < 0, cagr / -F.col("_mdd")), "omega": enough(5, F.col("_gain") / pos("_loss")), "var_95_pct": enough(10, -100 * F.col("_q05")),
           "cvar_95_pct": enough(10, -100 * F.col("_tail")), "gain_to_pain": enough(5, (F.col("_gain") - F.col("_loss")) / pos("_loss"))}
    return a.select(key, "n_days", *[e.alias(n) for n, e in out.items()])


def benchmark_stats(series: DataFrame, bench: DataFrame, key: str = "strategy", min_days: int = 30) -> DataFrame:
    """Alpha, beta, fit, tracking and capture against a benchmark (date, bench); all from one aggregate."""
    s, b = F.col("ret"), F.col("bench")
    j = series.join(bench, "date").where(s.isNotNull() & b.isNotNull())
    mean_if = lambda c, cond: F.avg(F.when(cond, c))
    a = j.groupBy(key).agg(F.count("*").alias("n_overlap"), F.covar_samp(s, b).alias("_c"), F.var_samp(b).alias("_v"), F.avg(s).alias("_ms"), F.avg(b).alias("_mb"), F.corr(s, b).alias("_r"),
                           F.stddev_samp(s - b).alias("_te"), F.avg(s - b).alias("_md"), mean_if(s, b > 0).alias("_us"), mean_if(b, b > 0).alias("_ub"), mean_if(s, b < 0).alias("_ds"), mean_if(b, b < 0).alias("_db"))
    ok = (F.col("n_overlap") >= min_days) & (F.col("_v") > SD_FLOOR ** 2)
    beta, g = F.col("_c") / F.col("_v"), lambda e: F.when(ok, e)
    te = F.col("_te") * ANN ** 0.5
    reason = F.when(F.col("n_overlap") < min_days, "too few overlapping days").when(~ok, "zero benchmark variance")
    return a.select(key, "n_overlap", g(beta).alias("beta"), g((F.col("_ms") - beta * F.col("_mb")) * ANN * 100).alias("alpha_ann_pct"), g(F.col("_r") * F.col("_r")).alias("r_squared"),
                    g(F.col("_r")).alias("correlation"), g(te * 100).alias("tracking_error_pct"), g(F.when(te > SD_FLOOR, F.col("_md") * ANN / te)).alias("information_ratio"),
                    g(100 * F.col("_us") / F.nullif(F.col("_ub"), F.lit(0.0))).alias("up_capture_pct"), g(100 * F.col("_ds") / F.nullif(F.col("_db"), F.lit(0.0))).alias("down_capture_pct"), reason.alias("bench_reason"))


def monthly_table(series: DataFrame, key: str = "strategy") -> DataFrame:
    """Compounded monthly returns, year x month, with the year to date (percent)."""
    m = series.where("ret is not null").groupBy(key, F.year("date").alias("obs_year"), F.month("date").alias("m")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    names = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    return m.groupBy(key, "obs_year").agg(*[F.max(F.when(F.col("m") == i + 1, F.col("ret") * 100)).alias(n) for i, n in enumerate(names)], ((F.product(1 + F.col("ret")) - 1) * 100).alias("ytd"))


def realised_returns(trades: DataFrame, start_equity: float, key: str = "strategy") -> DataFrame:
    """Daily returns from closed trades on a weekday calendar; a day without exits is zero."""
    by_day = trades.where("exit_date is not null and pnl is not null").groupBy(key, F.col("exit_date").alias("date")).agg(F.sum("pnl").alias("pnl"))
    span = by_day.groupBy(key).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    cal = span.select(key, F.explode(F.sequence("lo", "hi")).alias("date")).where(F.weekday("date") < 5)
    w = by_strategy(key)
    d = cal.join(by_day, [key, "date"], "left").withColumn("pnl", F.coalesce(F.col("pnl").cast("double"), F.lit(0.0)))
    d = d.withColumn("equity", start_equity + F.sum("pnl").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.withColumn("ret", F.col("equity") / F.coalesce(F.lag("equity").over(w), F.lit(start_equity)) - 1)


def factor_attribution(series: DataFrame, factors: DataFrame, names: list[str], key: str = "strategy", min_days: int = 30) -> DataFrame:
    """OLS of returns on factor returns.  Cross-products are summed on the executors (one row per
    strategy); only that small matrix goes to a grouped solve."""
    import numpy as np
    import pandas as pd
    terms = {"one": F.lit(1.0), **{n: F.col(n) for n in names}, "y": F.col("ret")}
    j = series.join(factors, "date").where(F.col("ret").isNotNull())
    for n in names:
        j = j.where(F.col(n).isNotNull())
    labels = list(terms)
    sums = j.groupBy(key).agg(*[F.sum(terms[a] * terms[b]).alias(f"{a}__{b}") for i, a in enumerate(labels) for b in labels[i:]])
    k = len(names) + 1

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in pdf.iterrows():
            get = lambda a, b: row.get(f"{a}__{b}", row.get(f"{b}__{a}"))
            xtx = np.array([[get(a, b) for b in labels[:k]] for a in labels[:k]], float)
            xty = np.array([get(a, "y") for a in labels[:k]], float)
            coef = np.linalg.pinv(xtx) @ xty
            n, sy, syy = row["one__one"], get("one", "y"), get("y", "y")
            tot, res = syy - sy * sy / n, syy - coef @ xty
            out.append([row[key], n, coef[0] * ANN * 100, 1 - res / tot if tot > 0 else 0.0, *coef[1:]])
        return pd.DataFrame(out, columns=[key, "n", "alpha_ann", "r_squared", *[f"beta_{n}" for n in names]])

    schema = f"{key} {dict(series.dtypes)[key]}, n double, alpha_ann double, r_squared double, " + ", ".join(f"beta_{n} double" for n in names)
    return sums.where(F.col("one__one") >= min_days).mapInPandas(lambda it: (solve(p) for p in it), schema)
