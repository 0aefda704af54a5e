"""Event studies, exit outcomes, entry/exit pairing and driver exposures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tidemark.operators.features import by_symbol, decluster
from tidemark.operators.relational import calendar_ranks, exact_quantile


# --- event paths -----------------------------------------------------------------------------

def _path(w, col: str, pre: int, post: int, lag: int) -> Column:
    """Closes at lag+pre .. lag+post bars from the current one, relative to the close before day 0."""
    at = lambda k: F.lag(col, -k).over(w) if k else F.col(col)
    base = at(lag - 1)
    return F.array(*[at(lag + k) / base - 1 for k in range(pre, post + 1)])


def event_paths(events: DataFrame, bars: DataFrame, pre: int, post: int, benchmark: DataFrame | None = None, entry_lag: int = 0) -> DataFrame:
    """Each event with day 0 (first bar on or after it, plus entry_lag bars) and its return path.

    The distinct (symbol, date) pairs of the events are numbered among the bars of their symbol in one shuffle of thin rows. The
    closes of a symbol (one a calendar day) become an array there, of which each pair takes its slice: paths are made for the
    pairs, not for every bar, and no event x bar pairs are.  ``benchmark`` is (date, bench), one row per day; its own path from
    day 0 is subtracted.  Events without a whole window, or too far from day 0, are dropped."""
    day = F.col("date")
    points = events.select("symbol", "date").where("symbol IS NOT NULL AND date IS NOT NULL").distinct()
    thin = bars.where("symbol IS NOT NULL").select("symbol", day.alias("_t"), F.struct(day.alias("day"), "close").alias("_bar"))
    rows = thin.unionByName(points.select("symbol", day.alias("_t")), allowMissingColumns=True)
    is_bar = F.col("_bar").isNotNull()
    before = W.partitionBy("symbol").orderBy("_t", is_bar).rowsBetween(W.unboundedPreceding, 0)  # a bar of the same day comes after the pair
    rows = rows.withColumn("_at", F.count_if(is_bar).over(before).cast("int"))
    own = rows.groupBy("symbol").agg(F.sort_array(F.collect_list("_bar")).alias("_bars"), F.collect_list(F.when(~is_bar, F.struct(F.col("_t").alias("_event"), "_at"))).alias("_points"))
    n = F.size("_bars")

    def cut(p: Column) -> Column:
        """Day 0, base and closes of a pair; slices are taken before pairs become rows, which then do not carry the symbol's bars."""
        first, base = p["_at"] + (entry_lag + pre), p["_at"] + (entry_lag - 1)
        whole = (F.least(first, base) >= 0) & (F.greatest(first + (post - pre), base) < n)
        found = F.struct(p["_event"].alias("_event"), F.get("_bars", p["_at"] + entry_lag)["day"].alias("day0"), F.get("_bars", base)["close"].alias("_base"), F.slice("_bars", first + 1, F.lit(post - pre + 1))["close"].alias("_c"))
        return F.when(whole, found)

    hit = own.where(F.size("_points") > 0).select("symbol", F.inline(F.array_compact(F.transform("_points", cut))))
    hit = hit.where(F.datediff("day0", "_event") <= 10 + 5 * entry_lag).where(F.col("_base").isNotNull() & ~F.exists("_c", lambda x: x.isNull()))
    hit = hit.select(F.col("symbol").alias("_symbol"), "_event", "day0", F.transform("_c", lambda x: x / F.col("_base") - 1).alias("path"))
    hit = events.join(hit, (events["symbol"] == hit["_symbol"]) & (events["date"] == hit["_event"])).drop("_symbol", "_event")
    if benchmark is not None:
        full = lambda p: F.when(~F.exists(p, lambda x: x.isNull()), p)
        days = benchmark.withColumn("_k", F.lit(0))
        bw = W.partitionBy("_k").orderBy("date")  # one row per day
        days = days.select(F.col("date").alias("day0"), full(_path(bw, "bench", pre, post, 0)).alias("bpath"))
        hit = hit.join(days, "day0").where("bpath is not null").withColumn("path", F.zip_with("path", "bpath", lambda x, y: x - y)).drop("bpath")
    return hit


def car_rows(paths: DataFrame, pre: int, keep: list[str]) -> DataFrame:
    return paths.select(*keep, F.posexplode("path").alias("_p", "car")).withColumn("rel", F.col("_p") + pre).drop("_p")


def baseline(bars: DataFrame, horizons: list[int]) -> DataFrame:
    """Mean compounded return over h days of the equal-weight market."""
    ret = bars.withColumn("r", F.col("close") / F.lag("close").over(by_symbol()) - 1)
    day = ret.groupBy("date").agg(F.avg("r").alias("r")).where("r is not null").withColumn("_k", F.lit(0))
    w = W.partitionBy("_k").orderBy("date")
    cols = []
    for h in horizons:
        f = w.rowsBetween(-(h - 1), 0)
        day = day.withColumn(f"_c{h}", F.when(F.count("r").over(f) >= h, F.product(1 + F.col("r")).over(f)))
        cols.append(F.struct(F.lit(h).alias("rel"), (F.avg(f"_c{h}") - 1).alias("baseline")))
    return day.agg(F.array(*cols).alias("a")).select(F.inline("a"))


def _with_median(agg: DataFrame, df: DataFrame, keys: list[str], value: str) -> DataFrame:
    med = exact_quantile(df, keys, value, 0.5, "_md")
    return agg.join(med, keys) if keys else agg.withColumn("_md", med.scalar())


def horizon_table(car: DataFrame, keys: list[str] = (), min_n: int = 1) -> DataFrame:
    """n, mean, median, hit rate and t per horizon (and label)."""
    c, keys = F.col("car"), [*keys, "rel"]
    agg = car.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(c).alias("_m"), F.avg((c > 0).cast("double")).alias("_h"), F.stddev_samp(c).alias("_s")).where(F.col("n") >= min_n)
    return _with_median(agg, car, keys, "car").select(*keys, "n", (100 * F.col("_m")).alias("mean_pct"), (100 * F.col("_md")).alias("median_pct"), (100 * F.col("_h")).alias("hit_rate_pct"),
                                                      F.when(F.col("_s") > 0, F.col("_m") / (F.col("_s") / F.sqrt("n"))).alias("t_stat"))


def date_level(car: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One mean per event date first, then t across dates: same-day events are not independent."""
    per = car.groupBy(*keys, "rel", "date").agg(F.avg("car").alias("m"))
    agg = per.groupBy(*keys, "rel").agg(F.count("*").alias("n_dates"), F.avg("m").alias("_m"), F.stddev_samp("m").alias("_s"))
    return agg.select(*keys, "rel", "n_dates", (100 * F.col("_m")).alias("mean_pct"), F.when(F.col("_s") > 0, F.col("_m") / (F.col("_s") / F.sqrt("n_dates"))).alias("t_stat"))


def exit_outcomes(paths: DataFrame, holding: int, stop_pct: float | None, target_pct: float | None, side: int = 1, round_trip_cost: float = 0.0) -> DataFrame:
    """First close in the holding window that meets the stop or the target, else the last day.  Works on
    the path array of each row; path[k] is the return k bars after entry."""
    first = None
    r = lambda x: x * side
    never = F.lit(holding + 1)
    def when(cond):
        hits = F.filter(F.sequence(F.lit(1), F.lit(holding)), lambda k: cond(r(F.get(F.col("path"), k))))
        return F.coalesce(F.get(hits, F.lit(0)), never)
    stop = when(lambda x: x <= -abs(stop_pct) / 100) if stop_pct is not None else never
    target = when(lambda x: x >= abs(target_pct) / 100) if target_pct is not None else never
    d = paths.withColumns({"_s": stop, "_t": target})
    first = F.least("_s", "_t", F.lit(holding))
    reason = F.when(F.least("_s", "_t") > holding, "time").when(F.col("_s") <= F.col("_t"), "stop").otherwise("target")
    d = d.withColumns({"exit_rel": first, "exit_reason": reason})
    return d.withColumn("ret", r(F.get(F.col("path"), F.col("exit_rel"))) - round_trip_cost).drop("_s", "_t")


def outcome_summary(out: DataFrame, keys: list[str] = ()) -> DataFrame:
    x, keys = F.col("ret"), list(keys)
    a = (out.groupBy(*keys) if keys else out.groupBy()).agg(
        F.count("*").alias("n_trades"), F.avg((x > 0).cast("double")).alias("_w"), F.avg(x).alias("_m"), F.max(x).alias("_mx"), F.min(x).alias("_mn"),
        F.sum(F.when(x > 0, x).otherwise(0.0)).alias("_g"), F.sum(F.when(x <= 0, -x).otherwise(0.0)).alias("_l"), F.count_if(F.col("exit_reason") == "stop").alias("stops_hit"), F.count_if(F.col("exit_reason") == "target").alias("targets_hit"))
    p = lambda c: 100 * F.col(c)
    return _with_median(a, out, keys, "ret").select(*keys, "n_trades", p("_w").alias("win_rate_pct"), p("_m").alias("avg_return_pct"), p("_md").alias("median_return_pct"), p("_mx").alias("best_pct"), p("_mn").alias("worst_pct"),
                    F.when(F.col("_l") > 0, F.col("_g") / F.col("_l")).alias("profit_factor"), "stops_hit", "targets_hit")


# fixed values: trailing windows of the signal monitor, in days
MONITOR_WINDOWS = {"full": None, "3y": 1095, "1y": 365, "180d": 180}


def signal_health(out: DataFrame, as_of: str, drop_pts: float = 10, pf_floor: float = 1.0, min_trades: int = 10, car: str | None = None, side: int = 1) -> DataFrame:
    """Outcome metrics per trailing window and whether the last year fell behind the whole history.

    ``car`` names a column with each event's abnormal return at a longer horizon, of the same path: its mean in percent and
    its t, signed by the side, come as car_mean_pct and car_tstat of the same windows."""
    wins = F.array_compact(F.array(*[F.when(F.lit(True) if n is None else F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), n), name) for name, n in MONITOR_WINDOWS.items()]))
    seen = out.withColumn("window", F.explode(wins))
    m = outcome_summary(seen, ["signal", "window"])
    if car is not None:
        x, sd = side * F.col(car), F.stddev_samp(F.col(car))
        m = m.join(seen.groupBy("signal", "window").agg((100 * F.avg(x)).alias("car_mean_pct"), F.when(sd > 0, F.avg(x) / (sd / F.sqrt(F.count(F.col(car))))).alias("car_tstat")), ["signal", "window"])
    pick = lambda w, c: F.max(F.when(F.col("window") == w, F.col(c)))
    flag = m.groupBy("signal").agg(pick("1y", "n_trades").alias("_n"), (pick("full", "win_rate_pct") - pick("1y", "win_rate_pct")).alias("_d"), pick("1y", "profit_factor").alias("_pf"))
    flag = flag.select("signal", F.coalesce((F.col("_n") >= min_trades) & ((F.col("_d") > drop_pts) | (F.col("_pf") < pf_floor)), F.lit(False)).alias("degraded"))
    return m.join(flag, "signal")


def evaluate_events(events: DataFrame, bars: DataFrame, benchmark: DataFrame | None = None, post: int = 21, horizons: list[int] = (1, 5, 10, 21), min_events: int = 5, lag_days: int = 0, min_gap_days: int = 0) -> DataFrame:
    """Event-set battery as long rows (evaluation, horizon, statistic, value, n): per label and horizon the mean, median, hit
    rate and t of abnormal returns entered on the bar after the event.

    Dates move by ``lag_days`` to when the event was known; with ``min_gap_days`` events of one label and symbol are
    de-clustered first.  A label of fewer than ``min_events`` events, or without a whole path, gives one row
    "skipped" whose n is its number of events.  Rows with a null part of the key take no part; repeated events count once."""
    known = events.where("symbol IS NOT NULL AND date IS NOT NULL AND label IS NOT NULL").select("symbol", F.date_add("date", lag_days).alias("date"), "label").distinct()
    if min_gap_days:
        who = known.withColumn("_who", F.to_json(F.struct("label", "symbol")))
        known = who.join(decluster(who, min_gap_days, "_who"), ["_who", "date"], "left_semi").drop("_who")
    sizes = known.groupBy("label").agg(F.count("*").alias("_events"))
    enough = known.join(sizes.where(F.col("_events") >= min_events).select("label"), "label", "left_semi")
    car = car_rows(event_paths(enough, bars, 0, post, benchmark, entry_lag=1), 0, ["label", "symbol", "date"])
    table = horizon_table(car.where(F.col("rel").isin(list(horizons))), ["label"])
    cols = ["mean_pct", "median_pct", "hit_rate_pct", "t_stat"]
    name = F.concat(F.lit("events:"), F.col("label")).alias("evaluation")
    rows = table.unpivot(["label", "rel", "n"], cols, "statistic", "value").select(name, F.col("rel").alias("horizon"), "statistic", "value", "n")
    skipped = sizes.join(table.select("label").distinct(), "label", "left_anti")
    return rows.unionByName(skipped.select(name, F.lit(None).cast("int").alias("horizon"), F.lit("skipped").alias("statistic"), F.lit(None).cast("double").alias("value"), F.col("_events").alias("n")))


# --- entry / exit pairing --------------------------------------------------------------------

TRADE_SCHEMA = "key string, side string, entry_date date, entry_price double, exit_date date, exit_price double, days_held int, pnl_pct double, exit_reason string"


def pair_trades(flags: DataFrame, key: str = "key", cost_rate: float = 0.0) -> DataFrame:
    """Ordered matching of entry and exit flags into closed positions: one open position per key, orders
    execute on the next bar, an unclosed position blocks later entries.

    Columns: key, date, close, entry, exit (and short_entry, short_exit).  Each position depends on the one
    before, so a key is one group: at most one row per calendar day.  Keys (and replicates) run in parallel."""
    short = "short_entry" in flags.columns
    cols = [F.col(key).cast("string").alias("key"), "date", "close", "entry", "exit"] + (["short_entry", "short_exit"] if short else [])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        px, n, day = pdf["close"].to_numpy(float), len(pdf), pdf["date"].to_numpy()
        sides = [("long", 1.0, pdf["entry"].to_numpy(bool), pdf["exit"].to_numpy(bool))]
        if short:
            sides.append(("short", -1.0, pdf["short_entry"].to_numpy(bool), pdf["short_exit"].to_numpy(bool)))
        # next exit flag at or after each bar, found once per side from the back
        nxt = {s: np.minimum.accumulate(np.where(x, np.arange(n), n)[::-1])[::-1] for s, _, _, x in sides}
        orders = sorted((i, s, sg) for s, sg, e, _ in sides for i in np.flatnonzero(e))
        good, rows, free = np.isfinite(px) & (px > 0), [], 0
        for i, side, sg in orders:
            a = i + 1
            if i < free or a >= n or not good[a]:
                continue
            stop_at = nxt[side][a + 1] if a + 1 < n else n
            z = stop_at + 1
            if z >= n:
                free = n
                continue
            free = z + 1
            if not good[z]:
                continue
            pct = sg * (px[z] / px[a] - 1.0) - cost_rate
            rows.append((pdf["key"].iloc[0], side, day[a], px[a], day[z], px[z], int(z - a), 100 * pct, "rule"))
        return pd.DataFrame(rows, columns=["key", "side", "entry_date", "entry_price", "exit_date", "exit_price", "days_held", "pnl_pct", "exit_reason"])

    return flags.select(*cols).groupBy("key").applyInPandas(run, TRADE_SCHEMA)


def trade_summary(trades: DataFrame, keys: list[str] = ()) -> DataFrame:
    x = F.col("pnl_pct")
    return (trades.groupBy(*keys) if keys else trades.groupBy()).agg(
        F.count("*").alias("n_trades"), F.count_if(F.col("side") == "long").alias("n_long"), F.count_if(F.col("side") == "short").alias("n_short"), F.sum(x).alias("total_pnl_pct"),
        (100 * F.avg((x > 0).cast("double"))).alias("win_rate_pct"), F.avg(x).alias("avg_pnl_pct"), F.expr("percentile(days_held, 0.5)").alias("median_days_held"), F.count_distinct("key").alias("n_keys"))


# --- exposures -------------------------------------------------------------------------------

def driver_returns(levels: DataFrame, key: str = "driver") -> DataFrame:
    """Returns of positive levels per driver; a non-positive level gives no return on either side."""
    v = F.when(F.col("value") > 0, F.col("value"))
    w = W.partitionBy(key).orderBy("date")
    d = levels.withColumn("_v", v)
    return d.select(key, "date", (F.col("_v") / F.lag("_v").over(w) - 1).alias("x"))


def _moments(y, x, m) -> dict[str, Column]:
    one = F.lit(1.0)
    ok = y.isNotNull() & x.isNotNull() & m.isNotNull()
    z = {"n": one, "y": y, "x": x, "m": m, "yy": y * y, "xx": x * x, "mm": m * m, "xy": x * y, "my": m * y, "xm": x * m}
    return {k: F.when(ok, e) for k, e in z.items()}


def ols_columns(min_obs: int, p: str = "") -> dict[str, Column]:
    """One- and two-regressor OLS from sums held in columns n, y, x, m, yy, xx, mm, xy, my, xm."""
    c = lambda k: F.col(p + k)
    n = c("n")
    cov = lambda ab, a, b: c(ab) - c(a) * c(b) / n
    sxx, smm, syy, sxy, smy, sxm = cov("xx", "x", "x"), cov("mm", "m", "m"), cov("yy", "y", "y"), cov("xy", "x", "y"), cov("my", "m", "y"), cov("xm", "x", "m")
    ok = (n >= min_obs) & (sxx > 1e-18)
    det = sxx * smm - sxm * sxm
    beta = sxy / F.nullif(sxx, F.lit(0.0))
    rss1 = syy - beta * sxy
    t1 = beta / F.sqrt(F.greatest(rss1 / (n - 2), F.lit(1e-300)) / sxx)
    b2x, b2m = (sxy * smm - smy * sxm) / F.nullif(det, F.lit(0.0)), (smy * sxx - sxy * sxm) / F.nullif(det, F.lit(0.0))
    rss2 = syy - b2x * sxy - b2m * smy
    t2 = b2x / F.sqrt(F.greatest(rss2 / (n - 3), F.lit(1e-300)) * smm / det)
    two = ok & (det > 1e-24)
    return {"n_obs": n.cast("bigint"), "beta": F.when(ok, beta), "t_stat": F.when(ok, t1), "r2": F.when(ok & (syy > 0), 1 - rss1 / syy), "beta_ex_mkt": F.when(two, b2x), "t_ex_mkt": F.when(two, t2)}


def exposure_map(stock: DataFrame, drivers: DataFrame, market: DataFrame, min_obs: int = 120) -> DataFrame:
    """Every (symbol, driver): Spearman, univariate and market-controlled OLS.  One equi join by date, one
    grouped sum; stock (symbol, date, y), drivers (driver, date, x), market (date, m)."""
    j = stock.join(market, "date").join(drivers, "date").where("y is not null and x is not null and m is not null")
    sums = j.groupBy("symbol", "driver").agg(*[F.sum(e).alias(k) for k, e in _moments(F.col("y"), F.col("x"), F.col("m")).items()])
    fit = sums.withColumns(ols_columns(min_obs)).where("beta is not null").select("symbol", "driver", "n_obs", "beta", "t_stat", "r2", "beta_ex_mkt", "t_ex_mkt")
    ranked = calendar_ranks(j.select("symbol", "driver", "y", "x"), ["symbol", "driver"], {"y": "_ry", "x": "_rx"})
    corr = ranked.groupBy("symbol", "driver").agg(F.corr("_ry", "_rx").alias("spearman"))
    return fit.join(corr, ["symbol", "driver"])


def trailing_exposure(stock: DataFrame, driver: DataFrame, market: DataFrame, event_dates: DataFrame, years: int = 3, min_obs: int = 120, min_t: float = 3.0) -> DataFrame:
    """Market-controlled exposure of each symbol as of each event date, from the trailing years only.

    The OLS sums are additive: each symbol keeps running sums by day, and a window's sums are those at its end less
    those at its start.  Both ends are as-of look-ups from the day rows' side: a row holds until the symbol's next row, so it
    names the event days that fall into that span.  A symbol without a return in an event's window never meets the event.
    Event days (at most one a calendar day) come to the driver, as two short arrays."""
    span = 365 * years
    events = [r[0] for r in event_dates.where("date IS NOT NULL").select(F.unix_date("date")).distinct().orderBy(1).collect()]
    keys = list(_moments(F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    if not events:
        events = [0]
        stock = stock.limit(0)
    low, high = events[0], events[-1]
    before, at = [], 0  # number of events before each day from the first to one past the last
    for day in range(low, high + 2):
        while at < len(events) and events[at] < day:
            at += 1
        before.append(at)
    table, days = (F.array(*[F.lit(x) for x in v]) for v in (before, events))
    count = lambda d: F.element_at(table, F.least(F.greatest(d, F.lit(low)), F.lit(high + 1)) - (low - 1))
    j = stock.join(market, "date").join(driver, "date").where("y IS NOT NULL AND x IS NOT NULL AND m IS NOT NULL")
    w = W.partitionBy("symbol").orderBy("_day")
    run = j.select("symbol", F.unix_date("date").alias("_day"), *[e.alias(f"s_{k}") for k, e in _moments(F.col("y"), F.col("x"), F.col("m")).items()]).groupBy("symbol", "_day").agg(*[F.sum(f"s_{k}").alias(f"s_{k}") for k in keys])
    run = run.select("symbol", "_day", F.lead("_day").over(w).alias("_next"), *[F.sum(f"s_{k}").over(w).alias(k) for k in keys])

    def seen(lo: Column, hi: Column, sign: int) -> DataFrame:
        """A row for each event day in [lo, hi), with the running sums so far."""
        found = run.withColumns({"_lo": count(lo), "_hi": count(hi)}).where("_hi > _lo")
        return found.select("symbol", F.explode(F.slice(days, F.col("_lo") + 1, F.col("_hi") - F.col("_lo"))).alias("_event"), *[(sign * F.col(k)).alias(k) for k in keys])
    ends = seen(F.col("_day"), F.least(F.coalesce("_next", F.lit(high + 1)), F.col("_day") + span), 1)
    starts = seen(F.greatest(F.col("_day") + span, F.col("_next")), F.col("_next") + span, -1)  # a later row is in the window, or the event has none
    sums = ends.unionByName(starts).groupBy("symbol", "_event").agg(*[F.sum(k).alias(k) for k in keys]).withColumns(ols_columns(min_obs))
    return sums.where(F.abs("t_ex_mkt") > min_t).select(F.date_from_unix_date("_event").alias("date"), "symbol", F.when(F.col("beta_ex_mkt") > 0, 1).otherwise(-1).alias("sign"), "beta_ex_mkt", "t_ex_mkt", "n_obs")


def shock_factor(moves: DataFrame, pct: float, reach: int = 3) -> DataFrame:
    """Sparse daily factor: the driver's move on the bars 1..reach after a shock, the latest shock winning."""
    w = W.partitionBy("driver").orderBy("date")
    shock = F.when(F.abs("move") >= abs(pct), F.col("move"))
    d = moves.withColumn("_s", shock)
    return d.withColumn("factor", F.coalesce(F.last("_s", ignorenulls=True).over(w.rowsBetween(-reach, -1)), F.lit(0.0))).drop("_s")


def sign_stability(grid: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of parameter cells whose effect has the majority sign."""
    p = F.avg((F.col(value) > 0).cast("double"))
    return grid.groupBy(*keys).agg(F.count("*").alias("cells"), F.greatest(p, 1 - p).alias("stability"), F.avg(value).alias("mean_effect"))
