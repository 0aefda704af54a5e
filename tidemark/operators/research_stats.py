"""Signal statistics: rank IC, spreads, folds, regimes, resampling nulls and multiple testing.

Horizons, regimes, folds and replicates are group keys, so a whole battery is a few jobs.  Random
draws come from md5 of (seed, replicate, position): a rerun, another partitioning or a lost executor
gives the same numbers.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.distributions import normal_probability, normal_quantile
from tidemark.operators.relational import average_rank, average_ranks, calendar_ranks, position_within, value_bucket
from tidemark.sources.workspace import materialise


def draw(parts: list, modulus: Column | int) -> Column:
    """Uniform integer in [0, modulus) from md5 of the joined parts."""
    h = F.md5(F.concat_ws("-", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint") % modulus


def spearman(df: DataFrame, group: list[str], x: str, y: str, min_n: int, calendar_bound: bool = False) -> DataFrame:
    """Rank correlation per group: average ranks, then a mergeable correlation aggregate.  Say
    ``calendar_bound`` for groups of at most one row per day (a symbol at one horizon).  Equal ranks have no correlation:
    no error."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = (calendar_ranks if calendar_bound else average_ranks)(d, group, {x: "_rx", y: "_ry"})
    agg = (d.groupBy(*group) if group else d.groupBy()).agg(F.count("*").alias("n"), F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"),
                                                               (F.covar_pop("_rx", "_ry") / F.nullif(F.stddev_pop("_rx") * F.stddev_pop("_ry"), F.lit(0.0))).alias("_c"))
    ok = (F.col("n") >= min_n) & (F.col("_x0") < F.col("_x1")) & (F.col("_y0") < F.col("_y1"))
    reason = F.when(F.col("n") < min_n, "too few pairs").when(~ok, "no variance")
    return agg.select(*group, "n", F.when(ok, F.col("_c")).alias("ic"), reason.alias("reason"))


def daily_ic(panel: DataFrame, value: str, fwd: str, keys: list[str] = (), min_names: int = 5, min_days: int = 5) -> DataFrame:
    """Cross-sectional rank IC per day, summarised per key."""
    keys = list(keys)
    ics = spearman(panel, [*keys, "date"], value, fwd, min_names).where("ic is not null")
    return ic_summary(ics, keys, min_days)


def daily_ic_on(panel: DataFrame, value: str, fwd: str, days: DataFrame, keys: list[str], min_names: int = 5, min_days: int = 5) -> DataFrame:
    """``daily_ic`` per key of ``days`` (date, keys), where a day may have several keys: a day's rank IC is worked out once, and
    the days meet their keys, not the rows."""
    ics = spearman(panel, ["date"], value, fwd, min_names).where("ic is not null")
    return ic_summary(ics.join(days, "date"), keys, min_days)


def ic_summary(ics: DataFrame, keys: list[str], min_days: int = 5) -> DataFrame:
    agg = (ics.groupBy(*keys) if keys else ics.groupBy()).agg(F.count("*").alias("ic_days"), F.avg("ic").alias("_m"), F.stddev_samp("ic").alias("_s"), F.avg((F.col("ic") > 1e-12).cast("double")).alias("_p"))
    ok = lambda e: F.when(F.col("ic_days") >= min_days, e)
    se = F.col("_s") / F.sqrt("ic_days")
    return agg.select(*keys, "ic_days", ok(F.col("_m")).alias("mean_daily_ic"), ok(F.when(F.col("_s") > 0, se)).alias("ic_se"), ok(F.when(F.col("_s") > 0, F.col("_m") / se)).alias("ic_t_stat"),
                      ok(100 * F.col("_p")).alias("ic_pct_positive"), F.when(F.col("ic_days") < min_days, "too few days").when(F.col("_s") == 0, "no variance across days").alias("daily_reason"))


def bucketed(panel: DataFrame, value: str, fwd: str, keys: list[str] = (), q: float = 0.2) -> DataFrame:
    """Rows of the top and bottom q of each day (at least one each, half-even size)."""
    keys = list(keys)
    d = panel.where(F.col(value).isNotNull() & F.col(fwd).isNotNull())
    spread = d.groupBy(*keys, "date").agg(F.min(value).alias("_a"), F.max(value).alias("_b")).where("_a < _b").select(*keys, "date")
    pos = position_within(d, [*keys, "date"], value, "symbol", "_p")
    k = F.greatest(F.lit(1), F.bround(F.col("_p_of") * q)).cast("bigint")
    cut = pos.withColumns({"top": F.col("_p") > F.col("_p_of") - k, "bottom": F.col("_p") <= k}).drop("_p", "_p_of").where("top or bottom")
    return cut.join(spread, [*keys, "date"], "left_semi")


def welch(mt, vt, nt, mb, vb, nb) -> tuple[Column, Column]:
    """t and degrees of freedom of the unequal-variance test."""
    a, b = vt / nt, vb / nb
    t = (mt - mb) / F.sqrt(F.when(a + b > 0, a + b))
    return t, (a + b) * (a + b) / (a * a / (nt - 1) + b * b / (nb - 1))


def quantile_spread(panel: DataFrame, value: str, fwd: str, keys: list[str] = (), q: float = 0.2, min_side: int = 6) -> DataFrame:
    keys, b = list(keys), bucketed(panel, value, fwd, keys, q)
    side = lambda s: F.when(F.col(s), F.col(fwd))
    agg = (b.groupBy(*keys) if keys else b.groupBy()).agg(*[f(side(s)).alias(f"_{p}{s[0]}") for s in ("top", "bottom") for p, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    ok = (F.col("_nt") > min_side) & (F.col("_nb") > min_side)
    t, df = welch(F.col("_mt"), F.col("_vt"), F.col("_nt"), F.col("_mb"), F.col("_vb"), F.col("_nb"))
    g = lambda e: F.when(ok, e)
    return agg.select(*keys, F.col("_nt").alias("top_n"), F.col("_nb").alias("bottom_n"), g(100 * F.col("_mt")).alias("top_mean_pct"), g(100 * F.col("_mb")).alias("bottom_mean_pct"),
                      g(100 * (F.col("_mt") - F.col("_mb"))).alias("spread_pct"), g(t).alias("spread_t"), g(df).alias("spread_df"), F.when(~ok, "bucket too small").alias("spread_reason"))


def to_horizons(panel: DataFrame, ids: list[str], horizons: list[int]) -> DataFrame:
    """fwd_1d, fwd_5d ... columns to (horizon, fwd) rows, so the horizon is a group key."""
    cells = F.array(*[F.struct(F.col(f"fwd_{h}d").alias("fwd"), F.lit(h).alias("horizon")) for h in horizons])
    return panel.select(*ids, F.explode(cells).alias("_h")).select(*ids, "_h.*")


def indexed_days(df: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """0-based position of each row of a daily table (one row per key and day)."""
    return df.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(date)) - 1).withColumn("_n", F.count("*").over(W.partitionBy(*keys)))


def bootstrap_spread(panel: DataFrame, value: str, fwd: str, n_boot: int = 200, seed: int = 0, q: float = 0.2, min_days: int = 20) -> DataFrame:
    """Resample whole days: draws are generated per replicate and joined to the per-day means."""
    b = bucketed(panel, value, fwd, [], q)
    days = b.groupBy("date").agg(F.avg(F.when(F.col("top"), F.col(fwd))).alias("t"), F.avg(F.when(F.col("bottom"), F.col(fwd))).alias("b")).withColumn("_k", F.lit(0))
    # read by the draws and by the picks: one row a day, written once
    days = materialise(indexed_days(days, ["_k"]), "days")
    draws = days.select("_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep")).withColumn("_d", draw([seed, F.col("rep"), F.col("_i")], F.col("_n")))
    picked = draws.select("rep", F.col("_d").alias("_i")).join(days.select(F.col("_i").cast("bigint").alias("_i"), "t", "b", "_n"), "_i")
    reps = picked.groupBy("rep").agg((F.avg("t") - F.avg("b")).alias("s"), F.max("_n").alias("n"))
    return reps.agg(F.max("n").alias("boot_days"), (100 * F.avg("s")).alias("spread_boot_mean_pct"), (100 * F.expr("percentile(s, 0.025)")).alias("spread_ci_lo_pct"),
                    (100 * F.expr("percentile(s, 0.975)")).alias("spread_ci_hi_pct")).where(F.col("boot_days") >= min_days)


def bootstrap_sharpe(series: DataFrame, key: str = "strategy", block: int = 21, n_boot: int = 100, seed: int = 0) -> DataFrame:
    """Moving-block bootstrap per strategy: (strategy, replicate, block) draw a start, blocks are
    expanded to day positions and joined back by (strategy, position)."""
    d = indexed_days(series.where("ret is not null"), [key]).where(F.col("_n") >= 3 * block)
    per = d.groupBy(key).agg(F.max("_n").alias("_n"), (F.avg("ret") / F.stddev_pop("ret") * 252 ** 0.5).alias("sharpe"))
    blocks = per.select(key, "_n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"))
    blocks = blocks.select(key, "_n", "rep", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / block).cast("int") - 1)).alias("blk"))
    start = draw([seed, F.col(key), F.col("rep"), F.col("blk")], F.col("_n") - block + 1)
    slots = blocks.withColumn("_s", start).select(key, "_n", "rep", "blk", "_s", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("o"))
    slots = slots.where(F.col("blk") * block + F.col("o") < F.col("_n")).select(key, "rep", (F.col("_s") + F.col("o")).alias("_i"))
    rets = d.select(key, F.col("_i").cast("bigint").alias("_i"), "ret")
    reps = slots.join(rets, [key, "_i"]).groupBy(key, "rep").agg(F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s")).where("s > 0")
    ci = reps.withColumn("sr", F.col("m") / F.col("s") * 252 ** 0.5).groupBy(key).agg(F.count("*").alias("n_boot"), F.expr("percentile(sr, 0.025)").alias("sharpe_ci_lo"), F.expr("percentile(sr, 0.975)").alias("sharpe_ci_hi"))
    return per.select(key, "sharpe").join(ci, key)


def order_shuffle_drawdown(trades: DataFrame, ident: str, pnl: str, n_trials: int = 50, seed: int = 0) -> DataFrame:
    """Drawdown distribution over random trade orders.

    A trial orders all trades by a hash.  The running sum of log growth is taken in two levels (hash
    prefix buckets, then offsets over 256 buckets), so no task ever holds all trades of a trial."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("rep").cast("string"), F.col(ident).cast("string")).cast("binary"))
    t = trades.select(ident, F.log1p(F.col(pnl)).alias("g")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1)))).withColumn("_h", h)
    t = t.withColumn("_b", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))
    inb = W.partitionBy("rep", "_b").orderBy("_h", ident).rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("_c", F.sum("g").over(inb)).withColumn("_top", F.greatest(F.max("_c").over(inb), F.lit(0.0)))
    # growth, best level and worst drop inside each bucket are all that the next level needs
    seg = t.groupBy("rep", "_b").agg(F.sum("g").alias("s"), F.max("_c").alias("hi"), F.min("_c").alias("lo"), F.min(F.col("_c") - F.col("_top")).alias("dd"))
    prior = W.partitionBy("rep").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    seg = seg.withColumn("_off", F.coalesce(F.sum("s").over(prior), F.lit(0.0)))
    seg = seg.withColumn("_peak", F.greatest(F.coalesce(F.max(F.col("_off") + F.col("hi")).over(prior), F.lit(0.0)), F.lit(0.0)))
    worst = F.least(F.col("dd"), F.col("_off") + F.col("lo") - F.greatest(F.col("_peak"), F.col("_off")), F.lit(0.0))
    return seg.groupBy("rep").agg((100 * (F.exp(F.min(worst)) - 1)).alias("mdd_pct"), (100 * (F.exp(F.sum("s")) - 1)).alias("final_return_pct"))


def drawdown_summary(trials: DataFrame) -> DataFrame:
    p = lambda x: F.expr(f"percentile(mdd_pct, {x})")
    return trials.agg(F.count("*").alias("n_trials"), F.avg("final_return_pct").alias("final_return_pct"), p(0.5).alias("mdd_median_pct"), p(0.05).alias("mdd_p5_pct"), p(0.95).alias("mdd_p95_pct"))


def split_index(i: Column, n: Column, k: int) -> Column:
    """0-based chunk of position i when n items are cut into k chunks, the first n % k one longer."""
    size, extra = F.floor(n / k), n % k
    edge = extra * (size + 1)
    return F.when(i < edge, F.floor(i / (size + 1))).otherwise(extra + F.floor((i - edge) / F.greatest(size, F.lit(1)))).cast("int")


def pbo(series: DataFrame, config: str = "config", n_splits: int = 8) -> DataFrame:
    """Probability of overfitting by symmetric cross-validation.  Days are reduced to moments per
    (chunk, config); moments add, so every combination is a sum over at most 8 rows per config."""
    chunks = indexed_days(series, [config])
    m = chunks.withColumn("g", split_index(F.col("_i"), F.col("_n"), n_splits)).groupBy(config, "g").agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("ss"))
    combos = list(combinations(range(n_splits), n_splits // 2))
    c = F.explode(F.array(*[F.struct(F.lit(i).alias("combo"), F.array(*[F.lit(g) for g in s]).alias("members")) for i, s in enumerate(combos)]))
    mm = m.withColumn("c", c).withColumn("_in", F.array_contains("c.members", F.col("g"))).withColumn("combo", F.col("c.combo"))
    half = lambda flag, x: F.sum(F.when(F.col("_in") == flag, F.col(x)))
    agg = mm.groupBy("combo", config).agg(*[half(f, x).alias(f"_{x}_{p}") for f, p in ((True, "i"), (False, "o")) for x in ("n", "s", "ss")])

    def ratio(p):
        n, s, ss = F.col(f"_n_{p}"), F.col(f"_s_{p}"), F.col(f"_ss_{p}")
        var = (ss - s * s / n) / (n - 1)
        return F.when(var > 1e-24, (s / n) / F.sqrt(var)).otherwise(0.0)
    perf = agg.select("combo", config, F.round(ratio("i"), 10).alias("is_perf"), F.round(ratio("o"), 10).alias("oos_perf"))
    # configurations per combination are few (they are the trials of one search)
    ranked = average_rank(perf, ["combo"], "oos_perf", "_r")
    best = ranked.groupBy("combo").agg(F.min(F.struct((-F.col("is_perf")).alias("p"), F.col(config).alias("c"), "_r")).alias("b"), F.count("*").alias("n_conf"))
    w = F.greatest(F.least(F.col("b._r") / (F.col("n_conf") + 1.0), F.lit(1 - 1e-12)), F.lit(1e-12))
    return best.withColumn("logit", F.log(w / (1 - w))).agg(F.avg((F.col("logit") <= 1e-12).cast("double")).alias("pbo"), F.expr("percentile(logit, 0.5)").alias("median_logit"), F.count("*").alias("n_combinations"))


def cpcv(days: DataFrame, n_groups: int = 6, k_test: int = 2, embargo_pct: float = 0.01, label_end: str | None = None) -> DataFrame:
    """(fold, date, role) table of combinatorial purged folds: rows whose label reaches into a test block
    are purged, rows after a block are under embargo.  ``label_end`` holds a row position."""
    d = indexed_days(days.withColumn("_k", F.lit(0)), ["_k"])
    g = split_index(F.col("_i"), F.col("_n"), n_groups)
    combos = list(combinations(range(n_groups), k_test))
    fold = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.array(*[F.lit(x) for x in s]).alias("test")) for i, s in enumerate(combos)]))
    d = d.withColumns({"_g": g, "_f": fold})
    size, extra = F.floor(F.col("_n") / n_groups), F.col("_n") % n_groups
    first = lambda q: q * size + F.least(q, extra)                      # first row of chunk q
    emb = F.floor(F.col("_n") * embargo_pct)
    is_test = F.array_contains("_f.test", F.col("_g"))
    # a block ends where the next chunk is not in the test set; only there does the embargo start
    ends = F.transform(F.filter(F.col("_f.test"), lambda q: ~F.array_contains(F.col("_f.test"), q + 1)), lambda q: first(q + 1))
    embargo = F.exists(ends, lambda e: (F.col("_i") >= e) & (F.col("_i") < e + emb))
    reach = F.col(label_end) if label_end else F.col("_i")
    purged = F.exists(F.col("_f.test"), lambda q: (reach >= first(q)) & (F.col("_i") < first(q + 1))) if label_end else F.lit(False)
    role = F.when(is_test, "test").when(purged, "purged").when(embargo, "embargo").otherwise("train")
    return d.select(F.col("_f.fold").alias("fold"), "date", role.alias("role"))


def bh_fdr(df: DataFrame, p: str = "p", alpha: float = 0.10) -> DataFrame:
    """Step-up adjusted p-values and rejections.  The rank and the minimum over all larger ranks are
    both taken in two levels (value buckets), so many hypotheses do not meet in one task."""
    d = position_within(df.withColumn("_all", F.lit(0)), ["_all"], p, "name", "_rk")
    d = d.withColumns({"_raw": F.col(p) * F.col("_rk_of") / F.col("_rk"), "_b": value_bucket(F.col(p))})
    later = W.orderBy("_b").rowsBetween(1, W.unboundedFollowing)  # one row per bucket
    per = d.groupBy("_b").agg(F.min("_raw").alias("_m")).withColumn("_after", F.min("_m").over(later)).drop("_m")
    inb = W.partitionBy("_b").orderBy("_rk").rowsBetween(0, W.unboundedFollowing)
    adj = F.least(F.min("_raw").over(inb), F.col("_after"), F.lit(1.0))
    d = d.join(per, "_b").withColumn("p_adj", adj)
    cut = d.agg(F.max(F.when(F.col(p) <= alpha * F.col("_rk") / F.col("_rk_of"), F.col("_rk"))).alias("c"))
    passed = d.withColumn("reject", F.coalesce(F.col("_rk") <= cut.scalar(), F.lit(False)))
    rest = df.where(F.col(p).isNull()).withColumns({"p_adj": F.lit(None).cast("double"), "reject": F.lit(False)})
    return passed.select(*df.columns, "p_adj", "reject").unionByName(rest)


def walk_forward(panel: DataFrame, value: str, fwd: str, n_folds: int = 4, min_train: int = 126) -> DataFrame:
    """Out-of-sample IC per fold: dates after the first min_train cut into chunks; fold 0 is all of them."""
    d = panel.where(F.col(value).isNotNull() & F.col(fwd).isNotNull())
    days = indexed_days(d.select("date").distinct().withColumn("_k", F.lit(0)), ["_k"])
    fold = split_index(F.col("_i") - min_train, F.col("_n") - min_train, n_folds) + 1
    days = days.where((F.col("_i") >= min_train) & (F.col("_n") >= min_train + n_folds * 21)).select("date", F.explode(F.array(F.lit(0), fold)).alias("fold"))
    return daily_ic_on(d, value, fwd, days, ["fold"])


def population_percentile(df: DataFrame, key: str, value: str) -> DataFrame:
    """Share of the population at or below each value, from collapsed value counts."""
    ranked = average_rank(df.where(F.col(value).isNotNull()), [], value, "_r")
    ties = df.groupBy(value).agg(F.count("*").alias("_c"))
    n = df.where(F.col(value).isNotNull()).agg(F.count("*").alias("n")).scalar()
    top = F.col("_r") + (F.col("_c") - 1) / 2.0
    return ranked.join(ties, value).withColumn("_n", n).select(key, value, (100 * top / F.col("_n")).alias("percentile"), (100 * (F.col("_n") - top + 1) / F.col("_n")).alias("from_top_pct"))


EULER_GAMMA = 0.5772156649015329


def deflated_sharpe(series: DataFrame, population: DataFrame, key: str = "strategy", ret: str = "ret", value: str = "value") -> DataFrame:
    """Probability that a strategy's Sharpe beats the best expected of as many null trials as the population holds.

    ``series`` (key, ret) gives each strategy's days, annual Sharpe, skew and kurtosis in one aggregate; ``population`` (value)
    holds the annual Sharpes recorded so far, reduced to their number and variance.  Returns key, sharpe_ann, n_days, n_trials,
    sr0_ann, dsr_prob and dsr_reason (why there is no probability).  Null, NaN and infinite trials are left out."""
    daily = 1 / math.sqrt(252)
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value)) < float("inf"))
    trials = population.where(known).agg(F.count("*").alias("n_trials"), F.var_samp(F.col(value) * daily).alias("_v"))  # one row
    n = F.col("n_trials")
    best = (1 - EULER_GAMMA) * normal_quantile("1 - 1 / n_trials") + EULER_GAMMA * normal_quantile("1 - 1 / (n_trials * e())")
    trials = trials.withColumn("_sr0", F.when((n >= 2) & (F.col("_v") > 0), F.sqrt("_v") * best)).withColumn("_one", F.lit(1))
    r = F.col(ret)
    own = series.where(r.isNotNull()).groupBy(key).agg(F.count("*").alias("n_days"), (F.avg(r) / F.when(F.stddev_pop(r) > 0, F.stddev_pop(r))).alias("_sr"), F.skewness(r).alias("_skew"), (F.kurtosis(r) + 3).alias("_kurt")).withColumn("_one", F.lit(1))
    sr, days = F.col("_sr"), F.col("n_days")
    denom = 1 - F.col("_skew") * sr + (F.col("_kurt") - 1) / 4 * sr * sr
    reason = (F.when(sr.isNull() | F.isnan(sr), "no observed Sharpe").when(n < 2, F.format_string("registry population too small (n=%d < 2)", n)).when(days < 30, F.format_string("only %d days (< 30)", days))
              .when(~(F.col("_v") > 0), "zero variance across trial Sharpes").when(~(denom > 0), "invalid skew/kurtosis adjustment"))
    stat = (sr - F.col("_sr0")) * F.sqrt(days - 1) / F.sqrt(F.when(denom > 0, denom))
    j = own.join(trials, "_one").withColumns({"dsr_reason": reason, "_stat": stat})  # the one row of the population meets each strategy
    return j.select(key, (sr / daily).alias("sharpe_ann"), "n_days", "n_trials", (F.col("_sr0") / daily).alias("sr0_ann"), F.when(F.col("dsr_reason").isNull(), normal_probability("_stat")).alias("dsr_prob"), "dsr_reason")


def evaluation_rows(ic: DataFrame, spread: DataFrame) -> DataFrame:
    """Statistics tables to long (evaluation, horizon, statistic, value, n) rows."""
    one = lambda df, name, cols, n: df.select("horizon", F.col(n).alias("n"), *cols).unpivot(["horizon", "n"], cols, "statistic", "value").withColumn("evaluation", F.lit(name))
    return one(ic, "ic", ["mean_daily_ic", "ic_t_stat"], "ic_days").unionByName(one(spread, "spread", ["spread_pct", "spread_t"], "top_n"))
