"""Point-in-time feature matrix, raw factors, z-scored panel, composite and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.exprs import ratio
from tidemark.operators import asof as AS, features as FE
from tidemark.operators.relational import position_within

# fixed values: publication lags, trailing spans and factor set
SHORT_LAG_DAYS, INSIDER_LAG_DAYS = 7, 3
INSIDER_DAYS, NEWS_DAYS = 90, 21
FACTORS = ["momentum", "value", "quality", "low_vol", "growth", "short_pressure", "insider_flow", "sentiment"]


def short_public(short_interest: DataFrame) -> DataFrame:
    public = F.date_add("settlement_date", SHORT_LAG_DAYS)
    return short_interest.where("settlement_date is not null").groupBy("symbol", public.alias("public_date")).agg(
        F.max("days_to_cover").alias("si_days_to_cover"), F.max("shares_short").alias("si_shares_short"))


def feature_matrix(bars: DataFrame, facts: DataFrame | None = None, metrics: list[str] = (), form: str | None = None,
                   short_interest: DataFrame | None = None, insider: DataFrame | None = None, news: DataFrame | None = None,
                   macro: DataFrame | None = None, macro_ids: list[str] = ()) -> DataFrame:
    """(symbol, date) panel with price features and every block that is given.

    All per-symbol sources are unioned with the bars on one (symbol, date) axis after each has been
    combined to at most one row per symbol and day: one shuffle by symbol serves the as-of columns
    (last non-NULL so far), the trailing sums (range frames of days) and, on the bars that are left, the price
    features.  Columns stay flat, so what the caller does not read is neither dealt nor worked out."""
    sides, asof_cols = [], []
    if facts is not None:
        wide = AS.latest_period_facts(facts, list(metrics), form)
        sides.append(wide.select("symbol", F.col("filed").alias("date"), *[F.col(m).alias(f"fund_{m}") for m in metrics]))
        asof_cols += [f"fund_{m}" for m in metrics]
    if short_interest is not None:
        cols = ["si_days_to_cover", "si_shares_short"]
        si = short_public(short_interest).select("symbol", F.col("public_date").alias("date"), F.struct(*cols).alias("_si"))
        sides.append(si)
    if insider is not None:
        pub = F.date_add("date", INSIDER_LAG_DAYS)
        sides.append(insider.where("shares is not null").groupBy("symbol", pub.alias("date")).agg(F.sum("shares").alias("_ins")))
    if news is not None:
        sides.append(news.where("score is not null").groupBy("symbol", "date").agg(F.sum("score").alias("_ns"), F.count("*").alias("_nc")))
    if sides:
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [bars.withColumn("_bar", F.lit(True)), *sides])
        rows = rows.withColumn("date", F.unix_date("date"))  # day numbers, so that frames of rows and of days need one sort
        upto = FE.by_symbol().rangeBetween(W.unboundedPreceding, 0)
        span = lambda n: FE.by_symbol().rangeBetween(-(n - 1), 0)
        new = {c: F.last(c, ignorenulls=True).over(upto) for c in asof_cols}
        if short_interest is not None:
            new["_si"] = F.last("_si", ignorenulls=True).over(upto)
        if insider is not None:
            new[f"insider_net_{INSIDER_DAYS}d"] = F.sum("_ins").over(span(INSIDER_DAYS)).cast("double")
        if news is not None:
            new["_ws"], new["_wc"] = F.sum("_ns").over(span(NEWS_DAYS)), F.sum("_nc").over(span(NEWS_DAYS))
        rows = FE.price_features(rows.withColumns(new).where("_bar"))
        out = [*bars.columns, *[c for c in rows.columns if c not in bars.columns and c not in new and not c.startswith("_")], *asof_cols]
        if short_interest is not None:
            out += [F.col("_si.si_days_to_cover").alias("si_days_to_cover"), F.col("_si.si_shares_short").alias("si_shares_short")]
        if insider is not None:
            out.append(f"insider_net_{INSIDER_DAYS}d")
        if news is not None:
            out += [(F.col("_ws") / F.when(F.col("_wc") > 0, F.col("_wc"))).alias(f"news_score_{NEWS_DAYS}d"),
                    F.coalesce("_wc", F.lit(0)).alias(f"news_count_{NEWS_DAYS}d")]
        panel = rows.withColumn("date", F.date_from_unix_date("date")).select(*out)
    else:
        panel = FE.price_features(bars)
    return AS.broadcast_by_date(panel, macro, list(macro_ids)) if macro is not None else panel


def raw_factors(fm: DataFrame) -> DataFrame:
    """Unstandardised factors from whichever feature columns are there."""
    have = set(fm.columns)
    f = {"momentum": F.coalesce("mom_12_1", "ret_63d") if "ret_63d" in have else F.col("mom_12_1")}
    if "fund_eps" in have:
        f["value"] = ratio("fund_eps", "close")
    parts = [ratio(a, b) for a, b in (("fund_net_income", "fund_total_assets"), ("fund_gross_profit", "fund_revenue")) if {a, b} <= have]
    if parts:
        f["quality"] = reduce(lambda a, b: a + b, parts) / len(parts)
    if "vol_21d" in have:
        f["low_vol"] = F.col("vol_21d")
    if "fund_revenue" in have:
        fm = FE.change_levels(fm, "fund_revenue")
        prior = F.col("prior_value")
        f["growth"] = F.when(prior > 0, (F.col("fund_revenue") - prior) / F.abs(prior))
    if "si_days_to_cover" in have:
        f["short_pressure"] = -F.col("si_days_to_cover")
    if "insider_net_90d" in have:
        f["insider_flow"] = ratio("insider_net_90d", "fund_shares") if "fund_shares" in have else F.col("insider_net_90d")
    if "news_score_21d" in have:
        f["sentiment"] = F.col("news_score_21d")
    return fm.select("symbol", "date", "close", *[f[c].alias(c) for c in FACTORS if c in f])


def signal_panel(raw: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Cross-sectional z-scores per date and their weighted mean over the factors that are present; a factor without weight
    takes no part in the mean."""
    cols = [c for c in FACTORS if c in raw.columns]
    used = [c for c in cols if weights.get(c)]
    z = FE.zscore_by(raw.select("symbol", "date", *cols), "date", cols)
    num = reduce(lambda a, b: a + b, [F.coalesce(F.col(c) * float(weights[c]), F.lit(0.0)) for c in used], F.lit(0.0))
    den = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), float(weights[c])).otherwise(0.0) for c in used], F.lit(0.0))
    return z.withColumn("composite", num / F.when(den != 0, den))


def rank_on_date(panel: DataFrame, score: str = "composite", on: str | None = None, ascending: bool = False) -> DataFrame:
    """Symbols ranked 1..n on one date (default: the newest), ties by symbol."""
    if on is None:
        panel = panel.join(panel.agg(F.max("date").alias("date")), "date", "left_semi")
    else:
        panel = panel.where(F.col("date") == F.lit(on).cast("date"))
    return position_within(panel, ["date"], score, "symbol", "rank", descending=not ascending).drop("rank_of")
