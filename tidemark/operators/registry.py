"""Result registry: append-only long rows, baselines, guarded comparison; and the evaluation contracts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.dedup import keep_latest

COLUMNS = ["run_id", "input_name", "input_type", "evaluation", "horizon", "statistic", "value", "n", "universe_hash", "date_range", "created_at", "execution_hash"]
KEY = ["input_name", "evaluation", "horizon", "statistic"]


def append(rows: DataFrame, path: str) -> None:
    missing = set(COLUMNS) - set(rows.columns)
    if missing:
        raise ValueError(f"registry rows lack {sorted(missing)}")
    rows.select(*COLUMNS).write.mode("append").parquet(path)


def baselines(registry: DataFrame) -> DataFrame:
    return keep_latest(registry, KEY, ["created_at"])


def compare(rows: DataFrame, registry: DataFrame, tol: float = 0.005) -> DataFrame:
    """Fresh rows against baselines.  Rows over different universes are never compared: they get a status."""
    base = baselines(registry).select(*KEY, F.col("value").alias("baseline"), F.col("universe_hash").alias("_u"))
    j = rows.join(base, KEY, "left")
    same, diff = F.col("universe_hash") == F.col("_u"), F.col("value") - F.col("baseline")
    status = F.when(F.col("_u").isNull(), "no_baseline").when(~same, "universe_mismatch").when(F.abs(diff) <= tol, "within_tol").otherwise("moved")
    return j.select(*KEY, "value", F.when(same, F.col("baseline")).alias("baseline"), F.when(same, diff).alias("diff"), status.alias("status"))


def population(registry: DataFrame, statistic: str, exclude: str | None = None) -> DataFrame:
    r = registry.where((F.col("statistic") == statistic) & F.col("value").isNotNull())
    if exclude is not None:
        r = r.where(F.col("input_name") != exclude)
    return keep_latest(r, ["input_name"], ["created_at"]).select("input_name", "value")


def summary(registry: DataFrame) -> DataFrame:
    return registry.groupBy("input_name").agg(F.count("*").alias("rows"), F.count_distinct("run_id").alias("runs"), F.max("created_at").alias("latest"))


def campaign(registry: DataFrame, stats: list[str], group: Column) -> DataFrame:
    """Latest value of each listed statistic per input, as columns, with a dev / holdout label."""
    latest = keep_latest(registry.where(F.col("statistic").isin(stats)), ["input_name", "statistic"], ["created_at"])
    return latest.groupBy("input_name").agg(*[F.max(F.when(F.col("statistic") == s, F.col("value"))).alias(s) for s in stats]).withColumn("split", group)


def survivors(table: DataFrame, p: str = "p_value", alpha: float = 0.1) -> DataFrame:
    """Inputs of a campaign whose p-value passes the false-discovery control over the whole campaign; without p-values none."""
    from tidemark.operators.research_stats import bh_fdr
    known = table.where(F.col(p).isNotNull()).select(F.col("input_name").alias("name"), F.col(p).alias("p"))
    return bh_fdr(known, alpha=alpha).where("reject").select(F.col("name").alias("input_name"), "p", "p_adj")


# --- contracts -------------------------------------------------------------------------------

def _check(df: DataFrame, keys: list[str], no_null: list[str], what: str) -> None:
    """One aggregate; the only values that reach the driver are three counts."""
    missing = set(no_null) - set(df.columns)
    if missing:
        raise ValueError(f"{what}: missing columns {sorted(missing)}")
    bad = F.lit(False)
    types = dict(df.dtypes)
    for c in no_null:
        bad = bad | F.col(c).isNull() | (F.isnan(c) if types[c] in ("double", "float") else F.lit(False))
    per = df.withColumn("_bad", bad).groupBy(*keys).agg(F.count("*").alias("c"), F.max("_bad").alias("b"))
    dup, null, rows = per.agg(F.count_if(F.col("c") > 1), F.count_if("b"), F.count("*")).first()
    if null:
        raise ValueError(f"{what}: {null} keys with NULL or NaN in {no_null}")
    if dup:
        raise ValueError(f"{what}: {dup} duplicate keys {keys}")
    if not rows:
        raise ValueError(f"{what}: no rows")


# fixed values: columns of the contracts, and the number of dates under which daily statistics are unreliable
CONTRACTS = {"signal": (("symbol", "date"), ("symbol", "date", "value")), "event_set": (("symbol", "date", "label"), ("symbol", "date", "label"))}
MIN_DATES = 250


def contract_violations(df: DataFrame, kind: str, name: str, lag_days: int = 0, direction: int = 1) -> DataFrame:
    """(contract, check, severity, n) rows: what keeps a table from being a signal or an event set, in one aggregate.

    Checks: missing columns, rows with NULL or NaN, keys with several rows (signals only), dates with a time zone, negative lag, direction, and
    (a warning) too few distinct dates.  A check whose columns are missing is not made."""
    keys, needed = CONTRACTS[kind]
    types = dict(df.dtypes)
    have = [c for c in needed if c in types]
    bad = F.lit(False)
    for c in have:
        bad = bad | F.col(c).isNull() | (F.isnan(c) if types[c] in ("double", "float") else F.lit(False))
    entry = lambda check, n, severity="error": F.struct(F.lit(check).alias("check"), F.when(n > 0, severity).otherwise("ok").alias("severity"), n.cast("bigint").alias("n"))
    fixed = [entry("missing_columns", F.lit(len(needed) - len(have))), entry("negative_lag", F.lit(int(lag_days < 0))), entry("time_zone", F.lit(int(types.get("date") == "timestamp")))]
    if kind == "signal":
        fixed.append(entry("direction", F.lit(int(direction not in (-1, 0, 1)))))
    if not set(keys) <= set(have):
        one = df.agg(F.count("*").alias("_n"))
        return one.select(F.lit(name).alias("contract"), F.explode(F.array(*fixed)).alias("e")).select("contract", "e.*")
    per = df.withColumn("_bad", bad).groupBy(*keys).agg(F.count("*").alias("_c"), F.count_if("_bad").alias("_b"))
    by_date = per.groupBy("date").agg(F.sum("_b").alias("_b"), F.count_if(F.col("_c") > 1).alias("_d"))
    one = by_date.agg(F.coalesce(F.sum("_b"), F.lit(0)).alias("_b"), F.coalesce(F.sum("_d"), F.lit(0)).alias("_d"), F.count("date").alias("_n"))
    found = [*fixed, entry("missing_values", F.col("_b")), entry("few_dates", F.when(F.col("_n") < MIN_DATES, F.col("_n")).otherwise(0), "warning")]
    if kind == "signal":
        found.append(entry("duplicate_keys", F.col("_d")))
    return one.select(F.lit(name).alias("contract"), F.explode(F.array(*found)).alias("e")).select("contract", "e.*")


@dataclass(frozen=True)
class Signal:
    """(symbol, date, value), unique by key, no missing values."""
    frame: DataFrame
    name: str
    lag_days: int = 1
    direction: int = 1

    def __post_init__(self):
        if self.direction not in (1, -1):
            raise ValueError("direction is 1 or -1")
        _check(self.frame, ["symbol", "date"], ["symbol", "date", "value"], f"signal {self.name}")


@dataclass(frozen=True)
class EventSet:
    """(symbol, date, label), no missing key part."""
    frame: DataFrame
    name: str
    lag_days: int = 0
    min_events: int = 5

    def __post_init__(self):
        if self.lag_days < 0:
            raise ValueError(f"event set {self.name}: lag_days is not negative")
        if "label" not in self.frame.columns:
            raise ValueError(f"event set {self.name}: missing columns ['label']")
        _check(self.frame, ["symbol", "date", "label"], ["symbol", "date", "label"], f"event set {self.name}")


@dataclass(frozen=True)
class TradeRule:
    """Boolean Columns over an indicator frame."""
    name: str
    entries: Column
    exits: Column
    side: str = "long"

    def flags(self, ind: DataFrame, key: str = "symbol") -> DataFrame:
        f = lambda c: F.coalesce(c, F.lit(False))
        return ind.select(F.col(key).alias("key"), "date", "close", f(self.entries).alias("entry"), f(self.exits).alias("exit"))
