"""Reference enrichment, layered merges and small reports built on joins.

No broadcast hints: the optimizer broadcasts a side only when its measured size is under
spark.sql.autoBroadcastJoinThreshold and otherwise shuffles, with skewed keys split at run time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.exprs import ratio

# fixed values: zones in the order they are tried (name, lat from, lat to, lon from, lon to)
ZONES = [("gulf", 10, 20, -45, -10), ("strait", 15, 30, -20, 20), ("canal", 25, 50, 0, 45)]


def enrich(base: DataFrame, ref: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Left join to a reference table of one row per key; never changes the row count."""
    return base.join(ref.select(on, *columns), on, "left")


def exposure(holdings: DataFrame) -> DataFrame:
    """Sector weights in percent per fund."""
    per = holdings.groupBy("fund", "sector").agg(F.sum("market_value").alias("mv"))
    total = holdings.groupBy("fund").agg(F.sum("market_value").alias("total"))
    pct = (100 * F.col("mv")).cast("double") / F.col("total").cast("double")
    return per.join(total, "fund").select("fund", "sector", F.round(pct, 2).alias("weight_pct"))


def overweight(fund: DataFrame, benchmark: DataFrame) -> DataFrame:
    a = fund.select("sector", F.col("weight_pct").alias("fund_pct"))
    b = benchmark.select("sector", F.col("weight_pct").alias("benchmark_pct"))
    both = a.join(b, "sector", "full").fillna(0.0, ["fund_pct", "benchmark_pct"])
    return both.withColumn("overweight_pct", F.round(F.col("fund_pct") - F.col("benchmark_pct"), 2))


def valuation(facts: DataFrame, bars: DataFrame) -> DataFrame:
    """Latest value per metric in one conditional aggregate, joined to the latest close."""
    order = F.struct("period_end", "accn")
    m = facts.groupBy("symbol").agg(*[F.max_by("value", F.when(F.col("metric") == k, order)).alias(k) for k in ("eps", "revenue", "net_income")])
    p = bars.groupBy("symbol").agg(F.max_by("close", "date").alias("close"))
    return p.join(m, "symbol", "left").select("symbol", "close", "eps", "revenue", "net_income",
                                              ratio("close", "eps").alias("pe"), ratio("net_income", "revenue").alias("margin"))


def for_symbols(events: DataFrame, symbols: list) -> DataFrame:
    """Market-wide events once per listed symbol; the list is a parameter, expanded row by row."""
    return events.withColumn("symbol", F.explode(F.array(*[F.lit(s) for s in symbols])))


def grid(df: DataFrame, axes: dict[str, list]) -> DataFrame:
    """Every combination of short parameter axes, expanded row by row."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def layered_reference(base: DataFrame, layers: list[tuple[str, DataFrame, str | None]], key: str, base_name: str) -> DataFrame:
    """Left joins in priority order; empty text counts as missing; the last layer that adds (its
    marker column set, or any match) names the primary source."""
    filled, source = base, F.lit(base_name)
    for name, layer, marker in layers:
        here = F.col(f"_{name}.{marker}") if marker else F.col(f"_{name}.{key}")
        lay = layer.alias(f"_{name}")
        both = filled.withColumn("_src", source).alias("_b").join(lay, F.col(f"_b.{key}") == F.col(f"_{name}.{key}"), "left")
        cols = []
        for c in dict.fromkeys([*filled.columns, *layer.columns]):
            mine, theirs = F.col(f"_b.{c}") if c in filled.columns else None, F.col(f"_{name}.{c}") if c in layer.columns else None
            if c == key or theirs is None:
                cols.append(mine.alias(c))
            elif mine is None:
                cols.append(theirs.alias(c))
            else:
                is_text = dict(filled.dtypes)[c] == "string"
                cols.append(F.coalesce(F.nullif(mine, F.lit("")) if is_text else mine, theirs).alias(c))
        filled = both.select(*cols, F.when(here.isNotNull(), name).otherwise(F.col("_src")).alias("primary_source"))
        source = F.col("primary_source")
        if (name, layer, marker) != layers[-1]:
            filled = filled.withColumnRenamed("primary_source", "_keep")
            source = F.col("_keep")
    return filled.drop("_keep") if "_keep" in filled.columns else filled


def holdings_overlap(latest: DataFrame, a, b) -> DataFrame:
    total = latest.groupBy("fund").agg(F.sum("market_value").alias("total"))
    w = latest.join(total, "fund").withColumn("w", F.col("market_value").cast("double") / F.col("total").cast("double") * 100)
    left = w.where(F.col("fund") == a).select("ticker", F.col("w").alias("weight_a"))
    right = w.where(F.col("fund") == b).select("ticker", F.col("w").alias("weight_b"))
    return left.join(right, "ticker")


def zone_of(lat: Column, lon: Column, zones=ZONES) -> Column:
    """First zone whose box holds the point, else 'unknown'.  Zones are configuration, so they are a
    CASE chain in the projection; no join, and it works on a stream as it stands."""
    out = reduce(lambda acc, z: F.when(lat.between(z[1], z[2]) & lon.between(z[3], z[4]), z[0]).otherwise(acc), reversed(zones), F.lit("unknown"))
    return out


def unmapped(sources: list[DataFrame], mapped: DataFrame, col: str) -> DataFrame:
    """Distinct upper-cased names over all sources that the mapping lacks."""
    names = reduce(lambda a, b: a.unionByName(b), [s.select(F.upper(col).alias(col)) for s in sources])
    return names.distinct().join(mapped.select(F.upper(col).alias(col)).distinct(), col, "left_anti")
