"""Latest record per key, reconciliation and slices of append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

# fixed values: columns that describe the load, not the record; recency order, strongest first
BOOKKEEPING = ["fetched_at", "year", "month"]
RECENCY = ["fetched_at", "filed", "filing_date", "filed_date", "last_refreshed"]


def keep_latest(df: DataFrame, keys: list[str], recency: list[str | Column]) -> DataFrame:
    """One row per key: greatest recency tuple (NULL is oldest), whole row as tie-break.

    A first-row filter on row_number is planned as a limit per key on both sides of the shuffle, so a key that holds a
    third of all rows reaches its reducer as one row per map task, and rows travel as they are (columns that cannot
    be ordered, such as maps, break ties by their JSON)."""
    ordered = lambda c: F.to_json(F.struct(c)) if _has_map(df.schema[c].dataType) else F.col(c)
    order = [*(F.col(c) if isinstance(c, str) else c for c in recency), *(ordered(c) for c in df.columns if c not in keys)]
    w = W.partitionBy(*keys).orderBy(*(o.desc_nulls_last() for o in order))
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _has_map(t.elementType)
    return isinstance(t, T.MapType) or isinstance(t, T.StructType) and any(_has_map(f.dataType) for f in t.fields)


def dedup_key(columns: list[str], natural_key: list[str] | None) -> list[str]:
    """The natural key only if every part of it is present, else all but the bookkeeping columns."""
    if natural_key and set(natural_key) <= set(columns):
        return natural_key
    return [c for c in columns if c not in BOOKKEEPING]


def dedup(df: DataFrame, natural_key: list[str] | None) -> DataFrame:
    key = dedup_key(df.columns, natural_key)
    recency = [c for c in RECENCY if c in df.columns and c not in key]
    if not set(df.columns) - set(key):
        return df.distinct()
    return keep_latest(df, key, recency)


def canonical_date(c: str) -> Column:
    """Mixed 'yyyy-MM-dd' and timestamp strings to one ISO date string."""
    return F.date_format(F.coalesce(F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")),
                                    F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss")),
                                    F.try_to_timestamp(F.col(c))), "yyyy-MM-dd")


def backfill_snapshot_date(df: DataFrame) -> DataFrame:
    derived = F.to_date("fetched_at")
    return df.withColumn("snapshot_date", F.coalesce(F.col("snapshot_date"), derived) if "snapshot_date" in df.columns else derived)


def compaction_report(df: DataFrame, keys: list[str], name: str, gate_pct: float = 5.0) -> DataFrame:
    """raw / curated / removed counts of one table; grouping twice keeps a hot key cheap."""
    per_key = df.groupBy(*keys).count()
    out = per_key.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("raw_rows"), F.count("*").alias("curated_rows"))
    removed = F.col("raw_rows") - F.col("curated_rows")
    pct = F.when(F.col("raw_rows") > 0, 100.0 * removed / F.col("raw_rows")).otherwise(0.0)
    return out.select(F.lit(name).alias("table"), "raw_rows", "curated_rows", removed.alias("removed"),
                      F.round(pct, 2).alias("pct_removed"), (pct > gate_pct).alias("over_gate"))


def prefer_first(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two sources; where both have a key, rows of the first win."""
    both = first.withColumn("_p", F.lit(1)).unionByName(second.withColumn("_p", F.lit(0)), allowMissingColumns=True)
    return keep_latest(both, keys, ["_p"]).drop("_p")


def duplicate_rate(df: DataFrame, ignore: list[str], name: str) -> DataFrame:
    keys = [c for c in df.columns if c not in ignore]
    return (df.groupBy(*keys).count().agg(F.sum("count").alias("rows"), F.count("*").alias("distinct_rows"))
            .select(F.lit(name).alias("table"), "rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicates")))


def longest_source(df: DataFrame, key: str, source: str, priority: Column) -> DataFrame:
    """Keep, per key, the rows of the source with most rows (ties: lowest priority number)."""
    counts = df.groupBy(key, source).agg(F.count("*").alias("_n"), F.min(priority).alias("_p"))
    best = counts.groupBy(key).agg(F.max_by(source, F.struct("_n", -F.col("_p"))).alias(source))
    return df.join(best, [key, source], "left_semi")


def unseen(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the target yet."""
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")


def latest_slice(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Rows of the newest value of a column, overall or per group."""
    if by:
        return df.join(df.groupBy(*by).agg(F.max(column).alias(column)), [*by, column], "left_semi")
    return df.join(df.agg(F.max(column).alias(column)), column, "left_semi")
