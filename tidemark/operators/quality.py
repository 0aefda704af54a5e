"""Data-quality checks.  Each check set is one aggregate pass over its table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


@dataclass(frozen=True)
class TableSchema:
    required: tuple[str, ...] = ()
    critical: tuple[str, ...] = ()
    date_col: str | None = None
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    stamp: str = "fetched_at"


# fixed values: thresholds of the checks
NULL_ERROR, NULL_WARN, SHRINK = 0.5, 0.05, 0.5
OUTLIER_HIGH, OUTLIER_MEDIUM = 10.0, 1.0


def _long(agg: DataFrame, rows: list[tuple[str, Column, Column]], table: str) -> DataFrame:
    """One aggregate row to (table, check, severity, measure) rows."""
    entries = F.array(*[F.struct(F.lit(n).alias("check"), sev.alias("severity"), val.cast("double").alias("measure")) for n, sev, val in rows])
    return agg.select(F.lit(table).alias("table"), F.explode(entries).alias("e")).select("table", "e.check", "e.severity", "e.measure")


def validate(df: DataFrame, schema: TableSchema, table: str, as_of, previous_rows: int | None = None, max_age_hours: float | None = None) -> DataFrame:
    """All checks of a table as rows, from a single aggregate.

    With ``max_age_hours`` the newest ingestion time (``schema.stamp``) must be so near to ``as_of``: an absent column is
    ok, a column without a time a warning.  The measure is the age in hours."""
    missing = [c for c in schema.required if c not in df.columns]
    aggs = [F.count("*").alias("n")]
    critical = [c for c in schema.critical if c in df.columns]
    ranges = {c: b for c, b in schema.ranges.items() if c in df.columns}
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in critical]
    if schema.date_col in df.columns:
        aggs.append(F.count_if(F.to_date(schema.date_col) > F.lit(as_of).cast("date")).alias("future"))
    aggs += [F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"out_{c}") for c, (lo, hi) in ranges.items()]
    if max_age_hours is not None and schema.stamp in df.columns:
        aggs.append(F.max(F.try_to_timestamp(F.col(schema.stamp).cast("string")).cast("timestamp_ntz")).alias("newest"))
    n = F.col("n")
    rows = [("not_empty", F.when(n > 0, "ok").otherwise("error"), n),
            ("required_cols", F.lit("error" if missing else "ok"), F.lit(len(missing)))]
    for c in critical:
        share = F.when(n > 0, F.col(f"null_{c}") / n).otherwise(0.0)
        rows.append((f"nulls:{c}", F.when(share > NULL_ERROR, "error").when(share > NULL_WARN, "warning").otherwise("ok"), F.col(f"null_{c}")))
    if schema.date_col in df.columns:
        rows.append(("future_dates", F.when(F.col("future") > 0, "warning").otherwise("ok"), F.col("future")))
    for c in ranges:
        rows.append((f"range:{c}", F.when(F.col(f"out_{c}") > 0, "warning").otherwise("ok"), F.col(f"out_{c}")))
    if previous_rows is not None:
        rows.append(("row_count", F.when(n < SHRINK * previous_rows, "warning").otherwise("ok"), n))
    if max_age_hours is not None and schema.stamp in df.columns:
        age = F.timestamp_diff("MICROSECOND", F.col("newest"), F.lit(as_of).cast("timestamp_ntz")) / 3.6e9
        rows.append((schema.stamp, F.when(age <= max_age_hours, "ok").otherwise("warning"), age))
    elif max_age_hours is not None:
        rows.append((schema.stamp, F.lit("ok"), F.lit(None).cast("double")))
    return _long(df.agg(*aggs), rows, table)


def verdict(checks: DataFrame) -> DataFrame:
    """PASS / FAIL / NO DATA per table."""
    empty = F.max(F.when((F.col("check") == "not_empty") & (F.col("severity") == "error"), 1).otherwise(0)) == 1
    errors, warnings = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")
    return checks.groupBy("table").agg(F.when(empty, "NO DATA").when(errors > 0, "FAIL").otherwise("PASS").alias("status"),
                                       errors.alias("errors"), warnings.alias("warnings"))


# --- files behind a table ----------------------------------------------------------------------


def files(df: DataFrame) -> DataFrame:
    """(file, folder, modified, rows) of the files that a scan reads, from its metadata columns: one partial aggregate, no shuffle of rows."""
    path = F.col("_metadata.file_path")
    return df.groupBy(path.alias("file"), F.col("_metadata.file_modification_time").alias("modified")).agg(F.count("*").alias("rows")).select(
        "file", F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("folder"), "modified", "rows")


def newest_files(df: DataFrame, by: str = "folder") -> DataFrame:
    """All rows of the newest file of a scan (by="file"), or of all files of the folder that holds it.  The newest is the one last
    modified, the greater name of equal times; its name comes from the file listing alone, and the scan is cut to it."""
    parts = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified")).groupBy("file").agg(F.max("modified").alias("modified"))
    newest = parts.agg(F.max_by("file", F.struct("modified", "file"))).head()[0]  # one name
    if newest is None:
        return df
    path = F.col("_metadata.file_path")
    return df.where(path == newest) if by == "file" else df.where(F.regexp_extract(path, "^(.*)/[^/]*$", 1) == newest.rsplit("/", 1)[0])


def validate_latest(tables: dict[str, tuple[DataFrame, TableSchema]], as_of, by: str = "folder") -> DataFrame:
    """(table, status, errors, warnings, rows) of the newest file of each table; an old file's age is no fault here."""
    parts = []
    for name, (df, schema) in tables.items():
        checks = validate(newest_files(df, by), schema, name, as_of)
        rows = checks.where("check = 'not_empty'").select("table", F.col("measure").cast("long").alias("rows"))
        parts.append(verdict(checks).join(rows, "table"))
    return reduce(DataFrame.unionByName, parts)


def stale_snapshots(tables: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(table, raw_rows, curated_rows, stale, status) for (raw, curated) scans: a snapshot last written before the newest raw file is stale."""
    parts = []
    for name, (raw, curated) in tables.items():
        a, b = (files(x).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias(f"{c}_rows"), F.max("modified").alias(f"{c}_at")) for x, c in ((raw, "raw"), (curated, "curated")))
        both = a.select(F.lit(name).alias("table"), "*").join(b.select(F.lit(name).alias("table"), "*"), "table")  # one row each
        stale = F.coalesce(F.col("curated_at") < F.col("raw_at"), F.lit(False))
        parts.append(both.select("table", "raw_rows", "curated_rows", stale.alias("stale"), F.when(stale, "snapshot_older_than_raw").when(F.col("curated_rows") > F.col("raw_rows"), "curated_exceeds_raw")
                                 .when(F.col("curated_rows") == 0, "missing_in_curated").otherwise("ok").alias("status")))
    return reduce(DataFrame.unionByName, parts)


def row_count_anomaly(df: DataFrame, table_col: str, snapshot: str, min_snapshots: int = 5) -> DataFrame:
    """z-score of the newest snapshot's row count against all snapshots of its table."""
    counts = df.groupBy(table_col, snapshot).agg(F.count("*").alias("rows"))
    z = (F.col("latest") - F.col("mean")) / F.col("std")
    return (counts.groupBy(table_col).agg(F.count("*").alias("snapshots"), F.max_by("rows", snapshot).alias("latest"),
                                          F.avg("rows").alias("mean"), F.stddev_pop("rows").alias("std"))
            .where((F.col("snapshots") >= min_snapshots) & (F.col("std") > 0))
            .withColumn("z", z)
            .withColumn("severity", F.when(F.abs("z") > 3, "high").when(F.abs("z") > 2, "medium")))


def outlier_share(df: DataFrame, ranges: dict[str, tuple[float, float]], table: str) -> DataFrame:
    agg = df.agg(F.count("*").alias("n"), *[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in ranges.items()])
    long = agg.unpivot(["n"], list(ranges), "column", "outliers")
    pct = 100.0 * F.col("outliers") / F.col("n")
    return (long.where(F.col("outliers") > 0)
            .select(F.lit(table).alias("table"), "column", "outliers", F.round(pct, 4).alias("pct"),
                    F.when(pct > OUTLIER_HIGH, "high").when(pct > OUTLIER_MEDIUM, "medium").otherwise("low").alias("severity")))


def temporal_gaps(df: DataFrame, key: str, date: str, max_days: int = 7) -> DataFrame:
    """Gaps between successive distinct days; distinct first, so a key has at most calendar-many rows."""
    w = W.partitionBy(key).orderBy(date)
    gap = F.datediff(F.col(date), F.lag(date).over(w))
    return (df.select(key, date).distinct().withColumn("gap", gap).groupBy(key)
            .agg(F.count_if(F.col("gap") > max_days).alias("gaps"), F.max("gap").alias("max_gap")).where("gaps > 0"))


def freshness(tables: dict[str, tuple[DataFrame, str | None]], as_of: str, warn_hours: float = 48, critical_hours: float = 168) -> DataFrame:
    """Status per table at an as-of date; one small aggregate per table, unioned."""
    parts = []
    for name, (df, date) in tables.items():
        latest = F.max(F.to_date(date)) if date else F.lit(None).cast("date")
        parts.append(df.agg(F.count("*").alias("rows"), latest.alias("latest")).select(
            F.lit(name).alias("table"), "rows", "latest", F.lit(date is not None).alias("dated")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    hours = 24.0 * F.datediff(F.lit(as_of).cast("date"), F.col("latest"))
    status = (F.when(F.col("rows") == 0, "NO DATA").when(~F.col("dated") | F.col("latest").isNull(), "NO DATE COL")
              .when(hours <= warn_hours, "FRESH").when(hours <= critical_hours, "STALE").otherwise("STALE_CRITICAL"))
    return out.select("table", "rows", "latest", hours.alias("staleness_hours"), status.alias("status"))


def reconcile(raw: DataFrame, curated: DataFrame, by: str) -> DataFrame:
    """Raw and curated row counts per group; a group missing on one side counts zero."""
    a, b = raw.groupBy(by).agg(F.count("*").alias("raw_rows")), curated.groupBy(by).agg(F.count("*").alias("curated_rows"))
    out = a.join(b, by, "full").fillna(0, ["raw_rows", "curated_rows"])
    return out.withColumn("status", F.when(F.col("curated_rows") > F.col("raw_rows"), "curated_exceeds_raw")
                          .when(F.col("curated_rows") == 0, "missing_in_curated").otherwise("ok"))


def constant_columns(df: DataFrame, cols: list[str], limit: int = 2) -> DataFrame:
    """Columns with suspiciously few distinct values, from one pass."""
    agg = df.agg(*[F.count_distinct(c).alias(c) for c in cols])
    return agg.unpivot([], cols, "column", "distinct_values").withColumn("suspicious", F.col("distinct_values") <= limit)


def publication_checks(df: DataFrame, keys: list[str], date: str, as_of: str, min_rows: int, max_age_days: int, table: str) -> DataFrame:
    per_key = df.groupBy(*keys).agg(F.count("*").alias("c"), F.max(F.to_date(date)).alias("m"))
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    agg = per_key.agg(F.sum("c").alias("n"), F.sum(F.when(null_key, F.col("c")).otherwise(0)).alias("nullk"),
                      F.sum(F.col("c") - 1).alias("dup"), F.datediff(F.lit(as_of).cast("date"), F.max("m")).alias("age"))
    bad = lambda cond: F.when(cond, "fail").otherwise("pass")
    return _long(agg, [("min_rows", bad(F.col("n") < min_rows), F.col("n")), ("null_key", bad(F.col("nullk") > 0), F.col("nullk")),
                       ("duplicate_key", bad(F.col("dup") > 0), F.col("dup")), ("stale", bad(F.col("age") > max_age_days), F.col("age"))], table)


def wide_key(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    """(table, rows, symbols, duplicate_keys, status): rows beyond the first of each key of a wide table; null parts of a key are values."""
    per = df.groupBy(*keys).agg(F.count("*").alias("c"))
    symbol = per.groupBy(keys[0]).agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("d"))
    out = symbol.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(keys[0]).alias("symbols"), F.coalesce(F.sum("d"), F.lit(0)).alias("duplicate_keys"))
    return out.select(F.lit(table).alias("table"), "rows", "symbols", "duplicate_keys", F.when(F.col("duplicate_keys") > 0, "fail").otherwise("pass").alias("status"))


def count_coherence(declared: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts that a manifest (table, rows) declares against the counts of the tables; a table missing on one side counts as null."""
    actual = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("actual")).select(F.lit(n).alias("table"), "actual") for n, df in tables.items()])
    both = declared.select("table", F.col("rows").cast("long").alias("declared")).join(actual, "table", "full")
    return both.select("table", "declared", "actual", F.when(F.col("declared").eqNullSafe(F.col("actual")), "pass").otherwise("fail").alias("status"))


def schema_check(tables: dict[str, DataFrame], registry: dict[str, dict[str, str]]) -> DataFrame:
    """(table, column, expected, found, nulls, bad_casts, status) for every registered column of every table.

    A column that is absent is an error, one with values that do not cast to the registered type a warning; one pass a table."""
    parts = []
    for name, columns in registry.items():
        df = tables.get(name)
        found = {} if df is None else {f.name: f.dataType.simpleString() for f in df.schema}
        aggs = [F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns if c in found]
        aggs += [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(f"b_{c}") for c, t in columns.items() if c in found]
        entries = []
        for c, t in columns.items():
            nulls, bad = (F.col(f"{p}_{c}").cast("long") if c in found else F.lit(None).cast("long") for p in "nb")
            status = F.when(bad > 0, "warning").otherwise("ok") if c in found else F.lit("error")
            entries.append(F.struct(F.lit(c).alias("column"), F.lit(t).alias("expected"), F.lit(found.get(c)).cast("string").alias("found"), nulls.alias("nulls"), bad.alias("bad_casts"), status.alias("status")))
        one = df.agg(*aggs) if aggs else df.sparkSession.range(1) if df is not None else next(iter(tables.values())).sparkSession.range(1)
        parts.append(one.select(F.lit(name).alias("table"), F.explode(F.array(*entries)).alias("e")).select("table", "e.*"))
    return reduce(DataFrame.unionByName, parts)


def missing_members(expected: DataFrame, chunks: list[str], present: DataFrame, member: str, chunk: str) -> DataFrame:
    """Expected (member, chunk) pairs that are not there; the chunk list is configuration."""
    grid = expected.select(member).distinct().withColumn(chunk, F.explode(F.array(*[F.lit(c) for c in chunks])))
    return grid.join(present.select(member, chunk).distinct(), [member, chunk], "left_anti")


def alignment(spark: SparkSession, registries: dict[str, list[str]]) -> DataFrame:
    """Names known to one configuration registry but not to the others; the registries are configuration, not data."""
    rows = [(reg, name) for reg, names in registries.items() for name in names]
    df = spark.createDataFrame(rows, "registry string, name string")
    seen = df.groupBy("name").agg(F.array_sort(F.collect_set("registry")).alias("have"))
    return seen.where(F.size("have") < len(registries)).select("name", F.array_join("have", ",").alias("present_in"))
