"""Set operations, ordered positions and ranks that survive a hot group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return (a.subtract(b).withColumn("side", F.lit("left_only"))
            .unionByName(b.subtract(a).withColumn("side", F.lit("right_only"))))


def value_bucket(v: Column) -> Column:
    """A pure monotone function double -> bigint that cuts any magnitude range into many
    buckets, an eight-thousandth of a value wide.  Pure, so every recomputation (a lost executor, a second
    branch) agrees.  The infinities fall into the outermost buckets; NaN has none and is to be left out."""
    v = v.cast("double")
    return (F.signum(v) * F.floor(F.log1p(F.least(F.abs(v), F.lit(1e300)) * 1e6) * 8192)).cast("bigint")


def number(v: Column) -> Column:
    """Neither NULL nor NaN."""
    return v.isNotNull() & ~F.isnan(v.cast("double"))


def tie_bucket(df: DataFrame, tie: str) -> Column:
    """A pure monotone bucket of the tie-break column: so equal values, however many, are split as well."""
    kind = df.schema[tie].dataType.typeName()
    c = F.col(tie)
    if kind in ("string", "varchar", "char"):
        return F.coalesce(F.substring(c, 1, 4), F.lit(""))
    return F.coalesce(F.unix_date(c).cast("bigint") if kind == "date" else value_bucket(c), F.lit(-(1 << 62)))


def _offsets(counts: DataFrame, group: list[str]) -> DataFrame:
    """Rows before each bucket; input has one row per (group, bucket), a bounded number."""
    w = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))


#: Rows of a group that one task sorts; larger groups are cut by value.
SORTED_ROWS = 1_000_000


def by_size(df: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of groups up to SORTED_ROWS rows, and those of larger ones.  The list of large groups has at most one row per
    SORTED_ROWS rows, so it is broadcast and no row is dealt by a group that one task would have to read; the second part is
    dropped at run time where no group is that large."""
    large = F.broadcast(df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > SORTED_ROWS).select(*group))
    return df.join(large, group, "left_anti").where(reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group])), df.join(large, group, "left_semi")


def position_within(df: DataFrame, group: list[str], value: str, tie: str, out: str, descending: bool = False) -> DataFrame:
    """1-based position by (value, tie) inside each group, NULL and NaN values excluded, plus the group
    size as ``<out>_of``.  Groups up to SORTED_ROWS rows are sorted by a window, larger ones cut by value."""
    v = -F.col(value) if descending else F.col(value)
    sorted_, cut = by_size(df.where(number(F.col(value))).withColumn("_v", v.cast("double")), group)
    w = W.partitionBy(*group)
    ranked = sorted_.withColumns({out: F.row_number().over(w.orderBy("_v", tie)).cast("bigint"), out + "_of": F.count("*").over(w)}).drop("_v")
    return ranked.unionByName(_position_cut(cut, group, tie, out).select(*ranked.columns))


def _position_cut(df: DataFrame, group: list[str], tie: str, out: str) -> DataFrame:
    """Positions by (_v, tie).  Rows are counted per value and tie bucket first; only rows of one value and one
    tie bucket are sorted in one task, so one group and one value may hold any share of the rows."""
    keyed = df.withColumns({"_b": value_bucket(F.col("_v")), "_t": tie_bucket(df, tie)})
    cell = [*group, "_b", "_v", "_t"]
    counts = keyed.groupBy(*cell).agg(F.count("*").alias("_n"))
    per = _offsets(counts.groupBy(*group, "_b").agg(F.sum("_n").alias("_n")), group)
    per = per.withColumn("_of", F.sum("_n").over(W.partitionBy(*group))).drop("_n")
    inside = W.partitionBy(*group, "_b").orderBy("_v", "_t").rowsBetween(W.unboundedPreceding, -1)
    before = (counts.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(per, [*group, "_b"])
              .withColumn("_before", F.col("_before") + F.col("_in")).drop("_n", "_in"))
    w = W.partitionBy(*cell).orderBy(tie)
    return (keyed.join(before, cell).withColumn(out, (F.row_number().over(w) + F.col("_before")).cast("bigint"))
            .withColumn(out + "_of", F.col("_of")).drop("_v", "_b", "_t", "_before", "_of"))


def rank_table(df: DataFrame, group: list[str], value: str, out: str, counted: bool = False) -> DataFrame:
    """(group, value, rank) with ties averaged.  Equal values are collapsed to one counted row before any
    ordering, and ordering is per value bucket, so neither a hot group nor a hot value meets in one task."""
    v = F.col(value)
    distinct = (df.where(number(v)).groupBy(*group, v.alias(value)).agg(F.count("*").alias("_c"))
                .withColumn("_b", value_bucket(v)))
    before = _offsets(distinct.groupBy(*group, "_b").agg(F.sum("_c").alias("_n")), group).drop("_n")
    w = W.partitionBy(*group, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (distinct.join(before, [*group, "_b"])
            .withColumn(out, F.col("_before") + F.coalesce(F.sum("_c").over(w), F.lit(0)) + (F.col("_c") + 1) / 2.0)
            .select(*group, value, out, *["_c"] * counted))


def average_rank(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Rank with ties averaged (for Spearman), joined back to the rows by (group, value)."""
    return df.join(rank_table(df, group, value, out), [*group, value])


def average_ranks(df: DataFrame, group: list[str], values: dict[str, str]) -> DataFrame:
    """Several ranks at once, NULL and NaN values excluded.  Groups up to SORTED_ROWS rows are ranked by windows of one shuffle;
    larger ones are cut by value."""
    rows = df.where(reduce(lambda a, b: a & b, [number(F.col(v)) for v in values]))
    if not group:
        return _ranks_cut(rows, group, values)
    sorted_, cut = by_size(rows, group)
    ranked = calendar_ranks(sorted_, group, values)
    return ranked.unionByName(_ranks_cut(cut, group, values).select(*ranked.columns))


def _ranks_cut(df: DataFrame, group: list[str], values: dict[str, str]) -> DataFrame:
    """Ranks of large groups: rows are dealt once a value, by value bucket, and ranked there by a window behind the rows of the
    buckets before.  Buckets over SORTED_ROWS rows (a hot value) are ranked from counted distinct values instead."""
    # the same filter everywhere, so that the counts of a value are made once
    df = df.where(reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group], F.lit(True)))
    out, cell = df, [*group, "_cell"]
    for value, name in values.items():
        b = value_bucket(F.col(value))
        counts = df.groupBy(*group, b.alias("_b")).agg(F.count("*").alias("_n"))
        before = _offsets(counts, group).select(*group, F.col("_b").alias("_cell"), "_before")
        crowded = F.broadcast(counts.where(F.col("_n") > SORTED_ROWS).select(*group, F.col("_b").alias("_cell")))
        keyed = out.withColumn("_cell", b)
        place = (F.col("_before") + F.col("_in")).alias(name)
        ranked = calendar_ranks(keyed.join(crowded, cell, "left_anti").join(before, cell), cell, {value: "_in"}).select(*out.columns, place)
        hot = df.withColumn("_cell", b).join(crowded, cell, "left_semi")
        table = rank_table(hot, cell, value, "_in").join(before, cell).select(*cell, value, place)
        out = ranked.unionByName(keyed.join(crowded, cell, "left_semi").join(table, [*cell, value]).select(*out.columns, name))
    return out


def calendar_ranks(df: DataFrame, group: list[str], values: dict[str, str]) -> DataFrame:
    """Average ranks by plain windows, for groups that have at most one row per calendar day: one shuffle
    by group instead of the bucketed joins."""
    out = df
    for value, name in values.items():
        v = F.col(value)
        ties = F.count("*").over(W.partitionBy(*group, value))
        out = out.withColumn(name, F.rank().over(W.partitionBy(*group).orderBy(v)) + (ties - 1) / 2.0)
    return out


def exact_quantile(df: DataFrame, group: list[str], value: str, q: float, out: str) -> DataFrame:
    """(group, quantile) with linear interpolation, from counted distinct values: the percentile
    aggregate keeps all values of a group in one buffer, this keeps two rows of it."""
    keys = group or ["_all"]
    rows = df.select(*group, value) if group else df.select(F.lit(0).alias("_all"), value)
    ranks = rank_table(rows, keys, value, "_r", counted=True)  # equal values are one row, whatever their number
    sizes = ranks.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    d = ranks.join(sizes, keys).withColumn("_at", 1 + q * (F.col("_n") - 1))
    first, last = F.col("_r") - (F.col("_c") - 1) / 2.0, F.col("_r") + (F.col("_c") - 1) / 2.0
    low, high = F.floor("_at"), F.floor("_at") + 1
    at = lambda p: F.max(F.when((first <= p) & (p <= last), F.col(value)))
    near = d.where((first <= high) & (low <= last))
    lo, hi = at(low), at(high)
    return near.groupBy(*keys).agg((lo + F.coalesce((hi - lo) * F.max(F.col("_at") - low), F.lit(0.0))).alias(out)).select(*group, out)
