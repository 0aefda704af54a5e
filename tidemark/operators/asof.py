"""As-of and trailing-range joins.

Neither is planned as a join: both sides are unioned on one time axis and read with windows, so
there is one shuffle and no pair explosion.  The general as-of join also cuts every key by a time
bucket and carries the last right row of earlier buckets over, so that a key holding a third of
all rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

_R, _L = 1, 2  # side order at equal time: right rows first when equality matches


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str],
              *, forward: bool = False, strict: bool = False, split: str | None = "quarter", repeated: bool = False) -> DataFrame:
    """Every left row with the nearest right row at or before it (``forward``: at or after it;
    ``strict``: equality does not match), NULLs when there is none.

    ``right`` has one row per (by, right_on).  Output columns: those of left, then ``values``.  A NULL key matches
    nothing.  ``repeated``: left may have any number of rows per (by, left_on); its distinct pairs are matched and the rows
    joined back, so no pair is sorted with all its rows.  On dates the pairs and the right rows of a key are bounded by the
    calendar, so they are not cut by time bucket: one shuffle by key.
    """
    if repeated:
        points = left.select(*by, left_on).distinct()
        if points.schema[left_on].dataType == right.schema[right_on].dataType == T.DateType():
            split = None
        hits = asof_join(points, right, by, left_on, right_on, values, forward=forward, strict=strict, split=split)
        hits = hits.where(reduce(and_, (F.col(c).isNotNull() for c in [*by, left_on])))
        plain = [left[c] == hits[c] for c in [*by, left_on]]
        return left.join(hits, plain, "left").select(*(left[c] for c in left.columns), *(hits[v] for v in values))
    nothing = reduce(or_, (F.col(b).isNull() for b in by))
    alone = left.where(nothing).select(*left.columns, *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values))
    left, right = left.where(~nothing), right.where(~nothing)
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"value columns {sorted(clash)} exist on the left side")
    ltype = left.select(F.struct(*left.columns).alias("_l")).schema["_l"].dataType
    vals = F.struct(*[F.col(v) for v in values])
    rtype = right.select(vals.alias("_r")).schema["_r"].dataType
    L = left.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col(left_on).alias("_t"), F.lit(_L).alias("_side"),
                    F.struct(*left.columns).alias("_l"), F.lit(None).cast(rtype).alias("_r"))
    R = right.where(F.col(right_on).isNotNull()).select(
        *[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col(right_on).alias("_t"),
        F.lit(_L + 1 if strict else _R).alias("_side"), F.lit(None).cast(ltype).alias("_l"), vals.alias("_r"))
    keys = [f"_k{i}" for i in range(len(by))]
    rows = L.unionByName(R)
    time = (F.col("_t").desc_nulls_first() if forward else F.col("_t").asc_nulls_first())
    part = keys
    if split:
        rows = rows.withColumn("_b", F.date_trunc(split, F.col("_t").cast("timestamp_ntz")))
        bucket = F.col("_b").desc_nulls_first() if forward else F.col("_b").asc_nulls_first()
        pick = F.min_by if forward else F.max_by
        last = rows.groupBy(*keys, "_b").agg(pick("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).alias("_c"),
                                             F.first(F.lit(_R)).alias("_side"))
        earlier = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
        carried = (last.withColumn("_r", F.last("_c", ignorenulls=True).over(earlier)).where(F.col("_r").isNotNull())
                   .select(*keys, F.lit(None).cast(rows.schema["_t"].dataType).alias("_t"), F.lit(0).alias("_side"),
                           F.lit(None).cast(ltype).alias("_l"), "_r", "_b"))
        rows = rows.unionByName(carried)
        part = [*keys, "_b"]
    w = W.partitionBy(*part).orderBy(time, F.col("_side")).rowsBetween(W.unboundedPreceding, 0)
    hit = rows.withColumn("_hit", F.last("_r", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
    return hit.select("_l.*", *[F.col("_hit")[v].alias(v) for v in values]).unionByName(alone)


def trailing_range_agg(panel: DataFrame, events: DataFrame, by: str, date: str, event_date: Column | str,
                       sums: dict[str, Column], days: int, counts: dict[str, Column] | None = None,
                       means: dict[str, Column] | None = None) -> DataFrame:
    """Per panel row, aggregates of the events with date in (row date - days, row date].

    Events are combined per (key, day) before the shuffle; then a range window over day numbers
    reads them.  A row without events, or without a key, gets NULL sums and means and zero counts."""
    counts, means = counts or {}, means or {}
    ed = F.col(event_date) if isinstance(event_date, str) else event_date
    aggs = [F.sum(c).alias(f"_s_{n}") for n, c in {**sums, **means}.items()] + [F.count(c).alias(f"_n_{n}") for n, c in {**counts, **means}.items()]
    daily = events.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("_k"), ed.alias("_d")).agg(*aggs)
    base = panel.where(F.col(by).isNotNull()).select(F.col(by).alias("_k"), F.col(date).alias("_d"), F.struct(*panel.columns).alias("_l"))
    w = W.partitionBy("_k").orderBy("_day").rangeBetween(-(days - 1), 0)
    rows = base.unionByName(daily, allowMissingColumns=True).withColumn("_day", F.unix_date("_d"))
    for n in [*sums, *means]:
        rows = rows.withColumn(f"_ws_{n}", F.sum(f"_s_{n}").over(w))
    for n in [*counts, *means]:
        rows = rows.withColumn(f"_wn_{n}", F.sum(f"_n_{n}").over(w))
    out = rows.where(F.col("_l").isNotNull()).select(
        "_l.*", *[F.col(f"_ws_{n}").alias(n) for n in sums],
        *[(F.col(f"_ws_{n}") / F.when(F.col(f"_wn_{n}") > 0, F.col(f"_wn_{n}"))).alias(n) for n in means],
        *[F.coalesce(F.col(f"_wn_{n}"), F.lit(0)).alias(n) for n in counts])
    keyless = panel.where(F.col(by).isNull())
    return out.unionByName(keyless.select(*keyless.columns, *[F.lit(0 if n in counts else None).cast(out.schema[n].dataType).alias(n) for n in [*sums, *means, *counts]]))


def latest_period_facts(facts: DataFrame, metrics: list[str], form: str | None = None) -> DataFrame:
    """One wide row per (symbol, filed): per metric the value of the newest period in the filing
    (ties: highest accession).  One conditional aggregate replaces one scan per metric."""
    if form:
        facts = facts.where(F.col("form") == form)
    order = F.struct("period_end", "accn")
    return facts.where(F.col("filed").isNotNull()).groupBy("symbol", "filed").agg(
        *[F.max_by("value", F.when(F.col("metric") == m, order)).alias(m) for m in metrics])


def asof_columns(left: DataFrame, wide: DataFrame, by: str, left_on: str, right_on: str, columns: list[str]) -> DataFrame:
    """As-of join where each column has its own latest non-NULL row: forward fill the wide side per
    key first (one row per filing day, bounded by the calendar), then one as-of join for all."""
    w = W.partitionBy(by).orderBy(right_on).rowsBetween(W.unboundedPreceding, 0)
    filled = wide.select(by, right_on, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns])
    return asof_join(left, filled, [by], left_on, right_on, columns)


def broadcast_by_date(panel: DataFrame, series: DataFrame, series_ids: list[str], date: str = "date") -> DataFrame:
    """Macro values as of each panel date.  Series are pivoted to one row per day, filled forward over
    all days that either side has (a calendar-sized table) and joined by date; the optimizer
    broadcasts the filled table only when its measured size allows."""
    wide = series.groupBy("date").agg(*[F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(s) for s in series_ids])
    days = panel.select(F.col(date).alias("date")).distinct()
    # calendar-sized: one row per day of the whole data set, whatever the number of rows per day
    w = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    filled = (days.join(wide, "date", "full").select("date", *[F.last(s, ignorenulls=True).over(w).alias(s) for s in series_ids]))
    return panel.join(filled.withColumnRenamed("date", date), date, "left")
