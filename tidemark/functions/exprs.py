"""Column builders: null-safe arithmetic, labels, dates, dirty numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a/b where b > 0, else NULL."""
    return F.when(col_of(b) > 0, col_of(a) / col_of(b))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a/b with a zero denominator as NULL."""
    return F.when(col_of(b) != 0, col_of(a) / col_of(b))


def clip(c: Column | str, lo: float, hi: float) -> Column:
    c = col_of(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column: apply once where data enters."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def null_safe_mean(cols: list[Column]) -> Column:
    """Mean over the columns of a row, skipping NULLs; NULL when all are."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(count > 0, total / count)


def business_day_shift(d: Column | str, n: int) -> Column:
    """n >= 0 weekdays after d; a weekend start counts from the Friday before; n = 0 keeps d."""
    d = col_of(d)
    if n == 0:
        return d
    wd = F.least(F.weekday(d), F.lit(4))
    start = F.date_sub(d, F.weekday(d) - wd)
    return F.date_add(start, (F.lit(n) + 2 * F.floor((wd + n) / 5)).cast("int"))


# fixed values: the period notations that statistical feeds use
PERIOD_PATTERNS = {
    "quarter": r"^(\d{4})-?Q([1-4])$",
    "month_compact": r"^(\d{4})(0[1-9]|1[0-2])$",
    "month_dash": r"^(\d{4})-(0[1-9]|1[0-2])$",
    "month_m": r"^(\d{4})-?M(0[1-9]|1[0-2])$",
    "quarter_coded": r"^(\d{4})-?Q0([1-4])$",
    "year": r"^(\d{4})(?:-?A01)?$",
}


def period_to_date(s: Column | str) -> Column:
    """First day of a period string; M13 (annual average) and anything else is NULL."""
    s = col_of(s)
    out = F.lit(None).cast("date")
    for kind, pat in PERIOD_PATTERNS.items():
        year = F.regexp_extract(s, pat, 1).try_cast("int")
        part = F.regexp_extract(s, pat, 2).try_cast("int") if kind != "year" else F.lit(1)
        month = (part - 1) * 3 + 1 if kind.startswith("quarter") else part
        out = F.when(s.rlike(pat), F.make_date(year, month, F.lit(1))).otherwise(out)
    return out


def to_number(s: Column | str) -> Column:
    """Strip %, $ and thousands commas; anything else that is not a number is NULL."""
    return F.trim(F.regexp_replace(col_of(s), r"[%,$]", "")).try_cast("double")


def label_by_floor(x: Column | str, steps: list[tuple[float, bool, str]], last: str, missing: str | None = None) -> Column:
    """First label whose threshold x reaches: (threshold, inclusive, label), from the top."""
    x = col_of(x)
    out = F.when(x.isNull(), F.lit(missing))
    for threshold, inclusive, name in steps:
        out = out.when((x >= threshold) if inclusive else (x > threshold), name)
    return out.otherwise(last)


def vendor_rating_label(x) -> Column:
    """Labels with closed lower edges on the buy side."""
    return label_by_floor(x, [(0.5, True, "strong_buy"), (0.1, True, "buy"), (-0.1, False, "neutral"), (-0.5, False, "sell")],
                          "strong_sell", "unknown")


def rating_bin(x) -> Column:
    """Right-closed bins of the computed rating."""
    x = col_of(x)
    return F.when((x <= -1.01) | (x > 1.01), F.lit(None)).otherwise(
        label_by_floor(x, [(0.5, False, "strong_buy"), (0.1, False, "buy"), (-0.1, False, "neutral"), (-0.5, False, "sell")],
                       "strong_sell"))


def significance_tier(p) -> Column:
    p = col_of(p)
    return F.when(p.isNull(), "n/a").when(p < 0.01, "significant").when(p < 0.05, "weak").otherwise("noise")


def hash_share(key: Column | str, buckets: int = 4) -> Column:
    """sha256(key) modulo a bucket count dividing 256: the last byte decides."""
    if 256 % buckets:
        raise ValueError("bucket count must divide 256")
    return (F.conv(F.right(F.sha2(col_of(key).cast("string"), 256), F.lit(2)), 16, 10).cast("int") % buckets)


def fingerprint(symbols: Column) -> Column:
    """First 12 hex digits of sha256 over the sorted upper-cased list (an aggregate)."""
    return F.substring(F.sha2(F.concat_ws(",", F.array_sort(F.collect_set(F.upper(symbols)))), 256), 1, 12)


def snake_case(name: str) -> str:
    import re
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", name.strip().lower().replace("%", "pct"))).strip("_")
