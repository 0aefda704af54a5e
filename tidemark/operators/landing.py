"""Landed payloads (JSON text, nested columns, text lines) to tidy tables.

Every job parses row by row with an explicit schema and explodes; nothing is grouped, so a payload
is never larger than what one source document holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.exprs import period_to_date, to_number


def observations(df: DataFrame, payload: str, names: dict[str, tuple[str, str, str]]) -> DataFrame:
    """{"series_id", "observations": [{"date", "value"}]} to long rows; a value that is no number is
    dropped; name, unit and frequency come from a dictionary."""
    doc = F.from_json(payload, "series_id string, observations array<struct<date:string,value:string>>")
    rows = df.select(doc.alias("d")).select("d.series_id", F.inline("d.observations"))
    rows = rows.select("series_id", F.col("date").try_cast("date").alias("date"), F.col("value").try_cast("double").alias("value")).where("value is not null")
    tag = lambda i: F.coalesce(*[F.when(F.col("series_id") == s, F.lit(t[i])) for s, t in names.items()], F.lit(None))
    return rows.withColumns({"name": tag(0), "unit": tag(1), "frequency": tag(2)})


def melt(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value).where(F.col(value).isNotNull())


CHAIN = "map<string,map<string,array<struct<mark:double,totalVolume:bigint,openInterest:bigint,delta:double>>>>"


def chain_rows(df: DataFrame, payload: str, side: str) -> DataFrame:
    """expiry:days -> strike -> contracts, to one row per contract."""
    a = df.select("symbol", F.explode(F.from_json(payload, CHAIN)).alias("exp", "strikes"))
    b = a.select("symbol", "exp", F.explode("strikes").alias("strike", "contracts"))
    return b.select("symbol", F.lit(side).alias("contract_type"), F.split("exp", ":")[0].cast("date").alias("expiration"), F.split("exp", ":")[1].cast("int").alias("dte"),
                    F.col("strike").cast("double").alias("strike"), F.inline("contracts"))


def parallel_arrays(df: DataFrame, keep: list[str], arrays: list[str]) -> DataFrame:
    return df.select(*keep, F.inline(F.arrays_zip(*arrays)))


def first_match_child(children: Column, match, field: str) -> Column:
    """Field of the first matching child, else of the first child, else NULL."""
    best = F.coalesce(F.get(F.filter(children, match), F.lit(0)), F.get(children, F.lit(0)))
    return best[field]


def rate_pairs(df: DataFrame, payload: str, base: str) -> DataFrame:
    """date -> currency -> rate."""
    a = df.select(F.explode(F.from_json(payload, "map<string,map<string,double>>")).alias("date", "rates"))
    return a.select(F.col("date").cast("date").alias("date"), F.explode("rates").alias("currency", "rate")).withColumn("pair", F.concat_ws("/", F.lit(base), "currency"))


def with_total(df: DataFrame, key: str, name: str, measures: list[str]) -> DataFrame:
    """Rows plus one total row per key.  The total is aggregated with partial combine and unioned."""
    total = df.groupBy(key).agg(*[F.sum(m).alias(m) for m in measures]).withColumn(name, F.lit("_ACCOUNT_TOTAL"))
    return df.select(key, name, *measures).unionByName(total)


# fixed values: consolidated ticker preference, suffix letters of special share classes
CLASS_SUFFIXES = ["W", "R", "U", "M", "N"]


def canonical_ticker(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Preferred ticker per entity: no hyphen, no class suffix, shortest, then alphabetical."""
    t = F.col("ticker")
    suffix = F.right(t, F.lit(1)).isin(CLASS_SUFFIXES) & (F.length(t) > 2)
    best = df.groupBy("cik").agg(F.min(F.struct(t.contains("-").alias("h"), suffix.alias("s"), F.length(t).alias("n"), t.alias("ticker"))).alias("b"))
    out = best.select("cik", F.col("b.ticker").alias("ticker"))
    for cik, ticker in (overrides or {}).items():
        out = out.withColumn("ticker", F.when(F.col("cik") == cik, ticker).otherwise(F.col("ticker")))
    return out


def derived_ohlc(bars: DataFrame) -> DataFrame:
    prev = F.lag("close").over(W.partitionBy("symbol").orderBy("date"))
    return bars.withColumns({"pct_change": F.round(F.col("close") / prev - 1, 6), "log_return": F.round(F.log(F.col("close") / prev), 6),
                             "intraday_change": F.round(F.col("close") - F.col("open"), 4), "intraday_range": F.round(F.col("high") - F.col("low"), 4),
                             "vwap": F.round((F.col("high") + F.col("low") + F.col("close")) / 3, 4)})


# fixed values: form families and the period length that each implies
ANNUAL_FORMS, QUARTERLY_FORMS = ["10-K"], ["10-Q"]
DURATION_DAYS = {"10-Q": (80, 100), "10-K": (340, 380)}


def concept_facts(facts: DataFrame, concepts: dict[str, list[str]]) -> DataFrame:
    """Candidate concepts coalesced per metric: one fact per (metric, entity, start, end, form, accn), the
    earliest candidate winning; durations must fit the form, instants are kept; routed by form."""
    rank = metric = F.lit(None)
    for m, cands in concepts.items():
        for i, c in enumerate(cands):
            metric, rank = F.when(F.col("concept") == c, m).otherwise(metric), F.when(F.col("concept") == c, i).otherwise(rank)
    days, fits = F.datediff("end", "start"), F.lit(True)
    for form, (lo, hi) in DURATION_DAYS.items():
        fits = F.when(F.col("form") == form, days.isNull() | days.between(lo, hi)).otherwise(fits)
    d = facts.withColumns({"metric": metric, "_rank": rank}).where(F.col("metric").isNotNull() & fits)
    key = ["symbol", "metric", "start", "end", "form", "accn"]
    best = d.groupBy(*key).agg(F.min(F.struct("_rank", "concept", "value")).alias("b"))
    route = F.when(F.col("form").isin(ANNUAL_FORMS), "annual").when(F.col("form").isin(QUARTERLY_FORMS), "quarterly")
    return best.select(*key, F.col("b.concept").alias("concept"), F.col("b.value").alias("value"), route.alias("period")).where("period is not null")


def fill_down(lines: DataFrame, file: str, order: str, context: Column, name: str, block: int = 50_000) -> DataFrame:
    """Carry a section value down the lines below it, file by file.  A file is cut into blocks of line
    numbers; the last value of each block is carried over the blocks (few rows) and joined back, so one
    long file is spread over many tasks."""
    d = lines.withColumns({"_c": context, "_b": F.floor(F.col(order) / block)})
    last = d.where(F.col("_c").isNotNull()).groupBy(file, "_b").agg(F.max_by("_c", order).alias("_v"))
    blocks = d.select(file, "_b").distinct().join(last, [file, "_b"], "left")
    earlier = W.partitionBy(file).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = blocks.select(file, "_b", F.last("_v", ignorenulls=True).over(earlier).alias("_carry"))
    inside = W.partitionBy(file, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = d.withColumn("_in", F.last("_c", ignorenulls=True).over(inside)).join(carry, [file, "_b"])
    return out.withColumn(name, F.coalesce("_in", "_carry")).select(*lines.columns, name)


# fixed values: filing keywords, tried in order
FILING_KEYWORDS = {
    "other": ["amendment"],
    "buy": ["purchase", "acquired", "bought", "acquisition"],
    "sell": ["sale", "sold", "disposition", "disposed", "selling"],
    "exercise": ["exercise", "conversion", "vesting", "option"],
    "grant": ["grant", "award", "restricted", "rsu"],
}


def classify_filing(description: Column, form: Column) -> Column:
    d = F.lower(F.coalesce(description, F.lit("")))
    out = F.when(F.upper(F.coalesce(form, F.lit(""))) == "4/A", "other")
    for kind, words in FILING_KEYWORDS.items():
        out = out.when(d.rlike("|".join(words)), kind)
    return out.otherwise("other")


# fixed value: $TICK, or a bare run of two to five capitals
MENTION_PATTERN = r"\$([A-Z]{1,5})\b|(?<![A-Z])([A-Z]{2,5})(?![A-Z])"


def watchlist_mentions(text: Column, watchlist: list[str]) -> Column:
    """Watchlist symbols mentioned in a text, sorted and distinct."""
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + MENTION_PATTERN), F.lit(0))
    names = F.array_distinct(F.transform(hits, lambda h: F.ltrim(h, F.lit("$"))))
    return F.array_sort(F.array_intersect(names, F.array(*[F.lit(w) for w in watchlist])))


def net_positions(df: DataFrame, rename: dict[str, str]) -> DataFrame:
    """Select and rename the columns that are there; net = long - short per trader group."""
    out = df.select(*[F.col(k).alias(v) for k, v in rename.items() if k in df.columns])
    for g in ("noncomm", "comm"):
        if {f"{g}_long", f"{g}_short"} <= set(out.columns):
            out = out.withColumn(f"net_{g}", F.col(f"{g}_long") - F.col(f"{g}_short"))
    return out


def vessel_type(code: Column) -> Column:
    return (F.when(code.isNull(), "unknown").when(code.between(70, 79), "cargo").when(code.between(80, 89), "tanker").when(code.between(60, 69), "passenger")
            .when(code == 30, "fishing").otherwise("other"))


# fixed values: navigational status codes
NAV_STATUS = {0: "under_way_engine", 1: "at_anchor", 2: "not_under_command", 3: "restricted_maneuverability", 4: "constrained_by_draught", 5: "moored",
              6: "aground", 7: "engaged_in_fishing", 8: "under_way_sailing", 15: "not_defined"}


def nav_status(code: Column) -> Column:
    pairs = [F.lit(x) for kv in NAV_STATUS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), code)


def record_feed(df: DataFrame, rename: dict[str, str], numeric: list[str], period: str | None = None, labels: tuple[str, dict[str, str], str] | None = None,
                value: str | None = None) -> DataFrame:
    """The generic feed job: rename, coerce numbers, parse the period, label by dictionary, drop
    rows without a value; columns that are absent are skipped."""
    out = df.select(*[F.col(k).alias(v) for k, v in rename.items() if k in df.columns])
    for c in numeric:
        if c in out.columns:
            out = out.withColumn(c, to_number(c))
    if period:
        out = out.withColumn("date", period_to_date(period))
    if labels:
        src, mapping, dst = labels
        out = out.withColumn(dst, F.coalesce(*[F.when(F.col(src) == k, F.lit(v)) for k, v in mapping.items()], F.lit(None)))
    return out.where(F.col(value).isNotNull()) if value else out


def two_buckets(df: DataFrame, keep: list[str], buckets: dict[str, str], tag: str) -> DataFrame:
    """Several record arrays of one document to rows tagged by bucket, in one pass."""
    def labelled(c, t):
        return F.transform(F.coalesce(F.col(c), F.array()), lambda x: F.struct(F.lit(t).alias(tag), x.alias("rec")))
    tagged = F.flatten(F.array(*[labelled(c, t) for c, t in buckets.items()]))
    return df.select(*keep, F.explode(tagged).alias("e")).select(*keep, f"e.{tag}", "e.rec.*")


def dated_measures(df: DataFrame, payload: str) -> DataFrame:
    """date -> measure -> text value."""
    a = df.select("symbol", F.explode(F.from_json(payload, "map<string,map<string,string>>")).alias("date", "m"))
    return a.select("symbol", F.col("date").try_cast("date").alias("date"), F.explode("m").alias("indicator", "raw")).withColumn("value", F.col("raw").try_cast("double"))


def epoch_day(c: str, unit: str) -> Column:
    ts = F.timestamp_millis(F.col(c)) if unit == "ms" else F.timestamp_seconds(F.col(c))
    return F.to_date(ts)


def ranked_array(df: DataFrame, keep: list[str], arr: str, rank: str) -> DataFrame:
    return df.select(*keep, F.posexplode(arr).alias("_p", "e")).select(*keep, (F.col("_p") + 1).alias(rank), "e.*")


def transaction_legs(df: DataFrame, legs: str) -> DataFrame:
    """Last leg with a non-currency instrument; absolute costs of the fee legs that are not one."""
    priced = lambda x: x["asset_type"].isNotNull() & (x["asset_type"] != "CURRENCY") & x["symbol"].isNotNull()
    leg = F.try_element_at(F.filter(legs, priced), F.lit(-1))
    fees = F.aggregate(F.filter(legs, lambda x: x["fee_type"].isNotNull() & ~F.coalesce(priced(x), F.lit(False))), F.lit(0.0), lambda a, x: a + F.abs(F.coalesce(x["cost"], F.lit(0.0))))
    return df.withColumns({"leg_symbol": leg["symbol"], "quantity": leg["amount"], "price": leg["price"], "fees": F.nullif(F.round(fees, 4), F.lit(0.0))})


def flatten(df: DataFrame, payload: str, schema: str, fields: dict[str, str]) -> DataFrame:
    """Nested document to one wide row; an absent branch gives NULLs."""
    d = df.withColumn("_d", F.from_json(payload, schema))
    return d.select(*[c for c in df.columns if c != payload], *[F.col(f"_d.{path}").alias(name) for name, path in fields.items()])


def stamp_symbol(rows: DataFrame, request_symbol: str, rename: dict[str, str]) -> DataFrame:
    """Payload rows get the requested symbol where they carry none, then alias names."""
    out = rows.withColumn("symbol", F.coalesce(F.col("symbol"), F.col(request_symbol))).drop(request_symbol)
    return out.withColumnsRenamed(rename)


def metric_dictionary(df: DataFrame, concept_lists: str, name: str) -> DataFrame:
    return df.select(name, F.array_join(F.array_sort(F.array_distinct(concept_lists)), ",").alias("concepts"), F.size(F.array_distinct(concept_lists)).alias("n_concepts"))


def broad_universe(holdings: DataFrame, n: int, extras: list, fallback: DataFrame | None = None) -> DataFrame:
    """The n largest holdings of a fund plus listed extras, distinct; where the fund has none, the fallback list (ticker)
    instead of them.  Null tickers are left out."""
    top = holdings.where("ticker IS NOT NULL").orderBy(F.desc("market_value"), "ticker").limit(n).select("ticker")
    extra = holdings.sparkSession.createDataFrame([(e,) for e in extras], top.schema)
    if fallback is not None:
        none = holdings.where("ticker IS NOT NULL").limit(1).agg(F.count("*").alias("_n")).where("_n = 0")  # one row, or none
        top = top.unionByName(fallback.select(F.col("ticker").cast(top.schema["ticker"].dataType).alias("ticker")).withColumn("_n", F.lit(0).cast("bigint")).join(none, "_n", "left_semi").select("ticker"))
    return top.unionByName(extra).distinct()
