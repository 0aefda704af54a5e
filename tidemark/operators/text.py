"""Text operators on headlines and articles: topics, lexicon sentiment, entity mentions, relevance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: topic tag -> pattern (case-insensitive), in tag order
TOPIC_PATTERNS = {
    "earnings": r"\bearnings?\b|\beps\b|\bquarterly results?\b|\bq[1-4]\b",
    "guidance": r"\bguidance\b|\boutlook\b|\bforecasts?\b",
    "analyst": r"\banalysts?\b|\bupgrade[ds]?\b|\bdowngrade[ds]?\b|\bprice target\b|\brating\b",
    "merger": r"\bmergers?\b|\bacquisitions?\b|\bacquires?\b|\btakeovers?\b|\bbuyout\b|\bdeal\b",
    "dividend": r"\bdividends?\b|\bpayout\b",
    "buyback": r"\bbuybacks?\b|\brepurchase\b",
    "legal": r"\blawsuits?\b|\bsettlement\b|\bsues?\b|\blitigation\b|\bprobe\b|\binvestigation\b",
    "regulation": r"\bsec\b|\bftc\b|\bdoj\b|\bregulat|\bantitrust\b|\btariffs?\b",
    "insider": r"\binsiders?\b|\bceo\b|\bcfo\b|\bexecutives?\b|\bresigns?\b|\bappoints?\b",
    "product": r"\blaunch(es)?\b|\bunveils?\b|\bproducts?\b|\bpatents?\b",
    "contract": r"\bcontracts?\b|\bpartnership\b|\bcollaborat|\bagreements?\b",
    "macro": r"\bfed\b|\binflation\b|\brates?\b|\brecession\b|\bgdp\b",
    "debt": r"\bdebt\b|\bbonds?\b|\bnotes offering\b|\brefinanc",
    "ai": r"\bai\b|\bartificial intelligence\b|\bmachine learning\b",
    "short": r"\bshort sellers?\b|\bshort interest\b|\bsqueeze\b",
    "bankruptcy": r"\bbankruptcy\b|\bchapter 11\b|\bdefault\b|\bdelisting\b",
    "workforce": r"\blayoffs?\b|\bjob cuts\b|\bhiring\b|\brestructuring\b",
}


def tag_list(text: Column, patterns: dict[str, str]) -> Column:
    """All tags whose pattern occurs, in dictionary order.  (?U) makes word boundaries Unicode-aware, so an
    accented letter next to a word is part of the word."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?iU)" + p), t) for t, p in patterns.items()]))


def topic_tags(text: Column) -> Column:
    return tag_list(text, TOPIC_PATTERNS)


# --- lexicon sentiment -----------------------------------------------------------------------

# fixed values: label cuts, part weights and the squash constant
BULLISH_FROM, BEARISH_FROM = 0.10, -0.10
HEADLINE_WEIGHT, SUMMARY_WEIGHT = 0.7, 0.3
SQUASH = 15.0

# fixed values: finance words and their valence
FINANCE_LEXICON = {
    "beat": 2.0, "beats": 2.0, "exceeds": 2.0, "tops": 1.8, "outperform": 2.0, "outperforms": 2.0, "upgrade": 2.5, "upgraded": 2.5, "upgrades": 2.5,
    "overweight": 1.5, "surge": 2.5, "surges": 2.5, "soar": 3.0, "soars": 3.0, "rally": 2.0, "rallies": 2.0, "jumps": 2.0, "climbs": 1.5, "gains": 1.5,
    "bullish": 2.5, "buyback": 1.5, "dividend": 1.0, "profitable": 1.8, "breakout": 1.5, "raises": 1.5, "raised": 1.5, "record": 1.2, "beat-and-raise": 3.0, "accretive": 1.5,
    "miss": -2.0, "misses": -2.0, "missed": -2.0, "shortfall": -2.0, "downgrade": -2.5, "downgraded": -2.5, "downgrades": -2.5, "underperform": -2.0, "underweight": -1.5,
    "plunge": -3.0, "plunges": -3.0, "tumble": -2.5, "tumbles": -2.5, "slump": -2.2, "slumps": -2.2, "sinks": -2.2, "slides": -1.8, "drops": -1.8, "falls": -1.5,
    "bearish": -2.5, "selloff": -2.5, "sell-off": -2.5, "lawsuit": -2.0, "probe": -2.0, "investigation": -2.0, "subpoena": -2.5, "recall": -2.0, "bankruptcy": -3.5, "default": -2.5,
    "layoffs": -2.0, "warns": -2.0, "warning": -1.8, "fraud": -3.0, "halted": -2.0, "delisting": -3.0, "dilution": -1.8, "dilutive": -1.8, "writedown": -2.0, "impairment": -2.0,
    "cuts": -1.5, "slashes": -2.2, "weak": -1.5, "weakness": -1.5,
}
WORD = r"\p{L}[\p{L}'-]*"


def score_texts(texts: DataFrame, key: str, parts: dict[str, str], lexicon: DataFrame) -> DataFrame:
    """Valence per text part from a lexicon table (word, valence).

    Words meet the lexicon, a broadcast word list, where the text is read; a task adds the words of a text up before
    anything moves, so one row a text part is dealt and no row a word; whole texts are read."""
    words = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(WORD), F.lit(0)).alias("w")) for p, c in parts.items()]))
    hit = texts.select(key, words.alias("p")).select(key, "p.part", F.explode("p.w").alias("word")).join(F.broadcast(lexicon), "word", "left")
    return hit.groupBy(key, "part").agg(F.coalesce(F.sum("valence"), F.lit(0.0)).alias("valence"), F.count("*").alias("words"), F.count("valence").alias("hits"))


def article_sentiment(texts: DataFrame, key: str, headline: str, summary: str, lexicon: DataFrame) -> DataFrame:
    """Score in (-1, 1), label and confidence; the headline weighs 0.7 when there is a summary."""
    per = score_texts(texts, key, {"h": headline, "s": summary}, lexicon)
    at = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c)))
    wide = per.groupBy(key).agg(*[at(p, c).alias(f"_{p}{c}") for p in "hs" for c in ("valence", "words", "hits")])
    d = texts.select(key).join(wide, key, "left")
    squash = lambda p: F.coalesce(F.col(f"_{p}valence") / F.sqrt(F.col(f"_{p}valence") * F.col(f"_{p}valence") + SQUASH), F.lit(0.0))
    neutral = lambda p: F.coalesce(1 - F.col(f"_{p}hits") / F.col(f"_{p}words"), F.lit(1.0))
    mix = lambda f: F.when(F.col("_swords") > 0, HEADLINE_WEIGHT * f("h") + SUMMARY_WEIGHT * f("s")).otherwise(f("h"))
    # labels are cut on nine digits, so that the order of a float sum cannot decide them
    d = d.withColumns({"score": F.round(mix(squash), 9), "neutral": mix(neutral)})
    label = F.when(F.col("score") >= BULLISH_FROM, "bullish").when(F.col("score") <= BEARISH_FROM, "bearish").otherwise("neutral")
    conf = F.when(label == "neutral", F.col("neutral")).otherwise(F.least(F.lit(1.0), (1 - F.col("neutral")) * 0.5 + F.abs("score") * 0.5))
    return d.select(key, "score", label.alias("sentiment"), conf.alias("confidence"))


def unseen_headlines(articles: DataFrame, cache: DataFrame, headline: str) -> DataFrame:
    """Distinct headlines that were not scored before."""
    return articles.select(headline).where(F.col(headline).isNotNull()).distinct().join(cache.select(headline).distinct(), headline, "left_anti")


# --- entity mentions and relevance -----------------------------------------------------------

# fixed values: legal suffix of a company name, cashtag and exchange forms
NAME_SUFFIX = r"(?i)\s+(inc|corp|co|companies|company|corporation|group|international|holdings?)\.?$"
CASHTAG = r"\$([A-Z]{1,5})\b"
EXCHANGE_FORM = r"(?i)\((?:NYSE|NASDAQ|AMEX|CBOE)\s*:\s*([A-Z]{1,5}(?:\.[A-Z])?)\)"


def alias_dictionary(names: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """(symbol, alias) rows: the name, the name without its legal suffix, again without, and manual
    ones; distinct ignoring case."""
    strip = lambda c: F.trim(F.regexp_replace(c, NAME_SUFFIX, ""))
    once = strip(F.col("name"))
    rows = names.where("name <> ''").select("symbol", F.explode(F.array(F.col("name"), once, strip(once))).alias("alias"))
    if manual is not None:
        rows = rows.unionByName(manual.select("symbol", "alias"))
    return rows.where("alias <> ''").groupBy("symbol", F.lower("alias").alias("_l")).agg(F.min("alias").alias("alias")).drop("_l")


SEGMENT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
#: A word, and a word with the gap and the word that follow it (the match itself is the word, so pairs overlap).
HEAD_WORD = r"[\p{L}\p{N}_]++"
HEAD_PAIR = r"(?<![\p{L}\p{N}_])(?=([\p{L}\p{N}_]++[^\p{L}\p{N}_]++[\p{L}\p{N}_]++))[\p{L}\p{N}_]++"
BEFORE, AFTER = r"(?<![\p{L}\p{N}_$])", r"(?![\p{L}\p{N}_])"


def mentions(texts: DataFrame, key: str, col: str, aliases: DataFrame) -> DataFrame:
    """(key, symbol) for texts that hold an alias between word boundaries (case-insensitive), a cashtag
    or an exchange form of a known symbol; bare tickers do not count.

    An alias is looked up by its head, its first word or its first two words with the gap between them; texts offer their
    distinct words and word pairs, so heads meet in an equi join and there are no text x alias pairs.  The whole alias,
    however long, is then verified in the text of the candidate."""
    pieces = lambda c: F.regexp_extract_all(c, F.lit(SEGMENT), F.lit(0))
    starts_in_word = lambda p: F.get(p, F.lit(0)).rlike(r"^[\p{L}\p{N}_]")
    al = aliases.select(F.col("symbol").cast("string").alias("symbol"), F.lower("alias").alias("alias")).where("alias <> ''").distinct()
    body = F.when(starts_in_word(F.col("_p")), F.col("_p")).otherwise(F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))))
    al = al.withColumn("_p", pieces(F.col("alias"))).withColumn("_p", body).withColumn(
        "head", F.when(F.size("_p") >= 3, F.array_join(F.slice("_p", 1, 3), "")).otherwise(F.get("_p", F.lit(0)))).where("head is not null").drop("_p")
    low = texts.select(key, F.lower(F.coalesce(F.col(col), F.lit(""))).alias("text"))
    found = lambda p, g: F.regexp_extract_all("text", F.lit(p), F.lit(g))
    heads = low.select(key, F.explode(F.array_distinct(F.concat(found(HEAD_WORD, 0), found(HEAD_PAIR, 1)))).alias("head"))
    asked = heads.join(al, "head").select(key, "symbol", "alias").distinct()
    quoted = F.concat(F.lit(BEFORE + r"\Q"), F.replace("alias", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E" + AFTER))
    by_name = asked.join(low, key).where(F.contains("text", "alias") & F.regexp_like("text", quoted)).select(key, "symbol")
    forms = F.explode(F.transform(F.concat(F.regexp_extract_all(F.coalesce(F.col(col), F.lit("")), F.lit(CASHTAG), F.lit(1)), F.regexp_extract_all(F.coalesce(F.col(col), F.lit("")), F.lit(EXCHANGE_FORM), F.lit(1))), lambda x: F.upper(x)))
    by_form = texts.select(key, forms.alias("symbol")).join(al.select("symbol").distinct(), "symbol", "left_semi").select(key, "symbol")
    return by_name.unionByName(by_form).distinct()


# fixed values: driver -> topic pattern
DRIVER_PATTERNS = {
    "oil": r"\b(crude|oil price|oil prices|opec|wti|brent|petroleum|oil output|oil supply|oil demand)\b",
    "natgas": r"\b(natural gas|lng|nat gas)\b",
    "gasoline": r"\b(gasoline|pump price|fuel price)\b",
    "gold": r"\bgold (price|prices|futures|rally|slump)|price of gold\b",
    "copper": r"\bcopper\b",
    "silver": r"\bsilver (price|prices|futures)\b",
    "wheat": r"\bwheat\b",
    "corn": r"\bcorn (price|prices|futures|crop)\b",
    "soybeans": r"\bsoybeans?\b",
    "t10y": r"\b(treasury yield|10-year|ten-year|bond yield|interest rate|rate (hike|cut|hikes|cuts)|fed funds|federal reserve|fomc)\b",
    "eur": r"\b(dollar (strength|weakness|rally|slide)|weaker dollar|stronger dollar|dxy|euro)\b",
    "vix": r"\b(volatility|vix|market turmoil|market selloff)\b",
}
# fixed values: relevance of direct mentions, cap of indirect ones, range of t
DIRECT_HEADLINE, DIRECT_SUMMARY, INDIRECT_CAP = 1.0, 0.7, 0.6
T_SIGNIFICANT, T_SATURATION = 3.0, 20.0


def indirect_relevance(t: Column) -> Column:
    """Exposure t to 0..0.6: zero below significance, then from half the cap up to it."""
    a = F.abs(t)
    frac = F.least(F.lit(1.0), (a - T_SIGNIFICANT) / (T_SATURATION - T_SIGNIFICANT))
    return F.when(a >= T_SIGNIFICANT, F.round(INDIRECT_CAP * (0.5 + 0.5 * frac), 3)).otherwise(0.0)


def relevance(articles: DataFrame, key: str, symbol: str, headline: str, summary: str, aliases: DataFrame, exposures: DataFrame, patterns: dict[str, str] = DRIVER_PATTERNS) -> DataFrame:
    """(key, symbol, relevance, direct): one row per article and the symbol it was filed under; the larger of
    the direct mention and the symbol's best exposure to a driver the text speaks of.  All joins are by
    (key, symbol) or (symbol, driver); an article never meets symbols that are not its own."""
    own = articles.select(key, F.col(symbol).cast("string").alias("symbol"))
    found = lambda c, s: mentions(articles, key, c, aliases).withColumn("score", F.lit(s))
    both = F.concat_ws(" ", F.coalesce(F.col(headline), F.lit("")), F.coalesce(F.col(summary), F.lit("")))
    tagged = articles.select(key, F.col(symbol).cast("string").alias("symbol"), F.explode(tag_list(both, patterns)).alias("driver"))
    exp = exposures.select(F.col("symbol").cast("string").alias("symbol"), "driver", indirect_relevance(F.col("t")).alias("score"))
    rows = (found(headline, DIRECT_HEADLINE).unionByName(found(summary, DIRECT_SUMMARY)).withColumn("direct", F.lit(True))
            .unionByName(tagged.join(exp, ["symbol", "driver"]).select(key, "symbol", "score").withColumn("direct", F.lit(False))))
    best = rows.groupBy(key, "symbol").agg(F.max("score").alias("score"), F.bool_or("direct").alias("direct"))
    return own.join(best, [key, "symbol"], "left").select(key, "symbol", F.round(F.coalesce("score", F.lit(0.0)), 3).alias("relevance"), F.coalesce("direct", F.lit(False)).alias("direct"))
