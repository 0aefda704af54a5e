"""Near duplicates of texts by b-bit MinHash.

Method: every text is a set of word shingles; for each of bands x rows hash functions its minimum is taken.  Rows of a
band together form the band's key, and texts that share a key are candidates.  The low b bits of the minima are packed
into four longs; the bits in which two signatures agree, corrected for chance agreement, estimate the similarity, and
candidates that are clearly too far apart go no further.  Beside them a table of parities of all shingles bounds the
symmetric difference of two sets from below, which dismisses most other pairs under the threshold for certain.  What is
left is decided on the full shingle sets, so every link is exact.

Pairs inside a group are never all formed.  Texts with the same set are one node.  First the members of a bucket meet
the bucket's centres only (the least member under a few orders); confirmed links are joined to components; then only
members of one bucket whose components still differ are left.  In a bucket of at most ``SMALL`` of them all are compared.
Members of larger ones meet where they share a shingle of their prefixes: a set's rarest shingles, so many that two sets
over the threshold have one in common for certain.  Members with a prefix shingle that many others share are compared with
such members of their bucket.  Nothing is capped: a link of a bucket is either connected already, or compared.

Chances: a link at the threshold 0.8 shares no band of 40 x 5 with probability 1.2e-7; the estimate loses one of
128 x 2 bits with less than 1e-7, as it is let through from five standard deviations below the threshold on.

Defined results: null and word-less texts have an empty set and are linked with nothing; texts with fewer words than a
shingle are one shingle; repeated rows are linked like any copies; null keys take part, and are ignored where the
smallest key of a component is sought; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import bytetext as bt
from tidemark.llm.components import components
from tidemark.llm.spread import left_join
from tidemark.llm.textmap import lists, over_texts, total_counts
from tidemark.sources.workspace import materialise

BANDS, ROWS = 40, 5
BITS, SIGNED = 2, 128
#: Longs of the parity table: bit i says whether an odd number of shingles falls on i.
PARITY = 16
#: Orders of the members of a bucket, each with its own centre.
ORDERS = 4
#: Members of a group that are all compared with each other.
SMALL = 32
#: Counters of the table whose counts order the shingles of a set, rare ones first; more shingles share them, and any order is exact.
COUNTERS = 1 << 18
SIGNATURE = [*(f"s{k}" for k in range(4)), *(f"p{k}" for k in range(PARITY))]
#: Pairs of alternating bits.
_ODD_BITS = 0x5555555555555555


def shingle_sets(words: bt.Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h = words.hashes()
    w, _, doc = bt.windows(words, size, h)
    bounds = np.searchsorted(doc, np.arange(len(words.counts) + 1))
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    whole = bt.run_hashes(h, words.first[short], words.first[short + 1])
    sets = [bt.distinct(w[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    for d, x in zip(short, whole):
        sets[d] = np.array([x], np.uint64)
    return sets


def set_id(shingles: np.ndarray) -> int:
    return int(bt.mix(np.add.reduce(shingles, keepdims=True) + np.uint64(len(shingles)))[0].view(np.int64))


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    draw = bt.mix(np.arange(1, 2 * n + 1, dtype=np.uint64)).astype(np.uint32)
    factor, shift = (draw[:n] | np.uint32(1))[:, None], draw[n:][:, None]
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, np.iinfo(np.uint32).max)
    for i in range(0, len(x), 4096):
        out = np.minimum(out, (factor * x[None, i:i + 4096] + shift).min(1))
    return out.astype(np.uint64)


def sketches(df: DataFrame, text: str, key: str, size: int, lower: bool) -> DataFrame:
    """key, n_shingles, node (identity of the set), bands array<bigint>, s0 to s3 (packed low bits of the minima), p0, p1, ... (parities)."""
    def prepare():
        band = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        place = np.tile(np.arange(0, 64, BITS, dtype=np.uint64), (4, 1))

        def work(texts):
            sets = shingle_sets(bt.split(texts, lower=lower), size)
            keys, packed, odd = np.zeros((len(sets), BANDS), np.uint64), np.zeros((len(sets), 4), np.uint64), np.zeros((len(sets), PARITY), np.int64)
            for i, s in enumerate(sets):
                if len(s):
                    m = minima(s, BANDS * ROWS)
                    keys[i] = bt.run_hashes(m, np.arange(0, len(m), ROWS), np.arange(ROWS, len(m) + 1, ROWS))
                    packed[i] = ((bt.mix(m[:SIGNED]).reshape(4, -1) & np.uint64((1 << BITS) - 1)) << place).sum(1, dtype=np.uint64)
                    odd[i] = np.packbits((np.bincount((s >> np.uint64(8) & np.uint64(PARITY * 64 - 1)).astype(np.int64), minlength=PARITY * 64) & 1).astype(bool)).view(np.int64)
            full = np.array([len(s) > 0 for s in sets], bool)
            at = np.append(0, np.cumsum(full * BANDS))
            return [np.array([len(s) for s in sets], np.int64), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                    lists(bt.signed(bt.mix(keys ^ band)[full].ravel()), at), *(np.ascontiguousarray(bt.signed(packed)[:, k]) for k in range(4)),
                    *(np.ascontiguousarray(odd[:, k]) for k in range(PARITY))]
        return work
    return over_texts(df, text, [key], "n_shingles bigint, node bigint, bands array<bigint>, " + ", ".join(f"{c} bigint" for c in SIGNATURE), prepare)


def estimate(a: str, b: str):
    """Similarity from the agreeing b-bit minima, corrected for agreement by chance."""
    differ = sum((F.bit_count((x := F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))).bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_ODD_BITS))) for k in range(4)), F.lit(0))
    chance = 2.0 ** -BITS
    return (1 - differ / SIGNED - chance) / (1 - chance)


def near(a: str, b: str, percent: int):
    """What cannot be excluded by sizes and parities (exact bounds) or by the estimate (five standard deviations below)."""
    chance = 2.0 ** -BITS
    agree = chance + (1 - chance) * percent / 100
    least = percent / 100 - 5.3 * (agree * (1 - agree) / SIGNED) ** 0.5 / (1 - chance)
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    # an odd parity of the difference takes at least one shingle that only one set has; similar sets have few of those
    differ = sum((F.bit_count(F.col(f"{a}.p{k}").bitwiseXOR(F.col(f"{b}.p{k}"))) for k in range(PARITY)), F.lit(0))
    return (small * 100 >= large * percent) & (estimate(a, b) >= least) & (differ * (100 + percent) <= (small + large) * (100 - percent))


def confirmed(pairs: DataFrame, df: DataFrame, nodes: DataFrame, text: str, key: str, size: int, lower: bool, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough. nodes: node and a key whose text has that set."""
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    asked = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    holders = nodes.join(asked, "node", "left_semi").select(key).distinct()

    def prepare():
        def work(texts):
            sets = shingle_sets(bt.split(texts, lower=lower), size)
            return [pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), lists(bt.signed(np.concatenate([*sets, np.zeros(0, np.uint64)])), np.append(0, np.cumsum([len(s) for s in sets])))]
        return work
    texts = df.select(key, text).join(holders, df[key].eqNullSafe(holders[key]), "left_semi")
    sets = over_texts(texts, text, [], "node bigint, shingles array<bigint>", prepare).join(asked, "node", "left_semi").dropDuplicates(["node"])
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("n")).where(F.col("c") * 100 >= percent * (F.col("n") - F.col("c"))).select("a", "b")


def prefixes(df: DataFrame, nodes: DataFrame, asked: DataFrame, text: str, key: str, size: int, lower: bool, percent: int) -> DataFrame:
    """node and token, the rarest shingles of its set: as many as a similar set cannot all do without."""
    holders = nodes.join(asked, "node", "left_semi").select(key).distinct()
    texts = materialise(df.select(key, text).join(holders, df[key].eqNullSafe(holders[key]), "left_semi").select(text), "texts")

    def count(texts):
        sets = shingle_sets(bt.split(texts, lower=lower), size)
        return np.bincount((np.concatenate([*sets, np.zeros(0, np.uint64)]) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
    often = total_counts(texts, text, COUNTERS, count)

    def prepare():
        def work(texts):
            sets = shingle_sets(bt.split(texts, lower=lower), size)
            rare = [s[np.lexsort((s, often[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]))[:len(s) + 1 + -percent * len(s) // 100]] if len(s) else s for s in sets]
            return [pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), lists(bt.signed(np.concatenate([*rare, np.zeros(0, np.uint64)])), np.append(0, np.cumsum([len(x) for x in rare])))]
        return work
    return over_texts(texts, text, [], "node bigint, tokens array<bigint>", prepare).join(asked, "node", "left_semi").dropDuplicates(["node"]).select("node", F.explode("tokens").alias("token"))


def meetings(members: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes of different components that share a token few have, and the nodes with a token that many have.

    members: node, label; tokens: node, token.
    """
    filed = materialise(tokens.join(members.select("node", "label").distinct(), "node"), "prefixes")
    crowd = filed.groupBy("token").agg(F.count("*").alias("n"), F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("token", "n")
    crowd = materialise(crowd, "tokens")
    p = filed.join(crowd.where(F.col("n") <= SMALL), "token", "left_semi")
    pairs = p.join(p.select("token", F.col("node").alias("other"), F.col("label").alias("far")), "token").where("label < far")
    common = filed.join(crowd.where(F.col("n") > SMALL), "token", "left_semi").select("node").distinct()
    return pairs.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct(), common


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", lower: bool = True) -> DataFrame:
    """key, n_shingles, component_id (smallest key that links reach), kept (key is component_id), one row for each row."""
    s = materialise(sketches(df, text, key, size, lower), "sketches")
    nodes = materialise(s.where("node is not null").groupBy("node").agg(F.min(key).alias(key)), "nodes")
    first = s.where("node is not null").dropDuplicates(["node"]).select("node", "n_shingles", *SIGNATURE, "bands")
    filed = first.select("node", F.posexplode("bands").alias("band", "k"))
    turn = F.element_at(F.array(*(F.lit(int(x)) for x in bt.signed(bt.mix(np.arange(1, ORDERS + 1, dtype=np.uint64))))), F.col("band") % ORDERS + 1)
    centres = filed.groupBy("k", "band").agg(F.min(F.col("node").bitwiseXOR(turn)).alias("m"), F.count("*").alias("n")).where("n > 1").select("k", F.col("m").bitwiseXOR(turn).alias("centre"))
    shared = materialise(filed.join(centres, "k").select("k", "node", "centre"), "buckets")
    sign = materialise(first.drop("bands").join(shared.select("node").distinct(), "node", "left_semi"), "signatures")
    star = shared.where("node != centre").select("node", "centre").distinct()
    tested = star.join(sign.alias("p"), F.col("p.node") == star["node"]).join(sign.alias("q"), F.col("q.node") == star["centre"]).where(near("p", "q", percent))
    links = materialise(confirmed(tested.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")), df, nodes, text, key, size, lower, percent), "links")
    label = components(links)
    # buckets in which more than one component is left
    known = shared.select("k", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = known.groupBy("k").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("n")).where("l < h").select("k", "n")
    open_ = materialise(known.join(mixed, "k").join(sign, "node"), "open")
    members = open_.where(F.col("n") > SMALL)
    small, met = open_.where(F.col("n") <= SMALL), None
    if not members.isEmpty():
        met, common = meetings(members, prefixes(df, nodes, members.select("node").distinct(), text, key, size, lower, percent))
        small = small.unionAll(members.join(common, "node", "left_semi").select(*small.columns))
    p, q = small.alias("p"), small.alias("q")
    others = p.join(q, (F.col("p.k") == F.col("q.k")) & (F.col("p.label") < F.col("q.label")) & near("p", "q", percent)).select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))
    if met is not None:
        met = met.join(sign.alias("p"), F.col("p.node") == met["a"]).join(sign.alias("q"), F.col("q.node") == met["b"]).where(near("p", "q", percent)).select("a", "b")
        others = others.unionAll(met)
    more = materialise(confirmed(others, df, nodes, text, key, size, lower, percent), "links")
    if not more.isEmpty():
        label = components(links.unionAll(more))
    nodes = materialise(nodes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "nodes")
    least = nodes.groupBy("label").agg(F.min(key).alias("least"))
    held = left_join(s.select(key, "n_shingles", "node"), materialise(left_join(nodes.select("node", "label"), least, "label").select("node", "least"), "components"), "node")
    out = held.select(key, "n_shingles", F.coalesce("least", key).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
