"""Prefix trie of conversations: members, children, leaves and shared tokens of every node, by the Euler tour.

Method: every distinct sequence of first turns is a node.  A node is named by its smallest member and its depth, so the nodes
of one smallest member are a path.  Each node has an enter and an exit arc; the arc after an enter arc is that of the first child
or the node's own exit, the arc after an exit arc is that of the next sibling or the parent's exit.  The tour is list-ranked:
arcs are dealt out by ranges of (smallest member, depth), each task joins the chains that lie inside its range
into one weighted arc, and so on with what is left; chains that ranges do not shorten are ranked by pointer doubling over
the whole cluster.  Ranks carry sums: leaves and savings entered before an arc.  A subtree's are the difference of
those at its exit and its enter arc.

Skew: turns of one conversation, children of one node and ends at one node may be any share of all rows.  Positions, prefix
names, siblings and parents come from range-sorted scans (``ordered``), never from a group gathered in one task; members are counted with
map-side combining.  The ids that end at one node are hashed in sorted chunks as a stream.

Names of prefixes are 128-bit hashes (two independent 64-bit lanes over the MD5 of each role and text and its depth): at 10
billion nodes the chance that any two meet is below 1e-18.

Defined results: a null role or text is empty; rows with a null conv_id take no part; turns with equal numbers follow the MD5 of
role and text, equal rows are turns of their own; null turns come first; a conversation whose turns are all skipped ends
at the root; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import bytetext as bt, ordered
from tidemark.llm.ordered import carried, ranged
from tidemark.sources.workspace import materialise

_BLOCK = 1 << 16
_CHUNK = 1 << 20


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1]))


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(table.column(n).combine_chunks()) for n in names]


# -- turns and prefixes ------------------------------------------------------------------------------------------------


def turns(df: DataFrame) -> DataFrame:
    """conv, pos (from 1), name (16 bytes of role and text), words: the turns of each conversation in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = df.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn"), name.alias("name"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))

    def place(t: pa.Table) -> dict:
        conv, = _numbers(t, "conv")
        first = _starts(conv)
        size = np.diff(np.append(first, len(conv)))
        pos = np.arange(len(conv)) - np.repeat(first, size) + 1
        return {"conv": conv, "pos": pos, "name": t.column("name"), "words": t.column("words"), "open": np.arange(len(conv)) < size[0]}
    done = ranged(rows, ["conv", "turn", "name"], "conv bigint, pos bigint, name binary, words bigint, open boolean", place, "turns")
    parts = done.groupBy("part").agg(F.min("conv").alias("a"), F.max("conv").alias("z"), F.max_by("pos", F.struct("conv", "pos")).alias("n")).orderBy("part").collect()  # a row a range
    carry, last, held = [], None, 0
    for r in parts:
        before = held if r["a"] == last else 0
        carry.append((r["part"], before))
        held = r["n"] + (before if r["a"] == r["z"] else 0)
        last = r["z"]
    return carried(done, carry, "before bigint").select("conv", (F.col("pos") + F.when(F.col("open"), F.col("before")).otherwise(0)).alias("pos"), "name", "words")


def rebuilt(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, name, words) of the rebuilt conversations, and (conv, base, skip, lead, size) of each."""
    skip = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    sizes = told.groupBy("conv").agg(F.count("*").alias("n"))
    own = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % 20).alias("base"), skip.alias("skip"))
    convs = own.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    lead = F.least("skip", F.coalesce("base_n", F.lit(0)))
    convs = materialise(convs.select("conv", "base", "skip", lead.alias("lead"), "n", (lead + F.greatest(F.col("n") - F.col("skip"), F.lit(0))).alias("size")), "conversations")
    # a long conversation meets its row block by block
    blocks = convs.select("conv", "skip", "lead", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / _BLOCK))).alias("block"))
    tail = told.withColumn("block", F.floor(F.col("pos") / _BLOCK)).join(blocks, ["conv", "block"]).where("pos > skip").select("conv", (F.col("pos") - F.col("skip") + F.col("lead")).alias("depth"), "name", "words")
    heads = told.where("pos <= 3").withColumnRenamed("conv", "base").join(convs.select("conv", "base", "lead"), "base").where("pos <= lead")  # at most 3 x 20 rows a key
    return heads.select("conv", F.col("pos").alias("depth"), "name", "words").unionAll(tail), convs


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, depth, words, (h1, h2) of the first depth turns, (p1, p2) of one turn fewer, and whether the conversation ends there."""
    def name(t: pa.Table) -> dict:
        conv, depth = _numbers(t, "conv", "depth")
        raw = np.frombuffer(b"".join(t.column("name").to_pylist()), "<u8").reshape(-1, 2)
        first = _starts(conv)
        size = np.diff(np.append(first, len(conv)))
        out: dict = {"conv": conv, "depth": depth, "words": t.column("words")}
        for lane in (0, 1):
            one = bt.mix(bt.mix(raw[:, lane]) + depth.astype(np.uint64) * np.uint64((0x9E3779B97F4A7C15, 0xD1342543DE82EF95)[lane]))
            upto = np.bitwise_xor.accumulate(one)
            upto ^= np.repeat((upto ^ one)[first], size)
            out[f"h{lane + 1}"], out[f"p{lane + 1}"] = bt.signed(upto), bt.signed(upto ^ one)
        place = np.arange(len(conv))
        ends = np.zeros(len(conv), bool)
        ends[first[1:] - 1] = True
        return out | {"open": place < size[0], "ends": ends, "last": place == len(conv) - 1}
    done = ranged(rows, ["conv", "depth"], "conv bigint, depth bigint, words bigint, h1 bigint, h2 bigint, p1 bigint, p2 bigint, open boolean, ends boolean, last boolean", name, "prefixes")
    parts = done.groupBy("part").agg(F.min("conv").alias("a"), F.max("conv").alias("z"), F.max_by(F.struct("h1", "h2"), F.struct("conv", "depth")).alias("h")).orderBy("part").collect()  # a row a range
    carry, last, held = [], None, (0, 0)
    for i, r in enumerate(parts):
        before = held if r["a"] == last else (0, 0)
        carry.append((r["part"], *before, i + 1 == len(parts) or parts[i + 1]["a"] != r["z"]))
        held = tuple(x ^ y for x, y in zip(r["h"], before if r["a"] == r["z"] else (0, 0)))
        last = r["z"]
    full = carried(done, carry, "c1 bigint, c2 bigint, closed boolean")
    with_ = lambda x, c: F.when(F.col("open"), F.col(x).bitwiseXOR(F.col(c))).otherwise(F.col(x)).alias(x)
    return materialise(full.select("conv", "depth", "words", with_("h1", "c1"), with_("h2", "c2"), with_("p1", "c1"), with_("p2", "c2"), (F.col("ends") | F.col("last") & F.col("closed")).alias("ends")), "named-prefixes")


# -- nodes and arcs ------------------------------------------------------------------------------------------------------


def linked(nodes: DataFrame) -> DataFrame:
    """A row for each node as parent (kind 0, next: its first child) and as child (kind 1, parent, next: the sibling after it)."""
    top = nodes.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("depth").alias("kd"), F.lit(0).alias("kind"), "conv", "depth", "n_convs", "words")
    below = nodes.where("depth > 0").select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("kd"), F.lit(1).alias("kind"), "conv", "depth", "n_convs", "words")

    def link(t: pa.Table) -> dict:
        kind, conv = _numbers(t, "kind", "conv")
        n = np.arange(len(kind))
        above = np.maximum.accumulate(np.where(kind == 0, n, -1))
        more = np.append(kind[1:] == 1, False)
        return {c: t.column(c) for c in ("kind", "conv", "depth", "n_convs", "words")} | {
            "parent": pa.array(conv[np.maximum(above, 0)], mask=(kind == 0) | (above < 0)), "next": pa.array(np.append(conv[1:], 0), mask=~more), "open": above < 0, "first": n == 0, "last": n == len(n) - 1}
    done = ranged(top.unionAll(below), ["k1", "k2", "kd", "kind", "conv"], "kind int, conv bigint, depth bigint, n_convs bigint, words bigint, parent bigint, next bigint, open boolean, first boolean, last boolean", link, "linked")
    edge = lambda c, when: F.max(F.when(F.col(when), F.col(c))).alias(f"{when}_{c}")
    parts = done.groupBy("part").agg(edge("kind", "first"), edge("conv", "first"), edge("kind", "last"), edge("conv", "last"), edge("parent", "last")).orderBy("part").collect()  # a row a range
    carry, above = [], None
    for i, r in enumerate(parts):
        after = parts[i + 1] if i + 1 < len(parts) and parts[i + 1]["first_kind"] == 1 else None
        carry.append((r["part"], above, after and after["first_conv"]))
        above = r["last_conv"] if r["last_kind"] == 0 else above if r["last_parent"] is None else r["last_parent"]
    full = carried(done, carry, "above bigint, after bigint")
    return materialise(full.select("kind", "conv", "depth", "n_convs", "words", F.when(F.col("open"), F.col("above")).otherwise(F.col("parent")).alias("parent"), F.when(F.col("last"), F.col("after")).otherwise(F.col("next")).alias("next")), "tree")


_ARC = ["conv", "at"]  # at: 2 x depth, one more for the exit arc
_SUMS = ["arcs", "leaves", "saved"]


def arcs(tree: DataFrame) -> DataFrame:
    """Euler tour as a linked list: arc (conv, at), the arc after it, and what it counts."""
    enter, leave = F.col("depth") * 2, F.col("depth") * 2 + 1
    leaf = F.col("next").isNull()
    down = tree.where("kind = 0").select("conv", enter.alias("at"), F.coalesce("next", "conv").alias("to_conv"), F.when(leaf, leave).otherwise(enter + 2).alias("to_at"), F.lit(1).cast("long").alias("arcs"),
                                         leaf.cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    nothing = [F.lit(1).cast("long").alias("arcs"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")]
    up = tree.where("kind = 1").select("conv", leave.alias("at"), F.coalesce("next", "parent").alias("to_conv"), F.when(leaf, leave - 2).otherwise(enter).alias("to_at"), *nothing)
    end = tree.where("kind = 0 AND depth = 0").select("conv", leave.alias("at"), F.lit(None).cast("long").alias("to_conv"), F.lit(None).cast("long").alias("to_at"), *nothing)
    return down.unionAll(up).unionAll(end)


# -- list ranking --------------------------------------------------------------------------------------------------------


def _chains(t: pa.Table) -> dict:
    """Join the chains inside one range: every arc's chain head and the sums before it, and one arc for each chain."""
    conv, at = _numbers(t, "conv", "at")
    n = len(conv)
    to_conv, to_at = (np.asarray(t.column(c).combine_chunks().fill_null(-1)) for c in ("to_conv", "to_at"))
    some = ~np.asarray(t.column("to_at").combine_chunks().is_null())
    names = np.unique(conv)
    rank = np.searchsorted(names, conv)
    own = rank.astype(np.int64) << 40 | at
    order = np.argsort(own)
    there = np.minimum(np.searchsorted(names, to_conv), len(names) - 1)
    want = there.astype(np.int64) << 40 | to_at
    where = np.minimum(np.searchsorted(own[order], want), n - 1)
    inside = some & (names[there] == to_conv) & (own[order][where] == want)
    before = np.full(n, -1)
    before[order[where[inside]]] = np.flatnonzero(inside)
    head = np.where(before < 0, np.arange(n), before)
    weight = [np.asarray(t.column(c).combine_chunks()).astype(np.int64) for c in _SUMS]
    sums = [np.where(before < 0, 0, w[np.maximum(before, 0)]) for w in weight]
    while True:
        further = head[head]
        if (further == head).all():
            break
        sums = [s + s[head] for s in sums]  # a head's own sums are 0
        head = further
    tail = ~inside
    nulls = lambda x: pa.array(np.concatenate([np.zeros(n, np.int64), x]), mask=np.concatenate([np.ones(n, bool), ~some[tail]]))
    h = head[tail]
    out = {"chain": np.append(np.zeros(n, bool), np.ones(len(h), bool)), "conv": np.concatenate([conv, conv[h]]), "at": np.concatenate([at, at[h]]),
           "head_conv": np.concatenate([conv[head], conv[h]]), "head_at": np.concatenate([at[head], at[h]]), "to_conv": nulls(to_conv[tail]), "to_at": nulls(to_at[tail])}
    return out | {c: np.concatenate([s, (s + w)[tail]]) for c, s, w in zip(_SUMS, sums, weight)}


_CHAIN = "chain boolean, conv bigint, at bigint, head_conv bigint, head_at bigint, to_conv bigint, to_at bigint, arcs bigint, leaves bigint, saved bigint"


def _doubled(left: DataFrame) -> DataFrame:
    """Sums before each arc by pointer doubling: the number of rounds is the logarithm of the list's length."""
    going, done = materialise(left, "list"), []
    while not going.isEmpty():
        b = going.unionByName(done[-1]) if done else going
        over = b.select(F.col("conv").alias("to_conv"), F.col("at").alias("to_at"), F.col("to_conv").alias("then_conv"), F.col("to_at").alias("then_at"), *(F.col(c).alias(f"b_{c}") for c in _SUMS))
        jumped = going.where("to_at IS NOT NULL").join(over, ["to_conv", "to_at"]).select("conv", "at", F.col("then_conv").alias("to_conv"), F.col("then_at").alias("to_at"), *((F.col(c) + F.col(f"b_{c}")).alias(c) for c in _SUMS))
        ended = going.where("to_at IS NULL")
        done.append(materialise(ended.unionByName(done[-1]) if done else ended, "ranked"))
        going = materialise(jumped, "list")
    ranked = done[-1]  # sums from each arc to the end
    whole = ranked.agg(*(F.max(c).alias(c) for c in _SUMS)).head()
    return ranked.select("conv", "at", *((F.lit(whole[c]) - F.col(c)).alias(c) for c in _SUMS))


def ranked(tour: DataFrame) -> DataFrame:
    """(conv, at) with the number of arcs, leaves and savings before it in the tour."""
    left, levels = tour, []
    size = None
    while True:
        level = ranged(left, _ARC, _CHAIN, _chains, "chains")
        levels.append(level.where("NOT chain").drop("chain", "to_conv", "to_at", "part"))
        left = level.where("chain").drop("chain", "head_conv", "head_at", "part")
        n = left.count()
        if n <= ordered.ROWS:  # a bounded number of chains: one task ends the list
            base = materialise(left.coalesce(1).mapInArrow(_alone, _CHAIN), "chains").where("NOT chain").select(*_ARC, *_SUMS)
            break
        if size is not None and n > size / 2:
            base = _doubled(left)
            break
        size = n
    for level in reversed(levels):
        over = base.select(F.col("conv").alias("head_conv"), F.col("at").alias("head_at"), *(F.col(c).alias(f"b_{c}") for c in _SUMS))
        base = level.join(over, ["head_conv", "head_at"]).select(*_ARC, *((F.col(c) + F.col(f"b_{c}")).alias(c) for c in _SUMS))
    return base


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if got:
        out = _chains(pa.Table.from_batches(got))
        yield from pa.table(out).to_batches()


# -- members that end at a node --------------------------------------------------------------------------------------------


def ends_hash(ends: DataFrame) -> DataFrame:
    """(h1, h2, depth, sha): SHA-256 of the ids that end at a node, ascending, comma-joined, streamed chunk by chunk."""
    def chunk(t: pa.Table) -> dict:
        h1, h2, depth, conv = _numbers(t, "h1", "h2", "depth", "conv")
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (depth[1:] != depth[:-1]))
        new[::_CHUNK // 20] = True
        first = np.flatnonzero(new)
        texts = [",".join(map(str, conv[x:y].tolist())).encode() for x, y in zip(first, [*first[1:], len(conv)])]
        return {"h1": h1[first], "h2": h2[first], "depth": depth[first], "i": np.arange(len(first)), "ids": pa.array(texts, pa.binary())}
    pieces = ranged(ends, ["h1", "h2", "depth", "conv"], "h1 bigint, h2 bigint, depth bigint, i bigint, ids binary", chunk, "ends")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        for b in batches:
            for *k, ids in zip(*(b.column(i).to_pylist() for i in range(4))):
                if k != key:
                    if digest:
                        out.append((*key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["h1", "h2", "depth", "sha"])
                out = []
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], names=["h1", "h2", "depth", "sha"])
    dealt = pieces.repartition("h1", "h2", "depth").sortWithinPartitions("h1", "h2", "depth", "part", "i").select("h1", "h2", "depth", "ids")
    return dealt.mapInArrow(stream, "h1 bigint, h2 bigint, depth bigint, sha string")


# -- the whole -------------------------------------------------------------------------------------------------------------


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enter and exit (places in the tour) of every node."""
    rows, convs = rebuilt(turns(conversations))
    named = prefixes(rows)
    shared = named.groupBy("h1", "h2", "depth").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("conv IS NOT NULL").select(zero.alias("h1"), zero.alias("h2"), zero.alias("depth"), "conv", "n_convs", zero.alias("words"), zero.alias("p1"), zero.alias("p2"))
    nodes = materialise(shared.unionByName(root), "nodes")
    tree = linked(nodes)
    placed = ranked(arcs(tree))
    ends = named.where("ends").select("h1", "h2", "depth", "conv").unionByName(convs.where("size = 0").select(zero.alias("h1"), zero.alias("h2"), zero.alias("depth"), "conv"))
    hashed = ends_hash(ends).join(nodes.select("h1", "h2", "depth", "conv"), ["h1", "h2", "depth"])
    # everything about a node meets by its name, each kind of row with its own columns
    depth, out = F.floor(F.col("at") / 2), F.col("at") % 2 == 1
    sign = F.when(out, 1).otherwise(-1)
    parts = [placed.select("conv", depth.alias("depth"), (sign * F.col("leaves")).alias("n_leaves"), (sign * F.col("saved")).alias("saved_tokens"), F.when(~out, F.col("arcs")).alias("enter"), F.when(out, F.col("arcs")).alias("exit")),
             tree.where("kind = 0").select("conv", "depth", "n_convs"), tree.where("kind = 1").select("conv", "depth", "parent"),
             tree.where("kind = 1").select(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth"), F.lit(1).cast("long").alias("n_children")), hashed.select("conv", "depth", "sha")]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    total: dict[str, Column] = {c: F.coalesce(F.sum(c), zero).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")}
    one = {c: F.max(c).alias(a) for c, a in (("parent", "parent_conv_id"), ("n_convs", "n_convs"), ("enter", "enter"), ("exit", "exit"))}
    return both.groupBy(F.col("conv").alias("conv_id"), "depth").agg(one["parent"], one["n_convs"], total["n_children"], total["n_leaves"], total["saved_tokens"],
                                                                     F.coalesce(F.max("sha"), F.sha2(F.lit(""), 256)).alias("ends_sha256"), one["enter"], one["exit"])
