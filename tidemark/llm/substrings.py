"""Exact removal of word passages that an earlier document has as well.

Method: prefix-partitioned suffix trees.  A passage repeats if the suffix at its first word shares ``size`` words with
another suffix, that is below an internal node of the suffix tree of that depth or more.  The tree is never built whole.
Suffixes are split by a run of their own words into groups that fit in memory, and each group builds its part of the
tree: its suffixes are sorted by their words, neighbours in that order share as many words as their lowest common
ancestor is deep, and stretches of neighbours that share ``size`` words are the deep nodes.  Each keeps its least
document; merging the covered places of a document gives its maximal repeats.

The splitting run has variable length: normally it is the one run of a few words, among those in the suffix's first
``size`` words, whose hash is least.  Equal suffixes choose the same run, neighbouring suffixes mostly share one, and so
one row carries the words of all of them; a run that had to be the first words of each suffix would send every word
``size`` times.  Where a run is so frequent that its group would not fit, it is lengthened by the words after it (by those
before it in suffixes that end too soon) to half way between its length and ``size``, and where that is still too
frequent, to the first ``size`` words.

Hashes only choose the group.  That two suffixes are equal is always decided by their words, byte by byte.

Rows of a slice that go to one group travel as one parcel with their compressed words, so the shuffle moves few large rows.

Skew: equal suffixes within a slice are merged before the shuffle, and only the least document of each goes on, so a
passage that a third of all documents share costs one row a slice.  How full the groups get is counted over all
documents, in a table that grows with the rows up to ``_MOST`` counters.

Defined results: null and empty texts lose nothing; documents with a null key lose nothing and take nothing; rows with
equal keys do not remove from each other; texts shorter than ``size`` words are kept whole; windows are judged on the
input; an empty table gives no rows; keys are integers.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import bytetext as bt
from tidemark.llm.textmap import lists, over_texts, total_counts

#: Words of a splitting run, more where ``size`` is over 14: a row has at most 12 windows.
RUN = 3
#: Rows of a group: what one task holds at once.
GROUP_ROWS = 50_000
#: Counters of the table of runs: at first, and at most.  There are four for each full group, so that a crowded run stands out.
_COUNTERS = 1 << 16
_MOST = 1 << 22
_SLICE = 2 << 20


def _least_run(run: np.ndarray, width: int) -> np.ndarray:
    """For each place the place of the least of ``width`` values from it on; the earlier one of equal values."""
    bits = np.uint64(max(21, int(len(run)).bit_length()))
    u = run >> bits << bits | np.arange(len(run), dtype=np.uint64)
    step = 1
    while step < width:
        by = min(step, width - step)
        u = np.minimum(u[:-by], u[by:])
        step += by
    return (u & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)


def _spaced(words: bt.Words) -> tuple[np.ndarray, np.ndarray]:
    """All words of a slice, each followed by one space, and where each begins."""
    n = words.end - words.start + 1
    begin = np.append(0, np.cumsum(n))
    data = np.append(words.data, np.uint8(32))[np.arange(begin[-1]) + np.repeat(words.start - begin[:-1], n)]
    data[begin[1:] - 1] = 32
    return data, begin


def _names(data, begin: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each word, in the order of their bytes, and how many different ones there are."""
    coded = pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin), pa.py_buffer(data)]).dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[np.asarray(pc.sort_indices(coded.dictionary))] = np.arange(len(rank))
    return rank[np.asarray(coded.indices)], len(rank)


def _suffixes(texts: pa.Array, keys: pa.Array, size: int, resolve: bool, crowded: tuple[np.ndarray, ...] = ()):
    """Windows of a slice: words, hash, first word, text, key, whether an earlier document of the slice has it (if asked),
    rows (first window, end), run hash of each row, place of the run of each window, spaced words and their places (if asked)."""
    words = bt.split(texts)
    h = words.hashes()
    w, at, doc = bt.windows(words, size, h)
    if keys.null_count:
        own = ~np.asarray(keys.is_null())[doc]
        w, at, doc = w[own], at[own], doc[own]
    key = np.asarray(keys.fill_null(0)).astype(np.int64)[doc]
    known = np.zeros(len(w), bool)
    if not len(w):
        return words, w, at, doc, key, known, np.zeros(0, np.int64), np.zeros(0, np.int64), w, at, w, at
    data = begin = None
    if resolve:
        data, begin = _spaced(words)
        order = np.argsort(w)
        new = np.append(True, w[order][1:] != w[order][:-1])
        alike = np.cumsum(new) - 1
        late = key[order] > np.minimum.reduceat(key[order], np.flatnonzero(new))[alike]
        if late.any():
            holder = np.empty(alike[-1] + 1, np.int64)
            holder[alike[~late]] = order[~late]
            x, y = order[late], holder[alike[late]]
            name, _ = _names(data, begin)
            same = np.ones(len(x), bool)
            for i in range(size):
                same &= name[at[x] + i] == name[at[y] + i]
            known[x[same]] = True
    length = max(RUN, size - 11)
    n = np.arange(len(h) - length + 1)
    run = bt.run_hashes(h, n, n + length)
    place = _least_run(run, size - length + 1)[at]
    name = run[place]
    fresh = np.append(True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))
    if crowded:
        longer = (size + length) // 2
        ahead = place - at <= size - longer
        full = crowded[0][_counter(name, len(crowded[0]))]
        # equal suffixes have their run at the same distance, and so choose the same longer one
        x = np.flatnonzero(full)
        first = np.where(ahead[x], place[x], place[x] + length - longer)
        name[x] = bt.run_hashes(h, first, first + longer)
        fresh[1:] |= full[1:] & (ahead[1:] != ahead[:-1])
        for still in crowded[1:]:
            full &= still[_counter(name, len(still))]
            name[full], fresh[full] = w[full], True
            fresh[1:] |= full[:-1] & ~full[1:]
    start = np.flatnonzero(fresh)
    return words, w, at, doc, key, known, start, np.append(start[1:], len(w)), name[start], place, data, begin


#: Bits that tell rows with equal keys and different texts apart.
_TAG = (1 << 23) - 1
_LEVEL = 6


def _counter(run: np.ndarray, counters: int) -> np.ndarray:
    return (run >> np.uint64(65 - counters.bit_length())).astype(np.int64)


def _fill(df: DataFrame, text: str, key: str, size: int, counters: int, crowded: tuple[np.ndarray, ...] = ()) -> np.ndarray:
    """How many rows fall on each counter, a power of two of them: all documents count."""
    def work(texts, keys):
        return np.bincount(_counter(_suffixes(texts, keys, size, False, crowded)[8], counters), minlength=counters)
    return total_counts(df, text, counters, work, (key,), _SLICE)


#: Arrays of a parcel: the rows that one slice sends to one group. meta: windows, known ones. The words of each row from its first open window to its last follow.
_PARCEL = (("key", np.int64), ("place", np.int64), ("meta", np.int32))


def _planes(x: np.ndarray) -> bytes:
    """Bytes of an array, all first bytes first: numbers that are alike compress well so."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unpacked(parcels: list[bytes]) -> tuple[dict[str, np.ndarray], bytes]:
    found, texts, unzip = {c: [] for c, _ in _PARCEL}, [], zstandard.ZstdDecompressor()
    for p in parcels:
        n, at = int.from_bytes(p[:4], "little"), 4
        for c, kind in _PARCEL:
            size = np.dtype(kind).itemsize
            found[c].append(np.ascontiguousarray(np.frombuffer(p, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
            at += n * size
        if at < len(p):
            texts.append(unzip.decompress(memoryview(p)[at:]))
    return {c: np.concatenate(x) for c, x in found.items()}, b"".join(texts)


def _rows(df: DataFrame, text: str, key: str, size: int, crowded: tuple[np.ndarray, ...], groups: int) -> DataFrame:
    """g, parcel: the suffix rows of each slice, by group."""
    def work(texts, keys):
        words, w, at, doc, own, known, start, end, run, _, spaced, begin = _suffixes(texts, keys, size, True, crowded)
        ends = np.zeros(len(texts) + 1, np.int64)
        if not len(w):
            return [lists(np.zeros(0, np.int32), ends), lists(pa.array([], pa.binary()), ends)]
        data, offsets = memoryview(np.ascontiguousarray(words.data)), words.offsets
        tag = np.array([zlib.crc32(data[a:b]) & _TAG for a, b in zip(offsets[:-1], offsets[1:])], np.int64)
        bit = np.int64(1) << (np.arange(len(w)) - np.repeat(start, end - start))
        flags = np.add.reduceat(np.where(known, bit, 0), start)
        open_ = np.add.reduceat((~known).astype(np.int64), start)
        k = np.where(open_ == 0, bt.mix((own[start] + at[start]).astype(np.uint64)), run)  # nothing open: any group will do
        g = (k % np.uint64(groups)).astype(np.int64)
        order = np.argsort(g, kind="stable")
        # words from the first open window of a row to the end of its last one
        opened = np.append(np.flatnonzero(~known), 0)
        before = np.append(0, np.cumsum(~known))[start]
        low = np.where(open_ > 0, begin[at[opened[before]]], 0)[order].tolist()
        high = np.where(open_ > 0, begin[at[opened[np.maximum(before + open_ - 1, 0)]] + size], 0)[order].tolist()
        view, zipped = memoryview(spaced), zstandard.ZstdCompressor(level=_LEVEL)
        columns = {"key": own[start][order], "place": (tag[doc[start]] << 40 | at[start] - words.first[doc[start]])[order],
                   "meta": (end - start | flags << 4)[order].astype(np.int32)}
        names, first = np.unique(g[order], return_index=True)
        parcels = []
        for x, y in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
            carried = b"".join([view[i:j] for i, j in zip(low[x:y], high[x:y])])
            parcels.append(b"".join([(y - x).to_bytes(4, "little"), *(_planes(columns[c][x:y]) for c, _ in _PARCEL), zipped.compress(carried) if carried else b""]))
        ends[1:] = len(names)
        return [lists(names.astype(np.int32), ends), lists(pa.array(parcels, pa.binary()), ends)]
    found = over_texts(df, text, [], "g array<int>, parcel array<binary>", lambda: work, beside=(key,), limit=_SLICE)
    return found.select(F.explode(F.arrays_zip("g", "parcel")).alias("r")).select("r.g", "r.parcel")


def _late(name: np.ndarray, names: int, at: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    """Which of the suffixes at places ``at`` lie below a node of depth ``size`` or more that a smaller key has too."""
    bits = max(1, (names - 1).bit_length())
    width, prefix = 63 // bits, []
    for i in range(0, size, width):
        x = name[at + i]
        for j in range(i + 1, min(i + width, size)):
            x = x << bits | name[at + j]
        prefix.append(x)
    order = np.lexsort(prefix[::-1])
    # neighbours in suffix order that share fewer words end a node
    fresh = np.zeros(len(order), bool)
    fresh[0] = True
    for x in prefix:
        x = x[order]
        fresh[1:] |= x[1:] != x[:-1]
    node, own = np.cumsum(fresh) - 1, key[order]
    late = np.empty(len(order), bool)
    late[order] = own > np.minimum.reduceat(own, np.flatnonzero(fresh))[node]
    return late


def _nodes(table: pa.Table, *, size: int = 13) -> pa.Table:
    """The part of the tree that belongs to a group: suffixes in order of their words, the deep nodes, and the suffixes of later documents."""
    c, text = _unpacked([p.as_py() for p in table.column("parcel")])
    key, meta = c["key"], c["meta"].astype(np.int64)
    j = np.arange(12)
    inside = j < (meta & 15)[:, None]
    known = inside & (meta[:, None] >> 4 >> j & 1 > 0)
    late, open_ = known, inside & ~known
    if open_.any():
        data = np.frombuffer(text, np.uint8)
        name, names = _names(text, np.append(0, np.flatnonzero(data == 32) + 1))
        first = open_.argmax(1)
        carried = np.where(open_.any(1), 12 - open_[:, ::-1].argmax(1) - 1 - first + size, 0)
        begin = np.cumsum(carried) - carried
        row, at = np.nonzero(open_)
        late[row, at] = _late(name, names, begin[row] + at - first[row], key[row], size)
    mask = (late << j).sum(1)
    some = mask > 0
    return pa.table({"key": key[some], "place": c["place"][some], "mask": pa.array(mask[some], pa.int32())})


def repeats(df: DataFrame, size: int = 13, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, place, mask): windows that start in a document with a smaller key, as bits from a first window on."""
    counters, crowded = _COUNTERS, ()
    total = _fill(df, text, key, size, counters)
    wanted = 1 << (4 * int(total.sum()) // GROUP_ROWS).bit_length()
    if wanted > counters:
        counters = min(wanted, _MOST)
        total = _fill(df, text, key, size, counters)
    # the mean counts only where the most counters are too few
    full = total > max(GROUP_ROWS, 4 * total.mean())
    if full.any():
        total = _fill(df, text, key, size, counters, (full,))
        crowded = full, total > max(GROUP_ROWS, 4 * total.mean())
    groups = max(-(-int(total.sum()) // GROUP_ROWS), 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _rows(df, text, key, size, crowded, groups).groupBy("g").applyInArrow(lambda table: _nodes(table, size=size), "key bigint, place bigint, mask int")


def without_repeats(df: DataFrame, size: int = 13, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), joined: bool = False) -> DataFrame:
    """key, the columns ``keep``, n_words, n_removed, spans (removed [from, to) in words) and the remaining text.

    With joined=True the remaining words are joined by one space; otherwise the text between and around them stays as it
    is, but for the space before each removed word.
    """
    if size < RUN:
        raise ValueError(f"size must be at least {RUN}")
    cuts = repeats(df, size, text, key).groupBy("key").agg(F.collect_list(F.struct("place", "mask")).alias("__cuts"))  # bounded by the document's own words
    rows = df.join(cuts.withColumnRenamed("key", "__key"), F.col(key) == F.col("__key"), "left")

    def work(texts, cut):
        words = bt.split(texts)
        offsets = words.offsets
        data = memoryview(np.ascontiguousarray(words.data))
        gone, spans, texts_out = [], [], []
        for d, c in enumerate(cut):
            a, b = int(words.first[d]), int(words.first[d + 1])
            lo, hi = int(offsets[d]), int(offsets[d + 1])
            hidden = np.zeros(b - a, bool)
            if c.is_valid and b > a:
                place, mask = (np.asarray(c.values.field(i)) for i in (0, 1))
                own = place >> 40 == zlib.crc32(data[lo:hi]) & _TAG
                place, mask = place[own] & (1 << 40) - 1, mask[own]
                at = np.concatenate([place[mask >> j & 1 > 0] + j for j in range(12)])
                hidden = bt.covered(b - a, at, size)
            gone.append(int(hidden.sum()))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hidden.view(np.int8), [0]])))
            spans.append([{"from": int(x), "to": int(y)} for x, y in zip(edge[::2], edge[1::2])])
            if joined:
                keep_ = np.flatnonzero(~hidden) + a
                texts_out.append(b" ".join(data[s:e] for s, e in zip(words.start[keep_].tolist(), words.end[keep_].tolist())).decode())
            elif not gone[-1]:
                texts_out.append(bytes(data[lo:hi]).decode() if texts[d].is_valid else None)
            else:
                out, p = [], lo
                for s in spans[-1]:
                    out.append(bytes(data[p:max(p, int(words.end[a + s["from"] - 1]))] if s["from"] else b""))
                    p = int(words.end[a + s["to"] - 1])
                texts_out.append(b"".join([*out, bytes(data[p:hi])]).decode())
        return [words.counts, np.array(gone, np.int64), pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.array(texts_out, pa.string())]
    return over_texts(rows, text, [key, *keep], f"n_words bigint, n_removed bigint, spans array<struct<from: int, to: int>>, `{text}` string", lambda: work, beside=("__cuts",))
