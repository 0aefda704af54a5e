"""Pack tokenized documents into as few fixed-length sequences as the lengths allow.

Method: linear grouping.  Large pieces, in order of length, are cut into groups of equal cardinality and every length
is rounded up to the largest of its group.  The configuration problem over these few sizes is solved as a linear
program by column generation (a knapsack prices new configurations); whole multiples of the configurations are used.
Actual pieces then take the places of their group, which leaves gaps, and all remaining pieces, longest first, go by
best fit into the tightest gap that takes them.

The plan needs nothing but the number of pieces of each length, at most ``capacity`` rows whatever the input holds.  It
is made of runs: so many sequences alike, so many pieces of a length in each.  Spark numbers the pieces of each length
(positions come from bucket counts, so a length with a third of all rows is spread over the buckets) and every task
reads sequence and offset from the plan by binary search.

Defined results: null text is an empty text; every document has at least its closing id; only documents longer than the
capacity are cut; repeated rows are packed each; ties follow doc_id, piece and checksum; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm import bpe
from tidemark.llm.textmap import fields, lists, over_texts
from tidemark.sources.workspace import materialise

#: Id that closes every document (fixed by the contract of the query).
CLOSING_ID = 1


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000) -> list[tuple[int, list[int]]]:
    """(times, pieces of each size) of a linear-programming optimum for covering the demand, times rounded down."""
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    need = np.array(demand, float)
    layers = [(i, s) for i, s in enumerate(sizes) for _ in range(capacity // s)]
    for _ in range(rounds):
        x = np.linalg.solve(basis, need)
        price = np.linalg.solve(basis.T, np.ones(k))
        best, took = np.zeros(capacity + 1), []
        for i, s in layers:
            with_it = best[:-s] + price[i]
            better = with_it > best[s:] + 1e-12
            took.append(better)
            best[s:] = np.where(better, with_it, best[s:])
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for (i, s), better in zip(reversed(layers), reversed(took)):
            if room >= s and better[room - s]:
                column[i] += 1
                room -= s
        step = np.linalg.solve(basis, column)
        ratio = np.full(k, np.inf)
        ratio[step > 1e-9] = np.maximum(x[step > 1e-9], 0) / step[step > 1e-9]
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, need)
    return [(int(t + 1e-6), basis[:, j].astype(int).tolist()) for j, t in enumerate(x) if t + 1e-6 >= 1]


class Runs:
    """Runs of alike sequences by gap. A run: number of sequences, gap, entries (length, first rank, pieces each)."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.full, self.serial = capacity, [], [], 0

    def add(self, n: int, gap: int, entries: list) -> None:
        if gap:
            self.serial += 1
            insort(self.open, (gap, self.serial, n, entries))
        else:
            self.full.append((n, entries))

    def best_fit(self, length: int, rank: int, count: int) -> None:
        """Place ``count`` pieces of one length, ranks from ``rank`` on, each into the tightest gap."""
        while count:
            i = bisect_left(self.open, (length,))
            if i < len(self.open):
                gap, _, n, entries = self.open.pop(i)
            else:
                gap, n, entries = self.capacity, -(-count // (self.capacity // length)), []
            each = min(gap // length, count)
            m = min(n, count // each)
            if m < n:
                self.add(n - m, gap, [(s, r + m * q, q) for s, r, q in entries]) if entries else None
            self.add(m, gap - each * length, [*entries, (length, rank, each)])
            rank, count = rank + m * each, count - m * each

    def rows(self) -> np.ndarray:
        """length, first rank, pieces, pieces each, first sequence, offset; sorted by length and rank."""
        out, sequence = [], 0
        for n, entries in [*self.full, *((n, e) for _, _, n, e in self.open)]:
            offset = 0
            for s, r, q in entries:
                out.append((s, r, n * q, q, sequence, offset))
                offset += s * q
            sequence += n
        rows = np.array(out, np.int64).reshape(-1, 6)
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def plan(counts: dict[int, int], capacity: int, groups: int = 12, large: float = 1 / 4) -> np.ndarray:
    """Plan rows (see ``Runs.rows``) for counts[length] pieces of each length."""
    runs = Runs(capacity)
    lengths = sorted((s for s in counts if counts[s]), reverse=True)
    big = [s for s in lengths if s > capacity * large and s < capacity]
    ends = np.cumsum([counts[s] for s in big]).astype(np.int64) if big else np.zeros(0, np.int64)
    total, left = int(ends[-1]) if big else 0, {s: (0, counts[s]) for s in lengths}
    if total:
        k = min(groups, total)
        cuts = [total * i // k for i in range(k + 1)]
        at = lambda r: int(np.searchsorted(ends, r, "right"))  # noqa: E731  length class of a rank
        sizes: dict[int, list[list[int]]] = {}
        for a, b in zip(cuts, cuts[1:]):
            sizes.setdefault(big[at(a)], []).append([a, b])
        tops = sorted(sizes, reverse=True)
        spans = {s: [sizes[s][0][0], sizes[s][-1][1]] for s in tops}
        for times, pattern in configurations(tops, [spans[s][1] - spans[s][0] for s in tops], capacity):
            slots = []
            for s, each in zip(tops, pattern):
                for _ in range(each):
                    if times <= spans[s][1] - spans[s][0]:
                        slots.append(spans[s][0])
                        spans[s][0] += times
            edges = {0, times}
            for r in slots:
                edges |= {int(e) - r for e in ends[at(r):at(r + times - 1)]}
            for a, b in zip(sorted(edges), sorted(edges)[1:]):
                own = [(big[c], r + a - int(ends[c] - counts[big[c]]), 1) for r in slots if (c := at(r + a)) >= 0]
                if own:
                    runs.add(b - a, capacity - sum(s for s, _, _ in own), own)
        rest: dict[int, list[tuple[int, int]]] = {s: [] for s in big}
        for a, b in spans.values():
            while a < b:
                c = at(a)
                stop = min(b, int(ends[c]))
                rest[big[c]].append((a - int(ends[c] - counts[big[c]]), stop - a))
                a = stop
    else:
        rest = {}
    for s in lengths:
        for rank, n in rest.get(s, [left[s]] if s not in rest else []):
            runs.best_fit(s, rank, n)
    return runs.rows()


def pieces(df: DataFrame, path: str, capacity: int, text: str = "text", key: str = "doc_id", closing_id: int = CLOSING_ID) -> DataFrame:
    """key, piece, start, length, ids_crc32: the pieces of each document's ids with the closing id."""
    def prepare():
        b = bpe.load(path)

        def work(texts):
            ids, offsets = b.encode(texts)
            lengths, sums, at = [], [], [0]
            for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                own = np.append(ids[x:y], closing_id).astype("<u4")
                for s in range(0, len(own), capacity):
                    part = own[s:s + capacity]
                    lengths.append(len(part))
                    sums.append(zlib.crc32(part.tobytes()))
                at.append(len(lengths))
            return [lists(pa.array([{"length": n, "ids_crc32": c} for n, c in zip(lengths, sums)], pa.struct([("length", pa.int64()), ("ids_crc32", pa.int64())])), at)]
        return work
    cut = over_texts(df, text, [key], "cut array<struct<length: bigint, ids_crc32: bigint>>", prepare)
    return cut.select(key, F.posexplode("cut").alias("piece", "p")).select(
        key, "piece", (F.col("piece").cast("long") * capacity).alias("start"), "p.length", "p.ids_crc32")


def positions(df: DataFrame, group: str, order: list[str], buckets: int) -> DataFrame:
    """``df`` with rank long: 0, 1, ... within each group; bucket counts spread a large group over many tasks."""
    b = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = b.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = counts.select(group, "_b", (F.sum("_n").over(Window.partitionBy(group).orderBy("_b")) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order)) - 1
    return b.withColumn("_i", inner).join(before, [group, "_b"]).withColumn("rank", F.col("_i") + F.col("_before")).drop("_b", "_i", "_before")


def pack(pieces_: DataFrame, capacity: int, key: str = "doc_id", groups: int = 12, buckets: int = 64) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset.  The input is read twice: give a written table."""
    counts = {r["length"]: r["n"] for r in pieces_.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    table = plan(counts, capacity, groups)
    span = 1 << 42  # more pieces than one length can have
    starts = table[:, 0] * span + table[:, 1]
    ranked = positions(pieces_, "length", [key, "piece", "ids_crc32"], buckets)
    names = [key, "piece", "start", "length", "ids_crc32"]
    schema = [pieces_.schema[c] for c in names] + fields("sequence_id bigint, offset bigint")
    from pyspark.sql.types import StructType

    def place(batches):
        for b in batches:
            length, rank = (np.asarray(b.column(i)) for i in (3, 5))
            row = table[np.searchsorted(starts, length * span + rank, "right") - 1] if len(length) else table[:0]
            j = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(row[:, 4] + j // row[:, 3]), pa.array(row[:, 5] + j % row[:, 3] * length)], names=[f.name for f in schema])
    return ranked.select(*names, "rank").mapInArrow(place, StructType(schema))


def pack_documents(df: DataFrame, path: str, capacity: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokenize, cut and pack; one row for each piece. The pieces are written once to the shared folder."""
    return pack(materialise(pieces(df, path, capacity, text, key), "pieces"), capacity, key)
