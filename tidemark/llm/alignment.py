"""Cross-tokenizer alignment: which tokens of two vocabularies end together, and how often each pair does, corpus-wide.

A (byte-level BPE) encodes space + text, B (sentencepiece BPE) encodes text and adds that space itself.  Byte offsets at
which a token of either ends cut a text into groups; the two tokens that end there are a link.

Method: external spill counting.  Executors encode slices of whole documents and sort each slice's links by (B id, A id,
document).  Cut by a radix of the B id, these pair-document records become zstd runs, written once to the shared
folder.  Runs of one radix group meet; a heap over the heads of their blocks merges them k ways, and pairs are
counted as soon as no run can hold more of them.  The merged order is B-major, so the greatest count of a B id is known when its
pairs end.  A second reading streams contributions back: each run meets its group's counts in the same order and gives sums
for the documents of its slice, which are added up by slice.

Skew: a radix with more than ``GROUP`` records (one B id may hold a third of all links) is dealt to several tasks by
slice; their counts are merged in levels of ``FAN``.  Such a table has at most 64 B ids times all A ids, whatever the corpus.
Pairs are counted within a slice before they are shuffled.  Only record counts by radix (500 numbers) reach the driver.

Defined results: null and empty texts, and texts that either tokenizer does not give back byte by byte (the second one
rewrites some characters), have no tokens: zeros and an empty string.  Repeated rows and rows with equal or null keys count
each on their own; strings of special tokens in a text are plain text; an empty table gives no rows; columns besides key
and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.llm import bytetext as bt
from tidemark.llm.bpe import _byte_alphabet
from tidemark.llm.textmap import trim, worker_cache
from tidemark.sources.workspace import materialise

#: Bytes of text sorted together, records of a group, runs merged at once, entries of a block.
SLICE = 2 << 20
GROUP = 1_000_000
FAN = 16
BLOCK = 1 << 16
_A_BITS, _RADIX_BITS = 17, 6
#: Fixed value: how byte-level vocabularies of this family split a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts outside these ranges, or with very long runs of white space, are left to the vocabulary file's own splitter.
_OTHER = r"[^\x{00}-\x{24F}\x{2010}-\x{2027}]|\s{500}"


# -- runs ------------------------------------------------------------------------------------------------------------


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers, byte planes of as few bytes as the greatest needs, under zstd."""
    out = []
    for x in arrays:
        x = x.astype("<u8")
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        out += [len(x).to_bytes(4, "little"), bytes([width]), np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8)[:, :width].T).tobytes()]
    return zstandard.compress(b"".join(out), 1)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    while at < len(raw):
        n, width = int.from_bytes(raw[at:at + 4], "little"), raw[at + 4]
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 5).reshape(width, n).T
        out.append(x.reshape(-1).view("<i8"))
        at += 5 + n * width
    return out


def _deltas(key: np.ndarray) -> np.ndarray:
    return np.diff(key, prepend=0)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n[order], first) if len(key) else n


def merge_counts(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way merge of packed (keys, counts) runs by a heap over block heads: sorted keys, each once, with its total.

    A run is unpacked when the heap comes to it; what is held are the blocks that overlap the least head.
    """
    heads = []
    for i, blob in enumerate(runs):
        first = int.from_bytes(blob[:8], "little")
        heads.append((first, i, 0))
    heapq.heapify(heads)
    open_: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    keys, counts, held = [], [], 0
    while heads:
        _, i, at = heapq.heappop(heads)
        if at == 0:
            delta, n = _unpacked(runs[i][8:])
            open_[i] = (np.cumsum(delta), n)
        key, n = open_[i]
        keys.append(key[at:at + BLOCK])
        counts.append(n[at:at + BLOCK])
        held += len(keys[-1])
        if at + BLOCK < len(key):
            heapq.heappush(heads, (int(key[at + BLOCK]), i, at + BLOCK))
        else:
            del open_[i]
        if heads and held < 8 * BLOCK:
            continue
        k, n = _summed(np.concatenate(keys), np.concatenate(counts))
        done = len(k) if not heads else int(np.searchsorted(k, heads[0][0]))  # no run holds more of these
        if done:
            yield k[:done], n[:done]
        keys, counts, held = [k[done:]], [n[done:]], len(k) - done


def _run(key: np.ndarray, n: np.ndarray) -> bytes:
    return (int(key[0]) if len(key) else 0).to_bytes(8, "little") + _packed(_deltas(key), n)


# -- encoding ----------------------------------------------------------------------------------------------------------


class Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a: str, a_ranks: str | None, b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.fast = None
        if a_ranks:
            with open(a_ranks, "rb") as f:
                ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        code = {c: i for i, c in enumerate(_byte_alphabet())}
        with open(a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        spelled = [b""] * (1 + max(vocabulary.values()))
        for t, i in vocabulary.items():
            spelled[i] = bytes(code[c] for c in t) if all(c in code for c in t) else t.encode()
        self.a_bytes = pa.array(spelled, pa.large_binary())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], pa.large_binary())
        self.a_size, self.b_size = (np.asarray(pc.binary_length(x)).astype(np.int64) for x in (self.a_bytes, self.b_bytes))
        n, m = len(spelled), len(pieces)
        # how an id is written where it stands inside a group, and where it ends its side
        self.written = pa.array([f"{i}," for i in range(n)] + [f"{i}|" for i in range(n)] + [f"{i}," for i in range(m)] + [f"{i};" for i in range(m)], pa.large_string())

    def encode(self, texts: list[str], other: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        plain = [np.asarray(self.fast.encode_ordinary(" " + t), np.int64) if self.fast is not None and not o else np.array(self.a.encode(" " + t, add_special_tokens=False).ids, np.int64) for t, o in zip(texts, other)]
        return plain, [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.cumsum([0, *map(len, parts)])


def _faithful(ids: list[np.ndarray], table: pa.Array, size: np.ndarray, want: list[bytes]) -> np.ndarray:
    """Which id lists spell the wanted bytes."""
    flat, at = _joined(ids)
    raw, _ = _bytes_of(table.take(pa.array(flat)))
    ends = np.append(0, np.cumsum(size[flat]))[at]
    data = memoryview(np.ascontiguousarray(raw))
    return np.array([data[x:y] == w for x, y, w in zip(ends[:-1], ends[1:], want)], bool)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def aligned(pair: Pair, texts: pa.Array, spell: bool) -> tuple[dict[str, object], np.ndarray, np.ndarray]:
    """Columns of a slice of texts, and key (B id and A id) and text of each link."""
    values = [t or "" for t in texts.to_pylist()]
    some = np.array([i for i, t in enumerate(values) if t], np.int64)
    chosen = [values[i] for i in some]
    other = np.asarray(pc.match_substring_regex(pa.array(chosen, pa.large_string()), _OTHER)) if chosen else np.zeros(0, bool)
    a_ids, b_ids = pair.encode(chosen, other)
    want = [b" " + t.encode() for t in chosen]
    good = _faithful(a_ids, pair.a_bytes, pair.a_size, want) & _faithful(b_ids, pair.b_bytes, pair.b_size, want)
    some = some[good]
    (a, a_at), (b, b_at) = (_joined([x for x, g in zip(ids, good) if g]) for ids in (a_ids, b_ids))
    a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    total = int(a_end[-1]) if len(a) else 0
    mark = np.zeros(total + 1, np.int8)
    mark[a_end] += 1
    mark[b_end] += 2
    a_last, b_last = mark[a_end] == 3, mark[b_end] == 3
    ia, ib = np.flatnonzero(a_last), np.flatnonzero(b_last)
    doc = np.searchsorted(a_at, ia, "right") - 1
    links = np.bincount(doc, minlength=len(some))
    n, m = len(pair.a_size), len(pair.b_size)
    # A tokens of a group, then its B tokens
    group_a, group_b = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    written = np.empty(len(a) + len(b), np.int64)
    written[np.arange(len(a)) + np.append(0, ib + 1)[group_a]] = a + n * a_last
    written[np.arange(len(b)) + ia[group_b] + 1] = 2 * n + b + m * b_last
    raw, offsets = _bytes_of(pair.written.take(pa.array(written)).cast(pa.large_binary()))
    data, bounds = memoryview(np.ascontiguousarray(raw)), offsets[a_at + b_at]
    spans = [data[x:max(x, y - 1)] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    groups = [""] * len(values)
    for i, s in zip(some.tolist(), spans):
        groups[i] = bytes(s).decode() if spell else hashlib.sha256(s).hexdigest()
    full = lambda x: np.bincount(some, weights=x, minlength=len(values)).astype(np.int64) if len(some) else np.zeros(len(values), np.int64)
    columns = {"n_a": full(np.diff(a_at)), "n_b": full(np.diff(b_at)), "n_groups": full(links), "n_links": full(links), "groups": groups}
    return columns, b[ib] << _A_BITS | a[ia], some[doc]


def _records(key: np.ndarray, doc: np.ndarray, n_docs: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(radix, records, run of pairs and their counts, documents of each pair) of a slice."""
    bits = max(1, int(n_docs).bit_length())
    both, times = np.unique(key << bits | doc, return_counts=True)
    key, doc = both >> bits, both & (1 << bits) - 1
    radix = key >> _A_BITS + _RADIX_BITS
    cut = np.flatnonzero(np.append(True, radix[1:] != radix[:-1])) if len(key) else np.zeros(0, np.int64)
    for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(key)]):
        k, d, t = key[x:y], doc[x:y], times[x:y]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        yield int(radix[x]), y - x, _run(k[first], np.add.reduceat(t, first)), _packed(np.diff(np.append(first, y - x)), d, t - 1)


_DOC = "slice bigint, at int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string"
_RUN = "radix int, records bigint, pairs binary, docs binary"


def spill(docs: DataFrame, a: str, a_ranks: str | None, b: str, key: str, text: str, spell: bool) -> DataFrame:
    """Encoded slices, written once: a row for each document (at is not null) and one for each run."""
    fields = [docs.schema[key], *StructType.fromDDL(_DOC).fields, *StructType.fromDDL(_RUN).fields]
    schema = StructType([StructField("__key", fields[0].dataType), *fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        pair = worker_cache(f"pair {a} {b}", lambda: Pair(a, a_ranks, b))
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in bt.slices(batch.column(1), SLICE):
                columns, keys, doc = aligned(pair, batch.column(1).slice(lo, hi - lo), spell)
                runs = list(zip(*_records(keys, doc, hi - lo))) or [(), (), (), ()]
                n, m = hi - lo, len(runs[0])
                none = lambda c, k: pa.nulls(k, arrow.field(c).type)
                made = {"__key": [batch.column(0).slice(lo, n), none("__key", m)], "slice": [pa.array(np.full(n + m, number), pa.int64())], "at": [pa.array(np.arange(n), pa.int32()), none("at", m)]}
                made |= {c: [pa.array(v, arrow.field(c).type), none(c, m)] for c, v in columns.items()}
                made |= {c: [none(c, n), pa.array(v, arrow.field(c).type)] for c, v in zip(("radix", "records", "pairs", "docs"), runs)}
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([x.cast(f.type) for x in made[f.name]]) for f in arrow], schema=arrow)
                number += 1
            trim()
    return materialise(docs.select(docs[key].alias("__key"), docs[text].cast("string").alias("__text")).mapInArrow(run, schema), "runs")


# -- counting ----------------------------------------------------------------------------------------------------------


def _dealt(runs: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Runs with their group g and part s, and the number of parts of each group of more than one."""
    sizes = {r["radix"]: r["n"] for r in runs.groupBy("radix").agg(F.sum("records").alias("n")).collect()}  # one number a radix
    group, parts, held = [0] * (1 + max(sizes, default=0)), {0: 1}, 0
    for r in sorted(sizes):
        if held and held + sizes[r] > GROUP:
            parts[len(parts)], held = 1, 0
        group[r], held = len(parts) - 1, held + sizes[r]
        parts[group[r]] = max(1, -(-held // GROUP))
    at = lambda values, i: F.element_at(F.array(*(F.lit(v) for v in values)), i)
    g = at(group, F.col("radix") + 1)
    return runs.select("slice", "radix", "pairs", "docs", g.alias("g")).withColumn("s", F.pmod(F.xxhash64("slice"), at([parts[k] for k in sorted(parts)], F.col("g") + 1)).cast("int")), parts


def _merged(table: pa.Table) -> pa.Table:
    runs = table.column("pairs").to_pylist()
    keys, counts = zip(*merge_counts(runs))
    return pa.table({"g": table.column("g")[:1], "s": table.column("s")[:1], "pairs": pa.array([_run(np.concatenate(keys), np.concatenate(counts))], pa.binary())})


def _finished(table: pa.Table) -> pa.Table:
    """All pairs of a group with their totals, and whether a total is the greatest of its B id."""
    keys, counts = (np.concatenate(x) for x in zip(*merge_counts(table.column("pairs").to_pylist())))
    b = keys >> _A_BITS
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    most = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(b))))
    return pa.table({"g": table.column("g")[:1], "counts": pa.array([_packed(_deltas(keys), counts, (counts == most).astype(np.int64))], pa.binary())})


def totals(dealt: DataFrame, parts: dict[int, int]) -> DataFrame:
    """(g, counts): the counted pairs of each group, written once."""
    some = dealt.select("g", "s", "pairs").groupBy("g", "s").applyInArrow(_merged, "g int, s int, pairs binary")
    width = max(parts.values())
    while width > FAN:
        some = some.withColumn("s", F.expr(f"s div {FAN}").cast("int")).groupBy("g", "s").applyInArrow(_merged, "g int, s int, pairs binary")
        width = -(-width // FAN)
    return materialise(some.groupBy("g").applyInArrow(_finished, "g int, counts binary"), "pair-counts")


def _returned(left: pa.Table, right: pa.Table) -> pa.Table:
    """What the runs of a group give back to the documents of their slices."""
    delta, total, best = _unpacked(right.column("counts")[0].as_py())
    keys, by_slice = np.cumsum(delta), {}
    order = np.argsort(np.asarray(left.column("radix")), kind="stable").tolist()  # B-major, as the counts are
    slices, pairs, docs = (left.column(c) for c in ("slice", "pairs", "docs"))
    for i in order:
        own, _ = _unpacked(pairs[i].as_py()[8:])
        n, doc, times = _unpacked(docs[i].as_py())
        at = np.repeat(np.searchsorted(keys, np.cumsum(own)), n)
        by_slice.setdefault(slices[i].as_py(), []).append((doc, (times + 1) * total[at], (times + 1) * best[at]))
    names, blobs = [], []
    for name, parts in by_slice.items():
        doc, sums, hits = (np.concatenate(x) for x in zip(*parts))
        blobs.append(_packed(*_by_doc(doc, sums, hits)))
        names.append(name)
    return pa.table({"slice": pa.array(names, pa.int64()), "given": pa.array(blobs, pa.binary())})


def _by_doc(doc: np.ndarray, sums: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(doc, kind="stable")
    d = doc[order]
    first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
    return d[first], np.add.reduceat(sums[order], first), np.add.reduceat(hits[order], first)


def _added(table: pa.Table) -> pa.Table:
    doc, sums, hits = _by_doc(*(np.concatenate(x) for x in zip(*(_unpacked(g.as_py()) for g in table.column("given")))))
    return pa.table({"slice": pa.array(np.full(len(doc), table.column("slice")[0].as_py()), pa.int64()), "at": pa.array(doc, pa.int32()), "count_sum": sums, "n_best": hits})


def align(docs: DataFrame, a: str, b: str, a_ranks: str | None = None, key: str = "doc_id", text: str = "text", spell: bool = False) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups: with spell=True the groups themselves, otherwise their SHA-256.

    ``a_ranks`` names the ranks of the same vocabulary as ``a``, a quicker way to the same ids for most texts.
    """
    rows = spill(docs, a, a_ranks, b, key, text, spell)
    dealt, parts = _dealt(rows.where("radix IS NOT NULL"))
    counted = totals(dealt, parts)
    width = F.element_at(F.array(*(F.lit(parts[k]) for k in sorted(parts))), F.col("g") + 1)
    there = counted.withColumn("s", F.explode(F.sequence(F.lit(0), width - 1))).select("g", "s", "counts")
    given = dealt.groupBy("g", "s").cogroup(there.groupBy("g", "s")).applyInArrow(_returned, "slice bigint, given binary")
    sums = given.groupBy("slice").applyInArrow(_added, "slice bigint, at int, count_sum bigint, n_best bigint")
    own = rows.where("at IS NOT NULL").join(sums, ["slice", "at"], "left")
    return own.select(F.col("__key").alias(key), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups")


def pair_counts(docs: DataFrame, a: str, b: str, a_ranks: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The alignment table itself: b, a, n, best (n is the greatest of its b)."""
    dealt, parts = _dealt(spill(docs, a, a_ranks, b, key, text, False).where("radix IS NOT NULL"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                delta, n, best = _unpacked(blob.as_py())
                k = np.cumsum(delta)
                yield pa.RecordBatch.from_arrays([pa.array(k >> _A_BITS), pa.array(k & (1 << _A_BITS) - 1), pa.array(n), pa.array(best > 0)], names=["b", "a", "n", "best"])
    return totals(dealt, parts).select("counts").mapInArrow(spread, "b bigint, a bigint, n bigint, best boolean")
