"""Benchmark decontamination: word windows of test items found in documents by a generalised suffix automaton.

Method: the normalised words of the items (A-Z lowered, runs of digits, a-z and characters from U+0080 on) go into one
generalised suffix automaton.  Document words are streamed through it; at each word the state and the longest matching
length are known.  A length of ``size`` and more ends an occurrence of a window, and the state's ancestor that holds the
last ``size`` words tells, by its subtree in the link tree, which items have that window.  An item of fewer words is
one window; its end state is looked for among the ancestors too.  ``without_leaks`` then removes the spans whose longest
match reaches a length and marks documents whose covered share exceeds a limit.

How it runs: documents are never shuffled.  A word whose pair with the word before it stands in no item leaves the
automaton at depth one, so numpy finds the stretches in between from the automaton's first two levels, and all stretches
of a slice are streamed side by side.  Words of a stretch are compared byte by byte with the items' words, not by hash
alone.  An automaton holds about ``PART_WORDS`` item words, by a hash of the item; a larger benchmark makes
several automata, built by executors, each met by one pass over the documents, so that memory has a bound at any size.

Defined results: null and empty texts have no words; an item without words has no window; rows with equal item ids are
texts of one item; an item with a null id covers words but is neither counted nor named; repeated documents are each
judged; an empty benchmark covers nothing; columns besides key, text, item id and item text are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import bytetext as bt
from tidemark.llm.textmap import over_texts, trim
from tidemark.sources.workspace import materialise

#: Item words of one automaton: about 100 bytes of arrays each.
PART_WORDS = 400_000
_FILTER_BITS = 20


class Automaton:
    """Arrays of a generalised suffix automaton over item words.

    texts: words of each item; ids: its id or None.  Transitions are sorted keys state * words + word.
    """

    FIELDS = ("hash", "spell", "at", "key", "to", "root", "link", "length", "anchor", "short", "tin", "tout", "end_tin", "end_item", "whole_at", "whole_n", "whole_item", "ids", "numbers")

    @classmethod
    def build(cls, texts: list[list[bytes]], ids: list[str | None], size: int) -> Automaton:
        """``size`` bounds the windows; items of fewer words are kept as whole windows."""
        words = sorted({w for t in texts for w in t})
        number = {w: i for i, w in enumerate(words)}
        step: list[dict[int, int]] = [{}]
        link, length, ends, wholes = [-1], [0], [], []
        for item, text in enumerate(texts):
            last = 0
            for c in (number[w] for w in text):
                last = cls._extend(step, link, length, last, c)
                ends.append((last, item))
            if 0 < len(text) < size:
                wholes.append((last, len(text), item))
        n, v = len(step), max(1, len(words))
        length_, link_ = np.array(length, np.int64), np.array(link, np.int64)
        flat = np.array([(s * v + c, t) for s, d in enumerate(step) for c, t in d.items()], np.int64).reshape(-1, 2)
        flat = flat[np.argsort(flat[:, 0])]
        weight, order = [1] * n, np.argsort(length_, kind="stable").tolist()
        for s in reversed(order[1:]):
            weight[link[s]] += weight[s]
        tin, free = [0] * n, [1] * n
        for s in order[1:]:
            tin[s] = free[link[s]]
            free[link[s]] += weight[s]
            free[s] = tin[s] + 1
        tin_ = np.array(tin, np.int64)
        # the class that holds the last ``size`` words of a state, and the nearest class with whole short items
        anchor, short, own = [-1] * n, [-1] * n, {s for s, _, _ in wholes}
        for s in order[1:]:
            anchor[s] = -1 if length[s] < size else s if length[link[s]] < size else anchor[link[s]]
            short[s] = s if s in own else short[link[s]]
        end = np.array([(tin[s], i) for s, i in ends], np.int64).reshape(-1, 2)
        end = end[np.lexsort((end[:, 1], end[:, 0]))]
        wholes.sort()
        joined = b"".join(words)
        hashes = bt.run_hashes(bt._BYTE_CODE[np.frombuffer(joined, np.uint8)], at := np.cumsum([0, *map(len, words)])[:-1], at + np.array([len(w) for w in words], np.int64), bt._BASE) if words else np.zeros(0, np.uint64)
        by = np.argsort(hashes, kind="stable")
        root = np.zeros(len(words), np.int64)
        for c, t in step[0].items():
            root[c] = t
        return cls(hash=hashes[by], numbers=by, spell=np.frombuffer(joined, np.uint8), at=np.cumsum([0, *map(len, words)]), key=flat[:, 0], to=flat[:, 1], root=root, link=link_, length=length_, tin=tin_,
                   tout=tin_ + np.array(weight), anchor=np.array(anchor), short=np.array(short), end_tin=end[:, 0], end_item=end[:, 1], whole_at=np.array([w[0] for w in wholes], np.int64), whole_n=np.array([w[1] for w in wholes], np.int64),
                   whole_item=np.array([w[2] for w in wholes], np.int64), ids=np.array(["" if i is None else "=" + i for i in ids], np.str_), size=size)

    @staticmethod
    def _extend(step: list[dict[int, int]], link: list[int], length: list[int], last: int, c: int) -> int:
        def split(p: int, q: int) -> int:
            new = len(step)
            step.append(dict(step[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = new
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = new
                p = link[p]
            return new
        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else split(last, q)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else split(p, q)
        return new

    def __init__(self, size: int, **arrays: np.ndarray):
        self.__dict__ |= arrays
        self.size, self.words = size, max(1, len(self.at) - 1)
        self.shortest = min(size, int(self.whole_n.min()) if len(self.whole_n) else size)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.hash >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self._items: dict = {}

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, size=np.array(self.size), **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> Automaton:
        with np.load(io.BytesIO(raw)) as f:
            return cls(int(f["size"]), **{k: f[k] for k in cls.FIELDS})

    # -- streaming -------------------------------------------------------------------------------------------------

    def _numbers(self, h: np.ndarray) -> np.ndarray:
        """Number of each word by its hash, -1 for words of no item."""
        out = np.full(len(h), -1, np.int64)
        some = np.flatnonzero(self.maybe[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if len(some) and len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, h[some]), len(self.hash) - 1)
            out[some] = np.where(self.hash[at] == h[some], self.numbers[at], -1)
        return out

    def _next(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        want = state * self.words + word
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.to[at], -1)

    def _stretches(self, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of item words of one text in which each adjacent pair stands in an item."""
        inside = number >= 0
        joined = np.zeros(len(number), bool)
        joined[1:] = inside[1:] & inside[:-1]
        joined[first[:-1][first[:-1] < len(number)]] = False
        pairs = np.flatnonzero(joined)
        joined[pairs] = self._next(self.root[number[pairs - 1]], number[pairs]) >= 0
        start = np.flatnonzero(inside & ~joined)
        stop = np.flatnonzero(inside & ~np.append(joined[1:], False)) + 1
        own = stop - start >= self.shortest
        return start[own], stop[own]

    def _same(self, words: bt.Words, at: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether words of the slice are spelled like the item words they stand for."""
        size, there = words.end[at] - words.start[at], self.at[number]
        same = size == self.at[number + 1] - there
        size = np.where(same, size, 0)
        row = np.repeat(np.arange(len(at)), size)
        j = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        bad = words.data[words.start[at][row] + j] != self.spell[there[row] + j]
        same[row[bad]] = False
        return same

    def stream(self, words: bt.Words) -> tuple[np.ndarray, np.ndarray]:
        """State and longest matching length at each word; both are 0 where no window can end."""
        state, longest = np.zeros(len(words.start), np.int64), np.zeros(len(words.start), np.int64)
        if not len(self.key) or not len(words.start):
            return state, longest
        number = self._numbers(words.hashes())
        while True:
            start, stop = self._stretches(number, words.first)
            size = stop - start
            at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            other = ~self._same(words, at, number[at])
            if not other.any():
                break
            number[at[other]] = -1
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        s, m = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        live = len(start)
        for j in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size[:live], -j, "left"))
            here, now, most = start[:live] + j, s[:live].copy(), m[:live].copy()
            c = number[here]
            to = self._next(now, c)
            lost = np.flatnonzero(to < 0)
            while len(lost):
                now[lost] = self.link[now[lost]]
                most[lost] = self.length[now[lost]]
                to[lost] = self._next(now[lost], c[lost])
                lost = lost[to[lost] < 0]
            s[:live], m[:live] = to, most + 1
            state[here], longest[here] = to, most + 1
        return state, longest

    def _items_below(self, s: int) -> np.ndarray:
        if s not in self._items:
            lo, hi = np.searchsorted(self.end_tin, [self.tin[s], self.tout[s]])
            self._items[s] = np.unique(self.end_item[lo:hi])
        return self._items[s]

    def occurrences(self, state: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(last word, number of words, items) of every occurrence of a window."""
        at, size, items = [], [], []
        full = np.flatnonzero(longest >= self.size)
        at.append(full)
        size.append(np.full(len(full), self.size))
        items += [self._items_below(int(a)) for a in self.anchor[state[full]]]
        some = np.flatnonzero(state > 0)
        up = self.short[state[some]]
        some, up = some[up >= 0], up[up >= 0]
        while len(some):
            lo, hi = np.searchsorted(self.whole_at, up), np.searchsorted(self.whole_at, up, "right")
            n = hi - lo
            row = np.repeat(np.arange(len(some)), n)
            w = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            fits = self.whole_n[w] <= longest[some[row]]
            row, w = row[fits], w[fits]
            at.append(some[row])
            size.append(self.whole_n[w])
            items += [self.whole_item[i:i + 1] for i in w]
            up = self.short[self.link[up]]
            some, up = some[up >= 0], up[up >= 0]
        return np.concatenate(at), np.concatenate(size), items


def _item_rows(items: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """part-sized pieces of items: id, words.  An item longer than a part is cut so that every window stays in one piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = bt.split(b.column(1), bt.ALNUM, lower=True)
            ids, pieces = [], []
            for d in range(len(w.first) - 1):
                lo, hi = int(w.first[d]), int(w.first[d + 1])
                for a in range(lo, max(lo + 1, hi - size + 1), PART_WORDS):
                    z = min(hi, a + PART_WORDS + size - 1)
                    if z > a:
                        ids.append(b.column(0)[d].as_py())
                        pieces.append([w.data[x:y].tobytes() for x, y in zip(w.start[a:z], w.end[a:z])])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pieces, pa.list_(pa.binary()))], names=["id", "words"])
            trim()
    return items.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id string, words array<binary>")


def automata(items: DataFrame, size: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """(part, automaton): one row for each part of the items, built by executors and written once."""
    rows = _item_rows(items, key, text, size)
    total = rows.agg(F.sum(F.size("words"))).head()[0] or 0
    parts = -(-2 * total // PART_WORDS) if total > PART_WORDS else 1

    def build(table: pa.Table) -> pa.Table:
        a = Automaton.build(table.column("words").to_pylist(), table.column("id").to_pylist(), size)
        return pa.table({"part": table.column("part")[:1], "automaton": pa.array([a.dumps()], pa.binary())})
    dealt = rows.select(F.pmod(F.xxhash64("id", "words"), F.lit(parts)).cast("int").alias("part"), "id", "words")
    return materialise(dealt.groupBy("part").applyInArrow(build, "part int, automaton binary"), "automata")


_FOUND = "n_words bigint, spans array<struct<from: int, to: int, longest: int>>, items array<string>"


def _pass(docs: DataFrame, raw: bytes | None, key: list[str], text: str) -> DataFrame:
    """One pass of the documents through one automaton."""
    kept = None if raw is None else docs.sparkSession.sparkContext.broadcast(raw)  # the size of one part, at most

    def prepare():
        a = None if kept is None else Automaton.loads(kept.value)

        def work(texts):
            words = bt.split(texts, bt.ALNUM, lower=True)
            n = len(words.first) - 1
            spans: list = [[] for _ in range(n)]
            named: list = [[] for _ in range(n)]
            if a is not None:
                state, longest = a.stream(words)
                at, size, items = a.occurrences(state, longest)
                hit = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(hit, at - size + 1, 1)
                np.add.at(hit, at + 1, -1)
                covered = np.cumsum(hit)[:-1] > 0
                doc = np.searchsorted(words.first, at, "right") - 1
                for d in np.unique(doc).tolist():
                    lo, hi = int(words.first[d]), int(words.first[d + 1])
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered[lo:hi].view(np.int8), [0]])))
                    spans[d] = [{"from": int(x), "to": int(y), "longest": int(longest[lo + x:lo + y].max())} for x, y in zip(edge[::2], edge[1::2])]
                    own = {id(i): i for i in (items[k] for k in np.flatnonzero(doc == d))}
                    some = np.unique(np.concatenate(list(own.values())))
                    named[d] = sorted({x[1:] for x in a.ids[some].tolist() if x})
            return [words.counts, pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("longest", pa.int32())]))), pa.array(named, pa.list_(pa.string()))]
        return work
    return over_texts(docs, text, key, _FOUND, prepare)


def scan(docs: DataFrame, items: DataFrame, size: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, columns ``keep``, n_words, n_hit, spans (covered [from, to) in words, with the longest match inside) and items (ids as sorted strings).

    Spans of several automata are merged; ``longest`` is then the greatest of theirs.
    """
    built = automata(items, size, item_key, item_text)
    parts = [r["part"] for r in built.select("part").collect()]  # one number for each part
    raw = lambda p: bytes(built.where(F.col("part") == p).head()["automaton"])
    columns = list(dict.fromkeys([key, *keep]))
    if len(parts) < 2:
        return _counted(_pass(docs, raw(parts[0]) if parts else None, columns, text))
    # rows with equal key and text have equal results: one pass a part, merged by both, and given back to every row
    marked = docs.select(*columns, text, F.xxhash64(text).alias("__text_hash"))
    rows = marked.select(key, "__text_hash", text).dropDuplicates([key, "__text_hash"])
    found = [_pass(rows, raw(p), [key, "__text_hash"], text) for p in parts]
    both = found[0]
    for f in found[1:]:
        both = both.unionByName(f)
    cover = F.array_sort(F.flatten(F.collect_list("spans")))
    grown = F.aggregate(cover, F.array().cast("array<struct<from: int, to: int, longest: int>>"), lambda out, s: F.when(
        (F.size(out) > 0) & (s["from"] <= F.element_at(out, -1)["to"]),
        F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["from"].alias("from"), F.greatest(F.element_at(out, -1)["to"], s["to"]).alias("to"), F.greatest(F.element_at(out, -1)["longest"], s["longest"]).alias("longest"))))
    ).otherwise(F.concat(out, F.array(s))))
    merged = both.groupBy(F.col(key).alias("__key"), F.col("__text_hash").alias("__hash")).agg(
        F.first("n_words").alias("n_words"), grown.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return _counted(marked.drop(text).join(merged, F.col(key).eqNullSafe(F.col("__key")) & F.col("__text_hash").eqNullSafe(F.col("__hash"))).drop("__key", "__hash", "__text_hash"))


def _counted(found: DataFrame) -> DataFrame:
    hits = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["to"] - s["from"]))
    return found.select(*(c for c in found.columns if c not in ("n_words", "spans", "items")), "n_words", hits.alias("n_hit"), "spans", "items")


def without_leaks(docs: DataFrame, items: DataFrame, size: int = 10, longest: int = 10, share: float = 0.5, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), **more) -> DataFrame:
    """key, columns ``keep``, the text without the spans whose longest match has ``longest`` words or more, n_words, n_hit, n_removed and kept.

    kept is false for a document of whose words more than ``share`` are covered.  A removed span takes what stands
    between it and the word before it along; other text stays as it is, a null text null.
    """
    found = scan(docs, items, size, key, text, keep=(*keep, text), **more)

    def prepare():
        inside = bt.ALNUM.copy()
        inside[65:91] = True  # the text is cut as it stands, capitals are letters
        return lambda texts, spans: _cut(texts, spans, inside, longest)
    done = over_texts(found.withColumnRenamed(text, "__whole"), "__whole", [key, *keep, "n_words", "n_hit"], f"`{text}` string, n_removed bigint", prepare, beside=("spans",))
    return done.withColumn("kept", F.col("n_hit") <= F.col("n_words") * share)


def _cut(texts: pa.Array, spans: pa.Array, inside: np.ndarray, longest: int) -> list:
    w = bt.split(texts, inside)
    raw, offsets = memoryview(np.ascontiguousarray(w.data)), w.offsets
    out, gone = [], []
    for d, cut in enumerate(spans.to_pylist()):
        cut = [s for s in cut or [] if s["longest"] >= longest]
        gone.append(sum(s["to"] - s["from"] for s in cut))
        parts, p = [], int(offsets[d])
        for s in cut:
            first = int(w.first[d]) + s["from"]
            if s["from"]:
                parts.append(bytes(raw[p:max(p, int(w.end[first - 1]))]))
            p = int(w.end[int(w.first[d]) + s["to"] - 1])
        out.append(b"".join([*parts, bytes(raw[p:int(offsets[d + 1])])]).decode() if texts[d].is_valid else None)
    return [pa.array(out, pa.string()), np.array(gone, np.int64)]
