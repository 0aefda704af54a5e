"""Byte-pair encoding and decoding with the vocabulary file of a public tokenizer.

Method: a word is held as part boundaries with the rank of each adjacent pair beside them.  The smallest rank is looked
for, its boundary is deleted, and the two neighbouring ranks are looked up anew, until no pair can merge.  All distinct
short words of one length are worked on side by side as a numpy matrix, one deletion a step, so every row keeps the
same number of parts.  Words over ``LONG`` bytes take the same steps with a heap, since repeated scans would be
quadratic there.  Distinct words are remembered in a bounded cache.

Texts: null counts as empty; empty texts give no ids; the two special-token strings in a text become their ids, as the
library does; ties between equal ranks go to the leftmost pair; repeated rows are encoded alike; whole texts of any
length are encoded.  Normalising (NFC, lower case) and splitting follow the file: a byte-class pass for texts of Latin
letters and common punctuation, the tokenizer's own normalizer and splitter for all other texts.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm import bytetext as bt
from tidemark.llm.textmap import lists, over_texts, worker_cache

#: Words of more bytes use the heap and are not cached.
LONG = 48
#: Distinct words kept; beyond it the cache starts anew (memory only, results are the same).
CACHE = 600_000
_NONE = np.int32(1 << 30)
#: Texts outside these ranges (or with the one letter whose lower case is two characters) use the general splitter.
_OTHER = r"[^\x{00}-\x{12F}\x{131}-\x{24F}\x{2010}-\x{2027}]"
#: Endings that are split off after a lone apostrophe, in the order of the pattern.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_SPACE, _LETTER, _NUMBER, _SYMBOL = 0, 1, 2, 3


def _code_classes() -> np.ndarray:
    c = np.full(0x250, _SYMBOL, np.uint8)
    for i in range(0x250):
        kind = unicodedata.category(chr(i))[0]
        c[i] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _SYMBOL
    c[[*range(9, 14), 0x20, 0x85, 0xA0]] = _SPACE
    return c


def _byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [rest.get(b, chr(b)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        letters = _byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + end] for c in letters], np.int32)
        left, right, to = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]], np.int64).T
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.to = key[order], order.astype(np.int32), to.astype(np.int32)
        self.merged = np.zeros(len(key), np.int32)  # by rank
        self.merged[self.rank] = self.to[order]
        bits = 20
        self.shift = np.uint64(64 - bits)
        slot = self._slot(self.keys)
        by = np.argsort(slot, kind="stable")
        self.keys, self.rank = self.keys[by], self.rank[by]
        self.at = np.searchsorted(slot[by], np.arange((1 << bits) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.at).max())
        self.keys = np.append(self.keys, np.full(self.deepest, -1))
        self.rank = np.append(self.rank, np.full(self.deepest, _NONE, np.int32))
        self.path, self.library = path, None
        self.classes = _code_classes()
        self.id_text = pa.array([f"{i} " for i in range(size)], pa.large_string())
        self.token_text = pa.array([f"{t} " for t in self.tokens], pa.large_string())
        self._empty_cache()

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, _NONE where no merge exists."""
        key = left.astype(np.int64) << 20 | right
        at, out = self.at[self._slot(key)], np.full(key.shape, _NONE, np.int32)
        for k in range(self.deepest):
            hit = self.keys[at + k] == key
            out[hit] = self.rank[(at + k)[hit]]
        return out

    # -- words ---------------------------------------------------------------------------------------------------

    def _merge_rows(self, parts: np.ndarray, emit) -> None:
        """parts: one row for each word of the same length; emit(rows, ids) is called as rows come to an end."""
        rows = np.arange(len(parts))
        near = self.ranks(parts[:, :-1], parts[:, 1:])
        while len(rows):
            if parts.shape[1] == 1:
                emit(rows, parts)
                return
            best = near.argmin(1)
            low = near[np.arange(len(rows)), best]
            going = low < _NONE
            if not going.all():
                emit(rows[~going], parts[~going])
                rows, parts, near, best, low = (x[going] for x in (rows, parts, near, best, low))
                if not len(rows):
                    return
            i, cols = np.arange(len(rows)), np.arange(parts.shape[1] - 1)
            parts = np.where(cols <= best[:, None], parts[:, :-1], parts[:, 1:])
            parts[i, best] = self.merged[low]
            near = np.where(cols[:-1] < best[:, None], near[:, :-1], near[:, 1:])
            b = np.flatnonzero(best > 0)
            near[b, best[b] - 1] = self.ranks(parts[b, best[b] - 1], parts[b, best[b]])
            a = np.flatnonzero(best < parts.shape[1] - 1)
            near[a, best[a]] = self.ranks(parts[a, best[a]], parts[a, best[a] + 1])

    def _merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        pair = lambda i: (int(self.ranks(np.array([parts[i]]), np.array([parts[after[i]]]))[0]), i, parts[i], parts[after[i]])
        first = self.ranks(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(first) if r < _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = int(self.merged[r]), False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (x := pair(k))[0] < _NONE:
                    heapq.heappush(heap, x)
        return [p for p, ok in zip(parts, alive) if ok]

    def _empty_cache(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_at = np.zeros(0, np.int64)
        self.known_n = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        """Encode words that are not in the cache and add them."""
        if len(self.known) + len(h) > CACHE:
            self._empty_cache()
        size, at = end - start, np.zeros(len(h), np.int64)
        flat: list[np.ndarray] = []
        count, total = np.zeros(len(h), np.int64), len(self.ids)
        for n in np.unique(size):
            here = np.flatnonzero(size == n)
            raw = data[start[here][:, None] + np.arange(n)]
            parts = self.inner[raw]
            parts[:, -1] = self.final[raw[:, -1]]

            def emit(rows, ids, here=here):
                nonlocal total
                at[here[rows]] = total + np.arange(len(rows)) * ids.shape[1]
                count[here[rows]] = ids.shape[1]
                flat.append(ids.ravel())
                total += ids.size
            self._merge_rows(parts, emit)
        self.ids = np.concatenate([self.ids, *flat])
        known = np.concatenate([self.known, h])
        order = np.argsort(known, kind="stable")
        self.known, self.known_at, self.known_n = known[order], np.concatenate([self.known_at, at])[order], np.concatenate([self.known_n, count])[order]

    def words_to_ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and how many each word has."""
        short = end - start <= LONG
        own = np.flatnonzero(short)
        h = bt.run_hashes(bt._BYTE_CODE[data], start[own], end[own], bt._BASE)
        distinct, example, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > CACHE:
            self._empty_cache()
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != distinct[inside]
        if new.any():
            e = own[example[new]]
            self._learn(data, start[e], end[e], distinct[new])
            place = np.searchsorted(self.known, distinct)
        n, src = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        pool = self.ids
        if len(own):
            n[own], src[own] = self.known_n[place][which], self.known_at[place][which]
        for w in np.flatnonzero(~short):
            raw = data[start[w]:end[w]]
            long = self._merge_long([*self.inner[raw[:-1]].tolist(), int(self.final[raw[-1]])])
            n[w], src[w] = len(long), len(pool)
            pool = np.append(pool, np.array(long, np.int32))
        ends = np.cumsum(n)
        return pool[np.repeat(src - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], n

    # -- texts ---------------------------------------------------------------------------------------------------

    def _latin_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data, offsets = bt.data_of(pc.utf8_lower(texts))
        n = len(data)
        kind = self.classes[data]  # right for ASCII
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
        kind[lead] = kind[lead + 1] = self.classes[(data[lead].astype(np.int32) & 0x1F) << 6 | data[lead + 1] & 0x3F]
        wide = np.flatnonzero(data >= 0xE0)
        kind[wide] = kind[wide + 1] = kind[wide + 2] = _SYMBOL
        inside = (data & 0xC0) == 0x80  # not the first byte of a character
        begin = np.zeros(n + 1, bool)
        if n:
            begin[0] = True
            begin[1:n] = (kind[1:] != kind[:-1]) | ((kind[1:] == _NUMBER) & ~inside[1:])
        begin[offsets] = True
        # a lone apostrophe with one of the endings: one word, and what follows begins another
        quote = np.flatnonzero((data == 0x27) & begin[:n])
        quote = quote[begin[quote + 1]]
        stop = offsets[np.searchsorted(offsets, quote, "right")]
        open_ = np.ones(len(quote), bool)
        for e in ENDINGS:
            raw = e.encode()
            fits = open_ & (quote + len(raw) < stop)
            for k, b in enumerate(raw):
                fits[fits] = data[quote[fits] + 1 + k] == b
            begin[quote[fits] + 1] = False
            begin[quote[fits] + 1 + len(raw)] = True
            open_ &= ~fits
        start = np.flatnonzero(begin[:n])
        end = np.append(start[1:], n)
        word = kind[start] != _SPACE if n else np.zeros(0, bool)
        start, end = start[word], end[word]
        return data, start, end, np.searchsorted(start, offsets)

    def _general_ids(self, text: str) -> np.ndarray:
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_file(self.path)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        code = {c: b for b, c in enumerate(_byte_alphabet())}
        words = [bytes(code[c] for c in w) for w, _ in pieces]
        if not words:
            return np.zeros(0, np.int32)
        ends = np.cumsum([len(w) for w in words])
        return self.words_to_ids(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1]), ends)[0]

    def _marked_ids(self, text: str) -> np.ndarray:
        """A text with special-token strings in it: the parts between them are encoded on their own."""
        out = []
        while text:
            found = min(((at, -len(s), s) for s in self.special if (at := text.find(s)) >= 0), default=None)
            before = text if found is None else text[:found[0]]
            if before:
                out.append(self._general_ids(before))
            if found is None:
                break
            out.append(np.array([self.special[found[2]]], np.int32))
            text = text[found[0] + len(found[2]):]
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets (texts + 1) of a slice of texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _OTHER)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = np.asarray(odd)
        data, start, end, first = self._latin_words(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        ids, n = self.words_to_ids(data, start, end)
        sums = np.append(0, np.cumsum(n))
        offsets = sums[first]
        if not odd.any():
            return ids, offsets
        parts, counts = [], np.diff(offsets)
        for d in range(len(texts)):
            part = self._marked_ids(texts[d].as_py()) if odd[d] else ids[offsets[d]:offsets[d + 1]]
            counts[d] = len(part)
            parts.append(part)
        return np.concatenate(parts), np.append(0, np.cumsum(counts))

    def spelled(self, ids: np.ndarray, table: pa.Array) -> tuple[memoryview, np.ndarray]:
        """Bytes of the texts of all ids, each with a space after it, and the byte offset of each id."""
        out = table.take(pa.array(ids))
        data, offsets = bt.data_of(out)
        return memoryview(np.ascontiguousarray(data)), offsets

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode without a decoder: the tokens, joined by a space."""
        return " ".join(self.tokens[i] for i in ids)

    def decode_words(self, ids: np.ndarray) -> str:
        """The words themselves: bytes restored, word ends as spaces, special tokens as they stand."""
        code, out = {c: b for b, c in enumerate(_byte_alphabet())}, []
        names = set(self.special)
        for t in (self.tokens[i] for i in ids):
            if t in names:
                out.append(t.encode() + b" ")
            else:
                end = t.endswith("</w>")
                out.append(bytes(code[c] for c in (t[:-4] if end else t)) + b" " * end)
        return b"".join(out).decode("utf-8", "replace").rstrip(" ")


def load(path: str) -> Bpe:
    """The encoder of a vocabulary file, kept by the Python worker from task to task."""
    return worker_cache(f"bpe {path}", lambda: Bpe(path))


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """Columns ``keep``, ids array<int> and, if asked for, decoded string (the ids as the library's decode gives them)."""
    def prepare():
        b = load(path)

        def work(texts):
            ids, offsets = b.encode(texts)
            out = [lists(ids, offsets)]
            if decoded:
                data, at = b.spelled(ids, b.token_text)
                raw = [data[at[x]:max(at[x], at[y] - 1)] for x, y in zip(offsets[:-1], offsets[1:])]
                out.append(pa.array([bytes(x) for x in raw], pa.binary()).cast(pa.string()))
            return out
        return work
    return over_texts(df, text, list(keep), "ids array<int>" + ", decoded string" * decoded, prepare)


def decode(df: DataFrame, path: str, ids: str = "ids", words: bool = True) -> DataFrame:
    """``df`` with decoded string: the words again, or with words=False the tokens as the library's decode joins them.

    A null array decodes to null; a column named decoded is replaced."""
    from pyspark.sql import functions as F
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def spell(col):
        b = load(path)
        one = b.decode_words if words else b.decode
        return col.map(lambda x: None if x is None else one([int(i) for i in x]))
    return df.withColumn("decoded", spell(F.col(ids)))
