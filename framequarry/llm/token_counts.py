"""Token counts of every prefix, by dynamic programming.

A sequence of tokens is what the merges give if and only if every two
neighbours are: so the last token of a prefix is the one token that ends there
and goes with the last token of what is before it, and the count of a prefix is
one more than that of the shorter one. Run over the bytes of a word, this gives
the count of all its prefixes in one pass, and the counts at the ends of words
add up along a text. Whether text fits a budget, and where to cut it, is then a
search in stored counts.

Two tokens go together if no merge across their border comes before the merges
that complete them: both are taken apart along the border, latest merge first,
and each pair that stands there is looked up. All of this runs on arrays, for
all new words of a chunk at once; counts of words are kept in a cache of
bounded size by 64-bit hash.

The vocabulary marks the last symbol of a word, so each byte of a word has two
states: the word goes on, or it ends there. Words of Latin letters up to U+017F,
digits and signs are worked out many at once. The others (further letters,
apostrophes, special strings, runs of over 64 bytes) are few: short ones are
counted by the tokenizers library prefix by prefix; long ones are normalised and
split as the library does, each match of up to 64 bytes is counted at each of its
characters, and longer matches, of any length, go through the dynamic program
byte by byte. So every prefix that ends between two characters has its count.

Nulls count as empty: no bytes, no tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .bpe import LETTER, NUMBER, OTHER, Cache, classes, decoded_points

_NONE = np.int64(1) << 40
_MOST = 64
_loaded: dict[str, object] = {}


def _begins(c: str) -> bool:
    """Whether normalising what is before a character never needs it."""
    return c < "\u0300" or not (unicodedata.category(c)[0] == "M" or unicodedata.combining(c) or "\u1160" <= c <= "\u11ff" or "\ud7b0" <= c <= "\ud7ff")


def _bytes_of_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Longs to longs, by open addressing, for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int):
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros((1 << bits) + 256, np.uint64)
        self.values = np.full((1 << bits) + 256, _NONE, np.int64)
        at, todo, self.steps = self._at(keys), np.arange(len(keys)), 0
        while len(todo):
            self.steps += 1
            cand = todo[self.keys[at[todo]] == 0]
            _, one = np.unique(at[cand], return_index=True)
            put = cand[one]
            self.keys[at[put]] = keys[put]
            self.values[at[put]] = values[put]
            todo = np.setdiff1d(todo, put)
            at[todo] += 1

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys (none is zero), _NONE where there is none."""
        at = self._at(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], _NONE)
        todo = np.flatnonzero((found != keys) & (found != 0))
        for step in range(1, self.steps):
            if not len(todo):
                break
            found = self.keys[at[todo] + step]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]] + step]
            todo = todo[~hit & (found != 0)]
        return out


class Vocabulary:
    """A byte-level vocabulary with word ends, and what goes together in it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        sign = _bytes_of_signs()
        n = max(vocab.values()) + 1
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.rank = np.full(n, -1, np.int64)  # of the merge that makes it; -1: a byte
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]], np.int64)
        self.left[pairs[:, 2]], self.right[pairs[:, 2]] = pairs[:, 0], pairs[:, 1]
        self.rank[pairs[:, 2]] = np.arange(len(pairs))
        self.merge = PairTable(self._key(pairs[:, 0], pairs[:, 1]), np.arange(len(pairs)), 19)
        together = self._together(pairs[:, 0], pairs[:, 1], top=False)
        self.whole = np.ones(n, bool)  # tokens that their own bytes lead to
        for (a, b, c), ok in zip(pairs.tolist(), together.tolist(), strict=True):
            self.whole[c] = ok and self.whole[a] and self.whole[b]
        text, ids, ends = [], [], []
        for w, i in vocab.items():
            if w.startswith("<|") or not self.whole[i]:
                continue
            last = w.endswith(end)
            b = bytes(sign[c] for c in (w[: -len(end)] if last else w))
            text.append(b)
            ids.append(i)
            ends.append(last)
        data = np.frombuffer(b"".join(text), np.uint8)
        stop = np.cumsum([len(b) for b in text])
        length = np.array([len(b) for b in text])
        hashes = K.byte_poly(data).of(stop - length, stop) | np.uint64(1)
        ids, ends = np.array(ids), np.array(ends)
        self.inner = PairTable(hashes[~ends], ids[~ends], 18)
        self.final = PairTable(hashes[ends], ids[ends], 18)
        self.longest = int(length.max())
        self.words = Cache()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.normal: dict[str, str] = {}
        self.counted: dict[str, int] = {}
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) + np.uint64(1)) << np.uint64(24) | b.astype(np.uint64)

    def _together(self, a: np.ndarray, b: np.ndarray, top: bool = True) -> np.ndarray:
        """Whether the merges keep a and b apart (top: also after both are whole)."""
        x, y = a.copy(), b.copy()
        x_until, y_until = np.full(len(x), _NONE), np.full(len(x), _NONE)  # rank of the merge that takes it up
        good = np.ones(len(x), bool)
        live = np.arange(len(x))
        first = not top
        while len(live):
            if not first:
                r = self.merge.get(self._key(x[live], y[live]))
                # of equal merges the leftmost is made first
                bad = (r < x_until[live]) & (r <= y_until[live]) & (r < _NONE)
                good[live[bad]] = False
                live = live[~bad]
            first = False
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            more = (rx >= 0) | (ry >= 0)
            live, rx, ry = live[more], rx[more], ry[more]
            undo = rx > ry
            i, j = live[undo], live[~undo]
            x_until[i], y_until[j] = rx[undo], ry[~undo]
            x[i], y[j] = self.right[x[i]], self.left[y[j]]
        return good

    def runs(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the prefixes of runs of bytes (each as a word that ends
        there), one after another; runs have 64 bytes at most."""
        out = np.zeros(lengths.sum(), np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        low = 0
        for high in (4, 8, 12, 16, 24, 40, _MOST):
            own = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            for i in range(0, len(own), 1 << 14):
                rows = own[i : i + (1 << 14)]
                got = self._table(data, starts[rows], lengths[rows], high)
                real = np.arange(high) < lengths[rows][:, None]
                out[np.repeat(begin[rows], lengths[rows]) + K.ragged(lengths[rows])] = got[real]
        return out, lengths

    def _table(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
        n = len(starts)
        at = np.minimum(starts[:, None] + np.arange(width), len(data) - 1)
        flat = K.byte_poly(data[at].ravel())
        base = np.arange(n) * width
        last = np.full((n, width + 1), -1, np.int64)
        count = np.zeros((n, width + 1), np.int64)
        ends = np.zeros((n, width), np.int64)
        for i in range(1, width + 1):
            rows = np.flatnonzero(lengths >= i)
            for table, inner in ((self.inner, True), (self.final, False)):
                todo = rows
                for size in range(min(i, self.longest), 0, -1):
                    if not len(todo):
                        break
                    h = flat.of(base[todo] + i - size, base[todo] + i) | np.uint64(1)
                    token = table.get(h)
                    hit = np.flatnonzero(token < _NONE)
                    if not len(hit):
                        continue
                    before = last[todo[hit], i - size]
                    ok = np.full(len(hit), i == size)
                    know = np.flatnonzero(before >= 0)
                    ok[know] = self._together(before[know], token[hit[know]])
                    took = hit[ok]
                    if inner:
                        last[todo[took], i] = token[took]
                        count[todo[took], i] = count[todo[took], i - size] + 1
                    else:
                        ends[todo[took], i - 1] = count[todo[took], i - size] + 1
                    todo = np.delete(todo, took)
        return ends

    def _apart(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            found = self.pairs[a, b] = bool(self._together(np.array([a]), np.array([b]))[0])
        return found

    def long_run(self, run: bytes) -> list[int]:
        """Counts of the prefixes of one run of any length. What tokens may end
        at a byte is looked up for some thousand bytes at once."""
        flat, n = K.byte_poly(np.frombuffer(run, np.uint8)), len(run)
        last, count, out = [-1] * (n + 1), [0] * (n + 1), [0] * n
        for low in range(0, n, 4096):
            ends = np.arange(low, min(n, low + 4096)) + 1
            found: list[list[list[tuple[int, int]]]] = [[[], []] for _ in ends]
            for size in range(min(self.longest, int(ends[-1])), 0, -1):
                own = ends[ends >= size]
                h = flat.of(own - size, own) | np.uint64(1)
                for k, table in enumerate((self.inner, self.final)):
                    token = table.get(h)
                    hit = np.flatnonzero(token < _NONE)
                    for e, t in zip(own[hit].tolist(), token[hit].tolist(), strict=True):
                        found[e - low - 1][k].append((size, t))
            for e in ends.tolist():
                for k in (0, 1):
                    for size, t in found[e - low - 1][k]:
                        before = last[e - size]
                        if e == size or before >= 0 and self._apart(before, t):
                            if k:
                                out[e - 1] = count[e - size] + 1
                            else:
                                last[e], count[e] = t, count[e - size] + 1
                            break
        return out

    def _count(self, text: str) -> int:
        """Tokens of a normalised piece of text."""
        found = self.counted.get(text)
        if found is None:
            if len(self.counted) > 1 << 18:
                self.counted.clear()
            found = sum(len(self.library.model.tokenize(p)) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text))
            self.counted[text] = found
        return found

    def _normal(self, text: str) -> str:
        found = self.normal.get(text)
        if found is None:
            if len(self.normal) > 1 << 18:
                self.normal.clear()
            found = self.normal[text] = self.library.normalizer.normalize_str(text)
        return found

    def long_word(self, word: str) -> list[int]:
        """Counts of the prefixes of a word, one for each character."""
        out: list[int] = []
        total, begin = 0, 0
        for special in [*self.special.finditer(word), None]:
            total, tail = self._section(word[begin : special.start() if special else len(word)], total, out)
            if special:
                # a special string that isn't whole is text, and goes on where the text before it stopped
                shown = special.group()
                out += [total - self._count(tail) + self._count(tail + self._normal(shown[:k])) for k in range(1, len(shown))]
                total, begin = total + 1, special.end()
                out.append(total)
        return out

    def _section(self, text: str, total: int, out: list[int]) -> tuple[int, str]:
        """Append total and the count at each character of text; the new total
        and the last match."""
        if not text:
            return total, ""
        fresh = [i for i, c in enumerate(text) if i == 0 or _begins(c)]
        atoms = [text[a:b] for a, b in zip(fresh, [*fresh[1:], len(text)], strict=True)]
        whole = [self._normal(a) for a in atoms]
        norm = "".join(whole)
        matches = [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(norm)]
        starts, before, runs = [a for a, _ in matches], [total], []
        for a, b in matches:
            own, run = norm[a:b], None
            if len(own.encode()) > _MOST:
                got = self.long_run(own.encode())
                run = [0, *(got[end - 1] for end in accumulate(len(c.encode()) for c in own))]
            runs.append(run)
            before.append(before[-1] + (run[-1] if run else self._count(own)))

        def at(stop: int, more: str) -> int:
            """Count of norm[:stop] + more."""
            m = bisect_right(starts, stop - (not more)) - 1
            if m < 0:
                return total + self._count(more)
            a, b = matches[m]
            if runs[m] and not more and stop <= b:
                return before[m] + runs[m][stop - a]
            return before[m] + self._count(norm[a:stop] + more)

        place = 0
        for atom, own in zip(atoms, whole, strict=True):
            out += [at(place, self._normal(atom[:k])) for k in range(1, len(atom))]
            place += len(own)
            out.append(at(place, ""))
        return before[-1], norm[starts[-1] :] if starts else ""

    def new_words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word, the count at each of its bytes (-1: not known there)."""
        flat = K.gathered(data, starts, lengths)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        point, at = decoded_points(flat)
        owner = np.searchsorted(begin, at, side="right") - 1
        kind = classes()[point]
        odd = (point > 0x17F) | (point == 0x27) | (point == 0x130) | ((kind != LETTER) & (kind != NUMBER) & (kind != OTHER))
        odd[:-1] |= (point[:-1] == 0x3C) & (point[1:] == 0x7C)
        plain = np.ones(len(starts), bool)
        plain[owner[odd]] = False
        fresh = np.ones(len(point), bool)
        fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | (owner[1:] != owner[:-1])
        run_at = at[fresh]
        run_len = np.diff(np.append(run_at, len(flat)))
        run_of = owner[fresh]
        plain[run_of[run_len > _MOST]] = False
        low = np.array([ord(chr(c).lower()) if c != 0x130 else c for c in range(0x180)])
        small = point < 0x180
        to = low[np.minimum(point, 0x17F)]
        flat = flat.copy()
        one, two = small & (point < 0x80), small & (point >= 0x80)
        flat[at[one]] = to[one]
        flat[at[two]], flat[at[two] + 1] = 0xC0 | to[two] >> 6, 0x80 | to[two] & 0x3F
        keep = plain[run_of]
        run_at, run_len, run_of = run_at[keep], run_len[keep], run_of[keep]
        out = np.full(len(flat), -1, np.int64)
        if len(run_at):
            # the same run is worked out once
            h = K.byte_poly(flat).of(run_at, run_at + run_len)
            _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            got, n = self.runs(flat, run_at[first], run_len[first])
            stop = np.cumsum(n)
            whole = got[stop - 1][inverse]
            total = np.cumsum(whole)
            head = np.searchsorted(run_of, run_of)
            before = total - whole - np.concatenate([[0], total])[head]
            here = np.repeat(run_at, run_len) + K.ragged(run_len)
            out[here] = K.gathered(got, (stop - n)[inverse], run_len) + np.repeat(before, run_len)
        inside = np.flatnonzero((flat[1:] & 0xC0) == 0x80)
        out[inside] = -1  # a character goes on
        rest = np.flatnonzero(~plain)
        if len(rest):
            raw = K.gathered(data, starts[rest], lengths[rest]).tobytes()
            texts, where, pos = [], [], 0
            for w in rest.tolist():
                b = raw[pos : pos + lengths[w]]
                pos += int(lengths[w])
                stops = [k for k in range(1, len(b) + 1) if k == len(b) or (b[k] & 0xC0) != 0x80]
                if len(b) > _MOST:
                    got = self.long_word(b.decode("utf-8", "replace"))
                    if len(got) == len(stops):  # otherwise the bytes aren't UTF-8
                        out[begin[w] + np.array(stops) - 1] = got
                        continue
                texts += [b[:k].decode("utf-8", "replace") for k in stops]
                where += [int(begin[w]) + k - 1 for k in stops]
            if texts:
                out[where] = [len(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)]
        return out, lengths

    def counts(self, data: np.ndarray, words: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """For each word the place of its counts in the cache's pool, and its length."""
        h = words.hashes()
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        size = words.end - words.start
        at, n = self.words.find(keys, lambda miss: self.new_words(data, words.start[first[miss]], size[first[miss]]))
        return at[inverse], n[inverse]


def _batches(path: str, limit: int, curve: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary.of(path)
        for batch in batches:
            for part, data, off in K.pieces(batch, "__text"):
                words = K.Words(data, off)
                at, n = own.counts(data, words)
                pool = own.words.pool
                whole = pool[at + n - 1].astype(np.int64) if len(at) else np.empty(0, np.int64)
                total = np.concatenate([[0], np.cumsum(whole)])
                tokens = total[words.first[1:]] - total[words.first[:-1]]
                size = np.diff(off)
                cut = size.copy()
                for i in np.flatnonzero(tokens > limit):
                    a, b = words.first[i], words.first[i + 1]
                    k = int(np.searchsorted(total[a + 1 : b + 1] - total[a], limit, side="right")) + a  # the first word that doesn't fit
                    room = limit - (total[k] - total[a])
                    inner = pool[at[k] : at[k] + n[k]]
                    fits = np.flatnonzero((inner >= 0) & (inner <= room))
                    cut[i] = words.start[k] - off[i] + (fits[-1] + 1 if len(fits) else 0)
                out = [part.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit), pa.array(cut)]
                if curve:
                    ends = pa.array(words.first.astype(np.int32))
                    out.append(pa.ListArray.from_arrays(ends, pa.array((words.end - off[words.text]).astype(np.int32))))
                    out.append(pa.ListArray.from_arrays(ends, pa.array((total[1:] - total[words.first[words.text]]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["__id", "n_bytes", "n_tokens", "over_limit", "cut_bytes", *(["ends", "totals"] if curve else [])])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", curve: bool = False) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, cut_bytes): cut_bytes is the longest
    prefix, in bytes, that has limit tokens at most. With curve also ends and
    totals: the byte at which each word ends and the tokens up to there."""
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = base.schema["__id"].dataType.simpleString()
    schema = f"__id {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long" + ", ends array<int>, totals array<int>" * curve
    return base.mapInArrow(_batches(path, limit, curve), schema).withColumnRenamed("__id", id_col)
