"""Byte-level BPE encoding and decoding.

Pre-tokenisation knows no regular expressions. A text becomes an array of
code-point classes (letter, number, white space, other); as the state of the
splitter after a change of class depends on nothing before it, the transition
functions compose to constants there, and an associative scan over them comes
down to comparing neighbours. What looks further (the last white space before a
word, contractions) is settled at the ends of runs.

Slices are hashed where they lie; each task merges pairs only for slices that it
has not met, many at once, and keeps the ids in a cache of bounded size. Byte
offsets of the slices stay in the result, so ids decode in place.

Nulls count as empty texts; an empty text has no ids. Long runs without a
boundary (over 64 bytes) are merged one by one with a heap, in n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_WIDE = 64
_CACHE = 1 << 21
_tables: dict[str, object] = {}


def classes() -> np.ndarray:
    """Class of each code point."""
    if "classes" not in _tables:
        kind = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                kind[c] = LETTER
            elif k == "N":
                kind[c] = NUMBER
        # fixed values: the code points with the property White_Space
        kind[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _tables["classes"] = kind
    return _tables["classes"]


def decoded_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte at which each begins."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    if len(at) == len(data):
        return data.astype(np.int32), at
    size = np.diff(np.append(at, len(data)))
    first = data[at].astype(np.int32)
    point = np.where(size == 1, first, first & (0xFF >> (size + 1)))
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        point[more] = point[more] << 6 | data[at[more] + k] & 0x3F
    return point, at


def slices(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bytes at which a slice begins, over all texts of a chunk."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    point, at = decoded_points(data)
    kind = classes()[point]
    fresh = np.zeros(n + 1, bool)
    fresh[off] = True
    opens = fresh[at]  # first character of a text
    m = len(point)
    start = np.empty(m, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= opens
    # the last white space before other things is a slice of its own, or goes with them if it is a blank
    space = kind == SPACE
    last = np.zeros(m, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~opens[1:]
    after = np.flatnonzero(last)
    start[after] = True
    blank = after[point[after] == 0x20]
    start[blank + 1] = False
    # contractions: an apostrophe that is a run of its own and has no blank before it
    quote = np.flatnonzero(start & (point == 0x27))
    quote = quote[quote + 1 < m]
    quote = quote[(kind[quote + 1] == LETTER) & ~opens[quote + 1]]
    if len(quote):
        end = np.zeros(m + 3, bool)
        end[:m] = opens
        ext = np.concatenate([point, [0, 0, 0]])
        one, two = ext[quote + 1], ext[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        pair &= ~end[quote + 2]
        took = np.where(short, 1, np.where(pair, 2, 0))
        quote, took = quote[took > 0], took[took > 0]
        start[quote + 1] = False
        rest = quote + took + 1
        inside = rest[rest < m]
        inside = inside[(kind[inside] == LETTER) & ~opens[inside]]
        start[inside] = True
    return at[start]


class Ranks:
    """A vocabulary of byte strings with ranks, and the pairs that merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.rank.values()) + 1
        words = [b""] * size
        for w, r in self.rank.items():
            words[r] = w
        self.words = words
        self.size = size
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.pool = np.frombuffer(b"".join(words), np.uint8)
        self.decimal = [str(i) for i in range(size)]
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        left, right, into = [], [], []
        for w, r in self.rank.items():
            for k in range(1, len(w)):
                a, b = self.rank.get(w[:k]), self.rank.get(w[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    into.append(r)
        self.pair = {(a, b): r for a, b, r in zip(left, right, into, strict=True)}
        bits = 22
        self.shift = np.uint64(64 - bits)
        keys = np.array(left, np.uint64) << np.uint64(20) | np.array(right, np.uint64)
        slots = np.zeros((1 << bits) + 64, np.uint64)
        ranks = np.full((1 << bits) + 64, size, np.int64)
        self.steps = 0
        todo = np.arange(len(keys))
        at = self._slot(keys)
        while len(todo):  # open addressing, all keys at once
            self.steps += 1
            free = slots[at[todo]] == 0
            cand = todo[free]
            _, one = np.unique(at[cand], return_index=True)
            put = cand[one]
            slots[at[put]] = keys[put] + np.uint64(1)
            ranks[at[put]] = np.array(into)[put]
            todo = np.setdiff1d(todo, put)
            at[todo] += 1
        self.slots, self.ranks = slots, ranks

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or size where none merges (an id of size: no token)."""
        keys = left.astype(np.uint64) << np.uint64(20) | right.astype(np.uint64)
        at = self._slot(keys)
        out = np.full(len(keys), self.size, np.int64)
        todo = np.arange(len(keys))
        keys = keys + np.uint64(1)
        for step in range(self.steps):
            found = self.slots[at[todo] + step]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]] + step]
            todo = todo[~hit & (found != 0)]
            if not len(todo):
                break
        return out

    def long(self, piece: bytes) -> list[int]:
        """Ids of one slice of any length, by a heap of pairs."""
        if piece in self.rank:
            return [self.rank[piece]]
        ids = [int(self.byte[b]) for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pair.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := self.pair.get((r, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            if (p := before[i]) >= 0 and (x := self.pair.get((ids[p], r))) is not None:
                heapq.heappush(heap, (x, p, ids[p], r))
        return [x for x in ids if x >= 0]

    def many(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of slices, one after another, and how many each has."""
        count = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for high in (4, 8, 12, 16, 24, 40, _WIDE):
            own = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            for i in range(0, len(own), 1 << 15):
                rows = own[i : i + (1 << 15)]
                ids, n = self._matrix(data, starts[rows], lengths[rows], high)
                count[rows] = n
                parts.append((rows, ids, n))
        for r in np.flatnonzero(lengths > _WIDE):
            ids = np.array(self.long(data[starts[r] : starts[r] + lengths[r]].tobytes()), np.int64)
            count[r] = len(ids)
            parts.append((np.array([r]), ids, count[r : r + 1]))
        begin = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(begin[-1], np.int32)
        for rows, ids, n in parts:
            out[np.repeat(begin[rows], n) + K.ragged(n)] = ids
        return out, count

    def _matrix(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for slices of at most width bytes: each round merges the
        leftmost pair of least rank in every row that still has one."""
        n = len(starts)
        cols = np.arange(width)
        real = cols < lengths[:, None]
        ids = np.where(real, self.byte[data[np.minimum(starts[:, None] + cols, len(data) - 1)]], self.size)
        left, right = ids[:, :-1], ids[:, 1:]
        rank = np.full((n, width), self.size, np.int64)
        both = right < self.size
        rank[:, :-1][both] = self.merged(left[both], right[both])
        count = lengths.astype(np.int64).copy()
        live = np.arange(n)
        while len(live):
            sub = rank[live]
            at = sub.argmin(axis=1)
            best = sub[np.arange(len(live)), at]
            go = best < self.size
            live, at, best = live[go], at[go], best[go]
            if not len(live):
                break
            # drop the right part of the pair: move the rest one place left
            src = cols + (cols > at[:, None])
            src = np.minimum(src, width - 1)
            rows = np.arange(len(live))[:, None]
            x, q = ids[live][rows, src], rank[live][rows, src]
            x[:, -1], q[:, -1] = self.size, self.size
            one = np.arange(len(live))
            x[one, at] = best
            q[one, at] = self.size
            for k in (at - 1, at):
                ok = np.flatnonzero((k >= 0) & (k < width - 1))
                ok = ok[x[ok, k[ok] + 1] < self.size]
                q[ok, k[ok]] = self.merged(x[ok, k[ok]], x[ok, k[ok] + 1])
            ids[live], rank[live] = x, q
            count[live] -= 1
        return ids[cols < count[:, None]], count


class Cache:
    """Ids of slices by hash: sorted arrays, so that looking up a batch is one
    merge; dropped whole when it has grown to `limit` slices."""

    def __init__(self, limit: int = _CACHE):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n, self.pool = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)

    def find(self, keys: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """keys: sorted, distinct. Places in the pool and counts; make(indices)
        gives ids and counts of the missing ones."""
        if len(self.keys) > self.limit:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        missing = np.flatnonzero(~known)
        if len(missing):
            ids, n = make(missing)
            at = len(self.pool) + np.concatenate([[0], np.cumsum(n)[:-1]])
            where = place[missing]
            self.keys = np.insert(self.keys, where, keys[missing])
            self.at = np.insert(self.at, where, at)
            self.n = np.insert(self.n, where, n.astype(np.int32))
            self.pool = np.concatenate([self.pool, ids.astype(np.int32)])
            place = np.searchsorted(self.keys, keys)
        return self.at[place], self.n[place].astype(np.int64)


class Encoder:
    def __init__(self, path: str):
        self.ranks = Ranks(path)
        self.cache = Cache()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per Python worker, with its cache."""
        if path not in _tables:
            _tables[path] = cls(path)
        return _tables[path]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, first id of each text (and the end), begin bytes of the slices,
        ids of each slice."""
        begin = slices(data, off)
        if not len(begin):
            return np.empty(0, np.int32), np.zeros(len(off), np.int64), begin, begin
        end = np.append(begin[1:], len(data))
        hashes = K.byte_poly(data).of(begin, end)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at, n = self.cache.find(keys, lambda miss: self.ranks.many(data, begin[first[miss]], (end - begin)[first[miss]]))
        count = n[inverse]
        ids = K.gathered(self.cache.pool, at[inverse], count)
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids, ends[np.searchsorted(begin, off)], begin, count

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids."""
        return K.gathered(self.ranks.pool, self.ranks.starts[ids], self.ranks.lengths[ids])


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder.of(path)
        for batch in batches:
            for part, data, off in K.pieces(batch, "__text"):
                ids, first, begin, count = own.encode(data, off)
                per = np.searchsorted(begin, off)
                local = begin - np.repeat(off[:-1], np.diff(per))
                offsets = pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.array(local.astype(np.int32)))
                out = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                counts = pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.array(count.astype(np.int32)))
                kept = [part.column(i) for i in range(2, part.num_columns)]
                yield pa.RecordBatch.from_arrays([part.column(0), out, offsets, counts, *kept], ["__id", "ids", "offsets", "counts", *part.schema.names[2:]])

    return run


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ids, offsets, counts): ids of the whole text; the byte at which each
    slice begins and how many ids it has, from which any id's bytes are found.
    The columns keep of docs come after them."""
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *keep)
    kind = base.schema["__id"].dataType.simpleString()
    more = "".join(f", {c} {base.schema[c].dataType.simpleString()}" for c in keep)
    return base.mapInArrow(_encoded(path), f"__id {kind}, ids array<int>, offsets array<int>, counts array<int>{more}").withColumnRenamed("__id", id_col)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder.of(path)
        for batch in batches:
            lists = batch.column(1)
            if lists.null_count:
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]).astype(np.int32)), lists.flatten())
            ends = np.asarray(lists.offsets, np.int64)
            ids = np.asarray(lists.values, np.int64)
            texts = [own.decode(ids[a:b]).tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["__id", "bytes"])

    return run


def decoded(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes) of rows with an array of ids (null: no bytes)."""
    base = ids.select(F.col(id_col).alias("__id"), F.col(ids_col).alias("__ids"))
    kind = base.schema["__id"].dataType.simpleString()
    return base.mapInArrow(_decoded(path), f"__id {kind}, bytes binary").withColumnRenamed("__id", id_col)


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder.of(path)
        decimal = own.ranks.decimal
        for batch in batches:
            for part, data, off in K.pieces(batch, "__text"):
                ids, first, _, _ = own.encode(data, off)
                back = own.decode(ids)
                ends = np.concatenate([[0], np.cumsum(own.ranks.lengths[ids])])[first]
                raw = back.tobytes()
                names = [decimal[i] for i in ids.tolist()]
                a, b = first[:-1].tolist(), first[1:].tolist()
                sha = [hashlib.sha256(",".join(names[i:j]).encode()).hexdigest() for i, j in zip(a, b, strict=True)]
                dec = [hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(first[1:] - first[:-1]), pa.array(sha), pa.array(dec)], ["__id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded again in
    one task, so that ids need not leave it."""
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = base.schema["__id"].dataType.simpleString()
    return base.mapInArrow(_round_trip(path), f"__id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("__id", id_col)
