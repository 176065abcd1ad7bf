"""Suffix-array dedup: distributed merge sort of front-coded suffix runs.

Texts are UTF-8 bytes. A byte goes if a string of `length` bytes that covers it
also starts earlier (smaller id, or same document and earlier start).

Documents are dealt into runs of some megabytes by a hash of the id; that is the
only shuffle of text. A run sorts what it has, strips what neighbours share, and
sends it to buckets; a bucket merges the runs and answers each of them.

The suffixes of all positions are far too many to send, so it is settled first
which can matter, as in prefix-doubling merge sort, where strings are first told
apart by hashes of prefixes:
 1. each string of `length` bytes owns the least `gram`-byte sequence in it (its
    anchor, by hash; one position in forty). Runs send their distinct anchors,
    sorted and front-coded; only anchors that occur twice stay.
 2. the strings that an anchor owns start one after another; they and the anchor
    are its context. Contexts are compared by hash in the same way; of equal ones
    the earliest stays, and all strings of the others are repeats.
 3. what is left are contexts that share an anchor and differ further out. Their
    suffixes from the anchor on are sorted, front-coded and exchanged; buckets
    combine the runs with a loser tree that knows how much each head shares with
    the last winner and compares bytes only from there. From the shared lengths
    of the merged order follows which suffixes agree for long enough, and from
    the bytes before the anchor which whole strings do.
Strings, anchors and contexts that are equal within a run are sent once, so a
passage of which there are many copies costs one entry a run. Suffixes of one
anchor with different contexts do meet in a bucket.

Nulls: a null text is empty; rows with a null id come last in the order. Ids are
integers; for rows with equal ids the order is undefined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

_LAST = (1 << 63) - 1
_RUN_BYTES = 6 << 20
_CHUNK = 1 << 20


def packed(keys: np.ndarray) -> bytes:
    """Sorted distinct longs, front-coded: differences without leading zeros."""
    step = np.diff(keys, prepend=np.uint64(0))
    size = np.ones(len(keys), np.int64)
    for k in range(1, 8):
        size += step >= np.uint64(1) << np.uint64(8 * k)
    raw = step.astype("<u8").view(np.uint8)
    return size.astype(np.uint8).tobytes() + K.gathered(raw, 8 * np.arange(len(keys)), size).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    size = raw[:n].astype(np.int64)
    wide = np.zeros(8 * n, np.uint8)
    wide[np.repeat(8 * np.arange(n), size) + K.ragged(size)] = raw[n:]
    return np.cumsum(wide.view("<u8").astype(np.uint64))


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """runs: sorted strings and how many bytes each shares with the one before.
    The merged order as (run, place), and the same shared lengths for it."""
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * k
    shared = [0] * k
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))

    def play(i: int, j: int) -> tuple[int, int]:
        a, b = heads[i], heads[j]
        if b is None:
            return i, j
        if a is None:
            return j, i
        if shared[i] != shared[j]:
            return (i, j) if shared[i] > shared[j] else (j, i)
        p, m = shared[i], min(len(a), len(b))
        differ = int.from_bytes(a[p:m]) ^ int.from_bytes(b[p:m])
        p = m - (differ.bit_length() + 7) // 8 if differ else m
        first = len(a) <= len(b) if p == m else a[p] < b[p]
        if p == m and len(a) == len(b):
            first = i < j
        win, lose = (i, j) if first else (j, i)
        shared[lose] = p
        return win, lose

    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if k > 1 else 0
    order, common = [], []
    while heads[best] is not None:
        order.append((best, place[best]))
        common.append(shared[best])
        place[best] += 1
        at, (strings, own) = place[best], runs[best]
        heads[best] = strings[at] if at < len(strings) else None
        shared[best] = own[at] if at < len(strings) else 0
        node = (best + k) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2
    return order, common


class Run:
    """The documents of a run, and the anchors of their strings."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        ids = np.array([_LAST if x is None else x for x in table.column("__id").to_pylist()], np.int64)
        order = np.argsort(ids, kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        self.column = table.column("__id")
        self.ids = ids[order]
        self.data, self.off = K.texts(table.column("__text"))
        self.length, self.gram = length, gram
        found = []
        i, n = 0, len(self.off) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.off, self.off[i] + _CHUNK, side="right")) - 1)
            base = self.off[i]
            found.append(self._scan(self.data[base : self.off[j]], self.off[i : j + 1] - base, base))
            i = j
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2
        self.at, self.low, self.high, self.anchor, self.context = parts
        self.row = np.searchsorted(self.off, self.at, side="right") - 1

    def _scan(self, data: np.ndarray, off: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
        n, length = len(data), self.length
        if n < length:
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
        poly = K.byte_poly(data)
        grams = poly.grams(self.gram)
        bits = np.uint64(max(24, n.bit_length()))
        keys = grams >> bits << bits | np.arange(len(grams), dtype=np.uint64)
        least = K.sliding(keys, length - self.gram + 1, np.minimum) & ((np.uint64(1) << bits) - np.uint64(1))
        starts = np.arange(n - length + 1)
        starts = starts[starts + length <= np.repeat(off[1:], np.diff(off))[: len(starts)]]
        own = least[starts].astype(np.int64)
        if not len(own):
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
        change = np.flatnonzero(np.diff(own)) + 1
        first, last = np.concatenate([[0], change]), np.append(change, len(own)) - 1
        at, low, high = own[first], starts[first], starts[last]
        context = K.mix(poly.of(low, high + length) ^ K.mix((at - low).astype(np.uint64)))
        return at + base, low + base, high + base, K.mix(grams[at]), context  # anchors are low hashes: mixed, they fill all buckets

    def place(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and place in the document of anchors."""
        return self.ids[self.row[which]], self.at[which] - self.off[self.row[which]]

    def repeated(self, answers: dict[int, bytes], buckets: int) -> np.ndarray:
        """Anchors (places in self.at) that occur twice or more somewhere."""
        keys = np.unique(self.anchor)
        keys = keys[_bits(answers, _ranges(keys, buckets))]
        at = np.searchsorted(keys, self.anchor)
        return np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, max(0, len(keys) - 1))] == self.anchor)) if len(keys) else np.empty(0, np.int64)


def _ranges(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """The buckets that sorted keys fall into, with the range of each."""
    if not len(keys):
        return []
    own = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    start = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
    return list(zip(own[start].tolist(), start.tolist(), [*start[1:].tolist(), len(keys)], strict=True))


def _bits(answers: dict[int, bytes], ranges: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(ranges[-1][2] if ranges else 0, bool)
    for b, i, j in ranges:
        if b in answers:
            out[i:j] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=j - i).astype(bool)
    return out


_SENT = "bucket int, run int, n int, keys binary, more binary"
_ANSWER = "run int, round int, bucket int, bits binary"


def _rows(kind: str, rows: list[tuple]) -> pa.Table:
    types = {"int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in kind.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table([pa.array(list(c), types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


class Rounds:
    """What runs and buckets do in each round, for given lengths."""

    def __init__(self, length: int, gram: int, buckets: int):
        self.length, self.gram, self.buckets = length, gram, buckets

    def _known(self, answers: pa.Table) -> dict[int, dict[int, bytes]]:
        out: dict[int, dict[int, bytes]] = {1: {}, 2: {}, 3: {}}
        for r, b, raw in zip(*[answers.column(c).to_pylist() for c in ("round", "bucket", "bits")], strict=True):
            out[r][b] = raw
        return out

    def _number(self, key: tuple) -> int:
        return key[0].as_py()

    # round 1: anchors
    def send_anchors(self, key: tuple, table: pa.Table) -> pa.Table:
        run = Run(table, self.length, self.gram)
        keys, count = np.unique(run.anchor, return_counts=True)
        return _rows(_SENT, [(b, self._number(key), int(j - i), squeezed(packed(keys[i:j])), np.packbits(count[i:j] > 1).tobytes()) for b, i, j in _ranges(keys, self.buckets)])

    def answer_anchors(self, key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        runs = [unpacked(unsqueezed(r["keys"]), r["n"]) for r in rows]
        here = [np.unpackbits(np.frombuffer(r["more"], np.uint8), count=r["n"]).astype(bool) for r in rows]
        merged = np.concatenate(runs)
        merged.sort(kind="stable")  # runs are sorted: this merges them
        twice = np.unique(merged[1:][merged[1:] == merged[:-1]])
        out = []
        for r, own, multi in zip(rows, runs, here, strict=True):
            at = np.searchsorted(twice, own)
            hit = multi | ((at < len(twice)) & (np.append(twice, np.uint64(0))[at] == own))
            out.append((r["run"], 1, r["bucket"], np.packbits(hit).tobytes()))
        return _rows(_ANSWER, out)

    # round 2: contexts
    def send_contexts(self, key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        run = Run(table, self.length, self.gram)
        which = run.repeated(self._known(answers)[1], self.buckets)
        keys, first = np.unique(run.context[which], return_index=True)
        ids, at = run.place(which[first])
        return _rows(_SENT, [(b, self._number(key), int(j - i), squeezed(packed(keys[i:j])), squeezed(ids[i:j].tobytes() + at[i:j].tobytes())) for b, i, j in _ranges(keys, self.buckets)])

    def answer_contexts(self, key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.concatenate([unpacked(unsqueezed(r["keys"]), r["n"]) for r in rows])
        place = [np.frombuffer(unsqueezed(r["more"]), np.int64).reshape(2, -1) for r in rows]
        ids, at = np.concatenate([p[0] for p in place]), np.concatenate([p[1] for p in place])
        order = np.lexsort([at, ids, keys])
        first = np.zeros(len(keys), bool)
        sorted_ = keys[order]
        first[order[np.concatenate([[True], sorted_[1:] != sorted_[:-1]])]] = True
        stop = np.cumsum([r["n"] for r in rows])
        return _rows(_ANSWER, [(r["run"], 2, r["bucket"], np.packbits(first[e - r["n"] : e]).tobytes()) for r, e in zip(rows, stop, strict=True)])

    def _earliest(self, run: Run, known: dict[int, dict[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Repeated anchors, and those of them that are the first of their
        context, in the order in which suffixes are sent."""
        which = run.repeated(known[1], self.buckets)
        keys, first = np.unique(run.context[which], return_index=True)
        heads = which[first[_bits(known[2], _ranges(keys, self.buckets))]]
        return which, heads[np.argsort(run.anchor[heads], kind="stable")]

    def _sorted(self, run: Run, heads: np.ndarray) -> list[tuple[int, np.ndarray, list[bytes]]]:
        """For each bucket, its heads in the order of their suffixes."""
        raw = run.data.tobytes()
        out = []
        for b, i, j in _ranges(run.anchor[heads], self.buckets):
            own = heads[i:j]
            strings = [raw[a:e] for a, e in zip(run.at[own].tolist(), (run.high[own] + self.length).tolist(), strict=True)]
            ids, at = run.place(own)
            order = sorted(range(len(own)), key=lambda k: (strings[k], ids[k], at[k]))
            out.append((b, own[order], [strings[k] for k in order]))
        return out

    # round 3: suffixes
    def send_suffixes(self, key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        run = Run(table, self.length, self.gram)
        _, heads = self._earliest(run, self._known(answers))
        raw, rows = run.data.tobytes(), []
        for b, own, strings in self._sorted(run, heads):
            shared, rest, last = [], [], b""
            for s in strings:
                m = min(len(s), len(last))
                differ = int.from_bytes(s[:m]) ^ int.from_bytes(last[:m])
                p = m - (differ.bit_length() + 7) // 8 if differ else m
                shared.append(p)
                rest.append(s[p:])
                last = s
            ids, at = run.place(own)
            left = [raw[x:y] for x, y in zip(run.low[own].tolist(), run.at[own].tolist(), strict=True)]
            numbers = np.concatenate([ids, at, shared, [len(x) for x in rest], [len(x) for x in left], run.at[own] - run.high[own]]).astype(np.int64)
            rows.append((b, self._number(key), len(own), squeezed(b"".join(rest) + b"".join(left)), squeezed(numbers.tobytes())))
        return _rows(_SENT, rows)

    def answer_suffixes(self, key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        runs, numbers, lefts = [], [], []
        for r in rows:
            num = np.frombuffer(unsqueezed(r["more"]), np.int64).reshape(6, -1)
            text = unsqueezed(r["keys"])
            strings, last, pos = [], b"", 0
            for p, n in zip(num[2].tolist(), num[3].tolist(), strict=True):
                last = last[:p] + text[pos : pos + n]
                strings.append(last)
                pos += n
            runs.append((strings, num[2].tolist()))
            lefts.append(text[pos:])
            numbers.append(num)
        order, shared = merge(runs)
        base = np.cumsum([0] + [r["n"] for r in rows])
        flat = np.array([base[r] + i for r, i in order], np.int64)
        all_ = np.concatenate(numbers, axis=1)[:, flat]
        ids, at, left, d_low = all_[0], all_[1], all_[4], all_[5]
        d_high = left  # a string starts at the first byte of the context at the earliest
        poly = K.byte_poly(np.frombuffer(b"".join(lefts), np.uint8))
        left_end = np.cumsum(np.concatenate([n[4] for n in numbers]))[flat]
        rank = np.empty(len(flat), np.int64)
        rank[np.lexsort([at, ids])] = np.arange(len(flat))
        by_rank = np.argsort(rank)
        common = np.array(shared, np.int64)
        gone = np.zeros((len(flat), self.length - self.gram + 1), bool)
        for d in range(self.length - self.gram + 1):
            own = by_rank[(d_low[by_rank] <= d) & (d <= d_high[by_rank])]
            if len(own) < 2:
                continue
            group = np.cumsum(common < self.length - d)[own]
            keys = K.mix(poly.of(left_end[own] - d, left_end[own]) + K.mix(group.astype(np.uint64)))
            _, first = np.unique(keys, return_index=True)
            again = np.ones(len(own), bool)
            again[first] = False
            gone[own[again], d] = True
        out = np.zeros_like(gone)
        out[flat] = gone
        return _rows(_ANSWER, [(r["run"], 3, r["bucket"], squeezed(np.packbits(out[i : i + r["n"]], axis=1).tobytes())) for r, i in zip(rows, base[:-1].tolist(), strict=True) if out[i : i + r["n"]].any()])

    # what goes
    def cut(self, key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        run = Run(table, self.length, self.gram)
        known = self._known(answers)
        which, heads = self._earliest(run, known)
        steps = np.zeros(len(run.data) + 1, np.int32)
        later = np.setdiff1d(which, heads, assume_unique=True)
        np.add.at(steps, run.low[later], 1)
        np.add.at(steps, run.high[later] + self.length, -1)
        if known[3]:
            width = self.length - self.gram + 1
            for b, own, _ in self._sorted(run, heads):
                if b in known[3]:
                    bits = np.unpackbits(np.frombuffer(unsqueezed(known[3][b]), np.uint8).reshape(len(own), -1), axis=1, count=width)
                    i, d = np.nonzero(bits)
                    np.add.at(steps, run.at[own[i]] - d, 1)
                    np.add.at(steps, run.at[own[i]] - d + self.length, -1)
        gone = np.cumsum(steps[:-1]) > 0
        raw = run.data.tobytes()
        spans, kept = [], []
        removed = np.concatenate([[0], np.cumsum(gone)])
        for a, b in zip(run.off[:-1].tolist(), run.off[1:].tolist(), strict=True):
            if removed[b] == removed[a]:
                spans.append([])
                kept.append(raw[a:b])
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8)))
            spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            kept.append(run.data[a:b][~gone[a:b]].tobytes())
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return pa.table([run.column, pa.array(np.diff(run.off)), pa.array(removed[run.off[1:]] - removed[run.off[:-1]]), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["__id", "n_bytes", "n_removed", "spans", "kept"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 20) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, spans (maximal removed runs
    of bytes as [begin, end)) and kept (the remaining bytes)."""
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    total = base.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    runs = max(1, -(-total // _RUN_BYTES))
    step = Rounds(length, gram, runs)
    text = base.withColumn("run", F.pmod(F.xxhash64("__id"), F.lit(runs)).cast("int")).repartition(runs, "run")

    def answered(sent: DataFrame, f) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(lambda key, table: f(key, table), _ANSWER)

    def again(known: DataFrame, f, schema: str) -> DataFrame:
        return text.groupBy("run").cogroup(known.repartition(runs, "run").groupBy("run")).applyInArrow(lambda key, table, answers: f(key, table, answers), schema)

    one = answered(text.groupBy("run").applyInArrow(lambda key, table: step.send_anchors(key, table), _SENT), step.answer_anchors)
    two = one.union(answered(again(one, step.send_contexts, _SENT), step.answer_contexts))
    three = two.union(answered(again(two, step.send_suffixes, _SENT), step.answer_suffixes))
    out = "__id long, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary"
    return again(three, step.cut, out).withColumnRenamed("__id", id_col)
