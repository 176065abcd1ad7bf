"""Token-id files with a minimal perfect hash index.

A file is a Parquet table of shards in ascending order of key. A shard holds
the raw ids of its documents one after another (`payload`, little-endian, two
bytes an id where the vocabulary allows, else four), the keys in their order,
and an index: a minimal perfect hash that maps each key to a slot of its own,
and for each slot a fingerprint of the key, the first id and the number of ids.
Finding a document in a shard takes one hash, one displacement and one slot,
whatever the shard's size; the fingerprint tells keys that aren't there.

Documents are dealt by ranges of the key, each task writes shards of a bounded
number of ids, and the first id of a shard in the whole file comes from sums
over shards, never over documents.

The hash is built by displacement: keys fall into buckets of about four; the
fullest buckets choose first, each the least displacement that puts its keys on
free slots; buckets of one key take the free slots that are left over.

Nulls: a null text is empty, so it has the end id alone. Rows with a null key
come first, count as ids before the others, and can't be looked up. Of rows with
equal keys the index finds the first in each shard; all are stored and read back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .bpe import Cache
from .storage import stored

_SHARD = "part int, seq int, first_key long, last_key long, n_docs long, n_ids long, width int, keys array<long>, lengths array<int>, shift array<int>, slots binary, payload binary"
_SLOT = np.dtype([("print", "<u4"), ("start", "<u4"), ("count", "<u4")])
_loaded: dict[str, object] = {}


class Encoder:
    """Ids by the tokenizers library, word by word: white space always ends a
    token, so a word's ids don't depend on its neighbours, and each word is
    encoded once per worker (as long as the cache, of bounded size, keeps it)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.cache = Cache()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _new(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = data.tobytes()
        texts = [flat[a : a + n].decode("utf-8", "replace") for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        ids, count = [], []
        for i in range(0, len(texts), 20000):
            for e in self.library.encode_batch_fast(texts[i : i + 20000], add_special_tokens=False):
                own = e.ids
                count.append(len(own))
                ids += own
        return np.array(ids, np.int32), np.array(count, np.int64)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the texts, and how many each has."""
        words = K.Words(data, off)
        if not len(words):
            return np.empty(0, np.int32), np.zeros(len(off) - 1, np.int64)
        keys, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        size = words.end - words.start
        at, n = self.cache.find(keys, lambda miss: self._new(data, words.start[first[miss]], size[first[miss]]))
        count = n[inverse]
        total = np.concatenate([[0], np.cumsum(count)])
        return K.gathered(self.cache.pool, at[inverse], count), total[words.first[1:]] - total[words.first[:-1]]


def _spread(keys: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    return (K.mix(K.mix(keys) + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def _bucket(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return (K.mix(keys ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(n_buckets)).astype(np.int64)


def prints(keys: np.ndarray) -> np.ndarray:
    return (K.mix(keys ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)


def perfect_hash(keys: np.ndarray) -> np.ndarray:
    """Displacements, one a bucket, for distinct keys (unsigned longs)."""
    n = len(keys)
    n_buckets = max(1, -(-n // 4))
    shift = np.zeros(n_buckets, np.int32)
    if not n:
        return shift
    bucket = _bucket(keys, n_buckets)
    order = np.argsort(bucket, kind="stable")
    stop = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    size = np.diff(stop)
    free = np.ones(n, bool)
    tries = np.arange(1, 65)
    for b in np.argsort(-size, kind="stable"):
        if size[b] < 2:
            break
        own = keys[order[stop[b] : stop[b + 1]]]
        d = 1
        while True:
            spots = _spread(np.repeat(own[None, :], len(tries), 0), np.repeat((d + tries - 1)[:, None], len(own), 1), n)
            good = free[spots].all(axis=1)
            for k in np.flatnonzero(good):
                if len(set(spots[k].tolist())) == len(own):
                    break
            else:
                d += len(tries)
                continue
            shift[b] = d + k
            free[spots[k]] = False
            break
    left = iter(np.flatnonzero(free).tolist())
    for b in np.flatnonzero(size == 1):
        shift[b] = -next(left) - 1
    return shift


def slot_of(keys: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    d = shift[_bucket(keys, len(shift))].astype(np.int64)
    return np.where(d < 0, -d - 1, _spread(keys, np.maximum(d, 0), n))


def _pack(path: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq = Encoder.of(path), TaskContext.get().partitionId(), 0
        width = 2 if own.size <= 1 << 16 else 4
        keys: list[int | None] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            count = np.concatenate(lengths)
            first = np.concatenate([[0], np.cumsum(count)[:-1]])
            real = np.array([k is not None for k in keys])
            known = np.array([k for k in keys if k is not None], np.int64)
            distinct, at = np.unique(known, return_index=True)
            u = distinct.view(np.uint64)
            shift = perfect_hash(u)
            slots = np.zeros(len(distinct), _SLOT)
            where = slot_of(u, shift, max(1, len(distinct)))
            rows = np.flatnonzero(real)[at]
            slots["print"][where], slots["start"][where], slots["count"][where] = prints(u), first[rows], count[rows]
            payload = np.concatenate(ids).astype("<u2" if width == 2 else "<u4").tobytes()
            row = [part, seq, int(distinct[0]) if len(distinct) else None, int(distinct[-1]) if len(distinct) else None, len(keys), int(count.sum()), width, keys, count.tolist(), shift.tolist(), slots.tobytes(), payload]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _SHARD.split(", ")])

        for batch in batches:
            for piece, data, off in K.pieces(batch, "__text"):
                got, count = own.encode(data, off)
                ends = np.cumsum(count)
                ids.append(np.insert(got, ends, end_id))
                lengths.append(count + 1)
                keys += piece.column(0).to_pylist()
                held += len(ids[-1])
                if held >= shard_ids:
                    yield shard()
                    seq, held = seq + 1, 0
                    keys, lengths, ids = [], [], []
        if keys:
            yield shard()

    return run


def write(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1 << 20) -> DataFrame:
    """Write the ids of docs, in ascending order of the key, as a table of shards
    in the shared folder, and return it. A shard has shard_ids ids and one chunk
    of texts at most more. Rows of one key or without a key are in the order of
    their texts' hashes, by which such a group is dealt to many tasks too."""
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    order = ["__id", "__hash"]
    dealt = base.withColumn("__hash", F.xxhash64("__text")).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.drop("__hash").mapInArrow(_pack(path, end_id, shard_ids), _SHARD), "shards")


def starts(shards: DataFrame) -> DataFrame:
    """(part, seq, before): how many ids come before each shard. Reads no payload."""
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # a row for each task that wrote
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("__before"))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select("part", "seq", within.alias("__within")).join(parts, "part").select("part", "seq", (F.col("__before") + F.col("__within")).alias("before"))


class Shard:
    """A shard in memory."""

    def __init__(self, row: dict):
        self.shift = np.asarray(row["shift"], np.int32)
        self.slots = np.frombuffer(row["slots"], _SLOT)
        self.ids = np.frombuffer(row["payload"], "<u2" if row["width"] == 2 else "<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and count of each key (count -1: not in the shard)."""
        if not len(self.slots):
            return np.zeros(len(keys), np.int64), np.full(len(keys), -1)
        u = keys.astype(np.int64).view(np.uint64)
        slot = self.slots[slot_of(u, self.shift, len(self.slots))]
        return slot["start"].astype(np.int64), np.where(slot["print"] == prints(u), slot["count"].astype(np.int64), -1)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row)
            lengths = np.asarray(row["lengths"], np.int64)
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            keys = row["keys"]
            start, count = first.copy(), lengths.copy()
            real = np.array([k is not None for k in keys])
            known = np.array([k for k in keys if k is not None], np.int64)
            once = np.flatnonzero(real)[np.unique(known, return_index=True)[1]]
            start[once], count[once] = shard.find(np.array([keys[i] for i in once], np.int64))
            if (count < 0).any():
                raise ValueError("an index doesn't find a key of its shard")
            wide = shard.ids.astype("<u4")
            crc = [zlib.crc32(wide[a : a + n]) for a, n in zip(start.tolist(), count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start), pa.array(count), pa.array(crc, pa.int64()), *[pa.array([row[c]] * len(keys), pa.int32()) for c in ("part", "seq")]], ["__id", "at", "n_tokens", "ids_crc32", "part", "seq"])


def contents(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, each found through
    the index of its shard. The places of the shards meet the documents' rows,
    so no payload is shuffled."""
    own = shards.mapInArrow(_read, "__id long, at long, n_tokens long, ids_crc32 long, part int, seq int")
    return own.join(starts(shards), ["part", "seq"]).select(F.col("__id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(shards: DataFrame, keys: list[int], id_col: str = "doc_id") -> DataFrame:
    """(id, ids) of a few keys: only shards whose range holds a key are read."""
    wanted = sorted(set(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                own = np.array([k for k in wanted if row["first_key"] <= k <= row["last_key"]], np.int64)
                start, count = shard.find(own)
                hit = np.flatnonzero(count >= 0)
                ids = [shard.ids[start[i] : start[i] + count[i]].astype(np.int64).tolist() for i in hit]
                yield pa.RecordBatch.from_arrays([pa.array(own[hit]), pa.array(ids, pa.list_(pa.int64()))], ["__id", "ids"])

    near = F.lit(False)
    for k in wanted:
        near |= (F.col("first_key") <= k) & (F.col("last_key") >= k)
    return shards.where(near).mapInArrow(run, "__id long, ids array<long>").withColumnRenamed("__id", id_col)
