"""SimHash near-dedup by a generalised pigeonhole.

Fingerprints: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of
`shingle` words (repeats included), XXH64 with seed 42; a bit of the 64 is set
if it is set in over half the hashes.

Links: two fingerprints link at `distance` or fewer differing bits. The 64 bits
are put into units of 8 correlated bits, units into partitions. If thresholds
t_i satisfy sum(t_i + 1) = distance + 1, a linked pair differs by at most t_i
bits in some partition i, so it is enough to look up, for each partition, the
values within t_i of a fingerprint's own. How many partitions, and which
threshold each gets, is settled by dynamic programming on the expected number
of candidates, from exact counts of all fingerprints: 8 histograms of 256 bins.
Candidates are verified on all 64 bits within the join.

Equal fingerprints are one node, so copies cost nothing however many there are.
Nothing but the histograms and a 64 x 64 table of joint bit counts reaches the
driver.

A null text, like one without words, has fingerprint zero, which links like any
other. Null ids get a fingerprint and the component of their fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .storage import stored
from .survivors import key, survivors

_UNIT, _UNITS = 8, 8
#: Cost of verifying a candidate pair, in lookups of a value.
_VERIFY = 0.5


def text_hashes(text: bytes, shingle: int, seed: int = 42) -> list[int]:
    """XXH64 of each shingle of a text (lower-cased, space-joined)."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: len(words) - shingle]])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Fingerprints of texts that have count hashes each, one after another."""
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    n = count[some]
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    blocks = -(-n // 255)  # sums of 255 bits fit a byte, so eight columns are summed in one 64-bit addition
    at = np.repeat(begin, blocks) + 255 * K.ragged(blocks)
    part = np.add.reduceat(bits.view(np.uint64), at, axis=0).view(np.uint8)
    sums = np.add.reduceat(part.astype(np.int64), np.concatenate([[0], np.cumsum(blocks)[:-1]]), axis=0)
    out[some] = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in K.pieces(batch, "__text"):
                raw = data.tobytes()
                found = [np.array(text_hashes(raw[a:b], shingle), np.uint64) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                fp = majority(np.concatenate(found), np.array([len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["__id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): a signed long that holds the 64 bits."""
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = base.schema["__id"].dataType.simpleString()
    return base.mapInArrow(_fingerprints(shingle), f"__id {kind}, fp long").withColumnRenamed("__id", id_col)


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often two bits are set together, one row for each pair and task."""
    total = np.zeros((64, 64), np.int64)
    for batch in batches:
        fp = np.asarray(batch.column(0), np.int64)
        for i in range(0, len(fp), 1 << 16):
            x = np.unpackbits(fp[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += (x.T @ x).astype(np.int64)
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096, dtype=np.int32)), pa.array(total.ravel())], ["pair", "n"])


def correlated(joint: np.ndarray, n: int) -> list[int]:
    """The 64 bits in an order in which bits that go together are neighbours:
    units of 8 are grown from the most correlated free bit."""
    p = np.diag(joint) / max(n, 1)
    cov = joint / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    corr = np.abs(cov / scale)
    np.fill_diagonal(corr, 0)
    free, order = set(range(64)), []
    while free:
        own = sorted(free)
        unit = [max(own, key=lambda b: (corr[b, own].sum(), -b))]
        free.remove(unit[0])
        while len(unit) < _UNIT:
            b = max(sorted(free), key=lambda b: (corr[b, unit].sum(), -b))
            unit.append(b)
            free.remove(b)
        order += unit
    return order


def chances(histograms: np.ndarray, distance: int) -> np.ndarray:
    """Of two fingerprints, the chance that a unit differs in exactly e bits,
    for each unit and e from 0 to distance."""
    weight = np.array([bin(v).count("1") for v in range(256)])
    near = weight[np.arange(256)[:, None] ^ np.arange(256)[None, :]]
    out = np.zeros((len(histograms), distance + 1))
    for u, h in enumerate(histograms):
        q = h / max(h.sum(), 1)
        for e in range(distance + 1):
            out[u, e] = q @ (near == e) @ q
    return out


def allocated(chance: np.ndarray, n: int, distance: int) -> list[tuple[int, int, int]]:
    """(first unit, end unit, threshold) of each partition that is looked up.

    For each number of partitions, dynamic programming over the partitions
    finds thresholds of least expected cost whose sum of (t + 1) is distance + 1
    (t = -1: the partition is not looked up); the cheapest number wins."""
    best: tuple[float, list[tuple[int, int, int]]] = (float("inf"), [])
    for m in range(1, _UNITS + 1):
        edges = [round(i * _UNITS / m) for i in range(m + 1)]
        table = {0: (0.0, [])}
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            exact = np.array([1.0] + [0.0] * distance)
            for u in range(a, b):
                exact = np.convolve(exact, chance[u])[: distance + 1]
            within, bits = np.cumsum(exact), _UNIT * (b - a)
            new: dict[int, tuple[float, list[tuple[int, int, int]]]] = {}
            for used, (cost, parts) in table.items():
                for t in range(-1, distance - used + 1):
                    lookups = sum(comb(bits, e) for e in range(t + 1))
                    c = cost + (n * lookups + _VERIFY * n * n * within[t] / 2 if t >= 0 else 0)
                    if c < new.get(used + t + 1, (float("inf"),))[0]:
                        new[used + t + 1] = (c, [*parts, (a, b, t)] if t >= 0 else parts)
            table = new
        if distance + 1 in table:
            best = min(best, table[distance + 1], key=lambda x: x[0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """nodes: distinct fingerprints in column fp. Returns (a, b), a < b: all
    pairs at 1 to distance differing bits, each at least once."""
    joint = np.zeros(4096, np.int64)
    for pair, n in nodes.mapInArrow(_joint, "pair int, n long").groupBy("pair").agg(F.sum("n")).collect():  # 4096 rows
        joint[pair] = n
    total = nodes.count()
    order = correlated(joint.reshape(64, 64), total)
    units = [order[i : i + _UNIT] for i in range(0, 64, _UNIT)]

    def value(bits: list[int]):
        return sum((F.getbit("fp", F.lit(b)).cast("int") * (1 << i) for i, b in enumerate(bits)), F.lit(0))

    histograms = np.zeros((_UNITS, 256), np.int64)
    stats = nodes.select(F.posexplode(F.array(*[value(u) for u in units])).alias("unit", "value")).groupBy("unit", "value").count()
    for unit, v, n in stats.collect():  # 2048 rows at most
        histograms[unit, v] = n
    parts = allocated(chances(histograms, distance), total, distance)
    masks = [sum(1 << b for u in units[a:b] for b in u) for a, b, _ in parts]
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    index = nodes.select(F.col("fp").alias("a"), F.explode(keys).alias("k")).select("a", "k.part", "k.key")
    flips = []
    for i, (a, b, t) in enumerate(parts):
        bits = [x for u in units[a:b] for x in u]
        flips += [(i, _signed(sum(1 << x for x in c))) for e in range(t + 1) for c in combinations(bits, e)]
    probes = nodes.select(F.col("fp").alias("b"), F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.lit(f).alias("flip")) for i, f in flips])).alias("k"))
    mask_of = F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), F.col("k.part") + 1)
    probes = probes.select("b", "k.part", F.col("b").bitwiseAND(mask_of).bitwiseXOR(F.col("k.flip")).alias("key"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return index.alias("x").join(probes.alias("y"), (F.col("x.part") == F.col("y.part")) & (F.col("x.key") == F.col("y.key")) & near).select("a", "b")


def _classes(fps: DataFrame, distance: int) -> DataFrame:
    """fps: __id, fp. The same with winner, the least __id among all rows that
    are reached over links, the row included."""
    fps = stored(fps, "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("__id").alias("least")), "nodes")
    groups = components(links(nodes.select("fp"), distance))
    tied = nodes.join(groups.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    tied = stored(tied, "tied")
    named = tied.groupBy("component").agg(F.min("least").alias("winner"))
    of = tied.join(named, "component").select("fp", "winner")
    return fps.join(of, "fp").select("__id", "fp", "winner")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """(id, fp, component_id), one row per row of docs; component_id is the
    least id among all rows that are reached over links, the row included."""
    found = _classes(fingerprints(docs, id_col, text_col, shingle).withColumnRenamed(id_col, "__id"), distance)
    return found.select(F.col("__id").alias(id_col), "fp", F.col("winner").alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row of docs for each component: the one with the smallest id (null
    last), of equal ids the one with the lesser hash of the text, of rows equal in
    both any one. Rows are judged, not ids: a row that links to nothing stays
    whatever other rows have its id, and a repeated row goes."""
    keyed = docs.select(key(id_col, text_col).alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    return survivors(docs, _classes(fingerprints(keyed, "__id", "__text", shingle), distance), id_col, text_col)
