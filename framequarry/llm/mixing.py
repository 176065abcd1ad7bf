"""Mixing sources to target weights by Pfair scheduling.

Each source's rows form blocks; a slot takes one block. With a share of w of all
weights, block j of a source is released at slot floor(j / w) and due by slot
ceil((j + 1) / w); taking the earliest deadline of what is released meets every
deadline, so at any slot each source is less than one block off its target. The
weights are taken as exact ratios, so nothing drifts however long the table is.
The driver works out the slots of all blocks (12 bytes a block, no rows); they
are handed out in rows of 1024 blocks.

When a source is used up, the weights of the others are scaled up and the
schedule begins anew (a phase): every row is placed, none is repeated.

Ranks come from two levels, so that a source with a third of all rows is spread
over as many tasks as the rest: rows are dealt by a hash of the whole row into
buckets of some `bucket_rows` rows of their source, ranked there, and moved up by
the rows of the source's earlier buckets. That also shuffles each source's rows.

The driver holds 12 bytes a block and `most_blocks` blocks at most: on tables
with more, blocks get longer, and the bound of one block holds for those.

Nulls: rows without a source form a source of their own. Ids may be null or
repeat: rows are ranked by the hash of all their columns, then by the id; rows
that still tie are equal in every column that can be hashed.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = 1024  # blocks in a row of the plan


def earliest_deadlines(weights: dict[str, int]) -> Iterator[str]:
    """The source of each slot, without end, by earliest deadline first. Windows
    are exact: block j of a source with weight c in a sum of d is released at
    slot floor(j d / c) and due by ceil((j + 1) d / c)."""
    total = sum(weights.values())
    waiting = [(0, s, 0) for s in weights]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), s, j))
        due, s, j = heapq.heappop(ready)
        assert due > t, "a deadline was missed"
        yield s
        heapq.heappush(waiting, ((j + 1) * total // weights[s], s, j + 1))
        t += 1


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Integers in the very proportions of weights."""
    ratios = {s: Fraction(w) for s, w in weights.items()}
    common = lcm(*(r.denominator for r in ratios.values()))
    return {s: int(r * common) for s, r in ratios.items()}


def scheduled(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, tuple[array, array]]:
    """For each source the slots of its blocks, and their phases."""
    left = {s: n for s, n in blocks.items() if n}
    out = {s: (array("q"), array("i")) for s in left}
    whole = exact({s: weights[s] for s in left}) if left else {}
    slot = phase = 0
    while left:
        for s in earliest_deadlines({s: whole[s] for s in left}):
            slots, numbers = out[s]
            slots.append(slot)
            numbers.append(phase)
            slot += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
        phase += 1
    return out


def _key(source: Column) -> Column:
    """A source as a string; null, which no string stands for, as the empty one."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def ranked(rows: DataFrame, source_col: str, id_col: str, sizes: dict[str, int], bucket_rows: int) -> DataFrame:
    """rows with `__source` and `__rank` (from 0 within the source)."""
    spark = rows.sparkSession
    many = spark.createDataFrame(pa.table([pa.array(list(sizes), pa.string()), pa.array([max(1, n // bucket_rows) for n in sizes.values()], pa.int64())], ["__source", "__buckets"]))
    hashed = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    h = F.xxhash64(*[F.col(f"`{c}`") for c in hashed])
    dealt = rows.select("*", _key(F.col(f"`{source_col}`")).alias("__source"), h.alias("__h")).join(F.broadcast(many), "__source")  # a row a source, as on the driver
    dealt = dealt.withColumn("__bucket", F.pmod("__h", "__buckets")).drop("__buckets")
    counted = dealt.groupBy("__source", "__bucket").count()
    before = F.sum("count").over(Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    counted = counted.select("__source", "__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__source", "__bucket").orderBy("__h", F.col(f"`{id_col}`"))) - 1
    found = dealt.withColumn("__place", place).join(counted, ["__source", "__bucket"])
    return found.withColumn("__rank", F.col("__place") + F.col("__before")).drop("__bucket", "__h", "__place", "__before")


def _placed(docs: DataFrame, weights: dict[str, float] | None, exponent: float, block: int, id_col: str, source_col: str, bucket_rows: int, max_sources: int | None, most_blocks: int) -> DataFrame:
    """docs with __block, __phase, __slot and __place."""
    counted = docs.groupBy(_key(F.col(f"`{source_col}`")).alias("s")).agg(F.count("*").alias("n"))
    sizes = {r["s"]: r["n"] for r in (counted if max_sources is None else counted.limit(max_sources + 1)).collect()}
    if max_sources is not None and len(sizes) > max_sources:
        raise ValueError(f"there are more than {max_sources} sources")
    target = {s: float((weights or {}).get(s[1:] if s else None, n**exponent)) for s, n in sizes.items()}
    if any(w <= 0 for w in target.values()):
        raise ValueError("weights are above zero")
    block = max(block, -(-sum(sizes.values()) // most_blocks))
    found = scheduled({s: -(-n // block) for s, n in sizes.items()}, target)
    plan = [(s, i // _CHUNK, slots[i : i + _CHUNK], numbers[i : i + _CHUNK]) for s, (slots, numbers) in found.items() for i in range(0, len(slots), _CHUNK)]
    columns = [pa.array([p[0] for p in plan], pa.string()), pa.array([p[1] for p in plan], pa.int64())]
    for k, kind in ((2, pa.int64()), (3, pa.int32())):
        ends = np.cumsum([0] + [len(p[k]) for p in plan]).astype(np.int32)
        flat = np.concatenate([np.asarray(p[k]) for p in plan]) if plan else np.empty(0)
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind.to_pandas_dtype()))))
    table = docs.sparkSession.createDataFrame(pa.table(columns, ["__name", "__chunk", "__slots", "__phases"]))
    rows = ranked(docs, source_col, id_col, sizes, bucket_rows).withColumn("__block", F.floor(F.col("__rank") / block))
    on = (F.col("__source") == F.col("__name")) & (F.floor(F.col("__block") / _CHUNK) == F.col("__chunk"))
    placed = rows.join(F.broadcast(table), on)  # 12 bytes a block, most_blocks of them
    at = (F.col("__block") % _CHUNK).cast("int")
    phase, slot = F.get("__phases", at), F.get("__slots", at)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return placed.select(*own, "__block", phase.alias("__phase"), slot.alias("__slot"), (F.col("__rank") % block).cast("int").alias("__place"))


def mixed(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    exponent: float = 0.5,
    block: int = 16,
    id_col: str = "doc_id",
    source_col: str = "source",
    bucket_rows: int = 4000,
    max_sources: int | None = None,
    most_blocks: int = 1 << 20,
) -> DataFrame:
    """docs with the columns block (of its source), phase, slot and place (in
    the block); order by slot and place for the mixture. Columns of docs with one
    of these names are replaced.

    weights: by source (None: rows without one); a source that is not named, or
    all where weights is None, gets its number of rows to the power exponent (0:
    equal weights, 1: in proportion). With max_sources, more sources than that
    are an error."""
    found = _placed(docs, weights, exponent, block, id_col, source_col, bucket_rows, max_sources, most_blocks)
    made = ("block", "phase", "slot", "place")
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made], *[F.col(f"__{c}").alias(c) for c in made])


def in_order(docs: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """The columns of docs, with rows dealt and sorted in the order of the
    mixture, so that each file written from it is in that order; readers may take
    the files in any order. options: those of `mixed`."""
    defaults = {"weights": None, "exponent": 0.5, "block": 16, "id_col": "doc_id", "source_col": "source", "bucket_rows": 4000, "max_sources": None, "most_blocks": 1 << 20}
    found = _placed(docs, **(defaults | options))
    order = ("__slot", "__place")
    dealt = found.repartitionByRange(partitions, *order) if partitions else found.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in docs.columns])


def deviation(order: list[str], weights: dict[str, float]) -> Fraction:
    """The largest distance, in blocks, of a source from its exact weight at any
    slot of a schedule."""
    total = sum(map(Fraction, weights.values()))
    share, seen, worst = {s: Fraction(w) / total for s, w in weights.items()}, dict.fromkeys(weights, 0), Fraction(0)
    for t, s in enumerate(order, 1):
        seen[s] += 1
        worst = max(worst, *(abs(share[x] * t - seen[x]) for x in weights))
    return worst
