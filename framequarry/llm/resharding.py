"""Resharding by minimum-cost flow: new capacities, the fewest bytes moved.

`laid` writes rows into files by (old shard, block); blocks are dealt by a hash of
the row's place, some `block_bytes` each. `resharded` then

1. sums up the shards (a row a shard reaches the driver) and solves the flow from
   old shards to new ones, whose capacities are equal parts of all bytes unless they
   are given; an arc from a shard to itself costs nothing, any other its bytes
   (`cost` may say otherwise, as for racks). Shortest augmenting paths, with the
   number of shards as the size of the problem, never that of the table;
2. lays the flow's arcs along each old shard's blocks by their running sum, blocks
   with the largest rows first, where what stays lies and few arcs end: a block
   within one arc stays or moves as a whole, and only blocks that an arc's end falls
   into (fewer than arcs) are divided, by their rows: the largest that still fit
   go first, so a cut misses its place by less than the least row left;
3. rewrites the files of blocks that move or are divided, and no others.

`contents` reads the new shards with a slot for each row, gapless within its shard,
from the sums of the files before and the row's number in its file.

Sizes of shards come out within a few bytes of their capacities where rows are small
against blocks; a row that is larger than a capacity is placed whole. A group of
equal texts is not kept together, as it may exceed a shard: its rows are dealt like
any others. Nulls: a null text counts as empty, the size is its UTF-8 bytes plus 1;
ids and other columns may be null, repeat, or have any name that does not begin with
two underscores. Old shards that lie out of range or are null are shard 0. An empty
table makes empty shards. A lost executor costs a stage: each step is a written table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import shared_dir, stored

_PIECE = ["__old", "__block"]


@dataclass(frozen=True)
class Layout:
    """Files below `path`, and for each block its rows and bytes."""

    spark: SparkSession
    path: str
    schema: str
    sizes: tuple[int, ...]
    blocks: DataFrame


@dataclass(frozen=True)
class Resharded:
    """files: __shard, __old, __block, __kept (as it lay), rows, bytes, __first
    (slot of its first row). flow[i][j]: bytes from old shard i to new shard j."""

    old: Layout
    moved: str
    files: DataFrame
    flow: list[list[int]]


def cheapest(supply: list[int], capacity: list[int], cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> list[list[int]]:
    """Flow of all supplies into capacities (of no smaller sum) at least cost, by
    shortest augmenting paths with potentials, so that no path looks at a negative
    arc."""
    n, m = len(supply), len(capacity)
    left, free = list(supply), list(capacity)
    flow = [[0] * m for _ in range(n)]
    price = [0] * (n + m)
    costs = [[cost(i, j) for j in range(m)] for i in range(n)]
    while any(left):
        far: list[float] = [0 if k < n and left[k] else float("inf") for k in range(n + m)]
        come, done = [-1] * (n + m), [False] * (n + m)
        for _ in range(n + m):
            k = min((x for x in range(n + m) if not done[x]), key=far.__getitem__)
            if far[k] == float("inf"):
                break
            done[k] = True
            arcs = [(n + j, costs[k][j]) for j in range(m)] if k < n else [(i, -costs[i][k - n]) for i in range(n) if flow[i][k - n]]
            for to, c in arcs:
                reached = far[k] + c + price[k] - price[to]
                if reached < far[to]:
                    far[to], come[to] = reached, k
        ends = [n + j for j in range(m) if free[j] and done[n + j]]
        if not ends:
            raise ValueError("the capacities are too small")
        most = max(f for f, d in zip(far, done, strict=True) if d)
        price = [p + int(min(f, most)) for p, f in zip(price, far, strict=True)]
        # potentials make a path's true cost the difference at its ends
        end = min(ends, key=lambda k: price[k])
        path = [end]
        while come[path[-1]] >= 0:
            path.append(come[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:], strict=False))
        amount = min([left[path[0]], free[end - n]] + [flow[b][a - n] for a, b in steps if a >= n])
        for a, b in steps:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[path[0]] -= amount
        free[end - n] -= amount
    return flow


def laid(docs: DataFrame, shard: Column, shards: int, text_col: str = "text", block_bytes: int = 4 << 20) -> Layout:
    """docs as files by shard (a whole number below `shards`) and block."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long") + 1
    old = F.when((shard >= 0) & (shard < shards), shard).otherwise(0).cast("int")
    rows = docs.select("*", old.alias("__old"), size.alias("__size"), F.xxhash64(F.monotonically_increasing_id()).alias("__row"))
    sums = {r["__old"]: r["n"] for r in rows.groupBy("__old").agg(F.sum("__size").alias("n")).collect()}  # a row a shard
    sizes = tuple(sums.get(i, 0) for i in range(shards))
    many = F.get(F.array(*[F.lit(max(1, -(-n // block_bytes))) for n in sizes]), F.col("__old"))
    dealt = rows.withColumn("__block", F.pmod("__row", many).cast("int"))
    at = F.row_number().over(Window.partitionBy(*_PIECE).orderBy("__row")) - 1
    path = f"{shared_dir(spark)}/laid-{uuid.uuid4().hex}"
    own = dealt.withColumn("__at", at).drop("__row")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    own.write.partitionBy(*_PIECE).parquet(path)
    blocks = spark.read.schema(schema).parquet(path).groupBy(*_PIECE).agg(F.count("*").alias("rows"), F.sum("__size").alias("bytes"), F.max("__size").alias("widest"))
    return Layout(spark, path, schema, sizes, stored(blocks, "blocks"))


def _divided(targets: list[int], sizes: np.ndarray, amounts: list[int]) -> np.ndarray:
    """The target of each row: all but the last target take, of the rows left by
    falling size, those that still fit into their amount."""
    out = np.full(len(sizes), targets[-1], np.int32)
    left = np.argsort(-sizes, kind="stable")
    for target, room in zip(targets[:-1], amounts[:-1], strict=True):
        taken = np.zeros(len(left), bool)
        for k, size in enumerate(sizes[left].tolist()):
            if size <= room:
                taken[k] = True
                room -= size
        out[left[taken]] = target
        left = left[~taken]
    return out


def _cut(key: tuple, table: pa.Table) -> pa.Table:
    """The rows of one divided block."""
    order = np.argsort(np.asarray(table.column("__at")), kind="stable")
    table = table.take(pa.array(order))
    arcs = table.column("arcs")[0].as_py()
    to = _divided([a["target"] for a in arcs], np.asarray(table.column("__size")), [a["amount"] for a in arcs])
    rank = np.empty(len(to), np.int32)
    for t in np.unique(to):
        rank[to == t] = np.arange((to == t).sum())
    keys = [table.column(c) for c in (*_PIECE, "__at")]
    return pa.table([*keys, pa.array(to), pa.array(rank)], names=[*_PIECE, "__at", "__shard", "__to"])


def equal(total: int, shards: int) -> list[int]:
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def resharded(old: Layout, shards: int, capacity: list[int] | None = None, cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> Resharded:
    """The rows of old in `shards` shards of the given capacities in bytes."""
    spark = old.spark
    flow = cheapest(list(old.sizes), capacity or equal(sum(old.sizes), shards), cost)
    arcs = []
    for i, row in enumerate(flow):
        low = 0
        for j in sorted(range(len(row)), key=lambda j, i=i: (j != i, j)):
            if row[j]:
                arcs.append((i, j, low, low + row[j]))
                low += row[j]
    plan = spark.createDataFrame(arcs, "o int, target int, low long, high long")
    start = F.sum("bytes").over(Window.partitionBy("__old").orderBy(F.col("widest").desc(), "__block").rowsBetween(Window.unboundedPreceding, -1))
    placed = old.blocks.withColumn("start", F.coalesce(start, F.lit(0).cast("long")))
    over = (F.col("o") == F.col("__old")) & (F.col("low") < F.col("start") + F.col("bytes")) & (F.col("high") > F.col("start"))
    amount = F.least("high", F.col("start") + F.col("bytes")) - F.greatest("low", "start")
    met = placed.join(plan, over).groupBy(*_PIECE, "rows", "bytes").agg(F.array_sort(F.collect_list(F.struct("low", "target", amount.alias("amount")))).alias("arcs"))
    met = stored(met, "plan")  # a row a block; arcs: fewer than shards
    whole = met.where(F.size("arcs") == 1).select(*_PIECE, "rows", "bytes", F.col("arcs")[0]["target"].alias("__shard"))
    open_ = met.where(F.size("arcs") > 1).select(*_PIECE, "arcs")
    files = spark.read.schema(old.schema).parquet(old.path)
    kinds = {f.name: f.dataType.simpleString() for f in files.schema}
    cut = files.select(*_PIECE, "__at", "__size").join(open_, _PIECE).groupBy(*_PIECE).applyInArrow(lambda key, table: _cut(key, table), "__old int, __block int, __at int, __shard int, __to int")
    parted = files.join(stored(cut, "cut"), [*_PIECE, "__at"]).withColumn("__at", F.col("__to")).drop("__to")
    sent = files.join(whole.where("__shard <> __old").select(*_PIECE, "__shard"), _PIECE)
    own = [c for c in kinds if c not in _PIECE]
    path = f"{shared_dir(spark)}/moved-{uuid.uuid4().hex}"
    made = [F.col(f"`{c}`") for c in (*own, "__shard", *_PIECE)]
    sent.select(*made).unionByName(parted.select(*made)).write.partitionBy("__shard", *_PIECE).parquet(path)
    moved = spark.read.schema(f"{old.schema}, __shard int").parquet(path)
    tally = moved.groupBy("__shard", *_PIECE).agg(F.count("*").alias("rows"), F.sum("__size").alias("bytes")).withColumn("__kept", F.lit(False))
    all_ = whole.where("__shard = __old").withColumn("__kept", F.lit(True)).unionByName(tally)
    before = F.sum("rows").over(Window.partitionBy("__shard").orderBy(*_PIECE).rowsBetween(Window.unboundedPreceding, -1))
    all_ = all_.withColumn("__first", F.coalesce(before, F.lit(0).cast("long")))
    return Resharded(old, path, stored(all_, "files"), flow)


def contents(new: Resharded) -> DataFrame:
    """The rows of all shards, with __size, __shard and __slot."""
    spark, schema = new.old.spark, new.old.schema
    kept = spark.read.schema(schema).parquet(new.old.path).join(new.files.where("__kept").select(*_PIECE, "__shard", "__first"), _PIECE)
    moved = spark.read.schema(f"{schema}, __shard int").parquet(new.moved)
    moved = moved.join(new.files.where("not __kept").select("__shard", *_PIECE, "__first"), ["__shard", *_PIECE])
    slot = (F.col("__first") + F.col("__at")).cast("long").alias("__slot")
    own = [F.col(f"`{f.name}`") for f in spark.createDataFrame([], schema).schema if not f.name.startswith("__")]
    shape = [*own, "__size", "__shard", slot]
    return kept.select(*shape).union(moved.select(*shape))
