"""Conversations as a trie of their prefixes, by collapsing whole sequences.

A conversation is rebuilt first: it starts with the opening turns of the first
conversation of its family and goes on with its own (`rebuilt`), which is how
dialogues that branch off a common start are stored. Then, in `nodes`:

1. Collapse. Conversations of one sequence of turns become one weighted sequence,
   with its least id and its list of ends (the ids, as a digest).
2. Weighted prefixes. Each sequence gives a row per prefix; aggregated by depth and
   hash they are the nodes, with the summed weights as members.
3. Leaves. Sequences that are a proper prefix of another go, by an anti-join; what
   stays are the leaves, counted along their prefixes.
4. Sums over subtrees need no walk: a node is owned by the sequence of its least
   member, so what a sequence owns is the lower end of its path. The sum over a
   subtree is that of all owned by the sequences through its top, less what the
   top's owner owns above it.

A prefix is known by 2 x 64 bits: the exclusive or, over its turns, of hashes of
(place, role, text). So it is a running aggregate, and prefixes of one conversation
need not be worked out in one task: turns are sorted by range over all
conversations, and what lies before a (conversation, partition) chunk comes from
the sums of the chunks before. No join has a conversation as key of many rows, so
one that holds a third of all turns is spread like the rest. Texts are not
shuffled, only their digests. The ids of a sequence of a third of all
conversations are joined to strings of some thousand ids where they lie, and only
those strings meet, as a stream into one digest.

Nulls: rows without a conversation's id are no turns of any and are left out; null
turns come first; null roles and texts are empty. Turns that tie are ordered by
role, then by the SHA-256 of the text; rows repeated in full are turns of their
own. Ids are whole numbers. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

_EMPTY = hashlib.sha256(b"").hexdigest()
_KEY = ["d", "k1", "k2"]
_RUN = 4096  # ids in a string of an end list
_STEP = 4096  # depths in a chunk of the sums along a path
_HEADS = 3  # the most turns that are taken from another conversation


def _preceding(over: Column, part: str, order: str) -> Column:
    """over, a sum, of what lies before a row."""
    before = over.over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(before, F.lit(0).cast("long"))


def _shared_turns(conv: Column) -> Column:
    return F.crc32(F.encode(conv.cast("string"), "UTF-8")) % (_HEADS + 1)


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 20) -> tuple[DataFrame, DataFrame]:
    """Conversation c becomes the first h turns of conversation c - c % family,
    then its own turns after its first h; h is the CRC-32 of the decimal c, modulo
    4. Returns (turns: c, pid, pos from 1, z1, z2 (hashes of the turn in its
    place), w (words)) and (c) of all conversations, those without turns too."""
    some = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    text = some(text_col)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    own = turns.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("c"),
        F.col(f"`{turn_col}`").alias("turn"),
        some(role_col).alias("role"),
        F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"),
        words.cast("long").alias("w"),
        F.monotonically_increasing_id().alias("tie"),  # rows that tie down to here are equal; so they can be dealt out
    )
    order = ["c", "turn", "role", "digest", "tie"]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order)
    codes = [F.xxhash64("role", "digest").alias("a"), F.xxhash64("digest", "role").alias("b")]
    laid = stored(dealt.select("c", *codes, "w", F.monotonically_increasing_id().alias("g")), "turns")
    laid = laid.select("c", F.shiftright("g", 33).alias("pid"), F.col("g").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), "a", "b", "w")
    chunks = laid.groupBy("c", "pid").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    chunks = chunks.select("c", "pid", (_preceding(F.sum("n"), "c", "pid") - F.col("low")).alias("lift"))
    heads = laid.join(chunks, ["c", "pid"]).withColumn("rank", F.col("at") + F.col("lift")).where(F.col("rank") < _HEADS)
    heads = heads.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("rank", "a", "b", "w"))).alias("top"))  # three at most
    convs = chunks.select("c").distinct().withColumn("h", _shared_turns(F.col("c")))
    opened = convs.join(heads.withColumnRenamed("c", "first"), F.col("c") - F.col("c") % family == F.col("first"), "left")
    top = F.coalesce(F.slice("top", F.lit(1), F.col("h").cast("int")), F.array())
    opened = stored(opened.select("c", "h", top.alias("top")), "openings")
    moved = chunks.join(opened.select("c", "h", F.size("top").alias("lent")), "c")
    rest = laid.join(moved, ["c", "pid"]).withColumn("rank", F.col("at") + F.col("lift")).where(F.col("rank") >= F.col("h"))
    rest = rest.select("c", "pid", (F.col("rank") - F.col("h") + F.col("lent") + 1).alias("pos"), "a", "b", "w")
    lent = opened.select("c", F.lit(-1).cast("long").alias("pid"), F.posexplode("top").alias("i", "t")).select("c", "pid", (F.col("i") + 1).cast("long").alias("pos"), "t.a", "t.b", "t.w")
    placed = rest.union(lent).select("c", "pid", "pos", F.xxhash64("pos", "a", "b").alias("z1"), F.xxhash64("b", "a", "pos").alias("z2"), "w")
    return stored(placed, "rebuilt"), opened.select("c")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ends of sequences as strings of up to _RUN ids."""
    key: tuple | None = None
    ids: list[int] = []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, ids[0], ",".join(map(str, ids)))], [*_KEY, "first", "ids"])

    for batch in batches:
        for *own, c in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if ids and (tuple(own) != key or len(ids) == _RUN):
                yield row()
                ids = []
            key = tuple(own)
            ids.append(c)
    if ids:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs as one digest a sequence."""
    key, sha = None, hashlib.sha256()
    for batch in batches:
        done = []
        for *own, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
            if tuple(own) == key:
                sha.update(b",")
            else:
                if key:
                    done.append((*key, sha.hexdigest()))
                key, sha = tuple(own), hashlib.sha256()
            sha.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], [*_KEY, "ends"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], [*_KEY, "ends"])


def ends(sequences: DataFrame) -> DataFrame:
    """sequences: d, k1, k2, c. (d, k1, k2, ends): the SHA-256 of the ascending
    decimal c, with commas between them."""
    order = [*_KEY, "c"]
    runs = sequences.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs, "d long, k1 long, k2 long, first long, ids string")
    order = [*_KEY, "first"]
    return runs.repartition(*_KEY).sortWithinPartitions(*order).mapInArrow(_digests, "d long, k1 long, k2 long, ends string")


def nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """turns, convs: as `rebuilt` returns them. A row per node: conv_id (least
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    xors = [F.bit_xor(f"z{i}").alias(f"x{i}") for i in (1, 2)]
    sums = stored(turns.groupBy("c", "pid").agg(F.count("*").alias("n"), *xors), "chunks")
    whole = sums.groupBy("c").agg(F.sum("n").alias("d"), F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2"))
    zero = F.lit(0).cast("long")
    whole = stored(convs.join(whole, "c", "left").select("c", *[F.coalesce(k, zero).alias(k) for k in _KEY]), "sequences")
    seqs = stored(whole.groupBy(*_KEY).agg(F.min("c").alias("t"), F.count("*").alias("weight")), "collapsed")
    listed = stored(ends(whole), "ends")

    # prefixes of one conversation of each sequence
    before = [_preceding(F.bit_xor(f"x{i}"), "c", "pid").alias(f"before{i}") for i in (1, 2)]
    own = seqs.select("t", "weight", F.col("d").alias("len"))
    chunks = stored(sums.select("c", "pid", *before).join(own, F.col("c") == F.col("t")).drop("c"), "paths")
    along = Window.partitionBy("c", "pid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = turns.join(chunks.select(F.col("t").alias("c"), "pid", "before1", "before2", "weight", "len"), ["c", "pid"])
    k = [F.bit_xor(f"z{i}").over(along).bitwiseXOR(F.col(f"before{i}")) for i in (1, 2)]
    prefixes = run.select(F.col("c").alias("t"), "pid", F.col("pos").alias("d"), k[0].alias("k1"), k[1].alias("k2"), "z1", "z2", "w", "weight", (F.col("pos") < F.col("len")).alias("inner"))
    prefixes = prefixes.withColumns({f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"z{i}")) for i in (1, 2)}).drop("z1", "z2")
    prefixes = stored(prefixes, "prefixes")
    found = prefixes.groupBy(*_KEY).agg(F.sum("weight").alias("n_convs"), F.min("t").alias("conv_id"), F.max("inner").alias("inner"), *[F.min(c).alias(c) for c in ("w", "p1", "p2")])
    found = stored(found.withColumn("v", (F.col("n_convs") - 1) * F.col("w")), "nodes")

    leaves = seqs.where("d > 0").join(found.where("inner").select(*_KEY), _KEY, "left_anti").select("t", F.lit(1).cast("long").alias("leaf"))
    owned = found.groupBy(F.col("conv_id").alias("t")).agg(F.sum("v").alias("owned"))
    told = seqs.select("t", "weight").join(leaves, "t", "left").join(owned, "t", "left").select("t", "weight", F.coalesce("leaf", zero).alias("leaf"), F.coalesce("owned", zero).alias("owned"))
    told = stored(told, "told")
    through = prefixes.select("t", "pid", *_KEY).join(chunks.select("t", "pid").join(told, "t"), ["t", "pid"])
    through = through.groupBy(*_KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum("owned").alias("below"))
    steps = found.groupBy("conv_id", F.floor(F.col("d") / _STEP).alias("step")).agg(F.sum("v").alias("v"))
    steps = steps.select("conv_id", "step", _preceding(F.sum("v"), "conv_id", "step").alias("earlier"))
    within = F.sum("v").over(Window.partitionBy("conv_id", "step").orderBy("d").rowsBetween(Window.unboundedPreceding, -1))
    ranked = found.withColumn("step", F.floor(F.col("d") / _STEP)).withColumn("above", F.coalesce(within, zero)).join(steps, ["conv_id", "step"])

    top = told.agg(F.min("t").alias("t"), F.sum("weight").alias("n"), F.sum("leaf").alias("leaves"), F.sum("owned").alias("saved")).first()
    up = [(F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = found.select(*up).groupBy(*_KEY).agg(F.count("*").alias("n_children"))
    parents = found.select(F.col("d").alias("pd"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    out = ranked.join(through, _KEY).join(children, _KEY, "left").withColumn("pd", F.col("d") - 1).join(parents, ["pd", "p1", "p2"], "left").join(listed, _KEY, "left")
    parent = F.when(F.col("d") == 1, F.lit(top["t"]).cast("long")).otherwise(F.col("parent"))
    shape = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    values = ["conv_id", "d", parent, "n_convs", F.coalesce("n_children", zero), "n_leaves", F.col("below") - F.col("above") - F.col("earlier"), F.coalesce("ends", F.lit(_EMPTY))]
    out = out.select(*[(F.col(v) if isinstance(v, str) else v).alias(n) for v, n in zip(values, shape, strict=True)])
    if top["n"] is None:  # no conversations
        return out
    spark = out.sparkSession
    none = listed.where("d = 0").select("ends").first()
    root = (top["t"], 0, None, top["n"], found.where("d = 1").count(), top["leaves"] or 1, top["saved"], none["ends"] if none else _EMPTY)
    return out.union(spark.createDataFrame([root], out.schema))
