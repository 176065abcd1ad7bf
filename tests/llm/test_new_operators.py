"""Prefix trie, spelling variants and resharding against plain versions, with the
hard cases mixed in."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framequarry.llm import oracle, prefix_trie, queries, resharding, spelling

TURNS = "conv_id long, turn long, role string, text string, n_convs int, d long, c string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def conversations() -> list[tuple]:
    rng = random.Random(3)
    rows = []
    openings = [("system", "be kind"), ("user", "hello there"), (None, None), ("user", "")]
    for c in [*range(0, 90), 1000, 1001, 1019, 1020, 5000]:
        if c in (20, 41):
            continue  # heads of families that do not exist, or only one
        turns = [openings[rng.randrange(2)], openings[rng.randrange(1, 4)], *[(rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "", None, "d e f"])) for _ in range(rng.randrange(4))]]
        turns = turns[: rng.choice([0, 1, 2, 6, 6, 6])] if c % 20 else turns
        rows += [(c, k if rng.random() > 0.05 else None, *t) for k, t in enumerate(turns)]
    rows += [(60, k, "user", f"turn {k}") for k in range(300)]  # a long one
    rows += [(70, None, "user", "tie"), (70, None, "user", "tie"), (70, None, "a", "tie"), (70, 0, None, "x" * 30000)]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None)]
    return [(*r, 1, 2, "c") for r in rows]


def plain_trie(rows: list[tuple]) -> dict:
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(x)] for c, x in own.items()}
    members = defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    below = defaultdict(list)
    for k in members:
        for d in range(len(k) + 1):
            below[k[:d]].append(k)
    kids = Counter(k[:-1] for k in members if k)
    value = {k: (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0 for k, m in members.items()}
    out = {}
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k))))
        out[min(m), len(k)] = (min(members[k[:-1]]) if k else None, len(m), kids[k], sum(not kids[x] for x in below[k]), sum(value[x] for x in below[k]), hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie(df) -> dict:
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}
    assert len(out) == df.count()
    return out


def test_trie_against_plain_dicts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_STEP", 64)
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    assert trie(prefix_trie.nodes(*prefix_trie.rebuilt(df))) == plain_trie(rows)


def test_trie_of_many_copies_and_of_nothing(spark):
    """Ends of one sequence in more than one string; turnless alone; no rows."""
    rows = [(c, k, "user", f"t{k}", 1, 2, "c") for c in range(9000) for k in range(2 if c % 3 else 1)]
    assert trie(prefix_trie.nodes(*prefix_trie.rebuilt(spark.createDataFrame(rows, TURNS)))) == plain_trie(rows)
    bare = [(c, 0, "user", "x", 1, 2, "c") for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4]
    got = trie(prefix_trie.nodes(*prefix_trie.rebuilt(spark.createDataFrame(bare, TURNS))))
    assert got == plain_trie(bare) and len(got) == 1 and next(iter(got.values()))[3] == 1
    assert prefix_trie.nodes(*prefix_trie.rebuilt(spark.createDataFrame([], TURNS))).count() == 0


def distance_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def word_list() -> dict[str, int]:
    rng = random.Random(8)
    words = {}
    for _ in range(150):
        base = "".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 9, 14])))
        for _ in range(4):
            w = list(base)
            k, at = rng.randrange(4), rng.randrange(len(w))
            if k == 0:
                w[at] = rng.choice("abz")
            elif k == 1:
                w.insert(rng.choice([at, len(w)]), rng.choice("abÿ"))
            elif k == 2 and len(w) > 6:
                del w[at]
            words["".join(w)] = rng.choice([5, 6, 30, 150, 150, 800])
    words |= {"x" * n: 5 * n for n in (6, 7, 8, 10, 300, 301)} | {"a" * 2000 + x: 9 for x in ("", "b", "bc")}
    return words


def plain_forms(words: dict[str, int]) -> dict:
    near = {a: [b for b in words if distance_one(a, b)] for a in words}
    form = {}
    for a, found in near.items():
        best = min(found, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best and words[best] >= 5 * words[a] else None

    def root(a: str) -> str:
        while form[a]:
            a = form[a]
        return a

    return {a: (form[a], root(a), words[a], len(near[a]), words[form[a]] if form[a] else None) for a in words}


@pytest.mark.parametrize("most", [3, 4096])
def test_spelling_against_all_pairs(spark, most):
    """most=3: blocks are cut down to single letters."""
    words = word_list()
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.forms(df, most=most).collect()}
    assert got == plain_forms(words)
    assert spelling.forms(df.limit(0)).count() == 0


def test_blocks_over_several_batches(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_SLICE", 4)
    words = {k: v for k, v in word_list().items() if len(k) < 100}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = sorted((hash(w[:3]) % 97, len(w), 0, len(w), w, n) for w, n in words.items())
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    names = ["block", "ell", "lo", "hi", "word", "n"]
    table = pa.Table.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
    found = [(r["word"], r["near"]) for b in spelling._near(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(found) == sorted((a[4], b[4]) for a in rows for b in rows if a[:2] == b[:2] and distance_one(a[4], b[4]))


def test_vocabulary(spark):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["Liberté", "NATURE9natures", "×÷éàüÿ", "short", "ÀÉÎÕÜß", "abcdef-ghijkl", "x" * 5000]) for _ in range(rng.randrange(60))) for i in range(60)}
    texts |= {100: None, 101: "", 102: "Liberté" * 3}
    seen: Counter[str] = Counter()
    rows = [(i, t, 1, "h") for i, t in texts.items()] + [(5, texts[5], 1, "h"), (None, "Liberté " * 50, 1, "h")]
    for i, t, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 3 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            seen[run] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, run int, h string")
    got = {r.word: r.n for r in spelling.vocabulary(docs, one_in=3).collect()}
    assert got == {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5} and got


def least_moved(supply: list[int], capacity: list[int], cost) -> int:
    """By trying all flows of whole units."""
    best = None
    ways = [[f for f in product(range(s + 1), repeat=len(capacity)) if sum(f) == s] for s in supply]
    for flow in product(*ways):
        if all(sum(f[j] for f in flow) <= c for j, c in enumerate(capacity)):
            total = sum(f[j] * cost(i, j) for i, f in enumerate(flow) for j in range(len(capacity)))
            best = total if best is None else min(best, total)
    return best


def test_flow_is_cheapest():
    rng = random.Random(2)
    for _ in range(60):
        supply = [rng.randrange(4) for _ in range(3)]
        capacity = [rng.randrange(4) for _ in range(3)]
        capacity[0] += max(0, sum(supply) - sum(capacity))
        table = [[rng.randrange(6) for _ in range(3)] for _ in range(3)]
        cost = lambda i, j, table=table: table[i][j]
        flow = resharding.cheapest(supply, capacity, cost)
        assert [sum(f) for f in flow] == supply and all(sum(f[j] for f in flow) <= c for j, c in enumerate(capacity))
        assert sum(f[j] * cost(i, j) for i, f in enumerate(flow) for j in range(3)) == least_moved(supply, capacity, cost)
    with pytest.raises(ValueError):
        resharding.cheapest([3], [2])


SHARDED = "doc_id long, text string, source string, shard int, size long, o int, rows int, first int"


def sharded(spark):
    rng = random.Random(6)
    texts = [None, "", "é" * 50, "copy " * 8] + ["w" * rng.randrange(300) for _ in range(400)] + ["copy " * 8] * 300 + ["long " * 3000]
    rows = [(i if i % 9 else None, t, "s", rng.choice([0, 0, 0, 1, 2, 7, None]), i, 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:5], SHARDED).repartition(4)


def test_resharding(spark):
    docs = sharded(spark)
    old = resharding.laid(docs, F.col("shard"), 3, block_bytes=2000)
    new = resharding.resharded(old, 4)
    got = resharding.contents(new).toPandas()
    want = docs.toPandas()
    assert len(got) == len(want)
    key = ["doc_id", "text", "shard", "size"]
    assert sorted(map(str, got[key].astype(object).where(got[key].notna(), None).values.tolist())) == sorted(map(str, want[key].astype(object).where(want[key].notna(), None).values.tolist()))
    sizes = got["text"].map(lambda t: len((t or "").encode()) + 1)
    assert (got["__size"] == sizes).all()
    total = got.groupby("__shard")["__size"].sum()
    assert sum(old.sizes) == sizes.sum() and len(total) == 4
    cut = 41  # the least row left of a divided block is a copy of 41 bytes at most
    assert total.max() - total.min() <= 3 * cut  # of some 21750 bytes a shard
    for _, part in got.groupby("__shard"):
        assert sorted(part["__slot"]) == list(range(len(part)))
    # the fewest bytes move: what a shard has above its new capacity
    capacity = resharding.equal(sum(old.sizes), 4)
    moved = sum(f for i, row in enumerate(new.flow) for j, f in enumerate(row) if i != j)
    assert moved == sum(max(0, s - c) for s, c in zip(old.sizes, capacity, strict=False))
    files = new.files.toPandas()
    kept = files[files["__kept"]]
    assert len(kept) and (kept["__shard"] == kept["__old"]).all()
    really = got.assign(was=got["shard"].map(lambda s: int(s) if s == s and s is not None and 0 <= s < 3 else 0))
    bytes_moved = really[really["was"] != really["__shard"]]["__size"].sum()
    assert abs(int(bytes_moved) - moved) <= 8 * cut
    # blocks that stay whole are read where they lay: only the others are written
    written = spark.read.parquet(new.moved).count()
    assert written == files[~files["__kept"]]["rows"].sum() < len(got)


def test_fewer_shards_given_capacities_and_no_rows(spark):
    docs = sharded(spark)
    old = resharding.laid(docs, F.col("shard"), 5, block_bytes=5000)
    total = sum(old.sizes)
    new = resharding.resharded(old, 2, [total // 3, total - total // 3])
    got = resharding.contents(new).groupBy("__shard").agg(F.sum("__size").alias("n")).collect()
    assert all(abs(r.n - [total // 3, total - total // 3][r["__shard"]]) <= 3 * 41 for r in got)
    none = resharding.resharded(resharding.laid(docs.where("false"), F.col("shard"), 3), 4)
    assert resharding.contents(none).count() == 0


def test_divided_blocks_miss_by_less_than_the_least_row():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = rng.integers(1, 90, 60)
        amount = int(rng.integers(0, sizes.sum()))
        to = resharding._divided([5, 2], sizes, [amount, int(sizes.sum()) - amount])
        left = sizes[to == 2]
        assert 0 <= amount - sizes[to == 5].sum() < (left.min() if len(left) else 90)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_spelling"])
def test_agrees_with_duckdb(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    sql = {"op11_prefix_trie": oracle.PREFIX_TRIE, "op12_spelling": oracle.SPELLING}[name]
    got, want = queries.QUERIES[name](spark, folder).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)

    def plain(frame: pd.DataFrame) -> list[tuple]:
        return sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))

    assert plain(got) == plain(want) and len(got)


def test_op13_columns(spark):
    out = queries.QUERIES["op13_resharding"](spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = out.collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
