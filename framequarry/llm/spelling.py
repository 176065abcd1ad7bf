"""Spelling variants: words one edit apart, over a bit-sliced position index.

The index has a bitset over the words for each (place, letter). A word q of length
m is run through it letter by letter, for all words at once: Z holds those that
equal q so far, S those with one letter replaced, I those with one letter more,
which are read one place further on:

    I = (I | Z) & B[i + 1][q[i]]
    S = (S & B[i][q[i]]) | (Z & ~B[i][q[i]])
    Z = Z & B[i][q[i]]

A word with one letter less is the same link seen from the shorter word, so q only
looks among words of its length and one more. The bitsets of a place are made when
it is reached, so long words take no more memory than short ones.

One index over a whole vocabulary would make each word pass over all others. An edit
lies in one piece of a word and leaves the other pieces as they are, so words are
dealt into blocks by (length m, piece, letters outside the piece): two halves a word
first, for m of its own length and one less. A block of more than `most` words is
cut further: its words are dealt anew by the halves of the piece, until the piece is
a single letter, where the alphabet bounds a block. That is exact, and no block
grows with the vocabulary. Small blocks share an index. An edit that fits several
pieces (a doubled letter) counts in the one that holds the first difference.

Nulls: a null text has no words; a null id is the empty string in `<id>:<run>`.
Texts of any length are taken whole; rows repeated in full count each. An empty
table has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHORTEST = 6  # below it a word has no two pieces that tell enough
_SLICE = 1024  # words that small blocks fill an index with
_FULL = ~np.uint64(0)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, one_in: int = 199) -> DataFrame:
    """(word, n) of the words of 6 letters or more with `least` occurrences or
    more. A run of letters whose CRC-32 of `<id>:<run>` is a multiple of `one_in`
    loses a letter; that is how misspellings get into the corpus."""
    text = F.translate(F.col(f"`{text_col}`"), _UPPER, _LOWER)
    runs = F.regexp_extract_all(text, F.lit(rf"[a-zÀ-ÿ]{{{_SHORTEST},}}"), F.lit(0))
    own = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.select(own.alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= _SHORTEST).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def _matches(codes: np.ndarray, lengths: np.ndarray, ell: int) -> tuple[np.ndarray, np.ndarray]:
    """codes: a row of letters per word, zeros after its end. Pairs (i, j) with
    word i of ell letters and word j one edit away, of ell letters or ell + 1."""
    n, lanes = len(codes), -(-len(codes) // 64)
    asks = np.flatnonzero(lengths == ell)

    def bits(rows: np.ndarray) -> np.ndarray:
        packed = np.zeros((len(rows), lanes * 8), np.uint8)
        packed[:, : -(-n // 8)] = np.packbits(rows, axis=1, bitorder="little")
        return packed.view(np.uint64)

    letters = np.unique(codes)
    letters = letters[letters > 0]
    digit = np.zeros(int(letters.max()) + 1, np.int64)
    digit[letters] = np.arange(len(letters))
    sets = bits(letters[:, None] == codes[None, :, 0])
    zero = np.full((len(asks), lanes), _FULL)
    one, more = np.zeros_like(zero), np.zeros_like(zero)
    for i in range(ell):
        ahead = bits(letters[:, None] == codes[None, :, i + 1])
        q = digit[codes[asks, i]]
        here = sets[q]
        more = (more | zero) & ahead[q]
        one = (one & here) | (zero & ~here)
        zero &= here
        sets = ahead
    size = bits(np.stack([lengths == ell, lengths == ell + 1]))
    found = (one & size[0]) | ((more | zero) & size[1])
    a, b = np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, count=n, bitorder="little"))
    return asks[a], b


def _sliced(blocks: np.ndarray, ells: np.ndarray) -> list[tuple[int, int]]:
    """Runs of whole blocks of one length, of some _SLICE words."""
    starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
    ends = np.r_[starts[1:], len(blocks)]
    out: list[tuple[int, int]] = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if out and out[-1][1] == a and ells[out[-1][0]] == ells[a] and b - out[-1][0] <= _SLICE:
            out[-1] = (out[-1][0], b)
        elif b - a > 1:
            out.append((a, b))
    return out


def _links(table: pa.Table) -> pa.RecordBatch:
    """table: whole blocks, sorted by ell and block."""
    table = table.combine_chunks()
    block, ells, low, high, n = (np.asarray(table.column(c)) for c in ("block", "ell", "lo", "hi", "n"))
    sizes = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
    shared = np.repeat(np.diff(sizes) > 1, np.diff(sizes))
    block, ells, low, high, n = (x[shared] for x in (block, ells, low, high, n))
    words = table.column("word").combine_chunks().filter(pa.array(shared))
    spelt, left, right = words.to_pylist(), [], []
    for a, b in _sliced(block, ells):
        ell = int(ells[a])
        lengths = np.array([len(w) for w in spelt[a:b]])
        codes = np.zeros((b - a, ell + 1), np.uint32)
        flat = np.frombuffer("".join(spelt[a:b]).encode("utf-32-le"), np.uint32)
        codes[np.arange(ell + 1) < lengths[:, None]] = flat
        i, j = _matches(codes, lengths, ell)
        same = block[a + i] == block[a + j]
        i, j = i[same], j[same]
        first = (codes[i] != codes[j]).argmax(axis=1)
        within = (first >= low[a + i]) & ((first < high[a + i]) | ((first == ell) & (high[a + i] == ell)))
        i, j = i[within], j[within]
        longer = lengths[j] > ell
        left += [a + i, a + j[longer]]
        right += [a + j, a + i[longer]]
    x, y = (np.concatenate(s) if s else np.empty(0, np.int64) for s in (left, right))
    return pa.RecordBatch.from_arrays([words.take(pa.array(x)), words.take(pa.array(y)), pa.array(n[y])], ["word", "near", "near_n"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ell and block; a block may go over several of them."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 8 * _SLICE:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        block, ell = np.asarray(table.column("block")), np.asarray(table.column("ell"))
        change = np.flatnonzero((block[1:] != block[:-1]) | (ell[1:] != ell[:-1]))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield _links(table.slice(0, cut))
        held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        yield _links(pa.Table.from_batches(held))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows: word, n, ell, lo, hi. The same with the block, by the letters
    outside the piece from lo to hi."""
    rest = F.substring("word", F.length("word") - (F.col("ell") - F.col("hi")) + 1, F.length("word"))
    return rows.withColumn("block", F.xxhash64("ell", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), rest))


def _halves(lo: Column, hi: Column) -> Column:
    mid = F.floor((lo + hi) / 2).cast("int")
    return F.explode(F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi"))))


def near(words: DataFrame, most: int = 4096) -> DataFrame:
    """words: word (6 letters or more), n. (word, near, near_n) for every two
    words that differ by exactly one inserted, deleted or replaced letter, both
    ways. most: words in a block that is not cut further."""
    size = F.length("word")
    ells = F.when(size > _SHORTEST, F.array(size, size - 1)).otherwise(F.array(size))
    rows = words.select("word", "n", F.explode(ells).alias("ell"))
    rows = rows.select("*", _halves(F.lit(0), F.col("ell")).alias("p")).select("word", "n", "ell", "p.lo", "p.hi")
    found = None
    while True:
        rows = _dealt(rows)
        big = rows.where("hi - lo > 1").groupBy("block").agg(F.count("*").alias("many")).where(F.col("many") > most).select("block")
        big = stored(big, "blocks")
        small = rows.join(big, "block", "left_anti").repartition("block").sortWithinPartitions("ell", "block")
        kernel = small.select("block", "ell", "lo", "hi", "word", "n").mapInArrow(_near, "word string, near string, near_n long")
        found = stored(kernel, "near") if found is None else found.union(stored(kernel, "near"))
        if big.isEmpty():
            return found
        rows = rows.join(big, "block", "left_semi").select("word", "n", "ell", _halves(F.col("lo"), F.col("hi")).alias("p"))
        rows = stored(rows.select("word", "n", "ell", "p.lo", "p.hi"), "pieces")


def _roots(forms: DataFrame) -> DataFrame:
    """forms: word, form (not null). (word, root) by doubling: rounds grow with
    the logarithm of the longest chain, and each form is `ratio` times as frequent
    as its word, so chains are short."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        both = now.join(ahead, "root", "left")
        new = stored(both.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def forms(words: DataFrame, ratio: int = 5, most: int = 4096) -> DataFrame:
    """words: word, n. One row a word: its form (the most frequent word one edit
    away, if it is `ratio` times as frequent; ties: the first in code-point order),
    root (form of form, to the last), n, n_near (words one edit away), form_n."""
    words = stored(words, "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best")
    told = near(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best)
    both = words.join(told, "word", "left")
    given = -F.col("best.minus") >= ratio * F.col("n")
    named = both.select("word", F.when(given, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(given, -F.col("best.minus")).alias("form_n"))
    named = stored(named, "forms")
    roots = _roots(named.where("form is not null"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
