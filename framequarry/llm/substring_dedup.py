"""Substring dedup: seed and extend over winnowed anchors.

Words are `[^\\x20\\x09-\\x0D]+`; a window is `window` consecutive words of one
document. A word goes if a window that covers it also starts earlier (smaller
id, or same document and earlier start), judged on the input.

1. Seeds. Each window picks its least `gram`-word sequence (by hash) as anchor,
   so equal windows pick equal anchors; about one word in nine is an anchor. An
   aggregate finds the anchors that occur twice or more, a join finds where.
2. Extension. Around each repeated anchor, both ways, lie the windows that hold
   it; nothing else can repeat. Their hashes are aggregated to the earliest
   place of each: partial aggregates stand before the shuffle, so a passage that
   a third of all documents share costs one row a task.
3. Maximal repeats. Windows round repeated anchors that aren't the earliest of
   their kind merge into maximal spans of words.

Text is shuffled once, by id; all other shuffles carry numbers. No group of
equal windows or anchors ever meets in one task: the only joins are on anchors
(a skewed side can be split) and on ids.

Nulls: a null text has no words; rows with a null id are kept, but neither
match nor lose words. Texts of fewer words than a window stay whole. Of rows
that share an id, the one whose text has the lesser 64-bit hash is earlier; rows
that share id and text are one document, and each of them gets its result. Extra
columns pass through `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import stored

_ID, _TWIN, _TEXT = "__id", "__twin", "__text"


def _named(part: pa.RecordBatch, keys: list[str], rows: np.ndarray) -> list[pa.Array]:
    """The key columns of some rows of a batch."""
    at = pa.array(rows)
    return [part.column(part.schema.get_field_index(k)).take(at) for k in keys]


def _anchors(window: int, gram: int, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in K.pieces(batch, _TEXT):
                words = K.Words(data, off)
                if len(words) < window:
                    continue
                grams = K.Poly(words.hashes(), K.WORD_BASE).grams(gram)
                whole = words.text[window - 1 :] == words.text[: len(words) - window + 1]
                at = K.winnowed(grams, window - gram + 1, whole)
                text = words.text[at]
                place = pa.array((at - words.first[text]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), *_named(part, keys, text), place], ["h", *keys, "at"])

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each (null: no values)."""
    lengths = np.nan_to_num(np.asarray(column.value_lengths().fill_null(0)))
    return np.asarray(column.flatten(), np.int64), np.repeat(np.arange(len(column)), lengths)


def _round(words: K.Words, anchors: np.ndarray, rows: np.ndarray, window: int, gram: int) -> np.ndarray:
    """First words of the windows that hold a repeated anchor."""
    if not len(anchors):
        return np.empty(0, np.int64)
    first, last = words.first[rows], words.first[rows + 1] - window
    low = np.maximum(first + anchors - (window - gram), first)
    high = np.minimum(first + anchors, last)
    steps = np.zeros(len(words) + 1, np.int32)
    np.add.at(steps, low, 1)
    np.add.at(steps, high + 1, -1)
    return np.flatnonzero(np.cumsum(steps[:-1]) > 0)


def _windows(window: int, gram: int, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in K.pieces(batch, _TEXT):
                words = K.Words(data, off)
                anchors, rows = _flat(part.column(part.schema.get_field_index("anchors")))
                starts = _round(words, anchors, rows, window, gram)
                if not len(starts):
                    continue
                h = K.Poly(words.hashes(), K.WORD_BASE).of(starts, starts + window)
                text = words.text[starts]
                _, keep = np.unique(K.mix(h + K.mix(text.astype(np.uint64))), return_index=True)
                keep.sort()
                starts, h, text = starts[keep], h[keep], text[keep]
                place = pa.array((starts - words.first[text]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *_named(part, keys, text), place], ["h", *keys, "at"])

    return run


def _spans(window: int, gram: int, texts: bool, carried: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in K.pieces(batch, _TEXT):
                words = K.Words(data, off)
                anchors, rows = _flat(part.column(part.schema.get_field_index("anchors")))
                again = np.zeros(len(words) + 1, bool)
                again[_round(words, anchors, rows, window, gram)] = True
                firsts, rows = _flat(part.column(part.schema.get_field_index("firsts")))
                again[words.first[rows] + firsts] = False
                gone = K.covered(np.flatnonzero(again[:-1]), window, len(words))
                lost = np.concatenate([[0], np.cumsum(gone)])
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                # spans don't run over into the next text
                cut = words.first[1:-1]
                cut = cut[(cut > 0) & (cut < len(words))]
                inner = cut[gone[cut - 1] & gone[cut]] if len(cut) else cut
                begin = np.sort(np.concatenate([np.flatnonzero(edge == 1), np.unique(inner)]))
                end = np.sort(np.concatenate([np.flatnonzero(edge == -1), np.unique(inner)]))
                base = words.first[words.text[begin]] if len(begin) else begin
                per = np.bincount(words.text[begin], minlength=len(part)) if len(begin) else np.zeros(len(part), np.int64)
                spans = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], ["begin", "end"]),
                )
                out = [part.column(part.schema.get_field_index(_ID)), *[part.column(part.schema.get_field_index("__row"))] * carried, pa.array(words.count.astype(np.int64)), pa.array((lost[words.first[1:]] - lost[words.first[:-1]]).astype(np.int64)), spans]
                if texts:
                    stay = ~gone
                    raw, kept = data.tobytes(), []
                    for i in range(len(part)):
                        a, b = words.first[i], words.first[i + 1]
                        if lost[b] == lost[a]:
                            kept.append(raw[off[i] : off[i + 1]] if carried else b" ".join(raw[off[i] : off[i + 1]].split()))
                        else:
                            own = np.flatnonzero(stay[a:b]) + a
                            kept.append(b" ".join([raw[s:e] for s, e in zip(words.start[own].tolist(), words.end[own].tolist(), strict=True)]))
                    out.append(pa.array(kept, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(out, [_ID, *["__row"] * carried, "n_words", "n_removed", "spans", *(["kept"] if texts else [])])

    return run


def _found(base: DataFrame, window: int, gram: int, texts: bool) -> DataFrame:
    """base: __id, __text and perhaps __row, which is carried along."""
    if not 1 <= gram <= window:
        raise ValueError("gram lies between 1 and window")
    kinds = dict(base.dtypes)
    kind, carried = kinds[_ID], "__row" in kinds
    known = base.where(F.col(_ID).isNotNull())
    keys = [_ID]
    if known.groupBy(_ID).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        # ids alone don't tell rows apart
        base = base.withColumn(_TWIN, F.xxhash64(F.coalesce(_TEXT, F.lit(""))))
        known, keys = base.where(F.col(_ID).isNotNull()), [_ID, _TWIN]
    row = ", ".join(["h long", f"{_ID} {kind}", *[f"{_TWIN} long"] * (len(keys) - 1), "at int"])
    some = known.select(*keys, _TEXT).where(F.col(_TEXT).isNotNull())
    if len(keys) > 1:
        some = some.dropDuplicates(keys)
    anchors = some.mapInArrow(_anchors(window, gram, keys), row)  # worked out twice: the table would be larger than the work
    repeated = stored(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    places = anchors.join(repeated.hint("shuffle_hash"), "h").groupBy(*keys).agg(F.sort_array(F.collect_list("at")).alias("anchors"))
    places = stored(places, "places")
    text = known.repartition(*keys)
    # all columns go along, so that both uses of the text read one shuffle
    around = text.join(places.hint("shuffle_hash"), keys).select(*base.columns, "anchors")
    windows = around.mapInArrow(_windows(window, gram, keys), row).groupBy("h")
    if len(keys) == 1:
        first = windows.agg(F.min(_ID).alias(_ID), F.min_by("at", _ID).alias("at"))
    else:
        first = windows.agg(F.min(F.struct(*keys, "at")).alias("m")).select("m.*")
    firsts = first.groupBy(*keys).agg(F.collect_list("at").alias("firsts"))
    marks = places.join(firsts, keys, "left")
    extra = f"__row {kinds['__row']}, " if carried else ""
    out = f"{_ID} {kind}, {extra}n_words long, n_removed long, spans array<struct<begin:int,end:int>>" + ", kept string" * texts
    whole = text.join(marks.hint("shuffle_hash"), keys, "left").select(*base.columns, "anchors", "firsts")
    nothing = F.lit(None).cast("array<int>")
    unnamed = base.where(F.col(_ID).isNull()).select("*", nothing.alias("anchors"), nothing.alias("firsts"))
    return whole.union(unnamed).mapInArrow(_spans(window, gram, texts, carried), out)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 5, texts: bool = True) -> DataFrame:
    """One row per document: id, n_words, n_removed, spans (maximal runs of
    removed words as [begin, end) places) and, if texts, kept (the kept words
    joined by one space)."""
    base = docs.select(F.col(id_col).alias(_ID), F.col(text_col).alias(_TEXT))
    return _found(base, window, gram, texts).withColumnRenamed(_ID, id_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 5) -> DataFrame:
    """docs with the repeated words cut out of the text column; texts that lose
    nothing stay as they are, byte for byte (a null one becomes empty); the
    others are the kept words joined by one space. All rows and columns stay."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.lit(0).alias("_"))
    base = docs.select(F.col(id_col).alias(_ID), F.col(text_col).alias(_TEXT), row.alias("__row"))
    found = _found(base, window, gram, True)
    back = {id_col: F.col(_ID), text_col: F.col("kept")} | {c: F.col(f"__row.c{i}") for i, c in enumerate(rest)}
    return found.select(*[back[c].alias(c) for c in docs.columns])
