"""Media columns: chroma fingerprints of audio, and their alignment.

Samples become frames, frames a spectrum, the spectrum 12 pitch classes. Sixteen
filters, each the difference of two rectangles of the chroma image, are read off
its integral image in constant time; each gives two bits (Gray code of four
ranges), so a time step is one packed 32-bit integer.

Alignment: recordings with the same sequence of integers are one class. Queries
meet classes in a join on keys; of each pair the offsets between equal keys are
counted, each offset is judged by the share of differing bits over the overlap,
and of those that pass the fullest wins.

Keys are bits of the integers of a step and the next (locality-sensitive
hashing): each of `tables` masks keeps `bits` of the 64. Both are fixed, so
whether two recordings meet depends on them alone, not on what else the table
holds; chance meetings of a query therefore grow with the table, by some 2**-40 a
pair of steps and table (more, as bits go together). `keys_for` gives other widths,
for callers that would rather have recall follow the size. Runs of one integer count once, as in silence. A key that many recordings hold
makes a vote for each query that holds it; votes are only counted.

The keys are an approximation. Of 384 pairs of a tune and a noisy copy whose bits
differ in a fifth at most, 40 bits and 16 tables find 0.94, whole integers 0.76.

Nulls and recordings too short for one step have no integers and match nothing,
not even each other. Silence has chroma zero, which is a valid image.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

STEPS = 12  # frames that a filter may span
BITS, TABLES = 40, 16  # of the keys
_BATCH = 64


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the 16 filters: four kinds at
    four places, by rule."""
    return [(kind, (5 * i + 3 * kind) % 8, 3 + (i + kind) % 3, 4 * (1 + (i + kind) % 3)) for kind in range(4) for i in range(4)]


def chroma(samples: np.ndarray, rate: int, size: int = 1024, hop: int = 512) -> np.ndarray:
    """Frames x 12 shares of the energy of each pitch class, 28 to 3520 Hz."""
    n = 1 + (len(samples) - size) // hop if len(samples) >= size else 0
    if not n:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float64), size)[::hop][:n]
    power = np.abs(np.fft.rfft(frames * np.hanning(size), axis=1)) ** 2
    hertz = np.fft.rfftfreq(size, 1 / rate)
    use = (hertz >= 28) & (hertz <= 3520)
    pitch = np.round(12 * np.log2(hertz[use] / 440)).astype(int) % 12
    image = power[:, use] @ np.eye(12)[pitch]
    total = image.sum(axis=1, keepdims=True)
    return np.where(total > 1e-9, image / np.maximum(total, 1e-9), 0)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """Packed integers, one for each frame from which STEPS frames follow."""
    n = len(image) - STEPS + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    sums = np.zeros((len(image) + 1, 13))
    sums[1:, 1:] = image.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0: np.ndarray, t1: np.ndarray, y0: int, y1: int) -> np.ndarray:
        return sums[t1, y1] - sums[t0, y1] - sums[t1, y0] + sums[t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        y1, mid_t, mid_y = min(12, y + h), w // 2, y + h // 2
        whole = area(t, t + w, y, y1)
        if kind == 0:  # against the rest of the frames' classes
            other = area(t, t + w, 0, 12) - whole
        elif kind == 1:  # first half of the time against the second
            whole, other = area(t, t + mid_t, y, y1), area(t + mid_t, t + w, y, y1)
        elif kind == 2:  # lower classes against higher
            whole, other = area(t, t + w, y, mid_y), area(t, t + w, mid_y, y1)
        else:  # checkerboard
            one = area(t, t + mid_t, y, mid_y) + area(t + mid_t, t + w, mid_y, y1)
            whole, other = one, whole - one
        ratio = np.log1p(whole) - np.log1p(other)
        level = np.digitize(ratio, [-0.25, 0.0, 0.25])
        out = out << np.uint32(2) | (level ^ level >> 1).astype(np.uint32)
    return out


def _prints(rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _BATCH):
                part = batch.slice(i, _BATCH)
                out = []
                for b in part.column(1).to_pylist():
                    own = np.frombuffer(b[: len(b) // 2 * 2], "<i2") if b else np.empty(0, "<i2")
                    out.append(fingerprint(chroma(own, rate)).view(np.int32).tolist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.int32()))], ["__id", "prints"])

    return run


def fingerprints(media: DataFrame, id_col: str = "id", pcm_col: str = "pcm", rate: int = 8000) -> DataFrame:
    """(id, prints) of a column of 16-bit little-endian mono samples."""
    base = media.select(F.col(id_col).alias("__id"), F.col(pcm_col).alias("__pcm"))
    kind = base.schema["__id"].dataType.simpleString()
    return base.mapInArrow(_prints(rate), f"__id {kind}, prints array<int>").withColumnRenamed("__id", id_col)


def _bits_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Share of differing bits of two sequences at an offset."""
    for batch in batches:
        names = batch.schema.names
        out, spans = [], []
        columns = [batch.column(names.index(c)) for c in ("prints_q", "prints_r", "offset")]
        for q, r, d in zip(*[c.to_pylist() for c in columns], strict=True):
            a, b = np.array(q, np.int32).view(np.uint32), np.array(r, np.int32).view(np.uint32)
            lo, hi = max(0, d), min(len(a), len(b) + d)
            n = hi - lo
            spans.append(max(n, 0))
            out.append(float(np.bitwise_count(a[lo:hi] ^ b[lo - d : hi - d]).sum() / (32 * n)) if n > 0 else 1.0)
        keep = ["class_q", "class_r", "offset", "votes"]
        yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in keep], pa.array(spans, pa.int32()), pa.array(out)], [*keep, "steps", "bit_error"])


def masks(bits: int, tables: int) -> list[int]:
    """Masks of 64 bits with some of them set, as signed integers."""
    rng = np.random.default_rng(77)
    chosen = [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(tables)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in chosen]


def keys_for(n: int) -> tuple[int, int]:
    """Bits of a key and number of tables by which a query's chance meetings stay
    as they are while n grows; what is found then depends on n."""
    return min(64, max(16, round(2.5 * np.log2(max(n, 2))))), max(4, round(0.62 * max(n, 1) ** 0.3))


def aligned(prints: DataFrame, queries: DataFrame, id_col: str = "id", max_error: float = 0.2, min_steps: int = 24, bits: int = BITS, tables: int = TABLES) -> DataFrame:
    """prints: (id, prints), queries: ids. For each query the classes of
    recordings it aligns with, its own included: id, class_id (least id of the
    query's class), match_class, offset (steps from the match to the query),
    votes, steps (of the overlap: min_steps at least, or the whole of a shorter
    recording), bit_error. `classes` tells which recordings a class has."""
    named = stored(classes(prints, id_col), "classes")
    kind = prints.schema[id_col].dataType.simpleString()
    heads = named.where(F.col(id_col) == F.col("class_id")).select("class_id", "prints").dropDuplicates(["class_id"])
    wanted = named.join(queries.select(id_col).distinct(), id_col, "left_semi").select(id_col, "class_id")
    chosen = masks(bits, tables)

    def pair(v: Column, t: Column) -> Column:
        after = F.coalesce(F.get("prints", (t + 1).cast("int")), v)
        return F.shiftleft(v.cast("long"), 32).bitwiseOR(after.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))

    steps = heads.select("class_id", F.transform("prints", pair).alias("pairs")).select("class_id", "pairs", F.posexplode("pairs").alias("t", "v"))
    steps = steps.where((F.col("t") == 0) | (F.get("pairs", F.col("t") - 1) != F.col("v"))).drop("pairs")
    keys = F.array(*[F.struct(F.lit(k).alias("part"), F.col("v").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(chosen)])
    asked = steps.join(wanted.select("class_id").distinct(), "class_id", "left_semi")
    asked, given = (x.select("class_id", "t", F.explode(keys).alias("k")).select("class_id", "t", "k.part", "k.key") for x in (asked, steps))
    votes = asked.alias("q").join(given.alias("r"), ["part", "key"]).groupBy(F.col("q.class_id").alias("class_q"), F.col("r.class_id").alias("class_r"), (F.col("q.t") - F.col("r.t")).alias("offset")).agg(F.count("*").alias("votes"))
    with_q = votes.join(heads.select(F.col("class_id").alias("class_q"), F.col("prints").alias("prints_q")), "class_q")
    with_r = with_q.join(heads.select(F.col("class_id").alias("class_r"), F.col("prints").alias("prints_r")), "class_r")
    overlap = F.least(F.size("prints_q"), F.size("prints_r") + F.col("offset")) - F.greatest(F.lit(0), F.col("offset"))
    with_r = with_r.where(overlap >= F.least(F.lit(min_steps), F.size("prints_q"), F.size("prints_r")))
    schema = f"class_q {kind}, class_r {kind}, offset int, votes long, steps int, bit_error double"
    good = with_r.mapInArrow(_bits_off, schema).where(F.col("bit_error") <= max_error)
    best = good.groupBy("class_q", "class_r").agg(F.max(F.struct("votes", -F.abs("offset"), "offset", "steps", "bit_error")).alias("b"))
    best = best.select("class_q", F.col("class_r").alias("match_class"), "b.offset", "b.votes", "b.steps", "b.bit_error")
    return wanted.join(best, wanted["class_id"] == best["class_q"]).select(id_col, "class_id", "match_class", "offset", "votes", "steps", "bit_error")


def classes(prints: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, class_id, prints) of recordings with prints: class_id is the least
    id with the same sequence (compared by two 64-bit hashes)."""
    key = [F.xxhash64("prints").alias("h1"), F.xxhash64(F.reverse("prints")).alias("h2")]
    keyed = prints.where((F.size("prints") > 0) & F.col(id_col).isNotNull()).select(id_col, "prints", *key)
    least = keyed.groupBy("h1", "h2").agg(F.min(id_col).alias("class_id"))
    return keyed.join(least, ["h1", "h2"]).select(id_col, "class_id", "prints")
