"""Quality rules: base counts and distribution divergence, all in built-in
expressions (no Python on the executors).

Base rules count words, symbols, repeated lines and words in repeated 5-word
windows within a text. The method then compares two histograms of a text, of
character classes and of common words, with those of its language over all
texts that pass the base rules, by Jensen-Shannon distance (square root of the
divergence to base 2, in [0, 1]). Short texts have noisy histograms, so a text
is judged only with `min_words` words and, for common words, `min_words` words
as well; a language without a reference rejects nothing.

One pass makes a narrow table of counts (some 150 bytes a text), kept in the
shared folder. The references are sums over it, one row per language of
`COMMON`, so their size is fixed; everything else is local to a row, and text
is never shuffled.

Windows within a text are compared by 64-bit hashes of their five words. Nulls:
a null text has no words (and fails the base rule); a null or unknown language
has no reference; null ids pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

SPACE = r"[\x20\x09-\x0D]"

#: Frequent function words of each language, the bins of the word histogram.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with", "as", "was", "be", "by", "at", "this", "from", "are"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus", "au", "sur", "avec"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
#: Character classes; what is in none of them is a lower-case or caseless letter or a rarer sign.
CLASSES = {
    "space": SPACE,
    "upper": r"[A-ZÀ-ÖØ-Þ]",
    "digit": r"[0-9]",
    "stop": r"[.,;:!?'\"()\-]",
    "symbol": r"[#*$%&|<>@/\\=+_~^{}\[\]]",
    "far": r"[^\x00-ɏ]",
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use mentions it."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words that lie in windows of size words that occur twice or more."""

    def cover(windows: Column) -> Column:
        tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        total = F.aggregate(
            let(tagged, places),
            start,
            lambda acc, i: F.struct((acc["n"] + size - F.greatest(F.lit(0), acc["end"] - i)).alias("n"), (i + size).alias("end")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), total).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) > size, let(hashes, cover)).otherwise(F.lit(0).cast("long"))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", whole: bool = False) -> DataFrame:
    """id, lang and all counts of each text; if whole, also the row itself, as a
    struct `row` of its columns in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    base = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text.alias("t"), *[row.alias("row")] * whole)
    t = F.col("t")
    own = [w for words in COMMON.values() for w in words]

    def bins(hits: Column) -> Column:
        def of(lang: str) -> Column:
            return F.array(*[F.size(hits) - F.size(F.array_remove(hits, w)) for w in COMMON[lang]])

        found = F.when(F.col("lang") == "en", of("en"))
        for lang in list(COMMON)[1:]:
            found = found.when(F.col("lang") == lang, of(lang))
        return found

    def per_word(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            let(F.filter(w, lambda x: x.isin(*sorted(set(own)))), bins).alias("common"),
        )

    words = F.array_remove(F.split(t, f"{SPACE}+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(rf"[^\x20\x09-\x0D]"))
    out = base.select(
        *[c for c in base.columns if c != "t"],
        F.length(t).cast("long").alias("n_chars"),
        *[F.regexp_count(t, F.lit(p)).cast("long").alias(c) for c, p in CLASSES.items()],
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words, per_word).alias("w"),
    )
    return out.select("*", "w.*").drop("w")


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda x, y: x + y)))


def rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 50,
    max_class_distance: float = 0.27,
    max_word_distance: float = 0.4,
) -> DataFrame:
    """One row per row of docs: id, base counts, base_failed, class_distance and
    word_distance (null where not judged), kept."""
    found = stored(counts(docs, id_col, text_col, lang_col), "quality")
    return _judged(found, min_words, max_class_distance, max_word_distance, []).withColumnRenamed("id", id_col)


def _judged(found: DataFrame, min_words: int, max_class_distance: float, max_word_distance: float, along: list[str]) -> DataFrame:
    """The verdicts on stored counts, with some columns of theirs."""
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = found.withColumn("base_failed", base_failed)
    known = [F.col(c) for c in CLASSES]
    classes = [*known, F.greatest(F.lit(0).cast("long"), F.col("n_chars") - sum(known[1:], known[0]))]
    n_common = len(next(iter(COMMON.values())))
    common = [F.get("common", F.lit(i)).cast("long") for i in range(n_common)]
    words = [*common, F.col("n_words") - sum(common[1:], common[0])]
    good = found.where(~F.col("base_failed") & (F.col("n_words") >= min_words) & F.col("common").isNotNull())
    sums = good.groupBy("lang").agg(F.array(*[F.sum(c) for c in classes]).alias("ref_class"), F.array(*[F.sum(c) for c in words]).alias("ref_word"))

    def shares(a: Column) -> Column:
        return let(F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y), lambda s: F.transform(a, lambda x: x / F.greatest(s, F.lit(1).cast("long"))))

    sums = sums.select("lang", shares(F.col("ref_class")).alias("ref_class"), shares(F.col("ref_word")).alias("ref_word"))
    judged = found.join(F.broadcast(sums), "lang", "left")  # a row for each language of COMMON at most
    long_enough = (F.col("n_words") >= min_words) & F.col("ref_class").isNotNull()
    judged = judged.withColumn("class_distance", F.when(long_enough, _distance(shares(F.array(*classes)), F.col("ref_class"))))
    judged = judged.withColumn("word_distance", F.when(long_enough, _distance(shares(F.array(*words)), F.col("ref_word"))))
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    return judged.select(
        "id",
        *along,
        "n_words",
        (F.col("n_chars") - F.col("space")).alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "class_distance",
        "word_distance",
        (~F.col("base_failed") & ~far).alias("kept"),
    )


def accepted(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 50,
    max_class_distance: float = 0.27,
    max_word_distance: float = 0.4,
) -> DataFrame:
    """The rows of docs that are kept. Rows are judged one by one, whatever their
    ids: they are stored with their counts, so text isn't shuffled."""
    found = stored(counts(docs, id_col, text_col, lang_col, whole=True), "quality")
    kept = _judged(found, min_words, max_class_distance, max_word_distance, ["row"]).where("kept")
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
