"""The pipeline against plain versions of its stages, one after another."""

from __future__ import annotations

import re

import corpus_pipeline
from framequarry.llm import quality

from . import brute
from .test_near import shingles, similar
from .test_operators import KIND, corpus, tiktoken_encoding


def test_pipeline(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = corpus() | {100 + i: re.sub(r"w(\d)", rf"v{i}\1", corpus()[5] or "")[: 400 + 37 * i] for i in range(6)}
    rows = [(i, t, ["en", "fr"][i % 2], f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in quality.rules(docs).where("kept").collect()}
    sets = {i: shingles(texts[i]) for i in kept}
    head = {i: i for i in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and similar(sets[a], sets[b]):
                x, y = sorted((head[a], head[b]))
                head = {i: x if h == y else h for i, h in head.items()}
    left = {i: texts[i] for i, h in head.items() if i == h}
    seen, after = set(), {}
    for i in sorted(left):
        words = brute.words(left[i])
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            key = tuple(words[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        after[i] = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode() if any(gone) else left[i]
    own = tiktoken_encoding()
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: own.encode_ordinary(t or "") for i, t in after.items()}
    assert len(got) > 10


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", None, i, 1, "s") for i, t in corpus().items()], KIND)
    docs = docs.selectExpr("doc_id", "text", "lang", "source", "h n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
