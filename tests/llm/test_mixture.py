"""The mixture must be in the pipeline's result, and keep to the exact weights."""

from __future__ import annotations

from fractions import Fraction

import corpus_pipeline
from framequarry.llm import mixing
from framequarry.llm.storage import stored


def lag(order: list[str], weights: dict[str, float]) -> Fraction:
    """The largest distance in blocks of a source from its exact weight."""
    total = sum(map(Fraction, weights.values()))
    share = {s: Fraction(w) / total for s, w in weights.items()}
    seen, worst = dict.fromkeys(weights, 0), Fraction(0)
    for t, s in enumerate(order, 1):
        seen[s] += 1
        worst = max(worst, *(abs(share[x] * t - seen[x]) for x in weights))
    return worst


def test_mixture_is_in_the_result(spark):
    sizes = {"a": 900, "b": 100, "c": 400}
    of = {}
    for s, n in sizes.items():
        of |= {len(of) + i: s for i in range(n)}
    rows = [(i, f"text {i}", "en", s, 9) for i, s in of.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    stages = dict(corpus_pipeline.STAGES)
    mixed = stored(stages["mixing"](spark, docs, ""), "mixing")
    out = stored(stages["byte_bpe"](spark, mixed, ""), "byte_bpe").collect()
    assert sorted(r.doc_id for r in out) == sorted(of)
    assert len({(r.slot, r.place) for r in out}) == len(out)
    source = {}
    for r in out:
        assert source.setdefault(r.slot, of[r.doc_id]) == of[r.doc_id]
    order = [source[t] for t in range(len(source))]
    until = min(max(t for t, x in enumerate(order) if x == s) for s in sizes) + 1  # the first source is used up
    assert until > 20
    assert lag(order[:until], {s: n**0.5 for s, n in sizes.items()}) < 1


def test_exact_weights():
    cases = [
        ({"big": 10**0.5} | {f"s{i}": 1.0 for i in range(19)}, 20_000),
        ({"tiny": 0.00001, "a": 0.5, "b": 0.3}, 300_000),
        ({f"s{i}": (i + 1) ** 0.5 for i in range(600)}, 3000),
    ]
    for weights, n in cases:
        blocks = dict.fromkeys(weights, n)
        order = {t: s for s, (slots, phases) in mixing.scheduled(blocks, weights).items() for t, p in zip(slots, phases, strict=True) if p == 0}
        checked = [order[t] for t in range(min(len(order), 400_000 // len(weights) + 2000))]
        assert lag(checked, weights) < 1


def test_tiny_weight_and_many_sources(spark):
    rows = [(i, f"s{i % 600}") for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    out = mixing.mixed(docs, weights={"s0": 0.00001}, exponent=0.0, block=1).collect()
    assert sorted(r.doc_id for r in out) == list(range(1800))
    assert sorted(r.slot for r in out) == list(range(1800))
    order = [r.source for r in sorted(out, key=lambda r: r.slot) if r.phase == 0]
    assert len(order) > 600
    assert lag(order, {f"s{i}": 1.0 for i in range(600)} | {"s0": 0.00001}) < 1
