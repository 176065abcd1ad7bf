"""The operators against plain versions, with the hard cases mixed in: nulls,
empty and long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import zlib
from fractions import Fraction
from itertools import count, islice
from math import ceil, floor

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framequarry.llm import bpe, chroma, components, mixing, quality, simhash, substring_dedup, suffix_dedup, token_counts, token_store, tool_calls
from framequarry.llm import kernels as K

from . import brute

KIND = "doc_id long, text string, lang string, source string, h long, at int, spans string"
TIKTOKEN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def corpus() -> dict[int, str | None]:
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "Été", "naïve", "x", "don't", "漢字", "12", "###", "été", "foo!", "a.b"] + [f"w{i}" for i in range(60)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = prose(60), prose(12)
    docs: dict[int, str | None] = {0: None, 1: "", 2: "   \n\t ", 3: "one", 4: "one two", 5: prose(3000)}
    for i in range(6, 40):
        docs[i] = prose(rng.randint(21, 150))
    for i in range(40, 60):
        docs[i] = f"{prose(rng.randint(0, 30))} {passage} {prose(rng.randint(0, 30))}"
    docs[60] = docs[61] = docs[39]
    docs[62] = (docs[39] or "") + " tail"
    docs[63] = "\n".join([line] * 5 + ["", "  ", line + " "])
    docs[64] = "ab " * 400
    docs[65] = passage.upper() + "\x85　" + passage
    docs[66] = "x" * 700 + " " + "é" * 300
    docs[67] = " ".join((passage.split()[:25]) * 3)
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None, "xx"][i % 4], ["a", "b", None][i % 3] if i > 30 else "hot", i, 1, "s") for i, t in corpus().items()]
    return spark.createDataFrame(rows, KIND).repartition(3).cache()


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], KIND)


def test_substring_dedup(docs, empty):
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.repeats(docs).collect()}
    assert got == brute.substring(corpus())
    assert substring_dedup.repeats(empty).count() == 0
    out = substring_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[7] == corpus()[7] and text[60] == ""
    assert substring_dedup.deduplicated(empty).count() == 0


def test_suffix_dedup(docs, empty, monkeypatch):
    want = brute.bytes_(corpus())
    for size in (1 << 30, 4000):
        monkeypatch.setattr(suffix_dedup, "_RUN_BYTES", size)
        monkeypatch.setattr(suffix_dedup, "_CHUNK", 3000)
        got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.repeats(docs).collect()}
        assert got == want
    assert suffix_dedup.repeats(empty).count() == 0


def test_loser_tree():
    rng = random.Random(2)
    for _ in range(50):
        runs = []
        for _ in range(rng.randint(1, 7)):
            strings = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 12)))
            shared = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(strings, strings[1:])]
            runs.append((strings, shared[: len(strings)]))
        order, shared = suffix_dedup.merge(runs)
        merged = [runs[r][0][i] for r, i in order]
        assert merged == sorted(s for strings, _ in runs for s in strings)
        for k in range(1, len(merged)):
            a, b = merged[k - 1], merged[k]
            assert a[: shared[k]] == b[: shared[k]] and (shared[k] == min(len(a), len(b)) or a[shared[k]] != b[shared[k]])


def test_front_coding():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64) >> np.arange(500, dtype=np.uint64) % np.uint64(60))
    assert (suffix_dedup.unpacked(suffix_dedup.packed(keys), len(keys)) == keys).all()


def test_simhash(docs, empty):
    want = brute.simhash(corpus())
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want
    left = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    assert left == {i for i, (_, c) in want.items() if i == c}
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_of_random_fingerprints(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for b in base for _ in range(6)}
    signed = [simhash._signed(p % (1 << 64)) for p in prints]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert got == want


def test_allocation_gives_enough_thresholds():
    rng = np.random.default_rng(1)
    for n in (10, 10**6, 10**10):
        parts = simhash.allocated(simhash.chances(rng.integers(1, 50, (8, 256)), 2), n, 2)
        assert sum(t + 1 for _, _, t in parts) == 3


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(None, 3), (5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e if None not in e}
    for _ in range(len(edges)):
        for a, b in edges:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    linked = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert got == {x: label[x] for x in linked}


def test_quality(docs, empty):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.rules(docs).collect()}
    assert got == {i: brute.quality(t) for i, t in corpus().items()}
    assert quality.rules(empty).count() == 0
    assert quality.accepted(docs).columns == docs.columns


def test_quality_rejects_symbol_noise(spark):
    rng = random.Random(8)
    plain = lambda n: " ".join(rng.choice(["the", "of", "and", "in", f"word{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"]) for _ in range(n))
    noise = " ".join(w + rng.choice(["###", "&&&", "$$$", "%%%"]) for w in plain(90).split())
    rows = [(i, plain(100), "en") for i in range(30)] + [(99, noise, "en"), (100, noise, "xx"), (101, noise[:60], "en")]
    got = {r.doc_id: r for r in quality.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[99].class_distance > 0.27 and not got[99].kept
    assert got[100].class_distance is None and got[100].kept  # no reference for its language
    assert got[101].class_distance is None  # too short to judge
    assert all(got[i].kept for i in range(30))


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TIKTOKEN, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, empty):
    own = tiktoken_encoding()
    for r in bpe.encoded(docs, TIKTOKEN).collect():
        text = corpus()[r.doc_id] or ""
        assert r.ids == own.encode_ordinary(text)
        assert sum(r.counts) == len(r.ids) and r.offsets == sorted(r.offsets)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decoded(bpe.encoded(docs, TIKTOKEN), TIKTOKEN).collect()}
    assert back == {i: (t or "").encode() for i, t in corpus().items()}
    assert bpe.encoded(empty, TIKTOKEN).count() == 0


def test_byte_bpe_on_random_text():
    own, mine, rng = tiktoken_encoding(), bpe.Encoder.of(TIKTOKEN), random.Random(7)
    signs = ["a", "s", "t", "re", "ve", "ll", "d", "m", "'", " ", "  ", "\n", " ", "　", "1", "٣", "é", "漢", "!", "😀", "é", "x" * 30]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    data, off = K.texts(pa.array(texts))
    ids, first, _, _ = mine.encode(data, off)
    assert all(ids[first[i] : first[i + 1]].tolist() == own.encode_ordinary(t) for i, t in enumerate(texts))


def longest_cut(library, text: str, limit: int) -> int:
    """The longest prefix, in bytes, of limit tokens at most, by trying all."""
    if len(library.encode(text, add_special_tokens=False).ids) <= limit:
        return len(text.encode())
    heads = [text[:k] for k in range(min(len(text), 20 * limit + 900), -1, -1)]
    counts = (len(e.ids) for i in range(0, len(heads), 500) for e in library.encode_batch(heads[i : i + 500], add_special_tokens=False))
    return next(len(h.encode()) for h, n in zip(heads, counts) if n <= limit)


def test_cuts_within_long_words(spark):
    library = token_counts.Vocabulary.of(WORDS).library
    rng = random.Random(3)
    texts = ["漢字仮名交じり文" * 40, base64.b64encode(rng.randbytes(400)).decode(), "हिन्दी" * 60, "e\u0301a" * 80, "x" * 900, "don't" * 50, "'" * 300, "한국어" * 60, "\u1112\u1161\u11ab" * 40, "😀" * 90, "a\u3000b" * 70, "İ" * 90, "<|endoftext|>" * 30 + "<|endof", "##<|startoftext|>ab" * 20, "x" * 90 + "<|startof", "12" * 100, "Ω" * 99, "!?" * 99 + "'re" * 50]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in token_counts.token_counts(docs, WORDS, limit=17).collect():
        assert r.cut_bytes == longest_cut(library, texts[r.doc_id], 17), texts[r.doc_id][:20]
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_token_counts(docs, empty):
    library = token_counts.Vocabulary.of(WORDS).library
    for r in token_counts.token_counts(docs, WORDS, limit=40, curve=True).collect():
        text = corpus()[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 40)
        assert r.cut_bytes == longest_cut(library, text, 40)
        assert (r.totals[-1] if r.totals else 0) == n
    assert token_counts.token_counts(empty, WORDS).count() == 0


def test_counts_of_all_prefixes():
    v = token_counts.Vocabulary.of(WORDS)
    rng = random.Random(13)
    signs = ["a", "b", "the", "S", "é", "e\u0301", "漢", "'", "'s", "re", "12", "!", "#", "<|", "|>", "<|endoftext|>", "<", "\u0338", "İ", "ß", "\u3000", "\xa0", "한", "\u1112\u1161", "\u11ab", "हि", "😀", "Σ", "x" * 70, "!" * 70]
    texts = ["internationalization", "aaaaaaaaaaa", "hello!!99", "Straße", "don't", "thththonere", "x" * 300, "漢字" * 50]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    data, off = K.texts(pa.array(texts))
    at, n = v.counts(data, K.Words(data, off))
    for i, t in enumerate(texts):
        raw = t.encode()
        for k in range(1, len(raw) + 1):
            got = v.words.pool[at[i] + k - 1]
            if k == len(raw) or raw[k] & 0xC0 != 0x80:
                assert got == len(v.library.encode(raw[:k].decode(), add_special_tokens=False).ids)
            else:
                assert got == -1


def test_token_store(docs, empty):
    library = token_store.Encoder.of(WORDS).library
    shards = token_store.write(docs, WORDS, shard_ids=500)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.contents(shards).collect()}
    want, start = {}, 0
    for i in sorted(corpus()):
        ids = [*library.encode(corpus()[i] or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    few = {r.doc_id: r.ids for r in token_store.lookup(shards, [3, 41, 1000]).collect()}
    assert set(few) == {3, 41} and few[3][-1] == 2
    assert token_store.contents(token_store.write(empty, WORDS)).count() == 0


def test_perfect_hash():
    for n in (0, 1, 2, 5, 300, 3000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        slots = token_store.slot_of(keys, token_store.perfect_hash(keys), max(1, len(keys)))
        assert sorted(slots.tolist()) == list(range(len(keys)))


def test_schedule():
    for weights in ({"a": 1.0, "b": 2.0}, {"a": 5.0, "b": 3.0, "c": 2.0}, {"a": 1.0, "b": 1e-6}, {f"s{i}": (i + 1) ** 0.5 for i in range(20)}):
        order = list(islice(mixing.earliest_deadlines(mixing.exact(weights)), 20_000))
        assert mixing.deviation(order, weights) < Fraction(1)


def plain_schedule(blocks: dict[str, int], weights: dict[str, float]) -> list[str]:
    """Slot by slot: of the released blocks the one due first, phase by phase."""
    left, order = {s: n for s, n in blocks.items() if n}, []
    while left:
        total, done = sum(Fraction(weights[s]) for s in left), dict.fromkeys(left, 0)
        share = {s: Fraction(weights[s]) / total for s in left}
        for t in count():
            due = [(ceil((done[s] + 1) / share[s]), s) for s in left if floor(done[s] / share[s]) <= t]
            s = min(due)[1]
            order.append(s)
            done[s] += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
    return order


def test_schedule_equals_the_plain_one():
    rng = random.Random(11)
    for _ in range(30):
        weights = {f"s{i}": rng.choice([1.0, 2.0, 0.3, rng.random() + 0.01]) for i in range(rng.randint(1, 7))}
        blocks = {s: rng.randint(0, 40) for s in weights}
        at = {t: s for s, (slots, _) in mixing.scheduled(blocks, weights).items() for t in slots}
        assert [at[t] for t in range(len(at))] == plain_schedule(blocks, weights)


def test_mixing(docs, empty):
    out = mixing.mixed(docs, block=2, bucket_rows=10).collect()
    assert sorted(r.doc_id for r in out) == sorted(corpus())
    assert len({(r.slot, r.place) for r in out}) == len(out)
    slots = sorted({(r.slot, r.source, r.block) for r in out}, key=lambda x: x[0])
    assert [s for s, _, _ in slots] == list(range(len(slots)))
    for source in {r.source for r in out}:
        assert [b for _, s, b in slots if s == source] == list(range(sum(s == source for _, s, _ in slots)))
    assert mixing.mixed(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(docs, max_sources=1)
    ordered = mixing.in_order(docs, block=2)
    assert ordered.columns == docs.columns and ordered.count() == docs.count()
    longer = mixing.mixed(docs, block=2, most_blocks=9).agg(F.countDistinct("slot"), F.max("place")).first()
    assert longer[0] <= 9 + 3 and longer[1] == -(-len(corpus()) // 9) - 1


def test_mixing_with_clashing_names_null_and_repeated_ids(spark):
    rows = [(None if i % 3 else 7, ["a", "\x00none", None, ""][i % 4], i, 5, 6, 7, 8, "z") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, own long, slot int, place int, block int, phase int, `a.b` string").repartition(3)
    out = mixing.mixed(docs, block=4, bucket_rows=8)
    assert sorted(out.columns) == sorted(docs.columns)
    got = out.collect()
    assert sorted(r.own for r in got) == list(range(200))
    assert len({(r.slot, r.place) for r in got}) == 200
    assert all(len({r.source for r in got if r.slot == t}) == 1 for t in {r.slot for r in got})
    again = {(r.own, r.slot, r.place) for r in mixing.mixed(docs.repartition(5), block=4, bucket_rows=8).collect()}
    assert again == {(r.own, r.slot, r.place) for r in got}  # the order of the input doesn't matter
    ordered = mixing.in_order(docs)
    assert ordered.columns == docs.columns and {r.slot for r in ordered.collect()} == {5}


CALLS = "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}


def test_tool_calls(spark):
    calls = [
        (1, "a", 1, "f", '{"x": 1}', None),
        (1, "b", 3, "f", '{ "x" : -1 }', ["a"]),
        (1, "c", 5, "f", '{"y": 1, "x": "q"}', ["b", "a", "a"]),
        (1, "d", 7, "g", "{", ["e"]),
        (1, "e", 9, "g", "[1]", ["d"]),
        (1, "m", 9, "f", '{"x": true}', ["nowhere"]),
        (2, "a", 1, "f", '{"x": 2}', []),
        (2, "a", 2, "f", '{"x": 3}', []),
        (None, "a", 1, "f", '{"x": 4}', None),
        (3, None, 1, None, None, None),
    ]
    results = [(1, "a", 2, "ü"), (1, "a", 4, "later"), (1, "c", 6, None), (2, "z", 1, "lost"), (None, "a", 1, "no")]
    out = tool_calls.linked(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    by = {(r.conv_id, r.call_id, r.turn): r for r in out}
    assert by[1, "a", 1].status == "linked" and by[1, "a", 1].level == 0 and by[1, "a", 1].result_turn == 2
    assert by[1, "a", 1].message == '{"call":{"function":{"arguments":{"x":1},"name":"f"},"id":"a","type":"function"},"result":"ü"}'
    assert by[1, "b", 3].level == 1 and by[1, "b", 3].status == "unanswered" and by[1, "b", 3].errors == ["$.x: minimum"]
    assert by[1, "c", 5].level == 2 and by[1, "c", 5].errors == ["$.x: type", "$.y: additionalProperties"]
    assert {by[1, k, t].status for k, t in (("d", 7), ("e", 9), ("m", 9))} == {"blocked"}
    assert by[1, "d", 7].errors == ["$: json"] and by[1, "e", 9].errors == ["name: unknown"] and by[1, "m", 9].errors == ["$.x: type"]
    assert by[2, "a", 1].valid
    assert by[2, "a", 2].status == "duplicate" and by[2, "z", None].status == "orphan"
    assert sum(r.status == "duplicate" for r in out) == 2  # a call and a result
    assert len(out) == 13
    none = tool_calls.linked(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMAS)
    assert none.count() == 0


def test_tool_call_arguments():
    bad = ["{", "[" * 200_000, '{"x": NaN}', '{"x": -Infinity}', '{"x": 1e999}', "", "nul", "1" * 5000]
    for text in bad:
        with pytest.raises(ValueError):
            tool_calls.parsed(text)
    assert tool_calls.canonical(tool_calls.parsed('{"b":1.5, "a":"\\ud800 \\ud83d\\ude00"}')) == '{"a":"\\ud800 😀","b":1.5}'
    rules = {"type": ["integer", "null"], "enum": [1, None, 7.0]}
    assert [tool_calls.violations(v, rules) for v in (1, 1.0, None, 7)] == [[]] * 4
    assert tool_calls.violations(True, rules) == ["$: type"] and tool_calls.violations(1.5, rules) == ["$: type"] and tool_calls.violations(2, rules) == ["$: enum"]
    assert tool_calls.violations(True, {"enum": [1]}) == ["$: enum"] and tool_calls.violations([{"a": 1}], {"enum": [[{"a": 1.0}]]}) == []
    assert tool_calls.violations(1, {"type": "nothing known"}) == ["$: type"]


def plain_links(calls: list[tuple], results: list[tuple]) -> list[tuple]:
    """(conv, call, turn, result turn, status, level) by plain loops."""
    out, heads, answers = [], {}, {}
    big = lambda row: tuple((x is not None, x) for x in row)
    for c in sorted(calls, key=lambda c: big((c[2], c[3], c[4]))):
        if c[0] is None or c[1] is None:
            out.append((c[0], c[1], c[2], None, "blocked" if c[5] else "unanswered", None))
        elif c[:2] in heads:
            out.append((*c[:3], None, "duplicate", None))
        else:
            heads[c[:2]] = c
    for r in sorted(results, key=lambda r: big(r[2:])):
        if r[0] is None or r[1] is None:
            out.append((r[0], r[1], None, r[2], "orphan", None))
        elif r[:2] in answers:
            out.append((*r[:2], None, r[2], "duplicate", None))
        else:
            answers[r[:2]] = r
    level = {k: 0 for k, c in heads.items() if not c[5]}
    while True:
        new = {k: 1 + max(level[k[0], n] for n in c[5]) for k, c in heads.items() if k not in level and all((k[0], n) in level for n in c[5] or [])}
        if not new:
            break
        level |= new
    for k, c in heads.items():
        status = "blocked" if k not in level else "linked" if k in answers else "unanswered"
        out.append((*k, c[2], answers[k][2] if k in answers else None, status, level.get(k)))
    out += [(*k, None, r[2], "orphan", None) for k, r in answers.items() if k not in heads]
    return out


def test_tool_calls_against_plain_loops(spark):
    rng = random.Random(6)
    calls, results = [], []
    for conv in [1, 2, 3, None]:
        for i in range(60):
            needs = rng.choice([None, [], [f"c{i - 1}"], [f"c{i - 1}"], [f"c{i - 2}", f"c{rng.randrange(60)}"] if i % 9 == 0 else [f"c{i - 1}", f"c{i - 1}"]])
            calls.append((conv, rng.choice([f"c{i}"] * 9 + [None, "c3"]), i, "f", rng.choice(['{"x": 1}', "[" * 9000, '{"x":"\\ud800"}', None]), needs))
            results.append((conv, f"c{rng.randrange(70)}", i, rng.choice([None, "", "r" * 9000, "\ue000"])))
    calls += [(4, f"d{i}", i, "f", None, [f"d{i - 1}"] if i else []) for i in range(300)]  # a long chain
    calls += [(5, "p", 0, "f", None, ["q"]), (5, "q", 1, "f", None, ["p"]), (5, "s", 2, "f", None, ["s"]), (5, "t", 3, "f", None, ["q", "d0"])]
    calls += [calls[0]] * 3
    results += [results[0]] * 3
    out = tool_calls.linked(spark.createDataFrame(calls, CALLS).withColumn("status", F.lit("x")), spark.createDataFrame(results, RESULTS).withColumn("name", F.lit(1)), SCHEMAS).collect()
    got = sorted((str((r.conv_id, r.call_id, r.turn, r.result_turn, r.status, r.level)) for r in out))
    assert got == sorted(map(str, plain_links(calls, results)))
    assert all(isinstance(json.loads(r.message), dict) for r in out)


def tune(seed: int, notes: int, rate: int = 8000) -> np.ndarray:
    rng = np.random.default_rng(seed)
    t = np.arange(1024) / rate
    return np.concatenate([np.sin(2 * np.pi * 440 * 2 ** (k / 12) * t) for k in rng.integers(-20, 20, notes)])


def pcm(wave: np.ndarray) -> bytes:
    return (8000 * wave).astype("<i2").tobytes()


def test_chroma(spark):
    wave, noise = tune(1, 40), np.random.default_rng(2).normal(0, 0.02, 40 * 1024)
    rows = [(1, pcm(wave)), (2, pcm(wave)), (3, pcm(wave[8 * 512 :])), (4, pcm(wave + noise)), (5, pcm(tune(9, 40))), (6, None), (7, b"\x00"), (8, pcm(np.zeros(20000)))]
    prints = chroma.fingerprints(spark.createDataFrame(rows, "id long, pcm binary"))
    found = {(r.id, r.match_class): r for r in chroma.aligned(prints, prints.where("id in (2, 6, 8)")).collect()}
    assert found[2, 1].class_id == 1 and found[2, 1].bit_error == 0 and found[2, 1].offset == 0
    assert found[2, 3].offset == 8 and found[2, 3].bit_error < 0.05
    assert found[2, 4].offset == 0 and found[2, 4].bit_error < 0.2
    assert (2, 5) not in found and not any(k[0] == 6 for k in found)
    assert chroma.aligned(prints.where("id > 100"), prints).count() == 0


def test_recall_of_noisy_and_shifted_copies(spark):
    """Every two recordings at every offset, in plain loops."""
    rng = np.random.default_rng(5)
    scores = [rng.integers(-20, 20, 45) for _ in range(60)]
    t = np.arange(512) / 8000
    wave = lambda notes: np.concatenate([np.sin(2 * np.pi * 440 * 2 ** (k / 12) * t) for k in notes])
    rows = []
    for i, notes in enumerate(scores):
        rows.append((10 * i, pcm(wave(notes))))
        for k, changed in enumerate((1, 2, 3, 4, 6)):
            own = notes.copy()
            own[rng.choice(45, changed, replace=False)] += rng.choice([-1, 1], changed)
            rows.append((10 * i + 1 + k, pcm(wave(own[k % 3 :]))))
    prints = chroma.fingerprints(spark.createDataFrame(rows, "id long, pcm binary")).cache()
    steps = {r.id: np.array(r.prints, np.int32).view(np.uint32) for r in prints.collect()}
    want = set()
    for a in range(0, 600, 10):
        for b in steps:
            for d in range(-3, 4):
                lo, hi = max(0, d), min(len(steps[a]), len(steps[b]) + d)
                if np.bitwise_count(steps[a][lo:hi] ^ steps[b][lo - d : hi - d]).sum() <= 0.2 * 32 * (hi - lo):
                    want.add((a, b))
    head = {r.id: r.class_id for r in chroma.classes(prints).collect()}
    found = {(r.id, r.match_class) for r in chroma.aligned(prints, prints.where("id % 10 = 0")).collect()}
    hit = sum((a, head[b]) in found for a, b in want)
    print(f"pairs {len(want)}, found {hit}")
    assert len(want) > 250 and hit >= 0.95 * len(want)
    for n in (10_000, 50_000):  # the keys of larger tables
        bits, tables = chroma.keys_for(n)
        found_then = {(r.id, r.match_class) for r in chroma.aligned(prints, prints.where("id % 10 = 0"), bits=bits, tables=tables).collect()}
        then = sum((a, head[b]) in found_then for a, b in want)
        print(f"keys of {n} classes: {then}")
        assert then >= 0.9 * len(want)
    assert all((a, head[a]) in found for a in range(0, 600, 10))
    assert all(any((a, b) in want for b in steps if head[b] == c) for a, c in found)


def test_matches_do_not_depend_on_the_size_of_the_table(spark):
    rng = np.random.default_rng(6)
    ints = lambda n: rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)
    rows = []
    for i in range(40):
        one = ints(30)
        flips = np.packbits(rng.random((30, 32)) < 0.15, axis=1).view(">u4").ravel().astype(np.uint32)
        rows += [(2 * i, one.view(np.int32).tolist()), (2 * i + 1, (one ^ flips).view(np.int32).tolist())]
    more = [(100 + i, ints(25).view(np.int32).tolist()) for i in range(3000)]
    asked = spark.range(80)
    few, many = ({(r.id, r.match_class) for r in chroma.aligned(spark.createDataFrame(x, "id long, prints array<int>"), asked).collect()} for x in (rows, rows + more))
    assert few == many and {(i, i) for i in range(80)} < few


def test_silence_and_repeated_ids(spark):
    rows = [(1, pcm(np.zeros(9000))), (2, pcm(np.zeros(15000))), (3, pcm(tune(1, 40))), (3, pcm(tune(1, 40))), (4, pcm(tune(2, 40))), (4, pcm(tune(3, 40)))]
    prints = chroma.fingerprints(spark.createDataFrame(rows, "id long, pcm binary"))
    found = {(r.id, r.match_class) for r in chroma.aligned(prints, prints).collect()}
    assert {(1, 2), (2, 1), (3, 3), (4, 4)} <= found


def test_integral_image_sums():
    image = np.random.default_rng(3).random((30, 12))
    assert len(chroma.fingerprint(image)) == 30 - chroma.STEPS + 1
    assert len(chroma.fingerprint(image[:5])) == 0
    assert (chroma.fingerprint(image)[4:] == chroma.fingerprint(image[4:])).all()


def test_rows_survive_extra_columns(docs):
    kept = quality.accepted(docs.withColumn("kept", F.lit(1)).withColumn("id", F.lit(2)).withColumn("row", F.lit(3)))
    assert kept.count() == quality.rules(docs).where("kept").count()
    assert {(r.kept, r.id, r.row) for r in kept.collect()} == {(1, 2, 3)}
    assert simhash.deduplicated(docs.withColumn("fp", F.lit(1))).count() > 0
    assert substring_dedup.deduplicated(docs.withColumn("anchors", F.lit(1)).withColumn("kept", F.lit(1))).count() == docs.count()


def test_quality_judges_rows_not_ids(spark):
    good = " ".join(f"the{i}" for i in range(40))
    rows = [(None, good, "en"), (None, "too short", "en"), (5, good, None), (5, "ab " * 50, "en"), (6, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted((r.doc_id or 0, r.text) for r in quality.accepted(docs).collect()) == [(0, good), (5, good)]


def test_substring_dedup_with_repeated_and_null_ids(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(f"v{rng.randrange(300)}" for _ in range(n))
    passage = prose(40)
    texts = [(7, passage + " " + prose(1000)), (7, prose(5) + " " + passage), (7, prose(3) + " " + passage), (3, prose(2000)), (3, passage), (3, passage), (None, passage), (None, None), (9, None), (9, ""), (8, prose(10) + " " + passage)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    hashed = {r.t: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    named = sorted({(i, hashed[t or ""], t or "") for i, t in texts if i is not None})
    want = brute.substring(dict(enumerate(t for _, _, t in named)))
    want = {(i, t): want[k] for k, (i, _, t) in enumerate(named)} | {(None, t or ""): brute.substring({0: t})[0] for i, t in texts if i is None}
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.repeats(docs).collect())
    assert got == sorted((str(i), *want[i, t or ""]) for i, t in texts)
    assert substring_dedup.deduplicated(docs).count() == len(texts)
