"""Chat formatting: linking of tool calls and results.

Calls and results are tables of their own, a row each. They meet in a hash join
on (conversation, identifier); a conversation's rows are never gathered in one
task, so one that holds a third of all rows is no harder than others.

Order: a call may need the results of others. Its level is one more than the
largest level of what it needs; (level, turn, call_id) is then an order in which
every call follows what it needs. Chains of calls with one need each are
shortened by doubling, in rounds that grow with the logarithm of their length;
calls with several needs are then settled in rounds, one for each such call on
the longest chain, and a need that is settled is not looked at again.

Arguments are checked against JSON schemas (type, required, properties,
additionalProperties, enum, minimum, maximum, minLength, maxLength, items), and
each call becomes one message in canonical JSON: keys sorted, no spaces, UTF-8,
with lone surrogates escaped, and one form for each number (1, 1.0 and 1e0 are
`1`, -0.0 is `0`, others have their shortest decimal form). Arguments that aren't
JSON, hold numbers that JSON has no form for (NaN, infinity, 1e999) or are nested
more than 400 levels deep are reported as `$: json` and stay a string in the
message. Where an object repeats a key, the last value counts and `$: repeated
key` names it.

Status: `linked`; `unanswered` (no result); `orphan` (a result without a call);
`blocked` (it needs a call that doesn't exist, is blocked or needs it in turn);
`duplicate` (a further call or result of one identifier). Nulls: rows with a null
conversation or identifier link to nothing; such results are orphans, such calls
are blocked if they need something and unanswered if not. Of several calls, or
results, of one identifier the first by turn counts; equal turns: the least text.
Every row given in is in the result: a linked call and its result share one row.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

_DEEPEST = 400  # levels; what is deeper is no use as arguments, and Python's readers and writers give out somewhere beyond
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": (int, float)}
_SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value: object) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _refused(text: str) -> float:
    raise ValueError(f"{text} isn't a number of JSON")


def _finite(text: str) -> float:
    value = float(text)
    return value if abs(value) < float("inf") else _refused(text)


def _number(text: str) -> float | int:
    value = _finite(text)
    return int(value) if value.is_integer() else value


def _depth(text: str) -> int:
    """Levels of brackets outside strings."""
    level = most = 0
    for c in re.findall(r"[\[\]{}]", _STRING.sub("", text)):
        level += 1 if c in "[{" else -1
        most = max(most, level)
    return most


def parsed(arguments: str) -> tuple[object, list[str]]:
    """The value of a JSON text, and the keys that an object repeats; ValueError
    where there is no value or one that is nested too deeply."""
    if _depth(arguments) > _DEEPEST:
        raise ValueError("nested too deeply")
    repeated: set[str] = set()

    def object_(pairs: list[tuple[str, object]]) -> dict:
        made = dict(pairs)
        if len(made) < len(pairs):
            repeated.update(k for k, n in Counter(k for k, _ in pairs).items() if n > 1)
        return made

    value = json.loads(arguments, parse_constant=_refused, parse_float=_number, object_pairs_hook=object_)
    return value, sorted(repeated)


def _is(value: object, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    whole = not isinstance(value, float) or value.is_integer()
    return isinstance(kind, str) and isinstance(value, _TYPES.get(kind, ())) and (kind != "integer" or whole)


def _equal(a: object, b: object) -> bool:
    """Equality of JSON values: true isn't 1, 1.0 is 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_equal(a[k], b[k]) for k in a)
    return a == b


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """What value breaks in a schema, as `place: rule`."""
    kinds = schema.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: type"]
    found = [f"{at}: enum"] if "enum" in schema and not any(_equal(value, e) for e in schema["enum"]) else []
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        found += [f"{at}: minimum"] if value < schema.get("minimum", value) else []
        found += [f"{at}: maximum"] if value > schema.get("maximum", value) else []
    if isinstance(value, str):
        found += [f"{at}: minLength"] if len(value) < schema.get("minLength", 0) else []
        found += [f"{at}: maxLength"] if len(value) > schema.get("maxLength", len(value)) else []
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += violations(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: additionalProperties")
    return found


def _checked(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, messages = [], []
            names = batch.schema.names
            for row in zip(*[batch.column(names.index(c)).to_pylist() for c in ("call_id", "name", "arguments", "content")], strict=True):
                call_id, name, arguments, content = row
                own: list[str] = []
                value: object = arguments
                try:
                    value, repeated = parsed(arguments) if arguments is not None else (None, [])
                    own = [f"$: repeated key {k}" for k in repeated]
                    if name is not None:
                        own += violations(value, schemas[name]) if name in schemas else ["name: unknown"]
                except ValueError:
                    own = ["$: json"]
                errors.append([_SURROGATE.sub("?", e) for e in own])
                call = {"id": call_id, "type": "function", "function": {"name": name, "arguments": value}}
                messages.append(canonical({"call": None if name is None and arguments is None else call, "result": content}))
            keep = [c for c in names if c != "arguments"]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in keep], pa.array(errors, pa.list_(pa.string())), pa.array(messages, pa.string())], [*keep, "errors", "message"])

    return run


_KEY = ["conv_id", "call_id"]


def _shortened(singles: DataFrame) -> DataFrame:
    """singles: conv_id, call_id, need. The same with need moved to the end of
    its chain, and the steps to it. Cycles never end: their needs stay within."""
    now = stored(singles.select(*_KEY, "need", F.lit(1).alias("steps")), "chain")
    most = now.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length()):
        ahead = now.select("conv_id", F.col("call_id").alias("need"), F.col("need").alias("far"), F.col("steps").alias("more"))
        if not now.join(ahead.select("conv_id", "need"), ["conv_id", "need"], "left_semi").limit(1).count():
            break
        now = now.join(ahead, ["conv_id", "need"], "left")
        now = stored(now.select(*_KEY, F.coalesce("far", "need").alias("need"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "chain")
    return now


def levels(calls: DataFrame) -> DataFrame:
    """calls: conv_id, call_id (unique, not null), needs. (conv_id, call_id,
    level) of the calls that can be ordered; what is left out is blocked."""
    keyed = calls.select(*_KEY, F.array_distinct("needs").alias("needs"))
    done = keyed.where(F.size("needs") == 0).select(*_KEY, F.lit(0).alias("level"))
    chains = _shortened(keyed.where(F.size("needs") == 1).select(*_KEY, F.get("needs", F.lit(0)).alias("need")))
    edges = keyed.where(F.size("needs") > 1).select(*_KEY, F.explode("needs").alias("need"))
    ends = chains.select("conv_id", F.col("call_id").alias("need"), F.col("need").alias("far"), "steps")
    edges = edges.join(ends, ["conv_id", "need"], "left").select(*_KEY, F.coalesce("far", "need").alias("need"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), F.lit(None).cast("int").alias("met"))
    edges, fresh = stored(edges, "needs"), done
    while True:
        # needs that were settled last; those of a call whose needs are all settled make it so
        new = fresh.select("conv_id", F.col("call_id").alias("need"), "level")
        edges = edges.join(new, ["conv_id", "need"], "left").select(*_KEY, "need", "steps", F.coalesce("met", F.col("level") + F.col("steps")).alias("met"))
        edges = stored(edges, "needs")
        whole = edges.groupBy(*_KEY).agg(F.max("met").alias("level"), F.count_if(F.col("met").isNull()).alias("open"))
        fresh = stored(whole.where("open = 0").select(*_KEY, "level"), "level")
        if not fresh.limit(1).count():
            break
        done = stored(done.union(fresh), "levels")
        edges = edges.join(fresh.select(*_KEY), _KEY, "left_anti")
    tails = chains.join(done.select("conv_id", F.col("call_id").alias("need"), "level"), ["conv_id", "need"])
    return done.union(tails.select(*_KEY, (F.col("level") + F.col("steps")).alias("level")))


def _first(rows: DataFrame, shape: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each identifier, and the others. Rows are counted before
    they meet, so that a row repeated often is one row."""
    some = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    counted = rows.where(some).groupBy(*_KEY, F.struct(*shape).alias("s")).agg(F.count("*").alias("n"))
    heads = counted.groupBy(*_KEY).agg(F.min("s").alias("head"))
    more = counted.join(heads, _KEY).withColumn("n", F.col("n") - F.when(F.col("s") == F.col("head"), 1).otherwise(0)).where("n > 0")
    others = more.select(*_KEY, "s.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("__k")).drop("__k")
    return heads.select(*_KEY, "head.*"), others


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls: conv_id, call_id, turn, name, arguments (JSON), needs (array of
    identifiers of the same conversation). results: conv_id, call_id, turn,
    content. One row per call, and per result that isn't a linked call's:
    conv_id, call_id, turn, result_turn, name, status, level, valid, errors,
    message."""
    loose = F.col("conv_id").isNull() | F.col("call_id").isNull()
    none = F.array().cast("array<string>")
    shape = ["turn", "name", "arguments", "needs"]
    calls = calls.select(*_KEY, *shape[:3], F.filter(F.coalesce("needs", none), lambda x: x.isNotNull()).alias("needs"))
    results = results.select(*_KEY, F.col("turn").alias("result_turn"), "content")
    keyed, more_calls = _first(calls, shape)
    answers, more_results = _first(results, ["result_turn", "content"])
    keyed = stored(keyed, "calls")
    is_call, is_result, again = F.lit(True).alias("is_call"), F.lit(True).alias("is_result"), F.lit(True).alias("again")
    both = keyed.select("*", is_call).join(answers.select("*", is_result), _KEY, "full").join(levels(keyed), _KEY, "left")
    for part in (calls.where(loose).select("*", is_call), results.where(loose).select("*", is_result), more_calls.select("*", is_call, again), more_results.select("*", is_result, again)):
        both = both.unionByName(part, allowMissingColumns=True)
    status = (
        F.when(F.col("again"), "duplicate")
        .when(F.col("is_call").isNull(), "orphan")
        .when(F.col("level").isNull() & (F.size(F.coalesce("needs", none)) > 0), "blocked")
        .when(F.col("is_result").isNull(), "unanswered")
        .otherwise("linked")
    )
    flat = both.select(*_KEY, "turn", "result_turn", "name", status.alias("status"), "level", "arguments", "content")
    kinds = dict(flat.dtypes)
    keep = [c for c in flat.columns if c != "arguments"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", errors array<string>, message string"
    return flat.mapInArrow(_checked(schemas), schema).withColumn("valid", F.size("errors") == 0)
