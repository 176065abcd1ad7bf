"""How the queries get tool calls and audio out of tables that have neither.

The rules are deterministic; the operators know nothing of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Schemas of the tools that the derived calls name.
SCHEMAS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}},
    "summarise": {"type": "object", "required": ["text", "words"], "properties": {"text": {"type": "string"}, "words": {"type": "integer", "minimum": 10}}},
    "translate": {"type": "object", "required": ["text", "to"], "properties": {"text": {"type": "string"}, "to": {"type": "string", "enum": ["de", "en", "es", "fr"]}}},
}


def calls_of(conversations: DataFrame) -> DataFrame:
    """Each assistant turn as a call; by a hash of its place it may need the
    call two turns before. Some arguments break their schema."""
    h = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(840))
    text = F.coalesce("text", F.lit(""))
    arguments = (
        F.when(h % 3 == 0, F.to_json(F.struct(text.alias("query"), (h % 120).alias("limit"))))
        .when(h % 3 == 1, F.to_json(F.struct(text.alias("text"), (h % 70).alias("words"))))
        .otherwise(F.to_json(F.struct(text.alias("text"), F.element_at(F.array(*[F.lit(x) for x in ("fr", "de", "en", "es", "xx")]), (h % 5 + 1).cast("int")).alias("to"))))
    )
    name = F.when(h % 3 == 0, "search").when(h % 3 == 1, "summarise").otherwise("translate")
    needs = F.when((h % 4 == 0) & (F.col("turn") >= 2), F.array(F.concat(F.lit("call_"), (F.col("turn") - 2).cast("string"))))
    base = conversations.where("role = 'assistant'")
    return base.select("conv_id", F.concat(F.lit("call_"), F.col("turn").cast("string")).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), needs.alias("needs"))


def results_of(conversations: DataFrame) -> DataFrame:
    """Each later user turn as the result of the call of the turn before."""
    base = conversations.where("role = 'user' and turn > 0")
    return base.select("conv_id", F.concat(F.lit("call_"), (F.col("turn") - 1).cast("string")).alias("call_id"), "turn", F.col("text").alias("content"))


def _tones(rate: int, note: int):
    clock = np.arange(note) / rate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                out = []
                for v in part.column(1).to_pylist():
                    pitch = np.clip(np.round(np.nan_to_num(np.array(v or [], float)) * 40), -24, 24)
                    hertz = 440 * 2 ** (pitch / 12)
                    wave = np.sin(2 * np.pi * hertz[:, None] * clock)
                    out.append((8000 * wave).astype("<i2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["id", "pcm"])

    return run


def audio_of(embeddings: DataFrame, rate: int = 8000, note: int = 512) -> DataFrame:
    """A recording per vector: a tone for each value, its pitch by the value."""
    return embeddings.select(F.col("vec_id").alias("id"), "embedding").mapInArrow(_tones(rate, note), "id long, pcm binary")
