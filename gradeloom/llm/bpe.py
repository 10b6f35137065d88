"""Operator 10: byte-level BPE encoding and decoding of whole texts.

The work on bytes is in ``bpe_fst``; here it is applied to DataFrames. There is no shuffle:
each task reads texts in Arrow batches and yields a row for each, so memory is bounded by a
batch, the vocabulary and the bounded caches, and a lost task is simply run again.

Nulls and empty texts have no tokens. Repeated rows give repeated results. Columns other
than those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common
from .bpe_fst import Decimals, codec, forget

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

#: Texts that are encoded together, and about how many bytes of them.
TOGETHER, TOGETHER_BYTES = 1024, 4 << 20

OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
    "round_trip": T.BooleanType(),
}


def _column(output: str, ids: np.ndarray, ends: np.ndarray, decimals: Decimals, back: tuple[memoryview, np.ndarray] | None, of: list[str] = ()) -> pa.Array:
    if output == "n_tokens":
        return pa.array(np.diff(ends), pa.int64())
    if output == "ids":
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
    if output == "ids_sha256":
        return pa.array(decimals.digests(ids, ends), pa.string())
    data, at = back
    texts = [data[i:j] for i, j in zip(at.tolist(), at[1:].tolist())]
    if output == "round_trip":
        return pa.array([bytes(t) == own.encode("utf-8") for t, own in zip(texts, of, strict=True)], pa.bool_())
    if output == "decoded":
        return pa.array([bytes(t).decode("utf-8") for t in texts], pa.string())
    return pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())


def encode(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    outputs: tuple[str, ...] = ("n_tokens", "ids"),
    ranks_path: str = RANKS,
    pattern: str = PATTERN,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """key, the kept columns and, of each text's tokens, the outputs: n_tokens, ids, the text decoded from
    the ids, SHA-256 digests of the decimal ids joined by commas and of the decoded bytes, and round_trip,
    whether the ids decode to the text."""
    decodes = any(o.startswith("decoded") or o == "round_trip" for o in outputs)
    kept = [key, *keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("bpe", forget)
        encoder, decoder, decimals = codec(ranks_path, pattern)
        for rows in common.portions(batches, len(kept), TOGETHER, TOGETHER_BYTES):
            texts = [t or "" for t in rows.column(len(kept)).to_pylist()]
            ids, ends = encoder.encode_batch(texts)
            back = decoder.decode_batch(ids, ends) if decodes else None
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], *(_column(o, ids, ends, decimals, back, texts) for o in outputs)], names=[*kept, *outputs])

    schema = T.StructType([*(df.schema[k] for k in kept), *(T.StructField(o, OUTPUTS[o]) for o in outputs)])
    return common.arrow_rows(df, [*kept, text]).mapInArrow(run, schema)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """key and the text that the ids spell; bytes that aren't UTF-8 become U+FFFD. Null ids: an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("bpe", forget)
        _, decoder, _ = codec(ranks_path, pattern)
        for rows in common.smaller(batches):
            texts = ["".join(decoder.stream(x or ())) for x in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, type=pa.string())], names=[key, "decoded"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("decoded", T.StringType())])
    return common.arrow_rows(df, [key, ids]).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_byte_bpe: doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    documents = common.table(spark, sf_dir, "documents")
    return encode(documents, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
