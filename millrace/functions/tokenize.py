"""Pre-tokenization on columns, and encoding and decoding with a public vocabulary file in Arrow batches.

Vocabularies are never trained here; the distributed half of counting pieces is ``piece_counts``.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the published pre-tokenizer pattern, in Java's syntax. Unicode classes without U+001C to
#: U+001F as white space are what the tokenizers library's engine has.
SPLIT = r"(?U)(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


def pieces(text: Column | str) -> Column:
    """The pieces of a text; joined, they give it back."""
    return F.regexp_extract_all(text, F.lit(SPLIT), F.lit(0))


def piece_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(piece, n) over all documents; counts combine before the shuffle."""
    return docs.select(F.explode(pieces(text)).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


@functools.lru_cache(maxsize=2)
def _tokenizer(source: str):
    import os

    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_str(source)


def encoder(spark: SparkSession, source: str, bos: int | None = None):
    """A function from a text column to arrays of ids, ``bos`` first if given; null texts have none of their own."""
    held = spark.sparkContext.broadcast(source)

    @F.arrow_udf("array<int>")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok, first = _tokenizer(held.value), [] if bos is None else [bos]
        for texts in parts:
            found = [np.array(first + e.ids, np.int32) for e in tok.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))

    return encode


def decoder(spark: SparkSession, source: str):
    """A function from an array of ids to text, special tokens kept."""
    held = spark.sparkContext.broadcast(source)

    @F.arrow_udf("string")
    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = _tokenizer(held.value)
        for ids in parts:
            yield pa.array(tok.decode_batch([x or [] for x in ids.to_pylist()], skip_special_tokens=False), pa.string())

    return decode


def digest(ids: str):
    """SHA-256 of an array of ids as little-endian 32-bit integers, in hex."""

    @F.arrow_udf("string")
    def sha(parts: pa.Array) -> pa.Array:
        return pa.array([None if not x.is_valid else hashlib.sha256(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()).hexdigest() for x in parts], pa.string())

    return sha(ids)
