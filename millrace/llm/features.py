"""Hashed n-gram indicators of whole texts, vectorised over a batch, and bounded labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words
from millrace.session import cut

#: Indicators of one document and their document's row, each pair once.
Extract = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


class WordTable:
    """A bounded memo from words to rows of per-word hashes, kept as one array."""

    def __init__(self, of: Callable[[bytes], tuple[int, ...]], width: int, size: int = words.MEMO):
        self.of, self.width, self.size = of, width, size
        self.places: dict[bytes, int] = {}
        self.rows = np.zeros((1024, width), np.uint64)

    def look_up(self, split: list[list[bytes]], total: int) -> np.ndarray:
        """The rows of all words in turn."""
        place = self.find(split, total)  # may replace ``rows`` by a larger array
        return self.rows[place]

    def find(self, split: list[list[bytes]], total: int) -> np.ndarray:
        """The places of all words in ``rows``, good until the next call."""
        if len(self.places) > self.size:
            self.places.clear()
        places = self.places
        fresh = list({w for ws in split for w in ws if w not in places})
        if fresh:
            first = len(places)
            places.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            while len(self.rows) < len(places):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first : len(places)] = np.fromiter((x for w in fresh for x in self.of(w)), np.uint64, len(fresh) * self.width).reshape(-1, self.width)
        get = places.__getitem__
        return np.fromiter((get(w) for ws in split for w in ws), np.int64, total)


def fold(hashes: np.ndarray, bits: int, family: int) -> np.ndarray:
    """Hashes to indices below 2 ** bits, apart for each family of features."""
    return words.mix(hashes + words.step(family + 1)) >> np.uint64(64 - bits)


def once(doc: np.ndarray, index: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (document, index) pair once, in order."""
    key = np.sort(doc.astype(np.uint64) << np.uint64(bits) | index)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def agreed(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the ids whose labels in ``column`` all agree, each id once; null ids and labels are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(column).alias(column), F.max(column).alias("_hi"))
    return one.where(F.col(column) == F.col("_hi")).drop("_hi")


def first_by_hash(ids: DataFrame, n: int) -> DataFrame:
    """``n`` rows with distinct ids, spread evenly over them by a hash."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def sampled(docs: DataFrame, chosen: DataFrame, rows: int) -> DataFrame:
    """The texts of the chosen ids, as (doc_id, text, other columns of ``chosen``): each text of an id once, and at
    most ``rows`` texts, however often ids repeat.

    ``chosen`` is bounded by its maker, so it is broadcast.
    """
    ids = F.broadcast(chosen.select("doc_id").distinct())
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi").withColumn("_h", F.xxhash64("text"))
    picked = cut(named.select("doc_id", "_h").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_h").limit(rows))
    texts = named.join(F.broadcast(picked), ["doc_id", "_h"], "left_semi").groupBy("doc_id", "_h").agg(F.first("text").alias("text"))
    return texts.drop("_h").join(F.broadcast(chosen), "doc_id")


def sample(docs: DataFrame, chosen: DataFrame, make: Callable[[], Extract], rows: int) -> list[tuple]:
    """Features of the sampled texts, as (doc_id, indices, label), in the order of doc_id: bounded, so they fit the driver."""
    label = next(c for c in chosen.columns if c != "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = make()
        for batch, texts in words.text_batches(batches):
            doc, index = extract(texts)
            bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
            data = [index[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary()), batch.column("label")], names=["doc_id", "indices", "label"])

    texts = sampled(docs, chosen, rows).select("doc_id", "text", F.col(label).cast("int").alias("label"))
    found = texts.mapInArrow(run, "doc_id long, indices binary, label int").collect()
    found.sort(key=lambda r: (r[0], r[2], xxhash.xxh3_64_intdigest(r[1])))
    return [(r[0], np.frombuffer(r[1], "<u4"), r[2]) for r in found]


def score(docs: DataFrame, make: Callable[[], Extract], held: object, probability: Callable[[object, np.ndarray, np.ndarray, int], np.ndarray], held_out: Column, cut: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = make()
        for batch, texts in words.text_batches(batches):
            doc, index = extract(texts)
            p = probability(shared.value, doc, index, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def remainder(of: int) -> Column:
    """crc32 of the id's digits modulo ``of``."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)
