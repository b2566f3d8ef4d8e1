"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are trained here from ``labels.quality`` on a bounded sample of ``SAMPLE`` labelled documents,
chosen by a hash of the id, flattened into node arrays and broadcast (some kilobytes). Statistics are
computed in one pass over whole texts; nothing is shuffled but the sample.

Edge cases
* null or empty text: all statistics 0, ``base_failed`` (fewer than 10 words).
* no labels, or labels of one class only: the trees are constant and every document that passes the base
  rules gets that verdict; with no labels at all it is kept.
* labels of ids without a document, null labels and null ids are ignored, and so are ids whose labels disagree;
  an id is learned from once for each of its texts, however often it or its label repeats.
* repeated documents get equal rows, long texts are read whole; an empty table gives an empty table; other
  columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import trees, words
from millrace.llm.features import agreed, first_by_hash, sampled
from millrace.session import cut

SAMPLE = 6000
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\v\f\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the trees see, and whether the score may only fall (-1) as one rises.
FEATURES = {
    "n_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_lines": -1, "repeated": -1, "upper": 0, "digits": 0,
    "marks_per_word": -1, "distinct": 0, "same_as_last": -1, "words_per_line": 0, "stops_per_word": 0,
}
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def statistics(texts: list[bytes], memo: words.Memo) -> tuple[np.ndarray, np.ndarray]:
    """Per text the counts of BASE, and the row of FEATURES."""
    split = [words.split(t) for t in texts]
    off = words.offsets(map(len, split))
    h = np.fromiter((memo[w] for ws in split for w in ws), np.uint64, int(off[-1]))
    n = np.diff(off)
    doc = np.repeat(np.arange(len(texts)), n)

    key, at, per = words.windows(h, off, 5)
    tagged = words.mix(key + np.repeat(np.arange(len(texts)), per).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(tagged)
    sorted_keys = tagged[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    twice = np.zeros(len(tagged), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 6, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + 5, -1)
    covered = np.cumsum(edge)[: len(h)] > 0
    repeat_words = np.bincount(doc[covered], minlength=len(texts))

    last = np.zeros(len(h), bool)
    last[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    # Equal words of one document share a tag; the first of each tag counts.
    _, first = np.unique(h ^ words.mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
    distinct = np.bincount(doc[first], minlength=len(texts))

    counts = np.zeros((len(texts), len(BASE)), np.int64)
    rest = np.zeros((len(texts), 6))
    for i, t in enumerate(texts):
        lines = [line for line in t.split(b"\n") if line.strip(WHITE)]
        white = len(t) - len(t.translate(None, WHITE))
        counts[i] = (
            n[i],
            len(t.decode("utf-8", "replace")) - white,
            len(t) - len(t.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)),
            repeat_words[i],
        )
        rest[i] = (
            len(t) - len(t.translate(None, _UPPER)), len(t) - len(t.translate(None, _DIGITS)), t.count(b"!"),
            len(lines), t.count(b".") + t.count(b","), len(t),
        )
    nw, chars, lines = np.maximum(n, 1), np.maximum(counts[:, 1], 1), np.maximum(rest[:, 3], 1)
    features = np.stack(
        [
            n, chars / nw, counts[:, 2] / nw, counts[:, 3] / lines, repeat_words / nw, rest[:, 0] / chars, rest[:, 1] / chars,
            rest[:, 2] / nw, distinct / nw, np.bincount(doc[last], minlength=len(texts)) / nw, n / lines, rest[:, 4] / nw,
        ],
        1,
    )
    return counts, features.astype(float)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = words.hash_memo()
    for batch, texts in words.text_batches(batches):
        _, features = statistics(texts, memo)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * features.shape[1], pa.int32()), pa.array(features.ravel()))
        yield pa.RecordBatch.from_arrays([flat, batch.column("quality")], names=["features", "quality"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> trees.Forest | None:
    """Trees from a bounded sample of labelled documents; None if there are no labels."""
    chosen = cut(first_by_hash(agreed(labels, "quality"), sample))
    texts = sampled(docs, chosen, sample).select("doc_id", "text", F.col("quality").cast("double").alias("quality"))
    rows = texts.mapInArrow(_count, "features array<double>, quality double").toPandas()
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (*rows["features"].iloc[i], rows["quality"].iloc[i]))]
    if rows.empty:
        return None
    monotone = np.array(list(FEATURES.values()))
    return trees.fit(np.stack(rows["features"].to_list()), rows["quality"].to_numpy(float), monotone)


def judge(docs: DataFrame, forest: trees.Forest | None) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, ``kept`` and the trees' ``score``."""
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = words.hash_memo()
        for batch, texts in words.text_batches(batches):
            counts, features = statistics(texts, memo)
            p = held.value.probability(features) if held.value is not None else np.ones(len(texts))
            failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
            columns = [batch.column("doc_id"), *(pa.array(counts[:, j]) for j in range(len(BASE)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(~failed & (p >= 0.5)), pa.array(p)], names=["doc_id", *BASE, "base_failed", "kept", "score"])
        memo.clear()
        words.release()

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, schema)


def keep(docs: DataFrame, forest: trees.Forest | None) -> DataFrame:
    """The documents that pass, with all their columns, in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = words.hash_memo()
        for batch, texts in words.text_batches(batches):
            counts, features = statistics(texts, memo)
            p = held.value.probability(features) if held.value is not None else np.ones(len(texts))
            failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
            yield batch.filter(pa.array(~failed & (p >= 0.5)))
        memo.clear()
        words.release()

    return docs.mapInArrow(passing, docs.schema)
