"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed indicators (words, their first 4 to 7 characters, so that inflected forms of one
stem meet, and whether two or three words of a document share a stem) is trained in numpy from confirmed toxic documents and unlabelled ones. The risk is
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)), with the logistic loss; where the
second term turns negative the step goes the other way, as in the published non-negative estimator. The
class prior is the share of toxic labels outside the held-out fold. The samples are bounded: ``POSITIVES``
and ``UNLABELLED``.

Edge cases
* null and empty texts have no indicators; they score by the intercept alone, near 0.
* no positive labels: every score is 0.
* null labels, and ids whose labels disagree, are ignored; a null id is scored and never counts as held out.
* an id is learned from once for each of its texts, however often it repeats.
* repeated rows get equal scores, long texts are read whole; an empty table gives an empty table; labels, lang,
  source and doc_id are no inputs, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import features, words
from millrace.session import cut

POSITIVES = 2500
UNLABELLED = 6000
BITS = 20
CUT = 0.5
EPOCHS = 150
RATE = 0.05
L2 = 1e-4
LEAST, Z = 3, 6.0  # positive documents, and standard errors above chance, that an indicator needs
HELD_OUT = (5, 0)
MARKS = b".,;:!?\"'()[]{}|*#$%&<>-_=+/\\~`^@"
STEMS = (4, 5, 6, 7)
OFTEN = (2, 3)  # distinct words of a stem in one document that are indicators of their own


def _hashes(word: bytes) -> tuple[int, ...]:
    """The bare word's hash, and its stems' or 0 where it is no longer than the stem."""
    plain = word.strip(MARKS).decode("utf-8", "replace").lower()
    return (features.word_hash(plain.encode()), *(features.word_hash(b"^" + plain[:k].encode()) if len(plain) > k else 0 for k in STEMS))


def extractor() -> features.Extract:
    table = features.WordTable(_hashes, 1 + len(STEMS))

    def extract(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        split = [words.split(t) for t in texts]
        off = words.offsets(map(len, split))
        place = table.find(split, int(off[-1])).astype(np.uint64)
        doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(off))
        doc, place = features.once(doc, place, 32)
        hashes = table.rows[place].ravel()
        live = hashes != 0
        key = np.repeat(doc, table.width)[live].astype(np.uint64) << np.uint64(BITS) | features.fold(hashes[live], BITS, 0)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(first, append=len(key))
        key = key[first]
        doc, index = key >> np.uint64(BITS), key & np.uint64((1 << BITS) - 1)
        found = [(doc, index)]
        for least in OFTEN:
            some = n >= least
            found.append((doc[some], features.fold(index[some], BITS, least)))
        return features.once(np.concatenate([d for d, _ in found]), np.concatenate([i for _, i in found]), BITS)

    return extract


def apart(rows: list[np.ndarray], hashes: int = 8, shared: int = 4) -> list[np.ndarray]:
    """The rows without those whose min-hashes mostly agree with an earlier row's: copies are no further evidence."""
    seen: dict[tuple[int, int], int] = {}
    out = []
    for i, r in enumerate(rows):
        if not len(r):
            continue
        least = [(j, int(words.mix(r.astype(np.uint64) + np.uint64((j + 1) << 40)).min())) for j in range(hashes)]
        alike = np.unique([seen[x] for x in least if x in seen], return_counts=True)[1]
        if alike.max(initial=0) < shared:
            out.append(r)
        for x in least:
            seen.setdefault(x, i)
    return out


def evidence(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Each indicator's scale: its log ratio of positive to unlabelled frequency, 0 unless that stands well above chance."""
    p, u = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for total, rows in ((p, positive), (u, unlabelled)):
        for r in rows:  # a row has each indicator once
            total[r] += 1
    expected = len(positive) * (u + 1) / (len(unlabelled) + 1)
    ratio = np.log((p + 0.5) / (len(positive) + 1)) - np.log((u + 0.5) / (len(unlabelled) + 1))
    return np.where((p >= LEAST) & ((p - expected) / np.sqrt(expected + 1) >= Z), np.maximum(ratio, 0), 0)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of the non-negative PU risk's minimiser, by Adam on the whole sample."""
    positive, unlabelled = apart(positive), apart(unlabelled)
    if not positive or not unlabelled:
        return np.zeros(1 << BITS, np.float32), -30.0
    rows, n = positive + unlabelled, len(positive)
    scale = evidence(positive, unlabelled)
    used = np.flatnonzero(scale)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    # Row by row, so that only indicators with some weight are ever side by side.
    live = [own[own >= 0] for own in (place[r] for r in rows)]
    doc, index = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in live]), np.concatenate(live)
    x = scale[used][index]
    w, b = np.zeros(len(used)), float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    is_p = np.arange(len(rows)) < n
    for step in range(1, EPOCHS + 1):
        z = np.bincount(doc, w[index] * x, len(rows)) + b
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = np.logaddexp(0, z)  # of calling a document clean
        rest = loss[~is_p].mean() - prior * loss[is_p].mean()
        # Derivatives by z of the clean-side risk, and of the toxic-side one.
        clean = np.where(is_p, -prior * q / n, q / (len(rows) - n))
        toxic = np.where(is_p, -prior * (1 - q) / n, 0.0)
        slope = toxic + clean if rest >= 0 else -clean
        gw, gb = np.bincount(index, slope[doc] * x, len(used)) + L2 * w, slope.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w = w - RATE * fix * m / (np.sqrt(v) + 1e-8)
        b = b - RATE * fix * mb / (np.sqrt(vb) + 1e-8)
    full = np.zeros(1 << BITS, np.float32)
    full[used] = w * scale[used]
    return full, float(b)


def probability(held: tuple[np.ndarray, float] | None, doc: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    if held is None:
        return np.zeros(n)
    weights, bias = held
    return 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights[index], n) + bias, -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    of, out = HELD_OUT
    known = cut(features.agreed(labels, "toxic").where(features.remainder(of) != out))
    prior = known.agg(F.avg("toxic")).first()[0]
    if not prior:
        return None
    positive = features.first_by_hash(known.where("toxic = 1"), POSITIVES).select("doc_id", F.lit(1).alias("kind"))
    open_ids = docs.where(F.col("doc_id").isNotNull() & (features.remainder(of) != out)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    unlabelled = features.first_by_hash(open_ids, UNLABELLED).withColumn("kind", F.lit(0))
    rows = features.sample(docs, cut(positive.unionByName(unlabelled)), extractor, POSITIVES + UNLABELLED)
    found = {k: [r[1] for r in rows if r[2] == k] for k in (1, 0)}
    return fit(found[1], found[0], float(prior)) if found[1] and found[0] else None


def classify(docs: DataFrame, held: tuple[np.ndarray, float] | None) -> DataFrame:
    of, out = HELD_OUT
    return features.score(docs, extractor, held, probability, features.remainder(of) == out, CUT)


def keep(docs: DataFrame, held: tuple[np.ndarray, float] | None) -> DataFrame:
    """The documents below the cut, with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = extractor()
        for batch, texts in words.text_batches(batches):
            p = probability(shared.value, *extract(texts), len(texts))
            yield batch.filter(pa.array(p < CUT))

    return docs.mapInArrow(passing, docs.schema)
