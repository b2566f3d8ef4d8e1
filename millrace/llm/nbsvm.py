"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios.

Indicators are hashed: words, word pairs, and n-grams (1 to 3) of word shapes, a shape being the run-length
form of a word's character classes and whether it repeats the word before. The model is fitted by dual
coordinate descent on a bounded sample of ``SAMPLE`` labelled documents outside the held-out fold, a fifth
of which only calibrates margins to probabilities. Scoring is one pass over whole texts.

Edge cases
* null and empty texts have no indicators and get the score of the intercept alone.
* no usable labels, or one class only: a constant score, the (smoothed) share of label 1.
* null labels, and ids whose labels disagree, are ignored; a null id is scored and never counts as held out.
* an id is learned from once for each of its texts, however often it repeats.
* repeated rows get equal scores, long texts are read whole; an empty table gives an empty table; labels, lang,
  source and doc_id are no inputs, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import features, words
from millrace.session import cut

SAMPLE = 5000
BITS = 18
CUT = 0.7
SMOOTH = 1.0
COST = 1.0
EPOCHS = 12
HELD_OUT = (4, 2)
_CLASSES = re.compile(rb"([A-Z])+|([a-z\x80-\xff])+|([0-9])+|(.)")


def shape(word: bytes) -> bytes:
    """Runs of capitals, other letters and digits as A, a and 9; marks as they are."""
    return _CLASSES.sub(lambda m: b"A" if m[1] else b"a" if m[2] else b"9" if m[3] else m[4] or b"", word)[:24]


def _hashes(word: bytes) -> tuple[int, int]:
    return features.word_hash(word.lower()), features.word_hash(shape(word))


def extractor() -> features.Extract:
    table = features.WordTable(_hashes, 2)

    def extract(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        split = [words.split(t) for t in texts]
        off = words.offsets(map(len, split))
        rows = table.look_up(split, int(off[-1]))
        doc = np.repeat(np.arange(len(texts)), np.diff(off))
        word, form = rows[:, 0], rows[:, 1]
        again = np.zeros(len(word), np.uint64)
        again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        form = words.mix(form + again)
        docs, found = [doc, doc], [features.fold(word, BITS, 0), features.fold(form, BITS, 1)]
        for k, source, family in ((2, word, 2), (2, form, 3), (3, form, 4)):
            hashed, at, _ = words.windows(source, off, k)
            docs.append(doc[at])
            found.append(features.fold(hashed, BITS, family))
        return features.once(np.concatenate(docs), np.concatenate(found), BITS)

    return extract


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def fit(rows: list[np.ndarray], y: np.ndarray, seed: int = 0) -> tuple[Model, np.ndarray]:
    """``rows``: indices of each document's indicators; ``y``: 0 or 1. Also gives the ratios' squares."""
    none = np.zeros(1 << BITS)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return Model(none, 0.0, 0.0, float(np.log(share / (1 - share)))), none
    order = np.random.default_rng(seed).permutation(len(rows))
    tune, learn = order[: len(order) // 5], order[len(order) // 5 :]
    if len(set(y[tune].tolist())) < 2 or len(set(y[learn].tolist())) < 2:
        tune = learn = order
    counts = [np.bincount(np.concatenate([rows[i] for i in learn if y[i] == c]), minlength=1 << BITS) + SMOOTH for c in (1, 0)]
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    # Each row is scaled to unit length, so that long and short texts weigh alike.
    scaled = [ratio[r] / max(np.sqrt((ratio[r] ** 2).sum()), 1e-9) for r in rows]
    w, b, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    sign = np.where(y == 1, 1.0, -1.0)
    rng = np.random.default_rng(seed + 1)
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            g = sign[i] * (w[rows[i]] @ scaled[i] + b) - 1
            new = min(max(alpha[i] - g / 2.0, 0.0), COST)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * scaled[i]
                b += step
                alpha[i] = new
    margin = np.array([w[rows[i]] @ scaled[i] + b for i in tune])
    slope, shift = _calibrate(margin, y[tune].astype(float))
    return Model(w * ratio, b, slope, shift), ratio**2


def _calibrate(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid, by Newton's method, with his smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([m, np.ones_like(m)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * (theta - [1, 0]))
        theta = theta - np.clip(step, -2, 2)
    return float(max(theta[0], 1e-3)), float(theta[1])


def probability(held: tuple[Model, np.ndarray], doc: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    model, squares = held
    total = np.bincount(doc, model.weights[index], n)
    length = np.sqrt(np.bincount(doc, squares[index], n))
    margin = total / np.maximum(length, 1e-9) + model.bias
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model, np.ndarray]:
    """The model and the squares of the ratios, from labelled rows outside the held-out fold."""
    of, out = HELD_OUT
    known = features.agreed(labels, "quality").where(features.remainder(of) != out)
    rows = features.sample(docs, cut(features.first_by_hash(known, sample)), extractor, sample)
    return fit([r[1] for r in rows], np.array([r[2] for r in rows], int))


def classify(docs: DataFrame, held: tuple[Model, np.ndarray]) -> DataFrame:
    of, out = HELD_OUT
    return features.score(docs, extractor, held, probability, features.remainder(of) == out, CUT)
