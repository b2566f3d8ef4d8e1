"""Hashes of all words of a batch of texts at once, in numpy: no step a word in Python."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: The polynomial's base, odd and so invertible modulo 2 ** 64.
_FACTOR = 0xD6E8FEB86659FD93
_INVERSE = pow(_FACTOR, -1, 1 << 64)
SEGMENT = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_FACTOR)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_FACTOR)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; the longest array so far is kept."""
    if len(known.get(base, ())) < n:
        all_ = np.full(n, base, np.uint64)
        all_[0] = 1
        known[base] = np.cumprod(all_)
    return known[base][:n]


def located(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of bytes other than white space: its hash, its start and its end.

    A word's hash is the polynomial of its bytes, mixed; one running sum over all bytes gives it for every word.
    """
    raw = np.frombuffer(data + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(WHITE[raw], prepend=True))  # where words start and end, by turns
    start, end = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_FACTOR, len(raw)))])
    return mix((total[end] - total[start]) * _powers(_INVERSE, len(raw))[start]), start, end


def _segments(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end between words; a word longer than a part stays whole."""
    at = 0
    while at < len(text):
        end = at + SEGMENT
        if end < len(text):
            white = np.flatnonzero(WHITE[np.frombuffer(text, np.uint8, SEGMENT, at)])
            found = None if len(white) else re.compile(rb"[ \t-\r]").search(text, end)
            end = at + int(white[-1]) + 1 if len(white) else found.end() if found else len(text)
        yield text[at:end]
        at = end


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in turn, and where each text's words start (one place more than texts).

    Texts are hashed together up to ``SEGMENT`` bytes, and longer ones in parts, so the arrays of a byte's width stay small.
    """
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    found, counts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + SEGMENT, side="right")))
        if ends[at] - before > SEGMENT:
            parts = [located(x)[0] for x in _segments(texts[at])]
            found += parts
            counts.append(np.array([sum(len(h) for h in parts)], np.int64))
            at += 1
            continue
        h, start, _ = located(b" ".join(texts[at:stop]))
        found.append(h)
        counts.append(np.diff(np.searchsorted(start, np.concatenate([[0], ends[at:stop] - before]))))
        at = stop
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
