"""Words, word hashes and hashed windows of whole texts, vectorised over a batch of documents."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

from millrace.functions.wordhash import hashes, mix

__all__ = ["Memo", "groups", "hash_memo", "hashes", "mix", "offsets", "powers", "ranges", "release", "split", "step", "text_batches", "windows", "within"]

#: A window's hash is a sum of its words' 64-bit hashes times these odd factors, then mixed.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
MEMO = 1 << 18


class Memo(dict):
    """A bounded memo of a pure function of a word; it starts over when full."""

    def __init__(self, of, size: int = MEMO):
        super().__init__()
        self.of, self.size = of, size

    def __missing__(self, word):
        if len(self) >= self.size:
            self.clear()
        value = self[word] = self.of(word)
        return value


def split(data: bytes) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 data: what bytes.split() gives, as no other byte is white space."""
    return data.split()


def hash_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def step(i: int) -> np.uint64:
    """The i-th member of a family of seeds."""
    return np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def offsets(lengths: Iterable[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(lengths, np.int64))])


def within(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1, for all i in turn."""
    total = int(lengths.sum())
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(lengths) else np.zeros(0, np.int64)
    return first + np.arange(total)


def windows(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of k words inside each document, their first words' places, counts per document."""
    n = np.maximum(np.diff(off) - (k - 1), 0)
    at = within(off[:-1], n)
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        total += h[at + j] * _FACTORS[j % len(_FACTORS)] * np.uint64(2 * (j // len(_FACTORS)) + 1)
    return mix(total), at, n


#: A polynomial of bytes modulo 2 ** 64: its base, and what undoes it.
BASE = 0x9E3779B97F4A7C15
_BACK = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 19


def powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; up to a length, the longest array so far is kept."""
    if len(known.get(base, ())) >= n:
        return known[base][:n]
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    out = np.cumprod(out)
    if n <= 1 << 23:
        known[base] = out
    return out


def ranges(data: bytes | np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges start[i] .. end[i] - 1, which come in order and apart: equal ranges have equal ones."""
    raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    if len(raw) > 2 * BLOCK:  # block by block, in little memory; the ranges come in order
        edge = np.searchsorted(start, np.arange(0, len(raw) + BLOCK, BLOCK))
        parts = [(start[a:b], end[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True) if a < b]
        return np.concatenate([np.zeros(0, np.uint64), *(_ranges(raw[s[0] : e[-1]], s - s[0], e - s[0]) for s, e in parts)])
    return _ranges(raw, start, end)


def _ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw)))])
    return mix((total[end] - total[start]) * powers(_BACK, len(raw) + 1)[start])


def release() -> None:
    """Give memory that a task has freed back to the system, as workers go on to tasks of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def text_batches(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = 4 << 20):
    """Slices of the batches with at most ``max_bytes`` of text (or one row), and their texts' UTF-8 bytes."""
    for batch in batches:
        texts = batch.column(column)
        data = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        sizes = np.diff(np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]) if len(data) else np.zeros(0, np.int64)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start), [x or b"" for x in data.slice(start, i - start).to_pylist()]
                start, held = i, 0
            held += int(n)
        if start < len(data):
            yield batch.slice(start), [x or b"" for x in data.slice(start).to_pylist()]


def groups(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by ``keys``: tables of some groups each, and where each group starts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = np.any([np.diff(batch.column(k).to_numpy()) != 0 for k in keys], axis=0)
        same = held and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
        last = int(np.flatnonzero(edge)[-1]) + 1 if edge.any() else 0
        if last or held and not same:
            done = [*held, batch.slice(0, last)] if last else held
            yield _starts(pa.Table.from_batches(done), keys)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield _starts(pa.Table.from_batches(held), keys)


def _starts(table: pa.Table, keys: tuple[str, ...]) -> tuple[pa.Table, np.ndarray]:
    table = table.combine_chunks()
    edge = np.any([np.diff(table.column(k).to_numpy()) != 0 for k in keys], axis=0) if table.num_rows > 1 else np.zeros(0, bool)
    return table, np.concatenate([[0], np.flatnonzero(edge) + 1, [table.num_rows]])
