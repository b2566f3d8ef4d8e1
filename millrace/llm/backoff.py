"""Stupid-backoff language-model scores from n-gram tables of the whole corpus.

The relational plan is: explode each document's n-grams, count them in tables partitioned by hash, join the
counts back to the exploded n-grams, sum per document. To keep a row per n-gram out of the shuffle it runs on
sorted arrays: a block of documents lists its distinct n-gram hashes of each order once, in order, cut by
hash range into parts (``grams``); each part sums the counts of equal hashes over all blocks and sends them
back in the same order (``_count``); they meet the block's word sequence, taken from a second pass over the
texts (``sequences``), by place (``_score``). A frequent n-gram is one entry a block, so no part is hot, and nothing is
gathered on the driver but two sums. The count of parts follows the text's bytes, so a part's memory does not
grow; a block's entries spread over more parts as the corpus grows, in shorter rows, of which there are at most as
many as n-grams. The form departs from a plan with a row for each n-gram, whose two shuffles of some 150 bytes a
word do not fit the disk that is given; the counts and scores are the same.

A word scores log(c(w1 w2 w3) / c(w1 w2)) where the trigram occurs ``LEAST`` times or more in the corpus,
else log 0.4 + log(c(w2 w3) / c(w2)) where the bigram does, else 2 log 0.4 + log(c(w3) / N); the first
words of a document start at the order they have. Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.

Edge cases
* null, empty and white-space texts: 0 words, score 0, mean null.
* repeated rows are counted as often as they occur and get equal scores; long texts are scored whole, a
  block being at least one document; an empty table stays empty; other columns are ignored.
* n-grams are known by 64-bit hashes of their words' hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words
from millrace.session import cut

ORDER = 3
ALPHA = 0.4
LEAST = 2
BLOCK_BYTES = 16 << 20
PART_BYTES = 16 << 20  # of text for each part of the tables


def squeeze(a: np.ndarray) -> bytes:
    """An array of unsigned integers by byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), 1) if len(a) else b""


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _fields(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _split_fields(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


_ROW = "part int, block long, blob binary"
_NAMES = ["part", "block", "blob"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


def _in_blocks(docs: DataFrame, rows_of: Callable[[int, list[int | None], list[np.ndarray]], Iterator[tuple]]) -> DataFrame:
    """What ``rows_of`` makes of each block of documents: its number, and its documents' ids and word hashes.

    Blocks are cut from the partitions, so ``docs`` must give the same rows in the same partitions each time, as a
    table that is read does.
    """
    limit = BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, block = words.hash_memo(), TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        hashes: list[np.ndarray] = []
        held = 0
        for batch, texts in words.text_batches(batches, max_bytes=min(limit, 4 << 20)):
            ids += batch.column("doc_id").to_pylist()
            for t in texts:
                ws = words.split(t.lower())
                hashes.append(np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws)))
                held += len(t)
            if held >= limit:
                yield _batch(list(rows_of(block, ids, hashes)))
                ids, hashes, held, block = [], [], 0, block + 1
        if ids:
            yield _batch(list(rows_of(block, ids, hashes)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ROW)


def grams(docs: DataFrame, parts: int, order: int = ORDER) -> DataFrame:
    """Rows (part, block, blob): for k = 1 .. order the sorted distinct k-gram hashes of a hash range, and their counts in
    the block. A block has no row for a range without n-grams of it, so there are never more rows than n-grams."""

    def rows_of(block: int, ids: list[int | None], hashes: list[np.ndarray]) -> Iterator[tuple]:
        off, h = words.offsets(map(len, hashes)), np.concatenate(hashes)
        edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
        lists, counts, ends = [], [], []
        for k in range(1, order + 1):
            g = h.copy() if k == 1 else words.windows(h, off, k)[0]
            g.sort()
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
            counts.append(np.diff(first, append=len(g)))
            lists.append(g[first])
            ends.append(np.concatenate([[0], np.searchsorted(g[first], edges), [len(first)]]))
        for p in np.flatnonzero(sum(np.diff(e) for e in ends)).tolist():
            own = [(g[e[p] : e[p + 1]], n[e[p] : e[p + 1]]) for g, n, e in zip(lists, counts, ends, strict=True)]
            yield p, block, _fields(*(x for g, n in own for x in (squeeze(np.diff(g, prepend=np.uint64(0))), squeeze(n.astype(np.uint32)))))

    return _in_blocks(docs, rows_of)


def sequences(docs: DataFrame) -> DataFrame:
    """One row a block: its documents as ranks in its vocabulary, most frequent words first."""

    def rows_of(block: int, ids: list[int | None], hashes: list[np.ndarray]) -> Iterator[tuple]:
        off = words.offsets(map(len, hashes))
        _, place, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        known = np.array([x if x is not None else 0 for x in ids], np.int64)
        null = np.array([x is None for x in ids], np.uint8)
        # Places by falling frequency have mostly low bytes, which compress well.
        by_count = np.argsort(-n, kind="stable")
        rank = np.empty_like(by_count)
        rank[by_count] = np.arange(len(n))
        yield 0, block, _fields(squeeze(known), squeeze(null), squeeze(np.diff(off).astype(np.uint32)), squeeze(rank[place].astype(np.uint32)))

    return _in_blocks(docs, rows_of)


def _count(table: pa.Table) -> pa.Table:
    """One part of the tables: each block's entries with the counts of the whole corpus, as fields: the words and
    their counts in the block (they order its vocabulary), then the corpus's counts of each order."""
    fields = [_split_fields(x.as_py()) for x in table.column("blob")]
    out = [f[:2] for f in fields]
    for k in range(len(fields[0]) // 2):
        lists = [np.cumsum(unsqueeze(f[2 * k], np.uint64)) for f in fields]
        ends = words.offsets(map(len, lists))
        _, place = np.unique(np.concatenate(lists), return_inverse=True)
        counts = np.concatenate([unsqueeze(f[2 * k + 1], np.uint32) for f in fields])
        total = np.bincount(place, counts).astype(np.uint64)[place] if len(place) else place.astype(np.uint64)
        for j, own in enumerate(out):
            own.append(squeeze(total[ends[j] : ends[j + 1]]))
    return pa.Table.from_batches([_batch(list(zip(table.column("part").to_pylist(), table.column("block").to_pylist(), (_fields(*f) for f in out), strict=True)))])


_SCORED = "doc_id long, n_words long, n_seen long, n_unigram long, partial double"


def _score(table: pa.Table, blocks: pa.Table, order: int) -> pa.Table:
    """One block: the counts joined to its positions and summed per document, log N left out."""
    if len(blocks) != 1:
        raise ValueError("the documents came in other partitions when read again: write them as a table first")
    known, null, sizes, rank = _split_fields(blocks.column("blob")[0].as_py())
    off = words.offsets(unsqueeze(sizes, np.uint32))
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    by_part = np.argsort(table.column("part").to_numpy())
    parts = [_split_fields(table.column("blob")[int(i)].as_py()) for i in by_part]
    whole = lambda i, kind: np.concatenate([np.zeros(0, kind), *(unsqueeze(p[i], kind) for p in parts)])
    vocabulary = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(unsqueeze(p[0], np.uint64)) for p in parts)])
    n = whole(1, np.uint32).astype(np.int64)
    if int(n.sum()) != int(off[-1]):
        raise ValueError("the documents came in another order when read again: write them as a table first")
    place = np.argsort(-n, kind="stable")[unsqueeze(rank, np.uint32).astype(np.int64)]
    h = vocabulary[place]
    counts = [whole(2, np.uint64).astype(float)[place]]  # at a position: of the k-gram that ends there, 0 where there is none
    for k in range(2, order + 1):
        g, at, _ = words.windows(h, off, k)
        full = np.zeros(len(h))
        full[at + k - 1] = whole(k + 1, np.uint64).astype(float)[np.unique(g, return_inverse=True)[1]] if len(g) else 0
        counts.append(full)
    room = np.minimum(np.arange(len(h)) - off[doc] + 1, order)  # the order a position can have
    used = np.ones(len(h), np.int64)
    for k in range(2, order + 1):
        used[(room >= k) & (counts[k - 1] >= LEAST)] = k
    with np.errstate(divide="ignore"):
        value = (room - used) * math.log(ALPHA)
        for k in range(1, order + 1):
            here = np.flatnonzero(used == k)
            value[here] += np.log(counts[k - 1][here])
            if k > 1:
                value[here] -= np.log(counts[k - 2][here - 1])
    n = len(off) - 1
    seen, low = np.bincount(doc[used == order], minlength=n), np.bincount(doc[used == 1], minlength=n)
    ids = pa.array(unsqueeze(known, np.int64), mask=unsqueeze(null, np.uint8).astype(bool))
    columns = [ids, pa.array(np.diff(off)), pa.array(seen), pa.array(low), pa.array(np.bincount(doc, value, n).astype(float))]
    return pa.table(columns, names=[x.split()[0] for x in _SCORED.split(", ")])


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Per document: doc_id, n_words, n_seen (words scored at the highest order), score, mean_score.

    ``score`` is rounded to 3 digits and ``mean_score``, the score per word, to 6.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counted = grams(docs, max(1, -(-size // PART_BYTES)), order).groupBy("part").applyInArrow(_count, _ROW)
    scored = counted.groupBy("block").cogroup(sequences(docs).groupBy("block")).applyInArrow(lambda t, b: _score(t, b, order), _SCORED)
    rows = cut(scored)
    total = rows.agg(F.sum("n_words")).first()[0] or 0
    value = F.col("partial") - F.col("n_unigram") * F.lit(math.log(max(total, 1)))
    mean = F.when(F.col("n_words") > 0, F.round(value / F.col("n_words"), 6))
    return rows.select("doc_id", "n_words", "n_seen", F.round(value, 3).alias("score"), mean.alias("mean_score"))


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (
  SELECT doc_id, i, w, lag(w) OVER o AS w1, lag(w, 2) OVER o AS w2 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (
  SELECT *, count(*) OVER (PARTITION BY w) AS c1,
         CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY w1, w) END AS c2,
         CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY w2, w1, w) END AS c3, count(*) OVER () AS n FROM g),
h AS (SELECT *, lag(c1) OVER o AS p1, lag(c2) OVER o AS p2 FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (
  SELECT doc_id, c3 >= {LEAST} AS seen,
         CASE WHEN c3 >= {LEAST} THEN ln(c3) - ln(p2)
              WHEN c2 >= {LEAST} THEN (CASE WHEN i > 2 THEN 1 ELSE 0 END) * ln({ALPHA}) + ln(c2) - ln(p1)
              ELSE (least(i, 3) - 1) * ln({ALPHA}) + ln(c1) - ln(n) END AS v FROM h),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE seen) AS n_seen, sum(v) AS v FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_seen, 0) AS n_seen, round(coalesce(v, 0), 3) AS score, round(v / n_words, 6) AS mean_score
FROM d LEFT JOIN a USING (doc_id)
"""
