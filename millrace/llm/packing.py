"""Lexical retrieval packing into sequences of at most 2048 tokens.

1. One pass over whole texts counts, over all documents, how many hold each word, in a table of ``BUCKETS``
   counters by hash (its size does not grow; where words outnumber it, rare ones look alike and frequent ones stay
   apart), and the count and mean length of documents. The table is broadcast.
2. A corpus-wide inverted index finds each document's best neighbour, wherever that lies, by BM25 over all words
   that the two share. The index lies in blocks of about ``BLOCK`` texts, each of which meets each, and of every
   meeting a text keeps its best neighbour: the search is exact, and its time grows with the square of the texts.
   Words that are frequent in both blocks go through matrix products, which bound the scores of two texts in each number,
   the others through posting lists; pairs whose bound reaches the best score are then worked out. Copies of
   a text are one entry, and have each other. Callers for whom that is too dear can limit the search: to the ``terms``
   rarest words of a document, in lists of about ``most`` documents (a word of more is salted, and a document meets a
   share of those that hold it). Tests measure the recall of that.
3. Documents that are each other's best neighbours, in chains, form groups, and groups are dealt to the tasks
   whole (those above ``GROUP`` documents in parts, copies of one text row by row where they alone are more), so documents that belong together arrive next to each
   other.
4. Each task encodes them and streams them into index shards of about ``SHARD_TOKENS`` tokens. Full windows of a
   long document are sequences of their own; documents of which something remains go into the shard's BM25 inverted
   index over all their words, weighted by the corpus's counts. The longest unused remainder seeds a window,
   the index ranks the unused documents by BM25 with the seed as query, and the window greedily takes those that fit,
   best first; what is still free is filled with the first tokens of the best one left, whose rest stays in the
   index. What does not fill a window moves on to the task's next shard; at the end of the task it is cut into
   sequences whose lengths are powers of two. So no sequence needs padding, and memory is bounded by a shard and
   the longest document.

Ids are those of the tokenizers library; they are computed with tiktoken from the same vocabulary and
pattern, which tests hold against the library: without the pattern's look-ahead where a text has no two white
spaces in a row, as it then decides nothing. Texts with a long run of white space, on which tiktoken's pattern
engine gives up, go to the library itself.

Edge cases
* null and empty texts: the closing id alone; texts without words have no neighbours.
* very long texts are cut into windows; every id lies in exactly one piece.
* repeated rows are packed once each, next to each other as far as ``GROUP`` allows, and are searched once; ties in a ranking go to the earlier document.
* an empty table gives an empty table; other columns are ignored, whatever their names; a null doc_id is
  carried through.
* a lost task packs the same documents into the same sequences again; sequence ids are made of the
  partition and a count, so they depend on the count of shuffle partitions, but never collide.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import minhash, words
from millrace.llm.bpe import byte_alphabet
from millrace.session import cut

WINDOW = 2048
CLOSING = 1
SHARD_TOKENS = 1 << 19
BUCKETS = 1 << 24
TERMS, LIST = 16, 32
BLOCK, POSTINGS = 8192, 1 << 22  # texts, and about the most words of them, in a block of the exact search
DENSE = 1 / 512  # the share of a block's pairs of texts from which a word goes through the matrix product
STEP = 1 << 17  # scores that are worked out at once
FREQUENT = 256  # words of a block that tell its groups
PRODUCT = 1 << 20  # numbers, of two scores each, of one matrix product
GROUP = 4096
SEEN = 1 << 18  # texts that a task remembers
SMALL = 1 << 20  # (document, group) rows that may be broadcast: 16 MB
K1, B = 1.2, 0.75
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: The pattern of the vocabulary's pre-tokenizer: a fixed value of the file format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The alternative that only decides about white space before white space.
AHEAD = r"\s+(?!\S)|"
_TWO_SPACES = re.compile(r"\s\s")
LONG_SPACE = 10_000  # characters
_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")


@functools.lru_cache(maxsize=2)
def encodings(source: str) -> tuple:
    """Two tiktoken encodings with the vocabulary of a tokenizers JSON file of byte-level BPE: the whole pattern, and without ``AHEAD``."""
    import tiktoken

    spec = json.loads(source)
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tuple(tiktoken.Encoding("byte-level", pat_str=p, mergeable_ranks=ranks, special_tokens=special) for p in (PATTERN, PATTERN.replace(AHEAD, "")))


@functools.lru_cache(maxsize=2)
def _library(source: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(source)
    tok.no_truncation()
    tok.no_padding()
    return tok


def tokenize(texts: list[bytes], source: str, closing: int = CLOSING) -> list[np.ndarray]:
    (whole, quick), end = encodings(source), np.array([closing], np.uint32)

    def ids(text: str) -> np.ndarray:
        if not _TWO_SPACES.search(text):
            return quick.encode_to_numpy(text, allowed_special="all")
        if len(text) >= LONG_SPACE and _LONG_SPACE.search(text):
            return np.array(_library(source).encode(text, add_special_tokens=False).ids, np.uint32)
        return whole.encode_to_numpy(text, allowed_special="all")

    return [np.concatenate([ids(t.decode("utf-8", "replace")), end]) for t in texts]


HASH_BITS = 48


@dataclass
class Terms:
    """The distinct words of a batch of texts, text by text: the text's place, the word's hash, how often; and where each text starts."""

    doc: np.ndarray
    word: np.ndarray
    tf: np.ndarray
    first: np.ndarray

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.first[i], self.first[i + 1])
        return self.word[own], self.tf[own]


def terms_of(texts: list[bytes]) -> Terms:
    """Words in lower case, as hashes of ``HASH_BITS`` bits; one sort serves all texts, of which there are fewer than 2 ** 16."""
    h, off = words.hashes([t.lower() for t in texts])
    key = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(off)) << np.uint64(HASH_BITS) | h >> np.uint64(64 - HASH_BITS)
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    tf, key = np.diff(at, append=len(key)), key[at]
    doc = (key >> np.uint64(HASH_BITS)).astype(np.int64)
    return Terms(doc, key & np.uint64((1 << HASH_BITS) - 1), tf, np.searchsorted(doc, np.arange(len(texts) + 1)))


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(HASH_BITS - (BUCKETS.bit_length() - 1))).astype(np.int64)


@dataclass
class Corpus:
    """Documents, their mean length in words, and for each bucket of words the count of documents as a level, 8 to a doubling."""

    n_docs: int
    mean: float
    levels: np.ndarray

    @functools.cached_property
    def _df(self) -> np.ndarray:
        return np.rint(2 ** (np.arange(256) / 8) - 1)

    def df(self, h: np.ndarray) -> np.ndarray:
        """How many documents hold each word, to within a twentieth; exact up to 8 but for words that share a bucket."""
        return self._df[self.levels[bucket(h)]]

    def impact(self, df: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What a word adds to the BM25 score of a document of ``size`` words that holds it ``tf`` times."""
        idf = np.log1p((np.maximum(self.n_docs - df, 0) + 0.5) / (df + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))


def _level(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(8 * np.log2(n + 1.0)), 255).astype(np.uint8)


def corpus(docs: DataFrame) -> Corpus:
    """Counts over all documents. Tasks send their counters that are not 0; the driver gets one byte for each bucket."""
    part = min(BUCKETS, 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, total = np.zeros(BUCKETS, np.uint32), 0, 0
        for _, texts in words.text_batches(batches):
            own = terms_of(texts)
            np.add.at(held, bucket(own.word), np.uint32(1))
            n += len(texts)
            total += int(own.tf.sum())
        some = np.flatnonzero(held)
        for at in range(0, len(some), 1 << 16):
            own = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(held[own].astype(np.int64))], names=["bucket", "n"])
        del held
        words.release()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, -2], pa.int32()), pa.array([n, total], pa.int64())], names=["bucket", "n"])

    def pack(t: pa.Table) -> pa.Table:
        bucket, n = t.column("bucket").to_numpy(), t.column("n").to_numpy()
        if bucket[0] < 0:
            data = n[np.argsort(-bucket)].astype("<i8").tobytes()
        else:
            own = np.zeros(part, np.uint8)
            own[bucket % part] = _level(n)
            data = own.tobytes()
        return pa.table({"slice": pa.array([int(bucket[0]) // part], pa.int32()), "data": pa.array([data], pa.binary())})

    counts = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    packed = counts.groupBy(F.floor(F.col("bucket") / part)).applyInArrow(pack, "slice int, data binary").collect()
    levels, n, total = np.zeros(BUCKETS, np.uint8), 0, 0
    for row in packed:
        if row.slice < 0:
            n, total = np.frombuffer(row.data, "<i8").tolist()
        else:
            levels[row.slice * part : (row.slice + 1) * part] = np.frombuffer(row.data, np.uint8)
    return Corpus(n, max(total / max(n, 1), 1.0), levels)


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, row, doc_id, text); the key is a hash of the text, so copies share it, and it does not depend on partitions."""
    return docs.select(F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def _postings(docs: DataFrame, held, terms: int | None) -> DataFrame:
    """(word, df, key, impact): the ``terms`` rarest words of each document that another document holds too (all, if None).
    A task posts copies of a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, texts in words.text_batches(batches):
            new = []
            for i, key in enumerate(batch.column("key").to_pylist()):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            if len(seen) > SEEN:
                seen.clear()
            if len(new) < len(texts):
                batch, texts = batch.take(pa.array(new, pa.int64())), [texts[i] for i in new]
            own = terms_of(texts)
            doc, h, size = own.doc, own.word, np.bincount(own.doc, own.tf, len(texts))
            df = held.value.df(h)
            live = np.flatnonzero(df > 1)
            live = live[np.lexsort((words.mix(h[live]), df[live], doc[live]))]
            if terms is not None:
                live = live[np.arange(len(live)) - np.searchsorted(doc[live], doc[live]) < terms]
            impact = np.rint(held.value.impact(df[live], own.tf[live], size[doc[live]]) * 1024)
            key = batch.column("key").to_numpy()[doc[live]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h[live].view(np.int64), df[live].astype(np.int64), key, impact.astype(np.int64))], names=["word", "df", "key", "impact"])

    return docs.select("key", "text").mapInArrow(run, "word long, df long, key long, impact long")


def _pairs(lists: DataFrame) -> DataFrame:
    """(a, b, of_a, of_b): documents of one list, and what its word adds to either's score for the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in words.groups(batches, ("word", "salt")):
            key, impact = t.column("key").to_numpy(), t.column("impact").to_numpy()
            group = np.repeat(np.arange(len(start) - 1), np.diff(start))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])  # copies that several tasks have posted
            key, impact, group = key[new], impact[new], group[new]
            for gap in range(1, int(np.bincount(group).max())):
                x = np.flatnonzero(group[gap:] == group[:-gap])
                low = key[x] < key[x + gap]
                a, b = np.where(low, x, x + gap), np.where(low, x + gap, x)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[a], key[b], impact[a], impact[b])], names=["a", "b", "of_a", "of_b"])

    return lists.mapInArrow(run, "a long, b long, of_a long, of_b long")


def _vectors(docs: DataFrame, held) -> DataFrame:
    """(key, tie, words, impacts): each text's words that another document holds too, as packed numbers of 6 and 2 bytes.
    A task gives copies of a text once; ``tie`` decides between neighbours of one score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, texts in words.text_batches(batches):
            key, new = batch.column("key").to_numpy(), []
            for i, k in enumerate(key.tolist()):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            if len(seen) > SEEN:
                seen.clear()
            own = terms_of([texts[i] for i in new])
            df, size = held.value.df(own.word), np.bincount(own.doc, own.tf, len(new))
            live = df > 1
            impact = np.rint(held.value.impact(df[live], own.tf[live], size[own.doc[live]]) * 1024).astype("<u2")
            word = np.ascontiguousarray(own.word[live].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            off = words.offsets(np.bincount(own.doc[live], minlength=len(new)))
            binary = lambda data, wide: pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer((off * wide).astype(np.int32)), pa.py_buffer(data)])  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(key[new]), batch.column("tie").take(pa.array(new, pa.int64())), binary(word, 6), binary(impact, 2)], names=["key", "tie", "words", "impacts"])

    tie = F.pmod(F.xxhash64("key"), F.lit(4096)).alias("tie")
    return docs.select("key", tie, "text").mapInArrow(run, "key long, tie long, words binary, impacts binary")


@dataclass
class Block:
    """Texts by key and tie, those that ties prefer first, and their words in order: how many texts hold each, which, and its
    impact there. Texts of one ``group`` share frequent words, as those of one language do."""

    key: np.ndarray
    tie: np.ndarray
    word: np.ndarray
    held: np.ndarray
    doc: np.ndarray
    impact: np.ndarray
    group: np.ndarray

    KINDS: ClassVar = {"key": "<i8", "tie": "<i8", "word": "<u8", "held": "<i4", "doc": "<u2", "impact": "<u2", "group": "u1"}

    @classmethod
    def of(cls, rows: list[tuple[int, int, bytes, bytes]]) -> Block:
        """Of distinct rows as ``_vectors`` gives them."""
        rows = sorted(rows, key=lambda r: (-r[1], -r[0]))
        word = np.zeros((sum(len(r[3]) for r in rows) // 2, 8), np.uint8)
        word[:, :6] = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, 6)
        doc = np.repeat(np.arange(len(rows)), [len(r[3]) // 2 for r in rows])
        word = word.view("<u8").ravel()
        order = np.argsort(word, kind="stable")
        distinct, count = np.unique(word[order], return_counts=True)
        impact, doc = np.frombuffer(b"".join(r[3] for r in rows), "<u2"), doc[order]
        return cls(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), distinct, count, doc, impact[order], _groups(count, doc, len(rows)))

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([getattr(self, c).astype(kind).tobytes()], pa.binary()) for c, kind in self.KINDS.items()], names=list(self.KINDS))

    @classmethod
    def read(cls, batch: pa.RecordBatch, side: str, row: int) -> Block:
        return cls(*(np.frombuffer(batch.column(f"{side}_{c}")[row].as_buffer(), kind) for c, kind in cls.KINDS.items()))


    def of_group(self, rows: np.ndarray) -> Block:
        """The texts at these places, which come in order."""
        if len(rows) == len(self.key):
            return self
        place = np.full(len(self.key), -1, np.int32)
        place[rows] = np.arange(len(rows))
        doc = place[self.doc]
        live = doc >= 0
        held = np.diff(_starts(live)[_starts(self.held)])
        some = held > 0
        return Block(self.key[rows], self.tie[rows], self.word[some], held[some], doc[live], self.impact[live], self.group[rows])


def _groups(held: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """A group for each of ``n`` texts: of the block's ``FREQUENT`` words the most frequent one of a text names its kind, and
    texts go to the frequent kind that they are most like. Neighbours are the same with any groups."""
    if not len(held):
        return np.zeros(n, np.uint8)
    top = np.argsort(-held, kind="stable")[:FREQUENT]
    has = np.zeros((n, len(top)), np.float32)
    has[doc[words.within(_starts(held)[top], held[top])], np.repeat(np.arange(len(top)), held[top])] = 1
    lead = has.argmax(1)
    kinds = np.flatnonzero(np.bincount(lead) >= max(n / 32, 1))[:32]
    centre = np.stack([has[lead == x].mean(0) for x in kinds]) if len(kinds) else has[:1]
    return (has @ (centre / np.maximum(np.linalg.norm(centre, axis=1), 1e-9)[:, None]).T).argmax(1).astype(np.uint8)


def _starts(held: np.ndarray) -> np.ndarray:
    """Where lists of these lengths start, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(held, dtype=np.int64)])


def _blocks(docs: DataFrame, held) -> DataFrame:
    """One row a block, with the columns of ``Block``. Partitions hold about one each."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-held.value.n_docs // BLOCK), min(int((2 * cores) ** 0.5) + 1, -(-held.value.n_docs // 512)), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, tuple] = {}  # by key, as several tasks can have given a text
        n = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "tie", "words", "impacts")), strict=True):
                rows[row[0]] = row
                n += len(row[3]) // 2
                if n >= POSTINGS or len(rows) >= 2 * BLOCK:
                    yield Block.of(list(rows.values())).batch()
                    rows, n = {}, 0
        if rows:
            yield Block.of(list(rows.values())).batch()
        del rows
        words.release()

    dealt = _vectors(docs, held).repartition(parts, "key").coalesce(parts)
    return cut(dealt.mapInArrow(run, ", ".join(f"{c} binary" for c in Block.KINDS)))


def _postings_of(a: Block, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and word, as its place in ``which``, of all postings of these words of ``a``, text by text."""
    held = a.held[which].astype(np.int64)
    doc, term = a.doc[words.within(_starts(a.held)[which], held)].astype(np.uint16), np.repeat(np.arange(len(which), dtype=np.int32), held)
    order = np.argsort(doc, kind="stable")
    return doc[order], term[order]


def _levels(row: np.ndarray, column: np.ndarray, impact: np.ndarray, half: int, n: int) -> tuple[np.ndarray | None, np.ndarray | None]:
    """The impacts of ``n`` words in 2 * ``half`` texts as multiples of a step of each text's own, rounded up, and the steps. Text i shares its
    numbers with text ``half`` + i, whose multiples come times 4096: all of a text's add up to less, so 32 bits, of which 24 are exact,
    hold any sums of both. None where a text holds too many words for that."""
    count = np.bincount(row, minlength=2 * half)
    if count.max(initial=0) >= 2048:
        return None, None
    step = np.maximum(np.ceil(np.bincount(row, impact, 2 * half) / (4095 - count)), 1)
    level, low, levels = np.ceil(impact / step[row]).astype(np.float32), row < half, np.zeros((half, n), np.float32)
    levels[row[low], column[low]] = level[low]
    levels[row[~low] - half, column[~low]] += 4096 * level[~low]
    return levels, step


class _Lists:
    """The posting lists of words that go one by one, padded to ``WIDTHS``, so that lists of one width are rows of one table.
    The tables keep the blocks' 2 bytes a number, as each of the texts that are asked for together reads other rows."""

    WIDTHS = np.unique([1, *(2**k for k in range(1, 17)), *(3 * 2**k for k in range(16))])

    def __init__(self, b: Block, first: np.ndarray, held: np.ndarray):
        self.kind = np.searchsorted(self.WIDTHS, held).astype(np.uint8)
        self.row, self.doc, self.impact = np.zeros(len(held), np.int64), {}, {}
        self.cells, self.weights = np.zeros(0, np.int64), np.zeros(0)
        for k in np.unique(self.kind).tolist():
            own = np.flatnonzero(self.kind == k)
            self.row[own] = np.arange(len(own))
            place = np.arange(self.WIDTHS[k])
            at = np.minimum(first[own][:, None] + place, max(len(b.doc) - 1, 0))
            self.doc[k] = b.doc[at].astype(np.uint16)
            self.impact[k] = np.where(place < held[own][:, None], b.impact[at], 0).astype(np.uint16)

    def add(self, doc: np.ndarray, term: np.ndarray, n: int, wide: int) -> np.ndarray:
        """The sums of the impacts for ``n`` texts, which hold the terms, in all texts."""
        kind = self.kind[term]
        order = np.argsort(kind, kind="stable")
        row, base, many = self.row[term[order]], doc[order] * wide, np.bincount(kind, minlength=len(self.WIDTHS))
        end = int((many * self.WIDTHS).sum())
        if end > len(self.cells):
            self.cells, self.weights = np.empty(2 * end, np.int64), np.empty(2 * end)
        at = first = 0
        for k in np.flatnonzero(many).tolist():
            m, w = int(many[k]), int(self.WIDTHS[k])
            cells, weights = (x[at : at + m * w].reshape(m, w) for x in (self.cells, self.weights))
            np.add(self.doc[k].take(row[first : first + m], 0), base[first : first + m, None], out=cells)
            weights[:] = self.impact[k].take(row[first : first + m], 0)
            at, first = at + m * w, first + m
        return np.bincount(self.cells[:at], self.weights[:at], n * wide).reshape(n, wide)


def best(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each text of ``a`` the place of its best neighbour in ``b``, and the score: the sum of the impacts there of all words that both hold."""
    found, score = np.zeros(len(a.key), np.int64), np.zeros(len(a.key), np.int64)
    for g in np.unique(a.group):
        rows = np.flatnonzero(a.group == g)
        found[rows], score[rows] = _meet(a.of_group(rows), b)
    return found, score


def _meet(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """``best`` for texts that share frequent words.

    Frequent words go through a matrix product whose numbers hold two texts of ``b`` each, by impacts rounded up to steps of
    the text's own. With the other words, which are summed up from lists, that bounds the score of each pair; pairs whose
    bound reaches the score of the text with the highest one are worked out in whole numbers.
    """
    wide, half = len(b.key), -(-len(b.key) // 2)
    at = np.minimum(np.searchsorted(b.word, a.word), max(len(b.word) - 1, 0))
    x = np.flatnonzero(b.word[at] == a.word) if len(b.word) else np.zeros(0, np.int64)
    y = at[x]
    of_a, of_b, from_b = a.held[x].astype(np.int64), b.held[y].astype(np.int64), _starts(b.held)[y]
    dense = of_a * of_b >= max(len(a.key) * wide * DENSE, 1)
    n_dense = int(dense.sum())
    d_doc, d_term = _postings_of(a, x[dense])
    d_first = _starts(np.bincount(d_doc, minlength=len(a.key)))
    own, column = words.within(from_b[dense], of_b[dense]), np.repeat(np.arange(n_dense), of_b[dense])
    row, impact = b.doc[own].astype(np.int64), b.impact[own]
    answer = np.zeros((wide, n_dense), np.uint16)
    answer[row, column] = impact
    levels, step = _levels(row, column, impact, half, n_dense)
    del own, row, column, impact
    packed = step is not None
    if not packed:
        levels = answer.astype(np.float64)
    doc, term = _postings_of(a, x[~dense])
    first = _starts(np.bincount(doc, minlength=len(a.key)))
    lists = _Lists(b, from_b[~dense], of_b[~dense])
    _, same_a, same_b = np.intersect1d(a.key, b.key, return_indices=True)
    itself = np.full(len(a.key), -1)
    itself[same_a] = same_b

    def exactly(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = d_first[i + 1] - d_first[i]
        got = answer[np.repeat(j, n), d_term[words.within(d_first[i], n)]]
        return np.diff(_starts(got)[_starts(n)])

    found, score = np.zeros(len(a.key), np.int64), np.zeros(len(a.key), np.int64)
    some = max(STEP // max(wide, 1), 1)
    rows = some * max(PRODUCT // (some * max(len(levels), 1)), 1)
    for s in range(0, len(a.key), rows):
        own = slice(d_first[s], d_first[min(s + rows, len(a.key))])
        asked = np.zeros((min(rows, len(a.key) - s), n_dense), levels.dtype)
        asked[d_doc[own].astype(np.int64) - s, d_term[own]] = 1
        whole = asked @ levels.T
        for i in range(0, len(whole), some):
            n = min(some, len(whole) - i)
            own = slice(first[s + i], first[s + i + n])
            rare = lists.add(doc[own].astype(np.int64) - (s + i), term[own], n, wide)
            if packed:
                upper = np.floor(whole[i : i + n] * np.float32(1 / 4096))
                total = np.empty((n, wide))
                np.multiply(whole[i : i + n] - upper * np.float32(4096), step[:half], out=total[:, :half])
                np.multiply(upper[:, : wide - half], step[half:wide], out=total[:, half:])
                total += rare
            else:
                total = whole[i : i + n] + rare
            met = np.flatnonzero(itself[s + i : s + i + n] >= 0)
            total[met, itself[s + i : s + i + n][met]] = -1
            own, at = np.arange(n), total.argmax(1)
            most = total[own, at]
            if packed:
                reach = np.minimum(exactly(s + i + own, at) + rare[own, at], most)
                row, column = np.divmod(np.flatnonzero(total >= reach[:, None]), wide)
                exact = np.minimum(exactly(s + i + row, column) + rare[row, column], total[row, column])  # -1 for the text itself
                order = np.lexsort((column, -exact, row))
                top = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
                at, most = column[top], exact[top]
            found[s + i : s + i + n], score[s + i : s + i + n] = at, most
    return found, score


def _exact(docs: DataFrame, held) -> DataFrame:
    """(key, neighbour, score) by all words that two texts share: each block meets each, itself included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = Block.read(batch, "a", row), Block.read(batch, "b", row)
                found, score = best(a, b)
                hit = score > 0
                found = found[hit]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a.key[hit], score[hit], b.tie[found], b.key[found])], names=["key", "s", "tie", "other"])
            words.release()

    blocks = _blocks(docs, held)
    a, b = (blocks.select(*(F.col(c).alias(f"{side}_{c}") for c in Block.KINDS)) for side in "ab")
    # Pairs of partitions, read from the checkpoint: neither side is shuffled or sent whole.
    met = a.crossJoin(b.hint("shuffle_replicate_nl")).mapInArrow(run, "key long, s long, tie long, other long")
    return met.groupBy("key").agg(F.max(F.struct("s", "tie", "other")).alias("m")).select("key", F.col("m.other").alias("neighbour"), F.col("m.s").alias("score"))


def neighbours(docs: DataFrame, held, terms: int | None = TERMS, most: int | None = LIST) -> DataFrame:
    """(key, neighbour, score): the best-ranked other text of each one that has any, from rows (key, text); scores in 1024ths.

    With ``terms`` and ``most`` None all shared words and all texts count: an exact search, whose time grows with
    the square of the texts.
    """
    if terms is None and most is None:
        return _exact(docs, held)
    salt = F.lit(0).cast("long") if most is None else F.pmod(F.xxhash64("key"), F.ceil(F.col("df") / most))
    lists = _postings(docs, held, terms).select("word", salt.alias("salt"), "key", "impact").repartition("word", "salt").sortWithinPartitions("word", "salt", "key")
    pairs = _pairs(lists).groupBy("a", "b").agg(F.sum("of_a").alias("of_a"), F.sum("of_b").alias("of_b"))
    side = lambda key, other, s: F.struct(F.col(key).alias("key"), F.col(other).alias("other"), F.col(s).alias("s"))
    both = pairs.select(F.explode(F.array(side("a", "b", "of_b"), side("b", "a", "of_a"))).alias("x")).select("x.*")
    rank = F.col("s") * 4096 + F.pmod(F.xxhash64("other"), F.lit(4096))  # ties go by a hash
    return both.groupBy("key").agg(F.max_by("other", rank).alias("neighbour"), F.max("s").alias("score"))


def grouped(links: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, route, parts, apart): the group of each linked text, and into how many parts its rows are dealt, as a group above
    ``GROUP`` documents is; ``apart``: the text alone has so many copies that they are dealt row by row."""
    of = minhash.contract(links.select(F.col("key").alias("ca"), F.col("neighbour").alias("cb")))
    if of is None:
        of = links.select("key", F.col("key").alias("route")).where("false")
    else:
        of = of.select(F.col("comp").alias("key"), F.col("into").alias("route"))
    copies = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    sized = cut(of.join(copies, "key", "full").select("key", F.coalesce("route", "key").alias("route"), F.coalesce("n", F.lit(1)).alias("n")))
    parts = cut(sized.groupBy("route").agg(F.ceil(F.sum("n") / GROUP).alias("parts")).where("parts > 1"))
    if parts.isEmpty():
        return sized.select("key", "route", F.lit(1).cast("long").alias("parts"), F.lit(False).alias("apart"))
    few = F.broadcast(parts) if parts.count() <= SMALL else parts
    return sized.join(few, "route", "left").select("key", "route", F.coalesce("parts", F.lit(1)).alias("parts"), (F.col("n") > GROUP).alias("apart"))


class Index:
    """BM25 over the words of one shard's documents, with the corpus's counts; words of one document alone are left out."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], known: Corpus):
        doc = np.repeat(np.arange(len(docs)), [len(h) for h, _ in docs])
        h, tf = np.concatenate([h for h, _ in docs]), np.concatenate([n for _, n in docs])
        size = np.array([n.sum() for _, n in docs])
        word, term, df = np.unique(h, return_inverse=True, return_counts=True)
        live = df[term] > 1
        doc, tf = doc[live], tf[live]
        self.term = (np.cumsum(df > 1) - 1)[term[live]]
        word, df = word[df > 1], df[df > 1]
        self.n, self.first = len(docs), np.searchsorted(doc, np.arange(len(docs) + 1))
        impact = known.impact(known.df(word)[self.term], tf, size[doc])
        order = np.argsort(self.term, kind="stable")
        self.posted, self.impact = doc[order], impact[order]
        self.start, self.df = words.offsets(df)[:-1], df

    def scores(self, query: int) -> np.ndarray:
        """BM25 of all documents for the distinct terms of one."""
        terms = self.term[self.first[query] : self.first[query + 1]]
        at = words.within(self.start[terms], self.df[terms])
        return np.bincount(self.posted[at], self.impact[at], self.n)


class Packer:
    """Packs a stream of (doc_id, ids); ``rows`` holds finished pieces."""

    def __init__(self, first_sequence: int, known: Corpus):
        self.next, self.rows, self.known = first_sequence, [], known
        self.pool: list[tuple[int | None, np.ndarray, int, tuple[np.ndarray, np.ndarray]]] = []  # id, ids, tokens already placed, words
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray, terms: tuple[np.ndarray, np.ndarray]) -> None:
        full = len(ids) // WINDOW * WINDOW
        for s in range(0, full, WINDOW):
            self._sequence([(doc_id, ids, s, WINDOW)])
        if full < len(ids):
            self.pool.append((doc_id, ids, full, terms))
            self.held += len(ids) - full
        if self.held >= SHARD_TOKENS:
            self._shard()

    def finish(self) -> None:
        if self.held >= WINDOW:
            self._shard()
        rest = [[d, ids, s, len(ids) - s] for d, ids, s, _ in self.pool]
        size, total = WINDOW, self.held
        while total:
            while size > total:
                size //= 2
            window, free = [], size
            while free:
                d, ids, s, n = rest[0]
                take = min(n, free)
                window.append((d, ids, s, take))
                free -= take
                rest[0][2:] = s + take, n - take
                if take == n:
                    rest.pop(0)
            self._sequence(window)
            total -= size
        self.pool, self.held = [], 0

    def _sequence(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, ids, start, n in pieces:
            self.rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids), self.next, at))
            at += n
        self.next += 1

    def _shard(self) -> None:
        pool, held = self.pool, self.held
        start = np.array([s for _, _, s, _ in pool])
        left = np.array([len(ids) for _, ids, _, _ in pool]) - start
        index = Index([terms for *_, terms in pool], self.known)
        unused = np.ones(len(pool), bool)
        for seed in np.argsort(-left, kind="stable"):
            if held < WINDOW:
                break
            if not unused[seed]:
                continue
            unused[seed] = False
            window, free = [(*pool[seed][:2], int(start[seed]), int(left[seed]))], WINDOW - int(left[seed])
            if free:
                ranked = np.flatnonzero(unused)
                ranked = ranked[np.argsort(-index.scores(seed)[ranked], kind="stable")]
                least = left[ranked].min(initial=WINDOW)
                for d in ranked[left[ranked] <= free]:
                    n = int(left[d])
                    if n <= free:
                        window.append((*pool[d][:2], int(start[d]), n))
                        unused[d] = False
                        free -= n
                        if free < least:
                            break
            if free:
                d = ranked[unused[ranked]][0]
                window.append((*pool[d][:2], int(start[d]), free))
                start[d] += free
                left[d] -= free
            self._sequence(window)
            held -= WINDOW
        self.pool = [(*pool[i][:2], int(start[i]), pool[i][3]) for i in np.flatnonzero(unused)]
        self.held = held


def pack(docs: DataFrame, source: str, terms: int | None = None, most: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. The search for neighbours is
    exact, unless ``terms`` and ``most`` limit it as in ``neighbours``."""
    spark, rows = docs.sparkSession, _keyed(docs)
    held, vocabulary = spark.sparkContext.broadcast(corpus(rows)), spark.sparkContext.broadcast(source)
    routes = cut(grouped(neighbours(rows, held, terms, most), rows))
    routes = F.broadcast(routes) if routes.count() <= SMALL else routes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 40, held.value)

        def done() -> pa.RecordBatch:
            out, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * len(NAMES), names=NAMES)

        for batch, texts in words.text_batches(batches):
            terms = terms_of(texts)
            for i, (doc_id, ids) in enumerate(zip(batch.column("doc_id").to_pylist(), tokenize(texts, vocabulary.value), strict=True)):
                packer.add(doc_id, ids, terms.of(i))
            yield done()
        packer.finish()
        yield done()
        del packer
        words.release()

    salt = F.pmod(F.when(F.col("apart"), F.xxhash64("row")).otherwise(F.xxhash64("key")), F.col("parts"))
    dealt = rows.join(routes, "key", "left").withColumns({"route": F.coalesce("route", "key"), "salt": F.coalesce(salt, F.lit(0))})
    dealt = dealt.repartition("route", "salt").sortWithinPartitions("route", "salt", "key", "doc_id")
    return dealt.select("doc_id", "text").mapInArrow(run, SCHEMA)
