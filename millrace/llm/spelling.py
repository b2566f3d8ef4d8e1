"""Groups of spelling variants: words that one inserted, deleted or replaced letter turns into a much more frequent one.

1. Words are counted over all documents: a task counts its own by hash in numpy, Spark adds the counts up.
2. A word of L letters has two segments, its first L // 2 letters and the rest. One edit leaves one of them as it
   is, so every word that is one edit away from w holds a segment of w: the first at its start or the second at its
   end, and has a length that differs by one at most. Rows are dealt by segment: each word goes where its own
   segments lie, and where those segments would lie that a word of one letter more or less has in common with it.
3. A task sorts its rows by segment and cuts them, between segments, into automaton shards of about ``SHARD`` rows.
   The shard's Aho-Corasick automaton holds the segments; all words of the shard are scanned. A match counts if it
   lies at the segment's place and the lengths are compatible; of the words that own the segment, those are verified
   that also share one of the two halves of their other segment, so a segment that very many words share is never
   compared in all pairs. A pair found by both segments counts once, by the first.
4. Segments of more than ``HOT`` words are dealt once more, by those halves, so that no task gets them whole.
5. Each word keeps the count of its near words and the most frequent one, combined before the shuffle. Roots follow
   the forms by pointer jumping: each round doubles the steps that a row has made, and forms at least ``RATIO`` times
   as frequent make chains short.

Edge cases
* null and empty texts have no words; very long texts and very long words are read whole.
* a null doc_id counts as an empty one in the hash that picks the altered words.
* repeated rows count again, as their words occur again.
* ties between near words of one count go to the least in code-point order.
* an empty table, or one without a word twice, gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words
from millrace.session import cut

LETTERS, LEAST, RATIO = 7, 2, 10
ALTER = 31
SHARD, HOT = 1 << 16, 1 << 17
SMALL = 100_000  # hot segments that may be broadcast
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
#: The lead byte of U+00C0 to U+00FF in UTF-8.
_LEAD = 0xC3
_TABLE = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)
_SHORT = 64


def _shifted(crc: np.ndarray, most: int) -> np.ndarray:
    """For each checksum, what it adds to that of a longer text after 0 .. ``most`` further bytes: CRCs are linear."""
    out = np.empty((most + 1, len(crc)), np.uint32)
    out[0] = crc
    for i in range(most):
        out[i + 1] = _TABLE[out[i] & np.uint32(255)] ^ (out[i] >> np.uint32(8))
    return out


def _runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and letters of each run of letters in UTF-8 text."""
    raw = np.frombuffer(text + b" ", np.uint8)
    lead = raw == _LEAD
    letter = _ASCII[raw] | lead
    letter[1:] |= lead[:-1]
    edge = np.flatnonzero(np.diff(letter, prepend=False))
    start, end = edge[::2], edge[1::2]
    n = np.concatenate([[0], np.cumsum(lead)])
    return start, end, end - start - (n[end] - n[start])


def _altered(word: str, h: int) -> str:
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counts(ids: list, texts: list[bytes]) -> dict[str, int]:
    """The words of some documents and how often they occur there."""
    lower = [t.lower() for t in texts]  # of bytes: A-Z alone
    whole = b" ".join(lower)
    start, end, n = _runs(whole)
    some = n >= LETTERS
    start, end = start[some], end[some]
    if not len(start):
        return {}
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in lower]), start, side="right")
    size = end - start
    _, first, word = np.unique(words.ranges(whole, start, end), return_index=True, return_inverse=True)
    names = [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    short = np.minimum(size, _SHORT)
    h = _shifted(prefix, int(short.max()))[short, doc] ^ np.array([zlib.crc32(x) for x in names], np.uint32)[word]
    for i in np.flatnonzero(size > _SHORT).tolist():
        h[i] = zlib.crc32(names[word[i]], int(prefix[doc[i]]))
    hit = h % np.uint32(ALTER) == 0
    own = np.bincount(word[~hit], minlength=len(names))
    out = defaultdict(int)
    for i in np.flatnonzero(own).tolist():
        out[names[i].decode()] = int(own[i])
    for i, x in zip(word[hit].tolist(), h[hit].tolist(), strict=True):
        found = _altered(names[i].decode(), x)
        if len(found) >= LETTERS:
            out[found] += 1
    return out


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words that occur ``LEAST`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in words.text_batches(batches):
            found = _counts(batch.column("id").to_pylist(), texts)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _one_edit(a: str, b: str) -> bool:
    """Whether exactly one insertion, deletion or replacement turns one text into the other."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def _rows(vocabulary: DataFrame) -> DataFrame:
    """(front, segment, rest, own, word, n): each word where its segments lie, and where those of a near word would.

    ``front``: the segment is a first half; ``rest`` is the word's other letters; ``own``: the segment is the word's.
    """
    size = F.char_length("word")

    def cut_at(front: bool, length: Column, own: Column) -> Column:
        at = length if front else size - length
        left, right = F.substring("word", F.lit(1), at), F.substring("word", at + 1, size)
        return F.struct(F.lit(front).alias("front"), (left if front else right).alias("segment"), (right if front else left).alias("rest"), own.alias("own"))

    half, yes, no = F.floor(size / 2).cast("int"), F.lit(True), F.lit(False)
    # Lengths of the first half in words of one letter less, as many, one more: two different ones; of the second half likewise.
    other = F.when(size % 2 == 0, half - 1).otherwise(half + 1)
    back, other_back = size - half, F.when(size % 2 == 0, size - half + 1).otherwise(size - half - 1)
    places = F.array(cut_at(True, half, yes), cut_at(True, other, no), cut_at(False, back, yes), cut_at(False, other_back, no))
    return vocabulary.select("word", "n", F.explode(places).alias("p")).select("p.*", "word", "n")


def _finer(rows: DataFrame) -> DataFrame:
    """Rows of hot segments once for each half of ``rest`` by which a pair can meet; ``part`` names it."""
    size = F.char_length("rest")

    def parts(length: Column) -> list[Column]:
        half = F.greatest(F.floor(length / 2), F.lit(0)).cast("int")
        return [F.concat(length.cast("string"), F.lit("<"), F.substring("rest", F.lit(1), half)), F.concat(length.cast("string"), F.lit(">"), F.substring("rest", size - (length - half) + 1, length))]

    own = F.array(*parts(size))
    near = F.array(*parts(size), *parts(size - 1), *parts(size + 1))
    return rows.withColumn("part", F.explode(F.array_distinct(near))).withColumn("own", F.col("own") & F.array_contains(own, F.col("part")))


class _Shard:
    """An automaton over the segments of some rows, and the words that own each."""

    def __init__(self, front: list[bool], segment: list[str], rest: list[str], own: list[bool], word: list[str], n: list[int], part: list[str]):
        self.automaton = ahocorasick.Automaton()
        self.owners: dict[tuple, dict] = {}  # by segment, then by length and half of the rest
        for f, s, r, o, w, k, p in zip(front, segment, rest, own, word, n, part, strict=True):
            if o:
                by = self.owners.setdefault((f, s), {})
                half = len(r) // 2
                for key in ((len(r), "<", r[:half]), (len(r), ">", r[half:])):
                    if not p or p == f"{key[0]}{key[1]}{key[2]}":
                        by.setdefault(key, []).append((r, w, k))
        for s in {s for _, s in self.owners}:
            self.automaton.add_word(s, len(s))
        self.words = sorted(set(zip(word, n, strict=True)))
        if self.owners:
            self.automaton.make_automaton()

    def near(self) -> Iterator[tuple[str, int, int, str]]:
        """(word, near words found here, count and name of the best one)."""
        for x, _ in self.words if self.owners else ():
            count, best = 0, None
            for end, length in self.automaton.iter(x):
                start = end + 1 - length
                found = []
                if start == 0 and (by := self.owners.get((True, x[:length]))):
                    found += self._verified(by, x[length:])
                if end + 1 == len(x) and (by := self.owners.get((False, x[start:]))):
                    found += ((w, k) for w, k in self._verified(by, x[:start]) if not x.startswith(w[: len(w) // 2]))
                for w, k in found:
                    count += 1
                    if best is None or k > best[0] or k == best[0] and w < best[1]:
                        best = k, w
            if best:
                yield x, count, *best

    @staticmethod
    def _verified(by: dict, rest: str) -> Iterator[tuple[str, int]]:
        """The owners of a segment whose rest is one edit away, each once."""
        for size in (len(rest) - 1, len(rest), len(rest) + 1):
            half = size // 2
            for r, w, k in by.get((size, "<", rest[:half]), ()):
                if _one_edit(r, rest):
                    yield w, k
            for r, w, k in by.get((size, ">", rest[len(rest) - (size - half) :]), ()):
                if r[:half] != rest[:half] and _one_edit(r, rest):
                    yield w, k


def near(vocabulary: DataFrame, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(word, n_near, best_n, best): how many words are one edit away, and the most frequent of them; others have no row."""
    rows = _rows(vocabulary)
    keys = ["front", "segment"]
    many = cut(rows.where("own").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).drop("_n"))
    count = many.count()
    if count:
        many = many.withColumn("_hot", F.lit(True))
        marked = rows.join(F.broadcast(many) if count <= SMALL else many, keys, "left")
        rows = marked.where("_hot IS NULL").withColumn("part", F.lit("")).unionByName(_finer(marked.where("_hot"))).drop("_hot")
    else:
        rows = rows.withColumn("part", F.lit(""))
    columns = ["front", "segment", "rest", "own", "word", "n", "part"]
    rows = rows.withColumn("key", F.xxhash64(*keys, "part"))

    def scanned(tables: list[pa.Table]) -> pa.RecordBatch:
        own = pa.concat_tables(tables)
        found = list(_Shard(*(own.column(c).to_pylist() for c in columns)).near())
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)], names=["word", "c", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for t, _ in words.groups(batches, ("key",)):
            held.append(t)
            size += t.num_rows
            if size >= shard:
                yield scanned(held)
                held, size = [], 0
        if held:
            yield scanned(held)
        held = []
        words.release()

    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "word string, c long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b")
    return found.groupBy("word").agg(F.sum("c").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where the chain of links (word, form) ends; words without a link have no row."""
    out = cut(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = out.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        out = cut(out.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if out.where("_moved").isEmpty():
            return out.drop("_moved")


def variants(docs: DataFrame, hot: int = HOT, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    vocabulary = cut(counts(docs, id_col, text_col))
    takes = F.col("best_n") >= RATIO * F.col("n")
    known = cut(
        vocabulary.join(near(vocabulary, hot, shard), "word", "left").select(
            "word", F.when(takes, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best_n")).alias("form_n")
        )
    )
    root = roots(known.where("form IS NOT NULL"))
    return known.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The query as SQL: the checksum byte by byte over a table, near words by the texts that one letter left out gives.
ORACLE_SQL = f"""
WITH RECURSIVE bit(k, i, c) AS (SELECT 0, i, i FROM range(256) r(i) UNION ALL SELECT k + 1, i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END FROM bit WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bit WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
own AS (SELECT doc_id, w, count(*) AS k FROM runs WHERE length(w) >= {LETTERS} GROUP BY ALL),
hx AS (SELECT w, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM own),
crc AS (SELECT w, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
  lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), CAST(4294967295 AS BIGINT)) AS h FROM hx, tab),
found AS (SELECT CASE WHEN h % {ALTER} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM crc),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM found WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(k) >= {LEAST}),
hole AS (SELECT word, n, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
less AS (SELECT DISTINCT h.word, v.word AS other, h.n AS n, v.n AS m FROM hole h JOIN v ON v.word = h.a || h.b),
near AS (SELECT x.word, y.word AS other, y.n AS m FROM hole x JOIN hole y ON x.a = y.a AND x.b = y.b AND x.word != y.word
  UNION SELECT word, other, m FROM less UNION SELECT other, word, n FROM less),
best AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
known AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * n THEN other END AS form, CASE WHEN m >= {RATIO} * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
chain(word, root, step) AS (SELECT word, word, 0 FROM known UNION ALL SELECT c.word, k.form, step + 1 FROM chain c JOIN known k ON k.word = c.root WHERE k.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM known JOIN ends USING (word)
"""
