"""Removal of passages that repeat: bytes under a string of ``LENGTH`` bytes that starts anywhere else too.

1. Anchors. Every string of ``LENGTH`` bytes holds ``SPAN`` starts of strings of ``GRAM`` bytes; the one of least hash,
   the first of those that tie, is its anchor. Equal strings have their anchors at the same place, so a string repeats
   only where its anchor's gram does. Grams are counted; the anchors of those that occur twice are kept: first by a
   bitmap of fixed size (``bitmap``), then exactly, by a join that Spark splits where one gram is in very many texts.
2. Segments. Of each such anchor the text from ``SPAN - 1`` bytes before it to ``LENGTH`` after it holds every string
   that the anchor speaks for. A task sends each segment once: one that it has seen twice repeats as a whole, which
   settles its places at home, and goes on only as a partner for others.
3. Suffix sort. Segments of one gram meet in a task. What lies right of the anchors, and what lies left of them read
   backwards, is sorted by a merge sort whose comparisons find the common extension of two suffixes by binary search
   over prefix polynomial hashes, some five steps a comparison, and the byte by which they differ in the block after
   it. All merges of a level go on at once in numpy. Neighbours are then compared byte by byte: order and common lengths
   must hold exactly, else hashes collided and the sort is done again with another base.
4. The common lengths cut both arrays into classes at every depth. The string that starts ``o`` bytes before an anchor
   repeats if another segment is in its class at depth ``LENGTH - o`` to the right and at depth ``o`` to the left. All
   strings of an anchor overlap, so what they cover is one range, from the first to the last one that repeats.
5. Grams with more than ``GROUP`` segments to send do not meet in one task: their strings are counted one by one, by
   two hashes, combined before the shuffle.
6. Texts with copies are covered wholly; the ranges of the others are merged, and their texts are cut and hashed.

Edge cases
* null and empty texts: no bytes, nothing removed, the digest of no bytes.
* texts below ``LENGTH`` bytes lose nothing, however often they occur.
* very long texts are read in pieces that overlap, and cut whole.
* repeated rows, also under one id, are copies of one another and lose everything; null ids are carried through.
* ties between hashes go to the first place; runs of one character give one segment, however long they are.
* an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import bitmap, words
from millrace.session import cut, scratch

LENGTH, GRAM = 200, 64
SPAN = LENGTH - GRAM + 1
GROUP = 1 << 17
SHARD = 1 << 14  # segments that are sorted at once
HELD = 1 << 16  # segments that a task remembers at once
SEEN = 1 << 16  # texts likewise
PIECE = 1 << 16  # bytes whose anchors are sought at once
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_INDEX = np.uint64((1 << 20) - 1)


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * words.powers(BASES[0], len(raw)))])
    return words.mix((total[GRAM:] - total[:-GRAM]) * words.powers(pow(BASES[0], -1, 1 << 64), len(raw))[: len(raw) - GRAM + 1])


def _least(h: np.ndarray) -> np.ndarray:
    """The least of every ``SPAN`` neighbours."""
    span, m = 1, h
    while 2 * span <= SPAN:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(h) - SPAN + 1], m[SPAN - span :]) if span < SPAN else m


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and gram hash of all anchors; texts go through in pieces of about ``PIECE`` bytes."""
    out: list[tuple] = []
    held: list[tuple[int, int, bytes]] = []  # text, start, piece
    size = 0

    def flush() -> None:
        raw = np.frombuffer(b"".join(p for *_, p in held), np.uint8)
        h = _gram_hashes(raw)
        least = _least(h & ~_INDEX | np.arange(len(h), dtype=np.uint64))
        off = words.offsets([len(p) for *_, p in held])
        at = words.within(off[:-1], np.diff(off) - LENGTH + 1)  # the strings inside one piece
        place = (least[at] & _INDEX).astype(np.int64)
        place = place[np.concatenate([[True], place[1:] != place[:-1]])]
        piece = np.searchsorted(off, place, side="right") - 1
        doc, start = np.array([d for d, *_ in held]), np.array([s for _, s, _ in held])
        out.append((doc[piece], place - off[piece] + start[piece], h[place]))

    for i, text in enumerate(texts):
        for s in range(0, len(text) - LENGTH + 1, PIECE - LENGTH + 1):
            held.append((i, s, text[s : s + PIECE]))
            size += len(held[-1][2])
            if size >= PIECE:
                flush()
                held, size = [], 0
    if held:
        flush()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, place, h = (np.concatenate(c) for c in zip(*out, strict=True))
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])])  # pieces overlap
    return doc[new], place[new], h[new]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Keys and texts, those left out that the task has just had."""
    seen: set[bytes] = set()
    for batch, texts in words.text_batches(batches):
        new = []
        for i, key in enumerate(batch.column("key").to_pylist()):
            if key not in seen:
                seen.add(key)
                new.append((key, texts[i]))
        if len(seen) > SEEN:
            seen.clear()
        if new:
            keys, own = zip(*new, strict=True)
            yield list(keys), list(own)


def _texts(docs: DataFrame) -> DataFrame:
    """(key, text) of the texts that are long enough; the key is a digest, so copies share it."""
    return docs.where(F.octet_length("text") >= LENGTH).select(F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("key"), "text")


def _repeated_grams(texts: DataFrame) -> DataFrame:
    """(h, n) of the grams that are anchors more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _distinct(batches):
            h, n = np.unique(anchors(own)[2], return_counts=True)
            for s in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[s : s + (1 << 16)].view(np.int64)), pa.array(n[s : s + (1 << 16)])], names=["h", "n"])

    return cut(texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))


def _candidates(texts: DataFrame, repeated: DataFrame, group: int) -> DataFrame:
    """(key, anchors): of each text the anchors (pos, h, hot) whose grams repeat; several tasks may have found one text."""
    held = texts.sparkSession.sparkContext.broadcast(bitmap.gather(repeated, "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, own in _distinct(batches):
            doc, place, h = anchors(own)
            some = np.flatnonzero(bitmap.holds(held.value, h))
            for s in range(0, len(some), 1 << 16):
                at = some[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(keys, pa.binary()).take(pa.array(doc[at])), pa.array(place[at])], names=["h", "key", "pos"])

    found = texts.mapInArrow(run, "h long, key binary, pos long").join(repeated, "h")
    return cut(found.groupBy("key").agg(F.collect_set(F.struct("pos", "h", (F.col("n") > group).alias("hot"))).alias("anchors")))


def _only(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts whose keys may be among some, which only saves the rest from a shuffle; of copies some."""
    held = texts.sparkSession.sparkContext.broadcast(bitmap.gather(keys.select(F.xxhash64("key").alias("h")), "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitmap.holds(held.value, batch.column("h").to_numpy().view(np.uint64)))).select(["key", "text"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, own in _distinct(run(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(own, pa.binary())], names=["key", "text"])

    return texts.select("key", "text", F.xxhash64("key").alias("h")).mapInArrow(once, "key binary, text binary")


PIECES = "h long, name binary, key binary, pos long, before int, seg binary, twice boolean, hot boolean, upto long"


def _segments(rows: DataFrame) -> DataFrame:
    """Rows (key, text, anchors) as rows of two kinds: segments for their gram's task, and ranges (key, pos, upto) that are
    settled. A segment's key and pos are null where its places are settled."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}  # by name: h, before, segment, hot, places
        done: set[bytes] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            out, ranges = [], {}
            for name, (h, before, seg, hot, places) in held.items():
                if len(places) > 1:
                    out.append((h, name, None, None, before, seg, True, hot, None))
                    for key, pos in places:
                        ranges.setdefault(key, []).append((pos - before, pos - before + len(seg)))
                else:
                    out.append((h, name, *places.pop(), before, seg, False, hot, None))
            for key, own in ranges.items():
                for a, b in _merged(own):
                    out.append((None, None, key, a, None, None, None, None, b))
            held.clear()
            for s in range(0, len(out), 1 << 13):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[s : s + (1 << 13)], strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for row in range(batch.num_rows):
                key = batch.column("key")[row].as_py()
                if key in done:
                    continue
                done.add(key)
                text = batch.column("text")[row].as_py()
                for x in sorted(batch.column("anchors")[row].as_py(), key=lambda x: x["pos"]):
                    pos = x["pos"]
                    before = min(pos, SPAN - 1)
                    seg = text[pos - before : pos + LENGTH]
                    name = hashlib.md5(before.to_bytes(2, "big") + seg).digest()
                    if (own := held.get(name)) is None:
                        held[name] = [x["h"], before, seg, x["hot"], {(key, pos)}]
                    else:
                        own[4].add((key, pos))
                if len(held) >= HELD:
                    yield from flush()
            if len(done) > SEEN:
                done.clear()
        yield from flush()

    return rows.select("key", "text", "anchors").mapInArrow(run, PIECES)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


class Suffixes:
    """Strings of some groups, sorted inside each group, with the length that each has in common with the one before it.

    ``blocks``: the strings' bytes as big-endian 64-bit integers, zeros behind their ends.
    """

    def __init__(self, strings: list[bytes], group: np.ndarray, most: int):
        width = -(-most // 8)
        self.size = np.array([len(s) for s in strings], np.int64)
        self.bytes = np.frombuffer(b"".join(s.ljust(8 * width, b"\0") for s in strings), np.uint8).reshape(len(strings), 8 * width)
        self.blocks = self.bytes.view(">u8").astype(np.uint64)
        for base in BASES:
            self._hashed(base)
            self.order = self._sorted(group)
            if self._verified(group):
                return
        raise ArithmeticError("prefix hashes collide under every base")

    def _hashed(self, base: int) -> None:
        """Hashes of the prefixes of 0, 1, ... blocks."""
        terms = words.mix(self.blocks + np.uint64(1)) * words.powers(base, self.blocks.shape[1])
        self.prefix = np.concatenate([np.zeros((len(terms), 1), np.uint64), np.cumsum(terms, axis=1)], axis=1)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many whole blocks two strings have in common, by binary search over their prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.blocks.shape[1])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.prefix[a, mid] == self.prefix[b, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def _order(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as a stands before b, is equal or stands behind; of equal bytes the shorter string stands first."""
        n = self._common(a, b)
        at = np.minimum(n, self.blocks.shape[1] - 1)
        x, y = self.blocks[a, at], self.blocks[b, at]
        return np.where(x != y, np.where(x < y, -1, 1), np.sign(self.size[a] - self.size[b]))

    def _sorted(self, group: np.ndarray) -> np.ndarray:
        """Merge sort of each group; in a merge a string's place is its own plus the count of those before it in the other run."""
        n = len(group)
        start = np.searchsorted(group, group)  # of its group, for each place
        end = np.searchsorted(group, group, side="right")
        order, place, width = np.arange(n), np.arange(n) - start, 1
        most = int((end - start).max(initial=0))
        while width < most:
            run = place // width
            other = start + (run ^ 1) * width
            low, high = np.minimum(other, end), np.minimum(other + width, end)
            first, left = low.copy(), run % 2 == 0
            some = np.flatnonzero(low < high)
            while len(some):
                mid = (low[some] + high[some]) >> 1
                sign = self._order(order[mid], order[some])
                ahead = (sign < 0) | ((sign == 0) & ~left[some])  # equal strings keep their order
                low[some], high[some] = np.where(ahead, mid + 1, low[some]), np.where(ahead, high[some], mid)
                some = some[low[some] < high[some]]
            to = start + (run // 2) * 2 * width + place % width + (low - first)
            out = np.empty_like(order)
            out[to] = order
            order, width = out, 2 * width
        return order

    def _verified(self, group: np.ndarray) -> bool:
        """Compare neighbours byte by byte, and set ``common``; False if the order is not that of the bytes."""
        self.common = np.zeros(len(self.order), np.int64)
        for s in range(1, len(self.order), SHARD):
            a, b = self.order[s - 1 : s - 1 + SHARD][: len(self.order) - s], self.order[s : s + SHARD]
            unlike = self.bytes[a] != self.bytes[b]
            differ = unlike.any(axis=1)
            n = np.where(differ, unlike.argmax(axis=1), self.bytes.shape[1])
            at = np.minimum(n, self.bytes.shape[1] - 1)
            same = group[s : s + SHARD] == group[s - 1 : s - 1 + SHARD][: len(a)]
            right = np.where(differ, self.bytes[a, at] < self.bytes[b, at], self.size[a] <= self.size[b])
            if not right[same].all():
                return False
            self.common[s : s + SHARD] = np.where(same, np.minimum(n, np.minimum(self.size[a], self.size[b])), -1)
        self.common[:1] = -1
        return True

    def classes(self, depth: int) -> np.ndarray:
        """A number for each string, equal for those of a group that have their first ``depth`` bytes in common."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < depth)
        return out


def repeats(group: np.ndarray, before: list[int], segments: list[bytes], twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct segments, sorted by group: the least and the greatest ``o`` for which the string that starts ``o`` bytes
    before the anchor repeats in the group, or in a segment that occurs twice; -1 if none does."""
    right = Suffixes([s[b:] for s, b in zip(segments, before, strict=True)], group, LENGTH)
    left = Suffixes([s[:b][::-1] for s, b in zip(segments, before, strict=True)], group, SPAN - 1)
    least, most = np.full(len(group), -1), np.full(len(group), -1)
    weight = np.where(twice, 2, 1)
    for o in range(SPAN):
        some = np.flatnonzero((left.size >= o) & (right.size >= LENGTH - o))
        if len(some):
            key = right.classes(LENGTH - o)[some] * (len(group) + 1) + left.classes(o)[some]
            _, inverse = np.unique(key, return_inverse=True)
            hit = some[np.bincount(inverse, weight[some])[inverse] > 1]
            least[hit] = np.where(least[hit] < 0, o, least[hit])
            most[hit] = o
    return least, most


RANGES = "key binary, a long, b long"


def _sorted_ranges(segments: DataFrame, shard: int) -> DataFrame:
    """(key, a, b): what the strings cover that repeat, from segments that meet by gram."""

    def judged(tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables).combine_chunks()
        name = t.column("name").to_pylist()
        first: dict[bytes, int] = {}
        of = np.array([first.setdefault(x, len(first)) for x in name])
        at = np.unique(of, return_index=True)[1]
        key, pos = t.column("key").to_pylist(), t.column("pos").to_pylist()
        places: list[set] = [set() for _ in first]
        for i, k, p in zip(of.tolist(), key, pos, strict=True):
            places[i].add((k, p))
        twice = t.column("twice").to_numpy(zero_copy_only=False)
        many = np.bincount(of, twice, len(first)) > 0
        many |= np.array([len(x) > 1 for x in places])
        rows = t.take(pa.array(at))
        before = rows.column("before").to_pylist()
        least, most = repeats(rows.column("h").to_numpy(), before, rows.column("seg").to_pylist(), many)
        out = [(k, p - most[i], p - least[i] + LENGTH) for i, own in enumerate(places) if most[i] >= 0 for k, p in own if k is not None]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([int(r[1]) for r in out], pa.int64()), pa.array([int(r[2]) for r in out], pa.int64())], names=["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for t, _ in words.groups(batches, ("h",)):
            held.append(t)
            size += t.num_rows
            if size >= shard:
                yield judged(held)
                held, size = [], 0
        if held:
            yield judged(held)

    rows = segments.select("h", "name", "key", "pos", "before", "seg", "twice")
    return rows.repartition("h").sortWithinPartitions("h", "name").mapInArrow(run, RANGES)


def _counted_ranges(segments: DataFrame) -> DataFrame:
    """The same for grams of very many segments: each string by two hashes, counted as often as places have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = np.frombuffer(row["seg"], np.uint8)
                n = len(raw) - LENGTH + 1
                if n <= 0:
                    continue
                hashes = []
                for base in BASES[:2]:
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * words.powers(base, len(raw)))])
                    hashes.append(words.mix((total[LENGTH:] - total[:-LENGTH]) * words.powers(pow(base, -1, 1 << 64), len(raw))[:n]))
                o = row["before"] - np.arange(n)
                columns = [pa.array(h.view(np.int64)) for h in hashes]
                columns += [pa.array([row["key"]] * n, pa.binary()), pa.array([row["pos"]] * n, pa.int64()), pa.array(o), pa.array([row["twice"]] * n)]
                yield pa.RecordBatch.from_arrays(columns, names=["w1", "w2", "key", "pos", "o", "twice"])

    strings = segments.select("key", "pos", "before", "seg", "twice").mapInArrow(run, "w1 long, w2 long, key binary, pos long, o long, twice boolean")
    place = F.xxhash64("key", "pos")
    many = strings.groupBy("w1", "w2", "o").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.max("twice").alias("t")).where("t OR lo != hi")
    hit = strings.where("key IS NOT NULL").join(many.select("w1", "w2", "o"), ["w1", "w2", "o"])
    return hit.groupBy("key", "pos").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).select("key", (F.col("pos") - F.col("hi")).alias("a"), (F.col("pos") - F.col("lo") + LENGTH).alias("b"))


def covered(docs: DataFrame, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """(key, ranges) of distinct texts of column ``text``: the ranges (a, b) of bytes to remove, not merged; texts without
    any have no row."""
    spark, texts = docs.sparkSession, _texts(docs)
    candidates = _candidates(texts, _repeated_grams(texts), group)
    home = scratch(spark, "substrings") + "/segments"
    _segments(_only(texts, candidates.select("key")).join(candidates.hint("shuffle_hash"), "key")).write.parquet(home)
    found = spark.read.parquet(home)
    segments = found.where("h IS NOT NULL")
    ranges = found.where("h IS NULL").select("key", F.col("pos").alias("a"), F.col("upto").alias("b"))
    ranges = ranges.unionByName(_sorted_ranges(segments.where("NOT hot"), shard)).unionByName(_counted_ranges(segments.where("hot")))
    return cut(ranges.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("ranges")))


def dedup(docs: DataFrame, group: int = GROUP, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text (what is left, as bytes; null where nothing is removed), n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    found = covered(rows, group, shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                data = batch.column("text")[i].as_py()
                spans = _merged([(x["a"], x["b"]) for x in batch.column("ranges")[i].as_py()])
                edges = [0, *(e for s in spans for e in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((batch.column("key")[i].as_py(), kept, len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names=["key", "kept", "n_removed", "n_spans", "kept_sha256"])

    kinds = "key binary, kept binary, n_removed long, n_spans long, kept_sha256 string"
    cuts = _only(_texts(rows), found.select("key")).join(found.hint("shuffle_hash"), "key").select("key", "text", "ranges").mapInArrow(run, kinds)
    cuts = cuts.groupBy("key").agg(*(F.first(c).alias(c) for c in ("kept", "n_removed", "n_spans", "kept_sha256")))
    data = F.encode("text", "UTF-8")
    slim = rows.select("doc_id", F.unhex(F.md5(data)).alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(data, 256).alias("_sha"))
    copies = slim.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("_copied"))
    out = slim.join(copies.join(cuts, "key", "left"), "key")
    whole = F.col("_copied") & (F.col("n_bytes") >= LENGTH)
    return out.select(
        "doc_id", F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("text"), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0))).alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"),
    )


#: The query as SQL, on texts in hex, which is cut into parts first as SQL counts characters from a string's start; ids must
#: be unique and not null there.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
part AS (SELECT doc_id, n, c, substr(x, 2 * c + 1, {2 * (2 * LENGTH - 1)}) AS p FROM (SELECT doc_id, x, n, unnest(range(0, n - {LENGTH - 1}, {LENGTH})) AS c FROM d)),
w AS (SELECT doc_id, c + j AS i, md5(substr(p, 2 * j + 1, {2 * LENGTH})) AS h FROM (SELECT doc_id, c, p, unnest(range(0, least({LENGTH}, n - {LENGTH - 1} - c))) AS j FROM part)),
r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH}, -1) AS new FROM w SEMI JOIN r USING (h)),
run AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + {LENGTH} AS b FROM run GROUP BY ALL),
edge AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM span),
kept AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed,
  string_agg(CASE WHEN k = 1 THEN substr(x, 1, 2 * a) ELSE '' END || substr(x, 2 * b + 1, 2 * (coalesce(next, n) - b)), '' ORDER BY a) AS x FROM edge JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
