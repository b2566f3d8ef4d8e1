"""Collocations: phrases of two to four words that occur more often than their parts explain.

1. Shards. A task gathers texts up to ``SHARD_BYTES`` and, for each language in them, makes a suffix array over word
   ids by prefix doubling in numpy: ranks of one word, then of two, then of four, which is as far as phrases reach. The
   lengths of common prefixes of neighbours in the array cut it into intervals, one for each phrase, and an interval's
   length is how often the shard has the phrase. Pieces end a suffix.
2. A first pass counts words and pairs of words by their hash. Only those that reach ``LEAST`` may be in a phrase that
   does; they make a bitmap of fixed size (``bitmap``), which is broadcast. A second pass does the same for three words
   whose pairs are in it. Hashes that collide only let more through.
3. A third pass over the shards gives the words and phrases themselves, of which all pairs and threes are in the bitmaps;
   Spark merges them by language and phrase, so counts are of the words, never of hashes.
4. Scores, parts and the phrases that hold others are joins on the phrases that reach ``LEAST``, in exact decimals.
   The ranking keeps each task's first ``TOP`` of a language before anything is shuffled.

Edge cases
* null and empty texts have no words; a null language is ``und``, and so one with texts that name it so.
* very long texts are one shard each and are read whole; repeated rows count again.
* ties in a score go by count, then by the phrase's bytes; cuts that tie in a score after flooring go to the smallest.
* an empty table, or one without a frequent phrase, gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import bitmap, words
from millrace.session import cut

LONGEST, LEAST, SCALE, TOP = 4, 30, 2_000_000, 2000
INSIDE = 80  # per cent of a phrase's occurrences
SHARD_BYTES = 8 << 20
UNKNOWN = "und"
#: Bits of a hash that go to the count: fewer let more through, more take more room in the shuffle.
COUNTED = 40
_SPACE, _ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_SPACE)] = 1
_KIND[list(_ENDS)] = 2


@dataclass
class Shard:
    """Words in their order: a local id each (from 1), 0 between pieces; and each id's hash and bytes."""

    ids: np.ndarray
    hashes: np.ndarray
    words: list[bytes]


def shard_of(parts: list[bytes]) -> Shard:
    """The shard of some texts, in lower case as to A-Z."""
    found, hashes, places = [], [], []
    for part in parts:
        data = part.lower()
        raw = np.frombuffer(data + b"\n", np.uint8)
        kind = _KIND[raw]
        edge = np.flatnonzero(np.diff(kind == 0, prepend=False))
        start, end = edge[::2], edge[1::2]
        ends = np.cumsum(kind == 2, dtype=np.int32)
        piece = ends[start]
        found.append((data, start, end))
        hashes.append(words.ranges(raw, start, end))
        places.append(np.diff(piece, append=-1) != 0)  # whether a word is the last of its piece
    h, last = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, bool), *places])
    known, first, word = np.unique(h, return_index=True, return_inverse=True)
    ids = np.zeros(len(h) + int(last.sum()), np.int64)
    ids[np.arange(len(h)) + np.cumsum(last) - last] = word + 1
    names, at, off = [b""] * len(known), np.argsort(first), 0
    run = iter(at.tolist())
    i = next(run, None)
    for data, start, end in found:
        while i is not None and first[i] < off + len(start):
            k = int(first[i]) - off
            names[i] = data[start[k] : end[k]]
            i = next(run, None)
        off += len(start)
    return Shard(ids, np.concatenate([np.zeros(1, np.uint64), known]), [b"", *names])


def _doubled(rank: np.ndarray, by: int) -> np.ndarray:
    """Ranks of prefixes twice as long: of pairs of ranks ``by`` places apart, nothing lying beyond the end."""
    ahead = np.zeros_like(rank)
    ahead[:-by] = rank[by:]
    return np.unique(rank * (int(rank.max(initial=0)) + 1) + ahead, return_inverse=True)[1]


def intervals(ids: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, counts): for each length up to ``longest`` (1, 2 or 4) the distinct phrases, each by one place where it
    starts, and how often it occurs."""
    rank, by = ids, 1
    while by < longest:
        rank = _doubled(rank, by)
        by *= 2
    array = np.argsort(rank, kind="stable")
    pad = np.concatenate([ids, np.zeros(longest, ids.dtype)])
    common = np.zeros(len(ids), np.int8)  # of each suffix in the array with the one before it
    same = np.ones(max(len(ids) - 1, 0), bool)
    rest = np.zeros(len(ids), np.int8)  # words up to the end of the piece
    inside = np.ones(len(ids), bool)
    for j in range(longest):
        word = pad[array + j]
        same &= (word[1:] == word[:-1]) & (word[1:] > 0)
        common[1:] += same
        inside &= word > 0
        rest += inside
    for n in range(1, longest + 1):
        start = np.flatnonzero(common < n)
        count = np.diff(start, append=len(ids))
        whole = rest[start] >= n
        yield n, array[start[whole]], count[whole]


def _hashes(shard: Shard, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place a hash of language and word, of language and pair of words, and of language and three words; the latter
    are of no use where a piece has no such phrase."""
    h = shard.hashes[shard.ids]
    ahead = np.concatenate([h[1:], np.zeros(1, np.uint64)])
    one = words.mix(h + np.uint64(xxhash.xxh3_64_intdigest(lang)))
    two = words.mix(one + ahead)
    return one, two, words.mix(two + np.concatenate([ahead[1:], np.zeros(min(len(ahead), 1), np.uint64)]))


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, Shard]]:
    held: dict[str, list[bytes]] = {}
    size = 0

    def done() -> Iterator[tuple[str, Shard]]:
        for lang, parts in held.items():
            yield lang, shard_of(parts)

    for batch, texts in words.text_batches(batches):
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            by.setdefault(lang, []).append(text)
            size += len(text)
        for lang, own in by.items():
            held.setdefault(lang, []).append(b"\n".join(own))
        if size >= limit:
            yield from done()
            held, size = {}, 0
    yield from done()


def _hash_counts(docs: DataFrame, limit: int, pairs=None) -> DataFrame:
    """(h, n): words and pairs by hash; with a bitmap of ``pairs``, which is broadcast, three words whose pairs are in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in _shards(batches, limit):
            if not len(shard.ids):
                continue
            hashes = _hashes(shard, lang)
            known = None if pairs is None else np.append(bitmap.holds(pairs.value, hashes[1]), False)
            for n, at, count in intervals(shard.ids, 2 if pairs is None else LONGEST):
                if known is not None:
                    at, count = (at[:0], count[:0]) if n != 3 else (at[own := known[at] & known[at + 1]], count[own])
                for s in range(0, len(at), 1 << 16):
                    own = slice(s, s + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array((hashes[n - 1][at[own]] >> np.uint64(64 - COUNTED)).view(np.int64)), pa.array(count[own])], names=["h", "n"])

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _phrase_counts(docs: DataFrame, pairs, triples, limit: int) -> DataFrame:
    """(lang, phrase, n) a shard: words, and phrases of which all pairs and threes are in the bitmaps, and in a row
    without a phrase all words."""
    names = ["lang", "phrase", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in _shards(batches, limit):
            if not len(shard.ids):
                continue
            ids = shard.ids
            one, two, three = _hashes(shard, lang)
            often, pair, triple = bitmap.holds(pairs.value, one), bitmap.holds(pairs.value, two), bitmap.holds(triples.value, three)
            pair, triple = np.append(pair, [False] * LONGEST), np.append(triple, [False] * LONGEST)
            text = pa.array(shard.words, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([int((ids > 0).sum())], pa.int64())], names=names)
            for n, at, count in intervals(ids, LONGEST):
                ok = often[at] if n == 1 else np.all([pair[at + j] for j in range(n - 1)] + [triple[at + j] for j in range(n - 2)], axis=0)
                at, count = at[ok], count[ok]
                for s in range(0, len(at), 1 << 15):
                    own = at[s : s + (1 << 15)]
                    parts = [text.take(pa.array(ids[own + j])) for j in range(n)]
                    phrase = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), phrase, pa.array(count[s : s + (1 << 15)])], names=names)

    counts = docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return counts.select("lang", F.when(F.col("phrase").isNull(), 0).otherwise(F.size(F.split("phrase", " "))).alias("size"), "phrase", "f")


def frequent(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(lang, size, phrase, f): phrases of up to four words that occur ``LEAST`` times, and single words that do;
    and for each language a row of size 0 with the count of all words."""
    slim = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    send = docs.sparkSession.sparkContext.broadcast
    often = lambda counts: bitmap.gather(counts.where(F.col("n") >= LEAST).select(F.shiftleft("h", 64 - COUNTED).alias("h")), "h")
    pairs = send(often(_hash_counts(slim, limit)))
    triples = send(often(_hash_counts(slim, limit, pairs)))
    return cut(_phrase_counts(slim, pairs, triples, limit).where((F.col("f") >= LEAST) | (F.col("size") == 0)))


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def _part(start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("w", start, n), " ")


def _runs_of(n: int) -> Column:
    """All runs of ``n`` words of a longer phrase; none of others."""
    runs = F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: _part(i, n))
    return F.when(F.col("size") > n, runs).otherwise(F.array().cast("array<string>"))


def collocations(docs: DataFrame, top: int = TOP, limit: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    known = frequent(docs, limit)
    total = known.where("size = 0").select("lang", F.col("f").alias("n"))
    counts = known.where("size > 0").select("lang", "phrase", "f")
    phrases = known.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    # A phrase goes if a longer one holds it and has nearly all its occurrences.
    inner = F.explode(F.concat(*[_runs_of(n) for n in range(2, LONGEST)]))
    held = phrases.where(F.col("size") > 2).select("lang", F.col("a").alias("_f"), inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    left = phrases.join(held, ["lang", "phrase"], "left").where(F.col("_f").isNull() | (_exact("_f") * 100 < _exact("a") * INSIDE)).drop("_f")

    cuts = left.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("_l"), _part(F.col("k") + 1, F.col("size")).alias("_r"))
    side = lambda name: counts.select("lang", F.col("phrase").alias(f"_{name}"), F.col("f").alias(name))
    scored = cuts.join(side("l"), ["lang", "_l"]).join(side("r"), ["lang", "_r"])
    scored = scored.withColumn("score", F.expr(f"(cast(a AS decimal(20,0)) * {SCALE}) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    ranked = lowest.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, range(1, {LONGEST + 1}) s(size))),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= {LEAST}),
inner_ AS (SELECT lang, f, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, a AS f, w, m, unnest(range(1, size - m + 2)) AS i FROM c, range(2, {LONGEST}) t(m) WHERE m < size)),
dropped AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inner_ i ON c.lang = i.lang AND c.phrase = i.phrase AND CAST(100 AS HUGEINT) * i.f >= CAST({INSIDE} AS HUGEINT) * c.a),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 : size], ' ') AS rp FROM (SELECT *, unnest(range(1, size)) AS k FROM c ANTI JOIN dropped USING (lang, phrase))),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r, CAST((CAST({SCALE} AS HUGEINT) * a) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = lp JOIN f r ON r.lang = cuts.lang AND r.phrase = rp),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
