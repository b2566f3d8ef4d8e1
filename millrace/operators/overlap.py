"""Overlap of a corpus with evaluation text by word 13-grams, and drop reasons.

One Arrow pass over the documents does the whole search, however many grams there are: words are hashed in numpy, a
window is looked at only if a Bloom filter may hold each of its words, and another one its hash. Both filters are
bounded in size and never lose a gram. The few windows that pass leave as text and are joined to the table of
grams, which is never collected, so neither a false hit of a filter nor a collision of hashes can flag a document.
A flag belongs to a text, so null and repeated keys flag and are flagged each by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import bloom, wordhash
from millrace.functions import text as T
from millrace.session import cut, fresh, spread

#: Rows up to which a narrow table is broadcast.
SMALL = 200_000
#: Bytes of text that are hashed at once.
BATCH = 4 << 20


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """``df``, computed once, with a broadcast hint if it has at most ``limit`` rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= limit else df


def stream_grams(reference: DataFrame, order: str, text: str = "text") -> DataFrame:
    """Distinct grams of all reference texts in order, as one stream of words: they cross text boundaries, and rows without a
    word do not interrupt them.

    Rows are dealt by ranges of the order. A task makes the grams that lie in its range, and tells the first and the last
    ``GRAM - 1`` words of it; from these, one row a task, come the grams that cross from range to range.
    """
    edge = T.GRAM - 1
    spread = reference.select(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t")).repartitionByRange("o", "t").sortWithinPartitions("o", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, tail = TaskContext.get().partitionId(), [], []
        for batch in batches:
            grams = set()
            for own in batch.column("w").to_pylist():
                head += own[: edge - len(head)]
                flow = tail + own
                grams.update(" ".join(flow[i : i + T.GRAM]) for i in range(len(flow) - edge))
                tail = flow[-edge:]
            yield pa.RecordBatch.from_pydict({"part": [part] * len(grams), "gram": list(grams), "head": [None] * len(grams), "tail": [None] * len(grams)}, schema=shape)
        yield pa.RecordBatch.from_pydict({"part": [part], "gram": [None], "head": [head], "tail": [tail]}, schema=shape)

    shape = pa.schema([("part", pa.int32()), ("gram", pa.string()), ("head", pa.list_(pa.string())), ("tail", pa.list_(pa.string()))])
    found = cut(spread.select(T.words("t").alias("w")).mapInArrow(run, "part int, gram string, head array<string>, tail array<string>"))

    # One row a task: the words before each range are folded, as a range may have fewer than a gram needs.
    ends = found.where("gram IS NULL").agg(F.array_sort(F.collect_list(F.struct("part", "head", "tail"))).alias("ends"))
    last = lambda ws: F.slice(ws, F.greatest(F.size(ws) - (edge - 1), F.lit(1)), F.lit(edge))
    none = F.array().cast("array<string>")

    def join(state, end):
        return F.struct(last(F.concat(state["before"], end["tail"])).alias("before"), F.concat(state["out"], T.ngrams(F.concat(state["before"], end["head"]))).alias("out"))

    across = ends.select(F.explode(F.aggregate("ends", F.struct(none.alias("before"), none.alias("out")), join, lambda s: s["out"])).alias("gram"))
    return found.where("gram IS NOT NULL").select("gram").unionByName(across).distinct()


def item_grams(items: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Distinct (keys, gram): grams within each text, never across texts."""
    return items.select(*keys, F.explode(F.array_distinct(T.ngrams(T.words(text)))).alias("gram")).distinct()


#: Bytes that belong to words stay, all others become spaces; texts are lower-cased before.
_LETTERS = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def _windows(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` words from each place on, that depends on their order."""
    total = np.zeros(len(first), np.uint64)
    for j in range(T.GRAM):
        total = wordhash.mix(total + h[first + j])
    return total


def _gram_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each gram its hash, and those of its words."""
    for batch in batches:
        h, off = wordhash.hashes([g.encode() for g in batch.column("gram").to_pylist()])
        whole = _windows(h, off[:-1][np.diff(off) == T.GRAM])
        every = np.unique(h)
        kind = np.repeat([True, False], [len(whole), len(every)])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([whole, every]).view(np.int64))], names=["whole", "h"])


def _hits(texts: list[str], known: bloom.Bloom, grams: bloom.Bloom) -> tuple[list[int], list[str]]:
    """Texts, by place, and the distinct windows of theirs that may be grams."""
    data = [t.lower().encode("utf-8", "replace").translate(_LETTERS) for t in texts]
    whole = b" ".join(data)
    h, start, end = wordhash.located(whole)
    run = np.concatenate([[0], np.cumsum(known.holds(h))])
    first = np.flatnonzero(run[T.GRAM :] - run[: -T.GRAM] == T.GRAM)
    if not len(first):
        return [], []
    doc = np.searchsorted(np.cumsum([len(d) + 1 for d in data]), start, side="right")
    first = first[doc[first] == doc[first + T.GRAM - 1]]
    first = first[grams.holds(_windows(h, first))]
    pairs = {(int(doc[i]), b" ".join(whole[a:b] for a, b in zip(start[i : i + T.GRAM].tolist(), end[i : i + T.GRAM].tolist(), strict=True))) for i in first.tolist()}
    ordered = sorted(pairs)
    return [d for d, _ in ordered], [g.decode() for _, g in ordered]


def matches(docs: DataFrame, grams: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (key, gram) for every reference gram that a document contains; computed once. Null keys are kept."""
    spark = docs.sparkSession
    wanted = cut(grams.select("gram").where("gram IS NOT NULL").distinct())
    n = wanted.count()
    hashes = cut(wanted.mapInArrow(_gram_hashes, "whole boolean, h long").distinct())
    held = spark.sparkContext.broadcast((bloom.build(hashes.where("NOT whole"), "h", hashes.where("NOT whole").count()), bloom.build(hashes.where("whole"), "h", n)))
    slim = spread(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")))
    kind = slim.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _cuts(batch):
                doc, gram = _hits(part.column("_text").to_pylist(), *held.value)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(doc, pa.int64())), pa.array(gram, pa.string())], names=[key, "gram"])

    return cut(slim.mapInArrow(run, f"`{key}` {kind}, gram string").join(wanted, "gram").select(key, "gram").distinct())


def _cuts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``BATCH`` bytes of text, or one row."""
    ends = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("_text")])
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + BATCH, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _hit(docs: DataFrame, grams: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_hit``: whether the text contains a reference gram."""
    name = fresh(docs, "_digest")
    marked = docs.withColumn(name, F.md5(F.coalesce(F.col(text), F.lit(""))))
    hit = matches(marked, grams, name, text).select(name).distinct().withColumn("_hit", F.lit(True))
    return marked.join(small(hit), name, "left").drop(name).withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def flags(docs: DataFrame, grams: DataFrame, text: str = "text") -> DataFrame:
    """Each document with ``flagged``: whether its text contains a reference gram."""
    return _hit(docs, grams, text).withColumnRenamed("_hit", "flagged")


def scan_totals(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: documents, matching documents, words, and tokens where each word and each document start is one."""
    n = F.size(T.words("text")).cast("long")
    hit = found.select(key).distinct().withColumn("_hit", F.lit(1))
    joined = docs.select(key, n.alias("n")).join(small(hit), key, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("n_docs_scanned"), F.count("_hit").alias("n_docs_matching"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_words_scanned"),
        F.coalesce(F.sum(F.col("n") + 1), F.lit(0)).alias("n_tokens_scanned"),
    )


def report(grams: DataFrame, found: DataFrame) -> DataFrame:
    """One row: reference grams, matched ones, their share, and the first five matched ones in order."""
    matched = found.select("gram").distinct().withColumn("m", F.lit(True))
    return grams.distinct().join(matched, "gram", "left").agg(
        F.count(F.lit(1)).alias("n_ngrams"), F.count("m").alias("n_matched_ngrams"),
        (F.count("m") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("frac_ngrams_matched"),
        F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.col("m"), F.col("gram")))), 1, 5), "|").alias("examples"),
    )


def item_report(items: DataFrame, found: DataFrame, bench: str = "bench", item: str = "item_id") -> DataFrame:
    """Per benchmark: items, items with grams, grams, matched grams, items hit, both shares, five examples.

    One scan serves all benchmarks: ``found`` may hold matches of their union.
    """
    grams = item_grams(items, bench, item)
    matched = found.select("gram").distinct().withColumn("m", F.lit(True))
    joined = grams.join(matched, "gram", "left")
    per_item = joined.groupBy(bench, item).agg(F.max(F.coalesce("m", F.lit(False))).alias("hit"))
    by_items = per_item.groupBy(bench).agg(F.count(F.lit(1)).alias("n_items_with_ngrams"), F.count_if("hit").alias("n_items_hit"))
    by_grams = joined.groupBy(bench, "gram").agg(F.max("m").alias("m")).groupBy(bench).agg(
        F.count(F.lit(1)).alias("n_ngrams"), F.count("m").alias("n_matched_ngrams"),
        F.array_join(F.slice(F.array_sort(F.collect_list(F.when(F.col("m"), F.col("gram")))), 1, 5), "|").alias("examples"),
    )
    out = items.groupBy(bench).agg(F.count_distinct(item).alias("n_items")).join(by_items, bench, "left").join(by_grams, bench, "left")
    out = out.fillna(0).fillna("")
    return out.withColumn("frac_ngrams_matched", F.col("n_matched_ngrams") / F.greatest("n_ngrams", F.lit(1))).withColumn("frac_items_hit", F.col("n_items_hit") / F.greatest("n_items", F.lit(1)))


def drop_reasons(docs: DataFrame, grams: DataFrame | None, titles: DataFrame | None, title: str = "title", text: str = "text") -> DataFrame:
    """Each document with ``reason``: "title" if its title is a known one, else "ngram" if it holds a known
    gram, else null. Titles are keyed once; the scan for grams reads ids and texts alone.
    """
    out = docs.withColumn("_hit", F.lit(False)) if grams is None else _hit(docs, grams, text)
    out = out.withColumn("reason", F.when(F.col("_hit"), F.lit("ngram"))).drop("_hit")
    if titles is not None:
        known = titles.select(T.title_key("title").alias("_key")).distinct().withColumn("_known", F.lit(True))
        out = out.withColumn("_key", T.title_key(F.coalesce(F.col(title), F.lit("")))).join(small(known), "_key", "left")
        out = out.withColumn("reason", F.when(F.col("_known"), F.lit("title")).otherwise(F.col("reason"))).drop("_key", "_known")
    return out


def drop_counts(reasons: DataFrame, *by: str) -> DataFrame:
    """Documents kept and dropped by each reason; a reason that never occurs counts 0."""
    count = lambda when, name: F.count_if(when).alias(name)
    return reasons.groupBy(*by).agg(
        count(F.col("reason").isNull(), "n_docs"), count(F.coalesce(F.col("reason") == "title", F.lit(False)), "n_docs_dropped_title"),
        count(F.coalesce(F.col("reason") == "ngram", F.lit(False)), "n_docs_dropped_ngram"),
    )


def union_grams(*parts: DataFrame) -> DataFrame:
    """Distinct grams of several references."""
    return reduce(DataFrame.unionByName, [p.select("gram") for p in parts]).distinct()
