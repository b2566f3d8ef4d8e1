import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import bloom
from millrace.operators import overlap

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split()
GRAM = " ".join(WORDS)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_flags(spark):
    ref = overlap.stream_grams(spark.createDataFrame([(0, "Alpha beta gamma delta epsilon"), (1, "zeta eta theta iota kappa lambda mu nu xi")], "i int, text string"), "i")
    assert sorted(r[0] for r in ref.collect()) == sorted([GRAM, " ".join([*WORDS[1:], "xi"])])
    texts = ["unrelated words here", "x " + ", ".join(WORDS).upper() + "!", " ".join(WORDS[:12]), "alpha beta QQ " + GRAM[11:], "", None, GRAM.replace("eta theta", "eta and theta"), "pre" + GRAM]
    got = {r.doc_id: r.flagged for r in overlap.flags(frame(spark, texts), ref).collect()}
    assert [i for i, f in sorted(got.items()) if f] == [1]


def test_matches_as_naive(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    import re

    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    grams = lambda ws: {" ".join(ws[i : i + 13]) for i in range(len(ws) - 12)}
    known = grams(words(" ".join(r.text for r in bench.orderBy("item_id").collect())))
    want = {(r.doc_id, g) for r in docs.collect() for g in grams(words(r.text)) & known}
    got = {(r.doc_id, r.gram) for r in overlap.matches(docs, overlap.stream_grams(bench, "item_id")).collect()}
    assert got == want and want


def test_large_reference_is_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SMALL", 0)
    monkeypatch.setattr(overlap.small, "__defaults__", (0,))
    ref = spark.createDataFrame([(GRAM,)], "gram string")
    assert [r.doc_id for r in overlap.matches(frame(spark, [GRAM, "no"]), ref).collect()] == [0]


def test_a_flag_belongs_to_a_text(spark):
    """Null and repeated ids: each row is judged by its own text, and its copies with it."""
    rows = [(None, GRAM), (None, "clean"), (7, "clean too"), (7, f"so {GRAM}"), (8, GRAM)]
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _digest string, k int")
    ref = spark.createDataFrame([(GRAM,), (None,)], "gram string")
    out = overlap.flags(docs, ref)
    assert out.columns == [*docs.columns, "flagged"]
    assert {r.k: r.flagged for r in out.collect()} == {0: True, 1: False, 2: False, 3: True, 4: True}
    assert {r.k: r.reason for r in overlap.drop_reasons(docs.withColumn("title", F.lit("t")), ref, None).collect()} == {0: "ngram", 1: None, 2: None, 3: "ngram", 4: "ngram"}
    assert not overlap.flags(docs, ref.limit(0)).where("flagged").count()


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_stream_grams_cross_lines_and_ranges(spark, parts):
    """Lines of none to forty words, empty and null ones among them, over more ranges than a gram has words."""
    rnd = random.Random(parts)
    lines = [None if rnd.random() < 0.1 else " ".join(f"w{rnd.randrange(9)}" for _ in range(rnd.choice([0, 0, 1, 2, 3, 40]))) for _ in range(60)]
    flow = [w for x in lines for w in (x or "").split()]
    want = {" ".join(flow[i : i + 13]) for i in range(len(flow) - 12)}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [r.gram for r in overlap.stream_grams(spark.createDataFrame(list(enumerate(lines)), "i long, text string"), "i").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(set(got)) and set(got) == want
    assert overlap.stream_grams(spark.createDataFrame([], "i long, text string"), "i").count() == 0


@pytest.mark.parametrize("most", [bloom.MOST, 1 << 20])
def test_many_grams_in_one_scan(spark, monkeypatch, most):
    """300,000 grams, also with filters that are far too small for them, against plain sets."""
    monkeypatch.setattr(bloom, "MOST", most)
    rnd = random.Random(3)
    words = [f"v{i}" for i in range(3000)]
    grams = [" ".join(rnd.choices(words, k=13)) for _ in range(300_000)]
    texts = [" ".join(rnd.choices(words, k=60)) for _ in range(300)]
    planted = {i * 7: rnd.choice(grams) for i in range(40)}
    texts = [f"{t} {planted.get(i, '')} end" for i, t in enumerate(texts)]
    ref = spark.createDataFrame([(g,) for g in grams], "gram string")
    assert {(r.doc_id, r.gram) for r in overlap.matches(frame(spark, texts), ref).collect()} == set(planted.items())


def test_bloom_filter_loses_nothing(spark):
    values = spark.range(50_000).select(F.xxhash64("id").alias("h"))
    known = bloom.build(values, "h", 50_000)
    mine = np.array([r.h for r in values.collect()], np.int64).view(np.uint64)
    assert known.holds(mine).all() and int(mine[0]) in known
    others = np.random.default_rng(1).integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert known.holds(others).mean() < 0.01
    assert not bloom.build(values.limit(0), "h", 0).holds(mine).any()


def test_reasons_and_counts(spark):
    rows = [(0, "Known @-@ Title", GRAM), (1, "Other", GRAM), (2, None, "text"), (3, "known-title", ""), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string")
    out = overlap.drop_reasons(docs, spark.createDataFrame([(GRAM,)], "gram string"), spark.createDataFrame([("Known-Title",)], "title string"))
    assert {r.doc_id: r.reason for r in out.collect()} == {0: "title", 1: "ngram", 2: None, 3: "title", 4: None}
    assert tuple(overlap.drop_counts(out.withColumn("s", F.lit("a")), "s").first())[1:] == (2, 2, 1)
    assert {r.reason for r in overlap.drop_reasons(docs, None, None).collect()} == {None}


def test_reports(spark):
    items = spark.createDataFrame([("a", 0, GRAM), ("a", 1, "short"), ("b", 2, GRAM + " xi")], "bench string, item_id int, text string")
    found = spark.createDataFrame([(9, GRAM)], "doc_id long, gram string")
    got = {r.bench: r for r in overlap.item_report(items, found).collect()}
    assert (got["a"].n_items, got["a"].n_items_with_ngrams, got["a"].n_items_hit, got["a"].n_ngrams, got["a"].n_matched_ngrams) == (2, 1, 1, 1, 1)
    assert (got["b"].n_ngrams, got["b"].n_matched_ngrams, got["b"].frac_ngrams_matched, got["b"].frac_items_hit) == (2, 1, 0.5, 1.0)
    empty = overlap.report(spark.createDataFrame([], "gram string"), found.limit(0)).first()
    assert (empty.n_ngrams, empty.frac_ngrams_matched, empty.examples) == (0, 0.0, "")
