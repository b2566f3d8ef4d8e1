"""Quality rules, the two classifiers and the language-model scores."""

import collections
import math
import re
import zlib

import numpy as np

from millrace.llm import backoff, features, nbsvm, nnpu, quality_rules, trees

ODD = [(9001, None), (9002, ""), (9003, " \n"), (9004, "x " * 20000), (9005, "#" * 3000), (9006, "| < >\n| < >\n"), (9006, "| < >\n| < >\n"), (None, "a b c")]
SCHEMA = "doc_id long, text string, score double, features int, n_words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, "x") for i, t in rows], SCHEMA)


def counts(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    often, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_rules_as_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + ODD
    got = quality_rules.judge(frame(spark, rows), None).collect()
    want = sorted(((i, *counts(t or "")) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, *r[1:6]) for r in got), key=repr) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed) for r in got)


def test_rules_find_held_out_junk(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest = quality_rules.train(docs, labels.where("doc_id % 2 = 0"))
    rows = quality_rules.judge(docs, forest).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.97
    kept = quality_rules.keep(docs, forest)
    assert kept.columns == docs.columns and kept.count() == quality_rules.judge(docs, forest).where("kept").count()


def test_rules_without_labels_and_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.train(frame(spark, ODD), labels) is None
    assert quality_rules.judge(frame(spark, []), None).collect() == []
    assert quality_rules.train(frame(spark, ODD), spark.createDataFrame([(9004, 1), (9005, None), (5, 1)], "doc_id long, quality int")).base > 0


def test_trees_keep_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + 0.2 * x[:, 2] < 0.7).astype(float)
    forest = trees.fit(x, y, np.array([-1, 0, 0]))
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.4), np.full(200, 0.5)], 1)
    assert (np.diff(forest.raw(grid)) <= 1e-9).all() and ((forest.probability(x) > 0.5) == y).mean() > 0.95
    assert trees.fit(x[:0], y[:0], np.zeros(3)).probability(x[:2]).tolist() == [0.5, 0.5]


def test_quality_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = nbsvm.classify(docs, nbsvm.train(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows if r.held_out]) > 0.95


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = nnpu.train(docs, labels)
    rows = nnpu.classify(docs, held).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.predicted for r in out if r.toxic]) > 0.75 and np.mean([r.predicted for r in out if not r.toxic]) < 0.02
    assert nnpu.keep(docs, held).columns == docs.columns


def test_classifiers_on_odd_rows(spark):
    labels = spark.createDataFrame([(9004, 1, 1), (9005, 0, 0), (9006, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, ODD)
    for model in (nbsvm, nnpu):
        rows = model.classify(docs, model.train(docs, labels)).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 9006}) == 1
        assert model.classify(docs.limit(0), model.train(docs.limit(0), labels.limit(0))).collect() == []
    assert {r.score for r in nnpu.classify(docs, nnpu.train(docs, labels.limit(0))).collect()} == {0.0}


def test_non_negative_risk_separates():
    rng = np.random.default_rng(2)
    clean = [np.unique(rng.integers(100, 900, 40)) for _ in range(300)]
    toxic = [np.unique(np.append(rng.integers(100, 900, 40), rng.integers(0, 5, 2))) for _ in range(100)]
    weights, bias = nnpu.fit(toxic[:60], clean[:200] + toxic[60:80], 0.1)
    p = lambda rows: np.array([nnpu.probability((weights, bias), np.zeros(len(r), int), r, 1)[0] for r in rows])
    assert (p(toxic[80:]) > 0.5).all() and (p(clean[200:]) < 0.5).all()


def test_scores_as_brute_force(spark):
    rows = [(1, "The cat sat on the mat"), (2, "the cat sat"), (2, "the cat sat"), (3, None), (4, ""), (5, "a"), (6, "the cat the cat the cat " * 400)]
    texts = [(i, (t or "").encode().lower().split()) for i, t in rows]
    c = collections.Counter(tuple(ws[i - k + 1 : i + 1]) for _, ws in texts for i in range(len(ws)) for k in (1, 2, 3) if i - k + 1 >= 0)
    total = sum(len(ws) for _, ws in texts)

    def word(ws, i):
        room = min(i + 1, 3)
        for k in (3, 2):
            g = tuple(ws[i - k + 1 : i + 1])
            if room >= k and c[g] >= 2:
                return (room - k) * math.log(0.4) + math.log(c[g] / c[g[:-1]])
        return (room - 1) * math.log(0.4) + math.log(c[ws[i],] / total)

    want = sorted((i, len(ws), round(sum(word(ws, j) for j in range(len(ws))), 3)) for i, ws in texts)
    got = backoff.score(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.score) for r in got) == want
    assert backoff.score(frame(spark, [])).collect() == []


def test_scores_over_many_blocks_and_parts(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(tuple(r) for r in backoff.score(docs).collect())
    stored = docs.selectExpr("sum(octet_length(text))").first()[0]
    for parts in (2, 3, 17, 3000):
        monkeypatch.setattr(backoff, "PART_BYTES", -(-stored // parts))
        monkeypatch.setattr(backoff, "BLOCK_BYTES", 100_000)
        assert sorted(tuple(r) for r in backoff.score(docs).collect()) == want


def test_rows_of_the_tables_are_never_more_than_n_grams(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c d{i}") for i in range(20)] + [(99, None)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 1)
    for parts in (1, 8, 10**6):
        rows = backoff.grams(docs, parts).collect()
        assert len(rows) <= 20 * 9 and {r.block for r in rows} == set(range(20))
    want = sorted(tuple(r) for r in backoff.score(docs).collect())
    monkeypatch.setattr(backoff, "PART_BYTES", 1)
    assert sorted(tuple(r) for r in backoff.score(docs).collect()) == want and want[-1] == (99, 0, 0, 0.0, None)


def test_repeated_ids_do_not_grow_the_samples(spark):
    """5,000 copies of one id, texts that differ under one id, and labels that disagree."""
    rows = [(1, "one same text of an id")] * 5000 + [(2, f"text {i} of the id") for i in range(300)] + [(10 + i, f"clean words {i} here and there") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1)] * 40 + [(2, 1, 1)] + [(10 + i, i % 2, 0) for i in range(60)] + [(11, 1, 1), (11, 0, 0)], "doc_id long, quality int, toxic int")
    chosen = features.agreed(labels, "quality")
    assert chosen.where("doc_id = 11").count() == 0 and chosen.where("doc_id = 1").count() == 1
    found = features.sample(docs, chosen, nbsvm.extractor, 100)
    assert len(found) == 100 and sum(r[0] == 1 for r in found) <= 1
    for model in (nbsvm, nnpu):
        assert model.classify(docs, model.train(docs, labels)).count() == len(rows)
    assert quality_rules.judge(docs, quality_rules.train(docs, labels)).count() == len(rows)
