from pyspark.sql.types import IntegerType

import corpus_pipeline
from millrace.llm import minhash, nnpu, packing, pii, quality_rules


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        seen[name] = out.collect()
        if name != "packing":
            assert out.columns == columns and out.dtypes == docs.dtypes
            docs = spark.createDataFrame(seen[name], docs.schema)
    ids = lambda n: {r.doc_id for r in seen[n]}
    assert ids("quality_rules") >= ids("toxicity") >= ids("near_dedup") == ids("pii") == ids("packing")
    assert all(r.n_chars == len(r.text) for r in seen["pii"])


def test_stages_decide_as_their_operators(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    run = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(run["quality_rules"](spark, docs, sf)) == ids(quality_rules.judge(docs, quality_rules.train(docs, labels)).where("kept"))
    assert ids(run["toxicity"](spark, docs, sf)) == ids(nnpu.classify(docs, nnpu.train(docs, labels)).where("predicted = 0"))
    assert ids(run["near_dedup"](spark, docs, sf)) == ids(minhash.components(docs, corpus_pipeline.NEAR_PERCENT).where("kept"))
    assert {r.doc_id: r.text for r in run["pii"](spark, docs, sf).collect()} == {r.doc_id: r.text for r in pii.report(docs).collect()}


def test_packing_stage_searches_without_limits(spark, sf, monkeypatch):
    """The stage's neighbours are those of the exact search, over all words and all texts."""
    found, grouped = [], packing.grouped
    monkeypatch.setattr(packing, "grouped", lambda links, rows: (found.append({r.key: r.score for r in links.collect()}), grouped(links, rows))[1])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    dict(corpus_pipeline.STAGES)["packing"](spark, docs, sf)
    keyed, held = packing._keyed(docs), spark.sparkContext.broadcast(packing.corpus(docs))
    whole = {r.key: r.score for r in packing.neighbours(keyed, held, None, None).collect()}
    capped = {r.key: r.score for r in packing.neighbours(keyed, held, packing.TERMS, packing.LIST).collect()}
    assert found == [whole] and whole != capped


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {r.offset for r in rows} >= {0}


def test_stages_on_odd_and_empty_tables(spark, sf):
    """Null and empty texts, a null id, repeats, a long text, and columns named like the stages' own."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    for name in ("_pii", "_found", "_matches", "text_key", "ids", "route", "key", "score"):
        schema = schema.add(name, IntegerType())
    prose = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id = 2").first().text
    bare = [(1, None), (2, ""), (2, ""), (None, prose), (3, "w" * 100000), (4, prose), (4, prose), (5, prose + " x"), (6, "call 10.2.3.4"), (7, "word and more " * 200000)]
    rows = [(i, t, "en", "s", len(t or ""), *range(8)) for i, t in bare]
    docs, run = spark.createDataFrame(rows, schema), dict(corpus_pipeline.STAGES)
    seen = {n: run[n](spark, docs, sf) for n in run}
    got = {n: sorted((r.doc_id for r in df.collect()), key=repr) for n, df in seen.items()}
    assert all(seen[n].columns == docs.columns for n in run if n != "packing")
    assert got["quality_rules"] == [4, 4, 5, None]
    assert got["toxicity"] == sorted((i for i, _ in bare), key=repr)
    assert got["near_dedup"] == [1, 2, 2, 3, 4, 6, 7]
    texts = {r.doc_id: r.text for r in seen["pii"].collect()}
    assert len(got["pii"]) == len(bare) and "10.2.3.4" not in texts[6] and {i: t for i, t in texts.items() if i != 6} == {i: t for i, t in bare if i != 6}
    assert all(tuple(r)[5:] == tuple(range(8)) for n in run if n != "packing" for r in seen[n].collect())
    assert set(got["packing"]) == {i for i, _ in bare}
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf)
        assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)
