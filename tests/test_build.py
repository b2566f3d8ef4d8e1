from pyspark.sql import functions as F

from millrace.operators import build, selection
from millrace.sources import token_shards

GRAM = "a b c d e f g h i j k l m"


def ids(text):
    """One id a word, after a mark."""
    return F.concat(F.array(F.lit(0)), F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != ""), lambda w: F.length(w)))


def setup(spark, tmp_path, n=6):
    rows = []
    for k in range(n):
        path = str(tmp_path / f"in/{k:02d}.parquet")
        docs = [(f"w{j} x y", f"T{j}", 3 + j % 3) for j in range(9)] + [(GRAM, "t", 5), ("kept text here", "Known", 5), ("", "e", 5), (None, "n", 5)]
        spark.createDataFrame(docs, "text string, title string, int_score int").coalesce(1).write.parquet(path)
        rows.append(("wiki", "file:" + path, k, "val" if k == n - 1 else "train"))
    listed = spark.createDataFrame(rows, "source string, file string, file_idx int, split string")
    source = selection.Source("wiki", "", min_int_score=4, title_col="title")
    files = []
    for r in listed.collect():
        name = spark.read.parquet(r.file).select("_metadata.file_path").first()[0]
        files.append((r.source, name, r.file_idx, r.split))
    how = build.Build(str(tmp_path / "out"), ids, "v1", spark.createDataFrame([(GRAM,)], "gram string"), spark.createDataFrame([("known",)], "title string"), shard_tokens=10, val_shard_tokens=8, val_tokens=12)
    return source, spark.createDataFrame(files, "source string, file string, file_idx int, split string"), how


def test_rounds_budgets_and_drops(spark, tmp_path):
    source, files, how = setup(spark, tmp_path)
    assert build.tokenize_all(spark, [source], files, {"wiki": 60}, how) == []
    done = {(r.split, r.file_idx): r for r in build.results(spark, how).collect()}
    first = done["train", 0]
    assert (first.n_tokens, first.n_docs, first.exhausted) == (24, 6, True)  # scores 4 and 5 only, four tokens each
    assert (first.n_docs_dropped_title, first.n_docs_dropped_ngram) == (1, 1)
    assert [(s.part, s.n_tokens, s.n_docs) for s in first.shards] == [(0, 12, 3), (1, 12, 3)]
    assert first.shards[1].n_docs_dropped_title + first.shards[1].n_docs_dropped_ngram == 2
    assert done["val", 5].n_tokens == 12 and not done["val", 5].exhausted
    assert sum(r.n_tokens for k, r in done.items() if k[0] == "train") >= 60
    n = build.results(spark, how).count()
    assert build.tokenize_all(spark, [source], files, {"wiki": 60}, how) == [] and build.results(spark, how).count() == n
    entries = build.manifest(spark, how).orderBy("source", "split", "ord").collect()
    assert [e.ord for e in entries if e.split == "train"] == list(range(sum(len(r.shards) for k, r in done.items() if k[0] == "train")))
    token_shards.register(spark)
    build.shard_tokens(spark, how).write.format("token_shards").mode("append").save(str(tmp_path / "shards"))
    sizes = {r.path.rpartition("/")[2]: len(r.tokens) for r in token_shards.read(spark, str(tmp_path / "shards")).collect()}
    assert sizes == {e.path: e.n_tokens for e in entries}


def test_short_sources_are_named(spark, tmp_path):
    source, files, how = setup(spark, tmp_path, 3)
    assert build.tokenize_all(spark, [source], files, {"wiki": 1000}, how) == ["wiki"]
    assert build.results(spark, how).where("split = 'train'").count() == 2
