import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import layout, mixture, selection
from millrace.sources import tables, token_shards


def test_selection(spark):
    df = spark.createDataFrame([("a", 3), ("b", 4), ("c", 5), ("", 5), ("e", 2), (None, 5), (" ", None)], "text string, int_score int")
    assert [r.text for r in selection.select_docs(df, 4).collect()] == ["b", "c"]
    assert [r.text for r in selection.select_docs(df).collect()] == ["a", "b", "c", "e", " "]


def test_split_files(spark):
    files = spark.createDataFrame([("s", f"sample/{i:03d}.parquet") for i in range(140)], "source string, path string")
    out = {r.path: r.split for r in selection.split_files(files, 60).collect()}
    assert out["sample/139.parquet"] == "val" and sum(v == "hq" for v in out.values()) == 60 and sum(v == "train" for v in out.values()) == 79
    with pytest.raises(Exception, match="too few files"):
        selection.split_files(files.limit(5), 60).collect()


def test_glob(spark):
    listing = spark.createDataFrame([("a/b/c.parquet",), ("a/B.parquet",), ("a/b.json",), ("x.a.parquet",)], "path string")
    assert [r.path for r in selection.list_files(listing, "a/*.parquet").collect()] == ["a/B.parquet", "a/b/c.parquet"]


def test_budget(spark):
    df = spark.createDataFrame([("f", i, 10, 5, i == 1) for i in range(6)], "file string, i int, n_tokens long, n_bytes long, dropped boolean")
    cut = lambda **k: [r.i for r in selection.cut_budget(df, k, ["file"], ["i"], ~F.col("dropped")).orderBy("i").collect()]
    assert cut(n_tokens=20) == [0, 1, 2]
    assert cut(n_tokens=21) == [0, 1, 2, 3]
    assert cut(n_tokens=1000, n_bytes=1) == [0]


def test_packing_closes_at_the_limit(spark):
    df = spark.createDataFrame([("f", i, n) for i, n in enumerate([4, 4, 5, 1, 9])], "file string, i int, n_tokens long")
    assert [r.part for r in layout.pack_shards(df, 8, ["file"], "i").orderBy("i").collect()] == [0, 0, 1, 1, 1]
    packed = layout.pack_shards(df, 8, ["file"], "i").withColumn("n_bytes", F.lit(1))
    drops = spark.createDataFrame([("f", 0, "title"), ("f", 7, "ngram")], "file string, part int, reason string")
    got = {r.part: (r.n_tokens, r.n_docs_dropped_title, r.n_docs_dropped_ngram) for r in layout.shard_totals(packed, ["file"], dropped=drops).collect()}
    assert got == {0: (8, 1, 0), 1: (15, 0, 1)}


def test_planner(spark):
    targets = spark.createDataFrame([("new", 100, 9), ("part", 1000, 10), ("short", 1000, 2), ("done", 50, 5)], "source string, target long, n_files long")
    results = spark.createDataFrame([("part", 100, True), ("part", 40, False), ("short", 10, True), ("short", 10, True), ("done", 60, False)], "source string, n_tokens long, exhausted boolean")
    got = {r.source: (r.n_jobs, r.budget) for r in layout.plan_jobs(targets, results).collect()}
    assert got == {"new": (1, 100), "part": (8, math.ceil(860 / 8))}
    plan = spark.createDataFrame([("a", "train", 0, 5), ("a", "train", 1, 5)], "source string, split string, file_idx int, budget long")
    done = spark.createDataFrame([("a", "train", 0, 5, "v1"), ("a", "train", 1, 5, "v0")], "source string, split string, file_idx int, budget long, filter string")
    assert [r.file_idx for r in layout.undone(plan, done, "v1").collect()] == [1]


def test_val_quota(spark):
    entries = spark.createDataFrame([(s, i, 37) for s in "ab" for i in range(3)], "source string, ord int, n_tokens long")
    mix = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    count = lambda most: sorted(r.source for r in layout.val_shards(entries, mix, most).collect())
    assert count(1) == ["a", "b"] and count(60) == ["a", "a", "b"] and len(count(None)) == 6


def test_allocation_needs_doubles(spark):
    """A published mix whose remainders are nearly tied, so that the order of operations decides."""
    mix = [("mild_wiki", s, w) for s, w in {"fwedu_hq": 0.40, "finemath": 0.20, "fwedu": 0.20, "dclm": 0.15, "wiki": 0.05}.items()]
    got = {r.source: r.rows_per_step for r in mixture.allocate(spark.createDataFrame(mix, "mix_name string, source string, weight double"), 64).collect()}
    assert got == {"fwedu_hq": 26, "finemath": 13, "fwedu": 13, "dclm": 9, "wiki": 3}
    bad = spark.createDataFrame([("m", "a", -1.0), ("m", "b", 2.0)], "mix_name string, source string, weight double")
    with pytest.raises(Exception, match="weights"):
        mixture.allocate(bad, 8).collect()


def test_batches_replay_from_any_step(spark):
    entries = spark.createDataFrame([(s, f"{s}{i}", i, 100) for s in "abc" for i in range(3)], "source string, path string, place int, n_tokens long")
    mix = spark.createDataFrame([("m", "a", 2.0), ("m", "b", 1.0), ("n", "a", 1.0), ("n", "c", 2.0)], "mix_name string, source string, weight double")
    scheduled = mixture.schedule(mixture.allocate(mix, 3), mixture.step_plan(spark, [("m", 5), ("n", 4)]))
    whole = [tuple(r) for r in mixture.batches(entries, scheduled, 8, 0, 9).orderBy("step", "row").collect()]
    again = [tuple(r) for k in range(9) for r in mixture.batches(entries, scheduled, 8, k, 1).orderBy("row").collect()]
    assert whole == again and len(whole) == 27
    cursor, want = {s: 0 for s in "abc"}, []
    order = {s: [(f"{s}{i}", k * 8) for i in range(3) for k in range(12)] for s in "abc"}
    for step in range(9):
        rows = [s for s, n in (("a", 2), ("b", 1)) for _ in range(n)] if step < 5 else [s for s, n in (("a", 1), ("c", 2)) for _ in range(n)]
        for row, s in enumerate(rows):
            want.append((step, row, s, *order[s][cursor[s]]))
            cursor[s] += 1
    assert whole == want
    read = {r.source: r.rows_consumed for r in mixture.rows_consumed(entries, mixture.cursors_at(entries, scheduled, 8, 9), 8).collect()}
    assert read == cursor


def test_supply_is_exact(spark):
    entries = spark.createDataFrame([("a", "a0", 0, 81)], "source string, path string, place int, n_tokens long")
    mix = spark.createDataFrame([("m", "a", 1.0)], "mix_name string, source string, weight double")
    enough = lambda steps: mixture.supply(entries, mixture.schedule(mixture.allocate(mix, 2), mixture.step_plan(spark, [("m", steps)])), 8).first().enough
    assert enough(5) and not enough(6)


def test_orders_and_pins(spark):
    entries = spark.createDataFrame([("a", f"p{i}", i) for i in range(9)], "source string, path string, ord int")
    order = lambda seed, split="train": [r.path for r in mixture.shard_order(entries, seed, split).orderBy("place").collect()]
    assert sorted(order(1)) == sorted(order(2)) and order(1) != order(2) and order(1, "val") == [f"p{i}" for i in range(9)]
    import zlib

    import numpy as np

    want = [f"p{i}" for i in np.random.default_rng([5, zlib.crc32(b"a")]).permutation(9)]
    assert [r.path for r in mixture.numpy_shard_order(entries, 5).orderBy("place").collect()] == want
    lists = spark.createDataFrame([("a", ["x"]), ("b", ["y"])], "source string, shards array<string>")
    pins = spark.createDataFrame([("b", ["z"]), ("c", ["w"])], "source string, shards array<string>")
    assert {r.source: r.shards for r in mixture.pinned_order(lists, pins).collect()} == {"a": ["x"], "b": ["z"], "c": ["w"]}
    assert [r.source for r in mixture.reconcile(spark.createDataFrame([("a", 1), ("b", 2)], "source string, n int"), spark.createDataFrame([("a", 1), ("b", 3)], "source string, n int")).collect()] == ["b"]


def test_token_shards_round_trip(spark, tmp_path):
    import numpy as np

    for n in (0, 1, 1000):
        t = np.arange(n) % 500
        assert (token_shards.unpack(token_shards.pack(t)) == t).all()
    for bad in (b"", token_shards.pack(np.arange(5))[:-1], b"\0" * 2000):
        with pytest.raises(ValueError):
            token_shards.unpack(bad)
    for ids, vocab in (([-1], None), ([65535], None), ([256], 256)):
        with pytest.raises(ValueError):
            token_shards.pack(np.array(ids), vocab)
    token_shards.register(spark)
    df = spark.createDataFrame([("one", [1, 2, 3]), ("two", list(range(70000)))], "name string, tokens array<int>").withColumn("tokens", F.transform("tokens", lambda x: x % 60000))
    # One shard comes in one row, the other in two.
    halves = F.explode(F.when(F.col("name") == "one", F.array("tokens")).otherwise(F.array(F.slice("tokens", 1, 40000), F.slice("tokens", 40001, 40000))))
    df = df.select("name", F.size("tokens").cast("long").alias("n_tokens"), halves.alias("tokens")).coalesce(1)
    df.write.format("token_shards").mode("append").save(str(tmp_path / "s"))
    back = token_shards.read(spark, str(tmp_path / "s")).orderBy("path", "start").collect()
    assert [len(r.tokens) for r in back] == [3, 65536, 70000 - 65536] and back[0].tokens == [1, 2, 3]
    assert not [p for p in (tmp_path / "s").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    assert tables.file_digests(spark, str(tmp_path / "s")).count() == 2


def test_shard_sink_refuses_short_and_scattered_shards(spark, tmp_path):
    token_shards.register(spark)
    for rows in ([("a", 3, [1, 2])], [("a", 1, [1]), ("b", 1, [1]), ("a", 1, [1])]):
        with pytest.raises(Exception, match="lacks|in a row"):
            spark.createDataFrame(rows, "name string, n_tokens long, tokens array<int>").coalesce(1).write.format("token_shards").mode("append").save(str(tmp_path / "bad"))


def test_manifest_round_trip(spark, tmp_path):
    rows = [("a", "train", 0, "/m/x.bin", 5, 9, 1), ("a", "train", 1, "/other/y.bin", 6, 9, 2), ("a", "val", 0, "/m/z.bin", 7, 9, 3), ("b", "train", 0, "/m/sub/w.bin", 8, 9, 4)]
    entries = spark.createDataFrame(rows, "source string, split string, ord int, path string, n_tokens long, n_bytes long, n_docs long")
    tables.write_manifest(entries, str(tmp_path / "m"), "/m")
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "m")).collect())
    assert '"sub/w.bin"' in text and "/m/" not in text
    back = tables.read_manifest(spark, str(tmp_path / "m"), "/m")
    assert sorted(tuple(r)[:7] for r in back.collect()) == sorted(rows)
    moved = tables.read_manifest(spark, str(tmp_path / "m"), "/new")
    assert {r.path for r in moved.collect()} == {"/new/x.bin", "/other/y.bin", "/new/z.bin", "/new/sub/w.bin"}
    spark.createDataFrame([("not json",)], "value string").coalesce(1).write.text(str(tmp_path / "bad"))
    with pytest.raises(Exception):
        tables.read_manifest(spark, str(tmp_path / "bad"), "/m").collect()


def test_records_are_written_whole(spark, tmp_path):
    for n in (1, 2):
        tables.write_record(spark, {"run": "r", "n": n}, str(tmp_path / "r"))
    assert [tuple(r) for r in tables.read_json(spark, str(tmp_path / "r"), "run string, n int").collect()] == [("r", 2)]


def test_batches_refuse_to_run_short(spark):
    entries = spark.createDataFrame([("a", "p", 0, 33)], "source string, path string, place int, n_tokens long")

    def scheduled(mix):
        weights = spark.createDataFrame([("m", s, 1.0) for s in mix], "mix_name string, source string, weight double")
        return mixture.schedule(mixture.allocate(weights, 2), mixture.step_plan(spark, [("m", 2 + len(mix))]))

    assert mixture.batches(entries, scheduled("a"), 8, 0, 2).count() == 4
    with pytest.raises(Exception, match="exhausted"):
        mixture.batches(entries, scheduled("a"), 8, 0, 3).collect()
    with pytest.raises(Exception, match="no shards"):
        mixture.batches(entries, scheduled("ab"), 8, 0, 1).collect()


def test_gathered_tokens(spark, tmp_path):
    """x and y of batches from written shards, rows that straddle runs included."""
    import numpy as np

    shards = {"p": np.arange(100) % 97, "q": np.arange(50) + 200}
    for name, t in shards.items():
        (tmp_path / f"{name}.bin").write_bytes(token_shards.pack(t))
    runs = token_shards.read(spark, str(tmp_path), rows=16).withColumn("path", F.regexp_extract("path", r"([a-z])\.bin$", 1))
    rows = spark.createDataFrame([(0, 0, "p", 0), (0, 1, "p", 10), (1, 0, "p", 92), (1, 1, "q", 30)], "step int, row int, path string, start long")
    got = mixture.gather(rows, runs, 7, 16).collect()
    assert len(got) == 4
    for r in got:
        want = shards[r.path][r.start : r.start + 8].tolist()
        assert (r.x, r.y) == (want[:-1], want[1:])
    with pytest.raises(Exception, match="ends within"):
        mixture.gather(rows.where("start = 92"), runs, 8, 16).collect()


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": {"train": [{"path": "x.bin", "n_tokens": 5}, {"path": "/abs/y.bin", "n_tokens": 6}]}}')
    rows = tables.read_manifest(spark, str(tmp_path / "m.json"), "/root/m").orderBy("ord").collect()
    assert [(r.source, r.split, r.path, r.n_tokens) for r in rows] == [("a", "train", "/root/m/x.bin", 5), ("a", "train", "/abs/y.bin", 6)]
    assert tables.read_json(spark, str(tmp_path / "none"), "a int").count() == 0
