"""The shard reader and the stream of training batches."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import mixture
from millrace.sources import token_shards
from millrace.streaming import loader

WIDTH = 8


@pytest.fixture()
def shards(spark, tmp_path):
    """Three sources of three shards, an empty shard, and a file that is none; and their entries."""
    rows = []
    for s, base in (("a", 0), ("b", 1000), ("c", 2000)):
        for k in range(3):
            n = 0 if (s, k) == ("b", 1) else 100 + 7 * k
            (tmp_path / f"{s}_{k}.bin").write_bytes(token_shards.pack(np.arange(n) + base + 300 * k))
            rows.append((s, k, f"{s}_{k}.bin", n))
    (tmp_path / "note.txt").write_text("x")
    return str(tmp_path), spark.createDataFrame(rows, "source string, ord int, path string, n_tokens long").withColumn("place", F.col("ord"))


def load(spark, path, **options):
    token_shards.register(spark)
    return spark.read.format("token_shard_runs").options(**options).load(path)


def plain(df):
    return sorted((os.path.basename(r.path), r.start, tuple(r.tokens)) for r in df.collect())


def test_reader_gives_what_binary_files_give(spark, shards):
    folder, _ = shards
    want = [r for r in plain(token_shards.read(spark, folder + "/*.bin", 16)) if r[2]]
    for each in (1, 40, 10**6):
        assert plain(load(spark, folder, rows=16, partition=each)) == want
    assert plain(load(spark, f"{folder}/a_2.bin", rows=16)) == [r for r in want if r[0] == "a_2.bin"]
    assert load(spark, folder, rows=16, partition=16).rdd.getNumPartitions() > 8


def test_filters_open_only_what_they_ask_for(spark, tmp_path):
    """A shard of 3 GB that has no bytes on disk: one run of it is opened, others are never read."""
    n = 1_600_000_000
    path = str(tmp_path / "huge.bin")
    with open(path, "wb") as f:
        f.write(token_shards.head(n))
        f.truncate(4 * token_shards.HEADER + 2 * n)
        f.seek(4 * token_shards.HEADER + 2 * (1 << 30))
        f.write(np.arange(5, dtype="<u2").tobytes())
    reader = token_shards._Reader({"path": path})
    assert list(reader.pushFilters([token_shards.GreaterThanOrEqual(("start",), 1 << 30), token_shards.LessThan(("start",), (1 << 30) + 1), token_shards.EqualTo(("tokens",), 1)])) == [token_shards.EqualTo(("tokens",), 1)]
    (part,) = reader.partitions()
    assert (part.first, part.last) == (1 << 30, (1 << 30) + token_shards.RUN)
    (batch,) = reader.read(part)
    assert batch.column("tokens")[0].as_py()[:5] == [0, 1, 2, 3, 4]
    got = load(spark, path).where(f"start >= {1 << 30} AND start < {(1 << 30) + 1}").select("start", F.slice("tokens", 1, 5).alias("t"), F.size("tokens").alias("n")).collect()
    assert [(r.start, r.t, r.n) for r in got] == [(1 << 30, [0, 1, 2, 3, 4], token_shards.RUN)]


@pytest.mark.parametrize("data", [b"", b"x" * 2000, token_shards.pack(np.arange(9))[:-1], token_shards.pack(np.arange(9)) + b"zz"])
def test_broken_shards_are_errors(spark, tmp_path, data):
    (tmp_path / "bad.bin").write_bytes(data)
    with pytest.raises(ValueError, match="header"):
        token_shards._Reader({"path": str(tmp_path)}).partitions()


def test_sink_lists_its_shards_last(spark, tmp_path):
    token_shards.register(spark)
    rows = [(f"s{k}", 20, list(range(k, k + 20))) for k in range(3)]
    spark.createDataFrame(rows, "name string, n_tokens long, tokens array<int>").write.format("token_shards").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out/_SUCCESS.txt").read_text().split() == ["s0.bin", "s1.bin", "s2.bin"]
    assert plain(load(spark, str(tmp_path / "out"))) == [(f"{n}.bin", 0, tuple(t)) for n, _, t in rows]


def planned(spark, shards, tmp_path, rows=5):
    folder, entries = shards
    mix = spark.createDataFrame([("one", "a", 2.0), ("one", "b", 1.0), ("two", "b", 1.0), ("two", "c", 3.0)], "mix_name string, source string, weight double")
    scheduled = mixture.schedule(mixture.allocate(mix, rows), mixture.step_plan(spark, [("one", 4), ("two", 3)]))
    loader.write_plan(mixture.numbered(entries, WIDTH), scheduled, WIDTH, str(tmp_path / "plan"))
    loader.register(spark)
    return folder, entries, scheduled, str(tmp_path / "plan")


def stream(spark, plan, folder, out, mark, **options):
    rows = spark.readStream.format("training_batches").options(plan=plan, shards=folder, **options).load()
    rows.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
    return sorted((tuple(map(str, r)) for r in spark.read.parquet(out).collect()))


def test_a_broken_run_goes_on_as_if_whole(spark, shards, tmp_path):
    folder, entries, scheduled, plan = planned(spark, shards, tmp_path)
    whole = stream(spark, plan, folder, str(tmp_path / "o1"), str(tmp_path / "m1"), stepsPerPartition=2)
    part = stream(spark, plan, folder, str(tmp_path / "o2"), str(tmp_path / "m2"), until=3)
    assert 0 < len(part) < len(whole)
    assert stream(spark, plan, folder, str(tmp_path / "o2"), str(tmp_path / "m2"), until=3) == part  # nothing is new
    assert stream(spark, plan, folder, str(tmp_path / "o2"), str(tmp_path / "m2")) == whole
    # The same rows as the static batches, and the same tokens as their gathered runs.
    rows = mixture.batches(entries, scheduled, WIDTH, 0, 7)
    runs = token_shards.read(spark, folder + "/*.bin", 16).withColumn("path", F.substring_index("path", "/", -1)).where(F.size("tokens") > 0)
    got = mixture.gather(rows, runs, WIDTH, 16).join(rows.select("step", "row", "source"), ["step", "row"])
    assert sorted((tuple(map(str, r)) for r in got.select("step", "row", "source", "path", "start", "x", "y").collect())) == whole


def test_another_plan_is_an_error(spark, shards, tmp_path):
    folder, _, _, plan = planned(spark, shards, tmp_path)
    stream(spark, plan, folder, str(tmp_path / "o"), str(tmp_path / "m"), until=2)
    planned(spark, shards, tmp_path, 7)
    with pytest.raises(Exception, match="does not agree"):
        stream(spark, plan, folder, str(tmp_path / "o"), str(tmp_path / "m"))


def test_a_source_that_runs_out_is_an_error(spark, shards, tmp_path):
    folder, _, _, plan = planned(spark, shards, tmp_path, 60)
    with pytest.raises(Exception, match="exhausted"):
        stream(spark, plan, folder, str(tmp_path / "o"), str(tmp_path / "m"))
