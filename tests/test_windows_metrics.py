import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import metrics, windows


def test_spans_score_each_target_once(spark):
    """Random lengths, windows and strides, and texts too short for one target."""
    rng = random.Random(8)
    for n, ctx in [(0, 6), (1, 6), (2, 6), *((rng.randrange(3, 90), rng.randrange(2, 20)) for _ in range(7))]:
        stride = rng.randrange(1, ctx)
        rows = windows.scoring_spans(spark.createDataFrame([(n,)], "n_tokens long"), ctx, stride).orderBy("begin").collect()
        assert [t for r in rows for t in range(r["first"], r.end)] == list(range(1, n))
        assert all(r.end - r.begin <= ctx and r["first"] > r.begin for r in rows)


def test_spans_refuse_bad_strides(spark):
    with pytest.raises(ValueError):
        windows.scoring_spans(spark.range(1), 8, 8)


def test_val_windows(spark):
    df = spark.createDataFrame([("a", 0, list(range(10, 20))), ("b", 0, [1]), ("c", 0, []), ("a", 1, [7, 8, 9])], "s string, k int, tokens array<int>")
    rows = windows.val_windows(df.where("k = 0"), 4).orderBy("start").collect()
    assert [(r.start, r.x, r.y) for r in rows] == [(0, [10, 11, 12, 13], [11, 12, 13, 14]), (4, [14, 15, 16, 17], [15, 16, 17, 18]), (8, [18, 2, 2, 2], [19, -100, -100, -100])]
    # Three windows of one shard and one of the next fill two batches; without the latter the last is filled up.
    batches = lambda of: windows.val_batches(windows.val_windows(of, 4), ["s"], ["k"], 2, 4).orderBy("batch", "row").collect()
    both = batches(df)
    assert [(r.batch, r.row) for r in both] == [(0, 0), (0, 1), (1, 0), (1, 1)] and both[-1].x == [7, 8, 2, 2]
    assert len(batches(df.where("k = 0"))) == 4 and set(batches(df.where("k = 0"))[-1].y) == {-100}


def test_pages(spark):
    lines = [" \n", " = One = \n", " text a \n", "", " = = Sub = = \n", " = Two = \n", " b \n"]
    out = windows.pages(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "f string, i int, line string"), ["f"], "i").orderBy("page").collect()
    assert [r.text for r in out] == [" = One = \n text a \n \n = = Sub = = ", " = Two = \n b "]


def test_split_on_marks(spark):
    get = lambda t, most: spark.createDataFrame([(t,)], "t array<int>").select(windows.split_on(F.col("t"), 0, most)).first()[0]
    assert get([7, 0, 1, 2, 0, 3, 0, 4], 100) == [[1, 2], [3], [4]]
    assert get([0, 1, 2, 0, 3, 0, 4], 3) == [[1, 2]]
    assert get([0, 1, 2, 0, 3, 0, 4], 4) == [[1, 2], [3]]
    assert get([], 5) == [] and get([1, 2], 5) == [] and get([0, 0], 5) == [[], []]


def test_captions(spark):
    get = lambda t: spark.createDataFrame([(t,)], "t string").select(windows.caption_chunks(F.col("t"), 7)).first()[0]
    assert get("aa bb ccc dddddddddd e") == ["aa bb", "ccc", "dddddddddd", "e"] and get("") == []


def test_log(spark):
    lines = ['{"step": 1, "loss": 3.0}', "", '{"step": 2, "loss": 2.5, "val_bpb": 1.1}', '{"step": 1, "loss": 9.0}']
    log = metrics.parse_log(spark.createDataFrame(list(enumerate(lines)), "ord int, line string"))
    assert {(r.step, r.loss, r.val_bpb) for r in log.collect()} == {(1, 9.0, None), (2, 2.5, 1.1)}
    assert metrics.truncate_log(log, 1).count() == 1
    smooth = metrics.ema(spark.createDataFrame([("r", 2, 2.0), ("r", 1, 1.0)], "run string, step int, loss double"), "run", "step", "loss").orderBy("step").collect()
    assert [r.ema for r in smooth] == [1.0, pytest.approx(1.02)]


def test_param_counts(spark):
    """Published configurations and the totals that must come out."""
    schema = "name string, vocab int, d_model int, n_unique_blocks int, repeats int, n_head int, n_kv_head int, mlp_hidden int, xsa boolean, value_residual boolean"
    plain = ("A", 32768, 512, 14, 1, 8, 4, 1536, False, False)
    configs = [plain, ("alt1", 32768, 576, 8, 2, 9, 3, 2304, False, False), ("alt2", 16384, *plain[2:]), ("A_xsa", *plain[1:8], True, False), ("A_vres", *plain[1:8], False, True), ("alt2_vres", 16384, *plain[2:8], False, True)]
    got = {r.name: (r.once, r.twice) for r in metrics.param_counts(spark.createDataFrame(configs, schema)).collect()}
    assert got["A"][0] == 49_822_215 and got["alt1"][0] == 47_195_720 and got["alt2"] == (41_433_607, 49_822_215)
    assert got["A_xsa"][0] == 49_822_327 and got["A_vres"][0] == 49_822_228 and got["alt2_vres"] == (41_433_620, 49_822_228)


def test_lr_ends_at_zero(spark):
    steps = spark.range(400).withColumnRenamed("id", "step")
    rate = lambda up, down: [r[0] for r in steps.select(metrics.rate_factor(F.col("step"), F.lit(400), F.lit(up), F.lit(down))).collect()]
    both = rate(0.05, 0.35)
    assert both[-1] == 0 and both[0] == pytest.approx(1 / 20) and max(both) == 1 and rate(0.1, 0.0)[-1] == 1
    assert rate(0.0, 0.5)[0] == 1 and max(rate(0.8, 0.6)) < 1


def test_uniform_model_bits(spark):
    import math

    scored = spark.createDataFrame([("s", math.log(256), 10, 10), ("s", math.log(256), 30, 30)], "s string, mean_loss double, n long, n_bytes long")
    assert metrics.bits_per_byte(scored, ["s"]).first().bpb == pytest.approx(8.0)


def test_errors_and_runs(spark):
    df = spark.createDataFrame([("ValueError", "x"), ("RuntimeError", "data exhausted"), ("RuntimeError", "cuda"), ("OSError", None)], "k string, m string")
    assert [r[0] for r in df.select(metrics.error_class(F.col("k"), F.col("m"))).collect()] == [True, True, False, False]
    runs = spark.createDataFrame([("sweep_A",), ("sweep_B",), ("main",)], "run string")
    assert metrics.select_runs(runs, "sweep").count() == 2 and metrics.select_runs(runs, "main,sweep_A").count() == 2
    with pytest.raises(ValueError):
        metrics.select_runs(runs, "main,nope")


def test_ties_stay_in_top_k(spark):
    df = spark.createDataFrame([(0, t, x, 0.999) for t, x in enumerate([5.0, 4.0, 4.0, 1.0])], "g int, token int, logit double, u double")
    assert metrics.top_k_sample(df, ["g"], 2, 1.0).first().token == 2
    assert metrics.top_k_sample(df, ["g"], 2, 0).first().token == 0


def test_rate_factor_is_a_trapezoid(spark):
    df = spark.range(100).withColumnRenamed("id", "step")
    get = lambda up, down: [r[0] for r in df.orderBy("step").select(metrics.rate_factor(F.col("step"), F.lit(100), F.lit(up), F.lit(down))).collect()]
    both = get(0.1, 0.3)
    assert both[:10] == [pytest.approx((i + 1) / 10) for i in range(10)] and set(both[10:71]) == {1.0} and both[-1] == 0.0 and both[71] == pytest.approx(28 / 29)
    assert set(get(0.0, 0.0)) == {1.0} and get(0.0, 0.01)[-2:] == [1.0, 0.0]


def test_deltas_need_one_baseline(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "run string, x double")
    assert sorted(tuple(r) for r in metrics.deltas(rows, "run", "a", ["x"]).collect()) == [("a", 0.0), ("b", 2.0)]
    with pytest.raises(Exception, match="one row"):
        metrics.deltas(rows, "run", "c", ["x"]).collect()
