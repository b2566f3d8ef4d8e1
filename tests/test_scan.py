"""Running sums and folds over groups that lie in many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import layout, scan, selection, windows


@pytest.fixture(params=[1, 23])
def parts(spark, request):
    """Ranges that rows are dealt to."""
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(seed):
    """One group with most rows, small ones, and one of a null key."""
    rnd = random.Random(seed)
    rows = [("big", i, rnd.choice([0, 1, 2, 7, 30, 300])) for i in range(900)] + [(f"g{k}", i, rnd.randrange(40)) for k in range(5) for i in range(k)]
    rows += [(None, i, 11) for i in range(30)] + [("big", 900, None), ("ones", 0, 1)]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(g, i, n, "x") for g, i, n in rows], "g string, i long, n long, _block string").repartition(5)


def grouped(rows):
    out = {}
    for g, i, n in sorted(rows, key=lambda r: r[1]):
        out.setdefault(g, []).append((i, n or 0))
    return out


def test_prefix_sums(spark, parts):
    rows = rows_of(parts)
    out = scan.prefix_sums(frame(spark, rows), {"s": "n", "k": F.lit(1)}, ["g"], ["i"])
    assert out.columns == ["g", "i", "n", "_block", "s", "k"]
    want = {(g, i): (sum(n for _, n in own[:k]), k) for g, own in grouped(rows).items() for k, (i, _) in enumerate(own)}
    assert {(r.g, r.i): (r.s, r.k) for r in out.collect()} == want
    assert scan.prefix_sums(frame(spark, rows).limit(0), {"s": "n"}, ["g"], ["i"]).count() == 0


@pytest.mark.parametrize("limit", [1, 29, 400, 10**9])
def test_fold(spark, parts, limit):
    """Limits of less than a row, of some rows, of several blocks and of everything; rows of size 0 and null."""
    rows, want = rows_of(limit), {}
    for g, own in grouped(rows).items():
        part = held = 0
        for i, n in own:
            want[g, i], held = part, held + n
            if held >= limit:
                part, held = part + 1, 0
    out = scan.fold(frame(spark, rows), "n", limit, ["g"], ["i"])
    assert out.columns == ["g", "i", "n", "_block", "part"]
    assert {(r.g, r.i): r.part for r in out.collect()} == want
    assert scan.fold(frame(spark, rows).limit(0), "n", limit, ["g"], ["i"]).count() == 0


def test_one_group_lies_in_many_tasks(spark, parts):
    """No range holds much more than its share of a group, and budgets and shards of it are whole."""
    docs = spark.range(20_000).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), (F.col("id") % 13 + 1).alias("n_tokens"))
    rows, block = scan.blocks(docs, ["source"], ["doc_id"])
    assert rows.groupBy(block).count().agg(F.max("count")).first()[0] <= 3 * 20_000 / parts
    assert selection.cut_budget(docs, {"n_tokens": 70_000}, ["source"], ["doc_id"]).count() == next(k for k in range(1, 20_000) if sum(i % 13 + 1 for i in range(k)) >= 70_000)
    packed = layout.pack_shards(docs, 1000, ["source"], "doc_id")
    totals = {r.part: r.s for r in packed.groupBy("part").agg(F.sum("n_tokens").alias("s")).collect()}
    assert sorted(totals) == list(range(len(totals))) and all(1000 <= s < 1013 for p, s in totals.items() if p < len(totals) - 1)
    assert sum(totals.values()) == sum(i % 13 + 1 for i in range(20_000))


def test_a_limit_must_be_positive(spark):
    with pytest.raises(ValueError):
        scan.fold(spark.range(3), "id", 0, [], ["id"])


def test_ranks_of_ties_and_nulls(spark, parts):
    rnd = random.Random(parts)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, 1.5, 2.5, rnd.random()]), k) for k in range(600)]
    got = {r.k: r.before for r in scan.ranks(spark.createDataFrame(rows, "g string, v double, k int"), ["g"], "v").collect()}
    low = lambda v: -1.0 if v is None else v
    assert got == {k: sum(g2 == g and low(v2) < low(v) for g2, v2, _ in rows) for g, v, k in rows}


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
@pytest.mark.parametrize("share", [0.0, 0.5, 0.99, 1.0])
def test_order_statistics(spark, accuracy, share):
    """Groups below and above the accuracy, ties, nulls, a null key, values of all sizes, the same ones only."""
    rnd = random.Random(9)
    rows = [("big", rnd.choice([rnd.random(), 0.25, 10 ** rnd.uniform(-300, 300), -(10 ** rnd.uniform(-9, 9))])) for _ in range(3000)]
    rows += [("same", 4.0)] * 500 + [("one", 1.0), (None, 2.0), (None, 3.0), ("big", None), ("nulls", None)]
    rnd.shuffle(rows)
    out = scan.kth(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", share, {"x": lambda n: F.floor(F.lit(share) * (n - 1)), "y": lambda n: F.ceil(F.lit(share) * (n - 1))}, accuracy)
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v) if v is not None else None
    own = {g: sorted(v) for g, v in groups.items()}
    assert {r.g: (r.n, r.x, r.y) for r in out.collect()} == {g: (len(v), v[int(share * (len(v) - 1))], v[-int(-share * (len(v) - 1) // 1)]) for g, v in own.items()}


def test_ema_over_blocks(spark, parts):
    rnd = random.Random(parts)
    rows = [("a", i, rnd.random()) for i in range(700)] + [("b", 0, 5.0), (None, 0, 1.0), (None, 1, 3.0)]
    got = {(r.g, r.i): r.ema for r in scan.ema(spark.createDataFrame(rows, "g string, i long, v double"), "v", 0.98, ["g"], ["i"]).collect()}
    for g in ("a", "b", None):
        at = None
        for _, i, v in sorted(r for r in rows if r[0] == g):
            at = v if at is None else 0.98 * at + 0.02 * v
            assert got[g, i] == pytest.approx(at, rel=1e-12)


@pytest.mark.parametrize("most", [None, 0, 30, 10**6])
def test_documents_over_runs(spark, parts, most):
    """Streams that begin with and without a mark, documents of none to many runs, an empty stream, against whole lists."""
    rnd = random.Random(parts)
    streams = {"a": [rnd.choice([0] + [5] * 40) for _ in range(900)], "b": [7, 7, 0] + [1] * 200 + [0, 0, 2], "c": [0] * 5, "d": [3] * 50, None: [0, 4]}
    runs = spark.createDataFrame([(k, s, t[s : s + 16]) for k, t in streams.items() for s in range(0, len(t), 16)] + [("e", 0, [])], "path string, start long, tokens array<int>").repartition(4)
    got = {(r.path, r.doc): (r.start, r.tokens) for r in windows.split_runs(runs, 0, ["path"], most=most).collect()}
    want = {}
    for k, t in streams.items():
        at = [i for i, x in enumerate(t) if x == 0]
        for doc, (a, b) in enumerate(zip(at, [*at[1:], len(t)], strict=False)):
            if most is None or a < most:
                want[k, doc] = (a, t[a + 1 : b])
    assert got == want
