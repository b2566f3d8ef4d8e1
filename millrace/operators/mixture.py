"""Weighted multi-source batches as a table that can be replayed from any position.

A training row is ``width + 1`` tokens of a shard at a multiple of ``width``; a source's rows in shard order
have one running number. A step takes a fixed count of rows from each source, so batch k is a range of
running numbers: no loop and no cursor is needed to say what any step reads. Everything here works on
manifest-sized tables, one row a shard, until ``batches`` makes one row per training row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.selection import prefix_sum


def allocate(mix: DataFrame, rows: int, by: str = "mix_name") -> DataFrame:
    """(mix_name, source, rows_per_step) by largest remainders, in doubles and in order of source.

    Ties and near-ties depend on the order of operations, so the total is a fold over sources in order and
    each share is weight * rows / total. Sources without weight get no row; negative weights and empty
    totals are errors.
    """
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("source", "weight"))), F.lit(0.0), lambda a, x: a + x["weight"])
    totals = mix.groupBy(by).agg(total.alias("total"), F.min("weight").alias("least"))
    checked = F.when((F.col("least") < 0) | (F.col("total") <= 0), F.raise_error(F.lit("weights must not be negative, nor all zero"))).otherwise(F.col("total"))
    exact = F.col("weight") * F.lit(float(rows)) / F.col("total")
    out = mix.join(totals.withColumn("total", checked), by).where("weight > 0").withColumn("exact", exact).withColumn("base", F.floor("exact"))
    per = Window.partitionBy(by)
    left = F.lit(rows) - F.sum("base").over(per)
    place = F.row_number().over(per.orderBy((F.col("base") - F.col("exact")).asc(), F.col("source").asc()))
    return out.select(by, "source", (F.col("base") + F.when(place <= left, 1).otherwise(0)).cast("long").alias("rows_per_step"))


def shard_order(entries: DataFrame, seed: int, split: str = "train") -> DataFrame:
    """Entries with ``place``: a seeded order of each source's train shards by hash; other splits keep theirs."""
    key = F.xxhash64(F.lit(seed), F.col("source"), F.col("path")) if split == "train" else F.col("ord")
    return entries.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(key, "ord")) - 1)


def numpy_shard_order(entries: DataFrame, seed: int) -> DataFrame:
    """``shard_order`` by numpy's generator seeded with (seed, crc32 of the source), for runs begun elsewhere."""
    import zlib

    import numpy as np
    import pandas as pd

    def by_source(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord")
        order = np.random.default_rng([seed, zlib.crc32(frame["source"].iloc[0].encode())]).permutation(len(frame))
        frame = frame.iloc[order].copy()
        frame["place"] = np.arange(len(frame))
        return frame

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema) + ", place int"
    return entries.groupBy("source").applyInPandas(by_source, schema)


def pinned_order(derived: DataFrame, pinned: DataFrame) -> DataFrame:
    """Shard lists (source, shards) where a pinned list replaces the derived one of its source."""
    both = derived.withColumnRenamed("shards", "_d").join(pinned.withColumnRenamed("shards", "_p"), "source", "full")
    return both.select("source", F.coalesce("_p", "_d").alias("shards"))


def shard_rows(width: int, n_tokens: str = "n_tokens") -> Column:
    """Training rows of a shard: each needs a token beyond its width, the tail is skipped."""
    return F.greatest(F.lit(0), F.floor((F.col(n_tokens) - 1) / width)).cast("long")


def numbered(entries: DataFrame, width: int) -> DataFrame:
    """Entries with ``n_rows`` and ``first_row``, the running number of their first row in the source."""
    rows = entries.withColumn("n_rows", shard_rows(width))
    return rows.withColumn("first_row", prefix_sum("n_rows", ["source"], ["place"]))


def step_plan(spark: SparkSession, phases: list[tuple[str, int]]) -> DataFrame:
    """(phase, mix_name, first_step, steps) of consecutive phases; cursors go on across a change of mix."""
    at, rows = 0, []
    for i, (mix, steps) in enumerate(phases):
        rows.append((i, mix, at, steps))
        at += steps
    return spark.createDataFrame(rows, "phase int, mix_name string, first_step long, steps long")


def schedule(allocation: DataFrame, plan: DataFrame) -> DataFrame:
    """Per phase and source: rows per step, and the source's running number at the phase's start.

    A source that is missing from a phase keeps its number, as its cursor stands still.
    """
    each = plan.join(allocation, "mix_name").withColumn("n", F.col("rows_per_step") * F.col("steps"))
    return each.withColumn("from_row", prefix_sum("n", ["source"], ["phase"])).drop("n")


def batches(entries: DataFrame, scheduled: DataFrame, width: int, first_step: int, steps: int) -> DataFrame:
    """(step, row, source, path, start): what the wanted steps read, rows in order of source, then position.

    Every step's range is cut per shard before anything is exploded, so only wanted rows are made. A source without
    shards, or one that runs out within the wanted steps, is an error: a batch is never short.
    """
    last = first_step + steps
    wanted = scheduled.where((F.col("first_step") < last) & (F.col("first_step") + F.col("steps") > first_step))
    lo = F.col("from_row") + (F.greatest("first_step", F.lit(first_step)) - F.col("first_step")) * F.col("rows_per_step")
    hi = F.col("from_row") + (F.least(F.col("first_step") + F.col("steps"), F.lit(last)) - F.col("first_step")) * F.col("rows_per_step")
    shard = numbered(entries, width).select("source", "path", "first_row", "n_rows")
    have = shard.groupBy("source").agg(F.sum("n_rows").alias("_have"))
    wanted = wanted.withColumn("lo", lo).withColumn("hi", hi).join(have, "source", "left")
    short = F.when(F.col("_have").isNull(), F.raise_error(F.concat(F.lit("no shards for source "), "source")))
    short = short.when(F.col("hi") > F.col("_have"), F.raise_error(F.concat(F.lit("exhausted: source "), "source")))
    wanted = wanted.withColumn("hi", F.coalesce(short.cast("long"), "hi")).drop("_have")
    a, b = F.greatest("lo", "first_row"), F.least(F.col("hi"), F.col("first_row") + F.col("n_rows")) - 1
    rows = wanted.join(shard, "source").where(a <= b).withColumn("k", F.explode(F.sequence(a, b)))
    step = F.col("first_step") + F.floor((F.col("k") - F.col("from_row")) / F.col("rows_per_step"))
    rows = rows.select(step.cast("long").alias("step"), "source", "path", ((F.col("k") - F.col("first_row")) * width).alias("start"), "k")
    return rows.withColumn("row", F.row_number().over(Window.partitionBy("step").orderBy("source", "k")) - 1).select("step", "row", "source", "path", "start")


def gather(rows: DataFrame, runs: DataFrame, width: int, run: int) -> DataFrame:
    """Batch rows (step, row, path, start) with their tokens: ``x``, and ``y`` one place on.

    ``runs``: (path, start, tokens), each shard in runs of ``run`` tokens, as ``token_shards.read`` gives them. A row
    meets the runs that its ``width + 1`` tokens lie in, one or two as a rule, so no shard is gathered in one place.
    """
    last = F.col("start") + width
    parts = rows.select("step", "row", "path", "start", F.explode(F.sequence(F.floor(F.col("start") / run), F.floor(last / run))).alias("_n"))
    runs = runs.select("path", F.floor(F.col("start") / run).alias("_n"), F.col("start").alias("_from"), "tokens")
    met = parts.join(runs, ["path", "_n"])
    lo, hi = F.greatest("start", "_from") - F.col("_from"), F.least(last + 1, F.col("_from") + F.size("tokens")) - F.col("_from")
    cut = F.slice("tokens", (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    whole = met.groupBy("step", "row", "path", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_n", cut.alias("t")))), lambda p: p["t"])).alias("_t"))
    whole = whole.withColumn("_t", F.when(F.size("_t") == width + 1, F.col("_t")).otherwise(F.raise_error(F.lit("a shard ends within a row"))))
    return whole.select("step", "row", "path", "start", F.slice("_t", 1, width).alias("x"), F.slice("_t", 2, width).alias("y"))


def supply(entries: DataFrame, scheduled: DataFrame, width: int) -> DataFrame:
    """Per source of the schedule: rows needed and left; ``missing`` marks sources without shards."""
    need = scheduled.groupBy("source").agg(F.sum(F.col("rows_per_step") * F.col("steps")).alias("rows_needed"))
    have = entries.withColumn("n_rows", shard_rows(width)).groupBy("source").agg(F.sum("n_rows").alias("rows_left"))
    out = need.join(have, "source", "left").withColumn("missing", F.col("rows_left").isNull()).fillna(0, ["rows_left"])
    return out.withColumn("enough", F.col("rows_left") >= F.col("rows_needed"))


def rows_consumed(entries: DataFrame, cursors: DataFrame, width: int) -> DataFrame:
    """Per cursor (source, shard_idx, offset): rows already read, and rows left from there on."""
    n = shard_rows(width)
    offset = F.floor(F.col("offset") / width)
    used = F.when(F.col("place") < F.col("shard_idx"), n).when(F.col("place") == F.col("shard_idx"), offset).otherwise(0)
    left = F.when(F.col("place") > F.col("shard_idx"), n).when(F.col("place") == F.col("shard_idx"), F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1 - F.col("offset")) / width))).otherwise(0)
    return entries.join(cursors, "source").groupBy("source").agg(F.sum(used).cast("long").alias("rows_consumed"), F.sum(left).cast("long").alias("rows_left"))


def cursors_at(entries: DataFrame, scheduled: DataFrame, width: int, step: int) -> DataFrame:
    """The state before ``step``: (source, shard_idx, offset) per source. The inverse of ``rows_consumed``."""
    done = F.greatest(F.lit(0), F.least(F.lit(step) - F.col("first_step"), F.col("steps"))) * F.col("rows_per_step")
    read = scheduled.groupBy("source").agg(F.sum(done).alias("n"))
    shard = numbered(entries, width).join(read, "source")
    inside = shard.where((F.col("n") >= F.col("first_row")) & ((F.col("n") < F.col("first_row") + F.col("n_rows")) | (F.col("n") == F.col("first_row") + F.col("n_rows"))))
    pick = inside.groupBy("source", "n").agg(F.min(F.struct("place", "first_row")).alias("s"))
    return pick.select("source", F.col("s.place").alias("shard_idx"), ((F.col("n") - F.col("s.first_row")) * width).alias("offset"))


def reconcile(expected: DataFrame, implied: DataFrame) -> DataFrame:
    """Sources whose rows by schedule and by cursor differ, or that only one side has."""
    both = expected.withColumnRenamed("n", "expected").join(implied.withColumnRenamed("n", "implied"), "source", "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("implied")))


def shards_needed(read: DataFrame) -> DataFrame:
    """The distinct shards that ``batches`` read."""
    return read.select("source", "path").distinct()


def missing_sources(mix: DataFrame, entries: DataFrame) -> DataFrame:
    """Sources with weight that have no shard."""
    return mix.where("weight > 0").select("source").distinct().join(entries.select("source").distinct(), "source", "left_anti")
