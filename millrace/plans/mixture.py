"""Queries on mixtures and the batches they give. Sources of ``documents`` stand in for corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import mixture
from millrace.plans.corpus import _ALL, _entries
from millrace.plans.windows import _tokens
from millrace.session import table

WIDTH, ROWS, STEPS, RUN = 64, 64, (6, 3), 300
MIX_ROWS, SEED = 64, 1337


def mix_allocation(spark: SparkSession, d: str) -> DataFrame:
    """A mix for each language: a tenth for each document of a source. Many weights are equal or nearly so, and tenths are not
    exact in doubles, so remainders tie or nearly tie and the order of operations decides."""
    weight = (F.count(F.lit(1)).cast("double") * F.lit(0.1)).alias("weight")
    return mixture.allocate(table(spark, d, "documents").groupBy(F.col("lang").alias("mix_name"), "source").agg(weight), MIX_ROWS)


def _mixes(spark: SparkSession, d: str) -> DataFrame:
    """Two mixes over all sources: by documents, and by the bytes that a source has above the mean; those below have no weight."""
    docs = table(spark, d, "documents").select("source", F.octet_length("text").alias("b"))
    sums = docs.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("b").cast("double").alias("b"))
    mean = F.broadcast(sums.agg((F.sum("b") / F.count(F.lit(1))).alias("mean")))  # one row
    by_docs = sums.select(F.lit("docs").alias("mix_name"), "source", F.col("n").alias("weight"))
    by_bytes = sums.crossJoin(mean).select(F.lit("bytes").alias("mix_name"), "source", F.greatest(F.col("b") - F.col("mean"), F.lit(0.0)).alias("weight"))
    return by_docs.unionByName(by_bytes)


def _train(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).where("split = 'train'").withColumn("place", F.col("ord"))


def _scheduled(spark: SparkSession, d: str) -> DataFrame:
    return mixture.schedule(mixture.allocate(_mixes(spark, d), ROWS), mixture.step_plan(spark, [("docs", STEPS[0]), ("bytes", STEPS[1])]))


def source_allocation(spark: SparkSession, d: str) -> DataFrame:
    return mixture.allocate(_mixes(spark, d), ROWS)


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = mixture.numbered(_train(spark, d), WIDTH)
    return rows.select("source", "ord", "n_rows", F.col("first_row").cast("long").alias("first_row"))


def training_batches(spark: SparkSession, d: str) -> DataFrame:
    """Steps 4 to 7: the mix changes at step 6 and the cursors go on."""
    out = mixture.batches(_train(spark, d), _scheduled(spark, d), WIDTH, 4, 4)
    return out.select("step", F.col("row").cast("long").alias("row"), "source", "path", F.col("start").cast("long").alias("start"))


def batch_shards(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shards_needed(mixture.batches(_train(spark, d), _scheduled(spark, d), WIDTH, 4, 4))


def batch_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The inputs and targets of the batches, as sums and ends; shards lie in runs of ``RUN`` tokens."""
    rows = mixture.batches(_train(spark, d), _scheduled(spark, d), WIDTH, 4, 4)
    path = F.format_string("%s_%04d_%02d.bin", "source", "file_idx", "part").alias("path")
    starts = F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(RUN))
    cut = F.transform(starts, lambda s: F.struct(s.cast("long").alias("start"), F.slice("tokens", s + 1, F.lit(RUN)).alias("tokens")))
    runs = _tokens(spark, d).select(path, F.explode(cut).alias("run")).select("path", "run.*")
    out = mixture.gather(rows, runs, WIDTH, RUN)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("step", F.col("row").cast("long").alias("row"), total("x").alias("x_sum"), total("y").alias("y_sum"), F.element_at("x", 1).cast("long").alias("x_first"), F.element_at("y", -1).cast("long").alias("y_last"))


def data_supply(spark: SparkSession, d: str) -> DataFrame:
    return mixture.supply(_train(spark, d), _scheduled(spark, d), WIDTH)


def loader_cursors(spark: SparkSession, d: str) -> DataFrame:
    """Cursors before step 7, and the rows that they say were read and are left."""
    train, scheduled = _train(spark, d), _scheduled(spark, d)
    cursors = mixture.cursors_at(train, scheduled, WIDTH, 7)
    return cursors.select("source", "shard_idx", F.col("offset").cast("long").alias("offset")).join(mixture.rows_consumed(train, cursors, WIDTH), "source")


def mix_without_shards(spark: SparkSession, d: str) -> DataFrame:
    """Sources of the mix without a shard above the mean length; such shards stand in for a corpus that is not built yet."""
    train = _train(spark, d)
    mean = F.broadcast(train.agg((F.sum("n_bytes") / F.count(F.lit(1))).alias("mean")))  # one row
    return mixture.missing_sources(_mixes(spark, d), train.crossJoin(mean).where(F.col("n_bytes") > 1.2 * F.col("mean")))


def seeded_shards(spark: SparkSession, d: str) -> DataFrame:
    """The order in which each source's train shards are read under a seed, as numpy's generator permutes them."""
    return mixture.numpy_shard_order(_train(spark, d).drop("place"), SEED).select("source", "path", F.col("place").cast("long").alias("place"))


def pinned_shards(spark: SparkSession, d: str) -> DataFrame:
    """Shard lists by hash, but for sources of which a run has stored a list: here those of more documents than the mean, by
    descending length."""
    train = _train(spark, d)
    order = F.md5(F.concat_ws("|", F.lit(str(SEED)), "path"))
    listed = lambda rows, key: rows.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), "path"))), lambda x: x["path"]).alias("shards"))
    sizes = train.groupBy("source").agg(F.sum("n_docs").alias("_docs"))
    mean = F.broadcast(sizes.agg(F.avg("_docs").alias("_mean")))  # one row
    stored = sizes.crossJoin(mean).where(F.col("_docs") > F.col("_mean")).select("source")
    lists = mixture.pinned_order(listed(train, order), listed(train.join(stored, "source", "left_semi"), -F.col("n_tokens")))
    return lists.select("source", F.array_join("shards", "|").alias("shards"))


def cursor_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose cursors do not stand where the schedule says they should: cursors as before step 7, and the
    schedule at step 7, when none may differ, and at step 8, when all do that give rows by then."""
    train, scheduled = _train(spark, d), _scheduled(spark, d)
    implied = mixture.rows_consumed(train, mixture.cursors_at(train, scheduled, WIDTH, 7), WIDTH)
    out = []
    for step in (7, 8):
        done = F.greatest(F.lit(0), F.least(F.lit(step) - F.col("first_step"), F.col("steps"))) * F.col("rows_per_step")
        expected = scheduled.groupBy("source").agg(F.sum(done).alias("n"))
        out.append(mixture.reconcile(expected, implied.select("source", F.col("rows_consumed").alias("n"))).withColumn("step", F.lit(step).cast("long")))
    return out[0].unionByName(out[1])


_MIX = f"""m AS (
  SELECT 'docs' AS mix_name, source, CAST(count(*) AS DOUBLE) AS weight FROM documents GROUP BY source
  UNION ALL SELECT 'bytes', source, greatest(b - sum(b) OVER () / count(*) OVER (), 0) FROM (SELECT source, CAST(sum(strlen(text)) AS DOUBLE) AS b FROM documents GROUP BY source))"""


def _allocate(rows: int) -> str:
    return f"""t AS (SELECT mix_name, list_reduce(list(weight ORDER BY source), lambda a, b: a + b) AS total FROM m GROUP BY mix_name),
e AS (SELECT mix_name, source, weight * CAST({rows} AS DOUBLE) / total AS exact FROM m JOIN t USING (mix_name) WHERE weight > 0),
k AS (SELECT *, floor(exact) AS base, row_number() OVER (PARTITION BY mix_name ORDER BY floor(exact) - exact, source) AS r, {rows} - sum(floor(exact)) OVER (PARTITION BY mix_name) AS l FROM e),
alloc AS (SELECT mix_name, source, CAST(base + CASE WHEN r <= l THEN 1 ELSE 0 END AS BIGINT) AS rows_per_step FROM k)"""


_PLAN = f"""p(phase, mix_name, first_step, steps) AS (VALUES (0, 'docs', 0, {STEPS[0]}), (1, 'bytes', {STEPS[0]}, {STEPS[1]})),
sched AS (SELECT *, coalesce(sum(rows_per_step * steps) OVER (PARTITION BY source ORDER BY phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS from_row FROM p JOIN alloc USING (mix_name)),
train AS (SELECT source, ord, path, n_tokens, greatest(0, (n_tokens - 1) // {WIDTH}) AS n_rows FROM entries WHERE split = 'train'),
placed AS (SELECT *, CAST(coalesce(sum(n_rows) OVER (PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row FROM train),
every AS (SELECT source, path, ord, first_row + unnest(range(0, n_rows)) AS k, first_row FROM placed),
wanted AS (SELECT source, first_step + unnest(range(0, steps)) AS step, first_step, rows_per_step, from_row FROM sched),
hits AS (SELECT step, w.source, path, (k - first_row) * {WIDTH} AS start, k FROM wanted w JOIN every e ON e.source = w.source
  AND k >= from_row + (step - first_step) * rows_per_step AND k < from_row + (step - first_step + 1) * rows_per_step WHERE step BETWEEN 4 AND 7)"""
_FULL = f"{_ALL}, {_MIX}, {_allocate(ROWS)}, {_PLAN}"

QUERIES = {f.__name__: f for f in (mix_allocation, source_allocation, training_rows, training_batches, batch_shards, batch_tokens, data_supply, loader_cursors, mix_without_shards, seeded_shards, pinned_shards, cursor_gaps)}
ORACLE_SQL = {
    "mix_allocation": f"WITH m AS (SELECT lang AS mix_name, source, CAST(count(*) AS DOUBLE) * CAST(0.1 AS DOUBLE) AS weight FROM documents GROUP BY ALL), {_allocate(MIX_ROWS)} SELECT * FROM alloc",
    "source_allocation": f"WITH {_MIX}, {_allocate(ROWS)} SELECT * FROM alloc",
    "training_rows": f"{_FULL} SELECT source, ord, n_rows, first_row FROM placed",
    "training_batches": f"{_FULL} SELECT CAST(step AS BIGINT) AS step, row_number() OVER (PARTITION BY step ORDER BY source, k) - 1 AS row, source, path, CAST(start AS BIGINT) AS start FROM hits",
    "batch_tokens": f"""{_FULL}, tk AS (SELECT doc_id, list_concat([0], list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) + 2)) AS t FROM documents),
st AS (SELECT format('{{}}_{{:04d}}_{{:02d}}.bin', source, file_idx, part) AS path, flatten(list(t ORDER BY doc_id)) AS tokens FROM tk JOIN fold USING (doc_id) GROUP BY source, file_idx, part),
r AS (SELECT CAST(step AS BIGINT) AS step, row_number() OVER (PARTITION BY step ORDER BY source, k) - 1 AS row, path, start FROM hits),
xy AS (SELECT step, row, tokens[start + 1 : start + {WIDTH}] AS x, tokens[start + 2 : start + {WIDTH + 1}] AS y FROM r JOIN st USING (path))
SELECT step, row, CAST(list_sum(x) AS BIGINT) AS x_sum, CAST(list_sum(y) AS BIGINT) AS y_sum, CAST(x[1] AS BIGINT) AS x_first, CAST(y[{WIDTH}] AS BIGINT) AS y_last FROM xy""",
    "batch_shards": f"{_FULL} SELECT DISTINCT source, path FROM hits",
    "data_supply": f"""{_FULL}, need AS (SELECT source, CAST(sum(rows_per_step * steps) AS BIGINT) AS rows_needed FROM sched GROUP BY source), have AS (SELECT source, CAST(sum(n_rows) AS BIGINT) AS rows_left FROM train GROUP BY source)
SELECT source, rows_needed, coalesce(rows_left, 0) AS rows_left, rows_left IS NULL AS missing, coalesce(rows_left, 0) >= rows_needed AS enough FROM need LEFT JOIN have USING (source)""",
    "loader_cursors": f"""{_FULL}, n AS (SELECT source, CAST(sum(greatest(0, least(7 - first_step, steps)) * rows_per_step) AS BIGINT) AS n FROM sched GROUP BY source),
c AS (SELECT source, n, min(ord) AS shard_idx, arg_min(first_row, ord) AS f FROM placed JOIN n USING (source) WHERE n >= first_row AND n <= first_row + n_rows GROUP BY source, n),
s AS (SELECT source, sum(n_rows) AS total FROM placed GROUP BY source)
SELECT source, shard_idx, (n - f) * {WIDTH} AS "offset", n AS rows_consumed, CAST(total - n AS BIGINT) AS rows_left FROM c JOIN s USING (source)""",
    "pinned_shards": f"""{_ALL}, t AS (SELECT * FROM entries WHERE split = 'train'), z AS (SELECT source, sum(n_docs) AS docs FROM t GROUP BY source),
p AS (SELECT source, docs > (SELECT avg(docs) FROM z) AS pinned FROM z)
SELECT source, CASE WHEN pinned THEN string_agg(path, '|' ORDER BY -n_tokens, path) ELSE string_agg(path, '|' ORDER BY md5('{SEED}|' || path), path) END AS shards FROM t JOIN p USING (source) GROUP BY source, pinned""",
    "cursor_gaps": f"""{_FULL}, n AS (SELECT step, source, CAST(sum(greatest(0, least(step - first_step, steps)) * rows_per_step) AS BIGINT) AS n FROM sched, (VALUES (7), (8)) s(step) GROUP BY step, source)
SELECT CAST(b.step AS BIGINT) AS step, source, b.n AS expected, a.n AS implied FROM n a JOIN n b USING (source) WHERE a.step = 7 AND a.n != b.n""",
    "mix_without_shards": f"{_FULL} SELECT DISTINCT source FROM m WHERE weight > 0 AND source NOT IN (SELECT source FROM entries WHERE split = 'train' AND n_bytes > 1.2 * (SELECT sum(n_bytes) / count(*) FROM entries WHERE split = 'train'))",
}
