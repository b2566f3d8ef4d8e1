"""Queries on logs, schedules and result tables. The tables hold no training logs: rows of ``events`` stand in,
each user being a run, its events in order the steps, and ``value`` the logged number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import layout, metrics
from millrace.session import scratch, table
from millrace.sources import tables

BASELINE = 1


def _steps(spark: SparkSession, d: str) -> DataFrame:
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, d, "events").select(F.col("user_id").alias("run"), step.cast("long").alias("step"), "event_type", F.col("value").alias("loss"))


def log_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Lines of JSON where every step was logged again later by a resumed run; the last line of a step wins."""
    rows = table(spark, d, "events").select("event_id", F.to_json(F.struct((F.col("event_id") % 1000).alias("step"), F.col("value").alias("loss"))).alias("line"))
    return metrics.parse_log(rows, "event_id").select("step", "loss")


def log_ema(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ema(_steps(spark, d).select("run", "step", "loss"), "run", "step", "loss").select("run", "step", F.round("ema", 8).alias("ema"))


def log_p99(spark: SparkSession, d: str) -> DataFrame:
    return metrics.lower_percentile(_steps(spark, d), "run", "loss").select("run", F.col("percentile").alias("p99"))


def val_points(spark: SparkSession, d: str) -> DataFrame:
    """The steps with a validation value; views stand in for validation passes."""
    log = _steps(spark, d).withColumn("val_bpb", F.when(F.col("event_type") == "view", F.col("loss")))
    return metrics.with_value(log).select("run", "step", "val_bpb")


def micro_batch_means(spark: SparkSession, d: str) -> DataFrame:
    """Every four lines of a run are the micro-batches of one step."""
    parts = _steps(spark, d).withColumn("step", F.floor(F.col("step") / 4))
    return metrics.step_means(parts, ["run", "step"], ["loss"]).select("run", "step", "n_parts", F.round("loss", 8).alias("loss"))


def median_throughput(spark: SparkSession, d: str) -> DataFrame:
    return metrics.median_rate(_steps(spark, d).withColumnRenamed("loss", "tok_per_s"), ["run"]).select("run", F.round("median_tok_per_s", 9).alias("median_tok_per_s"))


def truncated_log(spark: SparkSession, d: str) -> DataFrame:
    return metrics.truncate_log(_steps(spark, d), 20).select("run", "step", "loss")


def resumed_log(spark: SparkSession, d: str) -> DataFrame:
    """A log that is written and read back: each run's first attempt reaches step 30, its second goes on from step 20 and logs
    half of each value, and every third run has had no second one."""
    rows, path = _steps(spark, d).select("run", "step", "loss"), f"{scratch(spark, 'log')}/steps"
    tables.append_log(rows.where("step <= 30"), path, 0)
    tables.append_log(rows.where("step >= 20 AND run % 3 != 0").withColumn("loss", F.col("loss") / 2), path, 1)
    return tables.read_log(spark, path, "run long, step long, loss double", ["run"]).select("run", "step", "loss", F.col("attempt").cast("long").alias("attempt"))


def run_status(spark: SparkSession, d: str) -> DataFrame:
    rows = _steps(spark, d)
    attempts = rows.select("run", F.col("step").alias("attempt"), F.col("loss").alias("gpu_s"), F.col("event_type").alias("state"), "step", F.when(F.col("event_type") != "error", F.col("loss")).alias("loss"), F.when(F.col("event_type") == "view", F.col("loss")).alias("val_bpb"))
    return metrics.run_status(attempts).withColumn("gpu_s", F.round("gpu_s", 6))


def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The rate of every logged step; a run's number gives its shares of warm-up and decay, which may be none or overlap."""
    rows = _steps(spark, d)
    totals = rows.groupBy("run").agg(F.count(F.lit(1)).alias("total"))
    warmup, decay = (F.col("run") % 5).cast("double") / 10, (F.col("run") % 8).cast("double") / 10
    out = rows.join(totals, "run").select("run", "step", metrics.rate_factor(F.col("step"), F.col("total"), warmup, decay).alias("lr_mult"))
    return out.withColumn("lr_mult", F.round("lr_mult", 12))


def param_counts(spark: SparkSession, d: str) -> DataFrame:
    """Parts stand in for configurations: their numbers and sizes give vocabulary, widths, heads and flags."""
    key, size = F.col("p_partkey"), F.col("p_size")
    fields = {
        "name": key.cast("string"), "vocab": (1000 + key % 30_000).cast("int"), "d_model": 64 * (1 + size % 12), "n_unique_blocks": 1 + size % 14, "repeats": (1 + key % 2).cast("int"), "n_head": 1 + size % 12,
        "n_kv_head": 1 + size % 4, "mlp_hidden": 32 * size, "xsa": key % 3 == 0, "value_residual": key % 5 == 0,
    }
    configs = table(spark, d, "part").select(*(c.alias(n) for n, c in fields.items()))
    return metrics.param_counts(configs).select("name", "once", "twice", "embedding", "non_embedding", "under_cap")


def checkpoint_average(spark: SparkSession, d: str) -> DataFrame:
    """Elementwise means of embeddings of one label: a label stands in for a tensor, a vector for a checkpoint."""
    rows = table(spark, d, "embeddings").select(F.col("label").alias("tensor"), F.posexplode("embedding").alias("idx", "value"))
    return metrics.average_tensors(rows).select("tensor", F.col("idx").cast("long").alias("idx"), F.round(F.col("value").cast("double"), 4).alias("value"))


def last_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    files = _steps(spark, d).select("run", F.format_string("step_%06d", "step").alias("name"))
    return layout.last_n(files, 4, ["run"])


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d).groupBy("run", "event_type").agg(F.avg("loss").alias("value"))


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """Results as maps of library-style names, then the wanted metric of each task and its error."""
    both = _steps(spark, d).groupBy("run", F.col("event_type").alias("task")).agg(F.avg("loss").alias("a"), F.stddev_samp("loss").alias("e"), F.max("loss").alias("m"))
    maps = both.select("run", "task", F.create_map(F.lit("acc,none"), "a", F.lit("acc_stderr,none"), "e", F.lit("acc_norm,none"), "m", F.lit("alias"), F.lit(None).cast("double")).alias("metrics"))
    wanted = {"click": "acc", "view": "acc_norm", "error": "acc"}
    return metrics.pick_metrics(maps, wanted, ["run"]).select("run", "key", F.round("value", 8).alias("value"))


def metric_table(spark: SparkSession, d: str) -> DataFrame:
    keys = ["click", "error", "purchase", "signup", "view"]
    out = metrics.metric_table(_metrics(spark, d).withColumnRenamed("event_type", "key"), "run", keys)
    return out.select("run", *[F.round(F.nanvl(k, F.lit(-1.0)), 8).alias(k) for k in keys])


def baseline_deltas(spark: SparkSession, d: str) -> DataFrame:
    runs = _steps(spark, d).groupBy("run").agg(F.sum("loss").alias("total"), F.count(F.lit(1)).alias("n"))
    out = metrics.deltas(runs, "run", str(BASELINE), ["total", "n"])
    return out.select("run", F.round("d_total", 6).alias("d_total"), "d_n")


def category_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = _steps(spark, d).withColumn("correct", F.col("loss") > 10)
    out = metrics.accuracy(rows, ["event_type"])
    return out.select("event_type", "total", F.round("acc", 8).alias("acc"), F.round("stderr", 8).alias("stderr"))


def score_index(spark: SparkSession, d: str) -> DataFrame:
    """The weighted index of four mean scores."""
    by = F.col("event_type")
    mean = lambda kind: F.avg(F.when(by == kind, F.col("loss")))
    out = _steps(spark, d).groupBy("run").agg(metrics.intelligence_index(mean("click"), mean("view"), mean("signup"), mean("purchase")).alias("score_index"))
    return out.select("run", F.round("score_index", 8).alias("score_index"))


def compute_costs(spark: SparkSession, d: str) -> DataFrame:
    """Orders stand in for runs: price for parameters, key for tokens, status for the device."""
    factors = spark.createDataFrame([("F", 1.0), ("O", 0.5)], "device string, factor double")
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("device"), F.col("o_totalprice").alias("params"), F.col("o_orderkey").alias("tokens"), F.lit(8).alias("gpus"), F.lit(1.5).cast("double").alias("hours"))
    return metrics.compute_costs(runs, factors).select("run", F.round("flops", 2).alias("flops"), "equivalent_hours")


def disclosure_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    level = metrics.disclosure(F.col("quality"), F.nullif("toxic", F.lit(0)), F.when(F.col("n_chars") > 1000, F.col("n_chars")))
    return rows.select("doc_id", level.alias("level"))


def bracket_ranks(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.bracket_stats(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", "c_acctbal")
    return out.select("c_custkey", "n", *[F.round(c, 7).alias(c) for c in ("mean", "median", "percent_rank")])


def line_fit(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.least_squares(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "l_returnflag")
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 8).alias("r2"))


def plane_fit(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.least_squares_two(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "l_discount")
    return out.select(F.round("b1", 3).alias("b1"), F.round("r2", 7).alias("r2"))


def largest_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose price lies farthest from the line by size; the report is the first ten ranks."""
    out = metrics.largest_residuals(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size", 10)
    return out.select("p_partkey", F.col("residual_rank").cast("long").alias("residual_rank"), F.round("residual", 4).alias("residual"))


def top_k_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Each run samples among its five greatest logits; the draw is given by the run's number."""
    rows = _steps(spark, d).select("run", F.col("step").alias("token"), F.col("loss").alias("logit"), ((F.col("run") % 100 + 0.5) / 100).alias("u"))
    return metrics.top_k_sample(rows, ["run"], 5, 0.8)


def greedy_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = _steps(spark, d).select("run", F.col("step").alias("token"), F.col("loss").alias("logit"))
    return metrics.top_k_sample(rows, ["run"], 5, 0)


_S = "s AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, event_type, value AS loss FROM events)"
_LR = f"""{_S}, t AS (SELECT run, count(*) AS total FROM s GROUP BY run),
p AS (SELECT run, step, total, CAST(run % 5 AS DOUBLE) / 10 AS warmup, CAST(run % 8 AS DOUBLE) / 10 AS decay FROM s JOIN t USING (run)),
q AS (SELECT run, step, total, CASE WHEN floor(warmup * total) > 0 THEN least(1.0, (step + 1) / floor(warmup * total)) ELSE 1.0 END AS warm, total - floor(decay * total) AS start FROM p)"""

QUERIES = {
    f.__name__: f
    for f in (
        log_dedupe, log_ema, log_p99, val_points, micro_batch_means, median_throughput, truncated_log, resumed_log, run_status, lr_schedule, param_counts, checkpoint_average, last_checkpoints, metric_rows, metric_table, baseline_deltas,
        category_accuracy, score_index, compute_costs, disclosure_levels, bracket_ranks, line_fit, plane_fit, largest_residuals, top_k_tokens, greedy_tokens,
    )
}
ORACLE_SQL = {
    "log_dedupe": "SELECT event_id % 1000 AS step, arg_max(value, event_id) AS loss FROM events GROUP BY 1",
    "log_ema": f"""WITH RECURSIVE {_S}, f AS (SELECT run, step, loss AS ema FROM s WHERE step = 0
  UNION ALL SELECT s.run, s.step, CAST(0.98 AS DOUBLE) * ema + (1 - CAST(0.98 AS DOUBLE)) * loss FROM f JOIN s ON s.run = f.run AND s.step = f.step + 1) SELECT run, step, round(ema, 8) AS ema FROM f""",
    "log_p99": f"WITH {_S} SELECT run, list_sort(list(loss))[CAST(floor(0.99 * (count(*) - 1)) AS BIGINT) + 1] AS p99 FROM s GROUP BY run",
    "val_points": f"WITH {_S} SELECT run, step, loss AS val_bpb FROM s WHERE event_type = 'view'",
    "micro_batch_means": f"WITH {_S} SELECT run, step // 4 AS step, count(*) AS n_parts, round(avg(loss), 8) AS loss FROM s GROUP BY ALL",
    "median_throughput": f"WITH {_S} SELECT run, round(median(loss), 9) AS median_tok_per_s FROM s WHERE step >= 50 GROUP BY run",
    "truncated_log": f"WITH {_S} SELECT run, step, loss FROM s WHERE step <= 20",
    "resumed_log": f"""WITH {_S}, a AS (SELECT run, step, loss, 0 AS attempt FROM s WHERE step <= 30 UNION ALL SELECT run, step, loss / 2, 1 FROM s WHERE step >= 20 AND run % 3 != 0),
b AS (SELECT run, min(step) AS began FROM a WHERE attempt = 1 GROUP BY run)
SELECT run, step, loss, CAST(attempt AS BIGINT) AS attempt FROM a LEFT JOIN b USING (run) WHERE attempt = 1 OR began IS NULL OR step < began""",
    "run_status": f"""WITH {_S} SELECT run, round(sum(loss), 6) AS gpu_s, arg_max(event_type, step) AS state, max(step) AS step,
  arg_max(loss, step) FILTER (WHERE event_type != 'error') AS loss, arg_max(loss, step) FILTER (WHERE event_type = 'view') AS val_bpb FROM s GROUP BY run""",
    "lr_schedule": f"""WITH {_LR} SELECT run, step, round(CASE WHEN step < start THEN warm ELSE least(warm, greatest(0.0, CASE WHEN total - 1 > start THEN (total - 1 - step) / (total - 1 - start) ELSE 0.0 END)) END, 12) AS lr_mult FROM q""",
    "param_counts": """WITH c AS (SELECT CAST(p_partkey AS VARCHAR) AS name, 1000 + p_partkey % 30000 AS vocab, 64 * (1 + p_size % 12) AS d, 1 + p_size % 14 AS u, 1 + p_partkey % 2 AS r, 1 + p_size % 12 AS h, 1 + p_size % 4 AS kv, 32 * p_size AS m,
  p_partkey % 3 = 0 AS xsa, p_partkey % 5 = 0 AS vres FROM part),
n AS (SELECT name, vocab * d AS embedding, u * (2 * d * d + 2 * d * (kv * (d // h)) + 2 * d * m + 2 * d) + d + (u * r) // 2 + CASE WHEN xsa THEN u * r * h ELSE 0 END + CASE WHEN vres THEN u * r - 1 ELSE 0 END AS rest FROM c)
SELECT name, CAST(embedding + rest AS BIGINT) AS once, CAST(2 * embedding + rest AS BIGINT) AS twice, CAST(embedding AS BIGINT) AS embedding, CAST(rest AS BIGINT) AS non_embedding, embedding + rest < 50000000 AS under_cap FROM n""",
    "checkpoint_average": "SELECT label AS tensor, idx - 1 AS idx, round(avg(v), 4) AS value FROM (SELECT label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS idx FROM embeddings) GROUP BY ALL",
    "last_checkpoints": f"WITH {_S} SELECT run, name FROM (SELECT run, format('step_{{:06d}}', step) AS name, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS r FROM s) WHERE r <= 4",
    "metric_rows": f"""WITH {_S}, m AS (SELECT run, event_type AS t, avg(loss) AS a, stddev_samp(loss) AS e, max(loss) AS x FROM s GROUP BY ALL)
SELECT run, t || '/acc' AS key, round(a, 8) AS value FROM m WHERE t IN ('click', 'error') UNION ALL SELECT run, t || '/acc_stderr', round(e, 8) FROM m WHERE t IN ('click', 'error')
UNION ALL SELECT run, 'view/acc_norm', x FROM m WHERE t = 'view'""",
    "metric_table": f"WITH {_S} SELECT run, {', '.join(f"round(coalesce(avg(loss) FILTER (WHERE event_type = '{k}'), -1), 8) AS {k}" for k in ('click', 'error', 'purchase', 'signup', 'view'))} FROM s GROUP BY run",
    "baseline_deltas": f"WITH {_S}, t AS (SELECT run, sum(loss) AS total, count(*) AS n FROM s GROUP BY run), b AS (SELECT total AS bt, n AS bn FROM t WHERE run = {BASELINE}) SELECT run, round(total - bt, 6) AS d_total, n - bn AS d_n FROM t, b",
    "category_accuracy": f"WITH {_S}, p AS (SELECT event_type, count(*) AS total, avg(CASE WHEN loss > 10 THEN 1.0 ELSE 0.0 END) AS p FROM s GROUP BY 1) SELECT event_type, total, round(100 * p, 8) AS acc, round(100 * sqrt(p * (1 - p) / total), 8) AS stderr FROM p",
    "score_index": f"WITH {_S} SELECT run, round(({' + '.join(f"avg(loss) FILTER (WHERE event_type = '{k}')" for k in ('click', 'view', 'signup'))} + 0.65 * avg(loss) FILTER (WHERE event_type = 'purchase')) / 3.65, 8) AS score_index FROM s GROUP BY run",
    "compute_costs": "SELECT o_orderkey AS run, round(6.0 * o_totalprice * o_orderkey, 2) AS flops, CAST(8 * 1.5 * CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 END AS DOUBLE) AS equivalent_hours FROM orders",
    "disclosure_levels": """WITH n AS (SELECT doc_id, (quality IS NOT NULL)::INT + (nullif(toxic, 0) IS NOT NULL)::INT + (n_chars > 1000)::INT AS n FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN n > 0 THEN 'L' || n ELSE 'none' END AS level FROM n""",
    "bracket_ranks": """SELECT c_custkey, count(*) OVER w AS n, round(avg(c_acctbal) OVER w, 7) AS mean, round(median(c_acctbal) OVER w, 7) AS median, round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal), 7) AS percent_rank
FROM customer WINDOW w AS (PARTITION BY c_mktsegment)""",
    "line_fit": "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem GROUP BY 1",
    "plane_fit": """WITH s AS (SELECT var_pop(l_quantity) AS s11, var_pop(l_discount) AS s22, covar_pop(l_quantity, l_discount) AS s12, covar_pop(l_quantity, l_extendedprice) AS s1y, covar_pop(l_discount, l_extendedprice) AS s2y, var_pop(l_extendedprice) AS syy FROM lineitem),
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s) SELECT round(b1, 3) AS b1, round((b1 * s1y + b2 * s2y) / syy, 7) AS r2 FROM b""",
    "largest_residuals": """WITH f AS (SELECT regr_slope(p_retailprice, p_size) AS m, regr_intercept(p_retailprice, p_size) AS b FROM part),
r AS (SELECT p_partkey, p_retailprice - b - m * p_size AS residual FROM part, f), k AS (SELECT *, rank() OVER (ORDER BY abs(residual) DESC) AS residual_rank FROM r)
SELECT p_partkey, residual_rank, round(residual, 4) AS residual FROM k WHERE residual_rank <= 10""",
    "top_k_tokens": f"""WITH {_S}, k AS (SELECT run, step AS token, loss AS logit, (run % 100 + 0.5) / 100 AS u, coalesce(nth_value(loss, 5) OVER (PARTITION BY run ORDER BY loss DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), min(loss) OVER (PARTITION BY run)) AS kth FROM s),
e AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY run)) / CAST(0.8 AS DOUBLE)) AS e FROM k WHERE logit >= kth),
c AS (SELECT *, sum(e) OVER (PARTITION BY run ORDER BY token) / sum(e) OVER (PARTITION BY run) AS cum FROM e)
SELECT run, coalesce(min(token) FILTER (WHERE cum > u), max(token)) AS token FROM c GROUP BY run""",
    "greedy_tokens": f"WITH {_S} SELECT run, token FROM (SELECT run, step AS token, row_number() OVER (PARTITION BY run ORDER BY loss DESC, step) AS r FROM s) WHERE r = 1",
}
