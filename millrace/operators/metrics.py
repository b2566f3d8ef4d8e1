"""Run logs, learning-rate schedules, scores, and reports over small result tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import scan
from millrace.session import cut

#: Frequent tokens that are broadcast.
HOT = 1000

LOG_SCHEMA = "step long, tokens_seen long, loss double, lr_mult double, tok_per_s double, elapsed_s double, val_bpb double, val_loss double"


def parse_log(lines: DataFrame, order: str = "ord", line: str = "line") -> DataFrame:
    """JSON lines of steps: blank lines go, the last line of a step wins."""
    rows = lines.where(F.trim(line) != "").select(order, F.from_json(line, LOG_SCHEMA).alias("r"))
    last = rows.groupBy(F.col("r.step").alias("_step")).agg(F.max_by("r", order).alias("r"))
    return last.select("r.*")


def truncate_log(log: DataFrame, step: int) -> DataFrame:
    """The log as of a checkpoint's step, for a run that resumes there."""
    return log.where(F.col("step") <= step)


def run_status(attempts: DataFrame, by: str = "run") -> DataFrame:
    """Per run: GPU seconds over all attempts, and the last known values."""
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("attempt"))).alias(c)
    return attempts.groupBy(by).agg(F.sum("gpu_s").alias("gpu_s"), known("state"), known("step"), known("loss"), known("val_bpb"))


def ema(log: DataFrame, by: str, order: str, value: str, decay: float = 0.98) -> DataFrame:
    """The log with ``ema``: the exponential moving average of each run in order; the first is the first value."""
    return scan.ema(log, value, decay, [by], [order])


def lower_percentile(log: DataFrame, by: str, value: str, share: float = 0.99) -> DataFrame:
    """(by, percentile): the value at place floor(share * (n - 1)) of each group's ascending order, not interpolated; nulls are
    left out."""
    return scan.kth(log, [by], value, share, {"percentile": lambda n: F.floor(F.lit(share) * (n - 1))}).drop("n")


def medians(rows: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """(by, median): exact, the mean of the two middle values where their count is even; nulls are left out."""
    middle = {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)}
    return scan.kth(rows, by, value, 0.5, middle).select(*by, ((F.col("_low") + F.col("_high")) / 2).alias(name))


def with_value(log: DataFrame, column: str = "val_bpb") -> DataFrame:
    """The steps that logged a validation value."""
    return log.where(F.col(column).isNotNull())


def step_means(parts: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means over the micro-batches of a step, which all weigh the same."""
    return parts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_parts"), *[F.avg(c).alias(c) for c in columns])


def median_rate(log: DataFrame, by: list[str], skip: int = 50) -> DataFrame:
    """Exact median of tokens per second without the first ``skip`` steps."""
    return medians(log.where(F.col("step") >= skip), by, "tok_per_s", "median_tok_per_s")


def rate_factor(step: Column, steps: Column, rising: Column, falling: Column) -> Column:
    """The factor of the learning rate in a trapezoid schedule: the least of 1, of what has risen and of what is left to fall.

    The first floor(rising * steps) steps rise by equal parts up to 1; the last floor(falling * steps) fall from 1 to 0.
    """
    up, down, after = F.floor(rising * steps), F.floor(falling * steps), steps - step - 1
    # least() leaves out nulls, so a side of the trapezoid counts only where the step lies on it.
    return F.least(F.lit(1.0), F.when(up > 0, (step + 1) / up), F.when(after < down, after / F.greatest(down - 1, F.lit(1))))


def param_counts(configs: DataFrame, cap: int = 50_000_000) -> DataFrame:
    """Parameters of transformer configurations: all once, embeddings twice, embeddings, the rest; and whether under a cap.

    Per unique block: query and output projections, grouped keys and values, two-matrix MLP, two norms.
    Beyond: a norm, one skip scalar for each pair of the effective layers, optional gates and value scalars.
    """
    d, kv = F.col("d_model").cast("long"), F.col("n_kv_head") * F.floor(F.col("d_model") / F.col("n_head"))
    layers = F.col("n_unique_blocks") * F.col("repeats")
    block = 2 * d * d + 2 * d * kv + 2 * d * F.col("mlp_hidden") + 2 * d
    rest = F.col("n_unique_blocks") * block + d + F.floor(layers / 2)
    rest = rest + F.when(F.col("xsa"), layers * F.col("n_head")).otherwise(0) + F.when(F.col("value_residual"), layers - 1).otherwise(0)
    out = configs.withColumn("embedding", (F.col("vocab") * d).cast("long")).withColumn("non_embedding", rest.cast("long"))
    out = out.withColumn("once", F.col("embedding") + F.col("non_embedding")).withColumn("twice", 2 * F.col("embedding") + F.col("non_embedding"))
    return out.withColumn("under_cap", F.col("once") < cap)


def average_tensors(values: DataFrame) -> DataFrame:
    """Elementwise means, in single precision, of (checkpoint, tensor, idx, value)."""
    return values.groupBy("tensor", "idx").agg(F.avg(F.col("value").cast("float")).cast("float").alias("value"))


def bits_per_byte(scored: DataFrame, by: list[str]) -> DataFrame:
    """Bits per byte of (mean_loss, n, n_bytes) rows: losses in nats weigh by their tokens."""
    return scored.groupBy(*by).agg((F.sum(F.col("mean_loss") * F.col("n")) / (math.log(2) * F.sum("n_bytes"))).alias("bpb"))


def perplexities(scored: DataFrame, by: list[str]) -> DataFrame:
    """Token and word perplexity and bits per byte of (nats, n_tokens, n_words, n_bytes) rows."""
    nats = F.sum("nats")
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_docs"), nats.alias("total_nats"), F.exp(nats / F.sum("n_tokens")).alias("token_ppl"),
        F.exp(nats / F.sum("n_words")).alias("word_ppl"), (nats / (math.log(2) * F.sum("n_bytes"))).alias("bits_per_byte"),
    )


def unigram_nats(tokens: DataFrame, key: str, token: str = "token") -> DataFrame:
    """A stand-in scorer: negative log of each token's share of the corpus, summed per ``key``.

    Tokens are counted once, per key, and those counts give the corpus's. The ``HOT`` most frequent tokens are broadcast, so none of them gathers its rows in
    one task; the rest of the table, which grows with the corpus, is joined by a shuffle.
    """
    per = cut(tokens.groupBy(key, token).agg(F.count(F.lit(1)).alias("tf")))
    table = cut(per.groupBy(token).agg(F.sum("tf").alias("c")))
    total = F.broadcast(table.agg(F.sum("c").alias("total")))
    hot = F.broadcast(cut(table.orderBy(F.col("c").desc(), token).limit(HOT)))
    cold = per.join(hot.select(token), token, "left_anti").join(table, token)
    nats = -F.sum(F.col("tf") * F.log(F.col("c") / F.col("total")))
    return per.join(hot, token).unionByName(cold).crossJoin(total).groupBy(key).agg(nats.alias("nats"), F.sum("tf").alias("n_tokens"))


def pick_metrics(results: DataFrame, wanted: dict[str, str], by: list[str]) -> DataFrame:
    """(task, map of metrics) rows to (key, value): ``metric,none`` becomes ``task/metric``, with its error."""
    flat = results.select(*by, "task", F.explode("metrics").alias("name", "value"))
    base = F.regexp_replace(F.regexp_replace("name", ",none$", ""), "_stderr$", "")
    want = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    out = flat.where(F.col("name").endswith(",none") & (F.try_element_at(want, F.col("task")) == base))
    return out.select(*by, F.concat_ws("/", "task", F.regexp_replace("name", ",none$", "")).alias("key"), "value")


def metric_table(metrics: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """One row per run and one column per key; what is missing is NaN."""
    return metrics.groupBy(by).pivot("key", keys).agg(F.first("value")).fillna(float("nan"), keys)


def deltas(table: DataFrame, by: str, baseline: str, columns: list[str]) -> DataFrame:
    """Each run's columns less the baseline run's. The baseline becomes one row, which is broadcast; none or several are an error."""
    one = F.when(F.count(F.lit(1)) == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"the table must hold one row of {baseline}")).cast("boolean"))
    base = table.where(F.col(by) == baseline).agg(one.alias("_one"), *[F.max(c).alias(f"_{c}") for c in columns])
    return table.crossJoin(F.broadcast(base)).where("_one").select(by, *[(F.col(c) - F.col(f"_{c}")).alias(f"d_{c}") for c in columns])


def accuracy(items: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    """Share of correct items in per cent, and its binomial standard error."""
    p = F.avg(F.col(correct).cast("double"))
    return items.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), (100 * p).alias("acc"), (100 * F.sqrt(p * (1 - p) / F.count(F.lit(1)))).alias("stderr"))


def intelligence_index(hs: Column, arc: Column, piqa: Column, am: Column) -> Column:
    """The weighted mean of chance-adjusted scores; the last weighs 0.65."""
    return (hs + arc + piqa + 0.65 * am) / 3.65


def compute_costs(runs: DataFrame, factors: DataFrame) -> DataFrame:
    """Training FLOPs (6 per parameter and token) and GPU hours in units of the reference device."""
    out = runs.join(factors, "device", "left")
    return out.withColumn("flops", 6.0 * F.col("params") * F.col("tokens")).withColumn("equivalent_hours", F.col("gpus") * F.col("hours") * F.col("factor"))


def disclosure(tokens: Column, hardware: Column, hours: Column) -> Column:
    """L3 if tokens, hardware and time are given, L2 if two are, L1 if one is, else none."""
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in (tokens, hardware, hours)), F.lit(0))
    return F.when(n > 0, F.concat(F.lit("L"), n.cast("string"))).otherwise("none")


def bracket_stats(table: DataFrame, by: str, value: str) -> DataFrame:
    """Rows with their bracket's size, mean, median, and their percentile rank in it: the share of the others that are smaller."""
    stats = table.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).join(medians(table, [by], value), by, "left")
    share = F.when(F.col("n") > 1, F.col("_before") / (F.col("n") - 1)).otherwise(0.0)
    return scan.ranks(table, [by], value, "_before").join(stats, by).withColumn("percent_rank", share).drop("_before")


def least_squares(table: DataFrame, y: str, x: str, by: str | None = None) -> DataFrame:
    """One regressor: slope, intercept, R squared."""
    grouped = table.groupBy(by) if by else table
    return grouped.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def least_squares_two(table: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """Two regressors, from sums of squares and products: b1, b2, intercept, R squared."""
    s = lambda a, b: F.covar_pop(a, b)
    sums = table.select(*[F.col(c).cast("double").alias(c) for c in (y, x1, x2)]).agg(
        s(x1, x1).alias("s11"), s(x2, x2).alias("s22"), s(x1, x2).alias("s12"), s(x1, y).alias("s1y"), s(x2, y).alias("s2y"), s(y, y).alias("syy"),
        F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") ** 2
    out = sums.withColumn("b1", (F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12")) / det).withColumn("b2", (F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12")) / det)
    return out.select("b1", "b2", (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("intercept"), ((F.col("b1") * F.col("s1y") + F.col("b2") * F.col("s2y")) / F.col("syy")).alias("r2"))


def largest_residuals(table: DataFrame, y: str, x: str, n: int) -> DataFrame:
    """The rows of the first ``n`` ranks by size of their residual from the one-regressor fit; ties share a rank.

    The n-th greatest size is found first, so only rows of that size or more meet in the window.
    """
    out = table.crossJoin(F.broadcast(least_squares(table, y, x))).withColumn("residual", F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)).drop("slope", "intercept", "r2")
    least = out.select(F.abs("residual").alias("size")).orderBy(F.col("size").desc()).limit(n).agg(F.min("size").alias("_least"))
    few = out.crossJoin(F.broadcast(least)).where(F.abs("residual") >= F.col("_least")).drop("_least")
    return few.withColumn("residual_rank", F.rank().over(Window.orderBy(F.abs("residual").desc()))).where(F.col("residual_rank") <= n)


def top_k_sample(logits: DataFrame, by: list[str], k: int, temperature: float, u: str = "u") -> DataFrame:
    """The next token per group: the likeliest at temperature 0, else by inverse CDF at the group's ``u`` among
    the tokens whose logit is at least the k-th greatest (ties stay)."""
    w = Window.partitionBy(*by)
    if temperature == 0:
        best = w.orderBy(F.col("logit").desc(), "token")
        return logits.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*by, "token")
    kth = F.nth_value("logit", k).over(w.orderBy(F.col("logit").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lowest = F.min("logit").over(w)
    live = logits.withColumn("_kth", F.coalesce(kth, lowest)).where(F.col("logit") >= F.col("_kth"))
    live = live.withColumn("_e", F.exp((F.col("logit") - F.max("logit").over(w)) / temperature))
    live = live.withColumn("_p", F.col("_e") / F.sum("_e").over(w))
    live = live.withColumn("_cum", F.sum("_p").over(w.orderBy("token").rowsBetween(Window.unboundedPreceding, 0)))
    pick = F.coalesce(F.min(F.when(F.col("_cum") > F.col(u), F.col("token"))), F.max("token"))
    return live.groupBy(*by).agg(pick.alias("token"))


def error_class(kind: Column, message: Column) -> Column:
    """Whether a failure would only repeat: bad numbers, keys or values, or data that has run out."""
    return kind.isin("FloatingPointError", "KeyError", "ValueError") | ((kind == "RuntimeError") & F.coalesce(F.contains(message, F.lit("exhausted")), F.lit(False)))


def select_runs(runs: DataFrame, group: str, column: str = "run") -> DataFrame:
    """Runs of a comma-separated list of names, else those that begin with ``group``; nothing found is an error."""
    names = [x for x in group.split(",") if x]
    exact = runs.where(F.col(column).isin(names))
    unknown = {*names} - {r[0] for r in exact.select(column).distinct().collect()}
    if not unknown:
        return exact
    found = runs.where(F.col(column).startswith(group))
    if len(names) > 1 or found.isEmpty():
        raise ValueError(f"unknown runs: {sorted(unknown)}")
    return found
