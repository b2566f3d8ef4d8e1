"""Shards, manifests, job planning and validation quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import scan
from millrace.operators.selection import prefix_sum


#: Rows up to which a narrow table is broadcast.
SMALL = 200_000


def pack_shards(docs: DataFrame, limit: int, by: list[str], order: str, size: str = "n_tokens", also: tuple[str, ...] = ()) -> DataFrame:
    """Each row with ``part``: rows fill a shard in order, and a shard closes once it reaches ``limit``; a row never straddles
    shards. A file (``by``) of any length is folded over many tasks; only keys, sizes and the columns ``also`` take part.
    """
    return scan.fold(docs.select(*by, order, size, *also), size, limit, by, [order])


def shard_totals(packed: DataFrame, by: list[str], size: str = "n_tokens", dropped: DataFrame | None = None) -> DataFrame:
    """Per shard: documents, tokens, bytes, drops. ``dropped``: (by, part, reason) of rows dropped while a part was
    filled; those after the last shard's close belong to the last shard."""
    out = packed.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"))
    if dropped is None:
        return out
    last = out.groupBy(*by).agg(F.max("part").alias("_last"))
    count = lambda r: F.count_if(F.col("reason") == r).alias(f"n_docs_dropped_{r}")
    drops = dropped.join(last, by).withColumn("part", F.least("part", "_last")).groupBy(*by, "part").agg(count("title"), count("ngram"))
    return out.join(drops, [*by, "part"], "left").fillna(0, ["n_docs_dropped_title", "n_docs_dropped_ngram"])


def manifest(results: DataFrame) -> DataFrame:
    """Flat manifest of (source, split, file_idx, shards array): entries in order of file, then shard."""
    flat = results.select("source", "split", "file_idx", F.posexplode("shards").alias("pos", "shard"))
    w = Window.partitionBy("source", "split").orderBy("file_idx", "pos")
    return flat.withColumn("ord", F.row_number().over(w) - 1).select("source", "split", "ord", "shard.*")


def relative(path: str, root: str) -> Column:
    """A path relative to the manifest's folder; others stay."""
    folder = root.rstrip("/") + "/"
    return F.when(F.col(path).startswith(folder), F.substring(path, len(folder) + 1, 1 << 20)).otherwise(F.col(path))


def resolved(path: str, root: str) -> Column:
    return F.when(F.col(path).rlike("^(/|[a-z]+:)"), F.col(path)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col(path)))


def check_report(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source and split: shards, tokens, target, ratio, documents, bytes per token."""
    out = entries.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n_shards"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))
    out = out.join(targets, ["source", "split"], "left").fillna(0, ["target"])
    return out.withColumn("ratio", F.col("n_tokens") / F.greatest(F.lit(1), "target")).withColumn("bytes_per_token", F.col("n_bytes") / F.greatest(F.lit(1), "n_tokens"))


def progress(targets: DataFrame, entries: DataFrame) -> DataFrame:
    """Per source: target, files, train and val tokens, drops; a source without results has zeros."""
    tokens = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n_tokens"))), F.lit(0)).alias(f"{s}_tokens")
    return targets.join(entries, "source", "left").groupBy("source", "target").agg(
        F.count_distinct(F.when(F.col("split") == "train", F.col("file_idx"))).alias("n_files"), tokens("train"), tokens("val"),
        F.coalesce(F.sum("n_docs_dropped"), F.lit(0)).alias("n_docs_dropped"),
    )


def plan_jobs(targets: DataFrame, results: DataFrame) -> DataFrame:
    """The next round per source: (source, n_jobs, budget), from the yields of files done so far.

    A source without results starts with one file and its whole target. Later rounds take as many files as
    the rest needs at nine tenths of the mean yield of files read to their end (of all, if none was), up to
    the files left; each gets an equal share of the rest. Sources at their target have no row.
    """
    done = results.groupBy("source").agg(
        F.sum("n_tokens").alias("have"), F.count(F.lit(1)).alias("n_done"),
        F.coalesce(F.avg(F.when(F.col("exhausted"), F.col("n_tokens"))), F.avg("n_tokens")).alias("mean"),
    )
    out = targets.join(done, "source", "left").withColumn("rest", F.col("target") - F.coalesce("have", F.lit(0)))
    out = out.withColumn("left", F.col("n_files") - F.coalesce("n_done", F.lit(0))).where("rest > 0 AND left > 0")
    each = F.greatest(F.lit(1.0), 0.9 * F.col("mean"))
    jobs = F.when(F.col("have").isNull(), F.lit(1)).otherwise(F.least("left", F.ceil(F.col("rest") / each))).cast("long")
    return out.select("source", jobs.alias("n_jobs"), F.ceil(F.col("rest") / jobs).cast("long").alias("budget"))


def undone(plan: DataFrame, done: DataFrame, tag: str) -> DataFrame:
    """Planned jobs not yet done under the same filter version and budget."""
    keys = ["source", "split", "file_idx", "budget"]
    return plan.join(done.where(F.col("filter") == tag).select(*keys), keys, "left_anti")


def val_shards(entries: DataFrame, mix: DataFrame, max_tokens: int | None) -> DataFrame:
    """Each mixed source's first shards: those before which fewer tokens lie than its share of ``max_tokens``."""
    if max_tokens is None:
        return entries.join(mix.select("source"), "source", "left_semi")
    total = mix.agg(F.sum("weight")).first()[0]
    out = entries.join(mix, "source").withColumn("_before", prefix_sum("n_tokens", ["source"], ["ord"]))
    return out.where(F.col("_before") < max_tokens * F.col("weight") / total).drop("_before", "weight")


def _draw(seed: int, salt: str, *columns: str) -> Column:
    """32 bits of an MD5 of the seed and the columns: the same draw in any engine."""
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def shuffled(files: DataFrame, seed: int, by: list[str], name: str) -> DataFrame:
    """Rows with ``place``: a seeded order of each group's rows by hash, which does not depend on how they come."""
    w = Window.partitionBy(*by).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(name))), name)
    return files.withColumn("place", F.row_number().over(w) - 1)


def split_sharing(files: DataFrame, by: str = "source", name: str = "path", split: str = "split") -> DataFrame:
    """Per group: its files, and those that more than one split holds; a sound corpus has none of the latter."""
    per = files.groupBy(by, name).agg(F.count_distinct(split).alias("_n"))
    return per.groupBy(by).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("_n") > 1).alias("n_shared"))


def random_windows(entries: DataFrame, width: int, seed: int, each: int = 3) -> DataFrame:
    """``each`` seeded windows per source: (source, k, path, start), the start anywhere that leaves room for one.

    Shards are numbered per source, not collected: a draw meets its shard by a join.
    """
    placed = entries.withColumn("_s", F.row_number().over(Window.partitionBy("source").orderBy("ord", "path")) - 1)
    draws = placed.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    draws = draws.withColumn("_s", (_draw(seed, "shard", "source", "k") % F.col("_n")).cast("int"))
    room = F.greatest(F.lit(1).cast("long"), F.col("n_tokens") - width)
    return draws.join(placed, ["source", "_s"]).select("source", "k", "path", (_draw(seed, "start", "source", "k") % room).alias("start"))


def last_n(files: DataFrame, n: int, by: list[str], name: str = "name") -> DataFrame:
    """The last n rows by name of each group: checkpoints to average or to retain."""
    return files.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(name).desc()))).where(F.col("_r") <= n).drop("_r")
