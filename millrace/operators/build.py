"""From source files to token tables and a manifest, in rounds until every source has its tokens.

One round is one plan per source: scan, select, drop, encode, cut each file at its job's budget, assign
shards. Token rows land in a Parquet table partitioned by source, split and file; the totals of each shard
go to a results table, from which the next round is planned and the manifest is read. A job that is done
under the same filter tag and budget is not run again, so a broken build goes on where it stopped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import layout, overlap, selection
from millrace.operators.scan import prefix_sums
from millrace.operators.selection import Source
from millrace.session import cut, scratch

RESULT = "source string, split string, file_idx int, file string, budget long, filter string, exhausted boolean, n_tokens long, n_bytes long, n_docs long, n_docs_dropped_title long, n_docs_dropped_ngram long, shards array<struct<part:int,n_tokens:long,n_bytes:long,n_docs:long,n_docs_dropped_title:long,n_docs_dropped_ngram:long>>"


@dataclass(frozen=True)
class Build:
    """Where a build lies and what it does: ``encode`` turns the text column into arrays of ids."""

    out: str
    encode: object
    tag: str
    grams: DataFrame | None = None
    titles: DataFrame | None = None
    shard_tokens: int = 100_000_000
    val_shard_tokens: int = 1_000_000
    val_tokens: int = 5_000_000
    max_bytes: int = 1 << 62

    @property
    def tokens_path(self) -> str:
        return f"{self.out}/tokens"

    @property
    def results_path(self) -> str:
        return f"{self.out}/results"


def reasons(docs: DataFrame, source: Source, build: Build) -> DataFrame:
    """Drop reasons as a source wants them: titles only where it has them, n-grams everywhere."""
    return overlap.drop_reasons(docs, build.grams, build.titles if source.title_col else None)


def results(spark: SparkSession, build: Build) -> DataFrame:
    """What is done; an empty table before the first round."""
    try:
        return spark.read.schema(RESULT).parquet(build.results_path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], RESULT)
        raise


def run_jobs(spark: SparkSession, source: Source, jobs: DataFrame, build: Build, limit: int) -> None:
    """Tokenize the files of ``jobs`` (file, file_idx, split, budget) of one source, and record their totals.

    Jobs are one row a file; they meet the scan of just their files.
    """
    wanted = jobs.collect()
    if not wanted:
        return
    files = [r.file for r in wanted]
    scan = selection.read_source(spark, Source(source.name, files, source.text_col, source.min_int_score, source.title_col))
    rows = selection.select_docs(scan, source.min_int_score).withColumn("_place", F.concat_ws("#", "file", "row"))
    rows = reasons(rows, source, build).join(overlap.small(jobs), "file")
    kept = F.col("reason").isNull()
    rows = rows.withColumn("ids", F.when(kept, build.encode(F.when(kept, F.col("text")))))
    rows = rows.withColumn("n_bytes", F.when(kept, F.octet_length("text")).otherwise(0).cast("long"))
    # Encoding is the dear step: it runs once, into a table, and all that follows works on rows without texts or ids.
    path = f"{scratch(spark, 'build')}/encoded"
    keys = ["file", "file_idx", "split", "budget", "row"]
    rows.select(*keys, "ids", F.greatest(F.coalesce(F.size("ids"), F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"), "n_bytes", "reason").write.parquet(path)
    stored = spark.read.parquet(path)
    slim = stored.select(*keys, "n_tokens", "n_bytes", "reason")
    sums = prefix_sums(slim, {"_t": "n_tokens", "_b": "n_bytes"}, ["file"], ["row"])
    cut_rows = sums.where((F.col("_t") < F.col("budget")) & (F.col("_b") < build.max_bytes))
    also = ("file_idx", "split", "budget", "n_bytes", "reason")
    placed = cut(layout.pack_shards(cut_rows, limit, ["file"], "row", also=also).withColumn("source", F.lit(source.name)))
    tokens = stored.where("reason IS NULL").select("file", "row", "ids").join(placed.where("reason IS NULL").select("source", "split", "file_idx", "part", "file", "row"), ["file", "row"])
    tokens = tokens.select("source", "split", "file_idx", "part", "row", "ids")
    tokens.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "split", "file_idx").parquet(build.tokens_path)
    _record(placed.select("source", "split", "file_idx", "file", "budget", "part", "n_tokens", "n_bytes", "reason"), build)


def _record(placed: DataFrame, build: Build) -> None:
    """Append the totals of each file and its shards; drops after the last shard count to it."""
    by = ["source", "split", "file_idx", "file", "budget"]
    count = lambda when, name: F.count_if(when).alias(name)
    dropped = lambda r: F.coalesce(F.col("reason") == r, F.lit(False))
    last = F.max(F.when(F.col("reason").isNull(), F.col("part")))
    ends = placed.groupBy(*by).agg(last.alias("_last"))
    shard = placed.join(ends, by).withColumn("part", F.least("part", F.coalesce("_last", F.lit(0))))
    totals = [
        F.sum("n_tokens").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"), count(F.col("reason").isNull(), "n_docs"),
        count(dropped("title"), "n_docs_dropped_title"), count(dropped("ngram"), "n_docs_dropped_ngram"),
    ]
    names = ["n_tokens", "n_bytes", "n_docs", "n_docs_dropped_title", "n_docs_dropped_ngram"]
    each = shard.groupBy(*by, "part").agg(*totals).withColumn("shard", F.struct(F.col("part").cast("int").alias("part"), *names))
    listed = F.array_sort(F.collect_list(F.when(F.col("n_docs") > 0, F.col("shard"))))
    files = each.groupBy(*by).agg(listed.alias("shards"), *[F.sum(c).alias(c) for c in names])
    full: Column = (F.col("n_tokens") >= F.col("budget")) | (F.col("n_bytes") >= build.max_bytes)
    out = files.withColumn("exhausted", ~full).withColumn("filter", F.lit(build.tag))
    fields = [x.split(" ")[0] for x in RESULT.split(", ")]
    out.select(*[F.col(c) for c in fields]).coalesce(1).write.mode("append").parquet(build.results_path)


def tokenize_all(spark: SparkSession, sources: list[Source], files: DataFrame, targets: dict[str, int], build: Build, rounds: int = 99) -> list[str]:
    """Build until every source has its target or no file left; returns the sources that fall short.

    ``files``: (source, file, file_idx, split) of all sources, val and train. Validation files are taken
    whole up to ``val_tokens`` in the first round.
    """
    by_name = {s.name: s for s in sources}
    goal = spark.createDataFrame(list(targets.items()), "source string, target long")
    for turn in range(rounds):
        done = results(spark, build).where(F.col("filter") == build.tag)
        train = files.where("split = 'train'")
        count = train.groupBy("source").agg(F.count(F.lit(1)).alias("n_files"))
        plan = layout.plan_jobs(goal.join(count, "source"), done.where("split = 'train'").select("source", "n_tokens", "exhausted"))
        taken = done.select("source", "split", "file_idx")
        order = train.join(taken, ["source", "split", "file_idx"], "left_anti")
        place = F.row_number().over(Window.partitionBy("source").orderBy("file_idx"))
        jobs = order.withColumn("_n", place).join(plan, "source").where(F.col("_n") <= F.col("n_jobs")).select("source", "file", "file_idx", "split", "budget")
        if turn == 0:
            val = files.where("split = 'val'").withColumn("budget", F.lit(build.val_tokens).cast("long")).select("source", "file", "file_idx", "split", "budget")
            jobs = jobs.unionByName(layout.undone(val, done, build.tag))
        todo = jobs.collect()  # a round's jobs: one row a file
        if not todo:
            break
        for name in sorted({r.source for r in todo}):
            for split, limit in (("train", build.shard_tokens), ("val", build.val_shard_tokens)):
                own = [(r.file, r.file_idx, r.split, r.budget) for r in todo if r.source == name and r.split == split]
                if own:
                    run_jobs(spark, by_name[name], spark.createDataFrame(own, "file string, file_idx int, split string, budget long"), build, limit)
    have = {r.source: r.n for r in results(spark, build).where((F.col("split") == "train") & (F.col("filter") == build.tag)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    return sorted(s for s, t in targets.items() if have.get(s, 0) < t)


def manifest(spark: SparkSession, build: Build) -> DataFrame:
    """(source, split, ord, path, totals) of all shards, in order of file, then shard."""
    done = results(spark, build).where(F.col("filter") == build.tag)
    latest = done.groupBy("source", "split", "file_idx").agg(F.max_by("shards", "budget").alias("shards"))
    named = latest.withColumn("shards", F.transform("shards", lambda s: s.withField("path", F.format_string("%s_%s_%04d_%02d.bin", F.col("source"), F.col("split"), F.col("file_idx"), s["part"]))))
    return layout.manifest(named)


def shard_tokens(spark: SparkSession, build: Build) -> DataFrame:
    """(name, n_tokens, tokens) for the token-shard sink: a row a document, the rows of a shard in order in one partition."""
    rows = spark.read.parquet(build.tokens_path)
    name = F.format_string("%s_%s_%04d_%02d", "source", "split", F.col("file_idx").cast("int"), "part").alias("name")
    named = rows.select(name, "row", F.col("ids").alias("tokens"))
    totals = named.groupBy("name").agg(F.sum(F.size("tokens")).alias("n_tokens"))
    dealt = named.join(overlap.small(totals), "name").repartition("name").sortWithinPartitions("name", "row")
    return dealt.select("name", "n_tokens", "tokens")
