"""Manifests, job records and JSON tables."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import layout

ENTRY = "path string, n_tokens long, n_bytes long, n_docs long, n_docs_dropped_title long, n_docs_dropped_ngram long"


def read_manifest(spark: SparkSession, path: str, root: str) -> DataFrame:
    """The nested JSON manifest as (source, split, ord, path, counts); relative paths are resolved against ``root``.
    A file of another shape is an error."""
    whole = spark.read.text(path, wholetext=True)
    nested = whole.select(F.from_json("value", f"map<string, map<string, array<struct<{_fields()}>>>>", {"mode": "FAILFAST"}).alias("m"))
    sources = nested.select(F.explode("m").alias("source", "splits"))
    splits = sources.select("source", F.explode("splits").alias("split", "entries"))
    flat = splits.select("source", "split", F.posexplode("entries").alias("ord", "e")).select("source", "split", "ord", "e.*")
    return flat.withColumn("path", layout.resolved("path", root))


def _fields() -> str:
    return ", ".join(":".join(x.split()) for x in ENTRY.split(", "))


def write_manifest(entries: DataFrame, path: str, root: str) -> None:
    """The flat manifest as one nested JSON file that ``read_manifest`` reads: source, split, entries in order, their
    paths relative to ``root``. The output committer replaces the folder ``path`` as a whole."""
    known = [x.split()[0] for x in ENTRY.split(", ")]
    fields = [F.col(c) if c in entries.columns else F.lit(0).cast("long").alias(c) for c in known]
    own = entries.withColumn("path", layout.relative("path", root)).select("source", "split", "ord", F.struct(*fields).alias("e"))
    listed = own.groupBy("source", "split").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "e"))), lambda x: x["e"]).alias("entries"))
    pairs = lambda k, v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v))))
    by_source = listed.groupBy("source").agg(pairs("split", "entries").alias("splits"))
    whole = by_source.agg(F.map_from_entries(F.collect_list(F.struct("source", "splits"))).alias("m"))
    whole.select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """One record, as of an evaluation or a status, as JSON; the output committer replaces the folder ``path`` as a whole."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of a known schema; a path without files gives an empty table."""
    try:
        return spark.read.schema(schema).option("ignoreMissingFiles", "true").json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def append_log(log: DataFrame, path: str, attempt: int) -> None:
    """Append the steps of one attempt of a run as lines of JSON. Earlier lines stay: a run that resumes before its last step
    logs some steps again, which ``read_log`` tells apart by ``attempt``. An attempt that is written again after a failure replaces itself."""
    rows = log.withColumn("attempt", F.lit(attempt))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("attempt").json(path)


def read_log(spark: SparkSession, path: str, schema: str, by: list[str], step: str = "step") -> DataFrame:
    """The log of runs that may have been resumed: of each step what the last attempt has logged, and of a run nothing beyond
    where its last attempt began that this one has not reached again."""
    rows = read_json(spark, path, f"{schema}, attempt int")
    begun = rows.groupBy(*by, "attempt").agg(F.min(step).alias("_from"))
    later = begun.select(*(F.col(c).alias(f"_of_{c}") for c in by), F.col("attempt").alias("_later"), "_from")
    same = [rows[c].eqNullSafe(later[f"_of_{c}"]) for c in by]
    # A line counts unless a later attempt began at or before its step: what that one has not logged again was lost.
    return rows.join(F.broadcast(later) if later.count() <= layout.SMALL else later, [*same, later["_later"] > rows["attempt"], later["_from"] <= rows[step]], "left_anti")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
