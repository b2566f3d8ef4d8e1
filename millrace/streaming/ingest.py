"""Resumable ingestion: new parquet files of a folder are selected, filtered and appended, each exactly once.

The query runs through all files that are there and stops; its checkpoint remembers them, so running it again
takes only what has come since. The overlap filter joins the stream with a static table of known grams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.overlap import flags
from millrace.operators.selection import select_docs


def run(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, grams: DataFrame | None = None, files_per_batch: int = 64) -> None:
    """Append the kept documents of ``source`` to ``target`` with their byte counts, and stop."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def batch(rows: DataFrame, number: int) -> None:
        docs = select_docs(rows).withColumn("n_bytes", F.octet_length("text").cast("long"))
        if grams is not None:
            docs = flags(docs, grams).where("NOT flagged").drop("flagged")
        # A batch that is run again after a failure replaces its own folder.
        docs.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
