"""Session helpers: shared storage, shipping the package, and table access."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows that go to Python at once: documents can be long, and the default of 10,000 of them need not fit.
ARROW_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ROOT = Path(__file__).resolve().parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory, read lazily by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores, where it comes in fewer, as a small file of one row group does; for work
    that is dear row by row. Whatever has enough partitions is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset, a local session takes a folder of
    its machine, and any other is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/millrace-checkpoints"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, to write tables under that several steps read; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not, whatever the case of its names: ``name`` after as many underscores as that takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, computed once."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the executors' Python once per application, and bound the batches it gets."""
    if int(spark.conf.get(_ROWS)) > ARROW_ROWS:
        spark.conf.set(_ROWS, ARROW_ROWS)
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return spark
    files = sorted(_ROOT.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]
    target = os.path.join(tempfile.mkdtemp(prefix="millrace-"), f"millrace-{digest}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, os.path.join("millrace", p.relative_to(_ROOT)))
    sc.addPyFile(target)
    sc._millrace_shipped = True
    return spark
