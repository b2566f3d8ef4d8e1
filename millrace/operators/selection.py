"""Source registry, document selection, file splits, budgets and byte-bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import scan
from millrace.session import fresh


@dataclass(frozen=True)
class Source:
    """Where a source's parquet files lie, its text column, and the least score of its rows, if any."""

    name: str
    path_glob: str | list[str]
    text_col: str = "text"
    min_int_score: int | None = None
    title_col: str | None = None


def glob_regex(pattern: str) -> str:
    """A file pattern as a regular expression: case-sensitive, and ``*`` crosses ``/``."""
    out = {"*": ".*", "?": "."}
    return "^(?s:" + "".join(out.get(c, "\\" + c if c in r"\.^$+{}()|[]" else c) for c in pattern) + r")\z"


def list_files(listing: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """The matching paths, in order."""
    return listing.where(F.col(path).rlike(glob_regex(pattern))).orderBy(path)


def read_source(spark: SparkSession, source: Source) -> DataFrame:
    """The rows of a source's files with their order: (file, row, text, and score and title where known)."""
    df = spark.read.parquet(*([source.path_glob] if isinstance(source.path_glob, str) else source.path_glob))
    columns = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(source.text_col).alias("text")]
    if source.min_int_score is not None:
        columns.append(F.col("int_score"))
    if source.title_col is not None:
        columns.append(F.col(source.title_col).alias("title"))
    return df.select(*columns)


def select_docs(docs: DataFrame, min_score: int | None = None, text: str = "text", score: str = "int_score") -> DataFrame:
    """Rows of at least ``min_score`` (null scores go), then rows with a text; white space counts as text."""
    out = docs if min_score is None else docs.where(F.col(score) >= min_score)
    return out.where(F.length(text) > 0)


def split_files(files: DataFrame, hq_files: int, by: str = "source", path: str = "path") -> DataFrame:
    """Each file with ``split``: the last is "val", the ``hq_files`` before it "hq", earlier ones "train".

    A source without a file before those is an error, as nothing would be left to train on.
    """
    w = Window.partitionBy(by)
    place = F.row_number().over(w.orderBy(F.col(path).desc()))
    total = F.count(F.lit(1)).over(w)
    short = F.raise_error(F.concat(F.lit("too few files in "), F.col(by)))
    split = F.when(total <= hq_files, short).when(place == 1, "val").when(place <= hq_files + 1, "hq").otherwise("train")
    return files.withColumn("file_idx", (total - place).cast("int")).withColumn("split", split)


def prefix_sum(value: Column | str, by: list[str], order: list[str]) -> Column:
    """The sum of the rows before this one, by a window: for groups of few rows, as of a manifest. ``scan.prefix_sums`` takes any."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def cut_budget(docs: DataFrame, budgets: dict[str, int], by: list[str], order: list[str], kept: Column | None = None) -> DataFrame:
    """Rows up to a budget: a row stays while the totals before it are below every budget.

    Rows that ``kept`` refuses add nothing to the totals; they stay, for accounting, up to the cut. Totals run over groups of
    any size, in blocks; pass rows without their texts.
    """
    kept = F.lit(True) if kept is None else kept
    before = {fresh(docs, f"_before{i}"): F.when(kept, F.col(column)).otherwise(0) for i, column in enumerate(budgets)}
    out = scan.prefix_sums(docs, before, by, order)
    for name, budget in zip(before, budgets.values(), strict=True):
        out = out.where(F.col(name) < budget)
    return out.drop(*before)


def exhausted(docs: DataFrame, budgets: dict[str, int], by: list[str]) -> DataFrame:
    """Per group whether its files end before a budget is full; a budget filled by the last row counts as full."""
    full = [F.sum(c) >= b for c, b in budgets.items()]
    over = full[0]
    for x in full[1:]:
        over = over | x
    return docs.groupBy(*by).agg((~over).alias("exhausted"))


def sample_bytes(docs: DataFrame, n_bytes: int | DataFrame, source: list[str], file: str, order: list[str], batch_rows: int = 1024) -> DataFrame:
    """Whole scan batches, file by file, while the bytes of the source's batches before are below ``n_bytes``: one budget
    for every source, or a table (source, n_bytes) as a mix of sources gives them; a source that it lacks gives no rows.

    Batches are ``batch_rows`` rows of a file before any filter. Their sizes are summed first, so the window over a
    source has one row a batch, and only batch numbers are joined back.
    """
    by = [*source, file]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    tagged = docs.withColumn("batch", F.floor(place / batch_rows).cast("long"))
    sizes = tagged.groupBy(*by, "batch").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("_bytes"))
    sizes = sizes.withColumn("_before", prefix_sum("_bytes", source, [file, "batch"]))
    chosen = sizes.where(F.col("_before") < n_bytes) if isinstance(n_bytes, int) else sizes.join(n_bytes, source).where(F.col("_before") < F.col("n_bytes"))
    return tagged.join(chosen.select(*by, "batch"), [*by, "batch"], "left_semi")
