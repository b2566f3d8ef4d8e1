"""Queries on selection, splits, budgets, shards, manifests and planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import layout, overlap, selection
from millrace.plans.overlap import _FOUND, _STREAM, _WORDS
from millrace.session import table

SHARD_TOKENS, BUDGET_TOKENS, BUDGET_BYTES = 5000, 9000, 80_000
SAMPLE_BYTES, MIX_BYTES, BATCH_ROWS = 100_000, 700, 8
HQ_FILES, SPLIT_TARGET = 6, 12_000
VAL_TOKENS = 60_000
#: The tables have no files: so many ids of a source stand in for one, which bounds whatever runs file by file.
FILE_IDS = 100_000
FILE = ["source", "file_idx"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with counts; a word of the overlap test stands in for a token."""
    docs = table(spark, d, "documents")
    words = F.size(T.words("text")).cast("long")
    file = F.floor(F.col("doc_id") / FILE_IDS).cast("long").alias("file_idx")
    return docs.select("doc_id", "source", file, "text", (words + 1).alias("n_tokens"), F.octet_length("text").cast("long").alias("n_bytes"))


def select_scored_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("int_score")), "doc_id", "left")
    return selection.select_docs(docs, 1).select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"))


def file_splits(spark: SparkSession, d: str) -> DataFrame:
    """Each document's id, padded, stands in for a file name of its source."""
    files = table(spark, d, "documents").select("source", F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".parquet")).alias("path"))
    return selection.split_files(files, HQ_FILES)


def list_source_files(spark: SparkSession, d: str) -> DataFrame:
    listing = table(spark, d, "pages").select(F.concat(F.regexp_extract("url", "^https?://(.*)$", 1), F.lit(".parquet")).alias("path"))
    return selection.list_files(listing, "*/en/*.parquet").distinct()


def budget_cut(spark: SparkSession, d: str) -> DataFrame:
    slim = _docs(spark, d).drop("text")
    return selection.cut_budget(slim, {"n_tokens": BUDGET_TOKENS, "n_bytes": BUDGET_BYTES}, FILE, ["doc_id"]).select("doc_id", "source", "n_tokens", "n_bytes")


def budget_exhausted(spark: SparkSession, d: str) -> DataFrame:
    return selection.exhausted(_docs(spark, d), {"n_tokens": BUDGET_TOKENS, "n_bytes": BUDGET_BYTES}, FILE)


def byte_sample(spark: SparkSession, d: str) -> DataFrame:
    return selection.sample_bytes(_docs(spark, d), SAMPLE_BYTES, ["source"], "file_idx", ["doc_id"], BATCH_ROWS).select("doc_id", "batch")


def mix_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample for a tokenizer: each source in proportion to its documents, ``MIX_BYTES`` for each of them."""
    docs = _docs(spark, d)
    budgets = docs.groupBy("source").agg((F.count(F.lit(1)) * MIX_BYTES).alias("n_bytes"))
    return selection.sample_bytes(docs, budgets, ["source"], "file_idx", ["doc_id"], BATCH_ROWS).select("doc_id", "source", "batch")


def packed(spark: SparkSession, d: str) -> DataFrame:
    """(source, file_idx, doc_id, n_tokens, part, n_bytes) of every document."""
    docs = _docs(spark, d).select(*FILE, "doc_id", "n_tokens", "n_bytes")
    return layout.pack_shards(docs, SHARD_TOKENS, FILE, "doc_id", also=("n_bytes",)).withColumn("part", F.col("part").cast("long"))


def packed_shards(spark: SparkSession, d: str) -> DataFrame:
    return packed(spark, d).select("doc_id", *FILE, "part")


def _path() -> Column:
    return F.format_string("%s_%04d_%02d.bin", "source", "file_idx", "part")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of the packed shards: each source's last shard is its validation split."""
    totals = layout.shard_totals(packed(spark, d), FILE)
    w = Window.partitionBy("source")
    totals = totals.withColumn("ord", F.row_number().over(w.orderBy("file_idx", "part")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    split = F.when(F.col("ord") == F.col("n") - 1, "val").otherwise("train")
    return totals.select("source", split.alias("split"), F.col("ord").cast("long").alias("ord"), _path().alias("path"), "n_tokens", "n_bytes", "n_docs")


def manifest_entries(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d)


def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "documents").select("source").distinct().select("source", F.lit("train").alias("split"), F.lit(SPLIT_TARGET).cast("long").alias("target"))
    out = layout.check_report(_entries(spark, d), targets)
    return out.withColumns({"ratio": F.round("ratio", 9), "bytes_per_token": F.round("bytes_per_token", 9)})


def source_progress(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold benchmark text count as dropped from the shard that they would have been in."""
    targets = table(spark, d, "documents").select("source").distinct().withColumn("target", F.lit(SPLIT_TARGET).cast("long"))
    grams = overlap.stream_grams(table(spark, d, "benchmark"), "item_id")
    hit = overlap.flags(table(spark, d, "documents").select("doc_id", "text"), grams).where("flagged").select("doc_id")
    dropped = packed(spark, d).join(hit, "doc_id").groupBy(*FILE, "part").agg(F.count(F.lit(1)).alias("n_docs_dropped"))
    entries = _entries(spark, d).join(dropped.select(_path().alias("path"), "n_docs_dropped"), "path", "left")
    return layout.progress(targets, entries.select("source", "split", F.col("ord").alias("file_idx"), "n_tokens", F.coalesce("n_docs_dropped", F.lit(0)).alias("n_docs_dropped")))


def job_plan(spark: SparkSession, d: str) -> DataFrame:
    """All sources but one have finished two shards, of which the first was read to its end; that one starts."""
    entries = _entries(spark, d)
    results = entries.where("ord < 2 AND source != 'src0'").select("source", "n_tokens", (F.col("ord") == 0).alias("exhausted"))
    targets = entries.groupBy("source").agg(F.count(F.lit(1)).alias("n_files")).withColumn("target", F.lit(4 * SPLIT_TARGET).cast("long"))
    return layout.plan_jobs(targets, results)


def val_quota(spark: SparkSession, d: str) -> DataFrame:
    mix = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return layout.val_shards(_entries(spark, d), mix, VAL_TOKENS).select("source", "ord", "n_tokens")


def random_windows(spark: SparkSession, d: str) -> DataFrame:
    """Three windows of each source's train shards."""
    return layout.random_windows(_entries(spark, d).where("split = 'train'"), 64, 1).select("source", F.col("k").cast("long").alias("k"), "path", "start")


def shuffled_files(spark: SparkSession, d: str) -> DataFrame:
    """A seeded order of the pages of each site; pages stand in for files."""
    pages = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("site"), "url")
    return layout.shuffled(pages.distinct(), 7, ["site"], "url").select("site", "url", F.col("place").cast("long").alias("place"))


def split_sharing(spark: SparkSession, d: str) -> DataFrame:
    """Texts stand in for files and sources for splits: copies lie in more than one."""
    docs = table(spark, d, "documents").select("lang", F.md5("text").alias("path"), F.col("source").alias("split"))
    return layout.split_sharing(docs, "lang")


_DOCS = f"docs AS (SELECT doc_id, source, doc_id // {FILE_IDS} AS file_idx, len(regexp_extract_all(lower(text), '[a-z0-9]+')) + 1 AS n_tokens, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents)"
_PACK = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY source, file_idx ORDER BY doc_id) AS r FROM docs),
fold AS (
  SELECT source, file_idx, r, doc_id, n_tokens, n_bytes, CAST(0 AS BIGINT) AS part, CAST(n_tokens AS BIGINT) AS run FROM numbered WHERE r = 1
  UNION ALL
  SELECT n.source, n.file_idx, n.r, n.doc_id, n.n_tokens, n.n_bytes, f.part + CASE WHEN f.run >= {SHARD_TOKENS} THEN 1 ELSE 0 END, CASE WHEN f.run >= {SHARD_TOKENS} THEN 0 ELSE f.run END + n.n_tokens
  FROM fold f JOIN numbered n ON n.source = f.source AND n.file_idx = f.file_idx AND n.r = f.r + 1)"""
_ENTRY = """shards AS (SELECT source, file_idx, part, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM fold GROUP BY ALL),
entries AS (SELECT source, CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY source) THEN 'val' ELSE 'train' END AS split, row_number() OVER w - 1 AS ord,
  format('{}_{:04d}_{:02d}.bin', source, file_idx, part) AS path, n_tokens, n_bytes, n_docs FROM shards WINDOW w AS (PARTITION BY source ORDER BY file_idx, part))"""
_ALL = f"WITH RECURSIVE {_DOCS}, {_PACK}, {_ENTRY}"

QUERIES = {
    f.__name__: f
    for f in (select_scored_docs, file_splits, list_source_files, budget_cut, budget_exhausted, byte_sample, mix_sample, packed_shards, manifest_entries, manifest_check, source_progress, job_plan, val_quota, random_windows, shuffled_files, split_sharing)
}
ORACLE_SQL = {
    "select_scored_docs": "SELECT doc_id, source, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents JOIN labels USING (doc_id) WHERE quality >= 1 AND length(text) > 0",
    "file_splits": f"""WITH f AS (SELECT source, source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.parquet' AS path FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY path DESC) AS k, count(*) OVER (PARTITION BY source) AS c FROM f)
SELECT source, path, CAST(c - k AS INT) AS file_idx, CASE WHEN k = 1 THEN 'val' WHEN k <= {HQ_FILES + 1} THEN 'hq' ELSE 'train' END AS split FROM n""",
    "list_source_files": "SELECT DISTINCT path FROM (SELECT regexp_extract(url, '^https?://(.*)$', 1) || '.parquet' AS path FROM pages) WHERE path GLOB '*/en/*.parquet'",
    "budget_cut": f"""WITH {_DOCS}, s AS (SELECT *, coalesce(sum(n_tokens) OVER w, 0) AS t, coalesce(sum(n_bytes) OVER w, 0) AS b FROM docs
  WINDOW w AS (PARTITION BY source, file_idx ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, source, n_tokens, n_bytes FROM s WHERE t < {BUDGET_TOKENS} AND b < {BUDGET_BYTES}""",
    "budget_exhausted": f"WITH {_DOCS} SELECT source, file_idx, NOT (sum(n_tokens) >= {BUDGET_TOKENS} OR sum(n_bytes) >= {BUDGET_BYTES}) AS exhausted FROM docs GROUP BY source, file_idx",
    "byte_sample": f"""WITH {_DOCS}, t AS (SELECT *, (row_number() OVER (PARTITION BY source, file_idx ORDER BY doc_id) - 1) // {BATCH_ROWS} AS batch FROM docs),
s AS (SELECT source, file_idx, batch, sum(n_bytes) AS b FROM t GROUP BY ALL),
p AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY source ORDER BY file_idx, batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT doc_id, batch FROM t JOIN p USING (source, file_idx, batch) WHERE before < {SAMPLE_BYTES}""",
    "mix_sample": f"""WITH {_DOCS}, t AS (SELECT *, (row_number() OVER (PARTITION BY source, file_idx ORDER BY doc_id) - 1) // {BATCH_ROWS} AS batch FROM docs),
s AS (SELECT source, file_idx, batch, sum(n_bytes) AS b FROM t GROUP BY ALL),
p AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY source ORDER BY file_idx, batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
q AS (SELECT source, count(*) * {MIX_BYTES} AS budget FROM docs GROUP BY source)
SELECT doc_id, source, batch FROM t JOIN p USING (source, file_idx, batch) JOIN q USING (source) WHERE before < budget""",
    "packed_shards": f"WITH RECURSIVE {_DOCS}, {_PACK} SELECT doc_id, source, file_idx, part FROM fold",
    "manifest_entries": f"{_ALL} SELECT * FROM entries",
    "manifest_check": f"""{_ALL}, t AS (SELECT source, split, count(*) AS n_shards, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(sum(n_docs) AS BIGINT) AS n_docs, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM entries GROUP BY ALL)
SELECT *, CAST(CASE WHEN split = 'train' THEN {SPLIT_TARGET} ELSE 0 END AS BIGINT) AS target, round(n_tokens / greatest(1, CASE WHEN split = 'train' THEN {SPLIT_TARGET} ELSE 0 END), 9) AS ratio,
       round(n_bytes / greatest(1, n_tokens), 9) AS bytes_per_token FROM t""",
    "source_progress": f"""{_ALL}, {_WORDS}{_STREAM}{_FOUND}, hit AS (SELECT source, count(*) AS n_docs_dropped FROM documents WHERE doc_id IN (SELECT doc_id FROM found) GROUP BY source)
SELECT source, CAST({SPLIT_TARGET} AS BIGINT) AS target, count(DISTINCT CASE WHEN split = 'train' THEN ord END) AS n_files,
  CAST(coalesce(sum(n_tokens) FILTER (WHERE split = 'train'), 0) AS BIGINT) AS train_tokens, CAST(coalesce(sum(n_tokens) FILTER (WHERE split = 'val'), 0) AS BIGINT) AS val_tokens,
  coalesce(any_value(n_docs_dropped), 0) AS n_docs_dropped FROM entries LEFT JOIN hit USING (source) GROUP BY source""",
    "job_plan": f"""{_ALL}, r AS (SELECT source, sum(n_tokens) AS have, count(*) AS n_done, coalesce(avg(n_tokens) FILTER (WHERE ord = 0), avg(n_tokens)) AS mean FROM entries WHERE ord < 2 AND source != 'src0' GROUP BY source),
t AS (SELECT source, count(*) AS n_files, {4 * SPLIT_TARGET} AS target FROM entries GROUP BY source),
j AS (SELECT source, target - coalesce(have, 0) AS rest, n_files - coalesce(n_done, 0) AS l, have, mean FROM t LEFT JOIN r USING (source)),
k AS (SELECT source, rest, CASE WHEN have IS NULL THEN 1 ELSE least(l, CAST(ceil(rest / greatest(1.0, CAST(0.9 AS DOUBLE) * mean)) AS BIGINT)) END AS n_jobs FROM j WHERE rest > 0 AND l > 0)
SELECT source, CAST(n_jobs AS BIGINT) AS n_jobs, CAST(ceil(rest / n_jobs) AS BIGINT) AS budget FROM k""",
    "val_quota": f"""{_ALL}, m AS (SELECT source, count(*) AS w FROM documents GROUP BY source),
b AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM entries)
SELECT source, ord, n_tokens FROM b JOIN m USING (source) WHERE before < CAST({VAL_TOKENS} AS DOUBLE) * w / (SELECT sum(w) FROM m)""",
    "random_windows": f"""{_ALL}, t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) - 1 AS s FROM entries WHERE split = 'train'),
k AS (SELECT source, k, CAST('0x' || substr(md5('1|shard|' || source || '|' || k), 1, 8) AS BIGINT) % count(*) AS s FROM t, range(3) r(k) GROUP BY source, k)
SELECT source, k, path, CAST('0x' || substr(md5('1|start|' || source || '|' || k), 1, 8) AS BIGINT) % greatest(1, n_tokens - 64) AS start FROM k JOIN t USING (source, s)""",
    "shuffled_files": """WITH p AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS site, url FROM pages)
SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY md5('7|' || url), url) - 1 AS place FROM p""",
    "split_sharing": """SELECT lang, count(*) AS n_files, count(*) FILTER (WHERE n > 1) AS n_shared
FROM (SELECT lang, md5(text) AS path, count(DISTINCT source) AS n FROM documents GROUP BY ALL) GROUP BY lang""",
}
