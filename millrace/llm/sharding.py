"""Extendible-hash sharding, on DataFrame functions only.

Every row hashes to a bit string. The directory starts with one bucket; a bucket whose rows exceed the
byte limit splits on its next bit, others stay, so shards lie at different depths and each fits the
limit. The directory is never collected: byte totals are gathered for ``STEP`` bits at a time as a
table, rolled up to every shallower prefix, and each row takes the shallowest prefix that fits. Rows of
buckets that are still too large go through the next ``STEP`` bits.

Edge cases
* null or empty text: 0 bytes, the row is still assigned.
* null id: hashed as the empty string.
* one row larger than the limit: it ends alone in a shard of its own, the only kind above the limit.
* rows that share an id share all bits of the first hash. If such rows alone exceed the limit, they go on
  splitting on a second hash of id, text and row position, so they spread too.
* an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

LIMIT_BYTES = 32 << 20
BITS = 56
STEP = 8


def _bits(text: Column) -> Column:
    """The first BITS bits of a string's MD5."""
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, BITS // 4), 16, 10).cast("bigint")


def _leaves(rows: DataFrame, depth: int, limit: int) -> DataFrame:
    """For each prefix of ``depth + STEP`` bits: the leaf that holds it, or null if it must split on."""
    deep = depth + STEP
    fine = rows.groupBy("base", F.shiftright("h", BITS - deep).alias("p")).agg(
        F.sum("n_bytes").alias("b"), F.sum(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")
    )
    levels = [F.struct(F.lit(d).alias("d"), F.shiftright("p", deep - d).alias("q")) for d in range(depth + (depth > 0), deep + 1)]
    tall = fine.select("*", F.explode(F.array(*levels)).alias("v")).select("base", "p", "b", "n", "lo", "hi", "v.d", "v.q")
    bucket = tall.groupBy("base", "d", "q").agg(
        F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), (F.min("lo") == F.max("hi")).alias("one_hash")
    )
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | F.lit(deep == BITS) & (F.col("d") == BITS)
    leaf = F.min(F.when(fits, F.struct("d", "q", "shard_bytes", "shard_docs"))).alias("leaf")
    return tall.select("base", "p", "d", "q").join(bucket, ["base", "d", "q"]).groupBy("base", "p").agg(leaf, F.max_by("one_hash", "d").alias("one_hash"))


def _binary(value: Column, width: Column | int) -> Column:
    return F.lpad(F.conv(value.cast("string"), 10, 2), width, F.lit("0"))


def _split(rows: DataFrame, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The placed rows, and the rows of buckets that hold one hash only and are too large."""
    depth, done, stuck, given = 0, [], [], rows.columns
    carried = [c for c in given if c not in ("h", "h2", "base")]
    while True:
        deep = depth + STEP
        placed = cut(rows.withColumn("p", F.shiftright("h", BITS - deep)).join(_leaves(rows, depth, limit), ["base", "p"]))
        label = F.concat("base", F.when(F.col("leaf.d") > 0, _binary(F.col("leaf.q"), F.col("leaf.d"))).otherwise(F.lit("")))
        depth_of = F.length(F.translate(label, "bx", "")).cast("int")
        done.append(placed.where("leaf IS NOT NULL").select(*carried, label.alias("shard_id"), depth_of.alias("depth"), "leaf.shard_bytes", "leaf.shard_docs"))
        rest = placed.where("leaf IS NULL")
        stuck.append(rest.where("one_hash").select(*given))
        rows, depth = rest.where("NOT one_hash").select(*given), deep
        if deep == BITS or rows.isEmpty():
            return done, stuck


def assign(docs: DataFrame, limit_bytes: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, shard_id, depth, shard_bytes, shard_docs; with ``whole`` also the row
    itself, as a struct ``doc``.

    ``shard_id`` is ``b`` and the prefix bits; rows of one over-large id carry the bits of their second
    hash after an ``x``.
    """
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        _bits(ident).alias("h"),
        F.struct(F.xxhash64(text).alias("text"), F.monotonically_increasing_id().alias("row")).alias("h2"),
        F.lit("b").alias("base"),
        *([F.struct(*docs.columns).alias("doc")] if whole else []),
    )
    done, stuck = _split(cut(rows), limit_bytes)
    again = reduce(DataFrame.unionByName, stuck)
    if not again.isEmpty():
        second = _bits(F.concat_ws(":", F.col("h2.text"), F.col("h2.row")))
        done += _split(cut(again.withColumns({"base": F.concat("base", _binary(F.col("h"), BITS), F.lit("x")), "h": second})), limit_bytes)[0]
    return reduce(DataFrame.unionByName, done)


def write_shards(docs: DataFrame, path: str, limit_bytes: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows under ``path``, one ``shard_id=...`` folder a shard. Rows travel with their shard, so null and
    repeated ids are written as often as they occur; a column ``shard_id`` of the input gives way to the folder's."""
    placed = assign(docs, limit_bytes, id_col, text_col, whole=True)
    columns = [F.col("doc")[c].alias(c) for c in docs.columns if c.lower() != "shard_id"]
    placed.select(*columns, "shard_id").repartition("shard_id").write.partitionBy("shard_id").parquet(path)


def oracle_sql(limit: int) -> str:
    """The query as SQL for shards of at most ``limit`` bytes; ids must be unique and not null there."""
    return f"""
WITH RECURSIVE r AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS // 4}) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT r.*, d, CAST(sum(n_bytes) OVER w AS BIGINT) AS shard_bytes, count(*) OVER w AS shard_docs
  FROM r, range(0, 25) t(d) WINDOW w AS (PARTITION BY d, h >> ({BITS} - d))),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS k FROM s WHERE shard_bytes <= {limit} OR shard_docs = 1)
SELECT doc_id, n_bytes,
       'b' || CASE WHEN d > 0 THEN lpad(bin(h >> ({BITS} - d)), CAST(d AS INT), '0') ELSE '' END AS shard_id,
       CAST(d AS INT) AS depth, shard_bytes, shard_docs
FROM f WHERE k = 1
"""
