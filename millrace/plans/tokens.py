"""Queries on pre-tokenization, encoding and item texts. SQL engines lack the pattern's look-ahead, so the
first two have no SQL; tests hold them against the tokenizers library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import tokenize
from millrace.operators import layout, mixture, scan
from millrace.session import cut, spread, table

BOS = 50256
SHARD_IDS, WINDOW, RUN, SEED = 5000, 64, 256, 3


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def piece_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.piece_counts(_texts(spark, d))


def encoded_docs(spark: SparkSession, d: str) -> DataFrame:
    encode = tokenize.encoder(spark, vocabulary(), BOS)
    ids = _texts(spark, d).select("doc_id", encode("text").alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), tokenize.digest("ids").alias("ids_sha"))


def decoded_docs(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each document after encoding and decoding, which must give it back."""
    source = vocabulary()
    encode, decode = tokenize.encoder(spark, source), tokenize.decoder(spark, source)
    return _texts(spark, d).select("doc_id", F.sha2(decode(encode("text")), 256).alias("text_sha"))


def decoded_windows(spark: SparkSession, d: str) -> DataFrame:
    """Two seeded windows of each source's shards of ids, as text: documents are encoded, packed into shards of ``SHARD_IDS``,
    and the windows' ids gathered from runs of ``RUN`` and decoded. Sources whose ids do not fill a window have none."""
    source = vocabulary()
    encode, decode = tokenize.encoder(spark, source, BOS), tokenize.decoder(spark, source)
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    ids = cut(docs.select("source", "doc_id", encode("text").alias("ids")).withColumn("n_tokens", F.size("ids").cast("long")))
    packed = layout.pack_shards(ids.drop("ids"), SHARD_IDS, ["source"], "doc_id")
    packed = cut(scan.prefix_sums(packed, {"at": "n_tokens"}, ["source", "part"], ["doc_id"]).withColumn("path", F.format_string("%s_%04d.bin", "source", "part")))
    entries = packed.groupBy("source", "path", F.col("part").alias("ord")).agg(F.sum("n_tokens").alias("n_tokens")).where(F.col("n_tokens") > WINDOW)
    drawn = layout.random_windows(entries, WINDOW, SEED, 2)
    # Only the windows' shards are cut into runs, a document's ids after the other's.
    own = packed.join(drawn.select("path").distinct(), "path", "left_semi").join(ids.select("source", "doc_id", "ids"), ["source", "doc_id"])
    spots = own.select("path", "at", F.posexplode("ids").alias("i", "id")).select("path", (F.col("at") + F.col("i")).alias("place"), "id")
    runs = spots.groupBy("path", (F.floor(F.col("place") / RUN) * RUN).alias("start")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("tokens"))
    met = mixture.gather(drawn.select(F.col("k").alias("step"), F.col("source").alias("row"), "path", "start"), runs, WINDOW, RUN)
    return met.select(F.col("row").alias("source"), F.col("step").cast("long").alias("k"), "path", F.col("start").cast("long").alias("start"), decode("x").alias("text"))


def item_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as items of all four kinds, with two words as candidates; every "the" is the blank of a fill-in item."""
    text, a, b = F.col("text"), F.lit("a").alias("a"), F.lit("this").alias("b")
    rows = {
        "endings": F.struct(text.alias("ctx"), F.array(a, b).alias("endings")),
        "choices": F.struct(text.alias("question"), F.struct(F.array(a, b).alias("text")).alias("choices")),
        "solutions": F.struct(text.alias("goal"), a.alias("sol1"), b.alias("sol2")),
        "blank": F.struct(F.regexp_replace(text, r"\bthe\b", "_").alias("sentence"), a.alias("option1"), b.alias("option2")),
    }
    items = table(spark, d, "benchmark")
    parts = [items.select("item_id", F.lit(kind).alias("kind"), F.posexplode(T.item_texts(kind, row)).alias("place", "t")) for kind, row in rows.items()]
    texts = reduce(DataFrame.unionByName, parts)
    return texts.select("item_id", "kind", F.col("place").cast("long").alias("place"), F.sha2("t", 256).alias("sha"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(T.words("text")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (piece_counts, encoded_docs, decoded_docs, decoded_windows, item_candidates, word_counts)}
ORACLE_SQL = {
    "decoded_docs": "SELECT doc_id, sha256(text) AS text_sha FROM documents",
    "item_candidates": """WITH o AS (SELECT item_id, text, place, CASE place WHEN 0 THEN 'a' ELSE 'this' END AS x FROM benchmark, range(2) r(place))
SELECT item_id, kind, place, sha256(CASE kind WHEN 'blank' THEN replace(regexp_replace(text, '\\bthe\\b', '_', 'g'), '_', x) ELSE text || ' ' || x END) AS sha
FROM o, (VALUES ('endings'), ('choices'), ('solutions'), ('blank')) k(kind)""",
    "word_counts": "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) GROUP BY word",
}
