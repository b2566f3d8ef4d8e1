"""Queries on overlap with the benchmark: flags, reports, drop reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import overlap
from millrace.session import spread, table


def _grams(spark: SparkSession, d: str) -> DataFrame:
    return overlap.stream_grams(table(spark, d, "benchmark"), "item_id")


def overlap_by_source(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    found = overlap.matches(docs, _grams(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    out = docs.select("doc_id", "source").join(found, "doc_id", "left").groupBy("source")
    return out.agg(F.count(F.lit(1)).alias("n_docs"), F.count("n").alias("n_flagged"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_doc_grams"))


def overlap_flagged_docs(spark: SparkSession, d: str) -> DataFrame:
    return overlap.matches(table(spark, d, "documents"), _grams(spark, d)).select("doc_id").distinct()


def overlap_scan_totals(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return overlap.scan_totals(docs, overlap.matches(docs, _grams(spark, d)))


def overlap_report(spark: SparkSession, d: str) -> DataFrame:
    grams = _grams(spark, d)
    out = overlap.report(grams, overlap.matches(table(spark, d, "documents"), grams))
    return out.withColumn("frac_ngrams_matched", F.round("frac_ngrams_matched", 9))


def _items(spark: SparkSession, d: str) -> DataFrame:
    # The table has no benchmark names: the first letter of an item stands in for one.
    return table(spark, d, "benchmark").withColumn("bench", F.lower(F.substring("text", 1, 1)))


def overlap_bench_report(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    grams = overlap.union_grams(overlap.item_grams(items, "item_id"))
    out = overlap.item_report(items, overlap.matches(table(spark, d, "documents"), grams))
    return out.withColumns({c: F.round(c, 9) for c in ("frac_ngrams_matched", "frac_items_hit")})


def _reasons(spark: SparkSession, d: str) -> DataFrame:
    # Documents have no titles: their first line stands in for one, and page titles for the known ones.
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text")).select("*", F.substring_index("text", "\n", 1).alias("title"))
    titles = table(spark, d, "pages").select(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))
    return overlap.drop_reasons(docs, _grams(spark, d), titles)


def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _reasons(spark, d).select("doc_id", "reason")


def drop_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.drop_counts(_reasons(spark, d), "source")


_WORDS = """
dw AS (SELECT doc_id, source, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents),
dg AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+12], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM dw)),
"""
_STREAM = """
bw AS (SELECT regexp_extract_all(lower(string_agg(text, ' ' ORDER BY item_id)), '[a-z0-9]+') AS ws FROM benchmark),
grams AS (SELECT DISTINCT array_to_string(ws[i:i+12], ' ') AS gram FROM (SELECT ws, unnest(range(1, len(ws) - 11)) AS i FROM bw)),
"""
_FOUND = "found AS (SELECT doc_id, gram FROM dg JOIN grams USING (gram))"
_KEY = """lower(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(trim(regexp_replace({0}, '\\s+', ' ', 'g')),
  ' @-@ ', '-'), ' @,@ ', ','), ' @.@ ', '.'), ' ([,.;:!?)\\]''])', '\\1', 'g'), '([(\\[]) ', '\\1', 'g'), ' ?([-–—]) ?', '\\1', 'g'))"""
_REASON = f"""
keys AS (SELECT DISTINCT replace({_KEY.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")}, 'ß', 'ss') AS k FROM pages),
reasons AS (SELECT doc_id, source, CASE WHEN replace({_KEY.format("split_part(text, chr(10), 1)")}, 'ß', 'ss') IN (SELECT k FROM keys) THEN 'title'
  WHEN doc_id IN (SELECT doc_id FROM found) THEN 'ngram' END AS reason FROM documents)
"""

QUERIES = {f.__name__: f for f in (overlap_by_source, overlap_flagged_docs, overlap_scan_totals, overlap_report, overlap_bench_report, drop_reasons, drop_counts)}
ORACLE_SQL = {
    "overlap_by_source": f"""WITH {_WORDS}{_STREAM}{_FOUND}, n AS (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id)
SELECT source, count(*) AS n_docs, count(n) AS n_flagged, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_doc_grams FROM documents LEFT JOIN n USING (doc_id) GROUP BY source""",
    "overlap_flagged_docs": f"WITH {_WORDS}{_STREAM}{_FOUND} SELECT DISTINCT doc_id FROM found",
    "overlap_scan_totals": f"""WITH {_WORDS}{_STREAM}{_FOUND}
SELECT count(*) AS n_docs_scanned, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM found)) AS n_docs_matching,
       CAST(sum(len(ws)) AS BIGINT) AS n_words_scanned, CAST(sum(len(ws) + 1) AS BIGINT) AS n_tokens_scanned FROM dw""",
    "overlap_report": f"""WITH {_WORDS}{_STREAM}{_FOUND}, m AS (SELECT DISTINCT gram FROM found)
SELECT count(*) AS n_ngrams, (SELECT count(*) FROM m) AS n_matched_ngrams, round((SELECT count(*) FROM m) / greatest(count(*), 1), 9) AS frac_ngrams_matched,
       (SELECT coalesce(string_agg(gram, '|' ORDER BY gram), '') FROM (SELECT gram FROM m ORDER BY gram LIMIT 5)) AS examples FROM grams""",
    "overlap_bench_report": f"""WITH {_WORDS}
items AS (SELECT item_id, lower(text[1:1]) AS bench, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark),
ig AS (SELECT DISTINCT bench, item_id, array_to_string(ws[i:i+12], ' ') AS gram FROM (SELECT bench, item_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM items)),
m AS (SELECT DISTINCT gram FROM dg WHERE gram IN (SELECT gram FROM ig)),
j AS (SELECT ig.*, m.gram IS NOT NULL AS hit FROM ig LEFT JOIN m USING (gram)),
bi AS (SELECT bench, count(*) AS n_items_with_ngrams, count(*) FILTER (WHERE h) AS n_items_hit FROM (SELECT bench, item_id, bool_or(hit) AS h FROM j GROUP BY ALL) GROUP BY bench),
bg AS (SELECT bench, count(*) AS n_ngrams, count(*) FILTER (WHERE h) AS n_matched_ngrams, array_to_string(list_sort(list(gram) FILTER (WHERE h))[1:5], '|') AS examples
       FROM (SELECT bench, gram, bool_or(hit) AS h FROM j GROUP BY ALL) GROUP BY bench),
b AS (SELECT bench, count(*) AS n_items FROM items GROUP BY bench)
SELECT bench, n_items, coalesce(n_items_with_ngrams, 0) AS n_items_with_ngrams, coalesce(n_items_hit, 0) AS n_items_hit, coalesce(n_ngrams, 0) AS n_ngrams,
       coalesce(n_matched_ngrams, 0) AS n_matched_ngrams, coalesce(examples, '') AS examples,
       round(coalesce(n_matched_ngrams, 0) / greatest(coalesce(n_ngrams, 0), 1), 9) AS frac_ngrams_matched, round(coalesce(n_items_hit, 0) / greatest(n_items, 1), 9) AS frac_items_hit
FROM b LEFT JOIN bi USING (bench) LEFT JOIN bg USING (bench)""",
    "drop_reasons": f"WITH {_WORDS}{_STREAM}{_FOUND}, {_REASON} SELECT doc_id, reason FROM reasons",
    "drop_counts": f"""WITH {_WORDS}{_STREAM}{_FOUND}, {_REASON}
SELECT source, count(*) FILTER (WHERE reason IS NULL) AS n_docs, count(*) FILTER (WHERE reason = 'title') AS n_docs_dropped_title,
       count(*) FILTER (WHERE reason = 'ngram') AS n_docs_dropped_ngram FROM reasons GROUP BY source""",
}
