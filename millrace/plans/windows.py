"""Queries on titles, pages, validation windows, scoring spans and unigram scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import captions
from millrace.functions import text as T
from millrace.operators import metrics, windows
from millrace.operators.selection import prefix_sum
from millrace.plans.corpus import _DOCS, _PACK, FILE, packed
from millrace.session import spread, table

WIDTH, ROWS = 64, 16
CTX, STRIDE = 128, 48
CAPTION = 42
RUN = 300


def title_keys(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))
    return titles.select("page_id", T.title_key("title").alias("title_key"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as lines of one text each: a user's turn is a heading, an assistant's its text."""
    turns = table(spark, d, "conversations")
    first = F.regexp_extract("text", "^[^\n=]*", 0)
    line = F.when(F.col("role") == "user", F.concat(F.lit(" = "), first, F.lit(" = \n"))).otherwise(F.concat(F.lit(" "), F.regexp_replace("text", "\n", " "), F.lit("\n")))
    return turns.select("conv_id", "turn", line.alias("line"))


def heading_titles(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return lines.select("conv_id", "turn", T.heading_title("line").alias("title")).where("title IS NOT NULL")


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    pages = windows.pages(_lines(spark, d), ["conv_id"], "turn")
    return pages.select("conv_id", "page", F.octet_length("text").cast("long").alias("n_bytes"), F.size(F.split("text", "[ \n]+")).cast("long").alias("n_words"), F.sha2("text", 256).alias("sha"))


SHARD = [*FILE, "part"]


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Per packed shard a stream of word lengths plus two, each document after a mark 0."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.array(F.lit(0)), F.transform(T.words("text"), lambda w: F.length(w) + 2)).alias("t"))
    placed = packed(spark, d).select(*SHARD, "doc_id").join(docs, "doc_id")
    return placed.groupBy(*SHARD).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "t"))), lambda x: x["t"])).alias("tokens"))


def validation_windows(spark: SparkSession, d: str) -> DataFrame:
    out = windows.val_windows(_tokens(spark, d), WIDTH)
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(*SHARD, "start", add("x").alias("x_sum"), add("y").alias("y_sum"), F.element_at("x", 1).cast("long").alias("x_first"), F.element_at("y", -1).cast("long").alias("y_last"))


def validation_batches(spark: SparkSession, d: str) -> DataFrame:
    out = windows.val_batches(windows.val_windows(_tokens(spark, d), WIDTH), ["source"], ["file_idx", "part"], ROWS, WIDTH)
    scored = F.size(F.filter("y", lambda v: v != windows.IGNORE)).cast("long")
    return out.groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(scored).alias("n_scored"))


def scoring_spans(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", (F.size(T.words("text")) + 1).cast("long").alias("n_tokens"))
    return windows.scoring_spans(docs, CTX, STRIDE)


def stream_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the first 2,000 tokens and more of each shard, by the marks."""
    docs = _tokens(spark, d).select(*SHARD, F.posexplode(windows.split_on(F.col("tokens"), 0, 2000)).alias("place", "doc"))
    return docs.select(*SHARD, F.col("place").cast("long").alias("place"), F.size("doc").cast("long").alias("n_tokens"))


def shard_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents of each packed shard, put together from runs of ``RUN`` tokens: longer ones lie in three runs and more."""
    starts = F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(RUN))
    runs = F.transform(starts, lambda s: F.struct(s.cast("long").alias("start"), F.slice("tokens", s + 1, F.lit(RUN)).alias("tokens")))
    docs = windows.split_runs(_tokens(spark, d).select(*SHARD, F.explode(runs).alias("run")).select(*SHARD, "run.*"), 0, SHARD)
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.select(*SHARD, "doc", "start", F.size("tokens").cast("long").alias("n_tokens"), total.alias("token_sum"))


def unigram_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """A unigram model of the corpus itself scores it: a stand-in for a trained model."""
    docs = table(spark, d, "documents")
    tokens = spread(docs.select("doc_id", "text")).select("doc_id", F.explode(T.words("text")).alias("token"))
    scored = metrics.unigram_nats(tokens, "doc_id").join(docs.select("doc_id", "lang", T.space_words("text").alias("n_words"), F.octet_length("text").alias("n_bytes")), "doc_id")
    out = metrics.perplexities(scored, ["lang"])
    return out.select("lang", "n_docs", *[F.round(c, 4).alias(c) for c in ("total_nats", "token_ppl", "word_ppl", "bits_per_byte")])


def validation_bpb(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    tokens = spread(docs.select("doc_id", "text")).select("doc_id", F.explode(T.words("text")).alias("token"))
    scored = metrics.unigram_nats(tokens, "doc_id").join(docs.select("doc_id", "source", F.octet_length("text").alias("n_bytes")), "doc_id")
    batches = scored.select("source", (F.col("nats") / F.col("n_tokens")).alias("mean_loss"), F.col("n_tokens").alias("n"), "n_bytes")
    return metrics.bits_per_byte(batches, ["source"]).select("source", F.round("bpb", 6).alias("bpb"))


def caption_lines(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select("item_id", F.posexplode(windows.caption_chunks(F.regexp_replace("text", r"[^\x20-\x7E]+", " "), CAPTION)).alias("place", "line"))
    return items.select("item_id", F.col("place").cast("long").alias("place"), "line")


def caption_cues(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the benchmark as cues of about equal width, with the times that 15 characters a second give."""
    said = table(spark, d, "benchmark").select("item_id", F.posexplode(captions.sentences(F.regexp_replace("text", "\n", " "))).alias("sentence", "text"))
    cues = said.select("item_id", "sentence", F.posexplode(windows.caption_chunks(F.col("text"), captions.cue_width(F.col("text"), CAPTION))).alias("cue", "line"))
    before = prefix_sum(F.char_length("line"), ["item_id"], ["sentence", "cue"])
    return cues.select("item_id", "sentence", "cue", "line", captions.srt_time(before / 15).alias("start"))


def whitespace_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.space_words("text").cast("long").alias("n_words"), F.octet_length("text").cast("long").alias("n_bytes"))


_KEY = """lower(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(trim(regexp_replace({0}, '\\s+', ' ', 'g')),
  ' @-@ ', '-'), ' @,@ ', ','), ' @.@ ', '.'), ' ([,.;:!?)\\]''])', '\\1', 'g'), '([(\\[]) ', '\\1', 'g'), ' ?([-–—]) ?', '\\1', 'g'))"""
_LINES = """lines AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN ' = ' || regexp_extract(text, '^[^\\n=]*') || ' = ' || chr(10) ELSE ' ' || replace(text, chr(10), ' ') || chr(10) END AS line FROM conversations)"""
_STREAM = f"""{_DOCS}, {_PACK}, t AS (SELECT doc_id, list_concat([0], list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) + 2)) AS t FROM documents),
s AS (SELECT source, file_idx, part, flatten(list(t ORDER BY doc_id)) AS tokens FROM t JOIN fold USING (doc_id) GROUP BY ALL)"""
_WIN = f"""w AS (SELECT source, file_idx, part, tokens, unnest(range(0, len(tokens) - 1, {WIDTH})) AS start FROM s),
v AS (SELECT source, file_idx, part, start, tokens[start + 1 : start + least({WIDTH}, len(tokens) - 1 - start)] AS x, tokens[start + 2 : start + 1 + least({WIDTH}, len(tokens) - 1 - start)] AS y FROM w)"""
_NATS = """tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
c AS (SELECT w, count(*) AS c FROM tok GROUP BY w), n AS (SELECT count(*) AS n FROM tok),
nats AS (SELECT doc_id, -sum(ln(c / n)) AS nats, count(*) AS n_tokens FROM tok JOIN c USING (w), n GROUP BY doc_id)"""

QUERIES = {
    f.__name__: f
    for f in (title_keys, heading_titles, page_texts, validation_windows, validation_batches, scoring_spans, stream_documents, shard_documents, unigram_perplexity, validation_bpb, caption_lines, caption_cues, whitespace_words)
}
ORACLE_SQL = {
    "title_keys": f"SELECT page_id, replace({_KEY.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")}, 'ß', 'ss') AS title_key FROM pages",
    "heading_titles": f"WITH {_LINES} SELECT conv_id, turn, regexp_extract(line, '^ = ([^=\\n][^\\n]*?) = \\n$', 1) AS title FROM lines WHERE regexp_matches(line, '^ = [^=\\n][^\\n]*? = \\n$')",
    "page_texts": f"""WITH {_LINES}, p AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(line, '^ = [^=][^\\n]* = \\n$') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS page FROM lines),
g AS (SELECT conv_id, page, regexp_replace(string_agg(CASE WHEN line = '' THEN ' ' || chr(10) ELSE line END, '' ORDER BY turn), '\\n$', '') AS text FROM p GROUP BY ALL)
SELECT conv_id, page, CAST(strlen(text) AS BIGINT) AS n_bytes, len(regexp_split_to_array(text, '[ \\n]+')) AS n_words, sha256(text) AS sha FROM g WHERE regexp_matches(text, '\\S')""",
    "validation_windows": f"""WITH RECURSIVE {_STREAM}, {_WIN} SELECT source, file_idx, part, start, CAST(list_sum(x) + 2 * ({WIDTH} - len(x)) AS BIGINT) AS x_sum, CAST(list_sum(y) - 100 * ({WIDTH} - len(y)) AS BIGINT) AS y_sum,
  CAST(x[1] AS BIGINT) AS x_first, CAST(CASE WHEN len(y) < {WIDTH} THEN -100 ELSE y[-1] END AS BIGINT) AS y_last FROM v""",
    "validation_batches": f"""WITH RECURSIVE {_STREAM}, {_WIN}, r AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY file_idx, part, start) - 1) // {ROWS} AS batch, len(y) AS n FROM v)
SELECT source, batch, CAST({ROWS} AS BIGINT) AS n_rows, CAST(sum(n) AS BIGINT) AS n_scored FROM r GROUP BY ALL""",
    "scoring_spans": f"""WITH d AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) + 1 AS n FROM documents),
j AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 1 THEN 0 WHEN n <= {CTX} THEN 1 ELSE 1 + CAST(ceil((n - {CTX}) / {STRIDE}) AS BIGINT) END)) AS j FROM d)
SELECT doc_id, n AS n_tokens, j * {STRIDE} AS begin, least(j * {STRIDE} + {CTX}, n) AS "end", CASE WHEN j = 0 THEN 1 ELSE (j - 1) * {STRIDE} + {CTX} END AS first FROM j""",
    "stream_documents": f"""WITH RECURSIVE {_DOCS}, {_PACK},
p AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, file_idx, part ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fold),
f AS (SELECT source, file_idx, part, min(before) FILTER (WHERE before >= 2000) AS stop FROM p GROUP BY ALL)
SELECT source, file_idx, part, row_number() OVER (PARTITION BY source, file_idx, part ORDER BY doc_id) - 1 AS place, n_tokens - 1 AS n_tokens FROM p JOIN f USING (source, file_idx, part) WHERE before < coalesce(stop, 1e18)""",
    "shard_documents": f"""WITH RECURSIVE {_DOCS}, {_PACK}, k AS (SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) + 2)), 0) AS BIGINT) AS token_sum FROM documents)
SELECT source, file_idx, part, row_number() OVER w - 1 AS doc, CAST(coalesce(sum(n_tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, n_tokens - 1 AS n_tokens, token_sum
FROM fold JOIN k USING (doc_id) WINDOW w AS (PARTITION BY source, file_idx, part ORDER BY doc_id)""",
    "unigram_perplexity": f"""WITH {_NATS} SELECT lang, count(*) AS n_docs, round(sum(nats), 4) AS total_nats, round(exp(sum(nats) / sum(n_tokens)), 4) AS token_ppl,
  round(exp(sum(nats) / sum(len(regexp_split_to_array(text, '\\s+')))), 4) AS word_ppl, round(sum(nats) / (ln(2) * sum(strlen(text))), 4) AS bits_per_byte FROM documents JOIN nats USING (doc_id) GROUP BY lang""",
    "validation_bpb": f"WITH {_NATS} SELECT source, round(sum(nats) / (ln(2) * sum(strlen(text))), 6) AS bpb FROM documents JOIN nats USING (doc_id) GROUP BY source",
    "caption_lines": f"""WITH RECURSIVE w AS (SELECT item_id, ws, len(ws) AS n FROM (SELECT item_id, list_filter(regexp_split_to_array(trim(regexp_replace(text, '[^\\x20-\\x7E]+', ' ', 'g')), '\\s+'), lambda x: x != '') AS ws FROM benchmark)),
f AS (SELECT item_id, ws, n, 1 AS i, CAST(0 AS BIGINT) AS place, ws[1] AS line FROM w WHERE n > 0
  UNION ALL SELECT item_id, ws, n, i + 1, CASE WHEN length(line) + 1 + length(ws[i + 1]) <= {CAPTION} THEN place ELSE place + 1 END, CASE WHEN length(line) + 1 + length(ws[i + 1]) <= {CAPTION} THEN line || ' ' || ws[i + 1] ELSE ws[i + 1] END FROM f WHERE i < n)
SELECT item_id, place, arg_max(line, i) AS line FROM f GROUP BY item_id, place""",
    "whitespace_words": "SELECT doc_id, len(regexp_split_to_array(text, '\\s+')) AS n_words, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents",
}
