"""Validation windows, scoring spans, page segmentation, document splits and caption chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import scan
from millrace.operators.selection import prefix_sum
from millrace.session import cut as cut_lineage

PAD, IGNORE = 2, -100


def _steps(first: Column, last: Column, step: int) -> Column:
    """first, first + step, ... up to last; empty where last lies before first."""
    return F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<long>"))


def val_windows(shards: DataFrame, width: int, tokens: str = "tokens") -> DataFrame:
    """Rows (…, start, x, y): windows of ``width`` at every multiple of it below n - 1, y one token ahead.

    The last window is padded, x with 2 and y with -100, so that each token but the first is scored once.
    """
    n = F.size(tokens).cast("long")
    starts = _steps(F.lit(0).cast("long"), n - 2, width)
    out = shards.select("*", F.explode(starts).alias("start"))
    room = F.least(F.lit(width).cast("long"), n - 1 - F.col("start")).cast("int")
    piece = lambda shift: F.slice(tokens, (F.col("start") + 1 + shift).cast("int"), room)
    fill = lambda value: F.array_repeat(F.lit(value), F.lit(width) - room)
    return out.withColumn("x", F.concat(piece(0), fill(PAD))).withColumn("y", F.concat(piece(1), fill(IGNORE)))


def val_batches(windows: DataFrame, by: list[str], shard: list[str], rows: int, width: int) -> DataFrame:
    """Windows with (by, batch, row): each group's windows, shard after shard, are cut into batches, and the group's last
    one is filled with rows that score nothing.

    A window's number is its own place in its shard and the count of windows in the shards before, so nothing but one
    row a shard is ordered within a group.
    """
    counts = windows.groupBy(*by, *shard).agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", prefix_sum("_n", by, shard))
    numbered = windows.join(counts.drop("_n"), [*by, *shard]).withColumn("_at", F.col("_first") + F.floor(F.col("start") / width))
    out = numbered.withColumn("batch", F.floor(F.col("_at") / rows).cast("long")).withColumn("row", (F.col("_at") % rows).cast("int"))
    out = out.select(*by, "batch", "row", "x", "y")
    last = out.groupBy(*by).agg(F.max(F.struct("batch", "row")).alias("m")).where(F.col("m.row") < rows - 1)
    fill = last.select(
        *by, F.col("m.batch").alias("batch"), F.explode(F.sequence(F.col("m.row") + 1, F.lit(rows - 1))).alias("row"),
        F.array_repeat(F.lit(PAD), width).alias("x"), F.array_repeat(F.lit(IGNORE), width).alias("y"),
    )
    return out.unionByName(fill)


def scoring_spans(docs: DataFrame, ctx: int, stride: int, n: str = "n_tokens") -> DataFrame:
    """Rows (…, begin, end, first): windows of ``ctx`` tokens whose targets first .. end - 1 cover 1 .. n - 1 once."""
    if not 0 < stride < ctx:
        raise ValueError("stride must lie between 0 and the context")
    size = F.col(n).cast("long")
    count = F.when(size <= 1, 0).when(size <= ctx, 1).otherwise(1 + F.ceil((size - ctx) / stride)).cast("long")
    out = docs.select("*", F.explode(_steps(F.lit(0).cast("long"), count - 1, 1)).alias("_j"))
    begin = F.col("_j") * stride
    first = F.when(F.col("_j") == 0, 1).otherwise((F.col("_j") - 1) * stride + ctx).cast("long")
    return out.select(*docs.columns, begin.alias("begin"), F.least(begin + ctx, size).alias("end"), first.alias("first"))


def pages(lines: DataFrame, by: list[str], order: str, line: str = "line") -> DataFrame:
    """Texts of pages: a first-level heading starts one, blank lines read `` \\n``, pages without text go.

    Lines before the first heading are a page of their own; one line end at a page's end is removed.
    """
    starts = F.when(T.starts_page(F.col(line)), 1).otherwise(0)
    rows = scan.prefix_sums(lines, {"_pages": starts}, by, [order])
    shown = F.when(F.col(line) == "", " \n").otherwise(F.coalesce(F.col(line), F.lit("")))
    grouped = rows.withColumn("page", F.col("_pages") + starts).withColumn("_shown", shown).groupBy(*by, "page")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_shown"))), lambda x: x["_shown"]), "")
    out = grouped.agg(text.alias("text")).where(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"))
    return out.withColumn("text", F.regexp_replace("text", r"\n\z", ""))


def split_on(tokens: Column, mark: int, most: int) -> Column:
    """Documents of a token stream: what follows each mark, up to the first mark at or after place ``most``.

    Tokens before the first mark are ignored, and marks are not part of a document.
    """
    marks = F.filter(F.transform(tokens, lambda t, i: F.when(t == mark, i)), lambda i: i.isNotNull())
    end_of = lambda m: F.coalesce(F.try_element_at(F.filter(m, lambda i: i >= most), F.lit(1)), F.size(tokens))

    def cut(edges: Column) -> Column:
        """Documents between neighbouring edges: used marks, then the end."""
        later = F.slice(edges, 2, F.greatest(F.size(edges), F.lit(1)))
        return F.zip_with(F.slice(edges, 1, F.size(edges) - 1), later, lambda a, b: F.slice(tokens, a + 2, b - a - 1))

    edges = T.let(marks, lambda m: T.let(end_of(m), lambda end: F.concat(F.filter(m, lambda i: i < end), F.array(end))))
    return F.when(F.size(marks) > 0, T.let(edges, cut)).otherwise(F.array().cast("array<array<int>>"))


def split_runs(runs: DataFrame, mark: int, by: list[str], start: str = "start", tokens: str = "tokens", most: int | None = None) -> DataFrame:
    """Documents (by, doc, start, tokens) of token streams that lie in runs, as shards are read: ``split_on`` for streams of any
    length, of which no more than a document is ever in one place.

    A run is cut at its marks. What stands before its first mark goes on with the document of the runs before; how many
    marks those have is a running sum over runs, one number a run, that gives each cut its document. ``doc`` counts from
    0 in a stream, ``start`` is the place of its mark. With ``most``, documents whose mark lies at or after it are left out.
    """
    t, at = F.col(tokens), F.col(start)
    marks = F.filter(F.transform(t, lambda x, i: F.when(x == mark, i)), lambda i: i.isNotNull())
    slim = scan.prefix_sums(runs.select(*by, start, F.size(marks).alias("_n")), {"_before": "_n"}, by, [start]).drop("_n")
    slim = cut_lineage(slim)
    slim = F.broadcast(slim) if slim.count() <= scan.SMALL else slim

    def pieces(m: Column) -> Column:
        cuts = F.concat(F.array(F.lit(-1)), m)
        ends = F.concat(m, F.array(F.size(t)))
        return F.zip_with(cuts, ends, lambda a, b: F.struct(F.when(a >= 0, at + a).alias("mark"), F.slice(t, a + 2, b - a - 1).alias("t")))

    renamed = slim.select(*(F.col(c).alias(f"_of_{c}") for c in (*by, start)), "_before")
    met = runs.join(renamed, [runs[c].eqNullSafe(renamed[f"_of_{c}"]) for c in (*by, start)])
    each = met.select(*by, at.alias("_at"), "_before", F.posexplode(T.let(marks, pieces)).alias("_k", "_piece"))
    named = each.select(*by, "_at", (F.col("_before") + F.col("_k") - 1).cast("long").alias("doc"), "_piece.mark", "_piece.t").where("doc >= 0")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "t"))), lambda x: x["t"]))
    out = named.groupBy(*by, "doc").agg(F.min("mark").alias("start"), whole.alias("tokens"))
    return out if most is None else out.where(F.col("start") < most)


def caption_chunks(text: Column, most: int | Column) -> Column:
    """Words packed greedily into lines of at most ``most`` characters; a longer word has its own line."""
    ws = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")

    def add(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = (F.size(lines) > 0) & (F.char_length(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))) + 1 + F.char_length(word) <= most)
        joined = F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), word)))
        return F.when(fits, joined).otherwise(F.concat(lines, F.array(word)))

    return F.aggregate(ws, F.array().cast("array<string>"), add)
