"""Spelling variants against brute force over whole tables."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute(rows):
    """The rows by a table of all words with one letter left out."""
    seen = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                seen[w] += 1
    known = {w: n for w, n in seen.items() if n >= 2}
    shorter, holes = defaultdict(set), defaultdict(set)
    for w in known:
        for i in range(len(w)):
            shorter[w[:i] + w[i + 1 :]].add(w)
            holes[w[:i], w[i + 1 :]].add(w)
    form, count = {}, {}
    for w in known:
        near = set(shorter[w]) | {x for i in range(len(w)) if (x := w[:i] + w[i + 1 :]) in known}
        near |= set().union(*(holes[w[:i], w[i + 1 :]] for i in range(len(w)))) - {w}
        count[w] = len(near)
        best = min(near, key=lambda x: (-known[x], x), default=None)
        if best and known[best] >= 10 * known[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, count[w], known.get(form.get(w))) for w, n in known.items())


def plain(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("hot,shard", [(spelling.HOT, spelling.SHARD), (2, 40)])
def test_whole_table(spark, hot, shard):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert plain(spelling.variants(docs, hot, shard)) == want
    assert sum(1 for r in want if r[1]) > 100


def test_query_is_the_operator(spark, sf):
    assert plain(queries.op11_spelling_variants(spark, sf)) == brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


CHAIN = "overlapping " * 500 + "overlaping " * 40 + "overlapinq " * 3 + "Überraschung " * 30 + "überraschung " * 3 + "straßenbahn " * 20 + "strassenbahn " * 20


@pytest.mark.parametrize("hot,shard", [(spelling.HOT, spelling.SHARD), (0, 1)])
def test_odd_rows(spark, hot, shard):
    """Null, empty and very long texts, null and repeated ids, repeated rows, ties, long words, clashing columns."""
    rows = [
        (1, CHAIN), (1, CHAIN), (None, CHAIN), (2, None), (3, ""), (4, "...  \t 12345"), (5, "abcdefgh abcdefgh xbcdefgh xbcdefgh bcdefgh bcdefgh abcdefghi abcdefghi"),
        (6, "z" * 3000 + " " + "z" * 3000), (7, "z" * 2999 + "y " + "z" * 2999 + "y"), (8, "tiebreak " * 25 + "tiebreal " * 25 + "tiebrea " * 2), (9, ("longtext" * 3 + " ") * 40_000), (10, "a-b'c Ünïcödé Ünïcödé ünïcödé ünïcödé"),
        (11, "aaaaaaaa " * 30 + "aaaaaaa " * 3 + "aaaaaaaaa " * 3),
    ]
    docs = spark.createDataFrame([(i, t, "x", 0, "y") for i, t in rows], "doc_id long, text string, word string, n int, segment string")
    got, want = plain(spelling.variants(docs, hot, shard)), brute(rows)
    assert got == want
    by = {r[0]: r for r in got}
    assert by["overlapinq"][1:3] == ("overlaping", "overlapping")
    assert by["tiebrea"][1] == "tiebreak"
    assert plain(spelling.variants(docs.limit(0))) == []
    assert plain(spelling.variants(docs.where("doc_id = 2"))) == []
