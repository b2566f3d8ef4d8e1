"""Collocations against plain Python; the query itself is held against SQL in test_queries.py."""

import re
from collections import Counter

import pytest

from millrace.llm import bitmap, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, top):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                f.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= 30}
    gone = set()
    for (lang, w), a in cand.items():
        for n in range(2, len(w)):
            gone |= {(lang, w[i : i + n]) for i in range(len(w) - n + 1) if 100 * a >= 80 * f[lang, w[i : i + n]]}
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top]))


def plain(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("limit", [1 << 14, phrases.SHARD_BYTES])
def test_odd_rows(spark, limit):
    """Null, empty and long texts, null languages, repeated rows, ties, separators, overlaps, phrases inside others."""
    rows = [
        ("en", "New York city hall. "), ("en", "new york"), (None, "ab cd ef"), ("und", "ab cd ef"), ("fr", None), ("fr", ""), ("en", "New\tYork,City hall"), ("de", "naïve Ärger Straße"), ("de", "naïve Ärger\x0bStraße"),
        ("xx", "a a a a a a"), ("xx", "nbsp\xa0joined word"), ("yy", "tie one tie two tie one tie two"), ("zz", "\x00\x01 \x00\x01 q"),
    ]
    rows = rows * 35 + [("en", "filler text goes on and " * 40_000)]
    docs = spark.createDataFrame([(i, x, t, "p", 1) for i, (x, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int").repartition(3)
    got = plain(phrases.collocations(docs, limit=limit))
    assert got == brute(rows, phrases.TOP)
    assert {r[0] for r in got} == {"en", "und", "de", "xx", "yy", "zz"}
    assert plain(phrases.collocations(docs, top=2, limit=limit)) == brute(rows, 2)
    assert plain(phrases.collocations(docs.limit(0))) == []
    assert plain(phrases.collocations(docs.where("lang = 'fr'"))) == []


def test_full_bitmap_lets_everything_through(spark, monkeypatch):
    """Where hashes outnumber the bits, results stay the same."""
    monkeypatch.setattr(bitmap, "gather", lambda df, c: __import__("numpy").full(bitmap.BITS // 8, 255, "uint8"))
    rows = [("en", "one two three one two"), ("fr", "un deux")] * 33
    docs = spark.createDataFrame([(i, x, t) for i, (x, t) in enumerate(rows)], "doc_id long, lang string, text string")
    assert plain(phrases.collocations(docs)) == brute(rows, phrases.TOP)
