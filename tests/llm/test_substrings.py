"""Removal of repeated passages against brute force over whole tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import queries, substrings

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(rows):
    seen = Counter()
    for _, text in rows:
        data = (text or "").encode()
        seen.update(data[i : i + 200] for i in range(len(data) - 199))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        edge = np.zeros(len(data) + 1, np.int64)
        for i in range(len(data) - 199):
            if seen[data[i : i + 200]] > 1:
                edge[i] += 1
                edge[i + 200] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def plain(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]


@pytest.mark.parametrize("group,shard,held", [(substrings.GROUP, substrings.SHARD, substrings.HELD), (3, 10, 50)])
def test_whole_table(spark, table, monkeypatch, group, shard, held):
    """Also with grams above the group limit, small sorts and tasks that forget."""
    monkeypatch.setattr(substrings, "HELD", held)
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    got = plain(substrings.dedup(docs, group, shard))
    assert got == brute(table)
    assert sum(r[2] > 0 for r in got) > 50


def test_query_is_the_operator(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert plain(queries.op12_suffix_dedup(spark, sf)) == brute(rows)


@pytest.mark.parametrize("group", [0, substrings.GROUP])
def test_odd_rows(spark, group):
    """Null, empty, short and very long texts, repeated rows and ids, null ids, runs, overlaps, two letters, zero bytes."""
    rnd = random.Random(5)
    noise = lambda n, letters="abcdefghij klmnopé\n": "".join(rnd.choice(letters) for _ in range(n))
    passage, edge, zeros = noise(500), noise(199), "\x00" * 230
    rows = [
        (1, None), (2, ""), (3, "short"), (3, "short"), (4, noise(300)), (5, passage), (5, passage), (None, noise(90) + passage[40:260] + noise(90)), (None, passage[100:]),
        (6, "x" * 450), (7, noise(50) + "x" * 201 + noise(50)), (8, edge + "1"), (9, edge + "2"), (10, noise(100) + passage[:200]), (11, passage[300:] + noise(100)), (12, zeros + "q"), (13, "q" + zeros),
        (14, noise(2000, "ab")), (15, noise(100_000, "abcdefgh") + passage[:230] + noise(70_000, "abcdefgh")), (16, "é" * 120), (17, "è" + "é" * 110), (18, (noise(37) * 40)[:900]),
    ]
    rows += [(20 + i, noise(60) + passage[150:400] + noise(60)) for i in range(30)]
    docs = spark.createDataFrame([(i, t, b"k", 1, True) for i, t in rows], "doc_id long, text string, key binary, n_bytes int, h boolean").repartition(4)
    assert plain(substrings.dedup(docs, group, 8)) == brute(rows)
    assert plain(substrings.dedup(docs.limit(0), group)) == []
    assert plain(substrings.dedup(docs.where("doc_id < 5"), group)) == brute(rows[:5])


def test_text_is_what_is_left(spark):
    a, b = "".join(map(chr, range(33, 120))) * 1, "0123456789" * 25
    docs = spark.createDataFrame([(1, a + b), (2, b), (3, a)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substrings.dedup(docs).collect()}
    assert bytes(got[1]) == a.encode() and bytes(got[2]) == b"" and got[3] is None


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 300])
def test_suffix_sort(n):
    rnd = random.Random(n)
    strings = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.choice([0, 3, 8, 17, 40]))) for _ in range(n)]
    group = np.sort(np.array([rnd.randrange(1 + n // 20) for _ in range(n)]))
    s = substrings.Suffixes(strings, group, 40)
    assert [(group[i], strings[i]) for i in s.order] == sorted((group[i], strings[i]) for i in range(n))


def test_colliding_hashes_are_noticed(monkeypatch):
    """A base that makes all prefixes alike is given up for the next one; if none is left, it is an error."""
    strings, group = [bytes([97 + i % 5]) * 30 for i in range(20)], np.zeros(20, np.int64)
    real = substrings.Suffixes._hashed

    def broken(self, base):
        real(self, base)
        if base == substrings.BASES[0]:
            self.prefix[:] = 0

    monkeypatch.setattr(substrings.Suffixes, "_hashed", broken)
    s = substrings.Suffixes(strings, group, 40)
    assert [strings[i] for i in s.order] == sorted(strings)
    monkeypatch.setattr(substrings, "BASES", substrings.BASES[:1])
    with pytest.raises(ArithmeticError):
        substrings.Suffixes(strings, group, 40)
