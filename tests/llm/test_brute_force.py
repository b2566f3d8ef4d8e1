"""Operators without SQL against plain Python over whole tables: pseudonyms and the classifiers' scores."""

import math
import re

import xxhash
from pyspark.sql import functions as F

from millrace.llm import nbsvm, nnpu, pii, queries, words

SF = "/root/testdata/sf0.01"
M = (1 << 64) - 1


def mix(x):
    for _ in range(2):
        x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & M
    return x ^ x >> 32


def fold(h, bits, family):
    return mix((h + ((family + 1) * 0x9E3779B97F4A7C15)) & M) >> 64 - bits


def digest(word):
    return xxhash.xxh3_64_intdigest(word)


def sigmoid(x):
    return 1 / (1 + math.exp(-min(max(x, -30), 30)))


def nbsvm_indices(text):
    ws = text.encode().split()
    word = [digest(w.lower()) for w in ws]
    form = [mix((digest(nbsvm.shape(w)) + (i > 0 and word[i] == word[i - 1])) & M) for i, w in enumerate(ws)]
    out = {fold(h, nbsvm.BITS, 0) for h in word} | {fold(h, nbsvm.BITS, 1) for h in form}
    factors = [int(f) for f in words._FACTORS]
    for k, source, family in ((2, word, 2), (2, form, 3), (3, form, 4)):
        out |= {fold(mix(sum(source[i + j] * factors[j] for j in range(k)) & M), nbsvm.BITS, family) for i in range(len(ws) - k + 1)}
    return out


def nnpu_indices(text):
    count = {}
    for w in set(text.encode().split()):
        plain = w.strip(nnpu.MARKS).decode("utf-8", "replace").lower()
        for h in [digest(plain.encode())] + [digest(b"^" + plain[:k].encode()) for k in nnpu.STEMS if len(plain) > k]:
            index = fold(h, nnpu.BITS, 0)
            count[index] = count.get(index, 0) + 1
    return set(count) | {fold(i, nnpu.BITS, least) for least in nnpu.OFTEN for i, n in count.items() if n >= least}


def test_quality_scores(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model, squares = nbsvm.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = queries.op7_quality_nbsvm(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        own = sorted(nbsvm_indices(texts[r.doc_id]))
        margin = sum(model.weights[i] for i in own) / max(math.sqrt(sum(squares[i] for i in own)), 1e-9) + model.bias
        assert abs(r.score - sigmoid(model.slope * margin + model.shift)) < 1e-9


def test_toxicity_scores(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    weights, bias = nnpu.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = queries.op8_toxicity_nnpu(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert abs(r.score - sigmoid(sum(float(weights[i]) for i in sorted(nnpu_indices(texts[r.doc_id]))) + bias)) < 1e-6


FOUND = {
    "email": r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "us_ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])",
    "ipv4": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
}


def test_pseudonyms(spark):
    """Only findings change, each into one value of its kind that no other has, and nothing that plain patterns find is left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text for r in docs.collect()}
    out = pii.pseudonymise(docs)
    rows = out.select("doc_id", "text", "_pii", F.transform("_pii", lambda x: pii.kind_of(x["pseudonym"])).alias("kinds")).collect()
    assert len(rows) == len(before)
    named, seen = {}, set()
    for r in rows:
        left, built = before[r.doc_id], ""
        for f in r._pii:
            head, value, left = left.partition(f.value)
            assert value
            built += head + f.pseudonym
            assert named.setdefault((f.kind, f.value), f.pseudonym) == f.pseudonym
            assert len(f.pseudonym) == len(f.value) or f.kind == "ipv4"
        assert built + left == r.text and list(r.kinds) == [f.kind for f in r._pii]
        seen |= {f.kind for f in r._pii}
        for kind, pattern in FOUND.items():
            assert set(re.findall(pattern, before[r.doc_id], re.ASCII)) <= {f.value for f in r._pii if f.kind == kind}
    digits = {(k, re.sub(r"\D", "", v) if k == "card" else v) for k, v in named}
    assert len({(k, re.sub(r"\D", "", p) if k == "card" else p) for (k, _), p in named.items()}) == len(digits) and len(named) > 50 and len(seen) >= 4
    report = {r.doc_id: r for r in queries.op6_pii_pseudonyms(spark, SF).collect()}
    assert all(report[r.doc_id].text == r.text and report[r.doc_id].n_pii == len(r._pii) for r in rows)
