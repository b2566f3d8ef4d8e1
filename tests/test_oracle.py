"""Every registered query of the library against its SQL in DuckDB, over whole tables."""

import functools
import math
from pathlib import Path

import duckdb
import pytest

from millrace.plans import registry

#: Queries that refuse the smallest tables, in which most sources have too few rows for a batch.
LARGER = {"training_batches", "batch_shards", "batch_tokens", "cursor_gaps", "loader_cursors"}
#: Queries without SQL: whole tables are compared with the tokenizers library in test_text.py, or row by row below.
ELSEWHERE = {"piece_counts", "encoded_docs", "caption_cues", "seeded_shards", "decoded_windows"}


@functools.cache
def duck(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    sf = sf.replace("0.001", "0.01") if name in LARGER else sf
    df = registry.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    cur = duck(sf).execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(cur.fetchall(), columns)


def test_queries_without_sql_are_compared_elsewhere():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == ELSEWHERE


def test_caption_cues_as_brute_force(spark, sf):
    """Sentences, cues of about equal width, and start times, in plain Python."""
    import re

    from millrace.plans import windows as plan

    def cues(text):
        for place, said in enumerate(x for x in (p.strip() for p in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\[])", text.replace("\n", " ").strip())) if x):
            width = math.floor(len(said) / max(math.ceil(len(said) / plan.CAPTION), 1) + 8)
            lines = []
            for w in re.split(r"\s+", said):
                if lines and len(lines[-1]) + 1 + len(w) <= width:
                    lines[-1] += " " + w
                else:
                    lines.append(w)
            yield from ((place, i, line) for i, line in enumerate(lines))

    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = sorted((i, *c) for i, t in items.items() for c in cues(t))
    got = plan.caption_cues(spark, sf).collect()
    assert sorted((r.item_id, r.sentence, r.cue, r.line) for r in got) == want
    assert all(re.fullmatch(r"\d\d:[0-5]\d:[0-5]\d,\d{3}", r.start) for r in got)


def test_decoded_windows_as_the_library(spark, sf):
    """The windows in plain Python: shards as lists of ids, draws by MD5, texts by the tokenizers library."""
    import hashlib

    from tokenizers import Tokenizer

    from millrace.plans import tokens as plan

    tok, shards = Tokenizer.from_str(plan.vocabulary()), {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        own = shards.setdefault(r.source, [[]])
        if len(own[-1]) >= plan.SHARD_IDS:
            own.append([])
        own[-1] += [plan.BOS, *tok.encode(r.text, add_special_tokens=False).ids]
    draw = lambda salt, s, k: int(hashlib.md5(f"{plan.SEED}|{salt}|{s}|{k}".encode()).hexdigest()[:8], 16)
    want = []
    for s, own in shards.items():
        own = [(i, x) for i, x in enumerate(own) if len(x) > plan.WINDOW]
        for k in range(2 if own else 0):
            i, x = own[draw("shard", s, k) % len(own)]
            at = draw("start", s, k) % max(1, len(x) - plan.WINDOW)
            want.append((s, k, f"{s}_{i:04d}.bin", at, tok.decode(x[at : at + plan.WINDOW], skip_special_tokens=False)))
    assert sorted(tuple(r) for r in plan.decoded_windows(spark, sf).collect()) == sorted(want) and len(want) > 10


def test_seeded_shards_as_numpy(spark, sf):
    import zlib

    import numpy as np

    from millrace.plans import corpus, mixture

    own = {}
    for r in corpus._entries(spark, sf).where("split = 'train'").orderBy("source", "ord").collect():
        own.setdefault(r.source, []).append(r.path)
    want = sorted((s, paths[i], k) for s, paths in own.items() for k, i in enumerate(np.random.default_rng([mixture.SEED, zlib.crc32(s.encode())]).permutation(len(paths))))
    assert sorted(tuple(r) for r in mixture.seeded_shards(spark, sf).collect()) == want


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).agg({"n_flagged": "sum"}).first()[0] == 3


def test_names_agree():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
