"""The registered queries over whole tables: SQL where there is some, else schema and whole results."""

import math
from pathlib import Path

import duckdb
import pytest

from millrace.llm import queries, sharding


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    plain = lambda rows, names: sorted((tuple(None if isinstance(r[names.index(c)], float) and math.isnan(r[names.index(c)]) else r[names.index(c)] for c in sorted(names)) for r in rows), key=repr)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(cur.fetchall(), columns)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))


@pytest.mark.parametrize("limit", [3000, 20_000, 200_000])
def test_sharding_at_several_limits(spark, limit):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(sharding.oracle_sql(limit))
    columns = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    assert len({r[columns.index("shard_id")] for r in want}) > 5
    assert sorted(tuple(r) for r in sharding.assign(docs, limit).select(*columns).collect()) == want
