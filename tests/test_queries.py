"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quern.plans.registry import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["tokenize", "frontmatter_split", "search_topk", "quality_gate_review", "ingest_actions", "compile_upsert", "kb_index", "validate_report", "scan_shortlist", "rules"]


def norm(v):
    return float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", SOME)
def test_rows_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    df = QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr) == sorted((tuple(map(norm, r)) for r in cur.fetchall()), key=repr)


def test_each_query_of_the_base_has_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) >= 55


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
