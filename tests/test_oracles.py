"""Every registered query against its DuckDB counterpart on the smallest tables."""

import duckdb
import pytest

import corvane.operators  # noqa: F401
from corvane.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    return f"{float(v):.9g}" if type(v).__name__ in ("float", "Decimal") else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_decoding_of_odd_texts_equals_its_sql(spark, tmp_path):
    texts = ("é", "où", "È éé éê.", "Привет мир", "ωд", "知", "😀 é", " é\x00é", "\ufeffé", "é\r\né", "", None)
    odd = [(k, x) for k, x in enumerate(x for x in texts for _ in range(2))] + [(None, "é"), (None, None), (-3, "é"), (-4, "é"), (2**63 - 2, None)]
    spark.createDataFrame(odd, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = QUERIES["src_02_decode"](spark, str(tmp_path)).select("doc_id", "hash").collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(ORACLES["src_02_decode"]).fetchall(), key=str)
