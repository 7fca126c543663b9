"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import os

import duckdb
import pytest

import scriptorium

Q, S = scriptorium.queries(), scriptorium.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def shown(v):
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, duck, sf, name):
    df = Q[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name in S:
        got = duck.execute(S[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in got.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_whole_titles(spark, tmp_path):
    spark.createDataFrame([(1, "　题 目\t", "A, ,B", None), (2, None, None, None), (3, "T", "", 2000)], "fetch_id long, title string, authors string, year int").write.parquet(f"{tmp_path}/fetched.parquet")
    got = {tuple(r) for r in Q["mapped_rows"](spark, str(tmp_path)).collect()}
    assert got == {(1, "题 目", 2), (2, "", None), (3, "T", 0)}


def test_whole_abstracts(spark, tmp_path):
    texts = {1: "We, WE and 3 naïve ones.", 2: "融合  决策\n森林", 3: "", 4: " Да. ", 5: None}
    spark.createDataFrame(list(texts.items()), "id long, abstract string").write.parquet(f"{tmp_path}/papers.parquet")
    got = {tuple(r) for r in Q["rebuilt_abstracts"](spark, str(tmp_path)).collect()}
    assert got == {x for x in texts.items() if x[1] is not None}
