import duckdb
import pytest

import __spark_entry__ as entry
from inkwell.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(frame, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql).df()
    got = frame.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].values.tolist()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def test_upsert_removes_documents_of_any_source(spark, tmp_path):
    rows = [(k, f"text {k}", "en", f"{'other' if k % 4 else 'src1'}{k % 3}", 6) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"] for r in QUERIES["upsert_snapshot"](spark, str(tmp_path)).collect()}
    assert got == {k for k in range(60) if k % 10}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
