"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from framelake import registry

DATA = "/root/testdata/sf0.001"


def tables():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(df):
    names = sorted(df.columns)
    plain = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return names, sorted(map(repr, (tuple(plain(x) for x in r) for r in df[names].astype(object).where(df[names].notna(), None).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    assert rows(registry.queries()[name](spark, DATA).toPandas()) == rows(tables().sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_every_box_is_cropped(spark):
    made = registry.queries()
    got = made["crop_all_boxes"](spark, DATA)
    assert got.count() == made["box_helpers"](spark, DATA).count() and got.where("rank > 3").count() > 0


def test_long_addresses_match_sql(spark, tmp_path):
    urls = ["http://h/" + "x" * n for n in (0, 48, 49, 50, 105, 106, 400)] + ["https://\u00fc.de/\u00e4*+~ \r\n?\U0001f600" * 9, "", None]
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    con.sql(f"COPY pages TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    assert rows(registry.queries()["url_parts"](spark, str(tmp_path)).toPandas()) == rows(con.sql(registry.oracle_sql()["url_parts"]).df())
