"""Every query of the site part against its SQL, on the smallest tables and for several partition counts."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from pagelens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([v[k] for k in order]) for v in values)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_same_rows_for_any_number_of_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = set()
        for n in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.add(str([rows(d.columns, map(tuple, d.collect())) for d in (registry.QUERIES[q](spark, SF) for q in ("link_folds", "site_positions", "root_causes"))]))
        assert len(seen) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sitemap_pages_of_a_large_host(spark, tmp_path):
    """a host of more than 20,000 URLs in more than five files, against the SQL."""
    pages = str(tmp_path / "pages.parquet")
    spark.range(61_000).selectExpr("id AS page_id", "CASE WHEN id % 100 = 0 THEN 'https://B.com/' || id ELSE 'http://a.com/' || (id - id % 7) END AS url", "'' AS html").write.parquet(pages)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{pages}/*.parquet'")
    got, want = registry.QUERIES["sitemap_pages"](spark, str(tmp_path)), con.sql(registry.ORACLE_SQL["sitemap_pages"])
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_page_records_of_odd_titles(spark, tmp_path):
    """titles with entities, cut entities and none, against the SQL; the decoded title stays in the record."""
    titles = ["a &amp;&amp; b", "cut &amp", "cut &am", "token = &quot;0b96", "&lt;b&gt; &copy; &#39; &amp;quot;", "\n two\t lines \f", "&amp;amp;", "x < y", "", " "]
    pages = [f"<html><title>{t}</title><body><h1>h</h1>text" for t in titles]
    pages += ["<TITLE lang=de>a</Title><title>b &amp; c</title>", "<title>never closed", "<!-- <title>in &quot;</title> --><title>out</title>", "<h1>no title</h1>", "", None]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame([(k, f"https://a.com/{k}", h) for k, h in enumerate(pages)], "page_id long, url string, html string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    got, want = registry.QUERIES["page_records"](spark, str(tmp_path)), con.sql(registry.ORACLE_SQL["page_records"])
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())
