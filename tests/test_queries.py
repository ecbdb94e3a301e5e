"""Every query of the library against its DuckDB twin, and those without one for their rows."""

import pytest

from tests.oracle import difference
from tidewatch.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    assert difference(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE_SQL[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_page_links(spark, sf_dir, tmp_path):
    assert catalog.QUERIES["o5_11_page_links"](spark, sf_dir).count() > 0
    html = """<a href="/a">1</a><a class=x href='/a'>2</a><A HREF="https://o.org/b?x=1&amp;y=2#z">3</A><a href="#t">4</a><a href="mailto:a@b.c">5</a><a href="javascript:f()">6</a>
<a href="//cdn.org/c">7</a><a href="d.html">8</a><a href=/e>9</a><!-- <a href="/no">10</a> --><script>t='<a href="/no">'</script><link href="/no"><a data-href="/no" href="http://h.org/f">11</a>"""
    rows = [(1, "https://site.org:81/p/q?r=/s", html), (2, "no address", html), (3, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    df = catalog.QUERIES["o5_11_page_links"](spark, f"file://{tmp_path}")
    whole = {"https://o.org/b?x=1&y=2#z", "http://h.org/f"}
    found = [(r["page_id"], r["link"]) for r in df.collect()]
    host = "https://site.org:81"
    assert sorted(found) == sorted([(1, x) for x in whole | {f"{host}/a", "https://cdn.org/c", f"{host}/e"}] + [(2, x) for x in whole])
    assert difference(df, catalog.ORACLE_SQL["o5_11_page_links"], str(tmp_path)) == ""
