"""Every query with SQL holds against DuckDB; the others run and have rows."""

from __future__ import annotations

import math
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.oracle import connect, differences
from webloom.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():  # noqa: ANN201
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name) -> None:  # noqa: ANN001
    assert differences(QUERIES[name](spark, DATA), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name) -> None:  # noqa: ANN001
    assert QUERIES[name](spark, DATA).count() > 0


def test_page_queries_take_every_page(spark, tmp_path) -> None:  # noqa: ANN001
    rows = [
        (1, "https://a.example/1", '<html lang="en"><head><title>Salt &amp; Pepper &eacute; &#8211; 5 &lt; 6</title></head><body><nav><a href="/">x</a></nav><main>t</main></body></html>'),
        (2, "https://a.example/2", '<html lang="de"><head><title>Code</title><script>var a = "<nav>";</script></head><body><article><pre>&lt;a href="x"&gt; &lt;nav&gt; &lt;main&gt;</pre><a href="/y">y</a><pre><code>z</code></pre></article></body></html>'),
        (3, None, None), (4, "https://a.example/4", ""),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/crawled_data.parquet")
    meta = {(r.page_id, r.title, r.language) for r in QUERIES["d10_metadata"](spark, str(tmp_path)).collect()}
    assert meta == {(1, "Salt & Pepper é – 5 < 6", "en"), (2, "Code", "de"), (3, "", ""), (4, "", "")}
    parts = {(r.page_id, r.links, r.scripts, r.navs, r.has_main, r.has_article) for r in QUERIES["d21_structure"](spark, str(tmp_path)).collect()}
    assert parts == {(1, 1, 0, 1, True, False), (2, 1, 1, 0, False, True), (3, 0, 0, 0, False, False), (4, 0, 0, 0, False, False)}


def test_entry_has_columns(spark) -> None:  # noqa: ANN001
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "term", "count", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_quality_is_rounded_as_in_sql_to_the_last_place(spark, tmp_path) -> None:  # noqa: ANN001
    values = [*(k / 10 for k in range(-50, 2600)), None, math.nan, math.inf, -math.inf, 1e305, -1e305]
    rows = [(10 * k + v, kind, x) for k, x in enumerate(values) for v, kind in ((5, "view"), (2, "view"), (9, "error"), (7, None))]
    ids, kinds, marks = zip(*rows, strict=True)
    pq.write_table(pa.table({"event_id": pa.array(ids, pa.int64()), "event_type": kinds, "value": pa.array(marks, pa.float64(), from_pandas=False)}), tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    want = {i: repr(c) for i, c in con.execute(SQL["a17_quality"]).fetchall()}
    assert {r.event_id: repr(r.confidence) for r in QUERIES["a17_quality"](spark, str(tmp_path)).collect()} == want and len(want) == len(rows)
