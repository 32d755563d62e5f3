"""Holds queries against their SQL in DuckDB, the way the driver does: same columns, same rows in any order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings crawled_data crawl_cache scraping_result readability_score site_links benchmark context_windows".split()


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def plain(v):  # noqa: ANN001, ANN201
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") and v.tzinfo else v


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:  # noqa: ANN001
    """'' if both hold the same rows, else what differs."""
    names = sorted(df.columns)
    ours = Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    cur = con.execute(sql)
    theirs_names = [c[0] for c in cur.description]
    if sorted(theirs_names) != names:
        return f"columns {names} and {sorted(theirs_names)}"
    order = [theirs_names.index(n) for n in names]
    theirs = Counter(tuple(plain(r[k]) for k in order) for r in cur.fetchall())
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:2]}; only theirs {list((theirs - ours).items())[:2]}"
