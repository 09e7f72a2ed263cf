import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = ["index_doc", "url_normalize", "robots_rules", "sitemap_index", "url_section", "job_history",
         "rate_limit", "boilerplate_lines"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) == {"site", "doc"}
    assert all(r.doc.startswith("# ") and r.doc.endswith("\n") for r in rows)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 70


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple("NULL" if v is None or v != v else (repr(round(v, 9)) if isinstance(v, float) else str(v))
                         for v in r))
    return sorted(out)


def test_quick_queries_match_duckdb(spark):
    con = duckdb.connect()
    for t in ["pages", "documents", "events", "orders", "customer"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in QUICK:
        sdf = entry.queries()[name](spark, SF)
        cols = sorted(sdf.columns)
        got = _norm(tuple(r[c] for c in cols) for r in sdf.collect())
        ddf = con.execute(entry.oracle_sql()[name]).df()
        exp = _norm(ddf[cols].itertuples(index=False, name=None))
        assert got == exp, name
