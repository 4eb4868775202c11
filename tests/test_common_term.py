"""Search for a term that most pages hold."""

import duckdb

import __spark_entry__  # noqa: F401  (the repository's own path)
from revlake.plans import queries

SF = "/root/testdata/sf0.01"
TERM = "nav><ul"


def test_common_term_on_pages_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(f"WITH {queries._search_sql('pages', 'page_id', 'html', TERM, 'page')} SELECT * FROM k").df()
    got = queries._hits(queries.search.search_corpus(queries._corpus(spark, SF, "pages", "page_id", "html"), ["text"], TERM, "page", None)).toPandas()
    # adding 0.0 makes -0.0 and 0.0 one
    text = lambda df: sorted(tuple(f"{v + 0.0:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert text(got) == text(want) and 2 * len(got) > con.execute("SELECT count(*) FROM pages").fetchone()[0]
