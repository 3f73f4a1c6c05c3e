"""A page's URL comes back from the archives as it was, and the query returns it."""

from talkgrain.llm import queries

URLS = [None, "", "http://a.b/c?d=e%20f", "http://a.b/c d", "x\ty\r\nX-Page-Id: 9", ' "quoted" \\ ', "http://é.example/ü: v", "\u0085 "]


def test_urls_of_any_form_come_back(spark, tmp_path):
    rows = [(i, u, "same" if i % 2 else f"page {i}") for i, u in enumerate(URLS)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.url, r.refers_to) for r in queries.op5_warc(spark, str(tmp_path)).collect()}
    assert got == {i: (u, 1 if i % 2 and i > 1 else None) for i, u, _ in rows}
