"""Plan-shape guards for the scale properties the README claims."""


from tidemark.operators import validate as V
from tidemark.plans import site_docs as SD
from tidemark.session import table

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_does_not_shuffle_html(spark):
    plan = _plan(SD.extracted_pages(table(spark, SF, "pages"), materialize=False))
    assert "Exchange" not in plan and "Join" not in plan


def test_no_page_is_cut(spark):
    pages = table(spark, SF, "pages")
    assert SD.extracted_pages(pages, materialize=False).count() == pages.count()


def test_disallow_is_equi_join_not_nested_loop(spark):
    urls = spark.createDataFrame([("s", "https://s/a/b")], "site string, url string")
    rules = spark.createDataFrame([("s", "/a")], "site string, prefix string")
    plan = _plan(V.drop_disallowed(urls, rules))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
