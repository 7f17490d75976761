from pyspark.sql import functions as F

from strandwerk.functions import text as T
from strandwerk.operators.html import html_text, html_to_text


def one(spark, col, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(col(F.col("x"))).collect()]


def test_urls(spark):
    page = """<A HREF='https://a.example/1'>x</A> <a href="/rel">r</a> <img src="https://b.example/2"> <a href="mailto:x@y.example">m</a> <a href="javascript:f()">j</a> text https://c.example/3 and https://a.example/1"""
    assert one(spark, T.urls, page) == [["https://a.example/1", "https://b.example/2", "https://c.example/3"]]
    assert one(spark, lambda c: T.ignored(c, ["example.com"]), "https://example.com/page", "https://deep.sub.example.com/page", "//example.com", "ftp://example.com", "https://example.net/page", "not-a-url", "") == [True] * 4 + [False] * 3


def test_articles(spark):
    df = spark.createDataFrame([("Just a moment...", "x" * 300), ("t", "x" * 199), ("t", "x" * 200), (None, "x" * 200), ("t", None)], "t string, c string")
    assert [r[0] for r in df.select(T.valid_article(F.col("t"), F.col("c"))).collect()] == [False, False, True, True, False]


def test_dates_and_cells(spark):
    assert [str(x) for x in one(spark, T.flexible_date, "2024-05-07", "05/07/2024", "May 7, 2024", "2024-05-07T10:00:00Z", "nonsense", None)] == ["2024-05-07"] * 4 + ["None"] * 2
    assert one(spark, T.money_cell, "$ 1,234", "(1,234)", "-", None, "") == [1234.0, -1234.0, None, None, None]
    assert one(spark, T.wiki_markdown, "== H ==\n'''b''' [[p|t]] {{x {{y}}}}<ref>z</ref>") == ["## H\n**b** t "]


def test_html(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><main><h1>Head</h1><p>One <b>two<p>three</p><script>var a='</p>'</script><ul><li>x<ul><li>y</ul></ul><h3>Sub</h3></main></body>"
    assert html_text(page) == "Title: T\n# Head\nOne two\nthree\n- x\n- y\n### Sub"
    assert html_text("plain text") == "plain text" and html_text("") == "" and html_text(None) is None
    df = spark.createDataFrame([(page,), (None,), ("p",)], "x string")
    assert [r[0] for r in df.select(html_to_text(F.col("x"))).collect()] == [html_text(page), None, "p"]
