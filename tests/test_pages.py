"""Page scan: comments, raw elements with other end tags inside, character references."""

import pytest
from pyspark.sql import functions as F

from veil.operators.pages import scan_pages, unescape


def nodes(spark, html):
    return scan_pages(spark.createDataFrame([(1, html)], "page_id int, html string")).first()["nodes"]


@pytest.mark.parametrize("html, want", [
    ("<p>a</p><script>var t = '</style>'; key = 'x'</script><p>b</p>", ["a", "b"]),
    ("<style>p > a::after{content:'</script>'}</style>b", ["b"]),
    ("<p>a<!-- <b>secret</b> --></p><!-- open <p>c</p>", ["a"]),
    ("<p>a</p><script>never closed <p>b</p>", ["a"]),
    ("<SCRIPT type=x>a</Script >b<noscript>c</noscript>", ["b"]),
    ("<scripted>a</scripted>", ["a"])])
def test_unseen_parts(spark, html, want):
    assert nodes(spark, html) == want


@pytest.mark.parametrize("text, want", [
    ("ravi&#64;x.com &mdash; &#x1F600;&#X41;", "ravi@x.com — \U0001f600A"), ("&amp;lt; &lt;b&gt; &quot;&apos;&#39;", "&lt; <b> \"''"),
    ("a&nbsp;b&#160;c", "a b c"), ("&nosuch; &#0; &#xD800; &#9999999; &;", "&nosuch; &#0; &#xD800; &#9999999; &;"),
    ("R&D", "R&D"), (None, None), ("", "")])
def test_character_references(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(unescape(F.col("t")).alias("t")).first()["t"] == want
