"""URL, text and HTML functions on single values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import html as H
from gleaner.functions import text as X
from gleaner.functions import url as U


def values(spark, items, function, kind="string"):
    rows = [(i, x) for i, x in enumerate(items)]
    df = spark.createDataFrame(rows, f"i int, x {kind}").select("i", function(F.col("x")).alias("y"))
    return [r.y for r in sorted(df.collect(), key=lambda r: r.i)]


URLS = [
    ("HTTPS://WWW.EXAMPLE.COM/Path", "https://www.example.com/Path"), ("http://example.com:80/path", "http://example.com/path"), ("https://example.com:443/", "https://example.com/"),
    ("https://example.com:8080/path", "https://example.com:8080/path"), ("https://example.com/path#section", "https://example.com/path"), ("https://example.com", "https://example.com/"),
    ("https://example.com/path/", "https://example.com/path"), ("https://example.com//a//b/", "https://example.com/a/b"), ("https://example.com/a/./b/../c", "https://example.com/a/c"),
    ("https://example.com/../../a", "https://example.com/a"), ("https://example.com/s?q=kotlin&utm_source=google&sort=date&fbclid=123", "https://example.com/s?q=kotlin&sort=date"),
    ("https://example.com/?b=2&a=1&b=3&c=", "https://example.com/?a=1&b=2&c"), ("https://example.com/a%252541", "https://example.com/a%41"), ("  https://example.com/x ", "https://example.com/x"),
    ("ftp://example.com/x", None), ("mailto:a@b.c", None), ("", None), ("   ", None), ("no url", None), (None, None),
]


def test_normalize_url(spark):
    assert values(spark, [u for u, _ in URLS], U.normalize_url) == [n for _, n in URLS]


def test_normalize_options(spark):
    strip = lambda u: U.normalize_url(u, strip_locale=True)
    assert values(spark, ["https://example.com/en-us/about", "https://example.com/en", "https://example.com/about/en"], strip) == ["https://example.com/about", "https://example.com/en", "https://example.com/about/en"]
    listed = lambda u: U.normalize_url(u, strip_locale=True, locales=["en", "en-us"])
    assert values(spark, ["https://example.com/fr/about", "https://example.com/EN/about"], listed) == ["https://example.com/fr/about", "https://example.com/about"]
    www = lambda u: U.normalize_url(u, strip_www=True)
    assert values(spark, ["https://www.example.com/", "https://www.com/"], www) == ["https://example.com/", "https://www.com/"]
    df = spark.createDataFrame([("https://bücher.example/a",)], "u string").withColumn("a", U.ascii_url("u"))
    assert df.select(U.normalize_url(F.col("a"))).first()[0] == "https://xn--bcher-kva.example/a"
    assert values(spark, ["HTTPS://www.Example.com:443/en/path/./to/../page/?z=3&utm_source=t&a=1&hsLang=en#s", "odd"], U.dedup_key) == ["https://example.com/path/page?a=1&z=3", "odd"]


def test_language_patterns(spark):
    path = lambda u: U.matches_path_language(u, "/en-us/", "https://x.test/")
    assert values(spark, ["https://x.test/", "https://x.test/EN-US/a", "https://x.test/fr/a", "https://x.test/about", "https://x.test/fr"], path) == [True, True, False, True, True]
    query = lambda u: U.matches_query_language(u, "lang", "en")
    assert values(spark, ["https://x.test/?lang=EN", "https://x.test/?lang=fr", "https://x.test/?a=1", "https://x.test/?lang=fr&lang=en"], query) == [True, False, True, True]


def test_url_parts(spark):
    assert values(spark, ["https://x.test/a//b/?q", "https://x.test", "https://x.test/%zz|"], U.path_depth) == [2, 0, 2**31 - 1]
    assert values(spark, ["see https://a.test/x). and https://a.test/x, https://b.test/y;"], U.urls_in_text) == [["https://a.test/x", "https://b.test/y"]]
    assert values(spark, ["https://x.test/files/Annual-report_2024.pdf"], U.title_from_url) == ["Annual report 2024"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.from_regex(r"https?://[a-z]{1,5}\.(com|de)(/[a-z.]{0,4}){0,3}(\?[a-z]=[0-9](&[a-z]=[0-9]){0,2})?", fullmatch=True), min_size=5, max_size=20))
def test_normalize_is_idempotent_without_escapes(spark, urls):
    once = values(spark, urls, U.normalize_url)
    assert values(spark, once, U.normalize_url) == once


def test_queries_and_keywords(spark):
    assert values(spark, ["Kotlin\nlang\tx", "  a   b ", "x" * 600, "hi \U0001f600 there", ""], X.query_text) == ["Kotlinlangx", "a b", "x" * 500, "hi there", ""]
    assert values(spark, ["The cat, the CAT sat on 5,900 mats"], X.keywords) == [["the", "cat", "sat", "900", "mats"]]
    assert values(spark, ["日本語"], X.bigrams) == [["日本", "本語"]]
    assert values(spark, ["日本語のテキスト", "der Hund und die Katze ist nicht da ein mal wie so oft", "short text", "123 456"], X.analyser) == ["cjk", "de", "en", "standard"]


def test_text_helpers(spark):
    pair = spark.createDataFrame([("alpha beta gamma", "beta alpha"), ("a b", "x"), ("", "x")], "a string, b string")
    assert [round(r.o, 4) for r in pair.select(X.word_overlap(F.col("a"), F.col("b")).alias("o")).collect()] == [0.6667, 1.0, 1.0]
    assert values(spark, ['x ```json\n{"a": 1}\n``` y', '{"b": 2}'], X.fenced_json) == ['{"a": 1}', '{"b": 2}']
    assert values(spark, [[3.0, 4.0], [0.0, 0.0]], X.unit_vector, "array<float>") == [[0.6, 0.8], [0.0, 0.0]]
    assert values(spark, [401, 410, 429, 503, 418, None], X.error_category, "int") == ["ACCESS_RESTRICTED", "NOT_FOUND", "RATE_LIMITED", "WEBSITE_UNAVAILABLE", "CONNECTION_FAILED", "CONNECTION_FAILED"]


def test_chunks_join_to_the_text(spark):
    texts = ["short", "", "Sentence one. " * 400, "para\n\n" * 900, "x" * 5000]
    got = values(spark, texts, X.chunks)
    assert ["".join(c) for c in got] == texts
    assert len(got[2]) > 1 and all(len(c) < 2200 for c in got[2])


def test_html(spark):
    page = '<html><head><title> T &amp; x </title></head><body><!-- c --><p>One<p>Two &lt;b&gt;<script>var a="</p>";</script><img src="a" alt=" pic "><img alt=""></body></html>'
    assert values(spark, [page], H.visible_text) == ["One\nTwo <b>"]
    assert values(spark, [page], lambda h: H.visible_text(h, True)) == ['One\nTwo <b>\n<image placeholder alt="pic"/>']
    assert values(spark, ['<a href="/x">1</a><a class=k href="y">2</a><a href=" ">3</a>'], H.hrefs) == [["/x", "y"]]
    base = F.lit("https://x.test/dir/page?q=1")
    assert values(spark, ["/a", "b", "//c.test/d", "https://e.test", "#f", "mailto:g"], lambda h: H.absolute(h, base)) == ["https://x.test/a", "https://x.test/dir/b", "https://c.test/d", "https://e.test", None, None]


TABLES = [
    ("<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>", "| A | B |\n| --- | --- |\n| 1 | 2 |"),
    ("<table><tr><th>A</th><th>B</th></tr><tr><td>a | b</td></tr></table>", "| A | B |\n| --- | --- |\n| a \\| b |  |"),
    ('<table><tr><th colspan="2">Spanning Header</th></tr><tr><td>x<br>y</td><td></td></tr></table>', "| Spanning Header |  |\n| --- | --- |\n| x y |  |"),
    ("<table><tr><td>1</td></tr></table>", "|  |\n| --- |\n| 1 |"), ("<table></table>", ""), ("none", ""),
]


def test_tables(spark):
    assert values(spark, [h for h, _ in TABLES], H.table_markdown) == [m for _, m in TABLES]


LISTS = [
    ("<ul><li>a</li><li>b</li></ul>", "* a\n* b"), ("<ol start=5><li>a</li><li>b</li></ol>", "1. a\n2. b"),
    ("<ul><li>a<ol><li>x</li><li>y</li></ol></li><li>b</li></ul>", "* a\n  1. x\n  2. y\n* b"), ("<ul><li></li><li>b <b>c</b></li></ul>", "*\n* b c"), ("", ""), ("none", ""),
]


def test_lists(spark):
    assert values(spark, [h for h, _ in LISTS], H.list_markdown) == [m for _, m in LISTS]


def test_markdown(spark):
    assert values(spark, ['<h2>T</h2><p>a <b>b</b> <a href="/u">c</a></p><ul><li>d</ul>'], H.to_markdown) == ["## T\n\na **b** [c](/u)\n\n* d"]


def test_traversal_of_a_cycle_with_a_dangling_edge(spark):
    from gleaner.operators import graph
    from gleaner.streaming.rounds import checkpointed

    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("a", "gone", "x"), ("a", "b", "x"), ("b", "d", "y")], "from_id string, to_id string, relation_type string")
    vertices = spark.createDataFrame([(c,) for c in "abcde"], "id string")
    seeds = spark.createDataFrame([("a",), ("gone",)], "id string")
    walk = lambda hops, dedupe: sorted(tuple(r) for r in graph.traverse(edges, vertices, seeds, hops, dedupe, checkpointed).collect())
    three = [(1, "a", "b", "x"), (2, "b", "c", "x"), (2, "b", "d", "y"), (3, "c", "a", "x")]
    assert walk(3, True) == walk(3, False) == walk(5, True) == three
    assert walk(4, False) == [*three, (4, "a", "b", "x")]


def test_patterns_of_a_host(spark):
    row = spark.range(1).select(U.patterns_of_host(F.lit("a.b.org")).alias("x"), U.patterns_of_host(F.lit(None).cast("string")).alias("y")).first()
    assert row.x == ["a.b.org", "*.a.b.org", "*.b.org", "*.org"] and row.y is None


def test_unit_vectors_of_odd_entries(spark):
    got = values(spark, [[3.0, None, 4.0], [None], [], None], X.unit_vector, "array<float>")
    assert got == [[0.6, None, 0.8], [None], [], None]
    zero = values(spark, [[0.0, None], [3.0, 4.0]], lambda v: X.unit_vector(v, F.lit(float("nan"))), "array<float>")
    assert str(zero) == "[[nan, None], [0.6, 0.8]]"
    assert str(values(spark, [-1e-9, -0.0, 1e-9, -0.25, None, float("nan")], lambda x: X.rounded(x, 6), "double")) == "[-0.0, -0.0, 0.0, -0.25, None, nan]"
