from pyspark.sql import functions as F

from shelfspark.llm.html_text import extract_text, page_text


def test_blocks_and_hidden_parts():
    page = "<html><head><title>T</title><style>x</style></head><body><p>One<p>Two &amp; <b>three</b><div>four</div>five<!-- c --><script>s()</script><span hidden>h</span><i style='display: none'>n</i><br>six"
    assert page_text(page) == "One\n\nTwo & three\n\nfour\nfive\nsix"


def test_lists():
    assert page_text("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>") == "- a\n- b\n  3. c\n  4. d"


def test_tables_are_aligned():
    page = "<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>日本<td>22</table>"
    assert page_text(page) == "Name      | N\nlong name | 1\n日本      | 22"


def test_spans_of_tables():
    assert page_text("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a | b\n  | c"
    assert page_text("<table><tr><td colspan=2>wide one<td>x<tr><td>1<td>2<td>3</table>") == "wide one | x\n1 | 2 | 3"
    assert page_text("<table><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>") == "a | b\n  | c\nd | e"
    assert page_text("<table><tfoot><tr><td>f<tbody><tr><td>b<thead><tr><td>h</table>") == "h\nb\nf"
    assert page_text("<table><tr><td colspan=99999>a<td>b<tr><td rowspan=0999999>c</table>") == "a | b\nc"


def test_lists_in_cells_keep_their_lines():
    assert page_text("<table><tr><td><ul><li>a<li>b</ul><td>x<tr><td>long cell<td>y</table>") == "- a       | x\n- b\nlong cell | y"


def test_visibility():
    for page, want in [
        ("<p aria-hidden=true>seen", "seen"),
        ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>d", "b\nd"),
        ("<div style='display:block;display:none'>a</div>b", "b"),
        ("<div style='display:none !important;display:block'>a</div>b", "b"),
        ("<div style='background:url(display:none)'>a</div>", "a"),
        ("<math><mi>x</mi><mo>=</mo><annotation>tex</annotation></math>", "x="),
        ("<svg><title>t</title><text>in svg</text><desc>d</desc></svg> out", "in svg out"),
        ("<textarea>a\n  b</textarea>", "a\n  b"),
        ("<select><option>one<option selected>two</select>", "two"),
        ("<select multiple><option>one<option>two</select>", "one\ntwo"),
        ("<dialog>closed</dialog><dialog open>shown</dialog>", "shown"),
        ("<details><summary>s</summary>more</details><details open><summary>t</summary>all</details>", "s\nt\nall"),
        ("a<!-->b<!--->c<!-- x -->d<!-- y --!>e<!-- z", "abcde"),
        ("<script>var a = '<!--';</script>seen<!-- c -->", "seen"),
        ("<input value=typed><input type=hidden value=no><input type=submit value=Go>", "typed Go"),
        ("<noscript>n</noscript><iframe>f</iframe><template>t</template><ruby>k<rp>(</rp><rt>r</rt></ruby>", "kr"),
    ]:
        assert page_text(page) == want, page


def test_implied_and_stray_tags():
    for page, want in [
        ("<head><title>t</title>text", "text"),
        ("<html><head><body><head><p>a</head>b", "a b".replace(" ", "")),
        ("<p>a</div>b</p>c", "ab\n\nc"),
        ("<div><table><tr><td>x</div>y</table>z", "xy\n\nz"),
        ("<ol start=-1><li>a<li value=7>b<li>c</ol>", "-1. a\n7. b\n8. c"),
        ("<ol start=1234567890123><li>a</ol>", "1. a"),
        ("<ul><li>a<table><tr><td><li>b</table><li>c</ul>", "- a\n\n  - b\n\n- c"),
        ("<table><td>a<td>b<tr><td>c</table>", "a | b\nc"),
        ("<h1>a<h2>b</h1>c", "a\n\nb\n\nc"),
        ("a</p>b", "a\n\nb"),
        ("<body>a</body>b", "ab"),
    ]:
        assert page_text(page) == want, page


def test_time_grows_with_length_only():
    import time

    for page in (
        "<head>" * 100_000 + "<div>x",
        "<b>" * 50_000 + "<p>" * 50_000 + "x",
        "<p>" + "<b>" * 50_000 + "<p></p>" * 50_000 + "x",
        "<ul><li>x" * 50_000,
        "<div>" * 100_000 + "x" + "</div>" * 100_000,
        "<table><tr><td>" * 3000 + "x",
        "<table>" + ("<tr>" + "<td rowspan=65534>a<td>b" * 100) * 300,
        "<table>" + "<tr><td colspan=1000>x" * 30_000,
        "<table><tr><td>" + "word " * 20_000 + "<td>" + "<tr><td>a<td>b" * 20_000,
        "</p>" * 50_000 + "x",
        "<!--" * 100_000,
        "<script>" * 50_000,
        "<" * 100_000 + "x",
        "<li>x" * 50_000,
    ):
        began = time.process_time()
        text = page_text(page)
        assert time.process_time() - began < 15, page[:60]
        assert len(text) < 400 * len(page)


def test_white_space_and_pre():
    assert page_text("a  \n b<pre>x\n  y</pre>c&nbsp;d") == "a b\n\nx\n  y\n\nc\xa0d"


def test_odd_markup():
    for page in ("", "<", "<a", "</p></p>", "<table><td>x", "<li>x", "&#0;&bogus;", "<p " + "a" * 10_000, "<!DOCTYPE html>"):
        page_text(page)
    assert page_text("<div>" * 20_000 + "deep") == "deep"
    assert "deep" in page_text("<table><tr><td>" * 200 + "deep")
    assert page_text("word " * 50_000).count("word") == 50_000


def test_operator(spark):
    rows = spark.createDataFrame([(1, "<p>a"), (2, None), (3, ""), (1, "<p>a")], "page_id long, html string").withColumn("text", F.lit(1)).withColumn("url", F.lit("u"))
    got = sorted((r.page_id, r.text, r.url) for r in extract_text(rows).collect())
    assert got == [(1, "a", "u"), (1, "a", "u"), (2, "", "u"), (3, "", "u")]
    assert extract_text(rows.limit(0)).collect() == []


def plain_words(page):
    """All words outside of what is never shown, by plain substitutions."""
    import html
    import re

    page = re.sub(r"(?s)<!--.*?-->", "", page)
    page = re.sub(r"(?is)<(head|script|style|noscript|template|iframe)\b.*?</\1\s*>", " ", page)
    return re.findall(r"\w+", html.unescape(re.sub(r"(?s)<[^>]*>", " ", page)))


def shown_words(page):
    import re

    return re.findall(r"\w+", page_text(page))


def test_words_of_all_pages_against_plain_code(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()
    assert all(shown_words(r.html) == plain_words(r.html) for r in rows)


def test_words_of_random_markup_against_plain_code():
    import random

    rng = random.Random(6)
    tags = ["p", "div", "b", "ul", "li", "blockquote", "h2", "section", "span", "table", "tr", "td", "pre", "dl", "dt", "dd", "a", "i"]
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(60)):
            t = rng.choice(tags)
            parts.append(rng.choice([f"<{t}>", f"</{t}>", f"w{rng.randrange(999)} ", f"<{t} class=x>", "&amp; ", "<br>", "<!-- c -->", "<hr/>"]))
        page = "".join(parts)
        assert sorted(shown_words(page)) == sorted(plain_words(page)), page
