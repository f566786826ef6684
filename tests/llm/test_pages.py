import math

import pytest

from driftwell.llm import pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="ad">buy</div><div id="cookie-notice">cookies</div>
<article><h1>Head&amp;line &#233;</h1><p>One <b>two</b>th  ree&nbsp;four<br>five<p>six <!-- no > --> seven<form>f</form>
<div class="comments"><p>first!</p></div></article><aside>more</aside><footer>&copy; me</footer></body></html>"""


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, uid string, host string, text string, k0 string")


def texts(spark, rows, **kw):
    return {r.page_id: r.text for r in pages.extract_pages(frame(spark, [(*r, "a", "b", "c", "d") for r in rows]), "html", "url", ["page_id", "url"], **kw).collect()}


def test_article_of_a_page(spark):
    got = texts(spark, [(1, "http://a.example/1", PAGE)])
    assert got[1] == "Head&line é One twoth ree four five six seven"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain words", "plain words"), ("a < b & c", "a < b & c"), ("<p>one<p>two", "one two"), ("<p>cut <a href='x", "cut"),
        ("<div>a<!-- open", "a"), ("<script>x", ""), ("</p></div>odd", "odd"), ("<p>&lt;b&gt; &bogus; &#0;</p>", "<b> &bogus; �"),
        ("<ul><li>a<li>b</ul>c", "a b c"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<p title='>'>x</p>", "x"), ("<P>U<BR/>V</P>", "U V"),
        ("<div hidden>h</div><p style='display: none'>n</p>s", "s"), ("<main>m</main><div>outside</div>", "m"), ("<div class='post sidebar'><article>in</article></div>", "in"),
        ("x" * 300_000, "x" * 300_000), ("<div>" * 3_000 + "deep", "deep"), ("\x00a�", "\x00a�"),
    ],
)
def test_markup(html, text):
    blocks, elements = pages.parse(html or "")
    kept = pages.block_kinds(blocks, elements[0])
    assert " ".join(t for (_, t), k in zip(blocks, kept) if k) == text


def test_given_pages(spark):
    """The article as a second way of reading finds it."""
    import html
    import re

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in pages.page_texts(df).collect()}
    assert len(got) == df.count()
    for r in df.collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: "" if m.group() in ("<b>", "</b>") else " ", inside)).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_site_style_tree_removes_what_a_host_repeats(spark):
    """No tag or class tells here: only that most pages of the host show the same words in the same place."""
    rows = [
        (i, f"https://host.example/{i}", f"<html><body><div class='a'>Shop now at Example</div><div class='b'><h2>Title {i}</h2>" + "".join(f"<p>text {i} {j}</p>" for j in range(1 + i % 5))
         + ("<p>a quotation that many share</p>" if i % 2 else "") + "</div></body></html>")
        for i in range(40)
    ]
    got = texts(spark, rows + [(100, "https://other.example/", rows[0][2])])
    for i in range(40):
        assert "Shop now" not in got[i]
        assert got[i].startswith(f"Title {i} text {i} 0") and ("quotation" in got[i]) == bool(i % 2)
    assert got[100].startswith("Shop now at Example Title 0")


@pytest.mark.parametrize("pages_of_host", [1, 2, 4, 5, 7, 8, 12])
def test_small_hosts_follow_the_formula(spark, pages_of_host):
    """A notice on all pages goes as soon as one page more, without it, would not change the verdict."""
    rows = [(i, "https://s.example/", f"<body><div class='n'>Shop now</div><div class='t'>" + "".join(f"<p>text {i} {j}</p>" for j in range(1 + i % 3)) + "</div></body>") for i in range(pages_of_host)]
    gone = pages_of_host > 1 and pages.GAMMA * (1 - math.log(pages_of_host) / math.log(pages_of_host + pages.UNSEEN)) < pages.THRESHOLD
    assert gone == (pages_of_host >= 5)
    for i, text in texts(spark, rows).items():
        assert text == ("" if gone else "Shop now ") + " ".join(f"text {i} {j}" for j in range(1 + i % 3))


def test_copies_of_a_page_count_once(spark):
    rows = [(i, "https://h.example/", "<body><div><p>same page</p></div></body>") for i in range(30)]
    assert set(texts(spark, rows).values()) == {"same page"}


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "not an address", "<p>x</p>"), (2, "http://h", "")]
    found = sorted(((r.page_id, r.text, r.n_chars) for r in pages.page_texts(frame(spark, [(*r, "a", "b", "c", "d") for r in rows])).collect()), key=str)
    assert found == sorted([(1, "", 0), (1, "", 0), (None, "x", 1), (2, "", 0)], key=str)
    assert pages.page_texts(frame(spark, [])).count() == 0
