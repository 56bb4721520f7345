"""Page texts against the tables' template, hand-made pages and a plain LCS."""
import os
import random
import re
import time
from html import unescape

import pytest

from slatemill.llm.page_diff import main_text, page_lines, shared_lines

SF = "/root/testdata/sf0.01"


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment():
    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(12))] for _ in range(2))
        got, rest = shared_lines(a, b), iter(b)
        assert len(got) == lcs(a, b) and got == sorted(set(got)) and all(a[i] in rest for i in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_driver_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(x for x in blocks if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_structure():
    html = ('<html><body class="has-sidebar"><header>Top</header><div class="top-menu"><div>x</div>Menu</div><main><header><h1>T &amp; &lt;i&gt;</h1></header>A\n <b>b</b>old'
            '<br>c<script>var s="</p>"</script><ul><li>one<li>two</ul><form>f<input>g</form><div id="user_comments"><p>hi</p></div>&#233;&nbsp;z</main><div>after</div></body>')
    assert page_lines(html) == (["T & <i>", "A bold c", "one", "two", "é z"], True)
    assert page_lines(None) == page_lines("") == ([], False)
    assert page_lines("<p>a<p>b <nav>n") == (["a", "b"], False)


def test_differencing(spark):
    page = lambda *lines: "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"
    rows = [(1, "http://h.example/a/1", page("Site", "Menu x", "first text", "end")), (2, "http://h.example/a/2?p=1", page("Site", "second text", "Menu x", "more", "end")),
            (3, "http://h.example/b/1", page("Other", "third")), (4, "http://lone.example/", page("Site", "alone")), (5, None, page("n")), (6, "http://[bad", None),
            (7, "http://c.example/x", page("copy", "me")), (8, "http://c.example/y", page("copy", "me")), (9, "http://c.example/z", page("copy", "other")),
            (1, "http://u@H.example/a/1", "<article>kept Site</article><p>Site</p>"), (None, "http://q.example/q", "plain &amp; text")]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, row int").repartition(3)
    got = sorted(((r.page_id, r.text) for r in main_text(df).collect()), key=str)
    want = [(1, "first text"), (1, "kept Site"), (2, "second text\nmore"), (3, "Other\nthird"), (4, "Site\nalone"), (5, "n"), (6, ""), (7, "me"), (8, "me"), (9, "other"), (None, "plain & text")]
    assert got == sorted(want, key=str)
    assert main_text(df.limit(0)).collect() == []


def test_furniture_ends_where_its_end_tag_was_left_out():
    assert page_lines("<ul><li class=share>x<li>y</ul><p>Body") == (["y", "Body"], False)
    assert page_lines("<p class=notice>n <b>m<p>Body</p>") == (["Body"], False)
    assert page_lines("<ul><li>a<li class=share><p>x<ul><li>in</ul>out</ul>Body") == (["a", "Body"], False)
    assert page_lines("<article><p>one<p class=ad>x</article>after") == (["one"], True)
    assert page_lines("<table><tr><td class=ad>x<td>y<tr class=promo><td>z<td>w<tr><td>v</table>Body") == (["y", "v", "Body"], False)
    assert page_lines("<dl><dt class=promo>x<dd>y</dl><div class=ad><div>z</b></p></div>u</div>t") == (["y", "t"], False)
    assert page_lines('<main>Text<article class="comment">c<p>d</article>more</main>') == (["Text", "more"], True)


def test_runs_of_copies_meet_the_nearest_other_page(spark):
    page = lambda *lines: "".join(f"<div>{x}</div>" for x in lines)
    rows = [(1, "http://h.example/a", page("Menu", "one"))] + [(i, f"http://h.example/b{i}", page("Menu", "same")) for i in range(2, 7)]
    rows += [(7, "http://h.example/c", page("Menu", "two")), (8, "http://k.example/b3", page("Menu", "same"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = {1: "one", **{i: "same" for i in range(2, 7)}, 7: "two", 8: "Menu\nsame"}
    assert {r.page_id: r.text for r in main_text(df).collect()} == want


def test_broken_pages_take_linear_time():
    """Elements that are never closed, of each kind that the parser follows."""
    for tag in ("span", "div", "li", "p", "option"):
        start = time.process_time()
        lines, _ = page_lines(f"<{tag}>x " * 20_000 + "</b>" * 20_000)
        assert "x" in " ".join(lines) and time.process_time() - start < 3


def test_marked_pages_are_differenced(spark):
    """An article that the nearest page repeats whole is a teaser; one with lines of its own keeps the shared ones too."""
    teaser = "<article><h2>Read next</h2><p>Another story</article>"
    page = lambda *lines: "<p>Site</p><article>" + "".join(f"<p>{x}" for x in lines) + f"</article>{teaser}<p>Imprint</p>"
    rows = [(1, "http://h.example/a1", page("First", "common line")), (2, "http://h.example/a2", page("Second", "common line")), (3, "http://h.example/a2?x", page("Second", "common line")),
            (4, "http://k.example/", page("Lone")), (5, "http://h.example/b", "<p>Site</p><p>free</p><p>Imprint</p>")]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()}
    assert got == {1: "First\ncommon line", 2: "Second\ncommon line", 3: "Second\ncommon line", 4: "Lone\nRead next\nAnother story", 5: "Site\nfree\nImprint"}
