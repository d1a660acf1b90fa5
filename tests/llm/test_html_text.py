"""Main text: the article of marked-up pages, density rules for pages without, broken markup, linear time."""

import html
import time
from html.parser import HTMLParser

from lintlake.llm import html_text
from lintlake.llm.shared import read_table

PROSE = "It was the best of the times and it was the worst of them, for all that we had before us, and there was not much more to be said of it by any of those who were there. "


class Article(HTMLParser):
    """Plain reading of the article element: its blocks are what p and h1 tags cut."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        elif tag == "br" and self.inside:
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def plain(page):
    reader = Article()
    reader.feed(page)
    reader.close()
    return "\n\n".join(" ".join(b.split()) for b in reader.blocks if b.strip())


def test_articles_of_the_table(spark):
    pages = read_table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in html_text.extract_pages(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_margins_go_and_the_article_stays():
    page = f"""<!doctype html><title>No &amp; title</title><style>p{{}}</style><header><h1>Site name of the day</h1></header><div id="cookie-notice"><p>{PROSE * 2}</p></div>
    <main><article class="post has-sidebar"><header class="entry-header"><h1>The  head\n line</h1></header><p>Short one.</p><p>{PROSE * 2}<span class="ad">Buy it now</span> tail</p>
    <div class="share-buttons">Share it</div><aside>Aside of {PROSE * 2}</aside><form><p>Name {PROSE * 2}</p></form><pre>x = 1 &lt; 2</pre>
    <p>Café &eacute; &#x41; &amp;amp; &copy; 2020</p><section id="comments"><article class="comment"><p>{PROSE * 2}</p></article></section></article></main>
    <div class="sidebar"><p>{PROSE * 2}</p></div><footer>&copy; all of it</footer><script>document.write("<p>{PROSE}</p>")</script>"""
    prose = " ".join((PROSE * 2).split())
    assert html_text.main_text(page) == "\n\n".join(["The head line", "Short one.", prose, "tail", "x = 1 < 2", "Café é A &amp; \xa9 2020"])


def test_density_rules_without_an_article():
    links = "".join(f'<li><a href="/{i}">item number {i}</a></li>' for i in range(9))
    page = f"<body><div><ul>{links}</ul></div><div>Short before</div><h2>A heading</h2><p>{PROSE * 2}</p><p>Short between.</p><div>{PROSE * 2}</div><ul>{links}</ul><p>Short after</p><p>\xa9 2020 of the firm</p></body>"
    prose = " ".join((PROSE * 2).split())
    assert html_text.main_text(page) == "\n\n".join(["A heading", prose, "Short between.", prose])
    listed = " ".join(f"Zkr{i} qvt{i}" for i in range(60))
    assert html_text.main_text(f"<p>{listed}</p><p>{PROSE * 2}</p><p>{listed}</p>") == prose


def test_broken_markup():
    text = html_text.main_text
    assert text("<article><p>one<p>two<b>three<br>four<br><br>five</article>after") == "one\n\ntwothree four\n\nfive"
    assert text("<article>a < b <3 </> <?php x ?><![CDATA[y]]><p title='>'>c</p><!-- <p>d --><p e") == "a < b <3\n\nc"
    assert text("<article><p>a</p><!-- never closed <p>b</p>") == "a"
    assert text("<article><p>a</p><script>x</p>") == "a" and text('<article><p title="x>a</p><p>b</p>') == "a\n\nb"
    assert text(None) == "" and text("") == "" and text("<") == "" and text("</p></p>") == ""
    assert text("<ARTICLE><P>Straße &nbsp; &unknown; &#0; x</P></ARTICLE>") == "Straße &unknown; � x"


def test_long_pages_take_linear_time():
    for piece in ("<p>a", "<b>", "</i>", "<!-- ", "<script>", "<a 'x", '<p title="', "<", "&", "<div class=ad>x", "<br>"):
        seconds = []
        for n in (20_000, 80_000):
            start = time.process_time()
            html_text.main_text("<article>" + piece * n)
            seconds.append(time.process_time() - start)
        assert seconds[1] < 12 * max(seconds[0], 0.05), piece


def test_table_cases(spark):
    rows = [(1, "u", None, "t"), (1, "u", "<article><p>a</p>", "t"), (None, None, "", "t")]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", "", 0), (1, "u", "a", 1), (None, None, "", 0)], key=repr)
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert html.unescape("&amp;") == "&"
