"""Wrappers: order, template text, comments and names, and all given pages against a second implementation."""

import html.parser
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from fleetvane.llm import common, wrappers

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>x</p></article><div class='comment-list'><article class='comment'><p>reader comment</p></article></div>", "x"),
        ("<article><p>x</p><section id='comments'><article><p>me too</p></article></section></article>", "x"),
        ("<article><p>x</p><ol class='replies'><li><main>no</main></li></ol></article>", "x"),
        ("<article class='post comments-open'><p>x</p></article>", "x"),
        ("<article>a<section id='search-algorithms'>b</section><section class='related-work'>c</section></article>", "a b c"),
        ("<article><div class='article-header'><h1>T</h1></div><p>x</p></article>", "T x"),
        ("<article><p>x</p><div class='related-posts-list'>kept, as posts is no word of boilerplate</div><div class='social-share-buttons'>no</div></article>", "x kept, as posts is no word of boilerplate"),
        ("<div class='site-footer'>no</div><div id='cookie_banner'>no</div><p>x</p>", "x"),
    ],
)
def test_names(page, want):
    assert wrappers.main_text(f"<body>{page}</body>") == want


def site(rng, n):
    """Pages whose unnamed blocks are alike on all pages of a host, in bodies of differing structure."""
    rows = []
    for i in range(n):
        host = f"h{i % 4}"
        parts = [f"<h1>Title {i}</h1>", f"<div><p>Best of {host} since 1999</p></div>", *[f"<p>Text {i}.{k} {rng.random()}</p>" for k in range(rng.randrange(1, 5))]]
        parts += rng.choice([[], ["<ul><li>one<li>two</ul>"], ["<table><tr><td>1<td>2</table>"], [f"<blockquote>q{i}</blockquote>", f"<p>after {i}</p>"]])
        rows.append((i, f"https://{host}/{i}", f"<body><article>{''.join(parts)}<div><span>Tell a friend of {host}</span></div></article></body>"))
    return rows


def test_template_text_is_left_out(spark):
    rows = site(random.Random(1), 60)
    df = spark.createDataFrame(rows, PAGES).repartition(5)
    got = {r.page_id: r.text for r in wrappers.main_texts(df).collect()}
    alone = {i: wrappers.main_text(page) for i, _, page in rows}
    for i in got:
        assert "since 1999" in alone[i] and got[i] == alone[i].replace(f"Best of h{i % 4} since 1999 ", "").replace(f" Tell a friend of h{i % 4}", "")


def test_order_of_pages_changes_nothing(spark):
    rng = random.Random(2)
    tags = ["p", "h2", "ul", "div", "section", "blockquote", "pre"]
    rows = []
    for i in range(120):  # twenty hosts of six random pages
        body = "".join(f"<{t}>{rng.choice(['same', f'own {i} {k}'])}</{t}>" for k, t in enumerate(rng.choices(tags, k=rng.randrange(1, 9))))
        rows.append((i, f"http://h{i % 20}/", f"<body>{body}</body>"))
    found = []
    for order, parts in ((rows, 1), (rows, 3), (rows[::-1], 50), (rows[::2] + rows[1::2], 7)):
        df = spark.createDataFrame(order, PAGES).repartition(parts) if parts > 1 else spark.createDataFrame(order, PAGES).coalesce(1)
        found.append(sorted(map(tuple, wrappers.main_texts(df).collect())))
    assert found[0] == found[1] == found[2] == found[3]


def test_many_structures(spark, monkeypatch):
    """More wrappers of a host than are aligned in one go."""
    monkeypatch.setattr(wrappers, "GROUP", 3)
    rng = random.Random(3)
    rows = [(i, "http://one/", "<body><h1>Always here</h1>" + "".join(f"<{t}>v{i}.{k}</{t}>" for k, t in enumerate(rng.choices(["p", "pre", "h3", "div"], k=6))) + "</body>") for i in range(40)]
    df = spark.createDataFrame(rows, PAGES)
    assert wrappers.infer_wrappers(df).select("host", "pages").collect() == [("one", 40)]
    got = wrappers.main_texts(df.withColumn("host", F.lit("clash")).withColumn("salt", F.lit(1))).collect()
    assert len(got) == 40 and all("Always" not in r.text and r.text.split() == [f"v{r.page_id}.{k}" for k in range(6)] for r in got)


def test_copies_keep_their_text(spark):
    story = "<h1>The headline</h1>" + "<p>A common paragraph of the story that all versions have.</p>" * 3
    rows = [(i, "http://news/", f"<body><article>{story}<p>v{i}</p></article></body>") for i in range(7)]
    assert all("The headline" in r.text and "common" in r.text for r in wrappers.main_texts(spark.createDataFrame(rows, PAGES)).collect())


def test_long_page_and_ties(spark):
    long = "<body><article>" + "<p>word </p>" * 50_000 + "</article></body>"
    rows = [(1, "http://a/", long)] * 2 + [(1, "http://a/", "<body><article>other</article></body>")]
    got = sorted(r.n_chars for r in wrappers.main_texts(spark.createDataFrame(rows, PAGES)).collect())
    assert got == [5, 5 * 50_000 - 1, 5 * 50_000 - 1]


class Plain(html.parser.HTMLParser):
    """What stands in article, outside of what is never main text; for pages as simple as the given ones."""

    NOT, ENDLESS = {"nav", "header", "footer", "aside", "form", "script", "style"}, {"br", "meta", "link", "img", "hr"}
    LINES = {"a", "b", "i", "em", "strong", "span", "code", "small", "br"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.article = self.out = 0
        self.stack, self.pieces = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in self.LINES and self.article:
            self.pieces.append(" ")
        if tag == "br":
            self.pieces.append(" " if "br" not in wrappers.INLINE else "")
        if tag not in self.ENDLESS:
            self.stack.append((tag, tag in self.NOT or dict(attrs).get("class") in {"ad", "comments", "sidebar"}))
            self.article += tag == "article"
            self.out += self.stack[-1][1]

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.stack]:
            while self.stack:
                name, out = self.stack.pop()
                self.article -= name == "article"
                self.out -= out
                if name == tag:
                    break
            if tag not in self.LINES:
                self.pieces.append(" ")

    def handle_data(self, data):
        if self.article and not self.out:
            self.pieces.append(data)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_all_given_pages_by_a_second_parser(spark, sf):
    pages = common.table(spark, sf, "pages")
    got = {r.page_id: r.text for r in wrappers.main_texts(pages).collect()}
    wrong = []
    for r in pages.collect():
        p = Plain()
        p.feed(r.html or "")
        p.close()
        if " ".join("".join(p.pieces).split()) != got[r.page_id]:
            wrong.append(r.page_id)
    assert not wrong, (len(wrong), wrong[:3])
