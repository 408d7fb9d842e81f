"""Main texts that the ratios find without help of tag names, and articles that keep all their blocks."""

import math
import re

import pytest

from skerry.llm import html
from skerry.llm.frames import table

SF = "/root/testdata/sf0.01"
LONG = "A paragraph with enough words, some commas, and a full stop at its end. It goes on for a while, as texts do."
NAMED = re.compile(r"<(/?)(?:article|nav|header|footer|aside|main|section)\b[^>]*>")


def neutral(page):
    return re.sub(r"\s(?:class|id)=\"[^\"]*\"", "", NAMED.sub(r"<\1div>", page))


def test_neutral_tags_leave_it_to_the_ratios(spark):
    precision, recall = [], []
    for r in table(spark, SF, "pages").collect():
        true, got = html.main_text(r.html).split("\n"), html.main_text(neutral(r.html)).split("\n")
        size = lambda lines: sum(map(len, lines)) or 1
        precision.append(size([x for x in got if x in true]) / size(got))
        recall.append(size([x for x in true if x in got]) / size(true))
    n = len(precision)
    assert n == 250 and sum(precision) / n >= 0.95 and sum(recall) / n >= 0.99


def test_an_article_keeps_all_its_blocks():
    inner = f"<div class='post-header'><h1>Title</h1></div><p>{LONG} {LONG}</p><table><caption>Sizes</caption><tr><td>one</td><td>2</td></tr></table><figure><img src=x><figcaption>A boat</figcaption></figure><pre>x = 1</pre><div class='alert'>Mind the gap</div><p>E is <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>mc^2</annotation></math>.</p><ul><li><a href=a>see this</a></li></ul>"
    want = ["Title", f"{LONG} {LONG}", "Sizes", "one", "2", "A boat", "x = 1", "Mind the gap", "E is mc2.", "see this"]
    outside = "<nav><a href=1>Home</a><a href=2>News</a></nav>{}<div class='comments'><p>" + LONG + "</p></div><footer>© all rights</footer>"
    for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class=story>", "</div>")):
        got = html.main_text("<body>" + outside.format(f"{open_}{inner}<aside>Ad here</aside><div class='share'>Tweet</div><form><input>Mail</form>{close}") + "</body>").split("\n")
        # where no element says that it is the article, a header and an alert are what their names say
        assert got == (want if "story" not in open_ else [x for x in want if x not in ("Title", "Mind the gap")]), open_


@pytest.mark.parametrize("raw", ["<script>var x='<!--';</script>", "<style>/* <!-- */</style>", "<script>if (a < b) { s = \"</p>\" + '\"' }</script>", "<SCRIPT>'</scripty>'</SCRIPT >", "<!-->", "<!--->", "<!-- a > b -- c -->", "<textarea><p>not this</textarea>"])
def test_scripts_and_comments_end_at_their_own_end(raw):
    assert html.main_text(f"<body>{raw}<p>{LONG}</p>{raw}<p>{LONG} Again.</p></body>") == f"{LONG}\n{LONG} Again."
    assert html.main_text("<body><p>one</p><script>never ends <p>two") == "one"


def test_menus_of_links_are_told_by_their_links():
    menu = "".join(f"<li><a href=/{k}>A rather long entry of a menu, with a comma, number {k}.</a></li>" for k in range(9))
    page = f"<body><div><ul>{menu}</ul></div><div><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div><div>© nobody</div></body>"
    assert html.main_text(page) == f"Title\n{LONG}\n{LONG}"


def test_scores_equal_plain_loops(spark):
    for r in table(spark, SF, "pages").limit(60).collect():
        blocks = [b for b in html.text_blocks(neutral(r.html)) if not b.bad]
        paths = list(dict.fromkeys(b.path for b in blocks))
        ratio = lambda f: [sum(map(f, own)) / len(own) for own in ([b for b in blocks if b.path == p] for p in paths)]
        side = math.exp(-0.5)
        near = lambda x, i: (x[i] + side * sum(x[j] for j in (i - 1, i + 1) if 0 <= j < len(x))) / (1 + side * sum(0 <= j < len(x) for j in (i - 1, i + 1)))
        texts, marks = ratio(lambda b: len(b.text)), ratio(lambda b: sum(c in ",.;:!?，。；：！？、" for c in b.text))
        links = [sum(b.linked for b in blocks if b.path == p) / sum(len(b.text) for b in blocks if b.path == p) for p in paths]
        got = html.path_scores(blocks, 4.0)
        assert list(got) == paths
        for i, p in enumerate(paths):
            assert got[p] == pytest.approx(near(texts, i) * (1 + near(marks, i)) * (1 - links[i]))
