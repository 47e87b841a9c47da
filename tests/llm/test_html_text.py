import html
import random
import re
import time

import pytest

from sightline.llm import html_text

from .conftest import SF

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad">Buy &amp; save</div>
<div class='cookie-notice'>We use <p>cookies</p></div><article><h1>Title &amp; more</h1><p>First   para
graph with <b>bold</b> text<br>and a break.<p>Second &#233;&nbsp;one.<form><input>Sign up</form><p>End.
<aside>Related</aside><section class="comments"><p>nice read</p></section></article><footer>&copy; x</footer></body></html>"""


def test_article_only():
    assert html_text.main_text(PAGE) == "Title & more\nFirst para graph with bold text and a break.\nSecond é one.\nEnd."


def test_without_an_article_element_the_dense_lines_count():
    body = "".join(f"<p>This is paragraph {i} with quite a few words in it.</p>" for i in range(5))
    page = f"<div><a href=x>Home</a> <a href=y>News</a></div><div>{body}</div><footer>imprint</footer><div>ok</div>"
    assert html_text.main_text(page).split("\n") == [f"This is paragraph {i} with quite a few words in it." for i in range(5)]
    assert html_text.main_text("<p>Hi.") == "Hi."
    assert html_text.main_text("") == html_text.main_text("<nav>only a menu</nav>") == ""
    assert html_text.main_text("plain text without markup") == "plain text without markup"


def test_pages_against_their_plain_structure(spark):
    """The pages of this table hold the text in h1 and p of one article element."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for row in html_text.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>)", row["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert row["text"] == "\n".join(b for b in blocks if b)
        assert row["n_chars"] == len(row["text"])


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (None, "u", "<p>" + "long words " * 50_000, "x"), (3, "u", "<div class=ad>" + PAGE, "x"), (4, "u", "<p <b>>a & b &bogus; <", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_text.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = {r["page_id"]: r for r in found.collect()}
    assert found.count() == 6 and got[1]["text"] == "" and got[1]["n_chars"] == 0
    assert got[None]["n_chars"] == len("long words " * 50_000) - 1
    assert "First para" in got[3]["text"]
    assert html_text.extract(pages.limit(0)).count() == 0


def brute_between(lines, window, surge):
    """Runs of windows with weight; a run in which some window surges is text, from its first surge back over lines
    with text, without links at its beginning."""
    sums = [sum(w for _, w in lines[i : i + window]) for i in range(len(lines))]
    least, kept, i = min(surge, max(sums, default=0)), [], 0
    while least > 0 and i < len(lines):
        run = [j for j in range(i, len(lines)) if all(sums[i : j + 1])]
        surges = [j for j in run if sums[j] >= least]
        if surges:
            first = surges[0]
            while first - 1 in run and lines[first - 1][0]:
                first -= 1
            body = [lines[j] for j in run if j >= first]
            while not body[0][1]:
                body.pop(0)
            kept += [text for text, _ in body if text]
        i = (run[-1] if run else i) + 1
    return kept


def test_windows_against_brute_force():
    draw = random.Random(3)
    for _ in range(3_000):
        lines = []
        for k in range(draw.randint(0, 25)):
            text = draw.choice(["", f"t{k}", f"t{k}"])
            lines.append(html_text.Line(text, draw.choice([0, 0, 1, 5, 20, 50]) if text else 0))
        window, surge = draw.randint(1, 4), draw.choice([1, 10, 40])
        assert html_text.between(lines, window, surge) == brute_between(lines, window, surge), lines


LONG = "A paragraph with quite a few plain words in it, number {}."


def paragraphs(n, tag="p"):
    return "".join(f"<{tag}>{LONG.format(i)}</{tag}>" for i in range(n))


def test_nothing_after_the_article():
    page = f"<body><article><h1>T</h1>{paragraphs(2)}<p>End.</article><div class='latest'><p>Latest posts of this long list of ours</div><p>Copyright of all these words 2020</p></body>"
    assert html_text.main_text(page).split("\n") == ["T", LONG.format(0), LONG.format(1), "End."]


def test_paragraphs_with_telling_classes_stay():
    page = f"<article><p class='share price'>Shares rose.</p><div class='search-results'>Nothing found.</div>{paragraphs(1)}<div class='share-buttons'>Share it</div><div id='related-posts'><p>More</div></article>"
    assert html_text.main_text(page).split("\n") == ["Shares rose.", "Nothing found.", LONG.format(0)]


def test_short_end_after_an_advert_without_an_article():
    page = f"<body><div id=c>{paragraphs(3)}<div class=ad><p>Buy</p><p>this</p><p>now</p><p>!</p></div><p>Short end.</p></div><footer>x</footer></body>"
    assert html_text.main_text(page).split("\n") == [*(LONG.format(i) for i in range(3)), "Short end."]


def test_list_table_and_nested_divisions():
    items = "".join(f"<li>{LONG.format(i)}" for i in range(3))
    cells = "".join(f"<tr><td>{LONG.format(i)}<td>{i}" for i in range(2))
    page = f"<div><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a>Three</a></ul></div><div><div><h2>Head</h2><ul>{items}</ul></div><table>{cells}</table></div><div class='pager'><a>1</a> <a>2</a></div>"
    assert html_text.main_text(page).split("\n") == ["Head", *(LONG.format(i) for i in range(3)), LONG.format(0), "0", LONG.format(1), "1"]


def test_main_element_and_header_inside_the_article():
    page = f"<header>Site</header><p>Before it all there is a long line of words.</p><main><section>{paragraphs(2)}</section><nav>menu</nav><p>Tail</main><p>After it all there is a long line of words.</p>"
    assert html_text.main_text(page).split("\n") == [LONG.format(0), LONG.format(1), "Tail"]
    page = f"<article><header><h1>Title</h1></header>{paragraphs(1)}<footer>tags</footer></article><article class='comment'>{paragraphs(2)}</article>"
    assert html_text.main_text(page).split("\n") == ["Title", LONG.format(0)]


def test_quoted_ends_of_tags_and_text_that_looks_like_markup():
    page = f"<article><p title='a > b' data-x=\"</p>\">1 < 2 and 3 > 2</p><!-- <p>gone</p> --><![CDATA[x]]>{paragraphs(1)}<p title=\"open>still here</p></article>"
    assert html_text.main_text(page).split("\n") == ["1 < 2 and 3 > 2", LONG.format(0), "still here"]


def test_broken_markup_takes_linear_time():
    began = time.time()
    for piece in ("<a ", "<a '", '<a title="', "<!", "<!-- ", "<p <", "</", "<script ", "<a b='>", "<style>", '<p x="\'>', "<div class=ad>", "<div>x", "<div class=ad></p>"):
        html_text.main_text(piece * (600_000 // len(piece)))
    assert time.time() - began < 60


MAIN = "Main text of this article is here and long enough."


@pytest.mark.parametrize(
    "page",
    [
        "<article><p>{}</p><section class='comments'><article><p>Reader one.</p></article><p>Second.</p></section></article>",
        "<article><p>{}</p></article><section class='comments'><article><p>Reader one.</p></article><p>Second.</p></section>",
        "<article><p>{}</p></article><div id='comments' class='comments-area'><ol><li><article class='comment-body'><p>Reader.</p></article></li></ol></div>",
        "<article><p>{}</p></article><div class='user-comments'><p>Reader.</p></div>",
        "<article><p>{}</p></article><div class='discussion'><article class='post'><p>Reader.</p></article></div>",
        "<article class='post comments-open'><p>{}</p><div class='comment-reply-title'>Leave a reply</div></article>",
        "<div class='nav'><a href='x'>Home</a><article><p>{}</p></article>",
        "<p>{}</p><div id='respond' class='comment-respond'><p>Reader.</p></div>",
    ],
)
def test_what_readers_wrote_is_no_main_text(page):
    assert html_text.main_text(page.format(MAIN)) == MAIN


def test_a_discussion_inside_the_article_stays():
    assert html_text.main_text(f"<article><p>{MAIN}</p><section class='discussion'><p>So it is.</p></section></article>") == f"{MAIN}\nSo it is."


def test_windows_cut_inside_the_article():
    """Lines of links weigh nothing in an article too: as many as a window end the text, fewer go along with it."""
    links = "".join(f"<p><a href='{i}'>More about this {i}</a></p>" for i in range(6))
    page = f"<article><p>{MAIN}</p>{links}</article>"
    assert html_text.main_text(page) == MAIN != "\n".join(line.text for line in html_text.lines_of(page))
    assert html_text.main_text(f"<article><p>{MAIN}</p><p><a href='1'>One</a></p><p>{MAIN}</p></article>") == f"{MAIN}\nOne\n{MAIN}"
    assert html_text.main_text(f"<article><p>{MAIN}</p><aside>Ad</aside><div><p>End.</p></div></article>") == f"{MAIN}\nEnd."
