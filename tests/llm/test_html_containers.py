"""Main text by container: short parts of an article stay, and names of wrappers do not lose it."""

import random
import time

import pytest

from tidemill.llm import html_text

LONG = "Words of a long paragraph. " * 80
LONG = LONG.strip()


def test_short_parts_of_an_article_stay():
    for around in ("article", "main", "div"):
        page = (
            f"<body><{around}><div><h1>A headline of its own</h1></div><p>{LONG}</p><div class=ad>Buy now, it is really very cheap today.</div><p>After the advert.</p>"
            f"<ul><li>one<li>two</ul><table><tr><td>cell</td></tr></table><section><p>Short section.</p></section><aside><p>Side words, long enough to look like text.</p></aside><p>End.</p></{around}>"
            "<div><p>Some other box with a line of text that is not short.</p></div></body>"
        )
        assert html_text.extract(page) == "\n".join(["A headline of its own", LONG, "After the advert.", "one", "two", "cell", "Short section.", "End."]), around


@pytest.mark.parametrize("wrapper", ['class="content has-sidebar"', 'id="search-results"', 'class="post social-share-on"', 'class="widget"'])
@pytest.mark.parametrize("element", ["div", "section"])
def test_a_wrapper_may_have_a_furniture_word(wrapper, element):
    page = f"<body><{element} {wrapper}><article><p>{LONG}</p><p>End.</p></article></{element}><p>Some small print that is not the article.</p>"
    assert html_text.extract(page) == f"{LONG}\nEnd."


def test_a_heavy_container_is_not_dropped_for_part_of_its_name():
    page = f'<body><div class="content has-sidebar"><p>{LONG}</p><div class="share-box"><p>Share this text with everyone you know.</p></div><p>End.</p></div>'
    assert html_text.extract(page) == f"{LONG}\nEnd."


def test_furniture_stays_out():
    box = "<p>" + "Great text, I liked it a lot. " * 90 + "</p>"
    for kind in ('class="sidebar"', 'id="comments"', 'class="cookie-notice"', 'class="left newsletter_signup"', 'role="complementary"'):
        page = f"<body><div {kind}>{box}<article class='comment'>{box}</article></div><article><p>{LONG}</p></article></body>"
        assert html_text.extract(page) == LONG


@pytest.mark.parametrize("part", ['<div class="related-work"><p>{}</p></div>', '<p class="research-notice-board">{}</p>', '<blockquote class="social-quote">{}</blockquote>', "<aside>Side words<p>{}</p>", "<nav>Menu<div><p>{}</p></div>"])
def test_names_that_only_contain_furniture_and_ends_that_are_missing(part):
    page = f"<body><article><p>{LONG}</p>{part.format('Kept.')}<p>End.</p></article></body>"
    assert html_text.extract(page) == f"{LONG}\nKept.\nEnd."


@pytest.mark.parametrize("kind", ["comment-list", "site-nav", "ad-slot-1", "related-posts", "shareButtons", "sidebar__inner", "cookie-notice", "newsletter_signup"])
def test_names_that_are_furniture_throughout(kind):
    page = f"<body><article><p>{LONG}</p><div class='x {kind}'><p>{LONG}</p></div><p>End.</p></article></body>"
    assert html_text.extract(page) == f"{LONG}\nEnd."


def plain_spans(weights, k, surge):
    """Windows one by one: lines with text reach as far as each window of k lines that ends at the next ones has some."""
    padded = [0] * (k - 1) + list(weights) + [0] * k
    window = lambda first: sum(padded[first + k - 1 : first + 2 * k - 1])  # noqa: E731  of lines first .. first + k - 1
    out, i = [], 0
    while i < len(weights):
        j = i
        while j < len(weights) and weights[i] and window(j):
            j += 1
        if weights[i] and any(window(f) >= surge for f in range(i - k + 1, j)):
            out.append((i, j))
        i = max(j, i + 1)
    return out


def test_surges_and_dives_equal_the_plain_ones():
    rng = random.Random(14)
    for _ in range(500):
        weights = [rng.choice([0, 0, 0, 3, 9, 40]) for _ in range(rng.randint(0, 25))]
        for surge in (1, 30):
            assert html_text.spans(weights, 3, surge) == plain_spans(weights, 3, surge), weights


def test_very_long_and_broken_pages():
    paragraphs = [f"Paragraph {k} of a very long page." for k in range(40_000)]
    page = "<body><nav>" * 200 + "<article>" + "".join(f"<p>{p}<div class=ad>x" for p in paragraphs)
    assert html_text.extract("<article>" + "".join(f"<p>{p}" for p in paragraphs)) == "\n".join(paragraphs)
    assert html_text.extract(page).split("\n")[0] == paragraphs[0]


def _page(*blocks, wrap="article"):
    return "<body><nav><a href=/>Home</a></nav>" + (f"<{wrap}>" if wrap else "") + "".join(blocks) + (f"</{wrap}>" if wrap else "") + "</body>"


ENDS = ["This first paragraph of the article is long enough to surge well.", "And so is the last one, which says what there is left to say here."]


@pytest.mark.parametrize(
    "middle,lines",
    [
        ("<ul>" + "".join(f"<li><a href=/{k}>Reference {k}</a></li>" for k in range(4)) + "</ul>", [f"Reference {k}" for k in range(4)]),
        ("<table><tr>" + "".join(f"<td><a href=/{k}>Cell {k}</a></td>" for k in range(5)) + "</tr></table>", [f"Cell {k}" for k in range(5)]),
        ("<p><a href=/x>One linked line</a></p>", ["One linked line"]),
    ],
)
def test_linked_lines_between_paragraphs_stay(middle, lines):
    assert html_text.extract(_page(f"<p>{ENDS[0]}</p>", middle, f"<p>{ENDS[1]}</p>")).split("\n") == [ENDS[0], *lines, ENDS[1]]


def test_a_last_paragraph_that_is_a_link_stays_and_a_last_list_of_links_goes():
    assert html_text.extract(_page(*(f"<p>{x}</p>" for x in ENDS), "<p><a href=/x>Read on</a></p>")).split("\n") == [*ENDS, "Read on"]
    links = "<ul>" + "".join(f"<li><a href=/{k}>Other story {k}</a></li>" for k in range(4)) + "</ul>"
    assert html_text.extract(_page(*(f"<p>{x}</p>" for x in ENDS), links)).split("\n") == ENDS


NAMES = "user-comments post-comments article-comments blog-comments fb-comments discussion reader-responses google-ads post-share site-header legal-notice cookie-law entry-related story-nav sticky-sidebar commentsArea adBox comment-list"


@pytest.mark.parametrize("name", NAMES.split())
def test_furniture_is_told_by_the_end_of_its_name(name):
    box = f'<div class="{name}"><p>Some reader wrote this rather long remark, which is no part of it.</p></div>'
    assert html_text.extract(_page(f"<p>{ENDS[0]}</p>", box, f"<p>{ENDS[1]}</p>")).split("\n") == ENDS


@pytest.mark.parametrize("name", "no-sidebar has-comments with-menu entry-content article-header post-body shadow commentator nationwide content".split())
def test_names_that_only_speak_of_furniture_do_not_lose_text(name):
    assert html_text.extract(f'<body><div class="{name}">' + "".join(f"<p>{x}</p>" for x in ENDS) + "</div></body>").split("\n") == ENDS


BROKEN = {
    "tags without an end": "x <b " * 200_000,
    "names that are no patterns": "<x( class='user-comments'>" * 20_000,
    "many names": "".join(f"<x{k} class=ads>" for k in range(20_000)),
    "ends without a begin": "<div>" * 50_000 + "</ul>" * 50_000,
    "ends that an article holds": "<ul><article>" + "<div>" * 50_000 + "</ul>" * 50_000,
    "open quotes": "<a '" * 100_001 + ">",
    "an open comment": "text <!-- x" + "<b " * 100_000,
    "deep": "<div>x" * 60_000,
    "open declarations": "<!x " * 200_000,
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_take_time_in_proportion(name):
    began = time.process_time()
    html_text.extract(BROKEN[name])
    assert time.process_time() - began < 4


def test_null_pages_alone_in_a_partition(spark):
    pages = spark.createDataFrame([(k, None, None) for k in range(3)] + [(9, "u", _page(*(f"<p>{x}</p>" for x in ENDS)))], "page_id long, url string, html string").repartition(4, "page_id")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract_pages(pages).collect()) == [(0, "", 0), (1, "", 0), (2, "", 0), (9, "\n".join(ENDS), len("\n".join(ENDS)))]
