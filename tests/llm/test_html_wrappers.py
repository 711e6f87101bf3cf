"""Names of layout wrappers must not decide over the article; names of side matter still do."""

import re

import pytest

from spoor.llm import html

BODY = "".join(f"<p>Sentence number {i} of a long article about rivers, banks and the boats on them.</p>" for i in range(8))
MENU = "<ul class='menu'><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>"


@pytest.mark.parametrize(
    "page",
    [
        f'<main class="has-sidebar">{BODY}</main>', f'<div id="content" class="no-sidebar">{BODY}</div>', f'<article class="post comments-open">{BODY}</article>', f'<div class="with-footer"><div>{BODY}</div></div>',
        f'<div class="widget"><div>{BODY}</div></div>', f'<div role="form">{BODY}</div>', f'<form action="page.aspx"><input type=hidden name=state><div>{BODY}</div></form>',
    ],
)
def test_wrappers_keep_the_article(page):
    text = html.main_text(f"<body>{MENU}{page}<div class='cookie-notice'>We use cookies here.</div></body>")
    assert all(f"Sentence number {i} of" in text for i in range(8)) and "One" not in text and "cookies" not in text


def test_title_in_a_post_header():
    assert html.main_text(f"<body><article><div class='post-header'><h1>The title</h1></div>{BODY}</article></body>").startswith("The title Sentence number 0")


def test_form_around_the_page_loses_its_controls_only():
    page = f"<form><label for=q>Look for</label><input id=q><select><option>All</option></select><button>Go</button><article>{BODY}</article></form>"
    text = html.main_text(page)
    assert "Sentence number 7" in text and not any(w in text for w in ("Look for", "All", "Go"))


def test_long_comments_stay_out():
    comments = "".join(f"<article class='comment'><p>Reader {i} says that this was a fine article and goes on about it at length.</p></article>" for i in range(40))
    text = html.main_text(f"<main><article>{BODY}</article><div id='comments'>{comments}</div></main>")
    assert "Sentence number 7" in text and "Reader" not in text


def _paragraphs(n, words=40):
    return "".join(f"<p>{' '.join(f'word{k}x{i}' for k in range(words))}.</p>" for i in range(n))


LEAD = f"<p>{' '.join(['lead'] * 30)}</p>"
NAV = "<div><a href=a>Home page</a> <a href=b>All news</a> <a href=c>Contact us</a></div>"
END = "<div><a href=d>Terms</a> and <a href=e>imprint</a></div>"


@pytest.mark.parametrize("around", ["{}", NAV + "{}" + END, "<div>" + NAV + "{}" + END + "</div>", "<div>" + NAV + "</div><div>{}<div><a href=a>See this</a> <a href=b>and that too</a></div></div>" + END])
@pytest.mark.parametrize("article", [
    f"<article><h1>A title</h1><section>{_paragraphs(6)}</section><section>{_paragraphs(6)}</section></article>",
    f"<main><h1>A title</h1><section><h2>One</h2>{_paragraphs(4)}</section><section><h2>Two</h2>{_paragraphs(6)}</section><section><h2>Three</h2>{_paragraphs(5)}</section></main>",
    f"<div class='article'><div class='lead'><h1>A title</h1>{LEAD}</div><div class='text'>{_paragraphs(6)}</div></div>",
    f"<div id='wrap'><h1>A title</h1><div class='part1'>{LEAD}</div><div class='part2'>{_paragraphs(8)}</div></div>",
    f"<div><h1>A title</h1><h2>More</h2><div>{_paragraphs(3)}</div><div>{_paragraphs(3)}</div><div>{_paragraphs(3)}</div></div>",
])
def test_articles_in_several_parts_are_kept_whole(article, around):
    """Exactly the article, whatever unnamed neighbours it has."""
    whole = " ".join(re.sub("<[^>]+>", " ", article).split())
    assert html.main_text("<html><body>" + around.format(article) + "</body></html>") == whole
