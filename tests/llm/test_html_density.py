"""Text density: against brute force on small trees, and what it decides on whole pages."""

import math
import random
import time
from pathlib import Path

import pytest

from spoor.llm import html

BODY = "".join(f"<p>Sentence number {i} of a long article about rivers, banks and the boats on them.</p>" for i in range(8))
GIVEN = Path("/root/testdata/sf0.01/pages.parquet")


def random_page(rng, depth=0):
    if depth == 4 or rng.random() < 0.25:
        return "".join(rng.choice("abc ") for _ in range(rng.randrange(40)))
    tag = rng.choice(["div", "p", "section", "a", "b"]) if depth else "div"
    inner = "".join(random_page(rng, depth + 1) for _ in range(rng.randrange(1, 4)))
    return f"<{tag}>{inner}</{tag}>"


def density(chars, tags, link_chars, link_tags, share):
    if not chars:
        return 0.0
    base = chars / max(1, chars - link_chars) * link_chars + share * chars + math.e
    return chars / max(1, tags) * max(0.0, math.log(chars / max(1, link_chars) * max(1, tags) / max(1, link_tags))) / math.log(base)


def flat(node):
    return isinstance(node, str) or node.tag in html.INLINE and all(flat(c) for c in node.children)


def counts(node):
    """Characters, tags, link characters, link tags below a node, by recursion."""
    if isinstance(node, str):
        return len(" ".join(node.split())), 0, 0, 0
    chars = tags = link_chars = link_tags = 0
    for c in node.children:
        a, b, d, e = counts(c)
        chars, tags, link_chars, link_tags = chars + a, tags + b, link_chars + d, link_tags + e
        tags += not isinstance(c, str) and (c.tag == "a" or not flat(c))
    if node.tag == "a":
        link_chars, link_tags = chars, link_tags + 1
    return chars, tags, link_chars, link_tags


def test_densities_and_sums_by_force():
    rng = random.Random(1)
    seen = 0
    for _ in range(300):
        root = html.read_page(random_page(rng))
        html.measure(root)
        chars, _, link_chars, _ = counts(root)
        share = link_chars / chars if chars else 0.0
        todo = [root]
        sums = {}
        while todo:
            node = todo.pop()
            assert node.density == pytest.approx(density(*counts(node), share))
            own = [counts(c) for c in node.children if flat(c)]
            # loose text and inline elements count as one child, whose only tags are its links
            loose = [sum(x) for x in zip(*own)] or [0, 0, 0, 0]
            if node.tag == "a" and not own:
                loose = [0, 0, 0, 0]
            blocks = [c for c in node.children if not isinstance(c, str) and not flat(c)]
            sums[node] = sum(density(*counts(c), share) for c in blocks) + density(loose[0], loose[3], loose[2], loose[3], share)
            assert node.total == pytest.approx(sums[node])
            todo += blocks
            seen += 1
        assert sums[root.best] == pytest.approx(max(sums.values()))
    assert seen > 500


def without_density(page):
    root = html.read_page(page)
    html.measure(root)
    return html.text_of_nodes([root])


def test_density_decides_where_nothing_is_named():
    page = f"<body><div><a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a></div><div>Read this short notice.</div><div>{BODY}</div><div><a href=d>Terms</a> and <a href=e>imprint</a></div></body>"
    text = html.main_text(page)
    assert text.startswith("Sentence number 0") and text.endswith("boats on them.") and all(f"number {i} of" in text for i in range(8))
    assert without_density(page) != text


@pytest.mark.skipif(not GIVEN.exists(), reason="no given tables")
def test_density_decides_on_given_pages(spark):
    pages = [r["html"] for r in spark.read.parquet(str(GIVEN)).select("html").collect()]
    texts = [html.main_text(p) for p in pages]
    assert all(without_density(p) != t for p, t in zip(pages, texts))  # the adverts are out by density

    def unnamed(page):
        root = html.read_page(page)
        html.measure(root)
        return html.text_of_nodes(html._dense(root))

    assert sum(unnamed(p) == t for p, t in zip(pages, texts)) > 0.95 * len(pages)  # and names hardly matter


@pytest.mark.parametrize("around", ["<div class='layout no-sidebar'>{}</div>", "<article class='post with-comments'>{}</article>", "<main id='related-work'>{}</main>", "<div class='related'><div>{}</div></div>"])
def test_wrappers_keep_text(around):
    assert "Sentence number 7" in html.main_text("<body><nav><a href=a>Home</a></nav>" + around.format(BODY) + "</body>")


def test_titles_in_headers():
    assert html.main_text(f"<article><div class='entry-header'><h1>The title</h1></div>{BODY}</article>").startswith("The title Sentence")
    assert html.main_text(f"<header><h1>Site</h1></header><main><header><h1>The title</h1></header>{BODY}</main>").startswith("The title Sentence")


def test_hidden_without_a_value():
    assert "secret" not in html.main_text(f"<article>{BODY}<p hidden>secret words</p><p aria-hidden='true'>secret words</p></article>")


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "deep" + "</div>" * 100_000, "<p><table><tr><td>" + "<div>" * 50_000, "<ul>" + "<div><li>x" * 30_000, "<div class='ad'>" * 50_000 + "x", "<p>" * 100_000, "<a><b>" * 50_000])
def test_nested_tags_take_linear_time(page):
    began = time.perf_counter()
    html.main_text(page)
    assert time.perf_counter() - began < 20


def test_very_long_page():
    page = "<article>" + "<p>Some words of a paragraph that goes on for a while.</p>" * 40_000 + "</article><div>x</div>"
    assert len(html.main_text(page)) == 40_000 * 52 - 1
