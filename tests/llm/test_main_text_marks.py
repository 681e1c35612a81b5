"""Main text where marks, classes and layout speak for or against the article, and where nothing is marked."""

import collections

import numpy as np
import pytest

from paperloom.llm import maintext
from paperloom.llm.common import table

PAGES = [
    ("<main><h1>T</h1><p>body words are here now</p><article>teaser</article></main>", "T body words are here now teaser"),
    ("<body><div class='layout with-sidebar'><article><p>one two</p></article></div>", "one two"),
    ("<article class='post share-enabled'><p>one two</p></article>", "one two"),
    ("<div id=page class=no-comments><p>one two three</p></div>", "one two three"),
    ("<body><form action=x><div><h1>T</h1><p>body of the page</p></div></form>", "T body of the page"),
    ("<form>find</form><div><h1>T</h1><p>body of the page</p></div>", "T body of the page"),
    ("<article><p>a b</p><svg/><p>c d</p><svg><text>x</text></svg></article>", "a b c d"),
    ("<article><p>a b c d e</p></article><div class=x><div>lay out</div></div><article><p>f g h</p></article>", "a b c d e f g h"),
    ("<article><header><h1>T</h1><p>This lead says at length what follows.</p><p>by me</p></header><p>body</p></article>", "T This lead says at length what follows. body"),
    ("<main><p>some words</p><div class=commentList><p>" + "I say " * 50 + "</p></div></main>", "some words"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_marks_and_classes_are_evidence(page, want):
    assert maintext.main_text(page, maintext.Weights()) == want


def test_learned_classes_speak():
    page = "<div class=zq1><p>one two three four five</p></div><div class=zq2><p>six seven eight nine ten eleven</p></div>"
    assert maintext.main_text(page, maintext.Weights(classes={"zq1": -3.0})) == "six seven eight nine ten eleven"
    assert maintext.main_text(page, maintext.Weights(classes={"zq2": -3.0})) == "one two three four five"


def test_pages_without_marks(spark, sf):
    """200 pages without article or main element: at least 0.98 of all words are right, both ways."""
    weights = maintext.learn(table(spark, sf, "pages"))
    draws = np.random.default_rng(5)

    def words(n):
        return " ".join(f"w{draws.integers(10_000)}" for _ in range(n))

    def links(n):
        return "".join(f"<li><a href='/{i}'>{words(2)}</a></li>" for i in range(n))

    right = found = true = 0
    for _ in range(200):
        block = draws.choice(["p", "div"])
        body = [words(int(draws.integers(5, 80))) for _ in range(int(draws.integers(3, 12)))]
        inner = f"<h1>{body[0]}</h1>" + "".join(f"<{block}>{x}</{block}>" for x in body[1:])
        before = draws.choice([f"<div><ul>{links(8)}</ul></div>", f"<nav>{links(5)}</nav>", f"<div class=site-header>{words(4)}</div>"])
        after = draws.choice([f"<div class=related><ul>{links(9)}</ul></div>", f"<footer>{words(9)}</footer>", f"<div id=comments><p>{words(60)}</p></div>"])
        frame = draws.choice(["<form>{}</form>", "<div class='page has-sidebar'>{}</div>", "{}"])
        page = f"<html><head><title>{words(5)}</title></head><body>{frame.format(before + '<div id=content>' + inner + '</div>' + after)}</body></html>"
        got, want = collections.Counter(maintext.main_text(page, weights).split()), collections.Counter(" ".join(body).split())
        right, found, true = right + (got & want).total(), found + got.total(), true + want.total()
    assert right >= 0.98 * true and right >= 0.98 * found


def test_long_and_deep_pages():
    assert len(maintext.main_text("<article>" + "<p>a <b>b</b></p>" * 20_000, maintext.Weights()).split()) == 40_000
    assert maintext.main_text("<div class=a>" * 20_000 + "x y " * 20_000, maintext.Weights()).count("x") == 20_000
