"""Extraction on layouts that the chain was not trained on, and on the cases that lost text before."""

import pytest

from sitelens.llm import html_crf


@pytest.fixture(scope="module")
def chain():
    return html_crf.fitted()


def accuracy(chain, pages):
    right = total = 0
    for page, labels in pages:
        got = chain.best(html_crf.features(html_crf.blocks(page)))
        assert len(got) == len(labels)
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    return right / total


def test_unseen_pages_of_all_styles(chain):
    assert accuracy(chain, html_crf.labelled_pages(150, seed=77)) > 0.99


#: A list of links in an article and an article of one short block look like a menu or a notice to a chain that never saw any.
@pytest.mark.parametrize("style, least", [("paragraphs", .98), ("divs", .98), ("table", .98), ("definitions", .98), ("preformatted", .98),
                                          ("links", .9), ("single", .9)])
def test_styles_held_out_by_kind(style, least):
    others = tuple(s for s in html_crf.STYLES if s != style)
    assert accuracy(html_crf.fitted(styles=others), html_crf.labelled_pages(100, seed=78, styles=(style,))) >= least


@pytest.mark.parametrize("page, want", [
    ("<nav><a href=/>Home</a></nav><div id=wrap><div class=txt><h1>Trip report</h1><div>We went there in May and stayed.</div>"
     "<div>It was cold but fine.</div></div></div><footer>&copy; us</footer>",
     "Trip report\n\nWe went there in May and stayed.\n\nIt was cold but fine."),
    ("<nav><a href=/>Home</a></nav><article><h1>Sources</h1><p>These are the sources we used for it.</p><ul><li><a href=/a>First long title</a>"
     "</li><li><a href=/b>Second one here</a></li></ul></article><footer>&copy; us</footer>",
     "Sources\n\nThese are the sources we used for it.\n\nFirst long title\n\nSecond one here"),
    ("<article><pre>short x</pre></article>", "short x"),
    ("<article><p>short x</p></article>", "short x"),
    ("<article><p>short x</p><select><option>a<option>b</article>", "short x"),
    ('<article><p>One is here.</p><script src="a.js"/>var secret=1;</script><p>Two.</p></article>', "One is here.\n\nTwo."),
    ("<article><p>One is here.</p><script src=https://a.b/>var secret=1;</script><p>Two.</p></article>", "One is here.\n\nTwo."),
])
def test_cases_that_lost_text(chain, page, want):
    assert html_crf.main_text(f"<html><body>{page}</body></html>", chain)[0] == want


def test_a_slash_closes_foreign_elements_only():
    page = "<article><p>One <svg><path/><title/>no</svg>two.</p><math><mi/>x</math><p>Three <b/>four.</p></article>"
    assert [b.text for b in html_crf.blocks(page)] == ["One two.", "x", "Three four."]


def test_the_core_of_a_page():
    page = html_crf.blocks("<nav><ul><li><a href=/>a</a><li><a href=/>b</a></ul></nav><div><div><h1>Title</h1><p>Long text here.</p><p>More of it.</p>"
                           "</div><p>aside</p></div><footer>end</footer>")
    assert html_crf.core_levels(page) == [2, 2, 0, 0, 0, 1, 2]
    assert html_crf.core_levels([]) == []
