"""Pages whose article once fell out by a name or by its division."""

import numpy as np
import pytest

from lociframe.llm import pages


def prose(name, n):
    return "".join(f"<p>{name} sentence {i}, with some words in it. Another one follows here, calmly.</p>" for i in range(n))


def sentences(text, name):
    return text.count(f"{name} sentence")


NAV = "<nav><a href='x'>Home</a><a href='y'>News</a></nav>"
ADVERT = "<div class='ad'><p>Buy this, now!</p></div>"


@pytest.mark.parametrize(
    "opening",
    [f"<div class='{c}'>" for c in ("content-sidebar-wrap", "has-sidebar", "no-sidebar", "elementor-widget-container", "post comments-open")]
    + ["<form method='post' action='./page.aspx' id='form1'>", "<div id=page class='with-banner form'>"],
)
@pytest.mark.parametrize("holder", ["article", "main", "div"])
def test_marked_wrapper_of_the_page(opening, holder):
    closing = "</form>" if opening.startswith("<form") else "</div>"
    text = pages.main_text(f"<body>{opening}{NAV}<{holder}><h1>Head</h1>{prose('My', 8)}</{holder}>{ADVERT}<div class='comments'>{prose('Their', 2)}</div>{closing}</body>")
    assert sentences(text, "My") == 8 and sentences(text, "Their") == 0 and "Buy" not in text and "Home" not in text


def test_short_article_with_long_comments():
    text = pages.main_text(f"<body><div class='content-sidebar-wrap'><main>{prose('My', 3)}</main></div><div id='comments'><article>{prose('Their', 12)}</article></div></body>")
    assert sentences(text, "My") == 3 and sentences(text, "Their") == 0


def test_topics_within_an_article():
    source = f"<article><h1>Contract</h1>{prose('My', 6)}<section id='search'><h2 id='search'>Search</h2>{prose('Search', 3)}</section><div class='notice-period'>{prose('Notice', 3)}</div><form><p>Your name.</p><input></form></article>"
    text = pages.main_text(f"<body>{NAV}{source}{ADVERT}</body>")
    assert [sentences(text, x) for x in ("My", "Search", "Notice")] == [6, 3, 3]
    assert "Your name" not in text and "Buy" not in text


@pytest.mark.parametrize(
    "first, second, around",
    [
        ("<div class=part>", "<div class=part>", "<div id=content>{}</div>"),
        ("<article>", "<article>", "<main>{}</main>"),
        ("<article>", "<section>", "<main>{}</main>"),
        ("<article>", "<article>", "<div>{}</div>"),
        ("<article>", "<div>", "<div>{}</div>"),
        ("<section>", "<td>", "<article>{}</article>"),
    ],
)
@pytest.mark.parametrize("share", [(15, 5), (16, 4), (19, 1), (4, 16)])
def test_all_parts(first, second, around, share):
    end = lambda opening: "</" + opening[1:].split()[0].rstrip(">") + ">"
    body = f"{first}<h2>One</h2>{prose('First', share[0])}{end(first)}{second}<h2>Two</h2>{prose('Second', share[1])}{end(second)}"
    text = pages.main_text(f"<body>{NAV}{around.format(body)}<div class=footer>Imprint, contact.</div></body>")
    assert (sentences(text, "First"), sentences(text, "Second")) == share
    assert "Home" not in text and "Imprint" not in text
    if first != "<section>":
        assert text.startswith("One First") and " Two Second" in text


def test_long_block_of_an_article():
    listing = "<pre>" + " ".join(f"line {i}, of code;" for i in range(200)) + "</pre>"
    text = pages.main_text(f"<body>{NAV}<div id=content><h1>Head</h1>{prose('Before', 3)}{listing}{prose('After', 3)}</div></body>")
    assert "Head" in text and "line 199" in text and sentences(text, "Before") == sentences(text, "After") == 3


@pytest.mark.parametrize("paragraphs", [3, 10])
@pytest.mark.parametrize("beside", ["legal", "kommentare"])
def test_article_beside_one_long_text(paragraphs, beside):
    """One long node on a path of its own has a ratio above that of the article's paragraphs."""
    told = [f"Paragraph {i} of the article tells what happened that day, in some words." for i in range(paragraphs)]
    article = "<article><h1>Head</h1>" + "".join(f"<p>{t}</p>" for t in told) + "</article>"
    long = f"<div class={beside}><p>" + "All rights are reserved by whom it may concern, for ever. " * 8 + "</p></div>"
    for page in (f"<body>{article}{long}</body>", f"<body>{long}{article}</body>"):
        text = pages.main_text(page)
        assert all(t in text for t in told)


def test_paragraphs_beside_one_long_text_without_an_article():
    told = [f"Sentence {i} stands on a page that has no article element at all." for i in range(12)]
    page = "<body><div id=a><div>" + "".join(f"<p>{t}</p>" for t in told) + "</div></div><div><p>" + "Small print goes on. " * 25 + "</p></div></body>"
    assert all(t in pages.main_text(page) for t in told)


@pytest.mark.parametrize("ratios", [[5, 1, 9, 2, 2], [3, 3, 3], [1], [0, 7, 0, 7]])
def test_smoothing_is_a_weighted_mean(ratios):
    weights = [1, 4, 6, 4, 1]
    want = []
    for i in range(len(ratios)):
        near = [(weights[k - i + 2], ratios[k]) for k in range(len(ratios)) if abs(k - i) <= 2]
        want.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    assert pages._smooth(np.array(ratios, float)) == pytest.approx(want)


def test_paths_are_needed():
    """Without the ratios, text of little content beside the paragraphs would be taken as well."""
    told = "".join(f"<p>Paragraph {i} tells a long and punctuated story, with clauses, and more of them.</p>" for i in range(6))
    rest = "".join(f"<span>item {i}</span>" for i in range(30))
    text = pages.main_text(f"<body><div><div>{told}</div></div><div><b>{rest}</b></div></body>")
    assert "Paragraph 5" in text and "item 7" not in text
