"""Pages whose main text the densities of blocks decide, against or without the word of their elements."""

from __future__ import annotations

import pytest

from sparkdigest.llm import html

LONG = "It was the best of times and it was the worst of times, and that is what the story of the city is about when you read it from the start to the end of the book."
OTHER = "There is much more to be said of this, and some of it will be said when it is time for us to do so and you are with us again for a while on that day."
ITALIAN = "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Ahi quanto a dir qual era è cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura!"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<p title="the hidden treasure of">{LONG}</p>', LONG),
        (f"<p data-x='a hidden=true' hidden-x>{LONG}</p><p hidden>{OTHER}</p>", LONG),
        (f'<div class="layout has-sidebar"><p>{LONG}</p><p>{OTHER}</p></div>', f"{LONG}\n{OTHER}"),
        (f'<div id="sidebar-page" class="menu"><p>{LONG}</p><p>{OTHER}</p></div>', f"{LONG}\n{OTHER}"),
        (f"<nav><a href=a>Home</a><p>{LONG}</p><p>{OTHER}</p>", f"{LONG}\n{OTHER}"),
        (f"<nav><ul><li><a href=a>Home</a></li></ul><main><p>{LONG}</p></main>", LONG),
        ("<div><nav><a href=x>Home page</a></nav><p>Short.</p><p>Also short.</p></div>", "Short.\nAlso short."),
        (f"<div><p>{ITALIAN}</p><p>Breve.</p><p>{ITALIAN}</p></div><footer>c 2024</footer>", f"{ITALIAN}\nBreve.\n{ITALIAN}"),
        (f'<div class="article-header"><h1>Headline</h1></div><p>{LONG}</p>', f"Headline\n{LONG}"),
        (f"<p>{LONG} <label>Do you</label> <button>Click</button> agree? {OTHER}</p>", f"{LONG} Do you agree? {OTHER}"),
        (f"<p>{LONG}<select><option>One<option>Two</select></p><p><button>Unclosed <p>{OTHER}</p>", f"{LONG}\n{OTHER}"),
        (f"<form><div id=menu><a href=x>y</a></div><div><p>{LONG}</p><p>{OTHER}</p></div></form>", f"{LONG}\n{OTHER}"),
        (f'<div class="ad">{LONG} {OTHER}</div><article><p>Thnt erenan.</p><p>Ofshednd ined.</p></article>', "Thnt erenan.\nOfshednd ined."),
        (f'<article><p>{LONG}</p><section class="comments"><article class="comment"><p>{OTHER} {OTHER}</p></article></section></article>', LONG),
        (f'<article><p>{LONG}</p><aside><p>{OTHER}</p></aside><p>Fin.</p></article>', f"{LONG}\nFin."),
        ("", ""),
        ("<footer>All rights</footer><nav><a href=a>Home</a></nav>", "All rights"),
    ],
)
def test_pages(page, want):
    assert html.main_text(page) == want


def test_densities_decide_against_the_tags():
    """Inside an article a list of links goes, and without one prose stays where the elements say nothing."""
    links = "".join(f'<p><a href="/{k}">Another of the stories that we have told you in this week</a></p>' for k in range(3))
    assert html.main_text(f"<article><p>{LONG}</p>{links}<p>{OTHER}</p></article>") == f"{LONG}\n{OTHER}"
    page = f"<div>{links}</div><div><p>{LONG}</p><p>Short.</p><p>{OTHER}</p></div><div>Zugriffe xyz abc zahlreich qwertz uiop asdf ghjk yxcv bnm lorem ipsum dolor sit amet consectetur</div>"
    assert html.main_text(page) == f"{LONG}\nShort.\n{OTHER}"
    found, says = html.blocks(f"<article><p>{LONG}</p>{links}</article>")
    assert html.by_density(found) == [True, False, False, False] and html.classify(found, says) == [True, False, False, False]


def test_a_page_s_own_frequent_words_stand_in_for_an_unknown_language():
    words = "ja on ei se oli että hän mutta kun niin".split()
    rare = lambda start, k: start + "bcdfghjklm"[k // 10] + "aeiouyäöåü"[k % 10]
    prose = " ".join(f"{words[k % 10]} {rare('sana', k)} {words[(3 * k) % 10]}" for k in range(40))
    junk = " ".join(f"{rare('tuote', k)} {rare('hinta', k)} {rare('koodi', k)}" for k in range(30))
    assert html.main_text(f"<div><p>{prose}</p></div><div>{junk}</div><div><p>{prose} loppu</p></div>") == f"{prose}\n{prose} loppu"
