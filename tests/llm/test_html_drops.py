"""Wrappers whose classes only look like those of side content."""

import pytest

from kinweave.llm import html_text

STORY = "A long sentence of the real story. " * 20
WRAPPERS = ["div class='overflow-hidden'", "div class='md:hidden'", "div class='no-sidebar'", "div class='has-sidebar'", "div class='with-banner'", "div class='header-fixed'", "div class='sidebar'", "form", "x-app class='hidden'"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ["<article><p>{}</p></article>", "<main>{}</main>", "<p>{}</p>"])
def test_wrapped_articles_stay(wrapper, inner):
    page = f"<body><nav>Menu</nav><{wrapper}>{inner.format(STORY)}</{wrapper.split()[0]}><footer>Foot</footer></body>"
    assert html_text.extract_page(page) == STORY.strip()


def test_small_parts_still_go():
    page = f"<body><article><p>{STORY}</p><p>a <span class='ad'>x</span> b</p><div class='ad'>Buy</div><form>Search</form><section class='comments'><p>Reader</p></section></article></body>"
    assert html_text.extract_page(page) == f"{STORY.strip()}\na b"
