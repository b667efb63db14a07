"""Paths of deep pages and of elements with many classes."""

from kinweave.llm import html_text

STORY = "A long sentence of the real story. " * 20


def test_deep_paths_and_fourth_classes():
    deep = "<div class='a-rather-long-utility-class another-long-utility-class one-more-of-these'>" * 8
    page = f"<body>{deep}<div class='a b c author'>By me</div><div class='a b c story'><p>{STORY}</p></div><div class='a b c teaser'>More</div>{'</div>' * 8}</body>"
    assert html_text.extract_page(page) == STORY.strip()
    p = html_text.Page(page)
    assert html_text.extract_page(page, p.path(p.best())) == STORY.strip() and len(p.path(p.best())) == 32
