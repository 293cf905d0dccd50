import pytest

from touchline.llm import html

TEXT = "this is a long paragraph of plain text that goes on for more than a few words and has no links at all in it"


@pytest.mark.parametrize("name", ["page has-sidebar", "sticky-header", "no-footer", "with_menu", "search-results", "responsive"])
def test_layout_names_keep_the_text(name):
    tree = html.trained()
    assert html.main_text(f"<body><div class='{name}'><p>{TEXT}</p><p>{TEXT} twice</p></div></body>", tree) == f"{TEXT}\n{TEXT} twice"
    assert html.main_text(f"<body><div class='{name}'><article><p>{TEXT}</p></article></div></body>", tree) == TEXT


def test_article_in_a_named_wrapper():
    tree = html.trained()
    page = f"<body><div class='header widget'><article><p>{TEXT}</p><div class='ad'>Buy {TEXT}</div></article><p>{TEXT} outside</p></div><div class='comments'><article class='comment'><p>{TEXT} said</p></article></div></body>"
    assert html.main_text(page, tree) == TEXT
    assert html.main_text(f"<body><div hidden><article><p>{TEXT}</p></article></div></body>", tree) == ""


@pytest.mark.parametrize("name", ["site-footer", "main-nav", "cookie-notice", "search-form", "respond", "ad"])
def test_furniture_names_stay_furniture(name):
    assert html.main_text(f"<body><div class='{name}'><p>{TEXT}</p></div></body>", html.trained()) == ""
