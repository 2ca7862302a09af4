"""Articles inside parts whose names or tags are those of page furniture."""

import pytest

from ladderbook.llm.html_text import main_text

WORDS = "Many plain words of a long enough article, told one after another without any link."
ARTICLE = f"<h2>Title of it</h2><p>{WORDS}</p><p>{WORDS}</p>"
WANT = f"Title of it\n{WORDS}\n{WORDS}"
MENU = "<div class=menu><a href=a>home</a> <a href=b>news</a></div>"


@pytest.mark.parametrize("opening", ['<div class="content has-sidebar">', '<div id="page-with-nav">', '<section class="notice-board">', "<form method=post action=x.aspx>", '<form id=aspnetForm><div class="page has-banner">'])
def test_containers_of_most_text_stay(opening):
    close = "".join(f"</{x.split()[0]}>" for x in reversed(opening.replace(">", " ").split("<")[1:]))
    assert main_text(f"<html><body>{MENU}{opening}{ARTICLE}{close}<div class=footer>All rights</div></body></html>") == WANT


def test_forms_round_an_article_stay():
    assert main_text(f"<body><form>{MENU}<article>{ARTICLE}<form><input>no</form></article></form></body>").startswith(WANT)


def test_topic_names_inside_an_article_stay():
    page = f'<article>{ARTICLE}<section class="related-work"><p>{WORDS}</section><p class="social-history">{WORDS}</p><section class="related"><a href=x>other</a></section></article>'
    assert main_text(page) == f"{WANT}\n{WORDS}\n{WORDS}"


def test_furniture_still_goes():
    reply = "<p>" + "I do not agree with any of this. " * 30 + "</p>"
    assert main_text(f"<body><div class=text>{ARTICLE}</div><div class=comments>{reply}</div><form>search <input></form></body>") == WANT
    assert main_text(f'<body><div>{ARTICLE}</div><div class="has-sidebar" hidden>{reply}</div></body>') == WANT


def test_sections_leads_and_headlines_stay():
    """Without an article element: parts beside the densest one that are of the article too."""
    links = "<ul><li><a href=1>one thing</a><li><a href=2>two things</a></ul>"
    sections = f"<body>{MENU}{links}<div><section><h2>A</h2><p>{WORDS}<p>{WORDS}</section><section><h2>B</h2><p>{WORDS}<p>{WORDS}</section></div></body>"
    assert main_text(sections) == f"A\n{WORDS}\n{WORDS}\nB\n{WORDS}\n{WORDS}"
    lead = f"<body>{MENU}{links}<div class=page><h1>Head</h1><p class=lead>Lead of it. {WORDS}</p><div class=text><p>{WORDS}</p><p>{WORDS}</p><p>{WORDS}</p></div></div></body>"
    assert main_text(lead) == f"Head\nLead of it. {WORDS}\n{WORDS}\n{WORDS}\n{WORDS}"
    plain = f"<body>{MENU}<div class=text><p>{WORDS}</p><p>{WORDS}</p></div><div class=comments><p>{WORDS}{WORDS}</p></div>{links}<div class=footer>Rights</div></body>"
    assert main_text(plain) == f"{WORDS}\n{WORDS}"


@pytest.mark.parametrize("name", ["social-history", "search-results-study"])
def test_named_divs_of_an_article_stay(name):
    assert main_text(f'<article><h2>T</h2><p>{WORDS}</p><div class="{name}">{WORDS} {WORDS}</div><p>{WORDS}</p></article>') == f"T\n{WORDS}\n{WORDS} {WORDS}\n{WORDS}"
