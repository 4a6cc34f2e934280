"""The density of nodes, not their names, decides what the main text is; hostile pages take linear time."""

import random
import time

import pytest

from keyloom.llm import html_extract

R = random.Random(11)
WORDS = [" ".join("".join(R.choice("abcdefghij") for _ in range(R.randint(2, 8))) for _ in range(40)) for _ in range(8)]


def page(menu="div class=k1", note="div class=k2", main="div class=k3", foot="div class=k4"):
    name = lambda tag: tag.split()[0]
    links = "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(12))
    body = "".join(f"<p>{w}</p>" for w in WORDS)
    return f"<html><body><{menu}><ul>{links}</ul></{name(menu)}><{note}>Buy this now.</{name(note)}><{main}>{body}</{name(main)}><{foot}>All rights reserved.</{name(foot)}></body></html>"


def test_names_are_not_needed():
    assert html_extract.extract(page()) == "\n\n".join(WORDS)


def test_names_alone_do_not_decide(monkeypatch):
    """Menu, note and foot go by their density even if no name is doubted; and with one density for all nodes
    they stay, whatever the page calls them."""
    named = page("nav", 'div class="ad"', "article", "footer")
    assert html_extract.extract(named) == "\n\n".join(WORDS)
    monkeypatch.setattr(html_extract, "DOUBT", 1.0)
    assert html_extract.extract(named) == "\n\n".join(WORDS)
    monkeypatch.setattr(html_extract, "density", lambda c, t, lc, lt, share: 1.0)
    assert "All rights reserved." in html_extract.extract(named)


def test_a_form_around_the_page_keeps_its_article():
    inner = page("nav", 'div class="ad"', "article", "footer").replace("<body>", '<body><form id="aspnetForm">').replace("</body>", "</form></body>")
    assert html_extract.extract(inner) == "\n\n".join(WORDS)


def test_short_paragraphs_beside_a_long_one_stay():
    text = "<article><p>" + " ".join(WORDS * 3) + "</p>" + "<p>So it is.</p>" * 200 + "</article>"
    got = html_extract.extract(f"<body><nav><a href=/a>a</a><a href=/b>b</a></nav>{text}<footer>foot</footer></body>")
    assert got.count("So it is.") == 200 and "foot" not in got


def test_comments_go_even_where_they_outweigh_the_article():
    text = f"<body><article>{''.join(f'<p>{w}</p>' for w in WORDS[:4])}</article><div class='comments'>{''.join(f'<p>{w}</p>' for w in WORDS[4:] * 3)}</div></body>"
    assert html_extract.extract(text) == "\n\n".join(WORDS[:4])


def test_table_rows_close_each_other():
    rows = "".join(f"<tr><td>{w}<td>{w}" for w in WORDS)
    assert html_extract.extract(f"<body><table>{rows}</table></body>").split("\n\n") == [w for w in WORDS for _ in range(2)]


@pytest.mark.parametrize("make", [
    lambda n: "<b>" * n + "</i>" * n,
    lambda n: "<i><div>" + "<b>" * n + "</i>" * n,
    lambda n: "<ul>" + "<li>" * n + "<b>" * n + "</li>" * n,
    lambda n: "<header>" * n + "x",
    lambda n: "<p><button>" * n,
    lambda n: "<script>" + "</script " * n,
])
def test_hostile_pages_take_linear_time(make):
    start = time.time()
    html_extract.extract(make(60_000))
    assert time.time() - start < 20
