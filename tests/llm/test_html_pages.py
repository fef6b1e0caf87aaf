"""Pages that the tables of pages don't show: optional end tags, and class words of wrappers."""

import pytest

from brindle.llm.html_extract import extract

PROSE = ["The first paragraph of the page has many words, none of which is in a link, and it goes on for so long that nobody takes it for a label.", "A second one follows it, and says with as many words as it needs that the text of the page is all of this and nothing else beside."]
ARTICLE = "<article><h1>A title</h1>" + "".join(f"<p>{p}</p>" for p in PROSE) + "</article>"
WANTED = "\n".join(["A title", *PROSE])


@pytest.mark.parametrize("start", ["<body>", "", "<div>", "<link rel=x><base href=/><script>var a;</script><body class=x>"])
def test_head_without_end_tag(start):
    assert extract(f"<html><head><meta charset=utf-8><title>x</title><style>p{{}}</style>{start}{ARTICLE}") == WANTED
    assert extract(f"<html><head><title>x</title></head>{start}{ARTICLE}") == WANTED


def test_text_ends_an_open_head():
    assert extract(f"<head><title>x</title>{PROSE[0]}<p>{PROSE[1]}") == "\n".join(PROSE)


@pytest.mark.parametrize("name", ["class='layout with-sidebar'", "class=no-sidebar", "class='page has-header'", "id='page-form'", "id=discussion", "class=related-work", "class='col sidebar'", "class='site-header'"])
def test_wrappers_keep_their_text(name):
    assert extract(f"<body><nav><a href=/>Home</a></nav><div {name}>{ARTICLE}</div>") == WANTED
    assert extract(f"<body><nav><a href=/>Home</a></nav><div {name}><main>{ARTICLE}</main></div>") == WANTED
    assert extract(f"<body><nav><a href=/>Home</a></nav><div {name}><p>{PROSE[0]}<p>{PROSE[1]}</div>") == "\n".join(PROSE)


def test_parts_of_an_article_keep_their_text():
    for name in ("discussion", "related-work"):
        page = f"<article><div class=entry-header><h1>A title</h1></div><p>{PROSE[0]}<section id={name}><h2>Next</h2><p>{PROSE[1]}<p>Short.</section></article>"
        assert extract(page) == "\n".join(["A title", PROSE[0], "Next", PROSE[1], "Short."])
    for name in ("discussion", "related-work"):
        assert extract(f"<article><p>{PROSE[0]}</article><section id={name}><h2>Next</h2><p>{PROSE[1]}</section>") == "\n".join([PROSE[0], "Next", PROSE[1]])


def test_what_stands_beside_stays_out():
    comment = "<article><p>" + "I liked this very much and write a long comment about it here. " * 4 + "</article>"
    cards = "".join(f"<article><a href=/{i}>Another page to read</a></article>" for i in range(5))
    for beside in (f"<div class=comments>{comment}</div>", f"<section id='comment-list'>{comment}</section>", f"<div class=related>{cards}</div>", f"<div class='sidebar-left'><p>{PROSE[1]}</div>", "<div class=ad>Buy this now.</div>", "<div role=search>Search the site</div>", "<div class=share-box><a href=/>Share</a> <a href=/>Send</a></div>"):
        assert extract(f"<body>{beside}{ARTICLE}") == WANTED == extract(f"<body>{ARTICLE}{beside}")
