"""Marked wrappers, marked headings, and text beside the region stay."""

from __future__ import annotations

import time

import pytest

from ledgersift.llm import html

BODY = "<article><h1 class='page-header'>Title</h1><p class='legal'>Terms of it.</p><p class='notice-of-motion'>Moved.</p><p>" + "Long words of the text. " * 20 + "</p></article>"
TEXT = "Title\nTerms of it.\nMoved.\n" + ("Long words of the text. " * 20).strip()


@pytest.mark.parametrize("wrapper", ["layout has-sidebar", "no-sidebar", "with-header", "page-widget", "content header-fixed", "sidebar", "widget"])
def test_marked_wrappers_keep_their_article(wrapper):
    assert html.extract(f"<body><div>12 May</div><div class='{wrapper}'>{BODY}</div><div class='sidebar'>Links</div></body>") == TEXT
    plain = BODY.replace("article>", "div>").replace("class='legal'", "")
    assert html.extract(f"<body><div class='{wrapper}'>{plain}</div><div class='cookie-notice'>We use</div></body>") == TEXT


def test_text_beside_the_region_stays():
    long = "Long words of the text. " * 20
    assert html.extract(f"<body><h1>Title</h1><p>lead</p><div><p>{long}</p></div></body>") == f"Title\nlead\n{long.strip()}"


def test_every_article_with_seeds_stays():
    one, two = "First part of it. " * 30, "Second part of it. " * 20
    assert html.extract(f"<body><div>x</div><article><p>{one}</p></article><article><p>{two}</p></article></body>") == f"{one.strip()}\n{two.strip()}"


L = "Long words of the text in a row, as prose has them. " * 4
T = L.strip()
NAV = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"
FOOT = "<footer>&copy; 2020 Somebody</footer>"
CARDS = "".join(f"<div><a href=/{i}>Card {i}</a></div>" for i in range(8))

#: A page's body and its text, chosen by hand.
SHAPES = {
    "article": (f"{NAV}<article><h1>A</h1><p>{L}</p><p>b.</p></article>{FOOT}", f"A\n{T}\nb."),
    "main": (f"{NAV}<main><h1>A</h1><p>{L}</p><p>b.</p></main>{FOOT}", f"A\n{T}\nb."),
    "article in main": (f"<main><p>Date</p><article><h1>A</h1><p>{L}</p></article><div>More</div></main>", f"A\n{T}"),
    "divs": (f"{NAV}<div><h1>A</h1><p>{L}</p><p>b.</p></div>{FOOT}", f"A\n{T}\nb."),
    "bare body": (f"{NAV}<h1>A</h1><p>{L}</p><p>b.</p>{FOOT}", f"A\n{T}\nb."),
    "table layout": (f"<table><tr><td><a href=/>Home</a></td><td><p>{L}</p><p>b.</p></td></tr></table>", f"{T}\nb."),
    "section header": (f"<article><h2 class='section-header'>A</h2><p>{L}</p></article>", f"A\n{T}"),
    "marked heading": (f"<article><h2 class='header'>A</h2><p>{L}</p></article>", f"A\n{T}"),
    "legal paragraph": (f"<article><p class='legal'>a</p><p>{L}</p></article>", f"a\n{T}"),
    "header of the article": (f"<header><h1>Site</h1></header><article><header><h1>A</h1></header><p>{L}</p></article>", f"A\n{T}"),
    "header of main": (f"<main><header><h1>A</h1></header><p>{L}</p></main>", f"A\n{T}"),
    "footer of the article": (f"<article><p>{L}</p><footer>Tags</footer></article>", T),
    "aside in the article": (f"<article><p>{L}</p><aside>{L}</aside><p>b.</p></article>", f"{T}\nb."),
    "form in the article": (f"<article><p>{L}</p><form>Mail <input></form><p>b.</p></article>", f"{T}\nb."),
    "form around the article": (f"<form>{NAV}<article><p>{L}</p></article></form>", T),
    "teaser article": (f"<div><p>{L}</p><p>{L}</p></div><article><h3>Next</h3><p>Read on</p></article>", f"{T}\n{T}"),
    "teaser in main": (f"<main><p>{L}</p><p>{L}</p><article><a href=/>Next</a></article></main>", f"{T}\n{T}"),
    "two articles": (f"<article><p>{L}</p></article><article><p>{L}{L}</p></article>", f"{T}\n{(L + L).strip()}"),
    "comments": (f"<article><p>{L}</p><div class='comments'><p>{L}</p></div></article>", T),
    "comment articles": (f"<article><p>{L}</p></article><div id='comments'><article class='comment'><p>{L}{L}</p></article></div>", T),
    "menu only": ("<div class='menu'>Home</div>", ""),
    "cookie banner only": ("<div id='cookie-banner'>We use cookies</div>", ""),
    "nav only": (NAV, ""),
    "banner of prose": (f"<div id='cookie-banner'><p>{L}</p></div>", ""),
    "sidebar only": ("<div class='sidebar'>Links</div>", ""),
    "wrapper named sidebar": (f"<div class='sidebar'><h1>A</h1><p>{L}</p></div>{FOOT}", f"A\n{T}"),
    "cookie notice beside": (f"<div class='cookieNotice'>We use</div><div><p>{L}</p></div>", T),
    "sidebar beside": (f"<div><p>{L}</p><p>{L}</p></div><div class='sidebar'><p>{L}</p></div>", f"{T}\n{T}"),
    "cards beside": (f"<div><p>{L}</p><p>b.</p><p>{L}</p></div><div>{CARDS}</div>", f"{T}\nb.\n{T}"),
    "hidden": (f"<div hidden>{L}</div><div aria-hidden=true>x</div><p>{L}</p>", T),
    "role": (f"<div role=navigation>{L}</div><p>{L}</p>", T),
    "line breaks": (f"<div>{L}<br>{L}<br>b.</div>", f"{T}\n{T}\nb."),
    "list": (f"<div><p>{L}</p><ul><li>One<li>Two</ul></div>", f"{T}\nOne\nTwo"),
    "definition list": (f"<div><p>{L}</p><dl><dt>One<dd>first</dl></div>", f"{T}\nOne\nfirst"),
    "inline across blocks": (f"<article><b><p>{L}</b></p><p>b.</p></article>", f"{T}\nb."),
    "unclosed": (f"<div><p>{L}<p>{L}", f"{T}\n{T}"),
    "comment cut off": (f"<p>{L}</p><!-- {NAV}", f"{T}\nHome\nNews"),
    "references": (f"<p>{L}a &amp; b &lt;c&gt; &#233; &nbsp; d</p>", f"{T} a & b <c> é d"),
    "script text": (f"<script>var a = '<p>{L}</p>';</script><p>{L}</p><style>p {{}}</style>", T),
    "marked section": (f"<![CDATA[x]]><p>{L}</p>", T),
    "short": ("<p>a</p>", "a"),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(shape):
    body, text = SHAPES[shape]
    if shape == "comment cut off":
        body = body.replace("<nav>", "<div>").replace("</nav>", "</div>").replace("<a href=/a>", "").replace("<a href=/b>", "").replace("</a>", "")
    got = html.extract(f"<html><head><title>t</title></head><body>{body}")
    assert got == text


#: Short prose lines far from the text, and one longer line among links: the threshold leaves the former, the smoothing the latter.
NOISE = "".join(f"<div>Short line {i}</div>" for i in range(12))
LONE = CARDS + "<div>A somewhat longer line that stands alone among links.</div>" + CARDS
TEXTS = f"<div><p>{L}</p><p>b.</p><p>{L}</p><p>{L}</p></div>"


def test_the_threshold_decides(monkeypatch):
    want = f"{T}\nb.\n{T}\n{T}"
    assert html.extract(f"<body>{TEXTS}<div>{NOISE}</div></body>") == want
    monkeypatch.setattr(html, "threshold", lambda values: float(values.min()))
    assert html.extract(f"<body>{TEXTS}<div>{NOISE}</div></body>") != want


def test_the_smoothing_decides(monkeypatch):
    want = f"{T}\nb.\n{T}\n{T}"
    assert html.extract(f"<body>{TEXTS}<div>{LONE}</div></body>") == want
    monkeypatch.setattr(html, "SIGMA", 0.0)
    monkeypatch.setattr(html, "smooth", lambda ratios: ratios)
    assert html.extract(f"<body>{TEXTS}<div>{LONE}</div></body>") != want


PIECES = ["<b>x<br>", "<b></i>", "<ul><li>x", "<!--", "<", "&", "<article>x", "<a ", '<a href="', "<![x[", "<?", "</a ", "<p class='menu'>x", "<div>x"]


@pytest.mark.parametrize("end", ["", ">"])
@pytest.mark.parametrize("piece", PIECES)
def test_a_megabyte_of_anything_is_read_in_seconds(piece, end):
    start = time.process_time()
    html.extract(piece * (1_000_000 // len(piece)) + end)
    assert time.process_time() - start < 10


def test_no_marked_section_fails():
    assert html.extract("<p>a</p><![if x]><p>b</p><![endif]><![foo[<p>c") == "a\nb\nc"
