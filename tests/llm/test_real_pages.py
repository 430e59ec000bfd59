"""Pages in the styles of real sites, none of them used in training: the main text block by block, and word precision and recall."""

from collections import Counter

import pytest

from cadenza.llm import html_extract

P1 = "The harbour was quiet on the morning when the last of the herring boats came in, and nobody on the quay said a word."
P2 = "Its captain had kept a diary for forty years, which his daughter has now given to the museum together with his charts."
P3 = "It records the weather, the catch and the price of salt, but on some days only the names of those who had gone."
H = "The last herring boat"
BODY = f"<p>{P1}</p><p>{P2}</p>"
TEXT = f"{P1}\n{P2}"
NAV = '<nav><a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a></nav>'
FOOT = '<footer><p>Copyright of the harbour gazette, printed since 1901.</p><a href="/p">Privacy</a></footer>'


@pytest.fixture(scope="module")
def weights():
    return html_extract.trained()


NAMES = ("hentry post-content share-buttons", "type-post category-legal", "post tag-menu", "promo-story", "widget-free", "post-header-image", "single-post footer-dark", "entry sponsored-by", "main-header-offset", "story notice-board", "content legal-text", "post nav-next-hidden")


@pytest.mark.parametrize("name", NAMES)
def test_one_word_of_a_class_hides_no_article(weights, name):
    for page in (f'<body>{NAV}<div class="{name}">{BODY}</div>{FOOT}</body>', f'<body>{NAV}<div class="{name}"><h1>{H}</h1>{BODY}</div>{FOOT}</body>', f'<body>{NAV}<section id="{name}">{BODY}</section>{FOOT}</body>'):
        assert html_extract.main_text(page, weights) == (f"{H}\n{TEXT}" if "<h1>" in page else TEXT), page


@pytest.mark.parametrize("page", [
    f'<body>{NAV}<article class="post legal-news">{BODY}</article>{FOOT}</body>', f'<body>{NAV}<main class="header-main">{BODY}</main>{FOOT}</body>', f'<form id="aspnetForm" method="post">{NAV}<div>{BODY}</div>{FOOT}</form>',
    f'<form id="aspnetForm"><div class="menu"><a href="/">Home</a></div><table><tr><td>{BODY}</td></tr></table></form>', f'<body class="single footer-fixed">{NAV}<div id="page" class="site-header-sticky">{NAV}<div class="entry-content">{BODY}</div>{FOOT}</div></body>',
    f'<body>{NAV}<div class="widget-area-main">{BODY}</div><div class="widget"><a href="/t">Tags</a></div></body>',
])
def test_wrappers(weights, page):
    assert html_extract.main_text(page, weights) == TEXT


def test_pages_without_tags(weights):
    assert html_extract.main_text(f"{P1}\n\n {P2} &amp; more", weights) == f"{P1} {P2} & more"
    assert html_extract.main_text(f"<!-- a comment -->{P1}", weights) == P1 and html_extract.main_text("word", weights) == "word"


#: (style, page, blocks of main text)
PAGES = (
    ("blog with an entry header", f'<body><header class="site-header"><a href="/">Harbour notes</a></header>{NAV}<article class="post"><header class="entry-header"><h1 class="entry-title">{H}</h1><div class="entry-meta"><a href="/u">admin</a></div></header><div class="entry-content">{BODY}</div><footer class="entry-footer"><a href="/tag">boats</a></footer></article><div id="comments" class="comments-area"><ol><li><p>What a lovely story this was, thank you so much for it and for the charts.</p></li></ol></div>{FOOT}</body>', [H, P1, P2]),
    ("entry header in plain divs", f'<body>{NAV}<div class="wrap"><div class="entry-header"><h1>{H}</h1></div><div class="entry-content">{BODY}</div></div>{FOOT}</body>', [H, P1, P2]),
    ("news with a share bar and an advert in the middle", f'<body>{NAV}<main><article><h1>{H}</h1><div class="share-bar"><a href="#">Share</a> <a href="#">Mail</a></div><p>{P1}</p><div class="advertisement"><p>Fresh herring, delivered to your own door every day.</p></div><p>{P2}</p><p>{P3}</p></article><aside class="related"><h3>More</h3><a href="/1">Nets and knots</a></aside></main>{FOOT}</body>', [H, P1, P2, P3]),
    ("recipe with short items at its end", f'<body>{NAV}<div class="content"><h1>{H}</h1><p>{P1}</p><ul><li>salt</li><li>oil</li><li>flour</li></ul></div>{FOOT}</body>', [H, P1, "salt", "oil", "flour"]),
    ("plain div with short items at its end", f'<body><div><a href="/">Home</a> <a href="/r">Recipes</a></div><div><p>{P1}</p><p>{P2}</p><ul><li>salt</li><li>oil</li><li>flour</li></ul></div><div><a href="/p">Previous</a> <a href="/n">Next</a></div></body>', [P1, P2, "salt", "oil", "flour"]),
    ("plain div with a table at its end", f'<body><div><a href="/">Home</a></div><div><h2>{H}</h2><p>{P1}</p><p>{P2}</p><table><tr><th>Year</th><th>Boats</th></tr><tr><td>1931</td><td>twelve</td></tr></table></div><div>Last change in May</div></body>', [H, P1, P2, "Year", "Boats", "1931", "twelve"]),
    ("items between paragraphs", f'<body><div><a href="/">Home</a></div><div><p>{P1}</p><ol><li>nets</li><li>ropes</li></ol><p>{P2}</p></div></body>', [P1, "nets", "ropes", P2]),
    ("link list at the end stays out", f'<body>{NAV}<div><p>{P1}</p><p>{P2}</p><ul><li><a href="/1">Nets</a></li><li><a href="/2">Ropes</a></li></ul></div>{FOOT}</body>', [P1, P2]),
    ("layout table of the nineties", f'<table width="100%"><tr><td bgcolor="#ccc"><a href="/">Index</a><br><a href="/l">Links</a></td><td><h2>{H}</h2><p>{P1}<p>{P2}<br>{P3}</td></tr></table><hr><i>Copyright 1997</i>', [H, P1, f"{P2}", P3]),
    ("cookie banner before a short page", f'<div id="cookie-banner" role="dialog"><p>We and our many partners use cookies to store and read what your device tells us about you and your habits.</p><button>Accept</button></div><main id="content"><h1>{H}</h1>{BODY}</main>{FOOT}', [H, P1, P2]),
    ("newsletter box between paragraphs", f'<main><article><h1>{H}</h1><p>{P1}</p><div class="newsletter-signup"><p>Get the letters of the harbour every Friday in your own mail.</p><form><input><button>Sign up</button></form></div><p>{P2}</p></article></main>', [H, P1, P2]),
    ("breadcrumbs, pager, sidebar", f'<div class="breadcrumbs"><a href="/">Home</a> <a href="/b">Boats</a></div><div class="row"><div class="col-8 article-body"><h1>{H}</h1>{BODY}</div><div class="col-4 sidebar"><p>Our shop has charts, books and postcards of the old harbour for you.</p></div></div><ul class="pagination"><li><a href="/2">2</a></li></ul>', [H, P1, P2]),
    ("documentation", f'<div class="sphinxsidebar"><ul><li><a href="/a">Install</a></li></ul></div><div class="document" role="main"><div class="section"><h1>{H}</h1><p>{P1}</p><pre>boat --help</pre><p>{P2}</p></div></div><div class="footer">Built with care</div>', [H, P1, "boat --help", P2]),
    ("forum thread's first post", f'<div id="wrap"><div class="navbar"><a href="/f">Forum</a></div><div class="post"><div class="postbody">{P1}<br><br>{P2}</div></div><div class="reply"><p>I do not believe a word of that, sorry to say so here.</p></div></div>', [P1, P2]),
    ("comments longer than the article", f'<article><h1>{H}</h1>{BODY}</article><section class="comments"><h2>Comments</h2>' + "<p>I was there on that morning as well and I remember it in quite another way than you do.</p>" * 8 + "</section>", [H, P1, P2]),
    ("comments as articles", f'<main><article class="post"><h1>{H}</h1>{BODY}</article><article class="comment"><p>My uncle was the cook of that boat for many years, and he told me much of it.</p></article></main>', [H, P1, P2]),
    ("unclosed list menu", f'<ul class="nav"><li><a href="/">Home</a><li><a href="/n">News</a></ul><div class="post-body"><h2>{H}</h2><p>{P1}<p>{P2}</div>', [H, P1, P2]),
    ("encyclopedia", f'<div id="mw-panel" role="navigation"><a href="/m">Main page</a></div><div id="content" class="mw-body" role="main"><h1>{H}</h1><div id="mw-content-text"><p>{P1}</p><h2><span>Life</span></h2><p>{P2}</p><blockquote><p>{P3}</p></blockquote></div></div><div id="footer" role="contentinfo"><p>Text is available under a licence that you can read on its page.</p></div>', [H, P1, "Life", P2, P3]),
    ("question and answers", f'<header><a href="/">Ask</a></header><div id="mainbar"><div class="question"><h1>{H}</h1><div class="post-text"><p>{P1}</p></div></div><div class="answer"><div class="post-text"><p>{P2}</p></div></div></div><div id="sidebar"><a href="/h">Hot</a></div>', [H, P1, P2]),
    ("press release", f'<div class="topbar"><a href="/login">Log in</a></div><div class="press-release"><h1>{H}</h1><p class="dateline">HARBOUR, May 3</p>{BODY}<p>{P3}</p></div><div class="social-share"><a href="#">Post</a></div><div class="legal-footer">All prices include tax and shipping within the country.</div>', [H, "HARBOUR, May 3", P1, P2, P3]),
    ("figures and captions", f'<article><h1>{H}</h1><figure><img src="a.jpg"><figcaption>The boat in the spring of that year, seen from the quay</figcaption></figure>{BODY}</article>{FOOT}', [H, "The boat in the spring of that year, seen from the quay", P1, P2]),
    ("definition list in an article", f'<article><h1>{H}</h1><p>{P1}</p><dl><dt>Keel</dt><dd>the lowest beam</dd></dl><p>{P2}</p></article>', [H, P1, "Keel", "the lowest beam", P2]),
    ("nested wrappers with bad names", f'<div class="page-header-fixed"><div class="menu-open-push"><div class="sidebar-right-layout"><div class="entry">{BODY}<p>{P3}</p></div><div class="sidebar"><a href="/x">Archive</a></div></div></div></div>', [P1, P2, P3]),
    ("page of a nav alone", f"<body>{NAV}{FOOT}</body>", []),
)


@pytest.mark.parametrize(("style", "page", "blocks"), PAGES, ids=[p[0] for p in PAGES])
def test_style(weights, style, page, blocks):
    assert html_extract.main_text(page, weights).split("\n") == (blocks or [""])


def test_word_precision_and_recall(weights):
    hit = found = true = 0
    for _, page, blocks in PAGES:
        got, want = Counter(html_extract.main_text(page, weights).split()), Counter(" ".join(blocks).split())
        hit, found, true = hit + (got & want).total(), found + got.total(), true + want.total()
    assert hit / found >= 0.98 and hit / true >= 0.98, (hit, found, true)
