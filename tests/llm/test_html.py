import random

import pytest

from plumbline.llm.html import extract_pages, main_text

LONG = "A sentence with quite a few words that makes a proper paragraph of the text. " * 3
PAGES = {
    "article": (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        f"<div class='ad'>Buy now</div><article><h1>Head &amp; tail</h1><p><b>Lead<br><p>{LONG}</p><p>Short.</p><aside>More</aside><form>Name<input></form>"
        "<div class='comments'><p>First!</p></div></article><footer>&copy; x</footer></body></html>",
        "Head & tail\nLead\n" + " ".join(LONG.split()) + "\nShort.",
    ),
    "no article": (
        f"<body><div class=menu><a href=1>Home</a></div><h1>Title</h1><div><p>{LONG}<p>{LONG}</div><div id='comments'><p>{LONG}</div><footer>c</footer>",
        "Title\n" + " ".join(LONG.split()) + "\n" + " ".join(LONG.split()),
    ),
    "two articles": (f"<article><p>Teaser</p></article><main><article><p>{LONG}</p><p>End</p></article></main>", " ".join(LONG.split()) + "\nEnd"),
    "cut off": (f"<article><p>{LONG}</p><p>Half a sen", " ".join(LONG.split()) + "\nHalf a sen"),
    "references": ("<article><p>a&lt;b &eacute;&#233;&nbsp; c\n\td</p></article>", "a<b éé c d"),
    "notice": (f"<article><div class='cookie-notice'>We use cookies</div><p>{LONG}</p><script>x</script></article>", " ".join(LONG.split())),
    "plain": ("just words", "just words"),
    "odd": ("</p></div><p>x</b><p>", "x"),
    "nothing": ("<nav>a</nav>", ""),
}


LINE = " ".join(LONG.split())
SHORT = "".join(f"<p>Short {i}.</p>" for i in range(9))
SHORT_LINES = "\n".join(f"Short {i}." for i in range(9))
WHOLE = {
    "head left open": (f"<html><head><title>T</title><meta charset=x><script>x</script><body><article><p>{LONG}</p></article>", LINE),
    "head and body left open": (f"<head><link rel=x><style>x</style><noscript><img></noscript><p>{LONG}</p>", LINE),
    "head ended by text": ("<head><title>T</title>words", "words"),
    "short paragraphs at both ends": (f"<body><div class=menu>m</div><div>{SHORT}<p>{LONG}</p><p>{LONG}</p>{SHORT}</div>", "\n".join([SHORT_LINES, LINE, LINE, SHORT_LINES])),
    "divisions as paragraphs": (f"<body><div><div>{LONG}</div>" + SHORT.replace("p>", "div>") + "</div>", f"{LINE}\n{SHORT_LINES}"),
    "linked line": (f"<body><div><p>{LONG}</p><p><a href=x>All of this line is a link</a></p><p>{LONG}</p></div>", f"{LINE}\nAll of this line is a link\n{LINE}"),
    "beside the block": (f"<body><div><a href=1>x</a></div><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div>", f"Title\n{LINE}\n{LINE}"),
    "drawing in a paragraph": ("<article><p>one <svg><text>x</text></svg> two</p></article>", "one two"),
    "button in a paragraph": ("<article><p>one <button>Go</button> two <script>x()</script>three</p></article>", "one two three"),
    "advert in a paragraph": ("<article><p>one <span class=ad>Buy <i>now</i></span> two</p></article>", "one two"),
    "picture in a paragraph": ("<article><p>one <img class=share src=x> two</p></article>", "one two"),
    "names that tell a topic": ("<article><div class=social-science>A</div><p class=related>B</p><div class='cookie-notice'>C</div><ul class=share-buttons><li>D</ul></article>", "A\nB"),
    "short paragraphs around a long one": (f"<div><p>Short.</p><p>{LONG}</p><p>End.</p></div>", f"Short.\n{LINE}\nEnd."),
    "text right in the article": (f"<div><article>Intro<p>{LONG}</p></article></div>", f"Intro\n{LINE}"),
    "sidebar beside the article": (f"<body><div><p>Latest</p><p>Top</p></div><article><p>{LONG}</p><p>Yes.</p></article>", f"{LINE}\nYes."),
}


MENU = "<div class=menu><a href=/>Home</a> <a href=/x>Other</a></div>"
WRAPPED = {
    "page-wide form": f"<body><form action=/>{MENU}<article><p>{LONG}</p><p>End</p></article><input></form>",
    "site named after its sidebar": f"<body><div id=page class='site sidebar-right'>{MENU}<article><p>{LONG}</p><p>End</p></article></div>",
    "content named after its sidebar": f"<body>{MENU}<div id=content class='right-sidebar'><p>{LONG}</p><p>End</p></div>",
    "main named after its sidebar": f"<body>{MENU}<main class='content sidebar'><p>{LONG}</p><p>End</p></main>",
    "article that is a widget": f"<body>{MENU}<article class='post widget'><p>{LONG}</p><p>End</p></article>",
    "form left open": f"<body><form><input name=q><article><p>{LONG}</p><p>End</p></article>",
    "menu left open": f"<body><nav><ul><li><a href=/>Home</a><article><p>{LONG}</p><p>End</p></article>",
    "header left open": f"<body><header>Site<article><p>{LONG}</p><p>End</p></article>",
}


@pytest.mark.parametrize("name", WRAPPED)
def test_wrappers_do_not_silence_the_article(name):
    assert main_text(WRAPPED[name]) == f"{LINE}\nEnd"


def test_wrappers_keep_their_menus_and_cuts():
    page = f"<form><nav>Home</nav><article><p>one <span class=ad>Buy</span> two {LONG}</p><div class=comments><p>{LONG}</p></div></article></form>"
    assert main_text(page) == f"one two {LINE}"
    for name in ("comments", "ad", "nav"):
        assert main_text(f"<div class={name}><p>{LONG}</p></div>") == ""


@pytest.mark.parametrize("name", ["commentlist", "reader-comments", "user-comments", "commentsection", "article-ad-slot", "ad-slot", "newsletter-signup-form", "cookie-law-info"])
@pytest.mark.parametrize("key", ["class", "id"])
def test_comments_adverts_and_notices_by_other_names(name, key):
    assert main_text(f"<article><p>{LONG}</p><div {key}='{name}'><p>{LONG}</p></div><p>End</p></article>") == f"{LINE}\nEnd"


@pytest.mark.parametrize("element", ["<h2 id=comments>On comments</h2>", "<h2 id=navigation class=menu>Ships</h2>", "<section id=sharing><h2>Sharing</h2><p>To share.</p></section>", "<p id=cookies>Baked.</p>"])
def test_ids_that_tell_a_topic_cut_nothing(element):
    inner = main_text(element.replace("id=", "x=").replace("class=", "y="))
    assert main_text(f"<article><p>{LONG}</p>{element}<p>End</p></article>") == f"{LINE}\n{inner}\nEnd"


def test_two_articles_in_one_region_both_stay():
    body = f"<main><article><p>{LONG}</p></article><article><p>{LONG}!</p></article></main>"
    assert main_text(body) == f"{LINE}\n{LINE} !"


def foreign(rnd):
    """Pages whose names are not in the code's lists: wrappers and blocks of invented names around known text."""
    name = lambda: "".join(rnd.choice("bcdfghjklmnpqrtvwz") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 5)))
    lines = [" ".join(f"w{rnd.randrange(999)}" for _ in range(rnd.choice([2, 30, 90]))) for _ in range(rnd.randrange(3, 20))] + [LINE]
    body = "".join(f"<p class='{name()} {name()}-{name()}' id={name()}>{t}</p>" for t in lines)
    for _ in range(rnd.randrange(4)):
        body = f"<{rnd.choice(['div', 'section', 'form', 'main', 'div'])} class='{name()}-{name()}' id={name()}>{body}</{rnd.choice(['div', 'section'])}>" if rnd.random() < 0.2 else f"<div class='{name()}'>{body}</div>"
    tag = rnd.choice(["article", "main"])
    return f"<body class='{name()}'>{MENU}<{tag} class={name()}>{body}</{tag}><footer>x</footer>", "\n".join(lines)


def test_pages_with_names_of_their_own():
    rnd = random.Random(12)
    for _ in range(300):
        page, want = foreign(rnd)
        assert main_text(page) == want, page


def generated(rnd):
    """A page of known main text: paragraphs of any length in an article or a division, with all kinds of cuts and surroundings."""
    cuts = ["<svg><path d=x></svg>", "<button>Go</button>", "<span class='ad box'>Buy</span>", "<script>var a='</p>';</script>", "<!-- no -->", "<img class=share>", "<b></b>"]
    around = ["<nav><ul><li><a href=/>Home</a></ul></nav>", "<div class=ad>Buy now</div>", "<aside>More</aside>", "<footer>&copy; x</footer>", "<form><label>Name</label><input></form>", "<div id=comments><p>First of all!</p></div>", "<header>Site</header>"]
    lines, body = [], []
    for i in range(rnd.randrange(1, 30)):
        words = [f"w{rnd.randrange(999)}" for _ in range(rnd.choice([1, 3, 40, 200]))]
        lines.append(" ".join(words))
        marked = [rnd.choice(cuts) + " " + w if rnd.random() < 0.05 else f"<i>{w}</i>" if rnd.random() < 0.1 else w for w in words]
        body.append(f"<p>{rnd.choice([' ', chr(10), '  &#32;']).join(marked)}" + rnd.choice(["", "</p>"]))
        if rnd.random() < 0.2:
            body.append(rnd.choice(around))
    tag = rnd.choice(["article", "main", "div"])
    outer = "".join(rnd.sample(around, 3))
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{outer}<{tag}>{''.join(body)}</{tag}>{''.join(rnd.sample(around, 2))}</body></html>", "\n".join(lines)


def test_generated_pages():
    rnd = random.Random(8)
    for _ in range(400):
        page, want = generated(rnd)
        assert main_text(page) == want, page


@pytest.mark.parametrize("name", WHOLE)
def test_nothing_else_is_lost(name):
    page, want = WHOLE[name]
    assert main_text(page) == want


def test_deep_pages_without_an_article():
    assert main_text("<div>" * 20_000 + f"<p>{LONG}</p><p>End</p>") == LINE + "\nEnd"


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    assert main_text(page) == want


def test_very_long_page_is_read_in_slices():
    body = "".join(f"<p>Paragraph {i} of a very long page, whole.</p>" for i in range(20_000))
    assert main_text(f"<article>{body}</article>").count("\n") == 19_999


def test_table_of_pages(spark):
    rows = [(1, "u", PAGES["plain"][0], "x"), (2, None, None, "x"), (2, None, "", "x"), (None, "v", "<article>y", "x")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, "u", "just words", 10), (2, None, "", 0), (2, None, "", 0), (None, "v", "y", 1)], key=str)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
