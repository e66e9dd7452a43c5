"""Extraction against the articles that the pages' own markup shows, and hand-made pages."""

import html
import re
import time

import pytest

from lodestone.llm import maintext as M
from lodestone.llm import registry

PARAGRAPH = "The committee met on Tuesday, and after a long debate, voted to approve the plan; work starts in May."


def truth(page):
    """The blocks of the one article element."""
    body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    body = re.sub(r"</?(?:b|br)>", " ", body)
    body = re.sub(r"<[^>]*$", "", body)
    parts = re.split(r"</?(?:p|h1)>", body)
    return "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


def test_given_pages(spark):
    root = "/root/testdata/sf0.1"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{root}/pages.parquet").collect()}
    got = registry.op9_main_text(spark, root).collect()
    assert len(got) == len(pages)
    wrong = [r.page_id for r in got if r.text != truth(pages[r.page_id])]
    assert not wrong, (len(wrong), wrong[:5])
    assert all(r.n_chars == len(r.text) for r in got)


WRAP = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><header><h2>Site name</h2></header>%s<aside>Weather</aside><footer>&copy; 2024, all rights reserved, somewhere.</footer></body></html>"


@pytest.mark.parametrize(
    "body, text",
    [
        (f"<article><header><h1>Title</h1></header><p>{PARAGRAPH}</p><ul><li>one</li><li>two</ul><div class='comments'><p>{PARAGRAPH}</p></div></article>", f"Title\n{PARAGRAPH}\none\ntwo"),
        (f"<div id=cookie-notice><p>{PARAGRAPH}</p></div><div class=story><p>{PARAGRAPH}<p>Short.</div>", f"{PARAGRAPH}\nShort."),
        (f"<main><p>{PARAGRAPH}</p><form><label>Name, please</label><input></form><div class='ad-slot'>Buy now!</div><p>a &lt; b &amp; c&nbsp; d<br>e</p></main>", f"{PARAGRAPH}\na < b & c d e"),
        (f"<script>var a='<p>no</p>';</script><!-- <p>{PARAGRAPH}</p> --><div role=banner>{PARAGRAPH}</div><section><h1>H</h1><p>{PARAGRAPH}</p></section>", f"H\n{PARAGRAPH}"),
        (f"<article><p>{PARAGRAPH}</p><table><tr><td>1<td>2</table><p hidden>secret</p></article>", f"{PARAGRAPH}\n1\n2"),
        ("<article><p>Only this</p></article>", "Only this"),
        (f"<article><p data-id='alert-7' data-role='search' my-class=ad>{PARAGRAPH}</p><p class=notice>Short.</p></article>", f"{PARAGRAPH}\nShort."),
        (f"<article><div class='entry-header'><h1>Title</h1></div><p>{PARAGRAPH}</p></article>", f"Title\n{PARAGRAPH}"),
        (f"<div class=post><div class='entry-header'><h1 class='page-header'>Title</h1></div><p>{PARAGRAPH}</p><div class=comments><p>{PARAGRAPH}</div></div>", f"Title\n{PARAGRAPH}"),
        (f"<article><section id='social-policy'><h2>Policy</h2><p>{PARAGRAPH}</p></section></article>", f"Policy\n{PARAGRAPH}"),
        (f"<div id=main><section class='menu-reform alert'><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></section></div>", f"{PARAGRAPH}\n{PARAGRAPH}"),
        (f"<article><p>A <span class='related-term'>word</span> and <span class=ad>another</span> stay. {PARAGRAPH}</p></article>", f"A word and another stay. {PARAGRAPH}"),
        (f"<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds. {PARAGRAPH}</p></article>", f"So x=2 holds. {PARAGRAPH}"),
        (f"<div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><div class='site-footer'>About us</div></div>", f"{PARAGRAPH}\n{PARAGRAPH}"),
        (f"<article><p>one <b>bold<p>{PARAGRAPH}</article>", f"one bold\n{PARAGRAPH}"),
    ],
)
def test_hand_made(body, text):
    assert M.main_text(WRAP % body) == text


P, TWO, THREE = f"<p>{PARAGRAPH}</p>", f"{PARAGRAPH}\n{PARAGRAPH}", f"{PARAGRAPH}\n{PARAGRAPH}\n{PARAGRAPH}"
MENU = "<ul><li><a href=/a>Home</a><li><a href=/b>World news</a><li><a href=/c>Sport</a></ul>"


@pytest.mark.parametrize(
    "page, text",
    [
        # Elements whose tag or name speaks against them, but which hold the article.
        (f"<body><form id=aspnetForm><div id=menu>{MENU}</div><div id=body><h1>Title</h1>{P}{P}</div><div id=footer>&copy; 2024</div></form></body>", f"Title\n{TWO}"),
        (WRAP % f"<main><div id=login><h2>Sign in</h2>{P}{P}{P}</div></main>", f"Sign in\n{THREE}"),
        (WRAP % f"<article>{P}<section id=sharing><h2>Sharing</h2>{P}{P}</section></article>", f"{PARAGRAPH}\nSharing\n{TWO}"),
        (WRAP % f"<article><h1>Bistro</h1>{P}{P}<section id='menu'><h2>Menu</h2>{P}</section></article>", f"Bistro\n{TWO}\nMenu\n{PARAGRAPH}"),
        (f"<body><div class=sidebar><h1>Title</h1>{P}{P}</div><div class=nav>{MENU}</div></body>", f"Title\n{TWO}"),
        (f"<body><aside><h1>Title</h1>{P}{P}</aside></body>", f"Title\n{TWO}"),
        (f"<body><div role=dialog><div class=popup>{P}{P}</div></div></body>", TWO),
        # The body holds the content.
        (f"<body><h1>Title</h1>{P}{P}{P}{P}<ul><li>one<li>two</ul></body>", f"Title\n{THREE}\n{PARAGRAPH}\none\ntwo"),
        (f"<body><h1>Title</h1><h2>Part</h2>{P}{P}{P}<ul><li>one<li>two</ul></body>", f"Title\nPart\n{THREE}\none\ntwo"),
        (f"<body><nav>{MENU}</nav><h1>Title</h1>{P}{P}{P}<footer>About</footer></body>", f"Title\n{THREE}"),
        (f"<h1>Title</h1>{P}{P}{P}", f"Title\n{THREE}"),
        # Headers.
        (f"<body><header><h2>Site</h2>{MENU}</header><div class=post><header><h1>Title</h1></header>{P}{P}</div></body>", f"Title\n{TWO}"),
        (f"<body><div id=page><header><b>Site name</b></header><div><h1>Title</h1>{P}{P}</div></div></body>", f"Title\n{TWO}"),
        (f"<body><header><h1>Site</h1></header>{P}{P}{P}</body>", THREE),
        # Links in an article, and beside it.
        (WRAP % f"<article>{P}<ul><li><a href=/x>One link</a><li><a href=/y>Two</a></ul></article>", f"{PARAGRAPH}\nOne link\nTwo"),
        (f"<body><div class=story>{P}<ul><li><a href=/x>One link</a></ul>{P}{MENU}</div></body>", f"{PARAGRAPH}\nOne link\n{PARAGRAPH}"),
        (f"<body>{MENU}<div>{P}{P}</div>{MENU}</body>", TWO),
        # What stands beside the text of an article.
        (WRAP % f"<article>{P}<aside>{P}</aside><dialog open>{P}</dialog><object>Fallback, in the article.</object></article>", f"{THREE}\nFallback, in the article."),
        (WRAP % f"<article>{P}{P}<aside>Tags</aside><footer>Posted by someone, on a day, in a place.</footer><nav>{MENU}</nav></article>", TWO),
        # Reader comments, also where they are longer than the article.
        (f"<body><div class=post><h1>Title</h1>{P}</div><div id=comments><h2>Comments</h2>{P * 9}</div></body>", f"Title\n{PARAGRAPH}"),
        (WRAP % f"<article><h1>Title</h1>{P}<section class='comment-list'>{P * 9}</section></article>", f"Title\n{PARAGRAPH}"),
        (f"<body><div id=comments>{P}{P}</div><p>ok</p></body>", TWO),
        # Tables, definitions and quotations without any article element.
        (f"<body><div id=content><h1>Title</h1>{P}<blockquote>{P}</blockquote><dl><dt>term<dd>what it means</dl><table><tr><th>a<th>b<tr><td>1<td>2</table></div><div class='related'>{MENU}</div></body>", f"Title\n{TWO}\nterm\nwhat it means\na\nb\n1\n2"),
        (f"<body><div class=wrap><div class=ad>Buy this now!</div><div><h2>Part one</h2>{P}<h2>Part two</h2>{P}</div><div class='newsletter signup'><p>Get our news, every week.</p></div></div></body>", f"Part one\n{PARAGRAPH}\nPart two\n{PARAGRAPH}"),
        (f"<body><div class='cookie banner'><p>We use cookies, as all do; read more.</p><button>Accept</button></div><div>{P}{P}</div></body>", TWO),
        (f"<body><table><tr><td>{MENU}<td><h1>Title</h1>{P}{P}</table></body>", f"Title\n{TWO}"),
        (f"<body><div><p hidden>{PARAGRAPH}</p>{P}<div style='display:none'>{P}</div></div></body>", PARAGRAPH),
    ],
)
def test_pages_without_help(page, text):
    assert M.main_text(page) == text


def test_odd_pages():
    for page in ("", "   ", "<", "<p", "<html><body></body></html>", "<script>x", "<!-- x", "<a href='", "</p></div>"):
        assert M.main_text(page) in ("", "<")
    assert M.main_text("plain text only") == "plain text only"
    assert M.main_text("<p>1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"
    assert M.main_text("<div>" * 3000 + "deep") == "deep"
    assert M.main_text("<p>x</p>" * 20_000).count("x") == 20_000
    assert len(M.main_text("<a b='" * 3000)) == 0


def test_deep_pages_take_linear_time():
    for page in ("<div>a" * 60_000, "<span>" * 60_000 + "a", "<ul><li>a" * 30_000, "<b></i>" * 60_000, "<p>a</div>" * 40_000, "<div id='" + "x-" * 200_000 + "'>a"):
        began = time.perf_counter()
        assert "a" in M.main_text(page) or "<b>" in page
        assert time.perf_counter() - began < 8


def test_frames(spark):
    rows = [(1, "u", None, "c"), (1, "u", None, "c"), (None, None, WRAP % f"<p>{PARAGRAPH}</p>", "c"), (3, "v", "", "c")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text) for r in M.extract(frame).collect()), key=str)
    assert got == sorted([(1, "u", ""), (1, "u", ""), (None, None, PARAGRAPH), (3, "v", "")], key=str)
    assert M.extract(frame.limit(0)).count() == 0


def test_clashing_names(spark):
    frame = spark.createDataFrame([(1, "h", "<p>one</p>", "k")], "page_id long, _html string, html string, _html_ string")
    got = M.extract(frame, keep=("_html", "_html_", "html"))
    assert got.columns == ["page_id", "_html", "_html_", "html", "text"] and [tuple(r) for r in got.collect()] == [(1, "h", "k", "<p>one</p>", "one")]
    with pytest.raises(ValueError, match="text"):
        M.extract(frame.withColumnRenamed("_html", "text"), keep=("text",))
