"""Pages whose whole article has to come out: nested parts, cue words, long attributes, linked blocks."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from cuelake.llm import html_text
from cuelake.llm.html_text import main_text

LONG = "This is a long sentence, with marks, that goes on for a while. " * 8
TEXT = LONG.strip()


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><h1>T</h1><p>lead</p><section><p>{LONG}</p></section></article>", f"T\nlead\n{TEXT}"),
        (f"<main><h1>T</h1><div><p>{LONG}</p></div></main>", f"T\n{TEXT}"),
        (f"<article><p>Before.</p><table><tr><th>Head<td>{LONG}</table><p>After.</p></article>", f"Before.\nHead\n{TEXT}\nAfter."),
        (f"<body><h1>T</h1><div><p>{LONG}</p></div></body>", f"T\n{TEXT}"),
        (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><section><p>{LONG}</p></section></body>", f"{TEXT}\n{TEXT}\n{TEXT}"),
    ],
)
def test_all_blocks_of_the_article_stay(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class='content-sidebar-wrap'><main><p>{LONG}</p></main></div>", TEXT),
        (f"<div class='page-with-sidebar'><p>{LONG}</p></div>", TEXT),
        (f"<div class='layout-sidebar'><article><p>{LONG}</p></article></div>", TEXT),
        (f"<div class='content-sidebar'><article><p>{LONG}</p></article></div><article><p>Short one.</p></article>", TEXT),
        (f"<article class='post category-social'><p>{LONG}</p></article>", TEXT),
        (f"<body><div class='tag-promo'><p>{LONG}</p></div><div><p>x</p></div></body>", f"{TEXT}\nx"),
        (f"<article><p>{LONG}</p><div class='social-science'><p>{LONG}</p></div></article>", f"{TEXT}\n{TEXT}"),
    ],
)
def test_cue_words_on_what_holds_the_article(page, text):
    assert main_text(page) == text


def test_cue_words_beside_the_article():
    beside = f"<div class='site-sidebar'><p>{LONG}</p></div><div class='related'><article><p>{LONG}</p></article></div><div class='comments'><article class=comment>{LONG}</article></div>"
    assert main_text(f"<body><article><p>{LONG}</p><ul class='share-list'><li><a href=x>Mail</a></ul></article>{beside}</body>") == TEXT
    assert main_text(f"<body><main><p>{LONG}</p><p>{LONG}</p><div class='related'><article><p>{LONG[:60]}</p></article></div></main>{beside}</body>") == f"{TEXT}\n{TEXT}"


DATA = "data:image/png;base64," + "iVBORw0KGgo+/AAAA" * 6000  # 100 KB


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><p>{LONG}</p><p><img src=\"{DATA}\" alt=\"a > b\">After it.</p></article>", f"{TEXT}\nAfter it."),
        (f"<body><article data-json='{{\"class=ad\": \"<p class=\"ad\">{DATA}\"}}'><p>{LONG}</p></article><div>x</div></body>", TEXT),
        (f"<div style='{DATA}' class=ad>Buy.</div><p>{LONG}</p>", TEXT),
        (f"<div data-x='id=\"sidebar\" {DATA}'><p>Text, one.</p></div>", "Text, one."),
        ("<p title=it's>It's one, don't.</p><p class=\"x\"\">Two, \"too\".</p>", "It's one, don't.\nTwo, \"too\"."),
        ("<p>One, two.</p><p class=\"y>Three, four.</p><p class='z>Five, six.</p>", "One, two.\nThree, four.\nFive, six."),
    ],
)
def test_long_attributes_and_unclosed_quotes(page, text):
    assert main_text(page) == text


def test_broken_quotes_take_no_more_than_a_pass():
    assert main_text("<p>Text, one.</p>" + "<a x=\"y>" * 40_001).startswith("Text, one.")


ITEM = "<li><a href=x>A reference to a page of another site</a></li>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><h1><a href=x>Title</a></h1><p>{LONG}</p></article>", f"Title\n{TEXT}"),
        (f"<div><h2><a href=x>Title</a></h2><p>{LONG}</p></div>", f"Title\n{TEXT}"),
        (f"<main><p>{LONG}</p><ul>{ITEM * 5}<li>Plain.</li></ul></main>", f"{TEXT}\n" + "A reference to a page of another site\n" * 5 + "Plain."),
        (f"<div><p>{LONG}</p><ul>{ITEM * 5}<li>Plain.</li></ul></div>", f"{TEXT}\nPlain."),
    ],
)
def test_linked_blocks(page, text):
    assert main_text(page) == text


PARAGRAPH = "<p>This is a long paragraph of the article, with commas, and several words. It goes on and on, truly.</p>"
SAID = PARAGRAPH[3:-4]


def test_forms_around_the_page():
    """A form that holds the article isn't a form of its own; those beside and in it go."""
    own = "<form action=s>Search the site, please: <input></form>"
    assert main_text(f"<body><form id=page><h1>T</h1>{PARAGRAPH * 3}</form></body>") == "\n".join(["T", SAID, SAID, SAID])
    assert main_text(f"<body><form><div><article><h1>T</h1>{PARAGRAPH}</article></div></form>{own}</body>") == f"T\n{SAID}"
    assert main_text(f"<body><article><h1>T</h1>{PARAGRAPH}{own}</article></body>") == f"T\n{SAID}"


def test_names_that_hold_cues_and_long_attributes():
    assert main_text(f'<body><div class="social-science">{PARAGRAPH * 2}</div></body>') == f"{SAID}\n{SAID}"
    assert main_text(f'<body><div class="comment-policy-page"><h1>T</h1>{PARAGRAPH * 2}</div></body>') == f"T\n{SAID}\n{SAID}"
    assert main_text(f'<body><article>{PARAGRAPH}<img src="data:{"a" * 100_000}">{PARAGRAPH}</article></body>') == f"{SAID}\n{SAID}"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><h1>T</h1><svg class='i'/><p>{LONG}</p></article>", f"T\n{TEXT}"),
        (f"<article><h1>T</h1><svg-icon></svg-icon><p>{LONG}</p></article>", f"T\n{TEXT}"),
        (f"<button-group><article><p>{LONG}</p></article></button-group>", TEXT),
        (f"<article><p>{LONG}</p><svg viewBox='0 0 1 1'><text>label</text></svg><p>{LONG}</p></article>", f"{TEXT}\n{TEXT}"),
        (f"<article><p>{LONG}</p><svg><p>{LONG}</p></article>", f"{TEXT}\n{TEXT}"),
        (f"<article><p>{LONG}</p><button>Go<p>{LONG}</p><select><p>{LONG}</p></article>", f"{TEXT}\nGo\n{TEXT}\n{TEXT}"),
        (f"<title>T<article><p>{LONG}</p></article>", TEXT),
        (f"<article><p>{LONG}</p><script>var a = '<p>x</p>';<p>{LONG}</p></article>", TEXT),
        (f"<article><p>{LONG}</p><script data-a='b>c'>x</script ><p>{LONG}</p></article>", f"{TEXT}\n{TEXT}"),
        (f"<article><p>{LONG} If <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='t'>x=2</annotation></math> holds.</p></article>", f"{TEXT} If x=2 holds."),
        (f"<article><p>{LONG} <math/> holds.</p><p>One <math><mi>y</p><p>Two.</p></article>", f"{TEXT} holds.\nOne\ny\nTwo."),
        (f"<article><p>{LONG}</p><section class='discussion'><h2>D</h2><p>{LONG}</p></section></article>", f"{TEXT}\nD\n{TEXT}"),
        (f"<article><p>{LONG}</p></article><section class='discussion'><p>{LONG}</p></section>", TEXT),
        (f"<article><p>{LONG}</p><!-- <p>{LONG}</p>", TEXT),
        (f"<article><p>{LONG}</p><p>a < b and <3</p></article>", f"{TEXT}\na < b and <3"),
    ],
)
def test_elements_whose_content_is_no_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("part", ["<svg>", "<button ", "<!--", "<title>", "<a href='", "</svg", "<math>", "<select><b>", "<p class=\"", "<", "&lt;"])
def test_long_broken_pages_end(part):
    """Hundreds of thousands of characters of unclosed tags: no search is repeated for each of them."""
    main_text(part * 50_000 + f"<article><p>{LONG}</p></article>")
    main_text(part * 50_000)


def test_very_long_page():
    page = "<html><body><nav><a href=x>Menu</a></nav><article>" + f"<p>{LONG}</p>" * 20_000 + "</article></body></html>"
    assert main_text(page) == "\n".join([TEXT] * 20_000)


# --- the threshold decides --------------------------------------------------------------------

def pages(spark, n=250):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(n).collect()]


def bare(page: str) -> str:
    """A page whose parts don't say what they are."""
    return re.sub(r'\sclass="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", page))


def shared(found: str, wanted: str) -> int:
    return sum(len(k) * n for k, n in (Counter(found.split("\n")) & Counter(wanted.split("\n"))).items())


def test_without_the_threshold_every_page_differs(spark, monkeypatch):
    sources = pages(spark, 60)
    wanted = [main_text(p) for p in sources]
    monkeypatch.setattr(html_text.Page, "chosen", lambda self: set())
    assert {main_text(p) for p in sources} == {""}
    monkeypatch.setattr(html_text.Page, "chosen", lambda self: set(range(len(self.parent))))
    assert all(len(main_text(p)) > len(w) for p, w in zip(sources, wanted, strict=True))


def test_pages_that_do_not_say_what_is_the_article(spark):
    """With article, nav and footer as plain divs and no classes, the paths alone find the article."""
    kept = gone = wanted = 0
    for page in pages(spark):
        right, found = main_text(page), main_text(bare(page))
        kept, gone, wanted = kept + shared(found, right), gone + len(found.replace("\n", "")), wanted + len(right.replace("\n", ""))
    assert kept == wanted and kept > 0.97 * gone


def plain_chosen(page: html_text.Page) -> set[tuple]:
    """The paths above the threshold, by a plain statement of the rule on whole tag paths."""
    def path(p: int) -> tuple:
        return () if p == 0 else (*path(page.parent[p]), (page.label[p], page.barred[p]))

    nodes = [(path(leaf), text) for _, _, leaf, text, _ in page.nodes if not page.barred[leaf]]
    ratio = {}
    for p in {p for p, _ in nodes}:
        texts = [t for q, t in nodes if q == p]
        ratio[p] = (sum(map(len, texts)) / len(texts), sum(len(html_text.PUNCTUATION.findall(t)) for t in texts) / len(texts))
    fused = {}
    for p, own in ratio.items():
        beside = [r for q, r in ratio.items() if q[:-1] == p[:-1] and (p == ()) == (q == ())]
        smooth = [(x + sum(r[k] for r in beside) / len(beside)) / 2 for k, x in enumerate(own)]
        fused[p] = smooth[0] * (1 + smooth[1])
    total = sum(len(t) for _, t in nodes)
    return {p for p, f in fused.items() if f >= sum(fused[q] * len(t) for q, t in nodes) / total / 2}


def test_paths_against_a_plain_version(spark):
    def path(page: html_text.Page, p: int) -> tuple:
        return () if p == 0 else (*path(page, page.parent[p]), (page.label[p], page.barred[p]))

    for source in [*pages(spark, 40), *map(bare, pages(spark, 40))]:
        page = html_text.Page(source)
        assert {path(page, p) for p in page.chosen()} == plain_chosen(page)
