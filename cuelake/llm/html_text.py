"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf tag path. Over a page, text length and punctuation are
added up per path and divided by the path's node count; both ratios are smoothed with those of
paths under the same parent, fused into one and compared with a threshold. The paths above it
vote for the part of the tree that holds the article: from the root downwards the walk follows
the container that most of the chosen text lies in, and ends at article or main. Of that part all
blocks are kept (text that stands in a container itself which is neither article nor main only where its path is above the threshold), of the rest of the page the blocks whose path is above the threshold, and headings beside the
container. Outside article and main a block goes if it and its path are made of links and the path is below the
threshold; paragraphs and headings never do. Page order stays.

Subtrees that say by their tag, or by a class, id or role that is or ends in a cue word, that they are
menus, headers, footers, sidebars, notices, adverts, forms or comments have paths of their own with a ratio of 0. A cue word elsewhere in
a name is a doubt: such subtrees have paths of their own, too, and stay where most of their text has paths above the threshold. A page without a path above the
threshold has no text. Cues don't
hold for article, main and what they lie in, or on pages with neither for what most of the chosen text lies in. Blocks are joined by one
newline; white space inside a block, line breaks included, becomes one space. Null, empty and
text-free pages give the empty string; broken markup never fails.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import as_text, mapped

ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+"
TOKEN = re.compile(rf"<!--(?:.*?-->)?|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>{ATTRIBUTES})>|<[!?/][^>]*>", re.DOTALL)
#: Fixed names of elements whose content isn't text of the page. Of the foreign ones a tag that ends in a slash is the whole element.
RAW = frozenset("script style title textarea iframe noscript template svg object select button annotation annotation-xml".split())
FOREIGN = frozenset("svg math".split())
#: Without an end tag these reach to the end of the page; of the others the tag alone goes.
TO_THE_END = frozenset("script style".split())
#: All attributes are read, so that what stands inside the value of another isn't one; a quote that isn't closed is a plain character.
ATTRIBUTE = re.compile(r"([^\s=>]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))?+)?+")
NAMING = frozenset("class id role".split())
#: Fixed names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
CONTAINERS = frozenset("html body main article div center".split())
CONTENT = frozenset("main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_LINKS = HEADINGS | {"p"}
LEFT_OUT_TAGS = frozenset("head nav footer aside dialog menu".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": set()}
#: Fixed cue words in class, id and role that mark what isn't the article.
LEFT_OUT_CUES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar aside rail menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended comment comments reply replies disqus discussion respond newsletter "
    "subscribe subscription signup footer header masthead widget toolbar pagination pager login search skip contentinfo complementary toc byline-ad".split()
)
#: Fixed cue words that name parts of articles, too: inside an article they are in doubt.
ALSO_SECTIONS = frozenset("discussion".split())
#: Fixed words: layout classes such as with-sidebar, and headers that hold the article's title.
NEGATIONS = frozenset("with has no without".split())
OF_ARTICLE = frozenset("article post entry story content main".split())
PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？]")
WORDS = re.compile(r"[a-z]+")
CONTENT_SHARE = 0.6
LINK_SHARE = 0.8


#: What an element says of itself: it stays, a cue in doubt, a cue, a tag that goes.
STAYS, DOUBT, CUE, GOES = range(4)


def standing(tag: str, attrs: str, in_article: bool) -> int:
    if tag in LEFT_OUT_TAGS:
        return GOES
    names = [WORDS.findall(name) for key, *values in ATTRIBUTE.findall(attrs) if key.lower() in NAMING for name in "".join(values).lower().split()] if attrs else []
    titles = [w for w in names if w and w[-1] == "header" and w[0] in OF_ARTICLE]
    if tag == "header" and not in_article and not titles:
        return GOES
    if tag in ("html", "body") or tag in CONTENT:
        return STAYS
    found = CUE if tag == "form" else STAYS  # a form around the article is no form of the page's own
    for w in names:
        for k, word in enumerate(w if w not in titles else ()):
            if word in NEGATIONS:
                break
            if word in LEFT_OUT_CUES:
                found = max(found, CUE if k == len(w) - 1 and not (in_article and word in ALSO_SECTIONS) else DOUBT)
    return found


ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE) for tag in RAW | FOREIGN}


class Page:
    """The text nodes of a page: block number, path of the block, path of the leaf, text, whether in a link."""

    def __init__(self, source: str):
        #: Elements in page order, the page itself first: the element around, tag, standing.
        self.around, self.tags, self.standings = [0], [""], [STAYS]
        #: Block number, element of the block, element, text (None: white space), whether in a link.
        self.parts: list[tuple[int, int, int, str | None, bool]] = []
        self.read(source)
        self.exempt()
        self.place([s >= CUE for s in self.standings])

    def place(self, barred: list[bool]) -> None:
        """Paths of the elements, and the text nodes; what stands in a barred element has paths of its own."""
        self.paths: dict[tuple[int, str], int] = {}
        self.parent, self.label, self.barred = [-1], [""], [False]
        self.nodes: list[tuple[int, int, int, str, bool]] = []
        own = [0]
        for e in range(1, len(self.tags)):
            own.append(self.path(own[self.around[e]], self.tags[e] + "?" * (self.standings[e] == DOUBT), barred[e]))
        self.place_of = own
        last = (-1, 0, 0)
        for block, of, leaf, part, link in self.parts:
            if part is not None:
                self.nodes.append((block, own[of], own[leaf], part, link))
                last = last if self.barred[own[leaf]] else (block, own[of], own[leaf])
            elif last[0] == block and not self.barred[own[leaf]]:
                self.nodes.append((*last, " ", False))

    def exempt(self) -> None:
        """Takes back cues of elements that hold the article."""
        n, tags, around, standings = len(self.tags), self.tags, self.around, self.standings
        if not any(s in (DOUBT, CUE) for s in standings):
            return
        gone, cued, in_main, in_article = [False], [False], [False], [False]
        for e in range(1, n):
            a = around[e]
            gone.append(gone[a] or standings[e] == GOES)
            cued.append(cued[a] or standings[e] in (DOUBT, CUE))
            in_main.append(in_main[a] or tags[a] == "main")
            in_article.append(in_article[a] or tags[a] == "article")
        mains = [e for e in range(n) if tags[e] == "main" and not gone[e]]
        articles = [e for e in range(n) if tags[e] == "article" and not gone[e] and not in_article[e]]
        size = [0] * n
        if mains or articles:
            for _, _, leaf, part, _ in self.parts:
                size[leaf] += 0 if part is None or gone[leaf] else len(part)
        else:  # the chosen text, as if there were no cues
            self.standings = [STAYS if s in (DOUBT, CUE) else s for s in standings]
            self.place([s == GOES for s in self.standings])
            self.standings, chosen = standings, self.chosen()
            for _, _, leaf, part, _ in self.parts:
                size[leaf] += len(part) if part is not None and not gone[leaf] and self.place_of[leaf] in chosen else 0
        for e in range(n - 1, 0, -1):
            size[around[e]] += size[e]
        if mains or articles:
            holds = set(mains)
            if mains:  # an article in main under a cue counts if most of main lies in it
                articles = [e for e in articles if in_main[e] and 2 * size[e] >= sum(size[m] for m in mains if not in_main[m])]
            if articles:  # the longest; those under cues beside it are teasers or comments
                holds.add(max(articles, key=lambda e: (size[e], not cued[e])))
            for e in range(n - 1, 0, -1):
                if e in holds:
                    holds.add(around[e])
        else:
            holds = {e for e in range(n) if size[e] >= CONTENT_SHARE * size[0] > 0}
        for e in holds:
            if standings[e] in (DOUBT, CUE):
                standings[e] = STAYS

    def path(self, above: int, tag: str, barred: bool) -> int:
        key = (above, tag + "!" * barred)
        if key not in self.paths:
            self.paths[key] = len(self.parent)
            self.parent.append(above)
            self.label.append(tag)
            self.barred.append(barred or self.barred[above])
        return self.paths[key]

    def read(self, source: str) -> None:
        stack: list[tuple[str, int]] = []  # tag, element
        open_: Counter[str] = Counter()
        block = at = links = 0
        endless: set[str] = set()
        in_math = False

        def end_of(tag: str, start: int) -> re.Match | None:
            """The end tag of an element from there on; a name that has none is looked for once."""
            found = None if tag in endless else ENDS[tag].search(source, start)
            if not found:
                endless.add(tag)
            return found

        def pop() -> None:
            nonlocal links
            tag, _ = stack.pop()
            open_[tag] -= 1
            links -= tag == "a"

        def text(part: str) -> None:
            if part and not part.isspace():
                k = len(stack)
                while k and stack[k - 1][0] in INLINE:
                    k -= 1
                self.parts.append((block, stack[k - 1][1] if k else 0, stack[-1][1] if stack else 0, part, links > 0))
            elif part:
                self.parts.append((block, 0, stack[-1][1] if stack else 0, None, False))

        last = source.rfind(">") + 1  # no tag ends behind it
        while m := TOKEN.search(source, at, last) if at < last else None:
            text(source[at : m.start()])
            at = len(source) if m[0] == "<!--" else m.end()
            tag = (m["tag"] or "").lower()
            if not tag:
                continue
            if tag in RAW:
                if not m["close"] and not (tag in FOREIGN and m["attrs"].endswith("/")):
                    end = end_of(tag, at)
                    at = end.end() if end else len(source) if tag in TO_THE_END else at
                continue
            if tag == "math":  # its symbols are text of the line
                in_math = not m["close"] and not m["attrs"].endswith("/") and end_of(tag, at) is not None
                continue
            if in_math:
                continue
            if tag == "br":
                text(" ")
                continue
            block += tag not in INLINE
            if m["close"]:
                if open_[tag]:
                    while stack:
                        found = stack[-1][0] == tag
                        pop()
                        if found:
                            break
                continue
            if tag not in INLINE and open_["p"]:  # a block ends an open paragraph
                k = len(stack)
                while k and (stack[k - 1][0] in INLINE):
                    k -= 1
                if k and stack[k - 1][0] == "p":
                    while len(stack) >= k:
                        pop()
            if tag in CLOSED_BY and any(open_[t] for t in CLOSED_BY[tag]):
                k = len(stack) - 1
                while k >= 0 and stack[k][0] not in CLOSED_BY[tag] and stack[k][0] not in SCOPE[tag]:
                    k -= 1
                if k >= 0 and stack[k][0] in CLOSED_BY[tag]:
                    while len(stack) > k:
                        pop()
            if tag in VOID:
                continue
            self.around.append(stack[-1][1] if stack else 0)
            self.tags.append(tag)
            self.standings.append(standing(tag, m["attrs"], open_["article"] > 0 or open_["main"] > 0))
            stack.append((tag, len(self.tags) - 1))
            open_[tag] += 1
            links += tag == "a"
        text(source[at : source.find("<!--", at) if "<!--" in source[at:] else len(source)])

    def chosen(self) -> set[int]:
        """Leaf paths whose smoothed and fused ratio reaches the threshold."""
        length, marks, count = Counter(), Counter(), Counter()
        for _, _, leaf, part, _ in self.nodes:
            if not self.barred[leaf]:  # their ratio is 0
                length[leaf] += len(part)
                marks[leaf] += len(PUNCTUATION.findall(part))
                count[leaf] += 1
        near_length, near_marks, near = Counter(), Counter(), Counter()
        ratios = {p: (length[p] / count[p], marks[p] / count[p]) for p in count}
        for p, (a, b) in ratios.items():
            near_length[self.parent[p]] += a
            near_marks[self.parent[p]] += b
            near[self.parent[p]] += 1
        fused = {p: ((a + near_length[q] / near[q]) / 2) * (1 + (b + near_marks[q] / near[q]) / 2) for p, (a, b) in ratios.items() for q in [self.parent[p]]}
        total = sum(length.values())
        threshold = sum(fused[p] * length[p] for p in fused) / max(total, 1) / 2
        return {p for p, f in fused.items() if f >= threshold}

    def container(self, chosen: set[int]) -> int:
        """Where most of the chosen text lies, not below article, main, tables, sections or the level of paragraphs."""
        weight: Counter[int] = Counter()
        for _, _, leaf, part, _ in self.nodes:
            if leaf in chosen:
                weight[leaf] += len(part)
        for p in range(len(self.parent) - 1, 0, -1):  # a path is made after its parent
            weight[self.parent[p]] += weight[p]
        below: dict[int, list[int]] = {}
        for p in range(1, len(self.parent)):
            below.setdefault(self.parent[p], []).append(p)
        at = 0
        while self.label[at] not in CONTENT and (step := [p for p in below.get(at, []) if self.label[p] in CONTAINERS and weight[p] >= CONTENT_SHARE * weight[0] > 0]):
            at = max(step, key=lambda p: weight[p])
        return at

    def text(self) -> str:
        chosen = self.chosen()
        shown = [n for n in self.nodes if n[2] in chosen or not self.barred[n[2]]]
        if not chosen:
            return ""
        root, inside = self.container(chosen), [False] * len(self.parent)
        above, p = set(), root
        while p > 0:
            p = self.parent[p]
            above.add(p)
        total, linked, good = Counter(), Counter(), Counter()
        block_total, block_linked = Counter(), Counter()
        for block, own, leaf, part, link in shown:
            total[own] += len(part)
            linked[own] += len(part) if link else 0
            block_total[block] += len(part)
            block_linked[block] += len(part) if link else 0
            good[own] += len(part) if leaf in chosen else 0
        doubted, content = [False] * len(self.parent), [False] * len(self.parent)
        all_of, good_of = Counter(total), Counter(good)
        for p in range(len(self.parent) - 1, 0, -1):
            all_of[self.parent[p]] += all_of[p]
            good_of[self.parent[p]] += good_of[p]
        for p in range(len(self.parent)):
            inside[p] = p == root or (p > 0 and inside[self.parent[p]])
            content[p] = self.label[p] in CONTENT or (p > 0 and content[self.parent[p]])
            doubted[p] = self.label[p].endswith("?") and 2 * good_of[p] < all_of[p] or (p > 0 and doubted[self.parent[p]])
        loose = root and self.label[root] not in CONTENT  # text that stands in the container itself may be beside the article
        kept = [
            inside[p] and not doubted[p] and not (loose and p == root) or 2 * good[p] >= total[p] > 0 or self.label[p] in HEADINGS and self.parent[p] in above
            for p in range(len(self.parent))
        ]
        links = [linked[p] > LINK_SHARE * total[p] and 2 * good[p] < total[p] and not content[p] and self.label[p].rstrip("?") not in NEVER_LINKS for p in range(len(self.parent))]
        blocks: list[str] = []
        parts: list[str] = []
        last = None
        for block, own, _, part, _ in shown:
            if not kept[own] or links[own] and block_linked[block] > LINK_SHARE * block_total[block]:
                continue
            if block != last and parts:
                blocks.append("".join(parts))
                parts = []
            last = block
            parts.append(html.unescape(part) if "&" in part else part)
        blocks.append("".join(parts))
        return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def main_text(source: str) -> str:
    return Page(source).text()


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, in one narrow pass over whole pages.

    Repeated rows give repeated results, an empty table an empty one; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(as_text(s)) for s in batch["html"]]
            yield pd.DataFrame({id_col: batch[id_col].to_numpy(), url_col: batch[url_col].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts]})

    kinds = dict(df.dtypes)
    return mapped(df.selectExpr(f"`{id_col}`", f"`{url_col}`", f"`{html_col}` AS html"), run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
