"""Main text of web pages by composite text density.

Every page is parsed to a tree. Each element gets its characters per tag, adjusted
for link characters and link tags; an element's density sum adds the densities of
its children; the element with the largest sum is the core of the article. From
there the choice widens along the path to the body as long as the element above is
at least as dense as the body; where that element holds page furniture, or is the body
itself, it lends the title and the paragraphs between it and the article. Elements that
their tag, class, id or role marks as furniture are left out, but for those around
the article itself.

What a name marks: a class, id or role whose words are marks, or marks beside words of
place and shape (``site-footer``, but not ``full-text-search`` or ``related-work``), and
outside of articles a class with one of the words that are marks wherever they stand.
Headings, paragraphs, quotes, list items and inline elements go only by such a word
alone, outside of articles also if all names of their class are marks; other boxes of an article that a doubtful word marks go only if
half of their text is links or they are short: less than BOX characters or than a tenth
of the article.

Defined results: null or empty html gives an empty text; tags that are never
closed, closed twice or cut off end where their parents do; repeated rows are
extracted each by itself; an empty table gives an empty table; columns other than
the named ones are ignored. Nothing is cut off, however long a page is.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<""", re.S)
NAMES = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
HIDDEN = re.compile(r"""(?i)(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""")

#: Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
FURNITURE = frozenset("nav aside form footer header menu".split())
DROPPED = FURNITURE | RAW | frozenset("head button select option datalist input label object applet audio video canvas map dialog".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figure figcaption td th tr".split())
#: A new element of the first kind ends an open one of the second, unless one of the third stands between.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
ENDS_P = BLOCK - frozenset("body html tbody thead tfoot tr td th caption legend summary".split())
P_SCOPE = frozenset("table td th button caption html object".split())
#: Words in class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion menu nav navbar navigation topnav breadcrumb breadcrumbs sidebar "
    "footer header masthead cookie cookies consent gdpr notice notices alert newsletter subscribe share sharing social related recommended comment comments "
    "reply replies disqus respond login signin signup register popup modal overlay widget pagination pager copyright complementary contentinfo search form toolbar".split()
)
#: Those of them that mark wherever they stand in a class; the others are words of articles too.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo navbar topnav breadcrumb breadcrumbs sidebar footer masthead cookie cookies gdpr newsletter disqus signin signup popup modal pager pagination".split()
)
#: Words of place and shape that stand beside marks in names of furniture.
SHAPES = frozenset(
    "top bottom left right main site page global primary secondary mobile desktop sticky fixed wrapper wrap container inner outer box boxes block blocks area section list items item links link bar button buttons "
    "icon icons body content text post posts article entry col column row group panel unit slot zone region title label form author meta bottom id new v".split()
)
ARTICLE = frozenset(["article", "main"])
#: Words of a name such as has-sidebar or no-comments, by which it tells of a page's state and not of what the element is.
STATES = frozenset("has have no not with without hide hides show shows is open".split())
COMMENTS = frozenset("comment comments reply replies disqus respond".split())
#: Marked elements of these tags are never the page's own wrapper.
APART = frozenset("nav aside footer menu".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: A marked wrapper of a page holds more characters than this.
WRAPPER = 120

#: A doubtful box of an article that stays holds at least so many characters.
BOX = 240

NO, SOFT, FOR_GOOD = range(3)
#: Left out only if it is short or full of links.
DOUBTFUL = 3


def _marks(attributes: str) -> tuple[set[str], set[str], bool]:
    """The marks of an element's class, id and role: of names that hold nothing else, and of all others that mark wherever they stand; whether all names of its class or role are of the first kind."""
    whole: set[str] = set()
    words_: set[str] = set()
    alone, others = False, False
    for m in NAMES.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = [w for w in re.split(r"[^a-z0-9]+", name) if w and not w[0].isdigit()]
            if not STATES.isdisjoint(words):
                continue
            marks = MARKS.intersection(words)
            if marks and all(w in MARKS or w in SHAPES for w in words):
                whole |= marks
                alone |= m[1].lower() != "id"
            elif m[1].lower() != "id":
                words_ |= marks & STRONG
                others = True
    return whole, words_, alone and not others


def _unwanted(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element is left out: no, unless it holds the article, always, or if it is short or full of links."""
    if tag in DROPPED:
        if in_article and tag in ("header", "label"):
            return NO
        return SOFT if tag in FURNITURE else FOR_GOOD
    if not attributes or tag in ("html", "body"):
        return NO
    if HIDDEN.search(attributes):
        return FOR_GOOD
    whole, words, alone = _marks(attributes)
    if tag not in BLOCK or tag in PLAIN:
        plain = tag in BLOCK and not in_article and alone
        return FOR_GOOD if plain and COMMENTS & whole else SOFT if whole & STRONG or plain else NO
    if COMMENTS & whole:
        return FOR_GOOD
    if tag in ARTICLE:
        return NO
    if in_article:
        whole.discard("header")
        return SOFT if whole & STRONG else DOUBTFUL if whole else NO
    return SOFT if whole or words else NO


class Page:
    """Elements in document order (an element's descendants follow it), and the texts between their tags."""

    def __init__(self, source: str):
        self.tag, self.parent, self.own, self.article = ["#root"], [-1], [NO], [False]
        self.events: list[tuple[int, str | None]] = []
        self.body = 0
        open_, self.opened = [0], Counter()
        at, n = 0, len(source)
        while at < n:
            m = TOKEN.match(source, at)
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if m[0][0] != "<" or m[0] == "<":
                    self.events.append((open_[-1], m[0]))
                continue
            tag = name.lower()
            if m[1] or m[4]:
                self._close(open_, tag)
                continue
            self._end_others(open_, tag)
            if tag == "body" and not self.body:
                self._leave(open_, 1)
            k = self._add(open_[-1], tag, m[3] or m[6] or "")
            if tag == "body" and not self.body:
                self.body = k
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}(?![^\\s/>])[^>]*(?:>|\\Z)", re.I).search(source, at)
                at = end.end() if end else n
            elif tag not in VOID:
                open_.append(k)
                self.opened[tag] += 1
            elif tag == "br":
                self.events.append((k, " "))
        self._choose()

    def _inherited(self) -> list[bool]:
        out = [False]
        for k in range(1, len(self.tag)):
            out.append(out[self.parent[k]] or self.own[k] != NO)
        return out

    def _choose(self) -> None:
        """``skip``: which elements are left out, with all below them; a marked wrapper of the article stays.

        If every article or main element stands in marked ones, what surrounds the
        largest stays. Then, while less than a tenth of the prose of one marked
        element would stay otherwise, that element is the wrapper of the page and stays.
        """
        n = len(self.tag)
        text, blocks, linked, below, links = [0] * n, [0] * n, [False] * n, [[] for _ in range(n)], [0] * n
        for k, t in self.events:
            if t and self.tag[k] != "br":
                text[k] += len(t.strip())
        gone = [False] * n
        for k in range(1, n):
            p = self.parent[k]
            gone[k] = gone[p] or self.own[k] == FOR_GOOD
            linked[k] = linked[p] or self.tag[k] == "a"
            below[p].append(k)
            if gone[k] or linked[k]:
                links[k] = text[k] * linked[k]
                text[k] = 0
        prose = text.copy()
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            blocks[p] += blocks[k] + (self.tag[k] in PROSE and text[k] > 0)
            prose[p] += prose[k]
            links[p] += links[k]
        whole = [0] * n
        for k in range(1, n):
            whole[k] = whole[self.parent[k]] if self.article[self.parent[k]] else prose[k]
            if self.own[k] == DOUBTFUL:
                stays = links[k] < prose[k] and prose[k] >= max(BOX, whole[k] / 10)
                self.own[k] = NO if stays else SOFT
        skip = self._inherited()
        articles = [k for k in range(1, n) if self.tag[k] in ARTICLE and prose[k] and not gone[k]]
        if articles and all(skip[k] for k in articles):
            k = max(articles, key=lambda k: (prose[k], -k))
            while k > 0:
                self.own[k], k = NO, self.parent[k]
        kept, wrappers, fresh = 0, [], [0]
        while True:
            while fresh:  # each element becomes visible at most once
                k = fresh.pop()
                kept += text[k]
                for c in below[k]:
                    if self.own[c] == NO:
                        fresh.append(c)
                    elif self.own[c] == SOFT and self.tag[c] not in APART and blocks[c] > 1:
                        heappush(wrappers, (-prose[c], c))
            if not wrappers or -wrappers[0][0] <= max(10 * kept, WRAPPER):
                break
            k = heappop(wrappers)[1]
            self.own[k] = NO
            fresh.append(k)
        self.skip = self._inherited()

    def _add(self, parent: int, tag: str, attributes: str) -> int:
        inside = self.article[parent] or tag in ARTICLE
        self.tag.append(tag)
        self.parent.append(parent)
        self.article.append(inside)
        self.own.append(_unwanted(tag, attributes, self.article[parent]))
        k = len(self.tag) - 1
        if tag in BLOCK:
            self.events.append((k, None))
        return k

    def _leave(self, open_: list[int], i: int) -> None:
        """Closes the open elements from the ``i``-th on."""
        for k in open_[i:]:
            self.opened[self.tag[k]] -= 1
        del open_[i:]

    def _close(self, open_: list[int], tag: str) -> None:
        if not self.opened[tag]:
            return
        for i in range(len(open_) - 1, 0, -1):
            if self.tag[open_[i]] == tag:
                if tag not in ("body", "html"):
                    if any(self.tag[x] in BLOCK for x in open_[i:]):
                        self.events.append((open_[i], None))
                    self._leave(open_, i)
                return
            # an inline end tag does not reach over the block around it
            if tag not in BLOCK and self.tag[open_[i]] in BLOCK:
                return

    def _end_others(self, open_: list[int], tag: str) -> None:
        ends, scope = ENDS.get(tag, (frozenset(), frozenset()))
        if not (tag in ENDS_P and self.opened["p"]) and not any(self.opened[name] for name in ends):
            return
        for i in range(len(open_) - 1, 0, -1):
            name = self.tag[open_[i]]
            if name in ends or (name == "p" and tag in ENDS_P):
                self.events.append((open_[i], None))
                self._leave(open_, i)
                return
            if name in scope or name in P_SCOPE:
                return

    def sums(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """Characters, tags, link characters and link tags of each element with its descendants."""
        n = len(self.tag)
        chars, links = [0] * n, [0] * n
        link = [False] * n
        for k in range(1, n):
            link[k] = link[self.parent[k]] or self.tag[k] == "a"
        for k, text in self.events:
            if text and self.tag[k] != "br" and not self.skip[k]:
                size = len("".join(text.split()))
                chars[k] += size
                if link[k]:
                    links[k] += size
        tags, link_tags = [0] * n, [0] * n
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            chars[p] += chars[k]
            links[p] += links[k]
            tags[p] += tags[k] + 1
            link_tags[p] += link_tags[k] + (self.tag[k] == "a")
        return chars, tags, links, link_tags


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_link_share: float) -> float:
    """Characters per tag, less the more of them are links; 0 for an element without text."""
    if not chars:
        return 0.0
    tags = max(tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body_link_share * chars + math.e)
    value = chars / max(link_chars, 1) * tags / max(link_tags, 1)
    return chars / tags * math.log(max(value, 1.0)) / max(math.log(max(base, 1.0)), 1.0)


def core(page: Page) -> tuple[int, set[int], list[int], list[int], list[int]]:
    """The element whose text is the article, elements before it that belong to it, and the page's characters, link characters and link tags."""
    chars, tags, links, link_tags = page.sums()
    n, body = len(page.tag), page.body
    share = links[body] / max(chars[body], 1)
    density = [composite_density(chars[k], tags[k], links[k], link_tags[k], share) for k in range(n)]
    total, furniture = [0.0] * n, [False] * n
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        if not page.skip[k]:
            total[p] += density[k]
        furniture[p] |= furniture[k] or (page.skip[k] and page.tag[k] in FURNITURE)
    inside = [False] * n
    inside[body] = True
    for k in range(body + 1, n):
        inside[k] = inside[page.parent[k]]
    best = max((k for k in range(n) if inside[k] and not page.skip[k]), key=lambda k: (total[k], -k), default=body)
    # towards the body: at least its density; an article element is taken whole
    k, lent = best, set()
    while k not in (body, 0):
        p = page.parent[k]
        if page.article[k] and not page.article[p]:
            break
        if p in (body, 0) or furniture[p]:
            if p and not page.article[best] and (p == body or density[p] >= density[body]):
                lent |= _heading(page, p, k)
            if p in (body, 0):
                break
        elif page.article[p] or density[p] >= density[body]:
            best = p
        k = p
    return best, lent, chars, links, link_tags


def _heading(page: Page, parent: int, child: int) -> set[int]:
    """The title of ``parent`` and the paragraphs between it and ``child``, which holds the article."""
    found: set[int] = set()
    for k in range(parent + 1, child):
        if page.parent[k] == parent and not page.skip[k] and page.tag[k] in PLAIN and (found or page.tag[k] == "h1"):
            found.add(k)
    return found


def main_text(source: str | None) -> str:
    """The blocks of a page's article, joined by a blank line."""
    if not source:
        return ""
    page = Page(source)
    best, lent, chars, links, link_tags = core(page)
    n = len(page.tag)
    inside = [False] * n
    for k in range(n):
        if k == best or k in lent or not k:
            inside[k] = k == best or k in lent
            continue
        # lists and boxes of links are menus, but not in an article
        menu = not page.article[k] and link_tags[k] >= 2 and page.tag[k] in ("ul", "ol", "div", "section", "table", "dl") and 5 * links[k] >= 4 * chars[k]
        inside[k] = inside[page.parent[k]] and not page.skip[k] and not menu
    blocks, now = [], []
    for k, text in [*page.events, (0, None)]:
        if text is None:
            if now:
                block = " ".join(html.unescape("".join(now)).split())
                if block:
                    blocks.append(block)
                now = []
        elif inside[k]:
            now.append(text)
    return "\n\n".join(blocks)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: Sequence[str] = ("url",)) -> DataFrame:
    """(page_id, the columns ``keep``, text, n_chars) of every row."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), *(F.col(f"`{c}`") for c in keep), F.col(f"`{html_col}`").alias("html"))
    fields = rows.schema.fields[:-1]

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in fields), "text", "n_chars"])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
