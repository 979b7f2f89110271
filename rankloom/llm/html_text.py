"""Main text of HTML pages by composite text density (operator 3).

A page becomes a tree. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments,
known by element name, role, or a word of class or id, count for nothing. Every other node gets its characters per tag,
adjusted for the characters and tags of links, and the sum of its children's densities. The subtree with the greatest
sum is the content. The lowest density on its path to the body is the threshold: from the body on, every node that reaches
it is entered, and adds the subtree with the greatest sum below it; a node that doesn't reach it adds nothing, whatever it
holds. Where the body itself has the greatest sum, blocks of links only go. An article or main element around the greatest sum is taken
whole, and with it every other article (or main) whose density reaches ENOUGH of the threshold: its own heading and tags lower that of
a short one, links that of a teaser far more.

A class or id names an element only as a whole: all its words must be known, those of BESIDE or LAYOUT and such as box or list
beside them, so that ids made of a heading's words name nothing. Headings are never named, other elements of running text only by a class that is
one word of BESIDE. What BESIDE names stands beside an article's text, unless it has half of that text. What LAYOUT names
may also be a part of it (section-header, related): within an article it counts only where links make half of the element's text, or where
the word is a whole class of BOX and the element has at most a fifth of the article's text; outside, not where the element has most of
the page's text.

Null and empty pages give an empty text, n_chars 0; empty tables give no rows. Broken markup is read as browsers do in the
main: open elements end with what holds them, an unfinished tag at the end is dropped, unknown references stay as they are.
Of subtrees with equal sums the denser one is chosen, then the first. Repeated pages each get their own row. Whole pages are
read, in time linear in their length and nesting. A column with the name of a new one is replaced.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.common import with_columns

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[!/?a-zA-Z][^>]*\Z""", re.S)
MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Element names of the HTML standard, by their part here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("caption tbody td tfoot th thead tr html body dd dt li".split()) | frozenset(["p"])
#: A start tag of the key ends an open element of the first set, unless one of the second lies between.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tr td th tbody thead", "table"), "tfoot": ("tr td th tbody thead", "table")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
FENCE = frozenset("table td th caption button object template html body".split())
SKIPPED = frozenset("head script style textarea title xmp noscript iframe noframes nav footer aside form button select option input menu dialog template svg audio video search".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WHOLE = frozenset(["article", "main"])
ENOUGH = 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
RUNNING = frozenset("a abbr b blockquote caption cite code dd dfn dl dt em figcaption figure i img kbd li mark p pre q s samp small span strong sub summary sup table tbody td tfoot th thead time tr u var".split())
#: Words of classes and ids: what stands beside the text, what may, and what such names are made of besides.
BESIDE = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus gdpr modal nav navbar navigation newsletter popup sidebar sponsor sponsored sponsors subscribe subscription".split())
LAYOUT = frozenset("banner footer header masthead menu notice notices promo promos promotion related respond share sharing social toolbar widget widgets".split())
BOX = frozenset("banner notice notices promo promos promotion respond share sharing toolbar widget widgets".split())
WITH = frozenset("area bar block body bottom bottoms box btn button col column container content div entry fixed form global group holder inner item items layer left line link links list main media module outer overlay page panel placeholder post posts primary region right row secondary section site slot small sticky text thread top unit wrap wrapper zone".split())
#: How far an element's names say that it is no content: not at all, perhaps, by a whole class of BOX, for sure.
NOT_NAMED, LAYOUT_NAMED, BOX_NAMED, NAMED = range(4)


def named(tag: str, attributes: str) -> int:
    if not attributes or tag in ("html", "body", "main"):
        return NOT_NAMED
    found = NOT_NAMED
    for name, *values in MARK.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "role":
            found = NAMED if SKIPPED_ROLES.intersection(value.split()) else found
        elif tag in RUNNING:
            found = NAMED if name == "class" and not BESIDE.isdisjoint(value.split()) else found
        elif tag not in HEADINGS:
            for whole in value.split():
                parts = [x for x in re.split(r"[_-]+", whole) if x and not x.isdigit()]
                if not all(x in BESIDE or x in LAYOUT or x in WITH for x in parts):
                    continue
                if not BESIDE.isdisjoint(parts):
                    found = NAMED
                elif not LAYOUT.isdisjoint(parts):
                    found = max(found, LAYOUT_NAMED if BOX.isdisjoint([whole]) else BOX_NAMED)
    return found


class Page:
    """The tree of a page in page order: a node's descendants follow it. events: (node, text), or (node, None) at a block's edge."""

    def __init__(self, source: str):
        self.tag, self.parent, self.named, self.events = ["#root"], [-1], [NOT_NAMED], []
        stack, raw, at = [0], None, 0
        opened: dict[str, list[int]] = {}  # of each name, where it stands on the stack

        def close(k: int) -> None:
            for node in reversed(stack[k:]):
                opened[self.tag[node]].pop()
                if self.tag[node] in BLOCK:
                    self.events.append((node, None))
            del stack[k:]

        def innermost(tags) -> int:
            return max([opened[t][-1] for t in tags if opened.get(t)], default=0)

        def close_within(tags: frozenset, fence: frozenset) -> None:
            if (k := innermost(tags)) > innermost(fence):
                close(k)

        while at < len(source):
            if raw:
                end = re.compile(f"</{raw}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(source, at)
                at, raw = (end.end() if end else len(source)), None
                close(len(stack) - 1)
                continue
            found = TOKEN.search(source, at)
            if (stop := found.start() if found else len(source)) > at:
                self.events.append((stack[-1], source[at:stop]))
            if not found:
                break
            at = found.end()
            ending, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not name:
                continue
            name = name.lower()
            if ending:
                if (k := innermost([name])) and (name in BLOCK or k >= innermost(FENCE)):
                    close(k)
                continue
            if name in ("html", "body") and opened.get(name):
                continue
            if name in CLOSES_P:
                close_within(frozenset(["p"]), FENCE)
            if name in ENDS:
                close_within(*ENDS[name])
            if opened.get("head") and (name == "body" or name in BLOCK and name != "html"):
                close_within(frozenset(["head"]), frozenset(["body"]))
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.named.append(named(name, attributes))
            if name in BLOCK:
                self.events.append((node, None))
            elif name == "br":
                self.events.append((stack[-1], " "))
            if name not in VOID and not attributes.rstrip().endswith("/"):
                opened.setdefault(name, []).append(len(stack))
                stack.append(node)
                raw = name if name in RAW else None
        close(1)
        self.marked = self._mark()

    def _mark(self) -> list[bool]:
        """Which nodes count for nothing. A name does not count on what holds the article or main element with half of the text: it is a layout's."""
        n = len(self.tag)
        within, inside, article, linked = [False] * n, [False] * n, [0] * n, [t == "a" for t in self.tag]
        for k in range(1, n):
            p = self.parent[k]
            article[k] = p if self.tag[p] == "article" else article[p]
            inside[k] = inside[p] or self.tag[p] in WHOLE
            linked[k] |= linked[p]
            within[k] = within[p] or self.tag[k] in SKIPPED or self.tag[k] == "header" and not inside[k]
        size, links = [0] * n, [0] * n
        for k, text in self.events:
            if text is not None and not within[k]:
                size[k] += len(text)
                links[k] += len(text) * linked[k]
        for k in range(n - 1, 0, -1):
            size[self.parent[k]] += size[k]
            links[self.parent[k]] += links[k]
        holds = [False] * n
        for k in range(n - 1, 0, -1):
            if holds[k] or self.tag[k] in WHOLE and not within[k] and 2 * size[k] >= size[0]:
                holds[self.parent[k]] = True
        marked = [False] * n
        for k in range(1, n):
            says = self.named[k]
            if says in (LAYOUT_NAMED, BOX_NAMED):
                small = 5 * size[k] <= size[article[k]]
                says = 2 * links[k] >= size[k] or says == BOX_NAMED and small if article[k] else 2 * size[k] < size[0]
            elif says == NAMED and article[k]:
                says = 2 * size[k] < size[article[k]]
            marked[k] = marked[self.parent[k]] or within[k] or bool(says) and not holds[k]
        self.size = size
        return marked

    def above(self, k: int):
        while (k := self.parent[k]) >= 0:
            yield k

    def outermost(self, tags) -> list[int]:
        """The elements of these names that count and stand in none of them."""
        within = [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            within[k] = within[self.parent[k]] or self.tag[self.parent[k]] in tags
        return [k for k in range(1, len(self.tag)) if self.tag[k] in tags and not within[k] and not self.marked[k]]

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite text density of each node, and the sum of its children's."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        linked = [t == "a" for t in self.tag]
        for k in range(1, n):
            linked[k] |= linked[self.parent[k]]
        for k, text in self.events:
            if text is not None and not self.marked[k]:
                size = len("".join(text.split()))
                chars[k] += size
                link_chars[k] += size * linked[k]
        for k in range(n - 1, 0, -1):
            if not self.marked[k]:
                p = self.parent[k]
                chars[p] += chars[k]
                tags[p] += tags[k] + 1
                link_chars[p] += link_chars[k]
                link_tags[p] += link_tags[k] + (self.tag[k] == "a")
        body = next((k for k in range(n) if self.tag[k] == "body"), 0)
        body_links = link_chars[body] / max(1, chars[body])
        self.links_only = [chars[k] > 0 and link_chars[k] == chars[k] for k in range(n)]
        density, total = [0.0] * n, [0.0] * n
        for k in range(n - 1, -1, -1):
            if chars[k] and not self.marked[k]:
                c, t, lc, lt = chars[k], max(1, tags[k]), max(1, link_chars[k]), max(1, link_tags[k])
                base = math.log(c / max(1, c - link_chars[k]) * link_chars[k] + body_links * c + math.e)
                density[k] = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.0 + 1e-9)))
            if k:
                total[self.parent[k]] += density[k]
        return density, total

    def content(self) -> list[int]:
        """The nodes whose subtrees are the main text, in page order."""
        n = len(self.tag)
        density, total = self.densities()
        best = max(range(n), key=lambda k: (total[k], density[k], -k))
        if not total[best] and not density[best]:
            best = next((k for k in range(n) if self.tag[k] == "body"), 0)
        whole = [k for k in range(n) if self.tag[k] in WHOLE and not self.marked[k]]
        path = [best, *self.above(best)]
        path = path[: next((i for i, k in enumerate(path) if self.tag[k] == "body"), len(path) - 1) + 1]
        threshold = min(density[k] for k in path)
        for kind in ("article", "main"):
            if around := [k for k in path if self.tag[k] == kind]:
                return sorted({around[-1], *(k for k in self.outermost({kind}) if density[k] >= ENOUGH * threshold)})
        if whole and self.tag[best] in ("body", "html", "#root") and 2 * self.size[most := max(whole, key=lambda k: self.size[k])] >= self.size[best]:
            return sorted({most, *(k for k in self.outermost(WHOLE) if density[k] >= ENOUGH * threshold)})
        if self.tag[best] in ("body", "html", "#root"):  # the page's layout itself has the greatest sum: its blocks of nothing but links go
            for k in range(1, n):
                self.marked[k] = self.marked[k] or self.marked[self.parent[k]] or self.tag[k] in BLOCK and self.links_only[k]
        # The greatest sum below each node, or its own; ties as above.
        top = list(range(n))
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            top[p] = max(top[p], top[k], key=lambda j: (total[j], density[j], -j))
        entered, taken = [False] * n, set()
        for k in range(path[-1], n):
            if (k == path[-1] or self.parent[k] >= 0 and entered[self.parent[k]]) and density[k] >= threshold and not self.marked[k]:
                entered[k] = True
                # A leaf of the tree has no sum; what its parent adds then holds it.
                taken.add(top[k] if total[top[k]] else k)
        return sorted({self.block_of(k) for k in taken})

    def block_of(self, k: int) -> int:
        """k, or the element around it that a browser sets as one block: parts of a sentence don't stand alone."""
        while self.tag[k] not in BLOCK and self.tag[k] != "#root":
            k = self.parent[k]
        return k

    def text(self) -> str:
        n, roots = len(self.tag), set(self.content())
        of = [-1] * n  # the outermost root around each node
        for k in range(n):
            of[k] = of[self.parent[k]] if k and of[self.parent[k]] >= 0 else k if k in roots else -1
        blocks, parts, last = [], [], -1
        for k, piece in self.events:
            if of[k] >= 0:
                if piece is not None and self.marked[k]:
                    continue
                if of[k] != last or piece is None and (not self.marked[k] or k == of[k]):
                    blocks.append("".join(parts))
                    parts, last = [], of[k]
                parts.append(" " if piece is None else piece)
        blocks.append("".join(parts))
        return "\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame, column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """pages' columns `keep` (default all) with text and n_chars (its code points)."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        found = [main_text(x) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
        return {"text": found, "n_chars": [len(x) for x in found]}

    return with_columns(pages, run, {"text": "string", "n_chars": "long"}, keep)
