"""Main text of web pages by composite text density (Sun, Song and Liao 2011).

Every node of the page has a density: its characters per tag, lowered where much of it is link text.  The node whose
children's densities add up to most holds the article.  The lowest density on the way from it up to the body is the
threshold at which its neighbours, and articles elsewhere with a node that dense, still belong to it.  Paragraphs, headings,
lists and sections that follow each other are one run, however thin some are: where the chosen node is one of them, or lies in
one, the run belongs to it.  Menus, forms, adverts, comments and the like inside are left out by their element, role, class or
id.  A name that may belong to an article as well leaves out only what is thin or mostly links, and a form stays if it holds
the chosen node or most of its text.

The page is read once, by regular expressions, into parallel lists in document order; nothing recurses.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.words import parts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend option".split()
)
#: A start tag here ends an open paragraph.
ENDS_P = BLOCKS - frozenset("dd dt li td th tr tbody thead tfoot caption legend option html body summary".split())
#: A start tag ends an open element of these, unless one of the others lies between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
    "a": (("a",), ("div", "td", "section", "article", "body")),
}
#: Elements that hold no part of an article.
NOISE_TAGS = frozenset(
    "nav aside footer script style noscript iframe template button select input textarea object embed svg canvas audio video"
    " dialog menu head title link meta map noembed noframes xmp search datalist label".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar status".split())
#: Words of class and id names.
NOISE_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense adunit sponsor sponsored sponsors promo promoted promotion banner banners"
    " nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail footer masthead topbar toolbar comment comments commentlist"
    " disqus respond reply replies discussion share sharing shares social follow cookie cookies consent gdpr notice notices notification alert popup"
    " modal overlay newsletter subscribe subscription signup signin login register search related recommended recommendations widget widgets"
    " pagination pager skip hidden noprint paywall disclaimer copyright".split()
)
#: Those that name parts of articles as well.
DOUBTFUL_NAMES = frozenset(
    "advertising consent cookies copyright disclaimer discussion follow gdpr login navigation notice notices notification pagination promotion rail"
    " recommended recommendations register related reply replies search share shares sharing social subscription widgets".split()
)
#: Words that say nothing of what a name stands for.
FRAME_NAMES = frozenset(
    "area bar block body bottom box button buttons col column container content count entry feed form group header holder icon icons inner is item"
    " items left link links list main meta module panel page post reader right row section site slot text thread title top unit user wrap wrapper".split()
)
#: A name that begins so tells how an element looks, not what it is.
STATE_NAMES = frozenset("has have no non not with without".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Blocks of a text, of which several stand side by side.
RUN = HEADINGS | frozenset("p pre blockquote ul ol dl figure table section hgroup address".split())

_TAG = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s=>/][^\s=>/]*+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>"'][^\s>]*+|(?=[>\s])))?+""")
_WANTED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b""", re.IGNORECASE)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def noise_of(value: str) -> tuple[bool, bool]:
    """Whether a class or id names noise, and whether it may: by a doubtful word, or by a word among others."""
    sure = maybe = False
    for token in value.split():
        names = [x.lower() for x in _NAME_PART.findall(token)]
        noise = NOISE_NAMES.intersection(names)
        if noise and names[0] not in STATE_NAMES:
            told = not noise <= DOUBTFUL_NAMES and all(x in NOISE_NAMES or x in FRAME_NAMES or x.isdigit() for x in names)
            sure, maybe = sure or told, maybe or not told
    return sure, maybe and not sure


def tag_end(html: str, at: int) -> int:
    """The place of the ``>`` that ends the tag whose name ends at ``at``; -1 if there is none.  Quoted values may hold ``>``."""
    end = html.find(">", at)
    if end < 0 or (html.count('"', at, end) % 2 == 0 and html.count("'", at, end) % 2 == 0):
        return end
    place = at
    while True:
        found = _ATTRIBUTE.match(html, place)
        if not found or found.end() == place:
            break
        place = found.end()
    close = html.find(">", place)
    return close if close >= 0 and not html[place:close].strip("\"' \t\r\n\f/") else end


class Page:
    """Nodes in document order: tag, parent, end of subtree, noise; and pieces of text with their node."""

    def __init__(self, html: str):
        self.tag, self.parent, self.noise, self.landmark = ["html"], [-1], [False], [False]
        self.by_name, self.doubtful = [False], [False]
        self.events: list[tuple[int, str | None]] = []  # (node, text), or (node, None) where a block begins or ends
        self._read(html)

    def _open(self, tag: str, attributes: str, stack: list[int]) -> int:
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(stack[-1])
        noise, by_name, doubtful, landmark = tag in NOISE_TAGS, False, tag == "form", tag in ("article", "main")
        if attributes and _WANTED.search(attributes):
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id"):
                    sure, maybe = noise_of(value)
                    heading = tag in HEADINGS and name == "id"  # made of its words
                    by_name |= sure and not heading
                    doubtful |= maybe and tag not in HEADINGS
                elif name == "role":
                    noise |= value.lower() in NOISE_ROLES
                    doubtful |= value.lower() == "form"
                    landmark |= value.lower() == "main"
                elif name == "itemprop":
                    landmark |= value.lower() == "articlebody"
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
                    noise = True
        self.noise.append(noise)
        self.by_name.append(by_name)
        self.doubtful.append(doubtful)
        self.landmark.append(landmark)
        return node

    def _read(self, html: str) -> None:
        stack = [0]
        # Places on the stack: of every tag's open elements, and of the open blocks that a paragraph or a heading ends at.
        open_at: dict[str, list[int]] = {"html": [0]}
        not_p, not_heading = [0], [0]
        events, at, size = self.events, 0, len(html)

        def push(node: int, tag: str) -> None:
            place = len(stack)
            stack.append(node)
            open_at.setdefault(tag, []).append(place)
            if tag in BLOCKS:
                if tag != "p":
                    not_p.append(place)
                if tag not in HEADINGS:
                    not_heading.append(place)

        def close(down_to: int) -> None:
            for node in stack[down_to:]:
                tag = self.tag[node]
                open_at[tag].pop()
                if tag in BLOCKS:
                    events.append((self.parent[node], None))
                    if tag != "p":
                        not_p.pop()
                    if tag not in HEADINGS:
                        not_heading.pop()
            del stack[down_to:]

        def innermost(tags) -> int:
            return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

        def close_open(tags, barrier: int) -> None:
            place = innermost(tags)
            if place > barrier:
                close(place)

        while at < size:
            found = _TAG.search(html, at)
            text_end = found.start() if found else size
            if text_end > at:
                events.append((stack[-1], html[at:text_end]))
            if not found:
                break
            at = found.end()
            opening = found[0]
            if opening == "<!--":
                if html.startswith((">", "->"), at):
                    at = html.find(">", at) + 1
                    continue
                end = html.find("-->", at)
                at = end + 3 if end >= 0 else size
                continue
            if opening in ("<!", "<?"):
                end = html.find(">", at)
                at = end + 1 if end >= 0 else size
                continue
            name = _NAME.match(html, at - 1)
            tag, name_end = name[0].lower(), name.end()
            end = tag_end(html, name_end)
            if end < 0:
                break  # a tag that never ends hides what follows
            attributes, at = html[name_end:end], end + 1
            if opening[1] == "/":
                if tag == "br":
                    events.append((stack[-1], " "))
                elif open_at.get(tag) and tag not in ("html", "body"):
                    close(open_at[tag][-1])
                continue
            if tag in ("html", "body") and open_at.get(tag):
                continue
            if tag in ENDS_P:
                close_open(("p",), not_p[-1])
            if tag in ENDS:
                ended, within = ENDS[tag]
                close_open(ended, innermost(within))
            if tag in HEADINGS:
                close_open(HEADINGS, not_heading[-1])
            if tag == "body":
                close_open(("head",), 0)
            node = self._open(tag, attributes, stack)
            if tag in BLOCKS:
                events.append((stack[-1], None))
            elif tag == "br":
                events.append((stack[-1], " "))
            if tag in VOID:
                continue
            if tag in RAW:
                ending = _RAW_END[tag].search(html, at)
                if not ending:
                    break
                end = html.find(">", ending.end())
                at = end + 1 if end >= 0 else size
                continue
            if attributes.endswith("/") and tag in ("svg", "path", "use"):
                continue
            push(node, tag)

    def _densest(self, holds: list[bool], dropped: frozenset[int]) -> tuple:
        """What is left out, the counts, the densities, the path from the node of the largest sum, and its least density."""
        tag, parent, noise = self.tag, self.parent, self.noise
        n = len(tag)
        out, in_article = [False] * n, [False] * n
        for i in range(1, n):
            in_article[i] = in_article[parent[i]] or self.landmark[i]
            named = self.by_name[i] and not holds[i] and tag[i] not in ("body", "html")
            header = tag[i] == "header" and not in_article[i] and not holds[i]
            out[i] = out[parent[i]] or noise[i] or named or header or i in dropped
        chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.events:
            if text is not None and not out[node]:
                chars[node] += len("".join(text.split()))
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[parent[i]] or tag[i] == "a"
        for i in range(n - 1, 0, -1):
            if out[i]:
                continue
            p = parent[i]
            if in_link[i]:
                link_chars[i] = chars[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tag[i] == "a")
        body = next((i for i in range(n) if tag[i] == "body"), 0)
        ratio = link_chars[body] / max(1, chars[body])
        density, total = [0.0] * n, [0.0] * n
        for i in range(n):
            c, t, lc, lt = chars[i], max(1, tags[i]), link_chars[i], link_tags[i]
            if c and not out[i]:
                base = log(c / max(1, c - lc) * lc + ratio * c + e)
                # Without any link text the base is 1 for all nodes; its limit keeps their order.
                density[i] = c / t * max(0.0, log(max(1.0, c / max(1, lc) * (t / max(1, lt)))) / log(max(base, 1.0001)))
        for i in range(1, n):
            total[parent[i]] += density[i]
        inside = [i for i in range(n) if not out[i] and (i == body or i > body)]
        best = max(inside, key=lambda i: (total[i], -i), default=body)
        path = [best]
        while path[-1] not in (body, 0):
            path.append(parent[path[-1]])
        threshold = min(density[i] for i in path)
        peak = density[:]  # of the densest node of the subtree
        for i in range(n - 1, 0, -1):
            peak[parent[i]] = max(peak[parent[i]], peak[i])
        return out, chars, link_chars, density, peak, path, threshold

    def _run(self, path: list[int], out: list[bool], chars: list[int], link_chars: list[int]) -> list[int]:
        """The blocks of text that stand side by side with the one that is, or holds, the chosen node."""
        tag, parent = self.tag, self.parent
        member = next((i for i in path if tag[i] in BLOCKS), path[-1])
        if tag[member] not in RUN:
            return []
        beside = [i for i in range(parent[member] + 1, len(tag)) if parent[i] == parent[member] and tag[i] in BLOCKS]
        place = beside.index(member)
        run = []
        for way in (reversed(beside[:place]), beside[place:]):
            for i in way:
                if tag[i] not in RUN and not out[i]:
                    break
                if not out[i] and (tag[i] in HEADINGS or chars[i] > 2 * link_chars[i]):
                    run.append(i)
        return run

    def main_text(self) -> str:
        tag, parent = self.tag, self.parent
        n = len(tag)
        # Noise by name does not hold for what contains the article itself; a header inside an article is its own.
        holds = [False] * n
        for i in range(n - 1, 0, -1):
            if self.landmark[i] and not self.by_name[i] or tag[i] == "h1" or holds[i]:
                holds[i] = holds[i] or self.landmark[i] or tag[i] == "h1"
                holds[parent[i]] = True
        region_of = self._densest(holds, frozenset())
        doubtful = [i for i in range(1, n) if self.doubtful[i] and not holds[i] and tag[i] not in ("body", "html")]
        if doubtful:
            # With all of them in: what holds the chosen node or most of it stays, and so does a dense part with few links.
            _, chars, link_chars, _, peak, path, threshold = region_of
            ways = set(path)
            below = [False] * n
            for i in range(1, n):
                below[i] = parent[i] == path[0] or below[parent[i]]
            held = {i for i in doubtful if i in ways or (below[i] and 2 * chars[i] > chars[path[0]])}
            dense = {i for i in doubtful if tag[i] != "form" and chars[i] > 2 * link_chars[i] and peak[i] >= threshold}
            region_of = self._densest(holds, frozenset(doubtful) - held - dense)
        out, chars, link_chars, density, peak, path, threshold = region_of
        best = path[0]
        region, ways = {best}, set(path[1:])
        for i in range(1, n):
            if out[i] or i in ways:
                continue
            beside = parent[i] in ways and (tag[i] in HEADINGS or (chars[i] and density[i] >= threshold))
            # Articles of their own may lie deeper than beside the path, and their headings lower the density.
            if beside or (self.landmark[i] and chars[i] > 2 * link_chars[i] and peak[i] >= threshold):
                region.add(i)
        region.update(self._run(path, out, chars, link_chars))
        taken = [False] * n
        for i in range(n):
            taken[i] = not out[i] and (i in region or (i > 0 and taken[parent[i]]))
        blocks: list[str] = []
        piece: list[str] = []
        for node, text in self.events:
            if text is None:
                if piece:
                    blocks.append("".join(piece))
                    piece = []
            elif taken[node]:
                piece.append(text)
        if piece:
            blocks.append("".join(piece))
        clean = (" ".join(unescape(b).split()) if "&" in b else " ".join(b.split()) for b in blocks)
        return "\n".join(b for b in clean if b)


def extract(html: str | None) -> str:
    """The main text of one page; empty for null or a page without text."""
    return Page(html).main_text() if html else ""


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` in the column ``out``: blocks in page order, one line each.

    A null or empty page has an empty text.  Every row and every other column stays; a column named ``out`` is replaced.
    """

    def run(column: pa.Array) -> pa.Array:
        chunks = [pa.array([extract(h) for h in part.column("text").to_pylist()], pa.string()) for part in parts(pa.record_batch([column], ["text"]))]
        return pa.concat_arrays(chunks) if chunks else pa.array([], pa.string())

    return pages.withColumn(out, F.arrow_udf(run, "string").asNondeterministic()(html))
