"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements. Each block of text passes points to the containers around it: for its length (up to
three hundred letters) and one for each comma, the whole to the nearest, half to the next and a third to an eighth to those above.
A container's points are discounted by its share of link text. The best container is the article, with what lies beside it and
beside the elements around it up to the body, unless links are a quarter of it or more and it has less than a fifth of the best points; a heading stays with the text below it. Where it lies in an <article>, that whole element is taken. Menus, page headers, footers,
sidebars, notices, adverts, forms, comments of readers and hidden elements are cut beforehand, by element, role and class
name (the last name of a class or id, so has-sidebar and comments-open name nothing); what holds the main element, the h1 or most of the text
stays whatever its name; a form around the page stays too. Lists that are mostly links go as menus, unless they stand below the article's text (its references and
further reading) and no heading calls them related pages and the like. A page header goes, but for its h1 where that begins the page's title and the page has no other h1. Links that skip to a part of the page go.

Rows are handled one by one, in Arrow batches, without any exchange.

Defined cases: a null or empty page, and one without text, gives an empty text; markup that is not closed or nested wrongly is read as browsers do in
the main (a new paragraph ends an open one, unknown end tags are ignored); a "<" that begins no tag is text; repeated rows get a row each; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Elements and names.
BLOCKS = frozenset(
    "html body main article section div header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption details summary address fieldset hr center dialog menu search hgroup frameset".split()
)
RAW = frozenset("script style noscript template textarea title iframe svg select button audio video head".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr param".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - frozenset("html body".split())
#: An element of the key ends an open element of its values, if no element of STOPS lies between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "thead": {"tr"}, "tfoot": {"tr", "td", "th", "tbody"}}
STOPS = frozenset("html body table ul ol dl td th article section div".split())
CUT_ELEMENTS = frozenset("nav footer aside dialog menu search".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
CUT_NAMES = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer foot masthead topbar toolbar ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending comment comments commentlist disqus respond replies reply pagination pager skip widget widgets form search copyright disclaimer paywall hidden".split()
)
#: Names that say what an element is wherever they stand in a class or id.
PLAIN_NAMES = frozenset("disqus livefyre onetrust cookiebot cookieconsent cookielaw trustarc usercentrics quantcast gdpr ccpa ads adbox adslot adunit adbanner adsense adsbygoogle adwords advert adverts advertisement advertisements advertising doubleclick taboola outbrain sponsored newsletter breadcrumb breadcrumbs".split())
COMMENT_NAMES = frozenset("comment comments commentlist commentary disqus livefyre respond reply replies feedback discussion discussions".split())
#: Links that skip to a part of the page, headings of lists of other pages, and headings of lists that belong to a text.
SKIP = re.compile(r"(?:skip|jump|go) (?:to|past) (?:the )?(?:main |page |site )?(?:content|text|article|navigation|nav|menu|search|footer|header)\b|zum (?:haupt)?inhalt\b|aller au (?:contenu|menu)\b|(?:saltar|ir) al contenido\b", re.I)
OTHERS = re.compile(r"(?:related|read (?:more|next|also)|more (?:from|on|in|about|stories|articles|news)|you (?:may|might)|recommended|most (?:read|popular)|popular|trending|share|follow|latest|tags?\b|topics\b|categor|up next|verwandte|weiterlesen|mehr (?:zum|aus|von)|lesen sie|lire aussi|à lire|articles liés|sur le même|relacionad|también|más (?:sobre|noticias|leíd)|te puede)", re.I)
SOURCES = re.compile(r"(?:references?|further reading|external links|see also|sources?|bibliography|notes|footnotes|citations|works cited|literatur|quellen|weblinks|einzelnachweise|siehe auch|références|bibliographie|liens externes|voir aussi|referencias|bibliografía|enlaces externos|véase también)\b", re.I)
OWN_HEADER = frozenset("article entry post story content".split())
#: Names of place and shape, passed over at the end of a class or id (sidebar-left, comment-list), and beginnings that make it say something of the page.
SHAPES = frozenset("left right top bottom inner outer container wrapper wrap box list area block section bar item items link links body group main primary secondary col column row panel holder slot unit text title content div".split())
STATES = frozenset("has have no not non with without is are hide show js can".split())


#: Elements that can be the container; a table's cell is one if it holds paragraphs.
CONTAINERS = frozenset("body div section article main center details dialog".split())
REACH = 8
#: Text beside the article stays with a smaller share of link text.
MOST_LINKED = 0.25
#: Letters from which on a block is text, below which an article may list its references.
PROSE = 80
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)


class _Node:
    __slots__ = ("tag", "parent", "cut", "named", "inside", "points", "chars", "linked", "items", "links", "given", "plain", "holds")

    def __init__(self, tag: str, parent: "_Node | None", cut: bool):
        self.tag, self.parent, self.cut = tag, parent, cut
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.points, self.chars, self.linked, self.links = 0.0, 0, 0, 0
        self.items: list = []  # in page order: child nodes, and texts as strings
        self.named: frozenset | set = frozenset()  # names by which it would be cut
        self.given: list[float] = []
        self.plain, self.holds = 0, 0  # letters of texts that are not mostly links; 1 for an h1 in it, 2 for a main


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(raw)}


def _names(value: str) -> set[str]:
    """What the classes or ids of value call their element: the last name of each that is none of a shape, and any plain one, unless it begins with a state."""
    out = set()
    for token in value.split():
        parts = [p.lower() for p in _PART.findall(token)]
        if len(parts) > 1 and parts[0] in STATES:
            continue
        out.update(PLAIN_NAMES.intersection([*parts, token.lower()]))
        while len(parts) > 1 and (parts[-1] in SHAPES or parts[-1].isdigit()):
            parts.pop()
        out.update(parts[-1:])
    return out


def _cut(tag: str, raw: str, inside: bool) -> bool | set[str]:
    """Whether an element goes with all that is in it, or the names by which it would. inside: it lies in an article."""
    if tag in CUT_ELEMENTS:
        return True
    if tag == "form":  # unless the page lies in it
        return {"form"}
    if not raw or raw.isspace():
        return {"header"} if tag == "header" and not inside else False
    at = _attributes(raw)
    value = at.get("class", "") + " " + at.get("id", "")
    names = _names(value)
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", "")):
        return True
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return names & COMMENT_NAMES
    if at.get("role", "").lower() in CUT_ROLES:
        return True
    if tag == "header" or names & {"header", "head"} and tag not in HEADINGS:
        own = inside or {p.lower() for p in _PART.findall(value)} & OWN_HEADER
        return False if own else {"header"} if tag == "header" else names & {"header", "head"}
    return set() if tag in HEADINGS and inside else names & (CUT_NAMES | PLAIN_NAMES | COMMENT_NAMES)


def _judge(nodes: list[_Node]) -> tuple[list[_Node], str]:
    """Nodes without the elements that go by their names, and what is in them; and the h1 of a page header, if no other stays.

    One stays if it holds a main, the page's articles, its h1 (but for headers), or, with no article or main beside it, more than half of
    the text outside links; comments of readers need to hold all of it.
    """
    root, within, over = nodes[0], Counter(), Counter()  # articles and mains with text in an element, and around it
    for n in reversed(nodes[1:]):
        n.holds |= {"h1": 1, "main": 2}.get(n.tag, 0)
        if n.tag != "article" or not n.named:
            n.parent.holds |= n.holds
        n.parent.plain += n.plain
        within[id(n.parent)] += within[id(n)] + (n.tag in ("article", "main") and not n.named and n.plain > 0)
    for n in nodes[1:]:
        over[id(n)] = over[id(n.parent)] + (n.parent.tag in ("article", "main") and not n.parent.named and n.parent.plain > 0)
    out, gone = [root], set()
    for n in nodes[1:]:
        if not n.parent.cut and n.named:
            beside = within[id(root)] - within[id(n)] - over[id(n)] > 0
            bulk = n.plain >= root.plain > 0 if n.named & COMMENT_NAMES else n.plain > 0.5 * root.plain
            keep = n.holds & 2 or n.holds & 1 and not n.named <= {"header", "head"} or n.tag != "header" and not beside and (bulk or within[id(n)] and not over[id(n)])
            if not keep:
                n.cut = True
                gone.add(n.parent)
        n.cut = n.cut or n.parent.cut
        if not n.cut:
            out.append(n)
    title = "" if any(n.tag == "h1" for n in out) else next((t for n in nodes if n.tag == "h1" and n.cut and _heads(n) and (t := " ".join(x for x in n.items if isinstance(x, str)))), "")
    for n in gone:
        n.items = [x for x in n.items if isinstance(x, str) or not x.cut]
    return out, title


def _heads(n: _Node) -> bool:
    """Whether what cuts n is a page header."""
    while n.parent.cut:
        n = n.parent
    return n.tag == "header"


def _tree(page: str) -> tuple[_Node, list[_Node], str]:
    """The root, all elements that are not cut, parents first, and the h1 of a page header."""
    root = _Node("", None, False)
    node, held, linked, in_link, links = root, [], 0, False, 0
    nodes, is_open, unclosed = [root], Counter(), set()

    def flush() -> None:
        nonlocal held, linked, links
        if held:
            text = " ".join("".join(held).split())
            if text and not node.cut and not (linked >= len(text) and SKIP.match(text)):
                node.items.append(text)
                node.chars += len(text)
                node.linked += min(linked, len(text))
                node.links += links
                node.given.append(min(len(text) / 25, 1.0) + min(len(text) / 100, 3.0) + text.count(","))
                node.plain += len(text) if min(linked, len(text)) < 0.5 * len(text) else 0
            held, linked, links = [], 0, 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = entities.unescape(text) if "&" in text else text
            held.append(text)
            if in_link:
                linked += len(text.strip())

    def leave(to: _Node) -> _Node:
        """Ends elements from the current one up to, but not including, to."""
        up = node
        while up is not to:
            is_open[up.tag] -= 1
            up = up.parent
        return to

    at, end = 0, page.rfind(">") + 1
    while at < end:
        m = _TAG.search(page, at, end)
        if m is None:
            break
        add(page[at : m.start()])
        at = m.end()
        slash, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<![CDATA["):
                held.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag in RAW:
            if not slash and not raw.endswith("/"):
                close = None if tag in unclosed else re.compile(r"</head\s*>|(?=<body[\s>])" if tag == "head" else rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if close:
                    at = close.end()
                else:  # scripts and the like hide the rest, as in browsers; others are passed over
                    unclosed.add(tag)
                    at = len(page) if tag in ("script", "style", "textarea", "noscript", "iframe", "template") else at
        elif tag == "br":
            held.append(" ")
        elif tag == "a":
            in_link = not slash
            links += in_link
        elif tag in BLOCKS and slash:
            flush()
            in_link = False
            if is_open[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = leave(up.parent)
        elif tag in BLOCKS:
            flush()
            in_link = False
            if tag in CLOSES_P and node.tag == "p" or tag in HEADINGS and node.tag in HEADINGS:
                node = leave(node.parent)
            if tag in ENDS:
                up = node
                while up.tag and up.tag not in ENDS[tag] and up.tag not in STOPS:
                    up = up.parent
                while up.tag in ENDS[tag]:
                    node = leave(up.parent)
                    up = node
            if tag not in VOID:
                new = _Node(tag, node, False)
                cut = node.cut or _cut(tag, raw, new.inside)
                new.cut, new.named = cut is True, frozenset() if isinstance(cut, bool) else cut
                if not new.cut:
                    node.items.append(new)
                    nodes.append(new)
                is_open[tag] += 1
                node = new
    rest = page[at:]
    begun = re.search(r"<(?=[a-zA-Z/!?])", rest) if rest else None
    add(rest[: begun.start()] if begun else rest)
    flush()
    nodes, title = _judge(nodes)
    for n in nodes:
        for points in n.given:
            up, share = n, 1
            while up is not None and share <= REACH:
                if up.tag in CONTAINERS or up.tag == "td" and up is not n:
                    up.points += points / share
                    share += 1
                up = up.parent
    for n in reversed(nodes[1:]):
        n.parent.chars += n.chars
        n.parent.linked += n.linked
        n.parent.links += n.links
    return root, nodes, title


def _density(n: _Node) -> float:
    return n.linked / n.chars if n.chars else 0.0


def _texts(n: _Node, out: list[str]) -> None:
    """The texts of n in page order, without menus: lists that are mostly links, but for those of an article below its text, or below a heading of sources."""
    todo: list = [(n, "")]
    heading, prose = "", any(len(x) >= PROSE for x in out)
    while todo:
        x, tag = todo.pop()
        if isinstance(x, str):
            out.append(x)
            heading, prose = x if tag in HEADINGS else "", prose or len(x) >= PROSE and tag not in HEADINGS
        elif x is not n and x.tag in ("ul", "ol", "div", "section", "table", "dl") and x.links > 1 and _density(x) > 0.6:
            if not OTHERS.match(heading) and (x.inside and prose or SOURCES.match(heading)):
                _whole(x, out)
            elif heading and OTHERS.match(heading):
                out.pop()
            heading = ""
        else:
            todo.extend((y, x.tag) for y in reversed(x.items))


def _whole(n: _Node, out: list[str]) -> None:
    todo: list = [n]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo.extend(reversed(x.items))


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root, nodes, heading = _tree(page)
    text = _article(root, nodes)
    if heading and not text.startswith(heading):
        title = _TITLE.search(page)
        if " ".join(entities.unescape(title[1]).split()).casefold().startswith(heading.casefold()) if title else not any(n.tag in HEADINGS for n in nodes):
            text = f"{heading} {text}".strip()
    return text


def _article(root: _Node, nodes: list[_Node]) -> str:
    best, most = None, 0.0
    for n in nodes:
        value = n.points * (1 - _density(n))
        if value > most:
            best, most = n, value
    if best is None:
        best = root
    up, chosen = best, best
    while up is not None:
        if up.tag == "article":
            chosen = up
        up = up.parent
    out: list[str] = []
    if chosen.parent is None or chosen.tag in ("body", "html"):
        _texts(chosen, out)
        return " ".join(out)
    def kept(x: _Node) -> bool:
        return x.points * (1 - _density(x)) >= max(5.0, 0.2 * most) or chosen.tag != "article" and _density(x) < MOST_LINKED

    # From the container up to the body: what lies beside each step.
    before, after, step = [], [], chosen
    while step.parent is not None and step.tag not in ("body", "html"):
        side, held = before, []
        own: dict[bool, list[str]] = {True: [], False: []}
        for x in step.parent.items:
            if x is step:
                side = after
            elif isinstance(x, str):
                if chosen.tag != "article":
                    own[side is before] += [*held, x]
                    held = []
            elif side is after and x.tag in HEADINGS and chosen.tag != "article":
                _texts(x, held)  # goes with the text below it
            elif kept(x):
                own[side is before] += held
                held = []
                _texts(x, own[side is before])
        before.append(own[True])
        after.append(own[False])
        if chosen.tag == "article":
            break
        step = step.parent
    for part in reversed(before):
        out += part
    _texts(chosen, out)
    for part in after:
        out += part
    return " ".join(out)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars, a row for each row of pages (page_id, url, html)."""

    def texts(frames):
        for frame in frames:
            found = [extract(h) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": found, "n_chars": [len(t) for t in found]})

    # Ids pass Python as strings: pandas would turn a column with nulls into floats.
    out = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(texts, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
