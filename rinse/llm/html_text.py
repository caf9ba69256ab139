"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat text blocks at block-level tags.  A block is described
by its number of words and its link density, the same of the two blocks before
and after it, whether it is a heading or a legal line, the section its tags put
it in, and a hint from the names (class, id, role) around it.  A decision tree,
trained on the labelled table below, says which blocks are main text.  Most
labelled pages carry no telling names, and names inside an article are a hint
that words and links can overrule.  Every page is handled by itself inside a
task, in time linear in its length.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that hold no markup; their content, up to the next end tag of the name, is no text of the page.
HIDDEN = "script|style|title|noscript|iframe|textarea"
#: Elements with markup inside whose content is no text of the page; they end like all others.
DROPPED_TAGS = frozenset("template svg object select button canvas audio video annotation annotation-xml".split())
#: A start tag of these ends a dropped element that has no end tag of its own.
BLOCK_TAGS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
                       "hr main menu nav ol p pre section table ul".split())
#: Elements that stand inside a line; every other known element ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr img ruby rt rp nobr "
                   "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace "
                   "msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()) | DROPPED_TAGS
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What elements and words of class and id names say about a section.
MAIN_TAGS = frozenset(["article", "main"])
ASIDE_TAGS = frozenset(["nav", "footer", "aside", "form", "dialog", "menu", "fieldset"])
MAIN_WORDS = frozenset("article content main post entry story".split())
#: Names of adverts, notices and reader comments.
STRONG_WORDS = frozenset(
    "ad ads advert advertisement adverts adsense sponsor sponsored cookie cookies consent gdpr notice notices newsletter "
    "comment comments commentlist disqus replies".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies".split())
#: Names of parts around an article that may as well be part of its subject.
WEAK_WORDS = frozenset(
    "banner promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer foot header masthead topbar sidebar side rail widget widgets "
    "related recommended share sharing social alert popup modal overlay subscribe signup login search form reply respond feedback pagination pager "
    "tags toc copyright legal disclaimer toolbar skip".split())
#: An article has headers of its own.
HEADER_WORDS = frozenset("header head masthead".split())
#: Last words of names that say nothing; the word before them does.
TAILS = frozenset("area bar block body box container inner item left list outer right section slot text unit wrap wrapper".split())
#: A name that starts or ends so tells a state (has-sidebar, comments-open), not what the element is.
STATE_FIRST = frozenset("has no with without".split())
STATE_LAST = frozenset("open opened closed count enabled disabled".split())
#: Elements whose names say nothing about being an aside or comments.
WHOLE_TAGS = frozenset(["html", "body", "article", "main"])
#: Elements that hold one text; of their names only the strong ones count.
TEXT_TAGS = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{HIDDEN})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN_ATTR = re.compile(r"""\shidden(?=[\s=/>]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)

_LEGAL = re.compile(r"^\s*(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)

#: Sections by tags and content names; text in DROPPED is none of the page.
ASIDE, NEUTRAL, MAIN, DROPPED = -1, 0, 1, -9
#: Hints by names.
WEAK, STRONG, COMMENT = -1, -2, -3
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "words_before_2", "links_before_2",
            "words_after_2", "links_after_2", "heading", "legal", "name", "section")


class Zone(NamedTuple):
    section: int
    name: int


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    heading: int
    zone: Zone


def words_of(name: str) -> list[str]:
    """The words of one class, id or role name, in lower case."""
    return [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]


def head_of(words: list[str]) -> str:
    """What a compound name is about: its last word that is not in ``TAILS`` (the last if all are)."""
    return next((w for w in reversed(words) if w not in TAILS), words[-1])


def hint_of(tag: str, listed: list[list[str]], inside: bool) -> int:
    """What names say: inside an article only what they are about counts, outside every word does."""
    if tag in WHOLE_TAGS:
        return 0
    kinds = [ws for ws in listed if not (len(ws) > 1 and (ws[0] in STATE_FIRST or ws[-1] in STATE_LAST))]
    words = {head_of(ws) for ws in kinds} - HEADER_WORDS if inside else {w for ws in kinds for w in ws}
    if words & COMMENT_WORDS:
        return COMMENT
    if words & STRONG_WORDS:
        return STRONG
    return WEAK if words & WEAK_WORDS and tag not in TEXT_TAGS else 0


def zone_of(tag: str, attrs: str, around: Zone) -> Zone:
    """Zone inside an element.  Comments stay comments; articles lead out of all else, content names out of weak hints."""
    if around.section == DROPPED or tag in DROPPED_TAGS:
        return Zone(DROPPED, around.name)
    listed = [ws for m in _NAMES.finditer(attrs) for n in (m[1] or m[2] or m[3] or "").split() if (ws := words_of(n))]
    own = hint_of(tag, listed, around.section == MAIN)
    hint = min(around.name, own)
    if tag in ASIDE_TAGS or (tag == "header" and around.section != MAIN) or _HIDDEN_ATTR.search(attrs):
        return Zone(ASIDE, hint)
    if hint == COMMENT:
        return Zone(around.section, hint)
    if tag in MAIN_TAGS:
        return Zone(MAIN, 0)
    named = any(w in MAIN_WORDS for ws in listed for w in ws) and tag != "body" and tag not in TEXT_TAGS
    if named and own == 0 and around.name >= WEAK and around.section != ASIDE:
        return Zone(MAIN, 0)
    return Zone(around.section, hint)


def unended(tokens: list[re.Match]) -> frozenset[int]:
    """Places of the start tags of dropped elements that have no end tag before their parent's."""
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    out = set()
    for k, m in enumerate(tokens):
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if not m["close"]:
            if tag not in VOID and not m["attrs"].endswith("/"):
                stack.append((tag, k))
                opened[tag] += 1
        elif opened[tag]:
            last = None
            while last != tag:
                last, i = stack.pop()
                opened[last] -= 1
                if last != tag and last in DROPPED_TAGS:
                    out.add(i)
    out.update(i for t, i in stack if t in DROPPED_TAGS)
    return frozenset(out)


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page in order, character references decoded, white space single."""
    out: list[Block] = []
    stack: list[tuple[str, Zone]] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked: list[str] = []
    outside = Zone(NEUTRAL, 0)
    heading, zone = 0, outside

    def flush():
        words = " ".join(html.unescape("".join(text)).split())
        if words:
            n = len(words.split(" "))
            out.append(Block(words, n, min(n, len(html.unescape(" ".join(linked)).split())), heading, zone))
        text.clear()
        linked.clear()

    def add(s: str):
        nonlocal heading
        if not text:
            heading = int(any(t in HEADINGS for t, _ in stack[-3:]))
        text.append(s)
        if opened["a"]:
            linked.append(s)

    def cut(depth: int):
        while len(stack) > depth:
            opened[stack.pop()[0]] -= 1

    at = 0
    tokens = list(_TOKEN.finditer(page))
    loose = unended(tokens) if any((m["tag"] or "").lower() in DROPPED_TAGS for m in tokens) else frozenset()
    ends: list[int] = []  # depths of the open dropped elements without an end tag
    top = 0  # depth of the outermost open dropped element
    for k, m in enumerate(tokens):
        dropped = bool(stack) and stack[-1][1].section == DROPPED
        if m.start() > at and not dropped:
            add(page[at:m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if dropped and ends and not m["close"] and tag in BLOCK_TAGS and top >= ends[0]:
            cut(ends[0])
            ends.clear()
            dropped = False
        if tag not in INLINE and not dropped:
            flush()
        if m["close"]:
            if opened[tag]:
                place = len(stack) - 1
                while stack[place][0] != tag:
                    place -= 1
                if dropped and stack[place][1].section != DROPPED and tag not in INLINE:
                    flush()  # a parent's end tag ends what was dropped in it
                cut(place)
                while ends and ends[-1] >= len(stack):
                    ends.pop()
        elif tag not in VOID and not m["attrs"].endswith("/"):
            if k in loose:
                ends.append(len(stack))
            here = zone_of(tag, m["attrs"], stack[-1][1] if stack else outside)
            if here.section == DROPPED and not dropped:
                top = len(stack)
            stack.append((tag, here))
            opened[tag] += 1
        now = stack[-1][1] if stack else outside
        if now != zone and now.section != DROPPED:
            flush()
            zone = now
    if at < len(page) and not (stack and stack[-1][1].section == DROPPED):
        add(page[at:])
    flush()
    return out


def features(bs: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` per block; beyond the ends stand empty blocks.

    On a page with an article, what stands in no section is half an aside."""
    own = np.array([(b.words, b.linked / b.words) for b in bs], float).reshape(-1, 2)
    wide = np.vstack([np.zeros((2, 2)), own, np.zeros((2, 2))])
    n = len(bs)
    beside = -0.5 if any(b.zone.section == MAIN for b in bs) else 0.0
    rest = np.array([(b.heading, bool(_LEGAL.search(b.text)), max(b.zone.name, STRONG), b.zone.section or beside) for b in bs], float).reshape(-1, 4)
    return np.hstack([own, wide[1:n + 1], wide[3:n + 3], wide[:n], wide[4:n + 4], rest])


# ---- the labelled table: pages as lists of (markup of one block, is it main text) ----
_S = "The river had risen overnight and by the morning the lower road was under water, so the bus took the long way round."
_M = "Nobody in the village had seen anything like it for forty years."
LABELLED: list[list[tuple[str, int]]] = [
    [("<header><h1>Daily Herald</h1></header>", 0), ("<nav><a href=#>Home</a> <a href=#>Sport</a></nav>", 0),
     ("<article><h1>River floods the lower road</h1>", 1), (f"<p>{_S}</p>", 1), (f"<p>{_M}</p>", 1), ("<p>Yes.</p>", 1),
     (f"<p>{_S} {_S} {_S}</p></article>", 1), ("<aside><p>Read our other stories about water and roads in the region.</p></aside>", 0),
     ("<footer>&copy; Daily Herald. All rights reserved.</footer>", 0)],
    [("<div class=menu><a href=#>Start</a></div>", 0), ("<div class=content><h2>How to mend a fence</h2>", 1),
     (f"<p>{_S}</p>", 1), ("<ul><li>One hammer</li>", 1), ("<li>Two nails</li></ul>", 1), (f"<p>{_M}</p>", 1),
     ("<p>See <a href=#>this longer guide on posts and wire</a> for more.</p></div>", 1),
     (f"<div class=comments><p>{_S}</p>", 0), ("<p>Thanks!</p></div>", 0), ("<form>Your name</form>", 0)],
    [("<a href=#>Skip to text</a>", 0), ("<ul><li><a href=#>News</a></li>", 0), ("<li><a href=#>Weather</a></li>", 0),
     ("<li><a href=#>Travel and places</a></li></ul>", 0), (f"<p>{_S}</p>", 1), (f"<p>{_S} {_M}</p>", 1), (f"<p>{_M}</p>", 1),
     (f"<p>{_S} {_S}</p>", 1), ("<p><a href=#>Older posts</a> <a href=#>Newer posts</a></p>", 0), ("<p>Contact</p>", 0)],
    [("<div class=cookie-notice>We use cookies to make this site work. By going on you agree to this.</div>", 0),
     ("<main><h1>Minutes</h1>", 1), ("<p>Present: three.</p>", 1), ("<p><a href=#>Agenda</a></p>", 1), (f"<p>{_M}</p></main>", 1),
     (f"<div class=sidebar><p>{_S}</p></div>", 0), (f"<div class=ad>{_M}</div>", 0), ("<div class=ad>Buy now</div>", 0)],
    [("<div class=ad>Sale</div>", 0), (f"<article><p>{_M}</p></article>", 1), ("<footer>Imprint</footer>", 0)],
    [("<td><a href=#>Index</a></td>", 0), ("<td><a href=#>About us</a></td>", 0), ("<h2>On bread</h2>", 1), (f"<td>{_S} {_S}</td>", 1),
     (f"<td>{_M}</td>", 1), ("<td>Page 2</td>", 0), ("<td><a href=#>Top</a></td>", 0)],
    [("<div id=page class=no-sidebar><div class='container with-comments'><ul><li><a href=#>Home</a></li></ul>", 0),
     ("<article class='post comments-open'><h1>On wells</h1>", 1), (f"<p>{_S}</p>", 1), (f"<p>{_M}</p></article>", 1),
     (f"<div class=comments><p>{_M}</p></div></div></div>", 0)],
    [("<div class=sidebar-right><div class=menu><a href=#>Start</a></div>", 0), ("<div class=content><h2>On roofs</h2>", 1), (f"<p>{_S}</p>", 1),
     (f"<p>{_M}</p></div>", 1), (f"<div class=widget><p>{_S}</p></div></div>", 0)],
    [(f"<div class=has-sidebar><article><p>{_M}</p></article>", 1), (f"<div class=sidebar><p>{_S} {_M}</p>", 0), (f"<p>{_S} {_M}</p></div>", 0),
     (f"<div class=comments><p>{_S} {_S}</p>", 0), (f"<p>{_S} {_M}</p></div></div>", 0)],
    [("<nav><ul><li><a href=#>Alpha</a></li>", 0), ("<li>Beta</li></ul></nav>", 0), ("<article><p>Short.</p>", 1),
     ("<p><a href=#>A linked line</a></p>", 1), ("<pre>x = 1</pre></article>", 1), ("<div class=related><a href=#>More</a></div>", 0)],
]

#: Pages of the labelled table made by ``labelled_page``, and the seed of the first.
MADE_PAGES = 600
MADE_SEED = 1
STYLES = ("tags", "names", "tags", "names", "mixed", "bare", "bare", "bare", "bare", "bare")
#: Element with the name that a part has in the two styles that tell.
PARTS = {"top": ("header", "header"), "menu": ("nav", "menu"), "story": ("article", "content"), "side": ("aside", "sidebar"),
         "foot": ("footer", "footer"), "comments": ("section class=comments", "comments"), "ad": ("div class=ad", "advert"),
         "notice": ("div class=notice", "cookie-notice")}


def labelled_page(seed: int, style: str | None = None) -> list[tuple[str, int]]:
    """One page made by rule: menus, adverts, a story, side texts, comments and a footer of random lengths.

    ``style`` says how parts are marked: by tags, by names, by tags but for the
    story, or not at all ("bare"; such pages have no part that only a mark tells).
    """
    rng = random.Random(seed)
    style = style or STYLES[seed % len(STYLES)]
    rows: list[tuple[str, int]] = []

    def words(low: int, high: int) -> str:
        return " ".join("word" for _ in range(rng.randint(low, high)))

    def link(low: int, high: int) -> str:
        return f"<a href=#>{words(low, high)}</a>"

    def wrap(part: str, made: list[tuple[str, int]]):
        tag, name = PARTS[part]
        marked = {"tags": tag, "names": f"div class={name}", "mixed": "div" if part == "story" else tag, "bare": "div"}[style]
        if made:
            made[0] = (f"<{marked}>" + made[0][0], made[0][1])
            made[-1] = (made[-1][0] + f"</{marked.split()[0]}>", made[-1][1])
            rows.extend(made)

    def links(low: int, high: int) -> list[tuple[str, int]]:
        return [(f"<li>{link(1, 4)}</li>", 0) for _ in range(rng.randint(low, high))]

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.12:
            return words(1, 4)
        if kind < 0.3:
            return words(5, 14)
        return words(15, 90) + (f" {link(1, 4)} {words(4, 30)}" if rng.random() < 0.25 else "")

    def story() -> list[tuple[str, int]]:
        if style in ("tags", "names") and rng.random() < 0.6:  # a note of any length
            made = [(f"<h1>{words(1, 8)}</h1>", 1)] if rng.random() < 0.4 else []
            return made + [(f"<p>{link(2, 6) if rng.random() < 0.1 else words(1, 12)}</p>", 1) for _ in range(rng.randint(1, 4))]
        made = [(f"<h1>{words(3, 14)}</h1>", 1)]
        for i in range(rng.randint(2, 10)):
            kind = rng.random()
            if kind < 0.08 and i:
                made += [(f"<h2>{words(2, 6)}</h2>", 1), (f"<p>{words(15, 60)}</p>", 1)]
            elif kind < 0.16 and i:
                made += [(f"<li>{words(2, 14)}</li>", 1) for _ in range(rng.randint(2, 5))]
            elif kind < 0.2 and i:
                made += [(f"<p>{words(12, 40)}</p>", 1), (f"<p>{link(2, 6)}</p>", 1), (f"<p>{words(12, 40)}</p>", 1)]
            elif style != "bare" and kind < 0.26:
                made.append((f"<div class={rng.choice(['alert', 'legal', 'search', 'social'])}>{words(12, 80)}</div>", 1))
            elif style != "bare" and kind < 0.32:
                made.append((f"<div class=ad>{words(2, 30)}</div>", 0))
            elif style != "bare" and kind < 0.36:
                made.append((f"<div class={rng.choice(['share', 'tags', 'related'])}>{link(1, 3)} {link(1, 3)}</div>", 0))
            else:
                made.append((f"<p>{paragraph()}</p>", 1))
        made.append((f"<p>{words(15, 60) if style in ('bare', 'mixed') else paragraph()}</p>", 1))
        return made + (links(4, 8) if rng.random() < 0.2 else [])

    if style in ("tags", "names") and rng.random() < 0.5:  # a page with little beside its story
        if rng.random() < 0.5:
            wrap("menu", links(2, 6))
        wrap("story", story())
        if rng.random() < 0.4:
            part = rng.choice(["side", "comments", "foot", "notice", "ad"])
            wrap(part, [(f"<p>{words(1, 60)}</p>", 0) for _ in range(rng.randint(1, 2))])
        return rows
    if rng.random() < 0.5:
        if style == "bare" and rng.random() < 0.4:
            rows.append((f"<div>{words(1, 6)}</div>", 0))
        wrap("top", [(f"<h1>{words(1, 4)}</h1>" if rng.random() < 0.5 else f"<div>{link(1, 4)}</div>", 0)])
    if rng.random() < 0.7:
        wrap("menu", links(4, 10) if rng.random() < 0.8 else [(f"<div>{link(1, 2)} | {link(1, 2)} | {link(1, 2)} | {link(1, 2)}</div>", 0)])
    if style != "bare":
        if rng.random() < 0.6:
            wrap("ad", [(words(2, 40), 0)])
        if rng.random() < 0.4:
            wrap("notice", [(words(8, 50), 0)])
        if style == "tags" and rng.random() < 0.4:
            rows.append((f"<div>{words(3, 25)}</div>", 0))
    wrap("story", story())
    if style != "bare":
        if rng.random() < 0.5:
            wrap("comments", [(f"<p>{words(2, 60)}</p>", 0) for _ in range(rng.randint(1, 5))])
        if rng.random() < 0.5:
            wrap("side", [(f"<p>{words(3, 60)}</p>", 0) for _ in range(rng.randint(1, 4))] + links(0, 4))
    elif rng.random() < 0.5:
        wrap("side", links(4, 8))
    foot = [(f"<p>&copy; {words(1, 12)}</p>" if rng.random() < 0.6 else f"<p>{words(0, 3)} All rights reserved. {words(1, 12)}</p>", 0)]
    if style == "bare" and rng.random() < 0.4:
        foot = [(f"<p>{words(1, 6)}</p>", 0) for _ in range(rng.randint(1, 3))]
    if rng.random() < 0.6:
        wrap("foot", (links(2, 5) if rng.random() < 0.6 else []) + foot)
    return rows


MAX_DEPTH = 12
LEAF_ROWS = 3


SECTIONS = (-0.75, -0.25, 0.5)


def train(x: np.ndarray, y: np.ndarray):
    """The decision tree.  It asks for the section first (between ``SECTIONS``), so that no block of an article
    meets a bound learned on pages without marks; in each section words, links and hints decide by ``grow``."""
    tree = None
    section = FEATURES.index("section")
    for low, high in zip((None, *SECTIONS), (*SECTIONS, None)):
        inside = np.ones(len(y), bool)
        if low is not None:
            inside &= x[:, section] > low
        if high is not None:
            inside &= x[:, section] <= high
        part = grow(x[inside], y[inside]) if inside.any() else 0
        tree = part if low is None else (section, low, tree, part)
    return tree


def grow(x: np.ndarray, y: np.ndarray, depth: int = MAX_DEPTH):
    """A binary decision tree by the Gini impurity: a label, or (feature, bound, tree up to it, tree above it).

    Every leaf holds at least ``LEAF_ROWS`` rows of the table."""
    share, n = y.mean(), len(y)
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = None
    for f in range(x.shape[1] - 1, -1, -1):  # of equally good splits the last feature comes first
        order = np.argsort(x[:, f], kind="stable")
        v, hits = x[order, f], np.cumsum(y[order])
        low = np.arange(1, n)
        impurity = hits[:-1] * (1 - hits[:-1] / low) + (hits[-1] - hits[:-1]) * (1 - (hits[-1] - hits[:-1]) / (n - low))
        impurity[(v[1:] == v[:-1]) | (low < LEAF_ROWS) | (n - low < LEAF_ROWS)] = np.inf
        i = int(np.argmin(impurity)) if n > 1 else 0
        if n > 1 and (best is None or impurity[i] < best[0] - 1e-12):
            best = (impurity[i], f, float((v[i] + v[i + 1]) / 2))
    if best is None or best[0] >= n * share * (1 - share) - 1e-12:
        return int(share >= 0.5)
    _, f, bound = best
    is_low = x[:, f] <= bound
    return f, bound, grow(x[is_low], y[is_low], depth - 1), grow(x[~is_low], y[~is_low], depth - 1)


def labelled_table(pages: list[list[tuple[str, int]]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages: the written ones above and ``MADE_PAGES`` made by rule."""
    xs, ys = [], []
    for page in LABELLED + [labelled_page(MADE_SEED + i) for i in range(MADE_PAGES)] if pages is None else pages:
        x = features(blocks("".join(m for m, _ in page)))
        if len(x) != len(page):
            raise ValueError("a labelled page does not have one block per row")
        xs.append(x)
        ys += [y for _, y in page]
    return np.vstack(xs), np.array(ys, float)


def classify(tree, row) -> int:
    while isinstance(tree, tuple):
        f, bound, low, high = tree
        tree = low if row[f] <= bound else high
    return tree


def main_text(page: str | None, tree) -> tuple[str, int, int]:
    """Main text, number of blocks, number of main blocks."""
    bs = blocks(page or "")
    kept = [b.text for b, row in zip(bs, features(bs)) if classify(tree, row)]
    return " ".join(kept), len(bs), len(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_main`` for every input row.

    A NULL or empty page has an empty text.  NULL or repeated ids keep their
    rows; other columns are ignored; an empty table gives an empty result.  A
    very long page is read whole by one task, in time linear in its length.
    """
    tree = train(*labelled_table())

    def run(batches):
        for b in batches:
            out = [main_text(p, tree) for p in b.column("html").to_pylist()]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(cols[0], pa.string()), pa.array([len(t) for t in cols[0]], pa.int64()),
                 pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    p = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return p.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_main bigint")
