"""Main text of web pages by two passes of block rules.

The first pass judges each block on its own: by its length, the share of its words that are stop words, and the share
of its text inside links. Blocks that this leaves open, the short ones above all, then take the label of the nearest
decided neighbours. What the markup says is a prior to this: elements and names that stand for menus, forms, adverts,
comments and so on make a region bad, unless the page has its text in there; where a page marks an article, and has
its text in it, blocks outside of it are bad, and blocks inside look for neighbours inside.
"""

from __future__ import annotations

import html as entities
import re
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemark.llm.common import without

SHORT, LONG = 60, 160  # characters
STOP_LOW, STOP_HIGH = 0.12, 0.2
MAX_LINKS = 0.5
KNOWN = 0.08  # share of stop words from which on they are those of the page's language
ARTICLE = 0.25  # share of a page's text from which on an article counts
MENU = 3  # blocks of links in a row, before any text of an article

# fixed values: elements of HTML, by what they mean here
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
DROPPED = frozenset("head button select option datalist svg canvas object audio video map".split())
REGIONS = frozenset("nav footer aside form fieldset label dialog menu menuitem".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul""".split())
SPACED = frozenset(("br", "td", "th", "img"))
# fixed values: parts of class, id and role names of regions that are no article
NOT_MAIN = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies
disqus footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted related
recommended replies reply search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget""".split())
# fixed values: other parts of such names, which say nothing; a name with any further part is not one inside an article
NEUTRAL = frozenset("""area bar block bottom box btn button buttons center col column container content desktop div fixed form foot footnote group head icon icons
inner item items layout left line links list main mobile mid middle module outer page panel post primary row secondary section site sticky text title top user
right wrap wrapper""".split())
# fixed values: what comments, notices and contents are called as one word with others; such a part tells inside an article too
COMPOUND = re.compile(r"""(?:user|users|reader|readers|site|page|post|blog|article)?(?:comments?(?:list|section|area|box|thread|form|feed|body|wrap|wrapper|container)?|disqus\w*
|repl(?:y|ies)(?:list|thread|box)?|responses?(?:list)?|discussions?(?:list|thread|area|board|section)?|notices?(?:bar|box)?|(?:cookie|gdpr)s?(?:law|bar|banner|notice|consent|info)?
|toc(?:list|box|container|inner|title)?|tableofcontents)""", re.X)
# fixed values: words that turn a name into one of a state
STATES = frozenset("with has no without open closed enabled disabled off".split())
# fixed values: frequent words of English, German, French, Spanish, Italian, Portuguese, Dutch, Polish, Russian
STOP = frozenset("""the of and to in a is that it for was on are as with be by this from at or an not have which but
der die und das den dem des ein eine einer einem ist im in von mit zu auf für sich nicht auch als an es war wie
de la le les des et un une en du est que qui dans pour par au aux sur pas plus avec ce il elle se sont ou
el los las y del se con para una por su al lo como más pero sus este no son
di che il per non della sono gli nel più anche dei
os um uma não mais com foi ao dos pela
het van een niet zijn voor aan dat ook
nie się na do jest przez dla jak
и в не на что он как это по но из за его был для так же от мы вы""".split())
SENTENCE = re.compile(r"[.!?…。！？।؟]")

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WORD = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"([a-z0-9])([A-Z])")


def region(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element stands for something other than main text, by its kind or its names."""
    if tag in REGIONS or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if HIDDEN.search(attributes):
        return True
    for names in NAMES.findall(attributes):
        for name in "".join(names).split():
            words = re.split(r"[-_:\d]+", CAMEL.sub(r"\1-\2", name).lower())
            parts = set(words) - {""}
            if STATES & parts:
                continue
            if tag != "article" and any(map(COMPOUND.fullmatch, parts | {"".join(words)})):
                return True
            telling = NOT_MAIN & parts or (not in_article and tag != "article" and "header" in parts)
            if telling and (not in_article or not parts - NOT_MAIN - NEUTRAL):
                return True
    return False


def blocks_of(page: str) -> list[tuple[str, float, bool, tuple]]:
    """(text, share of it in links, whether it is in an article, its regions from the outermost on) of every block with
    text, in page order."""
    found: list[tuple[str, float, bool, tuple]] = []
    stack: list[tuple[str, bool, bool, tuple]] = []  # element, dropped, in an article, regions
    text: list[str] = []
    linked = at = n_regions = 0
    links = 0
    raw_end = ""

    def close():
        nonlocal linked
        whole = " ".join("".join(text).split())
        if whole:
            found.append((whole, min(1.0, linked / len(whole)), inside(), stack[-1][3] if stack else ()))
        text.clear()
        linked = 0

    def inside():
        return bool(stack) and stack[-1][2]

    def add(piece: str):
        nonlocal linked
        if piece and not (stack and stack[-1][1]):
            piece = entities.unescape(piece)
            text.append(piece)
            if links:
                linked += len(" ".join(piece.split()))

    while m := TOKEN.search(page, at):
        if raw_end:
            end = re.compile(rf"</{re.escape(raw_end)}\s*[^>]*>", re.I).search(page, at)
            raw_end = ""
            at = end.end() if end else len(page)
            continue
        add(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCK:
                close()
            elif tag in SPACED:
                add(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    links -= sum(x[0] == "a" for x in stack[i:])
                    del stack[i:]
                    break
            continue
        if tag in BLOCK:
            close()
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[i][0] == "p":
                    links -= sum(x[0] == "a" for x in stack[i:])
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK:
                    break
        elif tag in SPACED:
            add(" ")
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            raw_end = "" if attributes.endswith("/") and tag not in ("script", "style") else tag
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        regions = stack[-1][3] if stack else ()
        if region(tag, attributes, inside()):
            n_regions += 1
            regions += (n_regions,)
        stack.append((tag, bool(stack) and stack[-1][1] or tag in DROPPED, inside() or tag in ("article", "main"), regions))
        links += tag == "a"
    if not raw_end:
        add(page[at:])
    close()
    return found


def first_pass(blocks: list[tuple[str, float, bool, tuple]]) -> list[str]:
    """good, bad, near (good if in doubt) or short, of each block by itself. Where the stop words are not the page's,
    the ends of sentences take their place."""
    words = [WORD.findall(b[0].lower()) for b in blocks]
    hits = [sum(w in STOP for w in ws) for ws in words]
    plain = [i for i, b in enumerate(blocks) if b[1] <= MAX_LINKS]
    known = sum(hits[i] for i in plain) >= KNOWN * sum(len(words[i]) for i in plain)
    out = []
    for (text, links, *_), ws, n in zip(blocks, words, hits, strict=True):
        stops = n / len(ws) if ws and known else 0.0
        if not known and SENTENCE.search(text):
            stops = STOP_HIGH
        if links > MAX_LINKS:
            out.append("bad")
        elif len(text) < SHORT:
            out.append("bad" if links else "short")
        elif stops >= STOP_HIGH:
            out.append("good" if len(text) >= LONG else "near")
        elif stops >= STOP_LOW:
            out.append("near")
        else:
            out.append("bad" if links else "short")
    return out


def label(blocks: list[tuple[str, float, bool, tuple]]) -> list[bool]:
    """Which blocks are main text."""
    first = first_pass(blocks)
    # what a region's markup says does not hold if the region has most of the text and nothing outside could be main text
    weight = [len(b[0]) * (1 - b[1]) for b in blocks]
    share: dict[int, float] = {}
    for b, w in zip(blocks, weight, strict=True):
        for r in b[3]:
            share[r] = share.get(r, 0.0) + w
    void: set[int] = set()
    off = [bool(b[3]) for b in blocks]
    for r in sorted(share):
        if 2 * share[r] > sum(weight) and not any(not o and (b[2] or f == "good") for b, f, o in zip(blocks, first, off, strict=True)):
            void.add(r)
            off = [bool(set(b[3]) - void) for b in blocks]
    # an article counts if a good part of what looks like text is in it
    text = [w if not o and f in ("good", "near", "short") else 0.0 for w, f, o in zip(weight, first, off, strict=True)]
    inside = [b[2] and not o for b, o in zip(blocks, off, strict=True)]
    article = any(inside) and sum(t for t, i in zip(text, inside, strict=True) if i) >= ARTICLE * sum(text)
    # links say little inside an article, a list of sources being text of it; but several in a row before any text are a menu
    text_from = next((i for i, f in enumerate(first) if inside[i] and f in ("good", "near")), len(blocks))
    for heavy, run in groupby(range(len(blocks)), key=lambda i: inside[i] and blocks[i][1] > MAX_LINKS):
        run = list(run)
        for i in run:
            if off[i] or article and not inside[i]:
                first[i] = "bad"
            elif article and first[i] == "bad" and not (heavy and len(run) >= MENU and i < text_from):
                first[i] = "short"
    places = [i for i in range(len(blocks)) if inside[i] or not article]
    return second_pass(first, places, article)


def second_pass(first: list[str], places: list[int], article: bool) -> list[bool]:
    """Open blocks among places take the label of the nearest decided ones there; in an article, blocks of links are no
    neighbours. Without any they are good. Of two different neighbours the nearer counts; near blocks and ties go with the good."""
    good = [was == "good" for was in first]
    decided = [first[i] == "good" or first[i] == "bad" and not article for i in places]
    befores, last = [], None
    for j in range(len(places)):
        befores.append(last)
        last = j if decided[j] else last
    last = None
    for j in range(len(places) - 1, -1, -1):
        i, before, after = places[j], befores[j], last
        last = j if decided[j] else last
        if first[i] in ("good", "bad"):
            continue
        sides = {first[places[x]] for x in (before, after) if x is not None}
        if len(sides) < 2:
            good[i] = "bad" not in sides
        elif first[i] == "near" or j - before == after - j:
            good[i] = True
        else:
            good[i] = first[places[before if j - before < after - j else after]] == "good"
    return good


def main_text(page: str | None) -> str:
    """The main blocks of a page in order, joined by two line ends; empty for null, empty and bare pages."""
    blocks = blocks_of(page or "")
    return "\n\n".join(b[0] for b, keep in zip(blocks, label(blocks), strict=True) if keep)


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """df with text, the main text of the whole html, and n_chars, its code points. Columns of these names in df give
    way. Null html is an empty page; an empty table gives an empty table; repeated rows are extracted alike."""
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return without(df, "text", "n_chars").withColumn("text", run(F.coalesce(F.col(html_col).cast("string"), F.lit("")))).withColumn(
        "n_chars", F.length("text").cast("long"))


def op6(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
