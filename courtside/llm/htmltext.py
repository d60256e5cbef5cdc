"""The main text of web pages by two-pass block rules.

Markup cuts a page into blocks. The first pass decides blocks by where they stand (menus, forms, adverts and the like,
told by element, role or name), by the share of stop words, by length and by the share of their characters inside
links. What is too short to tell, or in an article but of no known language, stays open; in the second pass an open
block takes the label of its nearest decided neighbour. Blocks labelled good are the text.

- A page with an ``article`` (or, without one, a ``main``) outside of menus and the like: blocks beside it are bad, but
  for a first heading just before it; inside, neighbours are looked for inside only, a tie or no neighbour is good.
- Any other page: the element around most good text (without good text: most text outside links) stands for the
  article in the same way, but blocks beside it may be good if they are long; they look for neighbours on the whole
  page, whose edges count as bad, and a tie is bad unless the block stands in an element that is named as content.

Markup errors: what isn't closed ends with the element around it; end tags without a start are ignored; an unfinished
tag, comment, script or style runs to the end of the page. Character references are decoded once, those without a
semicolon too. White space is what ``str.split`` splits at, no-break spaces included.

Null or empty html, and pages without a good block, give an empty text and 0. Repeated rows, ids and null ids are pages
of their own; ties don't arise, as a page is judged by itself. Pages are handled one at a time, whole, in time
that grows with their length; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: fixed values: common words by language
STOP_WORDS = {
    "en": "a about after all also an and are as at be been but by can for from had has have he her his if in into is it its more no not of on one or our out she so than that the their them there they this to up was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist kann mit nach nicht noch nur oder sein sich sie sind so über um und unter von vor war was wenn werden wie wir wird zu zum zur",
    "fr": "à au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ont ou où par pas plus pour qu que qui sa se ses si son sont sur un une vous",
    "es": "a al como con de del desde el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero por que se ser si sin sobre son su sus también un una y ya",
}
#: fixed values: elements whose content is never text
DROPPED = "script style template noscript iframe svg math canvas object video audio select option textarea button head title datalist".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: fixed values: elements that begin and end blocks
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
#: fixed values: elements, roles and names that tell what isn't the article
AWAY = set("nav aside footer form menu dialog search fieldset legend".split())
AWAY_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist note".split())
AWAY_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot adunit sponsor sponsored promo promos promotion nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs masthead topbar toolbar banner "
    "footer foot sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices alert alerts warning popup modal overlay newsletter subscribe subscription signup signin login register share sharing social "
    "follow comment comments commentlist discussion respond reply replies disqus related recommended recommendations teaser teasers pagination pager copyright legal disclaimer paywall form search".split()
)
COMMENT_NAMES = set("comment comments commentlist discussion reply replies respond disqus related recommended teaser teasers sponsored promo ad advert advertisement".split())
HEADER_NAMES = set("header head masthead".split())
CONTENT_NAMES = set("article articlebody content post entry story main text maincontent postbody storybody entrycontent".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: fixed values: elements that hold a block of text or a list of them
LEAVES = HEADINGS | set("p ul ol li dl dt dd blockquote pre figure figcaption address table caption thead tbody tfoot tr td th html body".split())
#: fixed values: an element that ends an open one of the same kind
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = set("ul ol dl menu table tbody thead tfoot".split())

# thresholds: characters of a short and of a long block, shares of stop words and of linked characters
SHORT, LONG, FEW_STOPS, MANY_STOPS, MANY_LINKS = 70, 200, 0.15, 0.25, 0.4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(x for x in DROPPED if x not in ("head", "button", "select", "object")) + r")(?=[\s/>])[^>]*+(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[a-zA-Z/!?][^>]*+(?:>|\Z)""",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_WORD = re.compile(r"[^\W\d_]+")

GOOD, BAD, OPEN = "good", "bad", "open"


@dataclass
class Block:
    tag: str
    away: bool  # in a menu, form, advert ...
    article: int  # number of the article around it, or 0
    main: bool
    content: bool  # in an element named as content
    parent: int  # number of the element around paragraphs and lists; 0 for the page itself
    pieces: list[str] = field(default_factory=list)
    linked: int = 0  # characters in links
    text: str = ""
    label: str = OPEN


def _names(attrs: dict[str, str]) -> set[str]:
    """The words of class and id; what a name says it has or lacks (has-sidebar) isn't among them."""
    out: set[str] = set()
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in _NAME.findall(name)]
        if words and words[0] not in ("has", "with", "no", "without", "is"):
            out.update(words)
    return out


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(raw)} if raw and not raw.isspace() else {}


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in order, with where they stand; not labelled yet."""
    out: list[Block] = []
    # open elements: tag, away, article, main, content, parent of the blocks in it
    stack: list[tuple[str, bool, int, bool, bool, int]] = [("", False, 0, False, False, 0)]
    link, articles, parents, now = 0, 0, 0, None

    def close() -> None:
        nonlocal now
        if now is not None:
            text = " ".join(html.unescape("".join(now.pieces)).split())
            if text:
                now.text = text
                out.append(now)
            now = None

    def pop(to: int) -> None:
        nonlocal link
        del stack[to:]
        if link > len(stack):
            link = 0

    def put(text: str) -> None:
        nonlocal now
        _, away, article, main, content, parent = stack[-1]
        if now is None:
            inner = next((t[0] for t in reversed(stack) if t[0] in BLOCK), "")
            now = Block(inner, away, article, main, content, parent)
        elif away != now.away:  # an inline element that is away, such as a label among text
            close()
            return put(text)
        now.pieces.append(text)
        if link:
            now.linked += len(text.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if tag == "br":
            put(" ")
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        if m["end"]:
            if tag == "a":
                link = 0
            if tag in BLOCK:
                close()
            k = len(stack) - 1
            while k > 0 and stack[k][0] != tag:
                # an end tag inside a list item or cell doesn't end the list around it
                k -= 1
            if k > 0:
                pop(k)
            continue
        if tag == "a":
            link = len(stack)
        _, away, article, main, content, parent = stack[-1]
        attrs = _attributes(m["attrs"])
        if tag in BLOCK:
            close()
            if stack[-1][0] == "p" or stack[-1][0] in HEADINGS and tag in HEADINGS:
                pop(len(stack) - 1)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in SIBLINGS.get(tag, ()):
                    pop(k)
                elif stack[k][0] in LISTS or tag not in SIBLINGS:
                    break
            _, away, article, main, content, parent = stack[-1]
        names = _names(attrs) if "class" in attrs or "id" in attrs else set()
        role = attrs.get("role", "").lower()
        inside = article or main
        if tag in ("article", "main") or role == "main" or "articlebody" in attrs.get("itemprop", "").lower():
            mine = away and any(t[0] in ("form", "header") and t[1] for t in stack) and not any(t[1] and t[0] not in ("form", "header") and k and not stack[k - 1][1] for k, t in enumerate(stack))
            away = (away and not mine) or bool(names & COMMENT_NAMES)
            if tag == "main" or role == "main":
                main = True
            elif not article and not away:
                articles += 1
                article = articles
        elif tag not in ("html", "body"):
            hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").lower().replace(" ", "")
            away = away or tag in AWAY or tag in DROPPED or role in AWAY_ROLES or bool(names & AWAY_NAMES) or hidden or (not inside and (tag == "header" or bool(names & HEADER_NAMES)))
            content = content or bool(names & CONTENT_NAMES)
        if tag in BLOCK or tag in DROPPED or away != stack[-1][1]:
            if tag in BLOCK and tag not in LEAVES:
                parents += 1
                parent = parents
            stack.append((tag, away, article, main, content, parent))
    if at < len(page):
        put(page[at:])
    close()
    return out


def decide(block: Block, stops: frozenset[str], inside: bool) -> str:
    """The first pass for a block that isn't away."""
    n = len(block.text)
    share = block.linked / n
    words = _WORD.findall(block.text.lower())
    density = sum(w in stops for w in words) / max(len(words), 1)
    if share > MANY_LINKS and (not inside or block.tag in ("li", "td", "dd") and share > 0.8):
        return BAD
    if not inside and n < LONG and "©" in block.text:
        return BAD
    if n < SHORT or share > MANY_LINKS:
        return OPEN
    if density >= MANY_STOPS or density >= FEW_STOPS and (n >= LONG or inside):
        return GOOD
    return OPEN if inside or block.content or density >= FEW_STOPS else BAD


def most(page: list[Block]) -> int:
    """The parent of most good text, or, where no block is good, of most text outside links; 0 if that is short or the page itself."""
    mass: dict[int, int] = {}
    good = any(b.label == GOOD for b in page)
    for b in page:
        if b.label == GOOD or not good:
            mass[b.parent] = mass.get(b.parent, 0) + len(b.text) - b.linked
    return max(mass, key=lambda k: (mass[k], -k)) if mass and max(mass.values()) >= (1 if good else LONG) else 0


def label(page: list[Block], stops: frozenset[str]) -> None:
    """Both passes over a page's blocks."""
    open_to = [b for b in page if not b.away]
    for b in page:
        b.label = BAD if b.away else decide(b, stops, False)
    framed = True
    if any(b.article for b in open_to):
        home = lambda b: b.article and not b.away
    elif any(b.main for b in open_to):
        home = lambda b: b.main and not b.away
    else:
        own, framed = most(open_to), False
        home = lambda b: b.parent == own and own and not b.away
    for k, b in enumerate(page):
        if home(b):
            b.label = decide(b, stops, True)
        elif framed:
            b.label = OPEN if not b.away and b.tag == "h1" and not any(home(x) for x in page[:k]) else BAD
        elif own and b.label == GOOD and len(b.text) < LONG:
            b.label = OPEN
    # the nearest decided neighbour on either side: (distance, label), looking inside an article only if in one
    for frame in ([b for b in page if home(b)], page):
        inner = frame is not page
        first = [b.label for b in frame]
        left: list[tuple[float, str]] = []
        near = (float("inf"), OPEN) if inner else (0, BAD)
        for x in first:
            near = (near[0] + 1, near[1])
            left.append(near)
            if x != OPEN:
                near = (0, x)
        near = (float("inf"), OPEN) if inner else (0, BAD)
        for k in range(len(frame) - 1, -1, -1):
            near = (near[0] + 1, near[1])
            if first[k] == OPEN:
                (a, own), (b, other) = left[k], near
                side = own if a < b else other if b < a else own if own == other else OPEN
                frame[k].label = side if side != OPEN else GOOD if inner or frame[k].content else BAD
            else:
                near = (0, first[k])


def stop_set(languages: tuple[str, ...] | None = None) -> frozenset[str]:
    return frozenset(w for k, words in STOP_WORDS.items() if languages is None or k in languages for w in words.split())


def labelled(page: str | None, stops: frozenset[str]) -> list[Block]:
    found = blocks(page or "")
    label(found, stops)
    return found


def _mapped(pages: DataFrame, columns: tuple[str, ...], extra: list[StructField], make) -> DataFrame:
    """``columns`` of each page and what ``make`` gives for its html; large batches go on in slices."""
    own = [pages.schema[c] for c in columns]
    if clash := {f.name for f in extra} & set(columns):
        raise ValueError(f"rename the columns {sorted(clash)}: the result has its own")
    schema, last = StructType([*own, *extra]), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 256):
                b = big.slice(start, 256)
                made = [make(x) for x in b.column(last).to_pylist()]
                cols = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(last)), *cols], schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in extra]
    return pages.select(*columns, "html").mapInArrow(run, schema)


def extract_text(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url"), languages: tuple[str, ...] | None = None) -> DataFrame:
    """``columns``, text (good blocks joined by one space) and n_chars (its code points)."""
    stops = stop_set(languages)

    def make(page: str | None) -> tuple[str, int]:
        text = " ".join(b.text for b in labelled(page, stops) if b.label == GOOD)
        return text, len(text)

    return _mapped(pages, columns, [StructField("text", StringType()), StructField("n_chars", LongType())], make)


def extract_blocks(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url"), languages: tuple[str, ...] | None = None) -> DataFrame:
    """``columns`` and blocks: an array of (tag, label, linked, text) in page order, to see what was left out and why."""
    stops = stop_set(languages)
    one = StructType([StructField("tag", StringType()), StructField("label", StringType()), StructField("linked", LongType()), StructField("text", StringType())])

    def make(page: str | None) -> tuple[list[dict]]:
        return ([{"tag": b.tag, "label": b.label, "linked": b.linked, "text": b.text} for b in labelled(page, stops)],)

    return _mapped(pages, columns, [StructField("blocks", ArrayType(one))], make)
