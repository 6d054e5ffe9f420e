"""The main text of web pages by two passes of rules over their blocks.

A page is cut into blocks at block-level tags. The first pass decides each block on its own: markup that names a purpose
other than main text (menus, adverts, comments) decides at once, then link density,
length and the density of stop words do. Short and middling blocks stay open; in the second pass they
take the label of the nearest decided blocks before and after them. Inside ``article`` or ``main`` that markup is a prior: a
block that density would rule out stays open, looks to decided blocks of the article alone, and is kept where there are none.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags by their role, words that name the purpose of an element, and frequent words of four languages.
DROPPED = frozenset("nav header footer aside form button select option datalist dialog menu label fieldset noscript iframe object embed canvas svg math template head audio video map".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
#: Start tags that end an open paragraph, and elements that one is not looked for beyond.
ENDS_P = HEADINGS | frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre search section summary table ul".split())
KEEPS_P = frozenset("button caption html object table td template th".split())
PURPOSES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr privacy notice notices alert "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead comment comments reply replies respond disqus discussion "
    "newsletter subscribe subscription signup login register share sharing social related recommended popup modal overlay widget toolbar pagination pager copyright search".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with his they at be this from have or by had not but what all were when we there can an your which their "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder "
    "le la les de des un une et est en que qui dans pour pas au sur se plus par je avec il elle ce sont ne ont du mais nous ou son aux cette ces "
    "el los las y del que con una su para por no se lo como más pero sus le ya este sí porque esta entre cuando muy sin sobre".split()
)
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.25
LINKS = 0.3

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<bare>/?)(?P<odd>[a-zA-Z][^\s/>]*)(?P<left>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<\Z", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PIECES = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    text: str
    linked: int  # code points of the text inside links
    heading: bool
    label: str  # "good", "bad", "near", "short"
    main: bool = False  # inside an article, and not dropped there


def _purpose(name: str, rest: str) -> bool:
    """Whether an element's own markup says that it is not main text."""
    if name in DROPPED:
        return True
    if not rest or name in ("html", "body", "article", "main"):
        return False
    for key, *values in ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id") and not PURPOSES.isdisjoint(PIECES.split(value)):
            return True
        if key == "role" and value.strip() in ROLES:
            return True
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
    return False


def blocks(page: str) -> Iterator[Block]:
    """The text blocks of a page in order, with the first pass's labels."""
    stack: list[tuple[str, bool, bool]] = []  # name, whether dropped, whether main text
    opened = Counter()  # names on the stack
    dropped = main = links = 0
    text: list[tuple[str, bool]] = []
    heading = False
    at = 0

    def ended() -> Iterator[Block]:
        nonlocal heading
        if text:
            whole = " ".join(html.unescape("".join(t for t, _ in text)).split())
            if whole:
                linked = len("".join(html.unescape("".join(t for t, a in text if a)).split()))
                yield Block(whole, linked, heading, _first_pass(whole, linked, dropped > 0, main > 0), main > 0 and not dropped)
            text.clear()
        heading = False

    def implied(name: str) -> int:
        """Height of the stack after the start tag ``name`` has ended what needs no end tag."""
        height = len(stack)
        if opened["p"] and name in ENDS_P:
            for k in range(height - 1, -1, -1):
                if stack[k][0] in KEEPS_P:
                    break
                if stack[k][0] == "p":
                    height = k
                    break
        if name in HEADINGS and height and stack[height - 1][0] in HEADINGS:
            height -= 1
        same = ("li",) if name == "li" else ("dt", "dd") if name in ("dt", "dd") else ()
        for k in range(height - 1, -1, -1) if any(opened[n] for n in same) else ():
            if stack[k][0] in same:
                return k
            if stack[k][0] not in INLINE and stack[k][0] not in ("address", "div", "p"):
                break
        return height

    size = len(page)
    while at < size:
        token = TOKEN.search(page, at)
        if token is None:
            text.append((page[at:], links > 0))
            break
        if token.start() > at:
            text.append((page[at : token.start()], links > 0))
        at = token.end()
        name = (token["name"] or token["odd"] or "").lower()
        if not name:
            continue
        if token["close"] or token["bare"]:
            if name not in INLINE:
                yield from ended()
            elif name == "a" and links:
                links -= 1
            if opened[name]:
                while stack:
                    n, d, m = stack.pop()
                    opened[n] -= 1
                    dropped, main = dropped - d, main - m
                    if n == name:
                        break
            continue
        rest = token["rest"] or token["left"] or ""
        if name == "br":
            text.append((" ", links > 0))
            continue
        if name not in INLINE:
            yield from ended()
            links = 0
            heading = name in HEADINGS
            for _ in range(len(stack) - implied(name)):
                n, d, m = stack.pop()
                opened[n] -= 1
                dropped, main = dropped - d, main - m
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID or rest.endswith("/"):
            continue
        if name == "a":
            links += 1
            continue
        drop = _purpose(name, rest)
        if name in INLINE and not drop:
            continue
        if name == "p" or name in HEADINGS:  # these end an open paragraph, and need no end themselves
            if not drop:
                continue
        stack.append((name, drop, name in MAIN))
        opened[name] += 1
        dropped, main = dropped + drop, main + (name in MAIN)
    yield from ended()


def _first_pass(text: str, linked: int, dropped: bool, main: bool) -> str:
    if dropped:
        return "bad"
    unlikely = "near" if main else "bad"
    dense = linked / max(1, len(text) - text.count(" "))
    if dense > LINKS or "©" in text:
        return unlikely
    if len(text) < LENGTH_LOW:
        return unlikely if linked else "short"
    found = [w.strip(".,;:!?\"'()[]«»“”#*$%&|").lower() for w in text.split()]
    stop = sum(w in STOP_WORDS for w in found) / len(found)
    if stop >= STOP_HIGH:
        return "good" if len(text) > LENGTH_HIGH else "near"
    return "near" if stop >= STOP_LOW else unlikely


def _second_pass(found: list[Block], edge: str) -> list[bool]:
    """Whether each block is kept; ``edge`` is what stands before the first block and after the last."""
    n = len(found)
    before, after = [edge] * n, [edge] * n
    gap_before, gap_after = [n] * n, [n] * n
    for order, label, gap in ((range(n), before, gap_before), (range(n - 1, -1, -1), after, gap_after)):
        last, far = edge, n
        for i in order:
            label[i], gap[i] = last, far
            far += 1
            if found[i].label in ("good", "bad"):
                last, far = found[i].label, 1
    kept = []
    for i, b in enumerate(found):
        if b.label == "near":
            keep = "good" in (before[i], after[i])
        elif b.label == "short":
            if before[i] == after[i]:
                keep = before[i] == "good"
            elif b.heading:  # a heading belongs to what follows it
                keep = after[i] == "good"
            else:
                keep = (before[i] if gap_before[i] <= gap_after[i] else after[i]) == "good"
        else:
            keep = b.label == "good"
        kept.append(keep)
    return kept


def main_blocks(page: str) -> list[str]:
    """The texts of the blocks that the two passes keep."""
    found = list(blocks(page))
    if not any(b.label == "good" or b.main for b in found):
        # No block decides for main text on its own: middling ones are the best there is.
        for b in found:
            b.label = "good" if b.label == "near" else b.label
    inner = [b for b in found if b.main]
    of_article = iter(_second_pass(inner, "good"))
    for b in inner:
        b.label = "good" if next(of_article) else "bad"
    return [b.text for b, keep in zip(found, _second_pass(found, "bad"), strict=True) if keep]


def _extract(batches):
    for rows in batches:
        texts = ["\n".join(main_blocks(page or "")) for page in rows.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(row, text)``: each row of ``pages`` as a struct without its html, and the main text of the whole page.

    Character references are decoded, white space in a block becomes one space, and blocks are joined
    by a line feed in page order. A null or empty page, and one without main text, gives an
    empty text. Unclosed tags, comments and references at a page's end are taken as cut off. Rows are treated one by one, so
    repeated ones get equal texts, and other columns may have any name and be null.
    """
    rest = [F.col(f"`{c}`") for c in pages.columns if c != html]
    bare = pages.select(F.struct(*(rest or [F.lit(None).alias("none")])).alias("row"), F.col(html).alias("html"))
    return bare.mapInArrow(_extract, f"row {bare.schema['row'].dataType.simpleString()}, text string")
