"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides each block by link
density, stop-word density, length and the elements it lies in; the second gives short or
undecided blocks the label of their nearest decided neighbours inside the same container.
"""

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

# Elements of HTML by their role.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template iframe textarea svg math object xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog head title select button label fieldset".split())
#: Words in class, id or role that mark a container as no part of the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar side footer header masthead cookie cookies consent notice notices alert gdpr popup modal "
    "overlay newsletter subscribe subscription signup login comment comments reply replies respond disqus discussion "
    "share sharing social related recommended recommendations widget toolbar pagination pager copyright legal "
    "contentinfo complementary search form".split()
)
#: A name of two parts is a mark by its second if the first says where it lies.
AREAS = frozenset("site page main global primary secondary top bottom mobile post article entry".split())
#: Second parts that tell how a page is laid out or what state it is in, not what an element holds.
STATES = frozenset(
    "open opened closed active inactive visible hidden shown on off enabled disabled free none less fixed sticky "
    "collapsed expanded accepted left right layout content main page".split()
)
#: Common function words of the languages that are told apart.
STOP = frozenset(
    (
        "the of and to in is that it for was on as with be by at this from are or an have not but they his her which a "
        "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei "
        "le la les de des du et un une en que qui est dans pour par sur au ce il pas plus avec se ne son "
        "el los las y del se una por con para su al lo como más pero sus o este esta "
        "os as dos das do da na no em um uma não mais foi são ao pela pelo seu sua também "
        "il gli di che per non della dei nel alla sono anche dal ma ha è "
        "het een van voor niet zijn op aan met ook maar bij naar wordt "
        "och att det som på för av är inte till har med om jag af til ikke "
        "i w z na się nie do jest że to od jak przez dla oraz po ale "
        "и в не на что с по как это из у за от для он но к а то его "
        "a je v se že na ve pro jsou ale bir ve bu da için ile çok olarak daha"
    ).split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
PART = re.compile(r"[-_]+")
SPACE = re.compile(r"\s+")

#: Rules of the first pass.
LINKED = 0.33
LONG = 70
STOPPED = 0.2
UNTOLD = 0.25
#: Characters of scripts that say a word in one or two of them; they count twice.
DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")

GOOD, BAD, OPEN = 1, -1, 0


class Block:
    """One block: its text and what the rules look at."""

    __slots__ = ("text", "linked", "outside", "inside", "label")

    def __init__(self, text, linked, outside, inside):
        self.text, self.linked, self.outside, self.inside, self.label = text, linked, outside, inside, OPEN


def _mark(name):
    """The mark that a class, id or role name stands for, if any: as a whole, by its first part or after an area."""
    if name in MARKS:
        return name
    first, *rest = PART.split(name)
    if first in MARKS and rest and not STATES.intersection(rest):
        return first
    return rest[0] if first in AREAS and len(rest) == 1 and rest[0] in MARKS else None


def _marked(attributes, in_article, main):
    """Whether the attributes of an element make it no part of the article; names never remove main or article."""
    for match in ATTRIBUTE.finditer(attributes):
        name, value = match[1].lower(), (match[2] or match[3] or match[4] or "").lower()
        if name == "hidden" and value != "false" or name == "aria-hidden" and value.strip() == "true" or name == "style" and UNSHOWN.search(value):
            return True
        if name in ("class", "id", "role") and not main:
            marks = {m for m in map(_mark, value.split()) if m}
            if marks and not (in_article and marks == {"header"}):
                return True
    return False


def blocks(page):
    """The blocks of a page in order."""
    found, parts, linked = [], [], 0
    stack, outside, links, articles, number = [], 0, 0, 0, 0
    # Open elements by name: the stack is searched only for what stands in it.
    opened = Counter()
    at, size = 0, len(page)

    def flush():
        nonlocal parts, linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                found.append(Block(text, linked, outside > 0, number if articles else 0))
        parts, linked = [], 0

    def close(entry):
        nonlocal outside, links, articles
        opened[entry[0]] -= 1
        outside -= entry[1]
        links -= entry[0] == "a"
        articles -= entry[2]

    while at < size:
        match = TOKEN.search(page, at)
        stop = match.start() if match else size
        if stop > at:
            parts.append(page[at:stop])
            if links:
                linked += stop - at
        if match is None:
            break
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if match[1]:
            if name in BLOCK or name == "p":
                flush()
            while opened[name]:
                last = stack.pop()
                close(last)
                if last[0] == name:
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
            if opened[name] and name in ("p", "li", "dd", "dt", "option", "tr", "td", "th"):
                # These end an open element of their own kind.
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        for entry in stack[i:]:
                            close(entry)
                        del stack[i:]
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "td"):
                        break
        if name in VOID or match[3].endswith("/"):
            continue
        main = name in ("article", "main") and not outside
        # A header inside an article is the article's own.
        foreign = (name in OUTSIDE and not (name == "header" and articles)) or (name != "body" and name != "html" and _marked(match[3], articles > 0, name in ("article", "main")))
        if main and not articles:
            number += 1
        stack.append((name, int(foreign), int(main and not foreign)))
        opened[name] += 1
        outside += foreign
        links += name == "a"
        articles += main and not foreign
    flush()
    return found


def nearest_decided(found, decided, backward):
    """For every block the place of the last decided one of its article met before it, or None; one pass."""
    out, last = [None] * len(found), {}
    for i in range(len(found) - 1, -1, -1) if backward else range(len(found)):
        b = found[i]
        out[i] = last.get(b.inside)
        if decided[i] != OPEN and not b.outside:
            last[b.inside] = i
    return out


def classify(found):
    """Set the labels of the blocks of one page, in two passes.

    Stop words are those of some languages. On a page where no block inside an article and few of the
    others (under UNTOLD of their text) reach them, long blocks of few links are good by length alone.
    """
    untold, told = [], 0
    for b in found:
        words = b.text.lower().split()
        density = sum(w.strip(".,;:!?\"'()") in STOP for w in words) / len(words)
        size = len(b.text) + len(DENSE.findall(b.text))
        # A mark of rights tells of a footer only in a short block.
        if b.outside or b.linked > LINKED * len(b.text) or ("©" in b.text and not b.inside and size < LONG):
            b.label = BAD
        elif size >= LONG and (b.inside or density >= STOPPED):
            b.label = GOOD
            told += size
        elif size >= LONG:
            untold.append((b, size))
    if told < UNTOLD * (told + sum(n for _, n in untold)) and not any(b.inside and b.label == GOOD for b in found):
        for b, _ in untold:
            b.label = GOOD
    decided = [b.label for b in found]
    before, after = nearest_decided(found, decided, False), nearest_decided(found, decided, True)
    for i, b in enumerate(found):
        if decided[i] != OPEN:
            continue
        near = [j for j in (before[i], after[i]) if j is not None]
        if not near:
            b.label = GOOD if b.inside else BAD
        elif b.inside:
            # Inside an article only two unwanted neighbours make a short block unwanted.
            b.label = BAD if len(near) == 2 and all(decided[j] == BAD for j in near) else GOOD
        else:
            b.label = decided[min(near, key=lambda j: (abs(j - i), j))]
    return found


def main_text(page):
    """The article of a page: its blocks joined by line ends; empty if there is none."""
    if not page:
        return ""
    return "\n".join(b.text for b in classify(blocks(page)) if b.label == GOOD)


def extract(rows, html="html", keep=("page_id", "url")):
    """``keep`` columns, ``text`` and ``n_chars`` (code points) of every page.

    Null and empty pages give an empty text; rows stay one to one, repeated ones too; an empty
    table gives no rows. The whole of every page is read.
    """
    picked = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(html).cast("string").alias("_html"))
    schema = picked.drop("_html").schema.add("text", "string").add("n_chars", "long")

    def work(batches):
        from rallyframe.llm.text import slices

        for whole in batches:
            for batch in slices(whole, len(keep)):
                texts = [main_text(p) for p in batch.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*keep, "text", "n_chars"],
                )

    return picked.mapInArrow(work, schema)
