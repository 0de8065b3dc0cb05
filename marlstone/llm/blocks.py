"""Main text of HTML pages by block rules in two passes.

The page is read tag by tag (tags may be unclosed or cut off). Text between block-level tags is a block; blocks inside
elements that never hold the article, by tag, role or by words of their class or id, are dropped: menus, page headers
and footers, sidebars, notices, adverts, forms, scripts, styles, reader comments. The first pass judges each
remaining block by length, link density and stop-word density: good, bad, near-good or short. The second pass gives
near-good and then short blocks the label of their nearest decided neighbours.

Both passes judge every block of every page. Where a page marks its article (article, main), that is evidence: inside, a block
is judged one step better and the mark's border counts as a good neighbour; outside, one step worse and the border as a bad one.
``hints=False`` leaves it out. Languages whose stop-words aren't known have near-good blocks at best, which are kept
where no decided neighbours speak against them; where a page decides nothing at all, all its blocks are kept.

A null or empty page has an empty text. Pages are read one by one, in time linear in their length, however long or broken;
repeated rows and null ids are kept. An empty table gives an empty result. Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlstone.llm.session import prepare, table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|aria-hidden|hidden|style|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object select option".split())
DROP = frozenset("nav footer aside form head script style noscript template iframe svg math canvas object button select textarea dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: words of a class or id that say what a container is for
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|crumbs?|header|masthead|topbar|footer|foot|bottom|side\w*|rail|widget\w*|cookies?|consent|gdpr|notice|notices|notification\w*|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social\w*|related\w*|recommend\w*|trending|popular|comments?|commentlist|disqus|replies|reply|respond|pagination|pager|toolbar|tags?|copyright|legal|disclaimer|search\w*|form|skip\w*|hidden|toc)(?=$|[\s_-])", re.I)
#: of these, words that only say where a container lies; an article inside it, or a word of _GOOD beside it, counts for more
_PLACE = re.compile(r"header|masthead|banner|side\w*|rail|bottom|topbar|overlay|modal|hidden")
_GOOD = re.compile(r"article\w*|post|entry\w*|story\w*|content|main\w*|text|page|layout|site")
#: what a container has, or has not, isn't what it is
_NOT_ITSELF = re.compile(r"(?:^|(?<=[\s_-]))(?:no|has|with|without|not|is)[_-]\w+")
_COMMENT = re.compile(r"(?:^|\s)(?:user-|reader-)?(?:comment|reply)(?:-(?!open|closed)\w+)*(?=$|\s)", re.I)
STOP = frozenset(
    "the of and to in a is that it for on with as was be by are at from this not or have an but they which you were her all she there would their we him been has when who will more no if out so said what up its about than into them can only other new some could time these two may then do first any my now such like our over me even most made after also did many before must through back years where much your way well down should because each just those people how too "
    "der die das und ist nicht ein eine zu den mit von für auf sich dem des im auch als an es so dass wie aus bei nach um am sind noch wird einen einer hat oder aber war vor zum zur nur "
    "le la les de des du un une et est que qui dans en pour sur pas au avec ce se par plus ne il elle sont aux mais ou on son sa ses cette nous vous "
    "el los las y que del se con por una su para es al lo como más pero sus o este sí porque esta entre cuando muy sin sobre ser".split()
)
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.10, 0.30
LINKS = 0.33
_SPACE = re.compile(r"\s+")


def _purpose(name: str, attrs: str) -> int:
    """-1: never the article; -2: neither, unless an article lies in it; 1: marks the article; 0: nothing is known."""
    if name in DROP:
        return -1
    good = int(name in ("article", "main"))
    if not attrs.strip():
        return good
    words = []
    for m in _ATTR.finditer(attrs):
        key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if key == "role":
            if value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar", "alertdialog"):
                return -1
            if value in ("main", "article"):
                good = 1
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return -1
        elif key == "itemprop":
            good = 1 if value == "articleBody" else good
        elif key in ("class", "id"):
            words.append(value)
    said = " ".join(words)
    if name in ("article", "main"):
        return -1 if _COMMENT.search(said) else good
    if name in ("html", "body"):
        return good
    said = _NOT_ITSELF.sub("", re.sub(r"([a-z])([A-Z])", r"\1-\2", said).lower())
    worst = 0
    for token in said.split():
        found = [m.group().strip("_-") for m in _BAD.finditer(token)]
        if not found:
            continue
        if not all(_PLACE.fullmatch(w) for w in found):
            return -1
        if not any(_GOOD.fullmatch(w) for w in re.split(r"[_-]", token)):
            worst = -2
    return worst or good


class Block:
    __slots__ = ("text", "linked", "heading", "label", "inside", "item")

    def __init__(self, text, linked, heading, inside, item):
        self.text, self.linked, self.heading, self.inside, self.item = text, linked, heading, inside, item
        self.label = ""


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, without those of dropped elements."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # name, purpose
    bad = soft = good = link = heading = item = 0
    suspended: list[int] = []  # what was soft outside each open article
    opened: Counter[str] = Counter()
    parts: list[tuple[str, bool]] = []
    at, n = 0, len(page)

    def add(s: str) -> None:
        if s and not bad and not soft:
            parts.append((s, link > 0))

    def close_block() -> None:
        if parts:
            whole = _SPACE.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()
            if whole:
                linked = len(_SPACE.sub(" ", html.unescape("".join(p for p, a in parts if a))).strip())
                out.append(Block(whole, linked, heading > 0, good > 0, item > 0))
            parts.clear()

    def pop(name: str) -> None:
        nonlocal bad, soft, good, link, heading, item
        gone, purpose = stack.pop()
        opened[gone] -= 1
        bad -= purpose == -1
        soft -= purpose == -2
        if gone in ("article", "main"):
            soft = suspended.pop()
        good -= purpose > 0
        link -= gone == "a"
        heading -= gone in ("h1", "h2", "h3", "h4", "h5", "h6")
        item -= gone == "li"

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        m = _TOKEN.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            add(page[at : lt + 1])
            at = lt + 1
            continue
        add(page[at:lt])
        at = m.end()
        if m.re is _TOKEN and m.group(2) is None:
            if m.group().startswith("<![CDATA["):
                add(html.escape(m.group()[9:].removesuffix("]]>")))
            continue
        name, attrs, closing = m.group(2).lower(), m.group(3), m.group(1)
        if name in BLOCK:
            close_block()
        if name == "br" and not closing:
            add(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    while len(stack) > k:
                        pop(name)
                    break
                # a closing tag doesn't reach over containers, unless it is one itself
                if stack[k][0] in ("article", "main", "body", "nav", "aside", "footer", "table", "section", "div", "form") and name not in BLOCK:
                    break
            continue
        if name in VOID:
            continue
        if name == "p" or name in ("h1", "h2", "h3", "h4", "h5", "h6"):  # these end an open paragraph and what is open in it
            for k in range(len(stack) - 1, -1, -1) if any(opened[x] for x in ("p", "h1", "h2", "h3", "h4", "h5", "h6")) else ():
                if stack[k][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    while len(stack) > k:
                        pop(name)
                    break
                if stack[k][0] in BLOCK:
                    break
        elif name in ("li", "dd", "dt", "td", "th", "tr", "option"):
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    while len(stack) > k:
                        pop(name)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "nav", "div", "article", "section", "menu", "body"):
                    break
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        purpose = _purpose(name, attrs)
        if name == "header" and purpose == 0:
            purpose = 0 if good else -1
        stack.append((name, purpose))
        opened[name] += 1
        bad += purpose == -1
        if name in ("article", "main"):
            suspended.append(soft)
            soft = 0
        soft += purpose == -2
        good += purpose > 0
        link += name == "a"
        heading += name in ("h1", "h2", "h3", "h4", "h5", "h6")
        item += name == "li"
    close_block()
    return out


#: labels of the first pass, worst first
STEPS = ("bad", "short", "near", "good")


def first_pass(b: Block, marked: bool) -> str:
    words = b.text.lower().split()
    stop = sum(w.strip(".,;:!?") in STOP for w in words) / max(1, len(words))
    density = b.linked / max(1, len(b.text))
    if density > LINKS:
        label = 0
    elif len(b.text) < LENGTH_LOW:
        label = 0 if b.linked else 1
    elif stop >= STOP_HIGH and len(b.text) > LENGTH_HIGH:
        label = 3
    elif stop >= STOP_LOW or len(b.text) > LENGTH_HIGH:  # a long block without known stop-words may be of another language
        label = 2
    else:
        label = 1
    if marked:
        label += 1 if b.inside else -1
    return STEPS[min(3, max(0, label))]


def neighbours(labels: list[str], before: str, after: str) -> list[tuple[str, str]]:
    """The nearest decided label on each side of each block, in two sweeps."""
    out: list[list[str]] = [["", ""] for _ in labels]
    for side, order, now in ((0, range(len(labels)), before), (1, range(len(labels) - 1, -1, -1), after)):
        for i in order:
            out[i][side] = now
            if labels[i] in ("good", "bad"):
                now = labels[i]
    return [tuple(x) for x in out]


def second_pass(found: list[Block], edge: str, alone: bool) -> None:
    """Near-good blocks, then short ones, take the label of their nearest decided neighbours; ``edge`` lies beyond both ends.

    ``alone``: these are all blocks of the page, so where none is better, the near-good ones are the article, and where all are
    short, those are.
    """
    labels = [b.label for b in found]
    best = max((STEPS.index(x) for x in labels), default=0)
    if alone and best < 3 and (best == 2 or "bad" not in labels):
        labels = ["good" if x == STEPS[best] else x for x in labels]
    around = neighbours(labels, edge, edge)
    for i, label in enumerate(labels):
        if label == "near":
            labels[i] = "bad" if around[i] == ("bad", "bad") else "good"
    around = neighbours(labels, edge, edge)
    for i, b in enumerate(found):
        if labels[i] == "short":
            one, two = around[i]
            sentence = b.text[-1:] in ".!?:;»\"" and not b.item
            labels[i] = one if one == two else "good" if (b.heading and two == "good") or (not b.heading and sentence) else "bad"
    for b, label in zip(found, labels, strict=True):
        b.label = label


def classify(found: list[Block], hints: bool = True) -> list[Block]:
    """Both passes; returns the good blocks. What is marked as the article and what isn't are judged apart."""
    marked = hints and any(b.inside for b in found)
    for b in found:
        b.label = first_pass(b, marked)
    if not marked:
        second_pass(found, "bad", True)
    else:
        for inside, run in groupby(found, lambda b: b.inside):
            second_pass(list(run), "good" if inside else "bad", False)
    return [b for b in found if b.label == "good"]


def main_text(page: str | None, hints: bool = True) -> str:
    if not page:
        return ""
    return "\n".join(b.text for b in classify(blocks(page), hints))


def _extract(at: int, hints: bool):
    def run(batches):
        for b in batches:
            text = [main_text(p, hints) for p in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, hints: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``. ``hints``: marks of the article are evidence."""
    prepare(pages.sparkSession)
    part = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return part.mapInArrow(_extract(2, hints), "page_id long, url string, text string, n_chars long")


def op3(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", True))
