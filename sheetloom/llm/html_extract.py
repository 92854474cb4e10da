"""Main text of web pages as the maximum-scoring contiguous region of blocks and tags.

Words of a block score by what the block is: its element, whether it is mostly links, how long it is, and whether elements, roles or class names
tell that it is page furniture; tags score below zero. The weights are log-odds counted on labelled pages, those that mark their content with
an article or main element; the mark labels and is no input of a score, so pages without one are scored alike. One linear
scan finds the best contiguous region; it bridges furniture that is worth less than what lies behind it (adverts, forms, comments and the
like), which is left out of the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hash_share

#: The bound of the training sample: pages, and characters of one of them.
SAMPLE_PAGES, SAMPLE_CHARS = 500, 200_000
FURNITURE_WORDS = 8  # words of furniture inside the content that count against bridging it
TAG_LEAST, WORD_MOST, UNSURE = 0.05, 3.0, 0.2
LENGTHS = (4, 12, 40)
MARKS = frozenset(("article", "/article", "main", "/main"))

TOKEN = re.compile(
    r"<!--(?:>|->|.*?--!?>|.*)"
    r"|<(script|style|textarea|title|xmp|iframe|noembed|noframes|svg)(?=[\s/>])(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</\1(?=[\s/>])[^>]*>|.*)"
    r"|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*>"
    r"|<(/?)([a-z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)>",
    re.I | re.S,
)
OPENING = re.compile(r"<[a-zA-Z/!?]")
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav noscript ol optgroup option p pre search section select"
    " summary table tbody td template tfoot th thead tr ul video audio object".split()
)
SCOPES = frozenset("article aside body div fieldset footer form header html main nav section table td".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
FURNITURE_TAGS = frozenset("head nav footer aside form fieldset button select option label menu noscript template dialog object audio video canvas search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id attributes that tell furniture.
FURNITURE = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus"
    " footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup popular promo promoted promotion"
    " rail recommended related respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Such words that count only where no word of CONTENT stands beside them.
WEAK = frozenset("alert header topbar info bar".split())
CONTENT = frozenset("article body content entry main post story text".split())
UNLESS_AFTER = frozenset("has with no without not show hide".split())


@lru_cache(maxsize=1 << 14)
def is_furniture(tag: str, attributes: str) -> bool:
    """Whether an element is page furniture by its name, role or class words; a header is judged where it stands."""
    if tag in FURNITURE_TAGS or "-" in tag and not FURNITURE.isdisjoint(tag.split("-")):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    found = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    if found.get("role", "").lower() in FURNITURE_ROLES:
        return True
    words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower())
    told = [w for i, w in enumerate(words) if i == 0 or words[i - 1] not in UNLESS_AFTER]
    if any(w in FURNITURE for w in told):
        return True
    return any(w in WEAK for w in told) and not any(w in CONTENT for w in words)


class Block:
    """A run of text between block breaks: its pieces, words, where it stands, and the tags just before it."""

    __slots__ = ("furniture", "name", "n_linked", "n_words", "pieces", "scope", "tags")

    def __init__(self):
        self.pieces, self.tags, self.n_words, self.n_linked = [], [], 0, 0
        self.furniture, self.scope, self.name = False, "", ""


def parse(page: str) -> list[Block]:
    """The blocks of a page in order; the last one may hold closing tags only. Raw text, comments and declarations are skipped."""
    blocks, now = [], Block()
    stack: list[tuple[str, bool]] = []  # name, whether furniture from here on
    count: Counter = Counter()

    def pop(k: int) -> None:
        for name, _ in stack[k:]:
            count[name] -= 1
        del stack[k:]

    def text(raw: str) -> None:
        if not raw or raw.isspace():
            if raw and now.pieces:
                now.pieces.append(" ")
            return
        if not now.n_words:
            now.furniture = bool(stack) and stack[-1][1]
            now.scope = "article" if count["article"] > 0 else "main" if count["main"] > 0 else ""
            now.name = next((n for n, _ in reversed(stack) if n in BLOCK), "")
        raw = html.unescape(raw) if "&" in raw else raw
        n = len(raw.split())
        now.n_words += n
        now.n_linked += n * (count["a"] > 0)
        now.pieces.append(raw)

    if tail := OPENING.search(page, page.rfind(">") + 1):  # a tag that never ends shows nothing
        page = page[: tail.start()]
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            if m[1] and m[1].lower() not in ("script", "style", "svg") and now.n_words:
                blocks.append(now)
                now = Block()
            continue
        closing = m[2] or m[5]
        if name in BLOCK and now.n_words:
            blocks.append(now)
            now = Block()
        if name in BLOCK or name == "a":
            now.tags.append("/" + name if closing else name)
        if closing:
            if count[name] > 0:
                k = len(stack) - 1
                while stack[k][0] != name and (name in SCOPES or stack[k][0] not in SCOPES):
                    k -= 1
                if stack[k][0] == name:
                    pop(k)
        elif name not in VOID and not (m[4] or m[7] or "").endswith("/"):
            for other in CLOSES.get(name, ()):
                if count[other] > 0:
                    k = len(stack) - 1
                    while stack[k][0] != other and stack[k][0] not in SCOPES and stack[k][0] not in ("ul", "ol", "dl", "table"):
                        k -= 1
                    if stack[k][0] == other:
                        pop(k)
            inside = bool(stack) and stack[-1][1]
            own = is_furniture(name, (m[4] or m[7] or "").strip()) or name == "header" and not count["article"]
            stack.append((name, inside or own))
            count[name] += 1
    if at < len(page):
        text(page[at:])
    blocks.append(now)
    return blocks


def marked_scope(blocks: list[Block]) -> str:
    """The element that marks a page's content: article, else main, else none."""
    for scope in ("article", "main"):
        if any(b.n_words and not b.furniture and b.scope == scope for b in blocks):
            return scope
    return ""


def kind_of(block: Block) -> tuple[str, bool, int, bool]:
    """What a block's words are scored by: its element, whether it is mostly links, how long it is, and whether it is furniture."""
    return block.name, 2 * block.n_linked > block.n_words, sum(block.n_words >= k for k in LENGTHS), block.furniture


class Weights:
    """Log-odds of words by the kind of their block, and of tags, counted on labelled pages."""

    def __init__(self, pages: list[str]):
        words: dict[bool, Counter] = {True: Counter(), False: Counter()}
        tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for page in pages:
            blocks = parse(page)
            if not (marked := marked_scope(blocks)):
                continue
            for b in blocks:
                name, linked, length, furniture = kind_of(b)
                content = b.scope in (marked, "article") and not furniture
                words[content].update({(name, linked, length, furniture): b.n_words, (name, linked, furniture): b.n_words, (name, linked): b.n_words})
                tags[content].update(t for t in b.tags if t not in MARKS)
        self.words = {k: max(-WORD_MOST, min(WORD_MOST, math.log((words[True][k] + 1) / (words[False][k] + 1)))) for k in words[True] | words[False]}
        total = {c: sum(t.values()) + 1 for c, t in tags.items()}
        odds = {t: math.log((tags[True][t] + 1) / total[True]) - math.log((tags[False][t] + 1) / total[False]) for t in tags[True] | tags[False]}
        self.tags = {t: -max(TAG_LEAST, min(1.0, -x)) for t, x in odds.items()}

    def word(self, kind: tuple[str, bool, int, bool]) -> float:
        """Of kinds not seen the weight of blocks of any length, then of all such blocks; else for words, against furniture and links."""
        name, linked, _, furniture = kind
        for key in (kind, (name, linked, furniture), (name, linked)):
            if (found := self.words.get(key)) is not None and abs(found) > UNSURE:
                return found
        return -1.0 if furniture else -0.5 if linked else 1.0


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous run (start, stop) with the largest sum, by one linear scan; of equal sums the first, empty if none is above zero."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, region = total, (start, i + 1)
    return region


def block_scores(blocks: list[Block], weights: Weights) -> list[float]:
    """The scores that the scan goes over: of the tags before each block, and of its words; furniture counts against with its first words only."""
    scores = []
    for b in blocks:
        kind = kind_of(b)
        scores.append(sum(weights.tags.get(t, -TAG_LEAST) for t in b.tags))
        scores.append(-abs(weights.word(kind)) * min(b.n_words, FURNITURE_WORDS) if b.furniture else weights.word(kind) * b.n_words)
    return scores


def main_text(page: str | None, weights: Weights) -> str:
    """The text of a page's best region without the furniture in it, blocks joined by one space."""
    if not page:
        return ""
    blocks = parse(page)
    start, stop = best_region(block_scores(blocks, weights))
    texts = (" ".join("".join(b.pieces).split()) for i, b in enumerate(blocks) if b.n_words and start <= 2 * i + 1 < stop and not b.furniture)
    return " ".join(t for t in texts if t)


def labelled_pages(pages: DataFrame, rows: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> list[str]:
    """Up to ``rows`` pages with an article or main element, by a hash of their content."""
    known = pages.select(F.col("html").cast("string").alias("html")).where(F.length("html") <= chars).where(F.col("html").rlike("(?i)<(?:article|main)[\\s>]"))
    return [r.html for r in hash_share(known, F.col("html"), rows).orderBy(F.xxhash64("html"), "html").limit(rows).collect()]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``, from the whole html.

    A null or empty html, or one without content, gives an empty text. Repeated rows, null ids and urls are kept; an empty table
    gives an empty table; other columns are not looked at. Without labelled pages the default weights decide.
    """
    learned = Weights(labelled_pages(pages))
    held = pages.sparkSession.sparkContext.broadcast((learned.words, learned.tags))

    def run(batches):
        weights = Weights([])
        weights.words, weights.tags = held.value
        for b in batches:
            made = [main_text(h, weights) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
