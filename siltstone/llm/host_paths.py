"""HTML extraction by consensus host paths.

Every page is parsed to blocks under containers. A container scores by the text of the blocks that
stand in it, less their links; from the best one the way leads up to the article or main element
that holds it, or as long as a parent adds paragraphs. A container's path is the tags and classes
from the body down, digits generalised. Each page votes for the path of its container; Spark sums
the votes of every host, and every page is extracted anew from the containers on its host's winning
path, or from its own container where that path has no text.

Menus, headers outside articles, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out by element, role, class or id. A class counts if it is such a name as a
whole (``cookie-notice``, ``post-comments``), not if it mentions one (``has-sidebar``,
``comments-open``, ``social-science``). Forms, headers and what classes or roles alone mark are
judged when the page is parsed: one that holds a main element, the article or nearly all text stays. Boxes
for sharing, tags, related pages and page numbers are menus where at least half of what they hold is links; else they
are text like any other.

A page is read in one pass and its elements are walked a fixed number of times, so the time grows
with the page's length, however deep or unclosed its elements are.

Defined results: a null html is an empty page; a page without text gives an empty string and 0. A
page with nothing but marked text gives that. A null or unparsable URL belongs to a host named by
the empty string. Repeated rows get equal results and vote each. Equal votes go to the higher score,
then the smaller path. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stage
from .markup import BLOCK, RAW, VOID, attributes, one_spaced, scan
from .url_lists import host_of

# Elements, roles and words of class or id that mark what isn't the main text.
DROPPED = frozenset("nav aside footer script style noscript template svg button select option dialog iframe object canvas textarea title head menu input label".split())
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form".split())
MARKED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie cookies disclaimer footer gdpr login masthead menu modal nav "
    "navbar navigation newsletter notice notices overlay paywall popup promo promotion promoted sidebar sidenav "
    "signup skip sponsor sponsored subscribe subscription toolbar topbar widget widgets alert announcement".split()
)
# Words that mark a menu where most of what is held is links, and article text elsewhere.
LINK_WORDS = frozenset("pager pagination related recommended recommendations share sharing social tags".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
HEADER_WORDS = frozenset("header siteheader pageheader topheader".split())
#: Words that may stand before and after such a word in the name of a class.
BEFORE = frozenset("post article entry page site main blog user reader global top bottom left right primary secondary inner outer".split())
AFTER = BEFORE | frozenset(
    "area articles bar block body box button buttons col column container content form group header icon icons item items link links list message messages mobile panel posts row "
    "section slot text thread title unit wrap wrapper zone desktop fixed sticky".split()
)
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li ul ol dl dt dd td th tr tbody thead tfoot table figure figcaption hgroup address".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIERS = frozenset("table ul ol dl article section div".split())
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(frozen=True)
class PathConfig:
    #: Winning paths are broadcast up to this many hosts; beyond, they are joined.
    broadcast_hosts: int = 100_000
    #: Share of the text of a page's own best container below which the host's winner is passed over.
    least_share: float = 0.5
    parent_share: float = 0.6
    content_bonus: float = 1.5
    #: Share of a page's text from which on a form, a header or a marked container stays.
    most_text: float = 0.8
    #: Characters outside links from which on a block counts as a paragraph.
    paragraph_chars: int = 80


#: Why an element may be left out.
PLAIN, LINKS, MARKED, COMMENTS = 0, 1, 2, 3


@dataclass(slots=True)
class Element:
    parent: int
    tag: str
    path: str
    content: bool
    mark: int = PLAIN


@dataclass(slots=True)
class Block:
    element: int
    text: str
    link_chars: int

    def own_chars(self) -> int:
        return max(0, len(self.text) - 2 * self.link_chars)


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    #: Whether each element is left out, set by ``judge_marks``.
    out: list[bool] = field(default_factory=list)

    def summed(self, values: list[int]) -> list[int]:
        """For each element the values of itself and all that it holds; parents stand before children."""
        total = list(values)
        for i in range(len(total) - 1, 0, -1):
            total[self.elements[i].parent] += total[i]
        return total

    def below(self, chosen: list[bool]) -> list[bool]:
        """For each element whether it or what holds it is chosen."""
        found = list(chosen)
        for i in range(1, len(found)):
            found[i] = found[i] or found[self.elements[i].parent]
        return found

    def kept(self) -> list[Block]:
        return [b for b in self.blocks if not self.out[b.element]]


@functools.lru_cache(200_000)
def child_path(parent: str, step: str) -> str:
    """Name of a path: its last step and a digest of all, so that deep paths stay short."""
    return f"{step}@{hashlib.blake2b(f'{parent}/{step}'.encode('utf-8', 'replace'), digest_size=8).hexdigest()}"


def step_of(tag: str, names: list[str]) -> str:
    return tag + "." + re.sub(r"\d+", "#", names[0]) if names else tag


@functools.lru_cache(50_000)
def mark_of_name(name: str) -> int:
    """Mark of one class or id: a listed word, alone or among words that say where or what kind of box."""
    words = re.findall(r"[a-z]+", HUMP.sub("-", name).lower())
    while len(words) > 1 and words[0] in BEFORE:
        words = words[1:]
    if not words or not all(w in MARKED_WORDS or w in COMMENT_WORDS or w in LINK_WORDS or w in AFTER for w in words):
        return PLAIN
    return COMMENTS if words[0] in COMMENT_WORDS else MARKED if words[0] in MARKED_WORDS else LINKS if words[0] in LINK_WORDS else PLAIN


def mark_of(tag: str, found: dict[str, str], inside_article: bool) -> int:
    if tag in ("article", "main", "body", "html"):
        return PLAIN
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    mark = max(map(mark_of_name, names), default=PLAIN)
    header = tag == "header" or any(re.sub(r"[^a-z]", "", n.lower()) in HEADER_WORDS for n in names)
    if tag == "form" or found.get("role", "").lower() in MARKED_ROLES or header and not inside_article:
        mark = max(mark, MARKED)
    return mark


def parse(html: str) -> Page:
    """Containers and blocks of one page in page order."""
    page = Page([Element(-1, "html", "", False)])
    elements = page.elements
    #: Open elements as (tag, element or -1 for inline, drops what it holds).
    stack: list[tuple[str, int, bool]] = [("html", 0, False)]
    #: Places in the stack of each open tag, of open blocks and of open barriers; last one last.
    places: defaultdict[str, list[int]] = defaultdict(list)
    blocks_at: list[int] = [0]
    barriers_at: list[int] = [0]
    pieces: list[str] = []
    owner, links, drops = 0, 0, 0

    def flush() -> None:
        nonlocal links
        if pieces:
            text = one_spaced("".join(pieces))
            if text:
                page.blocks.append(Block(owner, text, links))
            pieces.clear()
        links = 0

    def close_to(depth: int) -> None:
        nonlocal owner, drops
        while len(stack) > depth:
            tag, element, drop = stack.pop()
            drops -= drop
            places[tag].pop()
            if tag in BARRIERS:
                barriers_at.pop()
            if element >= 0:
                blocks_at.pop()
                flush()
                owner = elements[element].parent

    def close_open(tags: tuple[str, ...]) -> bool:
        """Close the last of the tags that is open, unless a barrier stands above it."""
        at = max((places[t][-1] for t in tags if places[t]), default=0)
        if at and at > barriers_at[-1]:
            close_to(at)
        return bool(at)

    for kind, tag, source in scan(html):
        if kind == "text":
            if not drops:
                pieces.append(tag)
                if places["a"]:
                    links += len(tag.strip())
            continue
        if kind == "close":
            at = places[tag][-1] if places[tag] else 0
            if at and (tag in BLOCK or at > blocks_at[-1]):
                close_to(at)
            continue
        if places["head"] and (tag == "body" or tag in BLOCK):
            close_to(places["head"][-1])
        if tag in ("html", "body"):
            flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                pieces.append(" ")
            continue
        if not (tag in CLOSED_BY and close_open(CLOSED_BY[tag])) and tag in BLOCK:
            close_open(("p",))
        found = attributes(source) if source.strip() else {}
        mark = mark_of(tag, found, bool(places["article"] or places["main"]))
        drop = tag in RAW or tag in DROPPED or "hidden" in found or found.get("aria-hidden") == "true" or mark > LINKS and tag not in BLOCK
        element = -1
        if tag in BLOCK:
            flush()
            names = sorted(found.get("class", "").lower().split()) or ([found["id"].lower()] if found.get("id") else [])
            content = tag in ("article", "main") or bool(CONTENT_WORDS & set(re.findall(r"[a-z]+", " ".join(names))))
            elements.append(Element(owner, tag, child_path(elements[owner].path, step_of(tag, names)), content, mark))
            element = owner = len(elements) - 1
            blocks_at.append(len(stack))
        places[tag].append(len(stack))
        if tag in BARRIERS:
            barriers_at.append(len(stack))
        stack.append((tag, element, drop))
        drops += drop
    close_to(1)
    flush()
    return page


def judge_marks(page: Page, config: PathConfig) -> None:
    """Decide which marked elements are left out."""
    elements, n = page.elements, len(page.elements)
    chars, links, texts = [0] * n, [0] * n, [0] * n
    for block in page.blocks:
        chars[block.element] += block.own_chars() + 1
        links[block.element] += block.link_chars
        texts[block.element] += len(block.text)
    held, links, texts = map(page.summed, (chars, links, texts))
    mains = page.summed([e.tag == "main" for e in elements])
    story = page.summed([e.tag == "article" and 2 * held[i] >= held[0] for i, e in enumerate(elements)])

    def leave(i: int, comments_too: bool, marked_too: bool) -> bool:
        mark = elements[i].mark
        if mark == COMMENTS:
            return comments_too and not mains[i]
        if mark == LINKS:
            return marked_too and 2 * links[i] >= texts[i]
        return mark == MARKED and marked_too and not mains[i] and not story[i] and held[i] < config.most_text * held[0]

    # Where nothing is left, marked containers are taken for what they hold, and at last comments too.
    for comments_too, marked_too in ((True, True), (True, False), (False, False)):
        page.out = page.below([leave(i, comments_too, marked_too) for i in range(n)])
        if page.kept():
            return


def best_container(page: Page, config: PathConfig) -> tuple[int, int]:
    """The container of the main text and its score; -1 if no block scores."""
    elements, n = page.elements, len(page.elements)
    score, good, every, long_, heads = [0.0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    holder = list(range(n))
    for i in range(1, n):
        if elements[i].tag in PARAGRAPHS:
            holder[i] = holder[elements[i].parent]
    for block in page.kept():
        weight, e = block.own_chars(), block.element
        every[e] += len(block.text)
        if weight >= config.paragraph_chars or elements[e].tag in PARAGRAPHS and weight:
            good[e] += len(block.text)
        long_[e] += weight >= config.paragraph_chars
        heads[e] += elements[e].tag == "h1"
        at, share = holder[e], 1.0
        while at >= 0 and share > 0.05:
            score[at] += weight * share * (config.content_bonus if elements[at].content else 1.0)
            share *= config.parent_share
            at = elements[at].parent
    best = max(range(n), key=score.__getitem__)
    if score[best] <= 0:
        return -1, 0
    value = int(score[best])
    above = []
    at = best
    while at > 0:
        above.append(at)
        at = elements[at].parent
    for tag in ("article", "main"):
        if held := [i for i in above if elements[i].tag == tag]:
            return held[-1], value
    good, every, long_, heads = map(page.summed, (good, every, long_, heads))
    for up in [*above[1:], 0]:
        more, other = good[up] - good[best], every[up] - every[best] - good[up] + good[best]
        wanted = elements[up].content or long_[up] > long_[best] or heads[up] > heads[best]
        if not more or not wanted or other > 0.5 * more + 0.1 * every[best]:
            if every[up] > every[best]:
                break
            continue
        best = up
    return best, value


def main_text(page: Page, winner: str | None, config: PathConfig) -> str:
    def within(chosen: list[bool]) -> list[str]:
        inside = page.below(chosen)
        return [b.text for b in page.kept() if inside[b.element]]

    size = lambda blocks: sum(map(len, blocks))
    blocks = within([e.path == winner for e in page.elements]) if winner is not None else []
    best, _ = best_container(page, config)
    own = within([i == best for i in range(len(page.elements))]) if best >= 0 else [b.text for b in page.kept()]
    if not blocks or size(blocks) < config.least_share * size(own):
        blocks = own
    return "\n\n".join(blocks)


def read_page(html: str, config: PathConfig) -> Page:
    page = parse(html)
    judge_marks(page, config)
    return page


def winning_paths(pages: DataFrame, config: PathConfig = PathConfig()) -> DataFrame:
    """Rows (host, winner): votes are summed by host and path, then each host keeps its best."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for host, html in zip(pdf["host"], pdf["html"]):
                page = read_page(html or "", config)
                best, score = best_container(page, config)
                if best >= 0:
                    rows.append((host, page.elements[best].path, score))
            yield pd.DataFrame(rows, columns=["host", "path", "score"])

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(vote, "host string, path string, score long")
    summed = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    lowest = F.struct((-F.col("votes")).alias("votes"), (-F.col("score")).alias("score"), "path")
    return summed.groupBy("host").agg(F.min(lowest)["path"].alias("winner"))


def extract(pages: DataFrame, config: PathConfig = PathConfig()) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of ``pages`` (page_id, url, html)."""
    winners = stage(winning_paths(pages, config), "host-paths")
    few = winners.limit(config.broadcast_hosts + 1).count() <= config.broadcast_hosts
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = rows.join(F.broadcast(winners) if few else winners, "host", "left")

    @F.pandas_udf("string")
    def text_of(html: pd.Series, winner: pd.Series) -> pd.Series:
        return pd.Series([main_text(read_page(h or "", config), w if isinstance(w, str) else None, config) for h, w in zip(html, winner)], dtype=object)

    found = joined.select("page_id", "url", text_of("html", "winner").alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
