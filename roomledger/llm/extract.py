"""Main text of web pages by consensus of each host's pages.

Every page is scored on its own first: menus, adverts, forms and the like are left out, and the container
that holds the article is sought. Its generalised tag-class path is the page's vote. Spark counts the
votes per host, and every page is then extracted again from the containers at its host's winning path.
"""

from __future__ import annotations

import hashlib
import re
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.arrow import bounded_batches, in_batches
from roomledger.sources.tables import materialize

BROADCAST_HOSTS = 20_000  # winners of that many hosts are at most some 8 MB; with more, Spark joins by shuffle
PATH_CHARS = 400  # the steps before are known by their hash
PASSAGE = 3  # words that make a block outside of links a passage; headings are passages of any length
PROSE = 8  # words that make a block outside of links prose; prose beside an article element belongs to the article

# Elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp".split())
BOILERPLATE = frozenset("nav header footer aside form button select menu dialog head".split()) | RAW
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("body article main section div td".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disqus footer form header masthead menu modal nav navbar navigation newsletter notice notices notification "
    "popup promo promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe "
    "toolbar widget".split())
# Names of boilerplate wherever they stand in a class. The other names are so as a whole class only;
# as a part of one (post-header, social-history) they make a container doubtful.
PLAIN_NAMES = frozenset(
    "ad ads advert advertisement adverts breadcrumb breadcrumbs comments consent cookie cookies disqus masthead menu nav "
    "navbar navigation sidebar".split())
COMMENT_NAMES = frozenset("comment comments reply respond".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_NAME_PARTS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_RAW_END = {name: re.compile(rf"</{name}\s*>|\Z", re.I) for name in RAW}


class Container(NamedTuple):
    path: str
    tag: str
    first: int  # blocks [first, last)
    last: int
    depth: int


class Page(NamedTuple):
    blocks: list[str]
    links: list[int]  # characters of links in each block
    containers: list[Container]
    levels: list[int]  # of headings; 0 for other blocks


class Doubt(NamedTuple):
    """A container that only a part of its class calls boilerplate."""

    above: int  # the doubtful container around it, or -1
    first: int  # blocks [first, last)
    last: int
    holds_article: bool


def _attributes(text: str) -> dict[str, str]:
    if len(text) < 4:
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _step(tag: str, found: dict[str, str]) -> str:
    """A path's step: the tag with its classes, digits made one mark, so that numbered classes are alike."""
    names = sorted({_DIGITS.sub("#", c) for c in found.get("class", "").lower().split()})
    return ".".join([tag, *names])


def _is_boilerplate(tag: str, found: dict[str, str]) -> bool | None:
    """None for a container in doubt."""
    if tag in BOILERPLATE:
        return True
    if not found:
        return False
    if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if tag in ("body", "html", "main"):
        return False
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    parts = _NAME_PARTS.findall(names)
    if tag == "article":
        return not COMMENT_NAMES.isdisjoint(parts)
    if NAMES.isdisjoint(parts):
        return False
    return True if not PLAIN_NAMES.isdisjoint(parts) or not NAMES.isdisjoint(names.split()) else None


def _own(page: Page) -> list[int]:
    """Characters of each block beyond its links, which count twice."""
    return [max(0, len(block) - 2 * links) for block, links in zip(page.blocks, page.links, strict=True)]


def _has_words(block: str, least: int) -> bool:
    return len(block.split(None, least - 1)) >= least


def _settled(page: Page, doubts: list[Doubt], inside: list[int]) -> Page:
    """The page without those containers in doubt that place and links show to be boilerplate.

    One that holds an article or main element stays, one with the page's only title and no prose too, and
    one with over half of the text of a page whose other parts hold no such element. ``inside`` is the
    innermost doubtful container of every block, or -1.
    """
    own = _own(page)
    size, titles = [0], [0]
    for n, level in zip(own, page.levels, strict=True):
        size.append(size[-1] + n)
        titles.append(titles[-1] + (level == 1))
    articles = any(c.tag in ("article", "main") and size[c.last] > size[c.first] for c in page.containers)
    out: list[bool] = []
    for d in doubts:
        held = titles[d.last] - titles[d.first]
        is_title = held and held == titles[-1] and not any(
            own[i] and _has_words(page.blocks[i], PROSE) for i in range(d.first, d.last) if not page.levels[i])
        stays = d.holds_article or is_title or (not articles and 2 * (size[d.last] - size[d.first]) > size[-1])
        out.append(not stays or (d.above >= 0 and out[d.above]))
    keep = [i < 0 or not out[i] for i in inside]
    place = [0]
    for kept in keep:
        place.append(place[-1] + kept)
    containers = [c._replace(first=place[c.first], last=place[c.last]) for c in page.containers]
    blocks, links, levels = ([x for x, kept in zip(xs, keep, strict=True) if kept] for xs in (page.blocks, page.links, page.levels))
    return Page(blocks, links, containers, levels)


def parse(html: str) -> Page:
    """Text blocks in page order, without boilerplate, and the containers that hold them."""
    page = Page([], [], [], [])
    stack: list[tuple[str, str, int, bool, int]] = []  # tag, path, first block, left out, place in doubts or -1
    doubts: list[Doubt] = []
    inside: list[int] = []
    text: list[str] = []
    in_links = level = link_chars = 0

    def end_block() -> None:
        nonlocal link_chars
        if text:
            block = " ".join("".join(text).split())
            if block:
                page.blocks.append(block)
                page.links.append(min(link_chars, len(block)))
                page.levels.append(level)
                inside.append(stack[-1][4] if stack else -1)
            text.clear()
        link_chars = 0

    def close(depth: int) -> None:
        """Close the open elements down to that depth."""
        nonlocal in_links, level
        while len(stack) > depth:
            tag, path, first, out, doubt = stack[-1]
            if tag not in INLINE:
                end_block()
            stack.pop()
            above = stack[-1][4] if stack else -1
            if tag == "a":
                in_links -= 1
            if tag in HEADINGS:
                level = 0
            if doubt != above:
                doubts[doubt] = doubts[doubt]._replace(last=len(page.blocks))
            if tag in CONTAINERS and not out:
                page.containers.append(Container(path, tag, first, len(page.blocks), len(stack)))
                if tag in ("article", "main") and len(page.blocks) > first:
                    while doubt >= 0 and not doubts[doubt].holds_article:
                        doubts[doubt] = doubts[doubt]._replace(holds_article=True)
                        doubt = doubts[doubt].above

    at, end = 0, len(html)
    while at < end:
        found = _TOKEN.search(html, at)
        upto = found.start() if found else end
        if upto > at and not (stack and stack[-1][3]):
            piece = unescape(html[at:upto])
            text.append(piece)
            if in_links:
                link_chars += len(piece.strip())
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            continue  # comment or declaration
        tag = tag.lower()
        if found[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if place is not None and not (tag in INLINE and any(s[0] in CONTAINERS for s in stack[place + 1 :])):
                close(place)
            elif tag not in INLINE:
                end_block()
            continue
        if tag in RAW:
            at = _RAW_END[tag].search(html, at).end()
            if tag not in INLINE:
                end_block()
            continue
        if tag not in INLINE:
            end_block()
            if tag == "body":
                close(next((i for i, s in enumerate(stack) if s[0] == "head"), len(stack)))
            _close_implied(tag, stack, close)
        if tag in VOID:
            continue
        own = _attributes(found[3])
        above = stack[-1] if stack else ("", "", 0, False, -1)
        path, doubt = above[1], above[4]
        if tag not in INLINE:
            if len(path) > PATH_CHARS:
                path = hashlib.md5(path.encode("utf-8", "surrogatepass")).hexdigest()
            path = f"{path}/{_step(tag, own)}"
        out = above[3] or _is_boilerplate(tag, own)
        if out is None:
            doubts.append(Doubt(doubt, len(page.blocks), len(page.blocks), False))
            doubt = len(doubts) - 1
        stack.append((tag, path, len(page.blocks), bool(out), doubt))
        if tag == "a":
            in_links += 1
        if tag in HEADINGS:
            level = int(tag[1])
    close(0)
    end_block()
    return _settled(page, doubts, inside) if doubts else page


# What a start tag closes, and what it doesn't reach beyond.
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BARRIER = frozenset("ul ol dl table tbody thead body article main section div select".split())


def _close_implied(tag: str, stack: list, close) -> None:
    """Close what ends where this block begins: an open paragraph, or the item before."""
    ended = _CLOSED_BY.get(tag, ()) + ("p",)
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in ended:
            close(i)
            return
        if stack[i][0] in _BARRIER:
            return


def _articles(page: Page, own: list[int]) -> list[Container]:
    """The article and main elements with text of their own, in page order, without those inside another one."""
    found: list[Container] = []
    for c in sorted((c for c in page.containers if c.tag in ("article", "main")), key=lambda c: (c.first, -c.last, c.depth)):
        if (not found or c.first >= found[-1].last) and any(own[c.first : c.last]):
            found.append(c)
    return found


def best_container(page: Page) -> tuple[Container | None, float]:
    """The container that holds the article, and its characters outside links.

    On a page with article or main elements it is the deepest one with their text and what stands beside them as the
    title or as prose; an article element that holds it all is taken itself, not what is inside it. On other
    pages it is the deepest one with all headings and passages, or one around it as long as what that
    adds has text outside of links: short lines beside the body stay, lists of links don't come in.
    """
    own = _own(page)
    articles = _articles(page, own)
    if articles:
        in_articles = bytearray(len(own))
        for c in articles:
            in_articles[c.first : c.last] = b"\1" * (c.last - c.first)
        needed = [i for i, n in enumerate(own) if n and (
            in_articles[i] or page.levels[i] == 1 or _has_words(page.blocks[i], PROSE))]
    else:
        texts = [i for i, n in enumerate(own) if n]
        needed = [i for i in texts if page.levels[i] or _has_words(page.blocks[i], PASSAGE)] or texts
    if not needed:
        return None, 0.0
    first, last = needed[0], needed[-1] + 1
    for c in articles:
        if c.first <= first and c.last >= last:
            return c, float(sum(own[c.first : c.last]))
    holds = sorted((c for c in page.containers if c.first <= first and c.last >= last), key=lambda c: -c.depth)
    if not holds:
        return None, 0.0
    chosen = holds[0]
    for c in holds[1:] if not articles else ():
        if not all(own[c.first : chosen.first]) or not all(own[chosen.last : c.last]):
            break
        if c.last - c.first > chosen.last - chosen.first:
            chosen = c
    return chosen, float(sum(own[chosen.first : chosen.last]))


def vote(html: str | None) -> tuple[str | None, float]:
    """Path of the page's best container and its score; None for a page without text."""
    container, score = best_container(parse(html or ""))
    return (container.path, score) if container and score > 0 else (None, 0.0)


def extract(html: str | None, path: str | None) -> str:
    """Text at the winning path, or that of the page's own best container where it has no such path.

    Where the path leads to article or main elements, the page's other ones with prose are part of the text.
    """
    page = parse(html or "")
    at_path = [c for c in page.containers if c.path == path and c.last > c.first]
    if any(c.tag in ("article", "main") for c in at_path):
        own = _own(page)
        at_path += [c for c in _articles(page, own) if any(own[i] and _has_words(page.blocks[i], PROSE) for i in range(c.first, c.last))]
    chosen = sorted({(c.first, c.last) for c in at_path})
    if not chosen:
        own, _ = best_container(page)
        chosen = [(own.first, own.last)] if own else [(0, len(page.blocks))]
    out, done = [], 0
    for first, last in chosen:  # a container may lie inside another one
        out += page.blocks[max(first, done) : last]
        done = max(done, last)
    return " ".join(out)


def host_votes(pages: DataFrame, url_col="url", html_col="html") -> DataFrame:
    """host, path: the path that most pages of the host voted for.

    Ties go to the higher score in all, then to the path first in order. Votes are added up on the map
    side, so a host with a third of all pages is a few rows per task.
    """

    def cast(batch: pa.RecordBatch) -> pa.RecordBatch:
        votes = [vote(html) for html in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([v[0] for v in votes], pa.string()), pa.array([v[1] for v in votes], pa.float64())],
            names=["host", "path", "score"])

    chosen = pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html"))
    votes = chosen.mapInArrow(in_batches(cast), "host string, path string, score double").filter("path IS NOT NULL")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    ranked = F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path")
    return counted.groupBy("host").agg(F.min(ranked).alias("best")).select("host", F.col("best.path").alias("path"))


def _host(url_col: str):
    return F.coalesce(F.lower(F.try_parse_url(F.col(url_col), F.lit("HOST"))), F.lit(""))


def main_texts(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null or empty page has an empty text. Pages without a readable url are one host. Repeated rows
    come out repeated; other columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    winners = materialize(host_votes(pages, url_col, html_col), "host-paths")
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), _host(url_col).alias("host"), F.col(html_col).alias("html"))
    joined = rows.join(winners, "host", "left").select("page_id", "url", "html", "path")

    def again(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(html, path) for html, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(in_batches(again), f"page_id {kind}, url string, text string, n_chars long")
