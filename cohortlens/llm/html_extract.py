"""Main text of web pages, with host suffix arrays for boilerplate.

A page is read tag by tag into blocks.  Inside an article (or the main element of a page
without one) a block is *content*, or *weak* where the class or id of an element around it
only hints at a page part (related, share, widget).  Elsewhere it is *unmarked*.  A block
is *chrome* inside elements that say what they are (navigation, page headers, footers,
sidebars, forms, adverts, notices, comments) or where it is mostly link text.

All blocks but plain content make the page's stream.  First the streams of a host are
concatenated and their suffixes sorted by prefix doubling; neighbours that share a run of
``RUN`` tokens on ``PAGES`` distinct pages mark it as repeated, and marked runs that
overlap join into maximal ones.  (Each longer repeated substring is the union of its runs
of that length, so that sorting deeper would cover the same tokens.)  Equal streams are
kept once with their number of pages; a host with many has several suffix arrays, whose
counts of each run are added up over the host, so the host's size changes nothing.  Then
plain content is sorted in suffix arrays too, with the runs that are chrome on ``SHARE`` of
the host's distinct pages or more (there are few: at most the runs of two mean pages).

What the arrays decide:

* unmarked blocks, on pages without content: repeated runs go, unique ones are the text;
* weak blocks of an article: one that a maximal run covers wholly goes, any other stays;
* plain content: a block of ``RUN`` words or more that maximal runs of such common chrome
  cover wholly, and that is in articles of ``PAGES`` distinct pages, is a notice and goes.

Other plain content stays however often it is repeated, as passages are quoted, articles
syndicated and titles listed in sidebars; chrome that markup names goes however rare it is,
as an advert may be shown once.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .markup import BLOCKS, events
from .scratch import Scratch, partitions, prepare, tidy
from .shingles import U64, mix

#: Tokens of the shortest repeated run, and distinct pages it has to be on.
RUN, PAGES = 8, 3
#: Share of a host's distinct pages that have a run as chrome, from which on plain content made of such runs may be a notice.
SHARE = 0.5
#: Distinct streams of a host that meet in one suffix array; larger hosts are dealt by hash into several, whose counts are added up.
DEAL = 256
#: Words of plain content in one suffix array, about; a key tells a run in all of them.
PART = 1 << 17
#: Distinct pages whose article loses a block that are broadcast at most (some 100 bytes each); more of them are joined by an exchange.
FEW_CHANGES = 200_000

CHROME, CONTENT, UNMARKED, WEAK = range(4)

# HTML's element names by role, and words in class and id that tell a role.
_RAW = frozenset("script style noscript template textarea iframe svg object canvas title select option".split())
_CHROME_TAGS = frozenset("nav footer aside form menu dialog button head".split()) | _RAW
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar comment comments respond disqus".split())
#: Words that only hint at a page part: inside an article the host's other pages decide.
_WEAK_WORDS = frozenset("side related recommended share sharing social widget discussion reply replies pagination pager login signup search skip".split())
#: Words that make an article something else: its class often names the layout around it.
_ARTICLE_WORDS = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related".split())
#: Elements that an opening tag closes.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _element_role(tag: str, attributes: str, in_content: bool) -> int:
    """CHROME, WEAK or CONTENT (says nothing) of an element's name and attributes."""
    if tag in _CHROME_TAGS or tag == "header" and not in_content:
        return CHROME
    if not attributes or tag in ("html", "body", "main"):
        return CONTENT
    out = CONTENT
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            words = _SPLIT.split(value)
            if (_ARTICLE_WORDS if tag == "article" else _CHROME_WORDS).intersection(words):
                return CHROME
            if tag != "article" and _WEAK_WORDS.intersection(words):
                out = WEAK if in_content else CHROME
        if name == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"):
            return CHROME
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return CHROME
    return out


def page_blocks(html: str) -> list[tuple[int, bool, bool, str]]:
    """(role, in an article, in a main element, text) of each block with text, in page order.

    Every tag costs the same whatever is open around it, so a page of any nesting takes linear time.
    """
    out = []
    stack: list[tuple[str, int]] = []  # open elements: name, role
    opened: Counter = Counter()  # open elements by name and by role
    blocks: list[int] = []  # where the stack has block elements
    parts: list[str] = []
    linked = 0

    def close_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            articles, mains = opened["article"] > 0, opened["main"] > 0
            hidden = opened[CHROME] > 0 or opened["header"] > 0 and not (opened["h1"] or opened["h2"])
            mostly_links = not articles and not mains and linked * 2 > len(text)
            role = CHROME if hidden or mostly_links else UNMARKED if not (articles or mains) else WEAK if opened[WEAK] else CONTENT
            out.append((role, articles, mains, text))
        parts.clear()
        linked = 0

    def pop() -> None:
        name, role = stack.pop()
        opened[name] -= 1
        opened[role] -= 1
        if blocks and blocks[-1] == len(stack):
            blocks.pop()

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if opened["a"]:
                linked += len(text.strip())

    for before, name, closing, attributes in events(html, _RAW):
        add(before)
        if not name:
            continue
        if name == "br":
            parts.append("\n")
            continue
        if name in BLOCKS:
            close_block()
        if closing:
            if opened[name] > 0:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in _VOID or name in _RAW:
            continue
        closes = _CLOSES.get(name, ())
        if name in BLOCKS:
            closes = (*closes, "p")
        # an implied end reaches the nearest open block, with what is open inside it
        if blocks and stack[blocks[-1]][0] in closes:
            depth = blocks[-1]
            while len(stack) > depth:
                pop()
        role = _element_role(name, attributes, opened["article"] > 0 or opened["main"] > 0)
        if name in BLOCKS:
            blocks.append(len(stack))
        stack.append((name, role))
        opened[name] += 1
        opened[role] += 1
    close_block()
    return out


@dataclass
class PageParts:
    """``blocks``: what may be in the text of a page with content, in page order (else none); plain content and weak blocks.

    The stream: texts, roles, and which of ``blocks`` each one is (-1: none).
    """

    blocks: list[str]
    stream: list[str]
    roles: list[int]
    places: list[int]


def classify(html: str) -> PageParts:
    found = page_blocks(html)
    use = 1 if any(b[0] != CHROME and b[1] for b in found) else 2
    content = [i for i, b in enumerate(found) if b[0] != CHROME and b[use]]
    place = {i: k for k, i in enumerate(content)}
    stream = [i for i, b in enumerate(found) if i not in place or b[0] == WEAK]
    return PageParts([found[i][3] for i in content], [found[i][3] for i in stream], [found[i][0] if i in place or found[i][0] == CHROME else UNMARKED for i in stream],
                     [place.get(i, -1) for i in stream])


@dataclass
class SuffixArray:
    """Suffixes of a host's streams in order of their first ``run`` tokens; those that share them are one group.

    ``pages`` counts the distinct pages of each group, ``chrome`` those that have it in a chrome block.
    """

    names: list[str]  # distinct tokens; code 0 is beyond a block
    code: np.ndarray
    real: np.ndarray
    tokens: np.ndarray  # of each stream, with those beyond its blocks
    order: np.ndarray
    head: np.ndarray
    group: np.ndarray
    pages: np.ndarray
    chrome: np.ndarray
    run: int

    def keys(self) -> np.ndarray:
        """A 64-bit hash of each group's run, the same in all suffix arrays."""
        token = np.array([0] + [int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for t in self.names], np.uint64)
        out = np.zeros(len(self.head), np.uint64)
        for k in range(self.run):
            out = mix((out ^ token[self.code[self.order[self.head] + k]]) * U64(0x9E3779B97F4A7C15) + U64(k + 1))
        return out.view(np.int64)

    def covered(self, often: np.ndarray) -> list[np.ndarray]:
        """For each stream's tokens: is one in a run of the groups ``often``; overlapping runs join into maximal ones."""
        delta = np.zeros(len(self.code) + 1, np.int64)
        hit = self.order[often[self.group]]
        np.add.at(delta, hit, 1)
        np.add.at(delta, hit + self.run, -1)
        mark = np.cumsum(delta[:-1]) > 0
        ends = np.cumsum(self.tokens)
        return [mark[e - n : e][self.real[e - n : e]] for e, n in zip(ends, self.tokens)]


def suffix_array(streams: list[list[list[str]]], pages: list[int], run: int = RUN, roles: list[bytes] | None = None) -> SuffixArray:
    """Of streams (blocks of tokens), each of so many distinct pages; ``roles`` are those of its blocks (none: no chrome).

    A run has ``run`` tokens of one block, or is a whole shorter block.
    """
    names: dict[str, int] = {}
    code, length, owner, real, named = [], [], [], [], []
    for i, blocks in enumerate(streams):
        for k, block in enumerate(blocks):
            n = max(run, len(block))
            code += [names.setdefault(t, len(names) + 1) for t in block] + [0] * (n - len(block))  # 0: beyond the block
            real += [True] * len(block) + [False] * (n - len(block))
            length.append(n)
            owner.append(i)
            named.append(bool(roles) and roles[i][k] == CHROME)
    total, none = len(code), np.zeros(0, np.int64)
    if not total:
        return SuffixArray([], none, none.astype(bool), np.zeros(len(streams), np.int64), none, none, none, none, none, run)
    code, size = np.array(code, np.int64), np.array(length)
    left = np.repeat(np.cumsum(size), size) - np.arange(total)  # tokens to the block's end
    stream = np.repeat(np.array(owner), size)
    # Prefix doubling: rank orders the suffixes by their first ``depth`` tokens.
    rank, depth = code, 1
    while depth < run:
        step = min(depth, run - depth)
        following = np.zeros(total, np.int64)
        following[: total - step] = rank[step:] + 1
        following[left <= step] = 0
        _, rank = np.unique(rank * (total + len(names) + 3) + following, return_inverse=True)
        depth += step
    start = np.flatnonzero(left >= run)
    order = start[np.argsort(rank[start], kind="stable")]
    r = rank[order]
    head = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    group = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(order)]))
    weight = np.array(pages, np.int64)
    in_stream, in_chrome = group * len(streams) + stream[order], np.repeat(np.array(named), size)[order]

    def times(places: np.ndarray) -> np.ndarray:
        one = np.unique(places)  # a stream counts once for a group
        return np.bincount(one // len(streams), weight[one % len(streams)], len(head)).astype(np.int64)

    tokens = np.bincount(owner, size, len(streams)).astype(np.int64)
    return SuffixArray(list(names), code, np.array(real, bool), tokens, order, head, group, times(in_stream), times(in_stream[in_chrome]), run)


def decide(stream: list[str], roles: list[int], places: list[int], content: int, repeated: np.ndarray) -> tuple[str | None, list[int]]:
    """(text of a page without content, blocks that a page with content loses) from the covered tokens of its stream.

    ``content``: the number of blocks of a page's content.
    """
    out, gone, at = [], [], 0
    for text, role, place in zip(stream, roles, places):
        tokens = text.split()
        span = slice(at, at + len(tokens))
        at += len(tokens)
        if role == UNMARKED:
            if left := [t for t, c in zip(tokens, repeated[span]) if not c]:
                out.append(" ".join(left))
        elif role == WEAK and repeated[span].all():
            gone.append(place)
    if not content:
        return "\n\n".join(out), []
    return None, gone if len(gone) < content else []


def notices(blocks: list[str], common: np.ndarray) -> list[int]:
    """Which of a host's blocks of plain content the ``common`` runs (their keys) cover wholly; shorter ones than a run are none."""
    out, part, size = [], [], 0
    for k, text in enumerate(blocks):
        tokens = text.split()
        if len(tokens) >= RUN:
            part.append((k, tokens))
            size += len(tokens)
        if part and (size >= PART or k == len(blocks) - 1):
            found = suffix_array([[b] for _, b in part], [1] * len(part))
            known = np.isin(found.keys(), common) if len(common) else np.zeros(len(found.head), bool)
            out += [i for (i, _), covered in zip(part, found.covered(known)) if covered.all()]
            part, size = [], 0
    return out


_PARSED = "blocks array<string>, stream array<string>, roles binary, places array<int>, page binary, stream_key binary"


def _digest(*parts: object) -> bytes:
    # no block has a line feed
    return hashlib.blake2b("\n".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each input row: id, url, text, n_chars.

    Blocks are joined by two line feeds; white space inside a block is one space;
    character references are decoded.  Null and empty html give an empty text.  Pages
    with a null url or one without a host are taken as of one host.  Repeated rows stay
    (and count as one page for repetition); a page of any length and nesting is read in
    linear time; other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "html")
    kinds = ", ".join(f"{n} {pages.schema[c].dataType.simpleString()}" for n, c in (("id", id_col), ("url", url_col)))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classify(html or "") for html in batch.column("html").to_pylist()]
            key = [_digest(len(x.blocks), x.roles, x.places, *x.stream) for x in found]
            page = [_digest(k.hex(), *x.blocks) for k, x in zip(key, found)]
            cols = [pa.array([x.blocks for x in found], pa.list_(pa.string())), pa.array([x.stream for x in found], pa.list_(pa.string())), pa.array([bytes(x.roles) for x in found], pa.binary()),
                    pa.array([x.places for x in found], pa.list_(pa.int32())), pa.array(page, pa.binary()), pa.array(key, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), *cols], ["id", "url", "blocks", "stream", "roles", "places", "page", "stream_key"])

    def array_of(group: pa.Table) -> SuffixArray:
        streams = [[t.split() for t in x] for x in group.column("stream").to_pylist()]
        return suffix_array(streams, group.column("pages").to_pylist(), roles=group.column("roles").to_pylist())

    def count(group: pa.Table) -> pa.Table:
        found, of = array_of(group), group.column("of")[0].as_py()
        # a host with one deal needs no sums, only its common chrome
        rows = slice(None) if group.column("deals")[0].as_py() > 1 else found.chrome >= max(PAGES, SHARE * of)
        key = found.keys()[rows]
        same = [pa.array([group.column(c)[0].as_py()] * len(key), k) for c, k in (("host", pa.string()), ("deal", pa.int32()), ("of", pa.int64()))]
        return pa.table([*same, pa.array(key, pa.int64()), pa.array(found.pages[rows], pa.int64()), pa.array(found.chrome[rows], pa.int64())], ["host", "deal", "of", "run", "pages", "chrome"])

    def bare(group: pa.Table, often: pa.Table) -> pa.Table:
        found = array_of(group)
        repeated = found.pages >= PAGES
        if len(often) and len(found.head):
            repeated |= np.isin(found.keys(), often.column("run").to_numpy())
        made = [decide(*x) for x in zip(*(group.column(c).to_pylist() for c in ("stream", "roles", "places", "content")), found.covered(repeated))]
        rows = [i for i, (text, gone) in enumerate(made) if text is not None or gone]
        taken = group.take(pa.array(rows, pa.int64()))
        return pa.table([taken.column("host"), taken.column("stream_key"), pa.array([made[i][0] for i in rows], pa.string()), pa.array([made[i][1] for i in rows], pa.list_(pa.int32()))], ["host", "stream_key", "text", "gone"])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, blocks, places, common = (batch.column(c).to_pylist() for c in ("host", "blocks", "places", "common"))
            plain = defaultdict(list)  # by host: page and place of each block
            for i, (host, x, weak) in enumerate(zip(hosts, blocks, map(set, places))):
                plain[host] += [(i, k) for k in range(len(x)) if k not in weak]
            found = [at[n] for at in plain.values() if at for n in notices([blocks[i][k] for i, k in at], np.array(common[at[0][0]] or [], np.int64))]
            taken = batch.select(["host", "page"]).take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([k for _, k in found], pa.int32()), pa.array([_digest(blocks[i][k]) for i, k in found], pa.binary())], ["host", "page", "place", "block"])

    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    parsed = scratch.table(read.mapInArrow(tidy(parse), f"{kinds}, {_PARSED}"), "parsed")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    parsed = parsed.withColumn("host", host).withColumn("content", F.size("blocks"))
    # Equal streams of a host are one, with the number of its distinct pages.
    times = parsed.select("host", "page", "stream_key").distinct().groupBy("host", "stream_key").agg(F.count("*").alias("pages"))
    once = parsed.groupBy("host", "stream_key").agg(*[F.first(c).alias(c) for c in ("stream", "roles", "places", "content")])
    # The salt spreads a host with many streams until its number of deals is known.
    salt = F.pmod(F.xxhash64("stream_key"), F.lit(partitions(spark))).cast("int")
    streams = scratch.table(once.join(times, ["host", "stream_key"]).withColumn("salt", salt), "streams")
    part = streams.groupBy("host", "salt").agg(F.count("*").alias("n"), F.sum("pages").alias("of"))
    sizes = part.groupBy("host").agg(F.ceil(F.sum("n") / DEAL).cast("int").alias("deals"), F.sum("of").alias("of"))
    dealt = streams.join(part.select("host", "salt").join(sizes, "host"), ["host", "salt"]).drop("salt")
    dealt = dealt.withColumn("deal", F.pmod(F.xxhash64("stream_key", F.lit(1)), F.col("deals")).cast("int"))
    runs = scratch.table(dealt.groupBy("host", "deal").applyInArrow(count, "host string, deal int, of long, run long, pages long, chrome long"), "runs")
    total = runs.groupBy("host", "run").agg(F.sum("pages").alias("total"), F.sum("chrome").alias("named"), F.first("of").alias("of"))
    often = runs.where(F.col("pages") < PAGES).join(total.where(F.col("total") >= PAGES), ["host", "run"]).select("host", "deal", "run")
    made = scratch.table(dealt.groupBy("host", "deal").cogroup(often.groupBy("host", "deal")).applyInArrow(bare, "host string, stream_key binary, text string, gone array<int>"), "made")
    bared = parsed.where("content = 0").select("id", "url", "host", "stream_key").join(made.where("text is not null").select("host", "stream_key", "text"), ["host", "stream_key"]).select("id", "url", "text")
    # Plain content goes through suffix arrays where it lies: only the few runs of its host's common chrome are brought to it.
    common = scratch.table(total.where((F.col("named") >= PAGES) & (F.col("named") >= F.col("of") * SHARE)).groupBy("host").agg(F.collect_list("run").alias("common")), "common")
    full = parsed.where("content > 0")
    covered = scratch.table(full.select("host", "page", "blocks", "places").join(common, "host", "left").mapInArrow(tidy(cover), "host string, page binary, place int, block binary"), "covered").distinct()
    notes = covered.groupBy("host", "block").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= PAGES)
    lost = covered.join(notes, ["host", "block"]).select("host", "page", F.array("place").alias("gone"))
    weak = made.where("text is null").join(full.select("host", "stream_key", "page").distinct(), ["host", "stream_key"]).select("host", "page", "gone")
    changes = scratch.table(weak.union(lost).groupBy("host", "page").agg(F.flatten(F.collect_list("gone")).alias("gone")), "changes")
    small = changes.limit(FEW_CHANGES + 1).count() <= FEW_CHANGES
    marked = full.select("id", "url", "host", "page", "blocks").join(F.broadcast(changes) if small else changes.hint("merge"), ["host", "page"], "left")
    left = F.filter("blocks", lambda _, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    both = marked.select("id", "url", F.array_join(F.when(F.size(left) > 0, left).otherwise(F.col("blocks")), "\n\n").alias("text")).union(bared)
    return both.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
