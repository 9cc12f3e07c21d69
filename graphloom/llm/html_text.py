"""Main text of raw pages: markup drops what it names, a suffix array per host decides about the rest.

A page is read into blocks in one pass, linear in its length. Menus, headers, footers, asides, forms,
notices, adverts, comments and what is never shown are dropped by their elements, and by classes, ids
and roles that say nothing else (``share`` and ``share-box``, not ``share-price``). All other blocks, inside an
``article`` or ``main`` or not, go to their host's suffix array: the token streams of the host's pages
stand end to end, substrings of MIN_TOKENS tokens or more that occur on MIN_PAGES distinct pages are
boilerplate, and a block that they cover is removed; unique runs stay. Markup restricts this verdict
in one case: where boilerplate would take more than half the words inside ``article`` or ``main``, these
are an article that other pages show too, and its blocks stay.

Defined results: null, empty or tag-less input gives its own text, empty where there is none; unclosed
elements end with their parent; quotes count only as an attribute's value; a tag without an end is
text; a null url is a host of its own; repeated rows, also in page_id, are pages each; an empty table gives an
empty table; columns other than page_id, url and html are not read; pages of one article, or of one stream where there is none, count once,
so mirrors do not remove each other;
a host of many pages or bytes is split by hash into parts of about GROUP_PAGES or GROUP_BYTES. Its
windows of MIN_TOKENS tokens are counted over all parts, by hash, so the split changes no result. Up to
FEW_WINDOWS of these windows go to the pages as they are; more meet the pages part by part.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches, staged
from graphloom.llm.frequency import class_table, classes_of
from graphloom.llm.shingles import mixed, word_hashes

MIN_TOKENS, MIN_PAGES, GROUP_PAGES, GROUP_BYTES = 8, 3, 2000, 32_000_000
#: Tokens of the pieces of a window whose least hash stands for it when windows on one page only are ruled out.
PIECE = 6
#: Windows that a task holds before it hands them on.
HELD = 1_000_000
#: Repeated windows of split hosts, eight bytes each, that are broadcast at most.
FEW_WINDOWS = 1_000_000

# Fixed values of HTML: elements by their part in a page.
UNSEEN = frozenset("script style noscript template svg iframe object head title textarea select button canvas audio video".split())
CHROME = frozenset("nav footer aside form dialog menu".split())
MAIN = frozenset("article main".split())
STRUCTURE = frozenset("html body div section article main nav header footer aside form dialog menu ul ol dl table tbody thead tfoot tr blockquote figure details fieldset".split())
BREAKS = STRUCTURE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd br hr pre address center caption figcaption summary legend option".split())
#: Words of a class, id or role that name a part beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe signup login search nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets "
    "related recommended share sharing social footer contentinfo complementary comment comments reply replies disqus pagination pager".split()
)
ATOP = frozenset("header masthead topbar".split())
#: Words that say nothing about a part themselves.
PLAIN = frozenset(
    "area banner bar block body bottom box btn button card cell center col column container content entry first fixed form frame global grid group "
    "icon icons inline inner item items label last layout left link links list main message module page panel post primary reader region right row "
    "secondary section site slot small sticky strip tab text title top unit user view wrap wrapper zone".split()
)

# possessive, so nothing is tried twice; a quote that never closes is a character like others
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)")
_ATTRS = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+(?=>)")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _is_beside(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in CHROME or tag == "header" and not in_main:
        return True
    if not attrs:
        return False
    if _HIDDEN.search(attrs):
        return True
    drop = BESIDE if in_main else BESIDE | ATOP
    for m in _NAMES.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in _WORDS.findall(name)}
            if words & drop and words <= drop | PLAIN:
                return True
    return False


def tags(text: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it ends an element, attributes) of the markup of a page; comments and what is never shown have no name.

    Each character is read a bounded number of times: after one tag whose end is lost among quotes, tags end at the next ``>``.
    """
    at, quotes, unclosed = 0, True, set()
    while (i := text.find("<", at)) >= 0:
        at = i + 1
        if text.startswith("<!--", i):
            z = text.find("-->", i + 4)
            at = len(text) if z < 0 else z + 3
            yield i, at, "", False, ""
            continue
        m = _NAME.match(text, i)
        if m is None:
            if text.startswith(("<!", "<?"), i):
                z = text.find(">", i)
                if z < 0:
                    return
                at = z + 1
                yield i, at, "", False, ""
            continue
        a = _ATTRS.match(text, m.end()) if quotes else None
        z = a.end() if a else text.find(">", m.end())
        if z < 0:
            return
        quotes = quotes and a is not None
        name, attrs, closes = m[1].lower(), text[m.end() : z], text[i + 1] == "/"
        at = z + 1
        if name in UNSEEN and not closes and not attrs.endswith("/"):
            found = None if name in unclosed else re.compile(rf"</{name}\s*+>", re.I).search(text, at)
            if found is None:
                unclosed.add(name)
            at = found.end() if found else len(text)
            name = ""
        yield i, at, name, closes, attrs


def page_stream(page: str | None) -> list[tuple[str, bool]]:
    """(block, whether it is inside article or main) of every block that markup does not drop, in page order."""
    found: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    opened: dict[str, int] = {}
    beside = mains = floor = 0  # what lies under ``floor`` hides nothing any more
    piece: list[str] = []
    at = 0
    text = page or ""

    def close() -> None:
        if piece:
            words = " ".join(html.unescape("".join(piece)).split())
            piece.clear()
            if words:
                found.append((words, mains > 0))

    for start, end, tag, closes, attrs in tags(text):
        if not beside and start > at:
            piece.append(text[at:start])
        at = end
        if tag in ("td", "th"):
            piece.append(" ")
        if tag not in BREAKS:
            continue
        if not beside:
            close()
        if tag not in STRUCTURE:
            continue
        if closes:
            if opened.get(tag):
                while True:
                    t, b, i = stack.pop()
                    opened[t] -= 1
                    beside -= b and len(stack) >= floor
                    floor = min(floor, len(stack))
                    mains -= i
                    if t == tag:
                        break
        elif not attrs.endswith("/"):
            hides = _is_beside(tag, attrs, mains > 0)
            if tag in MAIN and not hides and beside and not mains:  # an unclosed part beside it ends where the article begins
                floor, beside = len(stack), 0
            stack.append((tag, hides, tag in MAIN))
            opened[tag] = opened.get(tag, 0) + 1
            beside += hides
            mains += tag in MAIN
    if not beside:
        piece.append(text[at:])
        close()
    return found


def page_blocks(page: str | None) -> tuple[list[str], list[str]]:
    """(content, open): the blocks inside article or main, and the other blocks that markup does not drop, in page order."""
    found = page_stream(page)
    return [x for x, m in found if m], [x for x, m in found if not m]


def _host(url: str | None) -> str:
    return re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url or "").split("/")[0].split("?")[0].split("#")[0].lower()


def _sizes(pages: DataFrame) -> DataFrame:
    """(host, parts) of every host: the parts it is split into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_host(u) for u in b.column("url").to_pylist()], pa.string()), b.column("size")], names=["host", "size"])

    sizes = pages.select("url", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size")).mapInArrow(run, "host string, size long")
    return sizes.groupBy("host").agg(F.ceil(F.greatest(F.count("*") / GROUP_PAGES, F.sum("size") / GROUP_BYTES, F.lit(1))).alias("parts"))


#: The number of a split host's first part, from 1 on, and of its parts.
Split = dict[str, tuple[int, int]]


def _part(page: str | None, page_id: int | None, url: str | None, split: tuple[int, int]) -> int:
    return split[0] + xxhash.xxh3_64_intdigest(f"{page_id}\n{url}\n{page}") % split[1]


def _pack(stream: list[tuple[str, bool]]) -> bytes:
    return zlib.compress("\n".join("-+"[m] + x for x, m in stream).encode("utf-8", "surrogatepass"))  # a block holds no line break


def _unpack(packed: bytes) -> tuple[list[str], list[bool]]:
    lines = zlib.decompress(packed).decode("utf-8", "surrogatepass")
    found = lines.split("\n") if lines else []
    return [x[1:] for x in found], [x[0] == "+" for x in found]


def _read(pages: DataFrame, split: Split) -> DataFrame:
    """(page_id, url, host, part, packed), split hosts by their parts and the others, of part 0, by name: the blocks of every page, and which of them are inside article or main, compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                ids, urls, raw = (part.column(x).to_pylist() for x in ("page_id", "url", "html"))
                hosts = [_host(u) for u in urls]
                parts = [_part(x, i, u, split[h]) if h in split else 0 for x, i, u, h in zip(raw, ids, urls, hosts)]
                hosts = ["" if k else h for h, k in zip(hosts, parts)]
                packed = [_pack(page_stream(x)) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(hosts, pa.string()), pa.array(parts, pa.int64()), pa.array(packed, pa.binary())], names=["page_id", "url", "host", "part", "packed"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, host string, part long, packed binary")


def _rolled(h: np.ndarray, length: int) -> np.ndarray:
    n = max(0, len(h) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return out


def _tokens(blocks: list[str]) -> np.ndarray:
    """The hash of each token of a page's stream; a block, whose words one blank parts, ends with a token of its own."""
    return word_hashes(np.frombuffer("".join(x + " \0 " for x in blocks).encode("utf-8", "surrogatepass"), np.uint8), lower=False)[1]


def _ends(blocks: list[str]) -> np.ndarray:
    """Where each block ends in the stream, its own end included."""
    return np.cumsum([x.count(" ") + 2 for x in blocks], dtype=np.int64)


def marked_windows(host: str, blocks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(window, mark): the windows of a page, and the least hash of a piece of each, both mixed with the host: equal windows have equal marks."""
    h = _tokens(blocks)
    w, piece = _rolled(h, MIN_TOKENS), _rolled(h, PIECE)
    mark = piece[: len(w)].copy()
    for k in range(1, MIN_TOKENS - PIECE + 1):
        mark = np.minimum(mark, piece[k : k + len(w)])
    salt = np.uint64(xxhash.xxh3_64_intdigest(host))
    return mixed(w ^ salt), mixed(mark ^ salt)


def covered_blocks(host: str, blocks: list[str], hot: np.ndarray) -> list[bool]:
    """For each block of a page: whether windows that are in ``hot``, which is sorted, cover it."""
    w = marked_windows(host, blocks)[0]
    ends = _ends(blocks)
    edge = np.zeros((ends[-1] if len(ends) else 0) + 1, np.int64)
    if len(w) and len(hot):
        at = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, w), len(hot) - 1)] == w)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + MIN_TOKENS, -1)
    covered = np.cumsum(edge) > 0
    return [bool(covered[a : z - 1].all()) for a, z in zip(np.append(0, ends[:-1]), ends)]


def _hot_windows(pages: DataFrame, split: Split) -> DataFrame:
    """(host, part, w), keyed like ``_read``: the windows of each part of the split hosts that MIN_PAGES distinct pages of the whole host hold."""

    def of_split_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([_host(u) in split for u in b.column("url").to_pylist()], pa.bool_()))

    some = pages.select("page_id", "url", "html").mapInArrow(of_split_hosts, "page_id long, url string, html string")

    def hashes(rows: list[dict[str, str | None]]) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint64), *[np.unique(marked_windows(_host(x["url"]), [y for y, _ in page_stream(x["html"])])[1]) for x in rows]])

    size = some.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    table, bits = class_table(some.select(F.struct("url", "html")), hashes, size // 12, spare=2)
    bundle = pages.sparkSession.sparkContext.broadcast(table)  # of at most 2**28 / 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            n = [len(w) for *_, w in held]
            w = np.concatenate([w for *_, w in held])
            part, name = (np.repeat(np.array(x, np.uint64), n) for x in ([p for p, *_ in held], [m for _, m, _ in held]))
            order = np.lexsort((name, part, w))
            part, name, w = part[order], name[order], w[order]
            first = np.append(True, (w[1:] != w[:-1]) | (part[1:] != part[:-1]))
            new = first | np.append(True, name[1:] != name[:-1])
            part, name, w, first = (x[new] for x in (part, name, w, first))
            # MIN_PAGES names of a part are enough to tell whether the host has as many
            few = np.arange(len(w)) - np.flatnonzero(first)[np.cumsum(first) - 1] < MIN_PAGES
            return pa.RecordBatch.from_arrays([pa.array(x[few].view(np.int64)) for x in (part, w, name)], names=["part", "w", "name"])

        for b in batches:
            for i, u, x in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                stream, host = page_stream(x), _host(u)
                blocks = [y for y, _ in stream]
                w, mark = marked_windows(host, blocks)
                w = np.unique(w[classes_of(mark, bundle.value, bits) > 0])  # the others are on one page of the host only
                if not len(w):
                    continue
                name = xxhash.xxh3_64_intdigest("\n".join(stream_name(blocks, [m for _, m in stream])))
                held.append((_part(x, i, u, split[host]), name, w))
                size += len(w)
                if size > HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    found = some.mapInArrow(run, "part long, w long, name long").groupBy("w").agg(F.collect_set("part").alias("parts"), F.collect_set("name").alias("names"))
    return found.where(F.size("names") >= MIN_PAGES).select(F.lit("").alias("host"), F.explode("parts").alias("part"), "w")


def stream_name(blocks: list[str], inside: list[bool]) -> tuple[str, ...]:
    """What mirrors of a page have in common: its article, or all of its blocks where there is none."""
    return tuple(x for x, m in zip(blocks, inside) if m) or tuple(blocks)


def kept_text(blocks: list[str], inside: list[bool], covered: list[bool]) -> str:
    """The blocks that stay; an article of which more than half would go is a mirrored one and stays whole."""
    words = [x.count(" ") + 1 for x in blocks]
    gone = sum(n for n, m, d in zip(words, inside, covered) if m and d)
    mirrored = 2 * gone > sum(n for n, m in zip(words, inside) if m)
    return "\n".join(x for x, m, d in zip(blocks, inside, covered) if not d or m and mirrored)


def suffix_ranks(stream: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, class): suffixes in order of their first ``length`` tokens, and which of them agree in all of these."""
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    n, width = len(stream), 1
    order = np.argsort(rank, kind="stable")
    while width < length:
        step = min(width, length - width)
        nxt = np.full(n, -1, np.int64)
        nxt[: n - step] = rank[step:]
        key = rank * (n + 1) + nxt + 1  # below 2**62 for the two billion tokens that a part never holds
        order = np.argsort(key)
        head = np.append(True, np.diff(key[order]) != 0)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(head) - 1
        width += step
    return order, rank


def boilerplate(pages: list[list[str]], names: list[tuple[str, ...]] | None = None) -> list[list[bool]]:
    """For each block of each page of one host: whether repeated long substrings cover it; pages of one name count once."""
    first: dict[tuple[str, ...], int] = {}
    same = [first.setdefault(tuple(blocks) if names is None else names[p], p) for p, blocks in enumerate(pages)]
    found = [_tokens(blocks) for blocks in pages]
    sizes = np.array([len(x) + 1 for x in found])
    starts = np.cumsum(sizes) - sizes
    stream = np.unique(np.concatenate([np.append(x, np.uint64(0)) for x in found]), return_inverse=True)[1].astype(np.int64) if pages else np.empty(0, np.int64)
    if len(stream) < MIN_TOKENS:
        return [[False] * len(x) for x in pages]
    stream[starts + sizes - 1] = -1 - np.arange(len(pages))  # ends of pages are all different
    owner = np.repeat(np.array(same), sizes)
    cuts = [list(zip((s + np.append(0, z[:-1])).tolist(), (s + z - 1).tolist())) if len(z) else [] for s, z in zip(starts, map(_ends, pages))]
    order, rank = suffix_ranks(stream, MIN_TOKENS)
    pair = np.unique(rank * len(pages) + owner)
    distinct = np.bincount(pair // len(pages), minlength=len(stream))
    hot = distinct[rank] >= MIN_PAGES
    edge = np.zeros(len(stream) + MIN_TOKENS + 1, np.int64)
    at = np.flatnonzero(hot)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + MIN_TOKENS, -1)
    covered = np.cumsum(edge)[: len(stream)] > 0
    return [[bool(covered[a:z].all()) for a, z in spans] for spans in cuts]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    # at most a row for every GROUP_PAGES pages and GROUP_BYTES bytes
    small_batches(pages.sparkSession)
    split, first = {}, 1
    for row in _sizes(pages).where("parts > 1").orderBy("host").collect():
        split[row["host"]] = (first, row["parts"])
        first += row["parts"]
    hot = staged(_hot_windows(pages, split), "html-windows") if split else None
    few = hot.select("w").distinct().limit(FEW_WINDOWS + 1).toArrow().column("w").to_numpy() if split else np.empty(0, np.int64)
    in_place = split and len(few) <= FEW_WINDOWS

    def text_of(t: pa.Table, hot: np.ndarray | None) -> pa.Table:
        found = [_unpack(x) for x in t.column("packed").to_pylist()]
        blocks, inside = [b for b, _ in found], [m for _, m in found]
        drop = boilerplate(blocks, [stream_name(b, m) for b, m in zip(blocks, inside)]) if hot is None else [covered_blocks(h, b, hot) for h, b in zip(map(_host, t.column("url").to_pylist()), blocks)]
        text = pa.array([kept_text(b, m, d) for b, m, d in zip(blocks, inside, drop)], pa.string())
        return pa.table({"page_id": t.column("page_id"), "url": t.column("url"), "text": text})

    def of_host(t: pa.Table) -> pa.Table:
        return text_of(t, None)

    def of_part(t: pa.Table, hits: pa.Table) -> pa.Table:
        return text_of(t, np.sort(hits.column("w").to_numpy().view(np.uint64)) if t.num_rows and t.column("part")[0].as_py() else None)

    schema = "page_id long, url string, text string"
    if not in_place:
        groups = _read(pages, split).groupBy("host", "part")
        decided = groups.cogroup(hot.groupBy("host", "part")).applyInArrow(of_part, schema) if split else groups.applyInArrow(of_host, schema)
        return decided.withColumn("n_chars", F.char_length("text").cast("long"))
    bundle = pages.sparkSession.sparkContext.broadcast(np.sort(few.view(np.uint64)))  # of FEW_WINDOWS at most

    def of_split_hosts(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([(_host(u) in split) == wanted for u in b.column("url").to_pylist()], pa.bool_()))

        return run

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
            out = []
            for u, x in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                stream = page_stream(x)
                blocks, inside = [y for y, _ in stream], [m for _, m in stream]
                out.append(kept_text(blocks, inside, covered_blocks(_host(u), blocks, bundle.value)))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    raw, as_read = pages.select("page_id", "url", "html"), "page_id long, url string, html string"
    alone = _read(raw.mapInArrow(of_split_hosts(False), as_read), split).groupBy("host", "part").applyInArrow(of_host, schema)
    decided = alone.union(raw.mapInArrow(of_split_hosts(True), as_read).mapInArrow(decide, schema))
    return decided.withColumn("n_chars", F.char_length("text").cast("long"))
