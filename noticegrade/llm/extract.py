"""Main text of web pages: page structure, and suffix arrays of each host's token streams.

A page's markup is read into blocks of text. Blocks in elements that aren't text of the page
(menus, headers, footers, sidebars, notices, adverts, forms, comments, ...) are chrome. If the
page marks its main part (article, main, or a usual name), the blocks in it that aren't chrome
are its text as far as the markup says.

Repetition decides on every page. The token streams of main parts and of what lies outside of
them are concatenated and put in suffix arrays, whole, shard by shard. Suffixes of one host that
share their first ``run`` tokens lie side by side; the shards' arrays are merged by those first
tokens, which shows the runs that occur on pages with different streams: first by counts of their
hashes, packed and dealt by range, which can't lose a run, then exactly for the few that are left. Those that stand on
``least_pages`` and on ``share`` of the host's distinct pages are boilerplate. Pages are distinct if
their main parts are, or without one their article-like blocks (those of a run or more that aren't
chrome), so copies of an article with another menu, date or counter are one. A host with any number
of pages is handled alike, as no step needs its pages together.

- Where the markup marks no main part, blocks that such runs cover whole, and covered stretches of
  ``LONG`` words, go, and what remains of a page's other blocks is its text.
- A main part loses the blocks that the host's marked pages have as boilerplate outside of theirs:
  a notice or an advert that a page says in its article without marking it. All runs of such a
  block are boilerplate outside, its first one on pages whose main parts don't hold it, and it
  begins blocks of main parts on as many pages with different longest blocks. So a
  sentence that many articles quote stays, as do headings, a pull quote, and the versions of an
  article that have its longest block, though a sidebar has its first words.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrade.functions.storage import settle
from noticegrade.llm.words import SPACE_SEPARATED, mix, slices, small_batches, text_buffers, word_hashes

RUN = 6
#: Distinct pages of a host that a run must stand on to be left out, at least, and the share of them.
LEAST_PAGES, SHARE = 3, 0.2
#: Words from which a covered stretch goes although its block has other words.
LONG = 30
#: What a row of ``_counts`` is: a run, a page without a main part, or one with it.
_RUN, _OPEN, _MARKED = 0, -1, -2
#: Bits of a run's number while runs are counted: of the host and of the words.
HOST_BITS, WORD_BITS = 16, 32
#: Runs that are sorted and packed together, at most, and pages for each part that counts are dealt to.
PACKED, PART_PAGES = 1 << 21, 4000
#: Bits in the table of runs that are looked at exactly, at most (2^26 are 8 MB), and in each of its pieces.
TABLE_BITS, PIECE_BITS = 26, 15

#: HTML's element kinds.
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
    "var", "wbr", "math", "mi", "mn", "mo", "mrow", "ms", "mtext", "object",
}
_CHROME_TAGS = {
    "nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "option", "datalist", "svg",
    "canvas", "audio", "video", "map", "fieldset",
}
#: First or last parts of class names and ids, and roles, that mark an element as chrome; see _chrome_name.
_CHROME_NAMES = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "banner", "footer", "sidebar",
    "aside", "complementary", "contentinfo", "search", "ad", "ads", "advert", "adverts", "advertisement", "sponsor",
    "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal",
    "overlay", "newsletter", "subscribe", "subscription", "paywall", "login", "signup", "share", "sharing", "social", "related",
    "recommended", "recommendations", "comment", "comments", "disqus", "replies", "respond", "form", "widget", "toolbar",
    "pagination", "pager", "copyright", "skip",
}
_MAIN_NAMES = {
    "article", "content", "main", "post", "story", "main-content", "article-body", "article-content", "entry-content",
    "post-content", "post-body", "story-body", "page-content",
}
#: Parts that may stand beside those in the name of a chrome element, as in post-comments; numbers may too.
_PLAIN_PARTS = {
    "post", "posts", "article", "articles", "page", "site", "entry", "main", "content", "section", "area", "wrapper", "wrap",
    "container", "inner", "box", "block", "list", "bar", "buttons", "links", "icons", "top", "bottom", "left", "right", "primary",
    "secondary", "global", "thread", "the",
}
#: Elements that hold text. Their ids name what they speak of.
_TEXT_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption", "caption"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that a new one of the same kind, or of a kind in the list, ends.
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</(?![a-zA-Z])[^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+[^>]*+)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_NAME_PART = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


def _chrome_name(parts: list[str]) -> bool:
    """Whether a name says chrome by its first or last part, and no other part says something else."""
    if not parts or parts[0] in ("has", "with", "no", "is", "not"):
        return False
    if not all(x in _CHROME_NAMES or x in _PLAIN_PARTS or x.isdigit() for x in parts):
        return False
    return parts[0] in _CHROME_NAMES or parts[-1] in _CHROME_NAMES


def _named(name: str, attributes: str, inside: int) -> tuple[bool, bool, bool]:
    """(chrome, main, hidden) by class, id, role and whether the element is hidden.

    In a main part (``inside``) ids are often made from headings: on elements that hold text they
    don't count there.
    """
    chrome = main = hidden = False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "role":
            main |= value == "main"
            chrome |= value in _CHROME_NAMES
        elif key in ("class", "id"):
            by_id = key == "id" and inside > 0
            for word in value.split():
                main |= word in _MAIN_NAMES
                if not (by_id and (name in _TEXT_TAGS or name in _INLINE)):
                    chrome |= _chrome_name([x for x in _NAME_PART.split(word) if x])
        elif key == "style":
            chrome |= "display:none" in value.replace(" ", "")
        elif key == "aria-hidden":
            chrome |= value == "true"
        elif key == "hidden":
            hidden |= value in ("", "hidden")
    if name in ("html", "body"):
        return False, False, hidden
    return chrome and not main, main, hidden


def blocks(page: str) -> list[tuple[int, bool, str]]:
    """(how main, chrome, text) of each block in page order: 3 in an article, 2 in main, 1 by name, 0 otherwise."""
    return [(main, chrome, text) for main, chrome, _, text in _blocks(page)]


def _blocks(page: str) -> list[tuple[int, bool, bool, str]]:
    """Those of ``blocks``, and whether each stands in a heading."""
    out: list[tuple[int, bool, bool, str]] = []
    text: list[str] = []
    stack: list[tuple[str, bool | str, int]] = []  # element, chrome so far, main so far
    at, size = 0, len(page)

    def close_block() -> None:
        joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        if joined:
            _, chrome, main = stack[-1] if stack else ("", False, 0)
            out.append((main, bool(chrome), any(x[0] in _HEADINGS for x in stack), joined))

    while at < size:
        tag = _TAG.search(page, at)
        if not tag:
            text.append(page[at:])
            break
        text.append(page[at : tag.start()])
        at = tag.end()
        closing, name, attributes = tag[1], (tag[2] or "").lower(), tag[3] or ""
        if not name:
            if page.startswith("<![CDATA[", tag.start()):
                text.append(html.escape(tag[0][9:].removesuffix("]]>")))
            continue
        if name in _RAW:
            if not closing:
                if name not in _INLINE:
                    close_block()
                end = re.compile(f"</{name}[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name in ("br", "hr", "wbr"):
            text.append(" " if name == "br" else "")
            if name == "hr":
                close_block()
            continue
        if name in _VOID:
            continue
        inline = name in _INLINE
        if closing:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if not inline or depth is not None and stack[depth][1] != (stack[depth - 1][1] if depth else False):
                close_block()
            if depth is not None and not (inline and any(x[0] not in _INLINE for x in stack[depth + 1 :])):
                del stack[depth:]
            continue
        inside = stack[-1][2] if stack else 0
        chrome, named, hidden = _named(name, attributes, inside) if attributes else (False, False, False)
        main = 3 if name == "article" else 2 if name == "main" else 1 if named else 0
        # an article is chrome by its name only within another, as comments are
        chrome = chrome and (main < 2 or main == inside == 3)
        chrome = chrome or name in _CHROME_TAGS or hidden
        if not inline or chrome:
            close_block()
        for ended in _ENDS.get(name, ()):
            inner = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in _INLINE), None)
            if inner is not None and stack[inner][0] == ended:
                del stack[inner:]
        above = stack[-1] if stack else ("", False, 0)
        so_far = above[1] or chrome
        if name == "header" and inside >= 2 and not above[1]:
            so_far = "own"  # the main part's own header: its headings are text
        elif so_far == "own" and name in _HEADINGS:
            so_far = False
        if not attributes.endswith("/") or name not in _CHROME_TAGS:
            stack.append((name, so_far, max(above[2], main)))
    close_block()
    return out


def _read(page: str | None) -> tuple[str | None, list[bool], list[str], list[bool]]:
    """(main part or None, which of its blocks are headings, other blocks, which of them aren't text by the markup)."""
    got = _blocks(page or "")
    level = max((main for main, chrome, *_ in got if not chrome), default=0)
    least = min(level, 2)  # an article, and what stands beside it in main
    inside = [(title, text) for main, chrome, title, text in got if level and not chrome and main >= least]
    rest = [(chrome, text) for main, chrome, _, text in got if not level or chrome or main < least]
    said = "\n".join(text for _, text in inside) if level else None
    return said, [title for title, _ in inside], [text for _, text in rest], [chrome or bool(level) for chrome, _ in rest]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        read = [_read(page) for page in batch.column("html").to_pylist()]
        kinds = {"main": pa.string(), "titles": pa.list_(pa.bool_()), "others": pa.list_(pa.string()), "chrome": pa.list_(pa.bool_())}
        columns = [pa.array([r[k] for r in read], kind) for k, kind in enumerate(kinds.values())]
        carried = ["page_id", "url", "host", "uid"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, carried), *columns], names=[*carried, *kinds])


def suffix_array(words: np.ndarray, rows: np.ndarray, hosts: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, whether each shares host and first ``run`` words with the one before).

    Only suffixes with ``run`` words before their row's end are in it.
    """
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    left = rows[1:][row] - np.arange(len(words)) if len(words) else np.zeros(0, np.int64)
    places = np.flatnonzero(left >= run)
    columns = [words[places + k] for k in range(run - 1, -1, -1)] + [hosts[row[places]]]
    order = np.lexsort(columns) if len(places) else places
    same = np.zeros(len(places), bool)
    same[1:] = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    return places[order], same


def _runs(texts: pa.Array, hosts: np.ndarray, run: int) -> Iterator[tuple[np.ndarray, ...]]:
    """By shard, in the order of its suffix array: text, place in it, run as a number, whether its text has it the first time."""
    data, offsets = text_buffers(texts)
    for start, end in slices(offsets):
        words, rows, _ = word_hashes(data, offsets[start : end + 1], SPACE_SEPARATED)
        places, same = suffix_array(words, rows, hosts[start:end], run)
        # host and first words of each group of neighbours, as one number
        row = np.searchsorted(rows, places, "right") - 1
        key = hosts[start:end][row].astype(np.int64).view(np.uint64)
        for k in range(run):
            key = mix(key ^ words[places + k], k)
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(places))))
        first = ~same
        first[1:] |= row[1:] != row[:-1]
        yield start + row, places - rows[row], key[head], first


def _short(key: np.ndarray, hosts: np.ndarray) -> np.ndarray:
    """Numbers of ``HOST_BITS`` and ``WORD_BITS``. Runs that share one are counted as one, so none is lost."""
    host = hosts.astype(np.int64).view(np.uint64) & np.uint64((1 << HOST_BITS) - 1)
    return host << np.uint64(WORD_BITS) | key >> np.uint64(64 - WORD_BITS)


def _counts(run: int, deep: int):
    """A row for each page, and the numbers of its runs, sorted and packed, in 2^``deep`` parts by the first bits of their words."""
    names = ["part", "host", "body", "story", "uid", "kind", "keys"]
    low = WORD_BITS - deep

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        number = np.concatenate(held)
        words = number & np.uint64((1 << WORD_BITS) - 1)
        part, host = words >> np.uint64(low), number >> np.uint64(WORD_BITS)
        number = part << np.uint64(HOST_BITS + low) | host << np.uint64(low) | words & np.uint64((1 << low) - 1)
        number.sort()
        limits = np.searchsorted(number, np.arange((1 << deep) + 1, dtype=np.uint64) << np.uint64(HOST_BITS + low))
        parts = np.flatnonzero(np.diff(limits))
        number &= np.uint64((1 << HOST_BITS + low) - 1)
        # differences, with equal bytes side by side, so that they pack well where they are moved
        steps = [np.diff(number[limits[k] : limits[k + 1]], prepend=np.uint64(0)) for k in parts]
        blobs = [np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8).T).tobytes() for s in steps]
        held.clear()
        nothing = [pa.nulls(len(parts), pa.int64())] * 4
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *nothing, pa.array([_RUN] * len(parts), pa.int32()), pa.array(blobs, pa.binary())], names=names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            host, uid = (batch.column(c).to_numpy() for c in ("host", "uid"))
            pages = [batch.column(c).cast(pa.int64()) for c in ("host", "body", "story", "uid")]
            part = pa.array(uid & ((1 << deep) - 1), pa.int32())
            yield pa.RecordBatch.from_arrays([part, *pages, batch.column("kind").cast(pa.int32()), pa.nulls(len(uid), pa.binary())], names=names)
            for column in ("stream", "main"):
                for row, _, key, first in _runs(batch.column(column), host, run):
                    held.append(_short(key[first], host[row[first]]))
                    size += len(held[-1])
                    if size >= PACKED:
                        yield packed(held)
                        size = 0
        if size:
            yield packed(held)

    return find


def _often(least: int, deep: int):
    """Pages as they are, and the runs of a part that stand ``least`` times in it."""
    names, low = ["start", "n", "body", "story", "uid", "kind"], WORD_BITS - deep

    def merge(part: pa.Table) -> pa.Table:
        pages = part.filter(pc.is_null(part["keys"]))
        pages = pa.Table.from_arrays([pages["host"], pa.nulls(len(pages), pa.int64()), *map(pages.column, names[2:])], names=names)
        steps = [np.frombuffer(blob.as_buffer(), np.uint8).reshape(8, -1) for blob in part["keys"] if blob.is_valid]
        number = [np.cumsum(np.ascontiguousarray(s.T).view(np.uint64).ravel(), dtype=np.uint64) for s in steps]
        number, n = np.unique(np.concatenate(number) if number else np.zeros(0, np.uint64), return_counts=True)
        number, n = number[n >= least], n[n >= least]
        at = np.uint64(part["part"][0].as_py() << low)
        number = (number >> np.uint64(low) << np.uint64(WORD_BITS)) | at | number & np.uint64((1 << low) - 1)
        nothing = [pa.nulls(len(n), pa.int64())] * 3
        runs = pa.Table.from_arrays([pa.array(number.view(np.int64)), pa.array(n.astype(np.int64)), *nothing, pa.array(np.full(len(n), _RUN, np.int32))], names=names)
        return pa.concat_tables([pages, runs])

    return merge


def _table(numbers: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, table of the runs' last bits, which hosts they are of), from (start): at most 2^``TABLE_BITS`` bits however many runs."""
    n = numbers.count()
    wide = min(TABLE_BITS, max(PIECE_BITS, (64 * n).bit_length()))
    piece = F.shiftright(F.col("start").bitwiseAND((1 << wide) - 1), PIECE_BITS).cast("int").alias("piece")

    def pack(found: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PIECE_BITS, bool)
        bits[found["at"].to_numpy()] = True
        return pa.table({"piece": found["piece"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    at = F.col("start").bitwiseAND((1 << PIECE_BITS) - 1).cast("int").alias("at")
    table = np.zeros((1 << wide - PIECE_BITS, 1 << PIECE_BITS - 3), np.uint8)
    for r in numbers.select(piece, at).groupBy("piece").applyInArrow(pack, "piece int, bits binary").collect():
        table[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    hosts = np.zeros(1 << HOST_BITS, bool)
    hosts[[r[0] for r in numbers.select(F.shiftright("start", WORD_BITS).cast("int")).distinct().collect()]] = True
    return wide, table.ravel(), hosts


def _places(run: int, wide: int, table: np.ndarray, likely: np.ndarray):
    """(start, uid, place, inside, head) of the runs in the table, on pages of its hosts: a run's whole number and where it stands.

    ``inside`` is whether it is in the main part, ``head`` whether it begins a block of that, not a heading.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            hosts = batch.column("host").to_numpy()
            batch = batch.filter(pa.array(likely[hosts & ((1 << HOST_BITS) - 1)]))
            hosts, uid = (batch.column(c).to_numpy() for c in ("host", "uid"))
            mains, others, heads = [], [], []
            for k, page in enumerate(batch.column("html").to_pylist()):
                main, titles, rest, _ = _read(page)
                others.append("\n".join(rest))
                mains.append(main or "")
                at = 0
                for title, text in zip(titles, main.split("\n") if titles else (), strict=True):
                    n = text.count(" ") + 1
                    if not title and n >= run:
                        heads.append(k << 32 | at)
                    at += n
            for texts, inside in ((others, False), (mains, True)):
                for row, place, key, _ in _runs(pa.array(texts, pa.string()), hosts, run):
                    bit = key >> np.uint64(64 - WORD_BITS) & np.uint64((1 << wide) - 1)
                    hit = np.flatnonzero(table[bit >> np.uint64(3)] << (bit & np.uint64(7)).astype(np.uint8) & 128)
                    row, place, key = row[hit], place[hit], key[hit]
                    head = np.isin(row << 32 | place, heads) if inside else np.zeros(len(hit), bool)
                    columns = [pa.array(key.view(np.int64)), pa.array(uid[row]), pa.array(place, pa.int32()), pa.array([inside] * len(hit), pa.bool_()), pa.array(head)]
                    yield pa.RecordBatch.from_arrays(columns, names=["start", "uid", "place", "inside", "head"])

    return find


def _uncovered(words: list[str], covered: list[bool]) -> list[str]:
    """A block's words without covered stretches; one below ``LONG`` words goes only if it's all of the block."""
    kept, at = [], 0
    for hit, group in groupby(covered):
        n = len(list(group))
        if not hit or n < min(LONG, len(words)):
            kept += words[at : at + n]
        at += n
    return kept


def _without(others: list[str], chrome: list[bool], common: list[int], run: int) -> str:
    """The text of a page without a main part: what the runs that start at ``common`` leave of its blocks."""
    covered = {p + k for p in common for k in range(run)}
    at, left = 0, []
    for text, is_chrome in zip(others, chrome, strict=True):
        words = text.split(" ")
        kept = _uncovered(words, [k in covered for k in range(at, at + len(words))])
        at += len(words)
        if kept and not is_chrome:
            left.append(" ".join(kept))
    return "\n".join(left)


def _without_template(main: str, titles: list[bool], begins: set[int], common: set[int], run: int) -> tuple[str, int]:
    """A main part without blocks that begin at one of ``begins`` and that the runs at ``common`` cover whole; such runs in blocks that begin so."""
    at, left, n_runs = 0, [], 0
    for text, title in zip(main.split("\n"), titles, strict=True):
        n = text.count(" ") + 1
        covered = set()
        if not title and at in begins:
            covered = {p + k for p in range(at, at + n - run + 1) if p in common for k in range(run)}
            n_runs += sum(p in common for p in range(at, at + n))
        if len(covered) < n:
            left.append(text)
        at += n
    return "\n".join(left), n_runs


def _decided(run: int):
    """The pages' texts. ``around`` and ``within`` are the places of boilerplate, in main parts ``begins`` those that a block may begin with."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts, starts = [], []
            for main, titles, others, chrome, begins, around, within in zip(*(batch.column(c).to_pylist() for c in ("main", "titles", "others", "chrome", "begins", "around", "within")), strict=True):
                text, n = main, None
                if main is None:
                    text, n = _without(others, chrome, around or [], run), len(around or [])
                elif begins:
                    text, n = _without_template(main, titles, set(begins), set(within), run)
                texts.append(text)
                starts.append(n)
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(starts, pa.int64()), batch.column("repeated")]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "boilerplate", "repeated"])

    return decide


def _found(places: DataFrame, totals: DataFrame, least_pages: int, share: float) -> DataFrame:
    """(uid, begins, around, within, repeated) of the pages with repeated runs, from the places (start, uid, place, inside, head) and their pages."""

    def enough(rows: DataFrame, distinct: str = "body") -> DataFrame:
        """(start) of the rows that have enough different values of ``distinct`` for their host."""
        runs = rows.groupBy("start", "host").agg(F.count_distinct(distinct).alias("n")).join(totals, "host")
        return runs.filter((F.col("n") >= least_pages) & (F.col("n") >= share * F.col("pages"))).select("start")

    outside, heads, marked = places.filter("not inside"), places.filter("head"), places.filter("not open")
    beside = marked.filter("not inside")
    # begins boilerplate: outside of main parts, on pages whose own doesn't begin a block with it, and in different ones
    apart = beside.join(heads.select("start", "uid").distinct(), ["start", "uid"], "left_anti")
    template = settle(enough(heads, "story").intersect(enough(apart)), "template")
    where = {
        "begins": heads.join(template, "start", "left_semi"),
        "around": outside.filter("open").join(enough(outside), "start", "left_semi"),
        "within": marked.filter("inside").join(enough(beside), "start", "left_semi"),
        "repeated": places.join(enough(places), "start", "left_semi"),
    }
    rows = None
    for name, found in where.items():
        found = found.select("uid", F.lit(name).alias("name"), "inside", "place").distinct()
        rows = found if rows is None else rows.unionByName(found)
    kept = [F.collect_list(F.when(F.col("name") == c, F.col("place"))).alias(c) for c in ("begins", "around", "within")]
    return settle(rows.groupBy("uid").agg(*kept, F.count_if(F.col("name") == "repeated").alias("repeated")), "found")


def extract(pages: DataFrame, run: int = RUN, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, boilerplate, repeated): one row for each row of ``pages``.

    ``text`` has the page's blocks of main text in page order, joined by line feeds; character
    references are decoded and white space in a block is one space. It is empty if there is none
    (a null or empty page). Runs on ``least_pages`` and on ``share`` of the host's distinct pages
    decide the text, in a marked main part those that stand outside of main parts too (see the module); a
    host with fewer pages loses no repeated text. ``boilerplate`` counts the starts of such runs on a page, null where
    its main part is marked and has no block that begins with one. ``repeated`` counts on every page, in its main part and
    around it, the starts of runs that stand on enough pages, wherever in them. Markup that is cut off or badly nested ends with the page. Rows that repeat are
    one page for repetition. A null url is a host of its own. Other columns aren't looked at.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    read = read.withColumn("host", F.xxhash64(host)).withColumn("uid", F.xxhash64("page_id", "url", "html"))
    kinds = "page_id long, url string, host long, uid long, main string, titles array<boolean>, others array<string>, chrome array<boolean>"
    parsed = read.mapInArrow(_parsed, kinds)  # read twice, which is less than to keep it

    stream = F.array_join("others", "\n")
    words = lambda block: F.size(F.split(block, " "))
    article = F.filter("others", lambda block, k: ~F.get("chrome", k) & (words(block) >= run))
    body = F.when(F.size(article) > 0, F.array_join(article, "\n")).otherwise(stream)
    kind = F.when(F.col("main").isNull(), _OPEN).otherwise(_MARKED)
    story = F.xxhash64(F.array_max(F.transform(F.split("main", "\n"), lambda block: F.struct(F.length(block), block))))
    streams = parsed.select("host", "uid", stream.alias("stream"), "main", F.xxhash64(F.coalesce("main", body)).alias("body"), story.alias("story"), kind.alias("kind"))

    # counts of all runs, by numbers that may stand for several
    deep = min(WORD_BITS // 2, max(6, (pages.count() // PART_PAGES).bit_length()))
    counted = streams.mapInArrow(_counts(run, deep), "part int, host long, body long, story long, uid long, kind int, keys binary")
    written = counted.groupBy("part").applyInArrow(_often(least_pages, deep), "start long, n long, body long, story long, uid long, kind int")
    written = settle(written, "runs")
    about = written.filter(F.col("kind") != _RUN)
    about = about.select(F.col("start").alias("host"), "body", "story", "uid", (F.col("kind") == _OPEN).alias("open"))
    totals = settle(about.groupBy("host").agg(F.count_distinct("body").alias("pages")), "totals")
    needed = totals.groupBy(F.col("host").bitwiseAND((1 << HOST_BITS) - 1).alias("near")).agg(F.min(F.greatest(F.lit(float(least_pages)), share * F.col("pages"))).alias("least"))
    likely = written.filter(F.col("kind") == _RUN).join(needed, F.shiftright("start", WORD_BITS) == F.col("near"))
    likely = settle(likely.filter(F.col("n") >= F.col("least")).select("start"), "likely")

    # these exactly: where they stand, and on which pages
    places = read.mapInArrow(_places(run, *_table(likely)), "start long, uid long, place int, inside boolean, head boolean")
    places = settle(settle(places, "places").join(about.dropDuplicates(["uid"]), "uid"), "places")
    decided = parsed.join(_found(places, totals, least_pages, share), "uid", "left").withColumn("repeated", F.coalesce("repeated", F.lit(0).cast("long")))
    return decided.mapInArrow(_decided(run), "page_id long, url string, text string, boilerplate long, repeated long")
