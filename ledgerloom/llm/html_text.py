"""Main text of web pages, with boilerplate found by host suffix arrays.

1. **Blocks.**  Each page is cut into blocks at block-level tags.  Structure gives each block a kind: ``OUT`` inside menus, headers, footers,
   sidebars, forms, dialogs, scripts, styles, hidden elements and elements named as adverts, notices or comments (inside an article: named so and
   nothing else, so that a paragraph of class ``alert-level`` stays); ``MAIN`` inside an article or main element (and not inside one of those);
   ``OPEN`` elsewhere.
2. **Host suffix array.**  The token streams of *all* pages of a host, whatever their kinds, are concatenated and their suffixes sorted by prefix
   doubling to a depth of ``LONG`` tokens.  *Runs* are substrings of ``LONG`` tokens, and stretches of whole blocks of ``RUN`` tokens or
   more.  A run is boilerplate if it is found on a share of the host's distinct pages (one in ``SHARE``, ``PAGES`` at least), and fewer than half of
   these have it inside their article: structure decides what a passage that many pages repeat is, furniture or a quotation.
3. **Removal.**  Blocks of which boilerplate runs cover ``COVERED`` % or more go as a whole; inside articles long runs alone count, and stretches of blocks
   that half of the host's pages have.  All others stay whole.
   The ``MAIN`` blocks that are left, or the ``OPEN`` ones on a page without any ``MAIN`` block, in page order, joined by one space, are the main text.

Pages with the same blocks count as one, so a copied page is not boilerplate.

Tokens are dealt into *cells* of about ``PART_BYTES``.  A host of that size or less lies in one cell, which decides alone.  The pages of a larger
host are spread over cells by their row numbers (so no page, however often copied, makes a cell large), and counted over the whole host:

* cells agree by page digests which of them counts a page that several hold;
* a run on a share of a host's pages is on that share of the pages of at least one of its cells, so each cell *nominates* the runs
  that its suffix array finds on that share of its own pages;
* all cells of the host count the pages of the nominated runs, and the sums decide.  Results are the same for any size of cells.

Edge cases: a null or empty html, and a page without text, give an empty text; a null url is a host of its own; broken and
cut-off markup is read as far as it goes; repeated rows each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import _buckets as B
from ledgerloom.llm._storage import bounded_batches, written
from ledgerloom.llm._words import Words, mix, rolling, tidy

U64 = np.uint64
RUN, PAGES, PART_BYTES = 6, 3, 4 << 20
LONG, SHARE, COVERED = 20, 10, 90
OUT, OPEN, MAIN = 0, 1, 2
# Fixed values of HTML: elements whose content is no markup, never shown, or inline; and those that hold page furniture.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
NEVER = frozenset("head noscript template svg math canvas object audio video select button datalist map".split())
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NAMED = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay newsletter "
    "subscribe subscription signup sidebar widget related recommended share sharing social breadcrumb breadcrumbs menu nav navbar navigation masthead footer comment comments "
    "disqus respond reply replies pagination pager toolbar login search skip hidden".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
COMMENTS = frozenset("comment comments reply replies disqus respond".split())
# Words that say where an element stands, not what it is.
PLAIN = frozenset(
    "area bar block body bottom box button buttons card cell col column container content foot form group head holder icon icons inline inner item items js label left line link links list main "
    "message module outer page panel post posts right row section site slot social space stack story stories text title top unit view widget wrap wrapper zone".split()
)
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</[^a-zA-Z][^>]*>|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[\s_\-]+")
_END = re.compile(r"</([a-zA-Z][^\s/>]*)[\s>]")


def _named(names: str, known: frozenset[str], inside: bool) -> bool:
    """Does a class or an id name one of ``known``?  Inside an article only if it says nothing else: ``alert-box`` does, ``alert-level`` does not."""
    for name in names.split():
        parts = [p for p in _NAME.split(name) if p]
        if any(p in known for p in parts) and (not inside or all(p in known or p in NAMED or p in PLAIN for p in parts)):
            return True
    return False


def _furniture(tag: str, attributes: str, inside: bool = False) -> int:
    """Is an element page furniture by its attributes?  0: no; 1: by a name that may mislead; 2: surely.  ``inside``: it stands in an article."""
    if not attributes or attributes.isspace():
        return 0
    found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return 2
    if found.get("role") in ROLES:
        return 2
    names = found.get("class", "") + " " + found.get("id", "")
    if tag in ("body", "html", "main"):
        return 0
    if _named(names, COMMENTS, inside):
        return 2
    return int(tag != "article" and _named(names, NAMED, inside))


class _Open:
    """An element on the stack: its tag, whether it is out of the text, whether only by its name, and whether inside an article."""

    __slots__ = ("tag", "out", "named", "main")

    def __init__(self, tag: str, out: bool, named: bool, main: bool):
        self.tag, self.out, self.named, self.main = tag, out, named, main


def blocks(page: str) -> list[tuple[str, int]]:
    """Non-empty blocks of a page in order, each ``OUT``, ``OPEN`` or ``MAIN``."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    linked = total = 0
    stack = [_Open("", False, False, False)]
    links = at = 0
    lowered: str | None = None
    last_end: dict[str, int] | None = None  # where the last end tag of each name stands
    opened: dict[str, int] = {}  # elements on the stack by name, so that stray end tags cost nothing

    def close() -> None:
        nonlocal linked, total
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                top = stack[-1]
                kind = OUT if top.out else MAIN if top.main else OUT if 2 * linked > total else OPEN
                out.append((joined, kind))
            text.clear()
        linked = total = 0

    def add(piece: str) -> None:
        nonlocal linked, total
        text.append(piece)
        if links:
            linked += len(piece)
        total += len(piece)

    def push(element: _Open) -> None:
        stack.append(element)
        opened[element.tag] = opened.get(element.tag, 0) + 1

    def drop(i: int) -> None:
        for element in stack[i:]:
            opened[element.tag] -= 1
        del stack[i:]

    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                if len(stack) > 1 and stack[-1].tag == tag:
                    close()
                    drop(len(stack) - 1)
                continue
            close()
            for i in range(len(stack) - 1 if opened.get(tag) else 0, 0, -1):
                if stack[i].tag == tag:
                    drop(i)
                    break
                if stack[i].tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break  # a stray end tag does not end the article
            continue
        if tag in RAW:
            close()
            lowered = lowered or page.lower()
            end = lowered.find("</" + tag, at) if len(lowered) == len(page) else -1
            if end < 0:
                found = re.compile("</" + tag, re.I).search(page, at)
                end = found.start() if found else len(page)
            at = end
            continue
        if tag in VOID:
            if tag not in INLINE:
                close()
            continue
        named = _furniture(tag, m[3], stack[-1].main)
        if tag == "a":
            links += 1
        if tag in INLINE:
            if named and not m[3].rstrip().endswith("/"):
                close()
                push(_Open(tag, True, True, stack[-1].main))
            continue
        close()
        top = stack[-1]
        article = tag in ("article", "main")
        if article and not named and (not top.out or top.named):
            push(_Open(tag, False, False, True))  # an article counts even inside a block with a suspicious name
        elif tag in FURNITURE or tag in NEVER or named:
            if last_end is None:
                last_end = {m[1].lower(): m.start() for m in _END.finditer(page)}
            push(_Open(tag, last_end.get(tag, -1) >= at or top.out, named == 1 and tag not in FURNITURE and tag not in NEVER and (top.named or not top.out), top.main))
        elif tag not in ("p", "li", "dt", "dd", "option", "tr", "td", "th", "html", "body"):
            push(_Open(tag, top.out, top.named, top.main))
    close()
    return out


def suffix_groups(tokens: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts of the substrings of ``run`` tokens inside a page that occur twice or more, and the group of equal ones of each.

    ``tokens`` is the concatenation of the streams, ``page`` tells whose token it is (ascending).  Suffixes are ranked by prefix doubling; one whose
    prefix is unique is settled and takes no part in later steps.  After the last step equal ranks mean equal prefixes of ``run`` tokens.
    """
    none = np.zeros(0, np.int64)
    n = len(tokens)
    at = np.arange(n)
    key, depth = tokens, 1
    while len(at):
        order = np.argsort(key)
        ordered = key[order]
        first = np.r_[True, ordered[1:] != ordered[:-1]]
        group = np.cumsum(first) - 1
        often = np.bincount(group)[group] > 1
        rank = np.full(n, -1, np.int64)  # -1: settled
        rank[at[order[often]]] = group[often]
        if depth == run:
            kept = at[order[often]]
            return kept, np.unique(group[often], return_inverse=True)[1]
        step = min(depth, run - depth)
        at = np.sort(at[order[often]])
        at = at[at + depth + step <= n]
        at = at[(rank[at + step] >= 0) & (page[at + depth + step - 1] == page[at])]
        key = rank[at] * (n + 1) + rank[at + step]
        depth += step
    return none, none


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` tokens lie in one of the ranges."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, ends, -1)
    return np.cumsum(mark[:n]) > 0


def bar(distinct, pages: int = PAGES):
    """On how many of a host's distinct pages a run is boilerplate."""
    return np.maximum(pages, -(-np.asarray(distinct) // SHARE))


def block_runs(start: np.ndarray, end: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Shortest stretches ``(i, j)``, both included, of whole blocks of a page with ``run`` tokens or more, from each start and to each end."""
    each = np.arange(len(start))
    j = np.searchsorted(end, start + run)
    ahead = j < len(end)
    ahead[ahead] = page[j[ahead]] == page[ahead]
    i = np.searchsorted(start, end - run, "right") - 1
    back = i >= 0
    back[back] = page[i[back]] == page[back]
    pairs = np.unique(np.r_[each[ahead] * len(start) + j[ahead], i[back] * len(start) + each[back]])
    return pairs // max(1, len(start)), pairs % max(1, len(start))


class Cell:
    """Token streams of some pages: blocks, runs, and on how many pages runs are found.

    Columns of ``table``: ``row`` (a number), ``host``, ``parts``, ``text`` (blocks, one a line) and ``kinds`` (a byte for each block).
    """

    def __init__(self, table: pa.Table, run: int, long: int):
        tidy()
        table = table.combine_chunks().sort_by("row")
        self.table, self.run, self.long = table, run, long
        texts = table.column("text").to_pylist()
        w = Words(table.column("text").combine_chunks())
        self.n = w.n
        self.page = w.row_of()
        hosts = table.column("host").to_pylist()
        self.host_key = np.array([xxhash.xxh64_intdigest(h.encode("utf-8", "surrogatepass")) for h in hosts], np.uint64)
        self.names = dict(zip(self.host_key.tolist(), hosts))
        self.spread = table.column("parts").to_numpy() > 1
        self.kinds = np.frombuffer(b"".join(table.column("kinds").to_pylist()), np.uint8)
        counts = np.array([len(k) for k in table.column("kinds").to_pylist()], np.int64)
        self.block_page = np.repeat(np.arange(len(texts)), counts)
        # A block ends where its line does.
        self.tokens = mix(w.hashes() + self.host_key[self.page]) if w.n else np.zeros(0, np.uint64)
        opens = np.zeros(w.n, bool)
        opens[w.row[:-1][w.per_row > 0]] = True
        line = np.flatnonzero(w.raw == 10)
        opens[np.searchsorted(w.start, line)] = True
        self.start = np.flatnonzero(opens)
        self.end = np.r_[self.start[1:], w.n] if w.n else self.start
        main = np.repeat(self.kinds == MAIN, self.end - self.start)
        self._main = np.r_[0, np.cumsum(main)]
        self.stream = np.array([xxhash.xxh64_intdigest(k + t.encode("utf-8", "surrogatepass"), h) for t, k, h in zip(texts, table.column("kinds").to_pylist(), self.host_key.tolist())], np.uint64)
        self._runs()

    def _runs(self) -> None:
        """Every run of whole blocks and every long substring: hash, token range and page."""
        ended = self.tokens.copy()
        if self.n:
            ended[self.end - 1] = mix(ended[self.end - 1])
        i, j = block_runs(self.start, self.end, self.block_page, self.run)
        a, b = self.start[i], self.end[j]
        powers = np.multiply.accumulate(np.r_[U64(1), np.full(int((b - a).max(initial=0)), 0x9E3779B97F4A7C15, np.uint64)])
        size = b - a
        flat = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        terms = ended[np.repeat(a, size) + flat] * powers[flat]
        h = mix(np.add.reduceat(terms, np.cumsum(size) - size) + size.astype(np.uint64)) if len(a) else np.zeros(0, np.uint64)
        self.block_run = (h, a, b, self.page[a])
        at = np.flatnonzero(np.arange(self.n) + self.long <= np.searchsorted(self.page, self.page, "right")) if self.n else np.zeros(0, np.int64)
        self.long_run = (rolling(self.tokens, self.long)[at] if len(at) else np.zeros(0, np.uint64), at, at + self.long, self.page[at])

    def counted(self, lead: np.ndarray, only: np.ndarray | None, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Host key, hash, and pages of each run (and those that have it in their article); pages count that ``lead`` and are in ``pages``.

        Long substrings come from the suffix array, or with ``only`` (sorted hashes) are those asked for.
        """
        found = []
        for kind, (h, a, b, page) in enumerate((self.long_run, self.block_run)):
            if kind == 0 and only is None:
                inside = np.flatnonzero(pages[self.page]) if len(self.page) else self.page
                starts, group = suffix_groups(self.tokens[inside], self.page[inside], self.long)
                place = np.searchsorted(a, inside[starts])  # the long runs that repeat
                pick = np.unique(place)
            else:
                pick = np.arange(len(h)) if only is None else np.flatnonzero(_within(h, only))
            pick = pick[(lead & pages)[page[pick]]]
            found.append((h[pick], page[pick], self._main[b[pick]] - self._main[a[pick]] == b[pick] - a[pick]))
        h, page, main = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((~main, page, h))
        h, page, main = h[order], page[order], main[order]
        one = np.r_[True, (h[1:] != h[:-1]) | (page[1:] != page[:-1])] if len(h) else np.zeros(0, bool)
        h, page, main = h[one], page[one], main[one]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(h)])
        inside = np.add.reduceat(main.astype(np.int64), first) if len(h) else first
        return self.host_key[page[first]], h[first], count, inside

    def led(self, answers: pa.Table | None) -> np.ndarray:
        """Pages that count: the first with their blocks, here and (by the answers) among all cells."""
        lead = np.zeros(self.table.num_rows, bool)
        lead[np.unique(self.stream, return_index=True)[1]] = True
        if answers is not None and self.spread.any():
            keys = np.unique(self.stream[self.spread])
            mine = B.read_answers(answers, 1, np.uint8) > 0
            lead[self.spread] &= mine[np.searchsorted(keys, self.stream[self.spread])]
        return lead

    def totals(self, lead: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hosts of ``pages`` and their distinct pages here."""
        return np.unique(self.host_key[lead & pages], return_counts=True)

    def texts(self, hits: np.ndarray, common: np.ndarray) -> list[str]:
        """Main text of each page, where ``hits`` are the sorted hashes of boilerplate runs and ``common`` those on most pages of their host."""
        size = self.end - self.start

        def covers(*runs: tuple[tuple, np.ndarray]) -> np.ndarray:
            picked = [(a[pick], b[pick]) for (h, a, b, _), known in runs for pick in [_within(h, known)]]
            gone = np.r_[0, np.cumsum(covered(self.n, *(np.concatenate(x) for x in zip(*picked))))]
            return 100 * (gone[self.end] - gone[self.start]) >= COVERED * size

        # A sentence of an article that adverts on a few pages say too is no furniture.
        stays = ~np.where(self.kinds == MAIN, covers((self.long_run, hits), (self.block_run, common)), covers((self.long_run, hits), (self.block_run, hits)))
        first = np.searchsorted(self.block_page, np.arange(self.table.num_rows + 1))
        out = []
        for k, text in enumerate(self.table.column("text").to_pylist()):
            i, j = int(first[k]), int(first[k + 1])
            kind = MAIN if MAIN in self.kinds[i:j] else OPEN
            out.append(" ".join(t for t, stay, c in zip(text.split("\n"), stays[i:j].tolist(), self.kinds[i:j].tolist()) if stay and c == kind))
        return out


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def furniture(hosts: np.ndarray, hashes: np.ndarray, count: np.ndarray, inside: np.ndarray, known: np.ndarray, distinct: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the boilerplate runs, and of those on half of their host's pages; ``known`` are sorted host keys with their ``distinct`` pages."""
    if not len(hashes):
        return hashes, hashes
    of = distinct[np.searchsorted(known, hosts)]
    due = (count >= bar(of, pages)) & (2 * inside < count)
    return np.unique(hashes[due]), np.unique(hashes[due & (2 * count >= of)])


def leaders(keys: np.ndarray, _: bytes, owner: np.ndarray) -> np.ndarray:
    """Per key: is its cell the first of those that hold it?"""
    order = np.lexsort((owner, keys))
    out = np.zeros(len(keys), np.uint8)
    out[order[np.r_[True, np.diff(keys[order]) != 0]]] = 1
    return out


def host(url: Column) -> Column:
    """Host of a URL, lower case; null and a URL without one give what stands in its place."""
    rest = F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), "(?s)^.*?://", "")
    return F.lower(F.regexp_replace(F.regexp_extract(rest, "(?s)^[^/?#]*", 0), "(?s)^.*@", ""))


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace ``html`` by its blocks, one a line, and their kinds."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [blocks(h.as_py()) for h in part.column("html")]
            rest = [c for c in part.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in rest], pa.array(["\n".join(t for t, _ in b) for b in found], pa.string()), pa.array([bytes(k for _, k in b) for b in found], pa.binary())], names=[*rest, "text", "kinds"]
            )


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, min_pages: int = PAGES, part_bytes: int | None = None, long: int = LONG) -> DataFrame:
    """One row per page: ``id_col, url, text, n_chars``."""
    bounded_batches(pages.sparkSession)
    url = F.col(f"`{url_col}`").cast("string")
    inner = pages.select(F.col(f"`{id_col}`").alias("id"), url.alias("url"), host(url).alias("host"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    sizes = inner.groupBy("host").agg(F.sum(F.octet_length("html")).alias("size"))
    total = int(sizes.agg(F.sum("size")).first()[0] or 0)
    part = part_bytes or B.grown(total, PART_BYTES, 128 << 20)
    cells = max(8, math.ceil(2 * total / part))
    # Hosts above the size of a part are total / part at most: a few MB unless there are millions, which are joined without a hint.
    large = written(sizes.where(F.col("size") > part).select("host", F.ceil(F.col("size") / part).cast("int").alias("parts")), "large-hosts")
    large = F.broadcast(large) if total // part < 1_000_000 else large
    kind = inner.schema["id"].dataType
    numbered = inner.withColumn("row", F.monotonically_increasing_id())
    shape = T.StructType().add("id", kind).add("url", "string").add("host", "string").add("row", "long").add("text", "string").add("kinds", "binary")
    rows = numbered.mapInArrow(parsed, shape).join(large, "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cell = lambda k: F.pmod(F.pmod(F.xxhash64("host"), F.lit(cells)) + k, F.lit(cells)).cast("int")  # noqa: E731  a host's parts lie side by side
    dealt = rows.withColumn("cell", cell(F.pmod(F.xxhash64("row"), "parts"))).repartition(cells, "cell")
    grouped = dealt.groupBy("cell")
    blocks_ = B.block_count(total // 64)
    nominee = T.StructType().add("host", "string").add("hash", "long").add("n", "long").add("inside", "long")
    empty = lambda shape: pa.table([pa.array([], t) for t in shape.values()], names=list(shape))
    run_shape = {"host": pa.string(), "hash": pa.int64(), "n": pa.int64(), "inside": pa.int64()}

    def ask(table: pa.Table) -> pa.Table:
        """Digests of the pages of large hosts."""
        if not (table.column("parts").to_numpy() > 1).any():
            return pa.Table.from_batches([B.ask(1, 0, np.zeros(0, np.uint64), None, blocks_)])
        cell = Cell(table, run, long)
        return pa.Table.from_batches([B.ask(1, table.column("cell")[0].as_py(), np.unique(cell.stream[cell.spread]), None, blocks_)])

    def as_rows(cell: Cell, hosts, hashes, n, inside) -> pa.Table:
        return pa.table([pa.array([cell.names[h] for h in hosts.tolist()], pa.string()), pa.array(hashes.view(np.int64)), pa.array(n), pa.array(inside)], names=list(run_shape))

    def nominate(table: pa.Table, answers: pa.Table) -> pa.Table:
        """Runs on a share of this cell's pages of their host; a row of hash 0 and ``inside`` -1 has the number of pages."""
        if not table.num_rows or not (table.column("parts").to_numpy() > 1).any():
            return empty(run_shape)
        cell = Cell(table, run, long)
        lead = cell.led(answers)
        hosts, pages_here = cell.totals(lead, cell.spread)
        of, h, n, inside = cell.counted(lead, None, cell.spread)
        due = n >= bar(pages_here, 1)[np.searchsorted(hosts, of)] if len(of) else np.zeros(0, bool)
        return pa.concat_tables([as_rows(cell, of[due], h[due], n[due], inside[due]), as_rows(cell, hosts, np.zeros(len(hosts), np.uint64), pages_here.astype(np.int64), np.full(len(hosts), -1))])

    def count(table: pa.Table, asked: pa.Table) -> pa.Table:
        """Pages of the nominated runs in this cell."""
        rounds = asked.column("kind").to_numpy()
        if not table.num_rows or not (rounds == 2).any():
            return empty(run_shape)
        cell = Cell(table, run, long)
        only = np.unique(asked.column("hash").to_numpy()[rounds == 2].view(np.uint64))
        return as_rows(cell, *cell.counted(cell.led(asked), only, cell.spread))

    def finish(table: pa.Table, hits: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in out_arrow.types], schema=out_arrow)
        cell = Cell(table, run, long)
        own = ~cell.spread
        lead = cell.led(None)
        known, distinct = cell.totals(lead, own)
        here, most = furniture(*cell.counted(lead, None, own), known, distinct, min_pages)
        there = hits.column("hash").to_numpy().view(np.uint64)
        common = hits.column("common").to_numpy(zero_copy_only=False).astype(bool)
        texts = cell.texts(np.union1d(here, there), np.union1d(most, there[common]))
        return pa.table([cell.table.column("id"), cell.table.column("url"), pa.array(texts, pa.string())], schema=out_arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType().add("id", kind).add("url", "string").add("text", "string")
    out_arrow = to_arrow_schema(out)
    one = B.answered(grouped.applyInArrow(ask, B.ASK), leaders)
    nominated = grouped.cogroup(one.groupBy("bucket")).applyInArrow(nominate, nominee)
    # Cells of a large host: one row for each of its parts.
    at = large.select("host", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)).alias("k")).select("host", cell(F.col("k")).alias("cell")).distinct()
    wanted = nominated.where("inside >= 0").select("host", "hash").distinct().join(at, "host").select("cell", "hash", F.lit(2).alias("kind"))
    asked = one.select(F.col("bucket").alias("cell"), "round", "block", "answer", F.lit(0).cast("bigint").alias("hash"), F.lit(1).alias("kind")).unionByName(wanted, allowMissingColumns=True)
    counted = grouped.cogroup(asked.groupBy("cell")).applyInArrow(count, nominee)
    distinct = nominated.where("inside < 0").groupBy("host").agg(F.sum("n").alias("pages"))
    sums = counted.groupBy("host", "hash").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside")).join(distinct, "host")
    due = sums.where((F.col("n") >= F.greatest(F.lit(min_pages), F.ceil(F.col("pages") / SHARE))) & (2 * F.col("inside") < F.col("n")))
    hits = due.select("host", "hash", (2 * F.col("n") >= F.col("pages")).alias("common")).join(at, "host").select("cell", "hash", "common")
    done = grouped.cogroup(hits.groupBy("cell")).applyInArrow(finish, out)
    return done.select(F.col("id").alias(id_col), F.col("url").alias("url"), "text", F.length("text").cast("bigint").alias("n_chars"))
