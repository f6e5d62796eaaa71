"""Main text of web pages by nearest-URL page differencing.

A page is read into lines (the texts of its blocks, in order), each with a zone:
``main`` inside an article or main element, ``dropped`` inside menus, headers,
footers, sidebars, forms, notices, adverts, comments and the like, ``open``
elsewhere.  The pages of a host are sorted by URL path; each path is paired with
the nearest other one (the path before or behind that has more characters in
common at the start), and the lines of both are aligned by their longest common
subsequence.  Shared lines are the site's, not the page's, and are deleted.

Every page of every host is paired and aligned.  Its zones break ties only:

* lines of a main zone are protected, since neighbouring articles do share
  paragraphs (licences, copied passages) and an article is to stay whole;
* menus, adverts and the like that differ from page to page, which no alignment
  can find, go by their dropped zone;
* a pair that shares nearly all of its text is one text under two paths, and a
  page that shares no line at all has no template to compare with: where such a
  page has a main zone, its open lines aren't part of the article.

Null and empty html give an empty text.  A null url has no host: such pages all
have the same, empty path.  Several rows of one URL path are one page in the
order of paths; the one with the least html hash stands for it, and all of them
lose the lines that it shares with the neighbour.  Repeated rows all get their
result.  A carried column named like a result's gets ``in_`` before its name.
"""

from __future__ import annotations

import functools
import html as html_lib
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import carried, materialize, small_batches, tidy
from docweave.llm.url_cascade import split_url

MAIN, OPEN, DROPPED = 1, 2, 3
#: Share of its text that a page may have in common with its neighbour before both count as one text.
MIRROR_SHARE = 0.8
#: Equal pairs of lines that are held at once.
MOST_PAIRS = 1_000_000
#: Lines of distinct paths that a task holds while it merges rows of one path.
MERGE_LINES = 500_000
#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template iframe svg math object canvas audio video head title textarea select option".split())
#: Elements around text that isn't the article's.
ASIDE = frozenset("nav footer aside form menu dialog button label fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of class, id and role names that mark text which isn't the article's.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets footer header masthead topbar toolbar "
    "comment comments commentlist disqus respond replies reply share sharing social related recommended newsletter subscribe subscription signup login search pagination pager complementary contentinfo".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_CAMEL = re.compile(r"([a-z])([A-Z])")


def marked(attributes: str) -> bool:
    """True if a class, id or role holds a marked word."""
    if "=" not in attributes:
        return False
    for groups in _NAMES.findall(attributes):
        name = _CAMEL.sub(r"\1-\2", "".join(groups)).lower()
        if any(p in MARKED for p in _PARTS.split(name)):
            return True
    return False


@functools.lru_cache(maxsize=4096)
def _end_tag(name: str) -> re.Pattern:
    return re.compile(f"</{re.escape(name)}", re.I | re.A)


def read_lines(page: str) -> list[tuple[int, str]]:
    """(zone, line) of each block with a visible character."""
    lines: list[tuple[int, str]] = []
    piece: list[str] = []
    zone_of: list[tuple[str, int]] = []  # open elements that change the zone
    depth = {MAIN: 0, DROPPED: 0}
    at = 0

    def close() -> None:
        if piece:
            text = " ".join(html_lib.unescape("".join(piece)).split())
            if text:
                lines.append((DROPPED if depth[DROPPED] else MAIN if depth[MAIN] else OPEN, text))
            piece.clear()

    size = len(page)
    ends: dict[str, int] = {}

    def ends_behind(name: str) -> int:
        """Where the name's next end tag begins; the page's length if there is none."""
        if ends.get(name, -1) < at:
            m = _end_tag(name).search(page, at)
            ends[name] = m.start() if m else size
        return ends[name]

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            piece.append(page[at:])
            break
        if m.start() > at:
            piece.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE and name not in ("img", "input"):
            if m[3] and not m[1] and marked(m[3]):
                close()
                zone_of.append((name, DROPPED))
                depth[DROPPED] += 1
            elif m[1] and zone_of and zone_of[-1][0] == name:
                close()
                depth[zone_of.pop()[1]] -= 1
            elif not m[1] and zone_of and zone_of[-1][0] == name:
                zone_of.append((name, zone_of[-1][1]))  # nested in a marked one of its kind
                depth[zone_of[-1][1]] += 1
            continue
        close()
        if m[1]:
            held = next((i for i in range(len(zone_of) - 1, -1, -1) if zone_of[i][0] == name), None)
            if held is not None:
                for _, zone in zone_of[held:]:
                    if zone:
                        depth[zone] -= 1
                del zone_of[held:]
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name in RAW:
            end = ends_behind(name)
            at = end if end < size or name in ("script", "style") else at
            continue
        zone = MAIN if name in ("article", "main") else DROPPED if name in ASIDE or (name == "header" and not depth[MAIN]) or (name not in ("html", "body") and marked(m[3])) else 0
        if zone == MAIN and depth[DROPPED]:
            # an article in a dropped element that was never closed before it ends the element
            if not any(ends_behind(n) < size for n, z in zone_of if z == DROPPED):
                zone_of = [(n, z) for n, z in zone_of if z != DROPPED]
                depth[DROPPED] = 0
        if zone or any(n == name for n, _ in zone_of):
            zone_of.append((name, zone))
            if zone:
                depth[zone] += 1
    close()
    return lines


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence with b.

    Equal starts and ends are taken first.  What is left is chained from its
    equal pairs (Hunt and Szymanski, 1977); where those are over ``MOST_PAIRS``, as
    among thousands of equal lines, it is halved first (Hirschberg, 1975) by
    bit-parallel lengths, so that neither time nor memory grows with the pairs.
    """
    found: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            found.add(lo)
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            found.add(hi)
        where: dict[int, list[int]] = {}
        for j in range(low, high):
            where.setdefault(b[j], []).append(j)
        pairs = sum(len(where.get(a[i], ())) for i in range(lo, hi))
        if pairs <= MOST_PAIRS:
            found |= _chain(a, lo, hi, where)
        elif hi - lo == 1:
            found.add(lo)
        else:
            mid = (lo + hi) // 2
            ahead = _lengths(a[lo:mid], b[low:high])
            back = _lengths(a[mid:hi][::-1], b[low:high][::-1])[::-1]
            cut = low + int((ahead + back).argmax())
            todo += [(lo, mid, low, cut), (mid, hi, cut, high)]
    return found


def _chain(a: list[int], lo: int, hi: int, where: dict[int, list[int]]) -> set[int]:
    tails: list[int] = []
    links: list[tuple] = []
    for i in range(lo, hi):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            elif j < tails[k]:
                tails[k] = j
                links[k] = link
    found, link = set(), links[-1] if links else None
    while link is not None:
        found.add(link[0])
        link = link[1]
    return found


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a with each start of b, from none of it to all (Hyyro, 2004)."""
    n = len(b)
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    masks: dict[int, int] = {}
    full = row = (1 << n) - 1
    for x in a:
        if x not in where:
            continue
        mask = masks.get(x)
        if mask is None:
            raw = bytearray(n // 8 + 1)
            for j in where[x]:
                raw[j >> 3] |= 1 << (j & 7)
            mask = int.from_bytes(raw, "little")
            if len(where[x]) > 16:  # so few are held that all are smaller than b's pairs
                masks[x] = mask
        hit = row & mask
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), count=n, bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def line_hash(line: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def page_text(texts: list[str], zones: bytes, hashes: list[int], template: list[int] | None) -> tuple[str, int]:
    """(the page's text, number of lines shared with the neighbour).

    texts: of the lines that aren't dropped; zones and hashes: of all lines, in
    order; template: hashes of the lines that the page's path shares.
    """
    shared = shared_lines(hashes, template) if template else set()
    at = [i for i, z in enumerate(zones) if z != DROPPED]
    common = sum(len(s) for i, s in zip(at, texts, strict=True) if i in shared)
    alike = common > MIRROR_SHARE * sum(map(len, texts))
    takes_open = MAIN not in zones or (bool(shared) and not alike)
    kept = [s for i, s in zip(at, texts, strict=True) if zones[i] == MAIN or (takes_open and (alike or i not in shared))]
    return " ".join(kept), len(shared)


def main_text(lines: list[tuple[int, str]], neighbour: list[tuple[int, str]] | None = None) -> str:
    """The text of one page beside one neighbour, both as of ``read_lines``."""
    hashes = [line_hash(s) for _, s in lines]
    other = [line_hash(s) for _, s in neighbour or ()]
    template = [hashes[i] for i in sorted(shared_lines(hashes, other))]
    return page_text([s for z, s in lines if z != DROPPED], bytes(z for z, _ in lines), hashes, template)[0]


def _numbers(raw: bytes) -> list[int]:
    return array("q", raw).tolist()


def template_of(path: tuple, before: tuple | None, behind: tuple | None) -> bytes:
    """The line hashes that a path shares with the nearer of two others; each is (host, path, hashes) or None, hosts must agree."""
    sides = [x for x in (before, behind) if x is not None and x[0] == path[0]]
    if not sides:
        return b""
    near = max(sides, key=lambda x: len(commonprefix([path[1], x[1]])))  # of equal ones the first
    own = _numbers(path[2])
    return array("q", [own[i] for i in sorted(shared_lines(own, _numbers(near[2])))]).tobytes()


def path_lines(pages: DataFrame, url: str, html: str) -> DataFrame:
    """host, path, digest and line hashes: rows of one path are merged where they arise, so few of them move."""
    host, path = split_url(F.col(url))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def flush(held: dict) -> pa.RecordBatch:
            rows = [(h, p, d, raw) for (h, p), (d, raw) in held.items()]
            names = ["host", "path", "digest", "hashes"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.binary()))], names=names)

        held: dict[tuple[str, str], tuple[int, bytes]] = {}
        size = 0
        for batch in batches:
            for host, path, digest, page in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "digest", "html")), strict=True):
                known = held.get((host, path))
                if known is None or digest < known[0]:
                    held[host, path] = digest, (raw := array("q", [line_hash(s) for _, s in read_lines(page)]).tobytes())
                    size += 1 + len(raw) // 8
            if size > MERGE_LINES:
                yield flush(held)
                held, size = {}, 0
        if held:
            yield flush(held)

    rows = pages.select(host.alias("host"), path.alias("path"), F.xxhash64(F.col(html)).alias("digest"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    small_batches(pages.sparkSession)
    return rows.mapInArrow(tidy(run), "host string, path string, digest long, hashes binary")


def templates(lines: DataFrame) -> DataFrame:
    """(host, path, template): the hashes of the lines that each path shares with its nearest neighbour, where there are any.

    Paths are sorted over all hosts by ranges, so a large host is spread, and
    each task aligns its paths as they pass.  The first and last path of a range
    wait for the ranges beside it; only these meet in one place.
    """
    ranged = lines.repartitionByRange("host", "path").sortWithinPartitions("host", "path", "digest")
    schema = "host string, path string, template binary, range int, side int, hashes binary, near_path string, near_hashes binary"

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in schema.split(", ")]
        held: list[tuple[str, str, bytes]] = []  # up to three paths that follow each other
        first = None
        edge = lambda side, own, near: (own[0], own[1], None, number, side, own[2], *(near[1:] if near and near[0] == own[0] else (None, None)))
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "hashes")), strict=True):
                if held and held[-1][:2] == row[:2]:
                    continue  # the path's least digest has come
                held.append(row)
                if len(held) == 2 and first is None:
                    first = edge(0, held[0], row)
                    out.append(first)
                elif len(held) == 3:
                    if template := template_of(held[1], held[0], held[2]):
                        out.append((*held[1][:2], template, None, None, None, None, None))
                    del held[0]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)
        if held:
            out = [edge(1, held[-1], held[-2]) if len(held) > 1 else edge(2, held[0], None)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)

    walked = materialize(ranged.mapInArrow(walk, schema), "templates")
    # the ends of the ranges: two rows for each range, whatever the number of pages
    order = Window.orderBy("range", "side")
    there = F.struct("host", "path", "hashes")
    own = F.when(F.col("near_path").isNotNull(), F.struct("host", F.col("near_path").alias("path"), F.col("near_hashes").alias("hashes")))
    ends = walked.where("side is not null").select("host", "path", "hashes", F.when(F.col("side") == 1, own).otherwise(F.lag(there).over(order)).alias("before"), F.when(F.col("side") == 0, own).otherwise(F.lead(there).over(order)).alias("behind"))

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            made = [template_of((r["host"], r["path"], r["hashes"]), *(tuple(r[c].values()) if r[c] else None for c in ("before", "behind"))) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("path"), pa.array(made, pa.binary())], names=["host", "path", "template"])

    met = ends.mapInArrow(meet, "host string, path string, template binary").where(F.length("template") > 0)
    return walked.where("side is null").select("host", "path", "template").unionByName(met)


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """keep columns, text, n_lines and n_shared (lines, and those that the neighbour has too) of every row.

    The html is read twice, first for its lines' hashes.  What may be a page's
    text, packed, meets the lines that its path shares by a key of the row; a
    table of shared lines under the session's broadcast threshold goes to the
    pages instead, as Spark decides from the written table's size.
    """
    keep = [c for c in pages.columns if c != html] if keep is None else keep
    host, path = split_url(F.col(url))
    near = templates(path_lines(pages, url, html))
    # 128 bits name a row
    row_key = [F.xxhash64(F.col(url), F.xxhash64(F.col(html))).alias("key"), F.xxhash64(F.lit(1), F.col(html), F.col(url)).alias("key2")]
    keys = pages.select(*row_key, host.alias("host"), path.alias("path"))
    wanted = materialize(keys.join(near, ["host", "path"]).select("key", "key2", "template").dropDuplicates(["key", "key2"]), "page-templates")  # a key has one path
    held = {c: f"k_{i}" for i, c in enumerate(keep)}
    rows = pages.select(*[F.col(f"`{c}`").alias(k) for c, k in held.items()], F.coalesce(F.col(html), F.lit("")).alias("html"), *row_key)
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name in held.values())

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            packed, zones, hashes = [], [], []
            for x in batch.column("html").to_pylist():
                lines = read_lines(x)
                packed.append(zlib.compress("\n".join(s for z, s in lines if z != DROPPED).encode("utf-8", "surrogatepass"), 1))
                zones.append(bytes(z for z, _ in lines))
                hashes.append(array("q", [line_hash(s) for _, s in lines]).tobytes())
            names = [n for n in batch.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(x, pa.binary()) for x in (packed, zones, hashes))], names=[*names, "packed", "zones", "hashes"])

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, shared = [], []
            for packed, zones, hashes, template in zip(*(batch.column(c).to_pylist() for c in ("packed", "zones", "hashes", "template")), strict=True):
                own = zlib.decompress(packed).decode("utf-8", "replace")
                text, n = page_text(own.split("\n") if own else [], zones, _numbers(hashes), _numbers(template or b""))
                texts.append(text)
                shared.append(n)
            lines = pa.array([len(z) for z in batch.column("zones").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in held.values()), pa.array(texts, pa.string()), lines, pa.array(shared, pa.int64())], names=[*held.values(), "m_text", "m_lines", "m_shared"])

    parsed = rows.mapInArrow(tidy(read), f"{kept}key long, key2 long, packed binary, zones binary, hashes binary")
    out = parsed.join(wanted, ["key", "key2"], "left").mapInArrow(tidy(join), f"{kept}m_text string, m_lines long, m_shared long")
    names = carried(keep, ["text", "n_lines", "n_shared"])
    return out.select(*[F.col(k).alias(names[c]) for c, k in held.items()], F.col("m_text").alias("text"), F.col("m_lines").alias("n_lines"), F.col("m_shared").alias("n_shared"))
