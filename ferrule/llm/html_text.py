"""Main text of web pages by differencing against the page with the nearest URL.

Pages are cut into lines (blocks of text) with the zone each stands in. Within
a host, pages are sorted by URL path; neighbours in that order are aligned by
the longest common subsequence of their lines, and each page is differenced
against the neighbour with the longer common path. A page that has all lines of
this one that could be text is a copy, which would delete everything: the
neighbours are the nearest pages on either side that are no copies. Shared lines
are deleted, except inside an article or main element, whose lines may recur and
are text all the same. Elements that are menus, headers,
footers, sidebars, notices, adverts, forms or comments by name are dropped as
well; where a page has an article or main element with words, only those count.

The order is cut into ranges for tasks; pages whose neighbour isn't in their own
range look for it in the next ones, so that the result doesn't depend on the cuts.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm._common import stage

#: HTML elements by what they do here.
DROPPED = frozenset("nav header footer aside form script style noscript template svg iframe button select textarea dialog title head".split())
MAIN = frozenset(("article", "main"))
NESTED = frozenset("div section article main nav header footer aside form ul ol table figure dialog noscript template svg iframe select button head body details fieldset".split())
BLOCKS = NESTED | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd dl tr td th thead tbody pre blockquote figcaption hr br address caption option html title summary legend".split())
RAW = frozenset(("script", "style", "textarea", "title"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Which starts of elements end an open one that has no end tag.
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
#: Names (class, id or role) of what isn't text: words that stand alone or begin a name, words that are a whole name, and their usual compounds.
_COMMENTS = r"comments?(?:[-_][\w-]*)?|disqus[\w-]*|repl(?:y|ies)|respond"
_NAMED = re.compile(
    rf"(?:^|\s)(?:(?:ads?|advert\w*|sponsor\w*|cookies?|consent|sidebar|newsletter|breadcrumbs?|popup|subscribe|masthead|promo)(?:[-_][\w-]*)?|{_COMMENTS}"
    r"|(?:notices?|banner|menu|nav|navbar|navigation|footer|header|share|social|related|modal|contentinfo|complementary|search|side-bar)"
    r"|(?:site|page|global|main|top|bottom|primary|secondary|user)[-_](?:header|footer|nav|navigation|menu|banner|notice|bar)|nav[-_](?:bar|menu|links?|list)|menu[-_](?:bar|list|items?)"
    r"|related[-_](?:posts?|articles?|links?|stories|content)|(?:share|social)[-_](?:bar|buttons?|links?|icons?|media|share)|(?:cookie|privacy|gdpr)[-_]\w+[\w-]*)(?=$|\s)",
    re.I,
)
_COMMENT = re.compile(rf"(?:^|\s)(?:{_COMMENTS})(?=$|\s)", re.I)
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PLAIN, INSIDE, OUT = 0, 1, 2


def _matches(pattern: re.Pattern, attributes: str) -> bool:
    return bool(attributes) and any(pattern.search(v) for a in _ATTRIBUTE.findall(attributes) for v in a if v)


def lines(page: str) -> tuple[list[str], list[int]]:
    """Lines of a page in order, and their zones: PLAIN, INSIDE an article or main element, or OUT.

    Elements of every kind are OUT by their names, inline ones too, whose text
    goes without a break; an article or main element is OUT only as a comment.
    """
    texts, zones = [], []
    stack: list[tuple[str, int, int]] = []  # name, zone and muting before it
    pieces: list[str] = []
    zone, muted = PLAIN, 0

    def close() -> None:
        nonlocal pieces
        if pieces:
            line = " ".join(html.unescape("".join(pieces)).split())
            if line:
                texts.append(line)
                zones.append(zone)
            pieces = []

    at, size = 0, len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        if m is None:
            if not muted:
                pieces.append(page[at:])
            break
        if m.start() > at and not muted:
            pieces.append(page[at : m.start()])
        at = m.end()
        name = m[2].lower() if m[2] else ""
        block = name in BLOCKS or name in RAW
        if block:
            close()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    _, zone, muted = stack[k]
                    del stack[k:]
                    break
                if not block and stack[k][0] in BLOCKS:
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if not name or name in VOID or m[3].endswith("/"):
            continue
        if block and stack and name in ENDED_BY.get(stack[-1][0], ()):
            _, zone, muted = stack.pop()
        named = zone != OUT and not muted and (_matches(_COMMENT if name in MAIN else _NAMED, m[3]) if name not in ("body", "html") else False)
        if block:
            if name in NESTED or named:
                stack.append((name, zone, muted))
                if zone != OUT:
                    zone = OUT if name in DROPPED or named else INSIDE if name in MAIN else zone
        elif named or muted:
            stack.append((name, zone, muted))
            muted += 1
    close()
    return texts, zones


def common_lines(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places in ``a`` and in ``b`` of a longest common subsequence (matches by line, longest rising chain)."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    where = defaultdict(list)
    for j in range(len(b) - end - 1, start - 1, -1):
        where[b[j]].append(j)
    tails: list[int] = []
    ends: list[tuple] = []
    for i in range(start, len(a) - end):
        for j in where.get(a[i], ()):
            at = bisect_left(tails, j)
            link = (i, j, ends[at - 1] if at else None)
            tails[at : at + 1], ends[at : at + 1] = [j], [link]
    chain, node = [], ends[-1] if ends else None
    while node:
        chain.append(node[:2])
        node = node[2]
    chain.reverse()
    mine = [*range(start), *(i for i, _ in chain), *range(len(a) - end, len(a))]
    theirs = [*range(start), *(j for _, j in chain), *range(len(b) - end, len(b))]
    return mine, theirs


def _near(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _wanted(page: str) -> tuple[list[str], list[int] | None]:
    """Lines that may be text: those of articles (places None: all stay), or of pages without one, with their places."""
    texts, zones = lines(page)
    if INSIDE in zones:
        return [t for t, z in zip(texts, zones, strict=True) if z == INSIDE], None
    places = [k for k, z in enumerate(zones) if z == PLAIN]
    return [texts[k] for k in places], places


def _signed(line: str) -> int:
    h = xxhash.xxh64_intdigest(line)
    return h - (1 << 64) if h >> 63 else h


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, plain = [], []
        for texts, zones in map(lines, batch.column(4).to_pylist()):
            hashes.append([_signed(t) for t in texts])
            plain.append([] if INSIDE in zones else sorted({h for h, z in zip(hashes[-1], zones, strict=True) if z == PLAIN}))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hashes, pa.list_(pa.int64())), pa.array(plain, pa.list_(pa.int64()))], names=["id", "key", "host", "path", "hashes", "plain"])


def _copied(page: dict, other: dict) -> bool:
    """Whether ``other`` has every line of ``page`` that could be text."""
    return bool(page["plain"]) and (page["plain"] == other["plain"] or set(page["plain"]) <= set(other["hashes"]))


def _pair(page: dict, other: dict) -> dict:
    """What a page shares with a neighbour of its host."""
    return {"id": page["id"], "key": page["key"], "near": _near(page["path"], other["path"]), "other": other["key"], "shared": common_lines(page["hashes"], other["hashes"])[0]}


def _asking(page: dict, where: int, step: int) -> dict:
    return {k: page[k] for k in ("id", "key", "host", "path", "hashes", "plain")} | {"range": where, "step": step}


def _within(pages: list[dict], step: int) -> list[dict]:
    """Pairs with the nearest page in one direction that is no copy; pages that reach the end of the range ask on."""
    out, size = [], len(pages)
    goal = [0] * size
    for i in range(size - 1, -1, -1) if step > 0 else range(size):
        page, j = pages[i], i + step
        while 0 <= j < size and pages[j]["host"] == page["host"] and _copied(page, pages[j]):
            j = goal[j] if pages[j]["plain"] == page["plain"] else j + step
        goal[i] = j
        if not 0 <= j < size:
            out.append(_asking(page, page["range"], step))
        elif pages[j]["host"] == page["host"]:
            out.append(_pair(page, pages[j]))
    return out


def _compare_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of a sorted range, numbered, then their pairs and what they ask of other ranges."""
    from pyspark import TaskContext

    part, pages = TaskContext.get().partitionId(), []
    for batch in batches:
        rows = [p | {"range": part, "place": len(pages) + k} for k, p in enumerate(batch.to_pylist())]
        pages += rows
        yield pa.RecordBatch.from_pylist(rows, _FOUND)
    for step in (1, -1):
        out = _within(pages, step)
        for k in range(0, len(out), 1000):
            yield pa.RecordBatch.from_pylist(out[k : k + 1000], _FOUND)


def _compare_next(asks: pa.Table, there: pa.Table) -> pa.Table:
    """Pairs of asking pages with the pages of one further range; pages that are through it ask on."""
    pages, out, known = sorted(there.to_pylist(), key=lambda p: p["place"]), [], {}
    for page in asks.to_pylist() if pages else ():
        step, same = page["step"], (page["step"], page["host"], tuple(page["plain"]))
        j = known.get(same)
        if j is None:
            j = 0 if step > 0 else len(pages) - 1
            while 0 <= j < len(pages) and pages[j]["host"] == page["host"] and _copied(page, pages[j]):
                j += step
            known[same] = j
        if not 0 <= j < len(pages):
            out.append(_asking(page, pages[0]["range"], step))
        elif pages[j]["host"] == page["host"]:
            out.append(_pair(page, pages[j]))
    return pa.Table.from_pylist(out, _FOUND)


_PAIRS = ["id", "key", "near", "other", "shared"]
_FOUND = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("near", pa.int64()), ("other", pa.int64()), ("shared", pa.list_(pa.int32())), ("range", pa.int32()), ("step", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("hashes", pa.list_(pa.int64())), ("plain", pa.list_(pa.int64())), ("place", pa.int32())])
_FOUND_SQL = "id long, key long, near long, other long, shared array<int>, range int, step int, host string, path string, hashes array<long>, plain array<long>, place int"
_PAGE_SQL = "id long, key long, host string, path string, hashes array<long>, plain array<long>"


def _pairs(pages: DataFrame) -> DataFrame:
    """Pairs of every page with the nearest pages of its host on either side that are no copies of it.

    The first range that is asked shows its end pages only; what these leave
    open goes over whole ranges, a round for each range that a run of copies spans.
    """
    order = ["host", "path", "id", "key"]
    found = stage(pages.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compare_range, _FOUND_SQL), "html-pairs", "zstd")
    placed = found.where("place is not null").select(*order, "hashes", "plain", "range", "place")
    pairs, asks = found.where("place is null and step is null").select(*_PAIRS), found.where("step is not null")
    ends = placed.groupBy("range").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    numbers = sorted(r["range"] for r in ends.select("range").collect())
    steps = [(x, 1, y) for x, y in zip(numbers, numbers[1:], strict=False)] + [(y, -1, x) for x, y in zip(numbers, numbers[1:], strict=False)]
    steps = pages.sparkSession.createDataFrame(steps, "range int, step int, target int")
    edges = placed.join(F.broadcast(ends), "range").where("place = a or place = b").drop("a", "b")
    at_end = asks.drop("place").join(F.broadcast(steps), ["range", "step"])
    last = F.when(F.col("step") > 0, F.col("a")).otherwise(F.col("b"))
    faced = at_end.join(F.broadcast(ends.withColumnRenamed("range", "target")), "target").withColumn("place", last)
    faced = faced.join(edges.select(F.col("range").alias("target"), "place", F.struct(*edges.columns).alias("facing")), ["target", "place"])
    met = stage(faced.where("host = facing.host").select(F.struct(*_FOUND.names).alias("page"), "facing").mapInArrow(_meet, _FOUND_SQL), "html-pairs", "zstd")
    pairs, asks = pairs.union(met.where("step is null").select(*_PAIRS)), met.where("step is not null")
    while not asks.isEmpty():
        onward = asks.join(F.broadcast(steps), ["range", "step"]).select("target", *_ASK)
        wanted = placed.join(F.broadcast(onward.select(F.col("target").alias("range")).distinct()), "range", "left_semi")
        met = stage(onward.groupBy("target").cogroup(wanted.groupBy("range")).applyInArrow(_compare_next, _FOUND_SQL), "html-pairs", "zstd")
        pairs, asks = pairs.union(met.where("step is null").select(*_PAIRS)), met.where("step is not null")
    return pairs


_ASK = ["id", "key", "host", "path", "hashes", "plain", "step"]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of asking pages with the end page that faces them; those that it copies ask the same range as a whole."""
    for batch in batches:
        rows = batch.to_pylist()
        out = [_asking(r["page"], r["page"]["range"], r["page"]["step"]) if _copied(r["page"], r["facing"]) else _pair(r["page"], r["facing"]) for r in rows]
        yield pa.RecordBatch.from_pylist(out, _FOUND)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=6).compress
    for batch in batches:
        found = [_wanted(p) for p in batch.column(3).to_pylist()]
        blobs = [press("\n".join(t).encode(errors="surrogatepass")) for t, _ in found]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blobs, pa.binary()), pa.array([p for _, p in found], pa.list_(pa.int32()))], names=["id", "url", "key", "blob", "places"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts = []
        for blob, places, shared in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
            found = open_(blob).decode(errors="surrogatepass").split("\n")
            if places is not None and shared:
                gone = set(shared)
                found = [t for t, k in zip(found, places, strict=False) if k not in gone]
            texts.append(" ".join(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row of ``pages``.

    Null and empty pages have empty texts, an empty table gives an empty one. A
    null URL is of the empty host. Rows that repeat an id are treated each;
    repeated pages are copies of each other, which are passed over. Of two
    neighbours that are equally near that with the greater hash decides. A long
    page is read whole; other columns don't matter. Only line hashes are sorted by URL; pages are
    parsed once more for their text, which moves once, packed by zstd, to meet
    the places of its shared lines.
    """
    url = F.lower(F.coalesce(F.col(url_column), F.lit("")))
    bare = F.regexp_replace(url, r"^[a-z][a-z0-9+.-]*://", "")
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), F.xxhash64(F.col(url_column), F.col(html_column)).alias("key"), F.regexp_extract(bare, r"^[^/?#]*", 0).alias("host"),
                        F.regexp_replace(F.regexp_replace(bare, r"^[^/?#]*", ""), r"#.*$", "").alias("path"), F.coalesce(F.col(html_column), F.lit("")).alias("html"))

    pairs = _pairs(rows.select("id", "key", "host", "path", "html").mapInArrow(_fingerprints, _PAGE_SQL))
    best = pairs.groupBy(F.col("id").alias("best_id"), F.col("key").alias("best_key")).agg(F.max_by("shared", F.struct("near", "other")).alias("shared")).where(F.size("shared") > 0)
    packed = rows.select("id", "url", "key", "html").mapInArrow(_pack, "id long, url string, key long, blob binary, places array<int>")
    joined = packed.join(best, (F.col("key") == F.col("best_key")) & F.col("id").eqNullSafe(F.col("best_id")), "left")
    out = joined.select("id", "url", "blob", "places", "shared").mapInArrow(_finish, "id long, url string, text string")
    return out.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text", F.char_length("text").cast("long").alias("n_chars"))
