"""Operator 3, main text of pages by nearest-URL page differencing.

1. Each page's markup becomes blocks of text. Parts that are never main text by their own declaration (scripts, styles,
   menus, headers, footers, asides, forms, and what is named as advert, notice, comment and the like) give none, apart from
   the headings in an article's header; blocks within a main or an article element are marked so.
2. Pages are sorted by host, path and page_id, in ranges dealt to tasks, with LENT pages at both ends of a range lent to the
   range next to it. A page's neighbours are the nearest page before it and the nearest one after it on the same host that
   aren't copies of it (copies share more than COPY_SHARE of the text); the nearer of them by common URL path is its pair.
3. A page's lines are aligned with its neighbours' by longest common subsequence. Lines shared with the pair are template and
   are deleted, declared article or not; but as an article may quote a neighbour or end on the same short words, lines within
   main or article are only deleted if both neighbours share them, and within an article only in runs that begin or end it,
   of TEMPLATE_WORDS words or more, in lines of up to TEMPLATE_LINE words: a longer one is a passage. A page with one
   neighbour alone loses lines in main, and none in an article.
4. Where the differenced lines of declared articles make up ARTICLE_SHARE or more of what is left (half of it, where the
   page has several articles and no main: these may be teasers), what is left besides them goes too.

Null or empty html gives an empty text. A page whose url is null or has no host has no neighbours. Repeated rows are pages
each. Equal texts of neighbours keep the order of host, path, page_id and url. Pages of a hot host are split over many
ranges, and a run of copies is held as one text with the copies' keys; only a run of over LENT copies over the end of a
range may hide what is beyond. Pages of any length are aligned exactly, by bit-parallel rows of which the square root of
their number is kept. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import deque
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, record_batch, slices

#: Ranges hold so many pages, until there are RANGES of them, which bounds the keys that go to driver and tasks.
RANGE_PAGES = 1000
RANGES = 65_536
#: Ranges that one task takes, about.
TASK_RANGES = 4
LENT = 3
MASK_BYTES = 1 << 24
COPY_SHARE = 0.8
ARTICLE_SHARE = 0.3
TEMPLATE_WORDS = 3
TEMPLATE_LINE = 40
MAIN, ARTICLE = 1, 2

#: Elements without main text, elements that break blocks, and names that tell what a part of a page is.
DROPPED = frozenset("script style noscript template head nav footer aside form button select textarea option svg math iframe object canvas dialog menu title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer form header masthead menu modal nav navbar navigation newsletter notice notices alert pager pagination popup promo related replies respond search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that say where such a part is or how it is laid out, beside its name in one class or id.
BESIDE = frozenset("area bar block body bottom box button buttons container content global icons inner item items left link links list main module outer page panel primary right row secondary section site slot sticky strip thread top unit wrap wrapper".split())
#: Words for the article that such a part belongs to; its header is part of it.
OF_ARTICLE = frozenset("article blog entry post story".split())
ITS_OWN = frozenset("banner header masthead".split())
#: What a name says of the page around it ("has-sidebar") isn't what the part itself is.
ABOUT = frozenset("has with no without is show hide hidden".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Attributes as HTML reads them: a quote that doesn't follow an equals sign is part of a name, one that is never closed part
#: of a value, and the tag ends at the next ">". Nothing is tried twice.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?>\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def _tells(value: str) -> bool:
    """Whether some name of a class or id is made of NAMES, with nothing beside them but BESIDE, OF_ARTICLE and numbers."""
    for token in value.split():
        words = [w.lower() for part in re.split(r"[-_]+", token) for w in ([part] if part.lower() in NAMES else _PARTS.findall(part))]
        names = NAMES - ITS_OWN if OF_ARTICLE.intersection(words) else NAMES
        if words and words[0] not in ABOUT and any(w in names for w in words) and all(w in names or w in BESIDE or w in OF_ARTICLE or w.isdigit() for w in words):
            return True
    return False


def _named_away(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    if name in ("html", "body", "main") or "=" not in attributes and "hidden" not in attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key in ("class", "id") and _tells(value) or key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
    return False


#: What is done with text: it stays, it goes, it goes unless it is in a heading.
STAY, GO, GO_BUT_HEADINGS = 0, 1, 2


def blocks(page: str | None) -> list[tuple[str, int]]:
    """Text of every block in page order, and whether it lies in MAIN (1), in an ARTICLE (2; the first one), a further one (3 and so on) or neither (0)."""
    out: list[tuple[str, int]] = []
    if not page:
        return out
    parts: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, and what held before it: fate and mark
    opened: dict[str, list[int]] = {}  # places in the stack by name
    open_blocks: list[int] = []
    fate, mark, articles = STAY, 0, 0

    def flush():
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((text, mark))
            parts.clear()

    def close(at: int):
        nonlocal fate, mark
        _, fate, mark = stack[at]
        while len(stack) > at:
            name = stack.pop()[0]
            opened[name].pop()
            if name in BLOCKS:
                open_blocks.pop()

    at, size, tag = 0, len(page), _TAG
    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if fate == STAY and start > at:
            parts.append(page[at:start])
        if start == size:
            break
        if page.startswith(("<!", "<?"), start):
            comment, data = page.startswith("<!--", start), page.startswith("<![CDATA[", start)
            end = page.find("-->" if comment else "]]>" if data else ">", start + (4 if comment else 2))
            at = size if end < 0 else end + (3 if comment or data else 1)
            continue
        m = tag.match(page, start)
        if not m and tag is _TAG and page[start + 1 : start + 3].lstrip("/")[:1].isascii() and page[start + 1 : start + 3].lstrip("/")[:1].isalpha():
            tag = _PLAIN_TAG  # the page ends within this tag: from here on tags end at the next ">", whatever is quoted
            m = tag.match(page, start)
        if not m:
            if fate == STAY:
                parts.append("<")
            at = start + 1
            if tag is _PLAIN_TAG and page.find(">", at) < 0:  # no further tag
                if fate == STAY:
                    parts.append(page[at:])
                break
            continue
        at = m.end()
        name = m[2].lower()
        if name in BLOCKS:
            flush()
        elif name == "br" and fate == STAY:
            parts.append(" ")
        held = opened.get(name)
        if m[1]:
            # what is open within it ends as well, but an inline end doesn't end blocks
            if held and (name in BLOCKS or not open_blocks or held[-1] > open_blocks[-1]):
                close(held[-1])
        elif name not in VOID:
            if name == "body":
                if stack:
                    close(0)
                fate = STAY
                mark = 0
            elif name in BLOCKS and open_blocks:  # a block ends an open paragraph, an item an open item
                last = stack[open_blocks[-1]][0]
                if last == "p" or last == name == "li":
                    close(open_blocks[-1])
            opened.setdefault(name, []).append(len(stack))
            if name in BLOCKS:
                open_blocks.append(len(stack))
            stack.append((name, fate, mark))
            if name == "article" and mark < ARTICLE:
                mark = ARTICLE + articles
                articles += 1
            elif name == "main":
                mark = max(mark, MAIN)
            if fate == GO_BUT_HEADINGS and name in HEADINGS:
                fate = STAY
            if fate != GO and _named_away(name, m[3]):
                fate = GO
            elif fate == STAY and name == "header":
                fate = GO_BUT_HEADINGS if mark >= ARTICLE else GO
            if name in RAW:  # its text runs to its own end tag, whatever it holds
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else size
                close(len(stack) - 1)
    flush()
    return out


def place_of(url: str | None) -> tuple[str, str]:
    """Host and path (with the query after it) of a URL; the host is empty where there is none."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url or "")
    return (m[1].lower().rsplit("@", 1)[-1], m[2]) if m else ("", url or "")


def _lcs(a: list, b: list) -> set[int]:
    """Indices of a in a longest common subsequence with b."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < len(a) - low and high < len(b) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    found = set(range(low)) | set(range(len(a) - high, len(a)))
    a, b, offset = a[low : len(a) - high], b[low : len(b) - high], low
    here = set(b)
    kept = [i for i, x in enumerate(a) if x in here]
    there = {a[i] for i in kept}
    b = [x for x in b if x in there]
    if not kept:
        return found
    n, m = len(kept), len(b)
    full = (1 << m) - 1
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(m - 1 - j)
    masks: dict = {}  # of the most frequent lines, MASK_BYTES together; a rarer line's is made when it is met
    for x in sorted(places, key=lambda x: -len(places[x]))[: max(1, MASK_BYTES // (m // 8 + 1))]:
        masks[x] = _bits(places[x], m)

    def above(v: int, i: int) -> int:
        """Row i from row i + 1. Rows have a zero bit where the longest common subsequence of the rest of a and of b grows by b's line."""
        x = a[kept[i]]
        u = v & (masks[x] if x in masks else _bits(places[x], m))
        return ((v + u) | (v - u)) & full

    # every step-th row is kept and those between are made again, so that memory is of order n ** 0.5 * m bits
    step = max(1, isqrt(n))
    every, v = {n: full}, full
    for i in range(n - 1, -1, -1):
        v = above(v, i)
        if i % step == 0:
            every[i] = v
    i = j = 0
    while i < n and j < m:
        end = min(n, i - i % step + step)
        rows = [every[end]]
        for k in range(end - 1, i - 1, -1):
            rows.append(above(rows[-1], k))
        rows.reverse()
        first = i
        while i < end and j < m:
            here, below = rows[i - first], rows[i + 1 - first]
            if a[kept[i]] == b[j]:
                found.add(kept[i] + offset)
                i, j = i + 1, j + 1
            elif here >> (m - 1 - j) & 1 == 0:  # without b[j] the rest would be shorter
                i += 1
            else:
                rest = (1 << (m - j)) - 1
                if (here & rest).bit_count() == (below & rest).bit_count():
                    i += 1
                else:
                    j += 1
    return found


def _bits(places: list[int], size: int) -> int:
    if len(places) == 1:
        return 1 << places[0]
    out = bytearray(size // 8 + 1)
    for p in places:
        out[p >> 3] |= 1 << (p & 7)
    return int.from_bytes(out, "little")


def shared_lines(own: list[tuple[str, int]], other: list[tuple[str, int]]) -> set[int] | None:
    """Indices of the page's lines that the other page has too; None if that is a copy of it."""
    shared = _lcs([x for x, _ in own], [x for x, _ in other])
    judged = [i for i, (_, mark) in enumerate(own) if mark >= ARTICLE] or range(len(own))
    if sum(len(own[i][0]) for i in judged if i in shared) > COPY_SHARE * sum(len(own[i][0]) for i in judged):
        return None
    return shared


def template_lines(own: list[tuple[str, int]], pair: set[int] | None, second: set[int] | None) -> set[int]:
    """Indices of the lines to delete, from those shared with the pair and with the other neighbour (None where there is none)."""
    if not pair:
        return set()
    both = pair if second is None else pair & second
    found = {i for i in pair if own[i][1] == 0} | {i for i in both if own[i][1] == MAIN}
    if second is None:
        return found
    of_article: dict[int, list[int]] = {}
    for i, (_, mark) in enumerate(own):
        if mark >= ARTICLE:
            of_article.setdefault(mark, []).append(i)
    for lines in of_article.values():
        for order in (lines, lines[::-1]):  # from its beginning, and from its end
            run = []
            for i in order:
                if i not in both or len(own[i][0].split()) > TEMPLATE_LINE:
                    break
                run.append(i)
            if sum(len(own[i][0].split()) for i in run) >= TEMPLATE_WORDS:
                found.update(run)
    return found


def main_text(own: list[tuple[str, int]], pair: set[int] | None = None, second: set[int] | None = None) -> str:
    template = template_lines(own, pair, second)
    left = [b for i, b in enumerate(own) if i not in template]
    declared = [x for x, mark in left if mark]
    marks = {mark for _, mark in left}
    share = 0.5 if len([m for m in marks if m >= ARTICLE]) > 1 and MAIN not in marks else ARTICLE_SHARE
    if sum(map(len, declared)) >= share * sum(len(x) for x, _ in left):
        return "\n\n".join(declared)
    return "\n\n".join(x for x, _ in left)


def common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


class Node:
    """Pages of one text that follow one another: the text's blocks, and (path, own, page_id, url) of each page."""

    def __init__(self, packed: bytes):
        import json
        import zlib

        self.packed, self.blocks, self.pages = packed, [tuple(x) for x in json.loads(zlib.decompress(packed))], []

    def texts(self, before: list[Node], after: list[Node]):
        """The main text of each page of this range, with its key; before and after are nodes of the host, the nearest first."""
        neighbours = []
        for nodes, last in ((before, -1), (after, 0)):
            for node in nodes:
                if (shared := shared_lines(self.blocks, node.blocks)) is not None:
                    neighbours.append((node.pages[last][0], shared))
                    break
        made: dict = {}
        for path, own, page_id, url in self.pages:
            if own:
                near = sorted(range(len(neighbours)), key=lambda k: -common(path, neighbours[k][0]))
                if (key := tuple(near)) not in made:
                    made[key] = main_text(self.blocks, *[neighbours[k][1] for k in near])
                yield page_id, url, made[key], len(made[key])


RESULT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """RESULT of every page."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(body).cast("string").alias("html"))
    n = rows.select("page_id").count()
    ranges = int(min(RANGES, max(1, n // RANGE_PAGES)))

    def keys(parts):
        schema = batches("host string, path string, page_id long")
        for part in slices(parts):
            found = [(*place_of(u), p) for u, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            yield record_batch(schema, list(zip(*found, strict=True)) if found else [[], [], []])

    order = lambda k: (k[0], k[1], k[2] is not None, k[2] or 0)
    splits: list = []
    edges: dict = {}
    if ranges > 1:
        # some four times as many keys as there are ranges, by hash: every fourth of them begins a range
        share = max(1, n // (4 * ranges))
        sample = rows.select("url", "page_id").where(F.pmod(F.xxhash64("page_id", "url"), F.lit(share)) == 0)
        found = sorted({order(tuple(r)) for r in sample.mapInArrow(keys, "host string, path string, page_id long").limit(64 * ranges).collect()})
        splits = found[3::4]

    def ends_of(parts):
        """The first and the last LENT keys of each range among the task's rows."""
        schema = batches("r int, host string, path string, page_id long")
        first: dict = {}
        last: dict = {}
        for part in slices(parts, 4096):
            of_range: dict = {}
            for u, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                key = order((*place_of(u), p))
                of_range.setdefault(bisect_right(splits, key), set()).add(key)
            for r, found in of_range.items():
                first[r] = sorted(found.union(first.get(r, ())))[:LENT]
                last[r] = sorted(found.union(last.get(r, ())))[-LENT:]
        found = [(r, k[0], k[1], k[3] if k[2] else None) for r in first for k in {*first[r], *last[r]}]
        for at in range(0, len(found), 4096):
            yield record_batch(schema, list(zip(*found[at : at + 4096], strict=True)))

    if splits:
        key = F.struct("host", "path", F.col("page_id").isNotNull().alias("has"), F.coalesce("page_id", F.lit(0)).alias("id"))
        ends = rows.select("url", "page_id").mapInArrow(ends_of, "r int, host string, path string, page_id long")
        listed = F.array_sort(F.collect_set(key))  # 2 * LENT keys of each task that met the range
        ends = ends.groupBy("r").agg(F.slice(listed, 1, LENT).alias("a"), F.slice(listed, F.greatest(F.size(listed) - LENT + 1, F.lit(1)), LENT).alias("z")).collect()
        there = sorted((r["r"], [tuple(k) for k in r["a"]], [tuple(k) for k in r["z"]]) for r in ends)
        for (r, _, z), (s, a, _) in zip(there, there[1:], strict=False):
            for k in z:  # the last pages of r are lent to s, the first of s to r
                edges.setdefault(k, set()).add(s)
            for k in a:
                edges.setdefault(k, set()).add(r)

    shuffled = "r int, host string, path string, page_id long, own boolean, url string, packed binary"

    def prepare(parts):
        import json
        import zlib

        schema = batches(shuffled)
        for part in slices(parts):
            out: list[list] = [[] for _ in schema]
            for p, u, h in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                host, path = place_of(u)
                key = order((host, path, p))
                packed = zlib.compress(json.dumps(blocks(h), ensure_ascii=True).encode(), 1)
                home = bisect_right(splits, key)
                for r in (home, *edges.get(key, ())):
                    for column, value in zip(out, (r, host, path, p, r == home, u, packed), strict=True):
                        column.append(value)
            yield record_batch(schema, out)

    def compare(parts):
        schema = batches(RESULT)
        nodes: deque = deque()  # of one host in one range
        settled, now = 0, None

        def settle(ahead: int):
            """The nodes that have this many after them."""
            nonlocal settled
            done: list = []
            while len(nodes) - settled > ahead:
                before = [nodes[k] for k in range(settled - 1, -1, -1)]
                after = [nodes[k] for k in range(settled + 1, min(len(nodes), settled + 1 + LENT))]
                for row in nodes[settled].texts(before, after) if now[1] else nodes[settled].texts([], []):
                    done.append(row)
                    if len(done) == 256:
                        yield record_batch(schema, list(zip(*done, strict=True)))
                        done = []
                settled += 1
                if settled > LENT:
                    nodes.popleft()
                    settled -= 1
            if done:
                yield record_batch(schema, list(zip(*done, strict=True)))

        for part in slices(parts):
            for r, host, path, p, own, u, packed in zip(*(part.column(k).to_pylist() for k in range(7)), strict=True):
                if now != (r, host):
                    yield from settle(0)
                    nodes.clear()
                    settled, now = 0, (r, host)
                if not nodes or nodes[-1].packed != packed:
                    nodes.append(Node(packed))
                nodes[-1].pages.append((path, own, p, u))
                yield from settle(LENT + 1)
        yield from settle(0)

    dealt = rows.mapInArrow(prepare, shuffled)
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), (len(splits) + 1) // TASK_RANGES)
    dealt = dealt.repartition(tasks, "r") if splits else dealt.repartition("r")
    dealt = dealt.sortWithinPartitions("r", "host", "path", F.col("page_id").asc_nulls_first(), "url", "packed")
    return dealt.mapInArrow(compare, RESULT)


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return extract(table(spark, sf_dir, "pages"))
