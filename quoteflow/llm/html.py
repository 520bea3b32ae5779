"""Main text of web pages by differencing pages of nearest address.

A page is cut into blocks of text (lines). Parts that are boilerplate by their tag or by what they are called (menus,
headers, footers, sidebars, notices, adverts, forms, comments) go at once. Then pages of a host are put in the order of
their paths, and each is paired with the neighbour whose path is nearest; their lines are aligned by longest common
subsequence, and lines that both have go, as what a site repeats is not the article. A copy of the page is no such
neighbour, as all its text would be shared, nor is a version of its article element.
"""

import html
import re
from bisect import bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quoteflow.llm.common import map_batches

# Addresses sampled for each stretch of pages, and stretches for each shuffle partition.
SAMPLED, STRETCHES = 40, 4
# Part of a page's signs in lines of another page from which the two are copies; of its article's, versions of one.
COPIED, VERSION = 0.95, 0.3

# Elements by their part in a page.
RAW = frozenset("script style noscript template iframe svg math object canvas textarea select audio video head title".split())
BOILERPLATE = frozenset("nav header footer aside form button dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6"
    " hgroup html li main ol p pre section summary table tbody td tfoot th thead tr ul br hr".split()
)
ARTICLE = frozenset(["article", "main"])
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|footer|header"
    r"|cookies?|consent|notices?|popup|modal|newsletter|subscribe|share|social|related|comments?|respond|replies|disqus|login|search)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
NAME = r"[A-Za-z][^\s/>]*"
TAG = re.compile(rf"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)({NAME})((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)", re.S)
CALLED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ROLE = re.compile(r"""\brole\s*=\s*["']?([\w-]+)""", re.I)
BLANK = re.compile(r"\s+")


def page_lines(page: str) -> list[tuple[str, bool]]:
    """Lines of text outside boilerplate, and whether an article element holds them."""
    lines: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    dropped = inside = 0
    held: list[str] = []
    at = 0

    def finish():
        text = BLANK.sub(" ", html.unescape("".join(held))).strip()
        if text:
            lines.append((text, inside > 0))
        held.clear()

    while True:
        match = TAG.search(page, at)
        if not dropped:
            held.append(page[at : match.start() if match else len(page)])
        if not match:
            break
        at = match.end()
        if not match[2]:
            continue
        name = match[2].lower()
        if name in BLOCKS or name in BOILERPLATE or name in RAW:
            finish()
        if match[1]:
            if any(open_name == name for open_name, _, _ in stack):
                while stack:
                    open_name, drops, holds = stack.pop()
                    dropped -= drops
                    inside -= holds
                    if open_name == name:
                        break
            continue
        if name in VOID or match[3].rstrip().endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "p":
            while stack and any(open_name == "p" for open_name, _, _ in stack[-4:]):
                open_name, drops, holds = stack.pop()
                dropped -= drops
                inside -= holds
        called = " ".join(next(filter(None, one), "") for one in CALLED.findall(match[3])) if match[3] else ""
        role = ROLE.search(match[3]) if match[3] else None
        drops = name in BOILERPLATE or bool(called and name not in ("body", "html", "article", "main") and NAMED.search(called)) or bool(
            role and role[1].lower() in ROLES
        )
        stack.append((name, drops, name in ARTICLE))
        dropped += drops
        inside += name in ARTICLE
    finish()
    return lines


def address(url: str | None) -> tuple[str, str]:
    """Host and path, without case, port, query and fragment; of what is no address, nothing and the text itself."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path
    except ValueError:
        return "", url or ""


def shared_lines(one: list[str], other: list[str]) -> set[int]:
    """Places in `one` of a longest common subsequence of two lists of lines."""
    head = 0
    while head < min(len(one), len(other)) and one[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(one), len(other)) - head and one[-1 - tail] == other[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(one) - tail, len(one))}
    # Only lines that both hold can be common; the rest is left out of the table.
    both = set(one[head : len(one) - tail]) & set(other[head : len(other) - tail])
    left = [i for i in range(head, len(one) - tail) if one[i] in both]
    right = [j for j in range(head, len(other) - tail) if other[j] in both]
    # Bit-parallel: a row of the table is one number, whose zero bits are where the length grows.
    masks: dict[str, int] = {}
    for bit, j in enumerate(right):
        masks[other[j]] = masks.get(other[j], 0) | 1 << bit
    full = (1 << len(right)) - 1
    rows = [full]
    for i in left:
        row = rows[-1]
        common = row & masks[one[i]]
        rows.append(((row + common) | (row - common)) & full)
    bit = len(right)
    for step in range(len(left), 0, -1):
        low = (1 << bit) - 1
        if (~rows[step] & low).bit_count() > (~rows[step - 1] & low).bit_count():
            found.add(left[step - 1])
            # The line is used; it is met at the last place where this row's count grew.
            bit = (~rows[step] & low).bit_length() - 1
    return found


def nearness(one: str, other: str) -> int:
    """Leading signs that two paths share."""
    n = 0
    for a, b in zip(one, other):
        if a != b:
            break
        n += 1
    return n


def copies(one: list[str], other: list[str], part: float = COPIED) -> bool:
    """One of two lists of lines has hardly a sign of its own beside the other."""

    def shared(held: list[str], by: set[str]) -> bool:
        signs = sum(map(len, held))
        return signs > 0 and sum(len(line) for line in held if line in by) >= part * signs

    return shared(one, set(other)) or shared(other, set(one))


def main_text(lines: list[str], other: list[str] | None) -> str:
    gone = shared_lines(lines, other) if other is not None else ()
    return "\n".join(line for i, line in enumerate(lines) if i not in gone)


def place_of(host: str, path: str, key) -> tuple:
    """What pages are put in order by; a null key comes first."""
    return host, path, key is not None, key if key is not None else ""


def stretches(pages: DataFrame, key: str, url: str) -> tuple[list[tuple], dict[tuple, set[int]]]:
    """Where stretches of the order of all pages begin, and the places of each one's first and last page with the
    stretches beside it. To the driver come a bounded sample of addresses and two addresses a stretch."""

    def addresses():
        def one_by_one(piece):
            places = [address(one) for one in piece.column(1).to_pylist()]
            yield {"key": piece.column(0), "host": [host for host, _ in places], "path": [path for _, path in places]}

        return one_by_one

    kind = pages.schema[key].dataType.simpleString()
    found = map_batches(pages.select(F.col(key).alias("key"), F.col(url).alias("url")), f"key {kind}, host string, path string", addresses)
    parts = STRETCHES * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = found.orderBy(F.xxhash64("host", "path", "key")).limit(SAMPLED * parts).collect()
    met = sorted(place_of(row["host"], row["path"], row["key"]) for row in sample)
    splits = sorted({met[at * len(met) // parts] for at in range(1, parts)}) if met else []

    def number():
        def one_by_one(piece):
            rows = zip(*(piece.column(i).to_pylist() for i in range(3)))
            yield {
                **{name: piece.column(i) for i, name in enumerate(("key", "host", "path"))},
                "stretch": [bisect_right(splits, place_of(host, path, one)) for one, host, path in rows],
            }

        return one_by_one

    order = F.struct("host", "path", "key")
    ends = (
        map_batches(found, f"key {kind}, host string, path string, stretch int", number)
        .groupBy("stretch").agg(F.min(order).alias("first"), F.max(order).alias("last")).orderBy("stretch").collect()
    )
    beside: dict[tuple, set[int]] = {}
    for one, other in zip(ends, ends[1:]):
        beside.setdefault(place_of(*one["last"]), set()).add(other["stretch"])
        beside.setdefault(place_of(*other["first"]), set()).add(one["stretch"])
    return splits, beside


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """`key`, `url` and `text` (blocks joined by line ends, empty if there are none) of every page.

    Pages go to tasks by stretches of host and path, so a host of any size is cut into many; the first and the last page
    of a stretch are lent to the ones beside it, so how pages are cut changes no result. A page alone with its host, and equal addresses' pages in either order of `key`, are
    told by what they hold themselves. A null page has no text; a null address is a host of its own. A neighbour that is
    a copy or nearly so is no partner: between copies alone a page keeps its whole text. An empty table gives no rows; other columns are
    left out.
    """
    kinds = {name: pages.schema[name].dataType.simpleString() for name in (key, url)}
    splits, beside = stretches(pages, key, url)

    def cut():
        def one_by_one(piece):
            found = [page_lines(one or "") for one in piece.column(2).to_pylist()]
            places = [address(one) for one in piece.column(1).to_pylist()]
            orders = [place_of(*place, one) for place, one in zip(places, piece.column(0).to_pylist())]
            own = [bisect_right(splits, order) for order in orders]
            # Each page in its own stretch, and lent to those beside it where it is the first or last.
            rows = [(i, at, False) for i, at in enumerate(own)]
            rows += [(i, at, True) for i, order in enumerate(orders) for at in beside.get(order, ())]
            taken = pa.array([i for i, _, _ in rows], pa.int64())
            yield {
                "key": piece.column(0).take(taken), "url": piece.column(1).take(taken),
                "host": [places[i][0] for i, _, _ in rows], "path": [places[i][1] for i, _, _ in rows],
                "lines": [[line for line, _ in found[i]] for i, _, _ in rows],
                "inside": [[held for _, held in found[i]] for i, _, _ in rows],
                "stretch": [at for _, at, _ in rows], "lent": [lent for _, _, lent in rows],
            }

        return one_by_one

    lines = map_batches(
        pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("page")),
        f"key {kinds[key]}, url {kinds[url]}, host string, path string, lines array<string>, inside array<boolean>, stretch int, lent boolean", cut,
    )
    ranged = lines.repartition("stretch").sortWithinPartitions("stretch", "host", "path", "key")

    def difference(batches):
        waiting: list[tuple] = []
        out: list[tuple] = []

        def near(here, other):
            return other is not None and here[2] == other[2] and here[6] == other[6]

        def article(one):
            return [line for line, held in zip(one[4], one[5]) if held]

        def alike(here, other):
            return copies(here[4], other[4]) or copies(article(here), article(other), VERSION)

        def settle(before, here, after):
            if here[7]:
                return
            options = [one for one in (before, after) if near(here, one) and not alike(here, one)]
            best = max(options, key=lambda one: nearness(here[3], one[3]), default=None)
            out.append((here[0], here[1], main_text(here[4], best[4] if best else None)))

        def packed():
            batch = pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*out), types)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8))):
                waiting.append(row)
                if len(waiting) == 2:
                    settle(None, waiting[0], waiting[1])
                elif len(waiting) == 3:
                    settle(*waiting)
                    waiting.pop(0)
                if len(out) >= 256:
                    yield packed()
        if len(waiting) == 1:
            settle(None, waiting[0], None)
        elif waiting:
            settle(waiting[-2], waiting[-1], None)
        if out:
            yield packed()

    names = ["key", "url", "text"]
    types = [to_arrow_type(lines.schema["key"].dataType), to_arrow_type(lines.schema["url"].dataType), pa.string()]
    return ranged.mapInArrow(difference, f"key {kinds[key]}, url {kinds[url]}, text string").select(
        F.col("key").alias(key), F.col("url").alias(url), "text"
    )
