"""Passages of test items in texts, up to a budget of edits.

Each item is cut into one piece more than its budget has edits, so that an occurrence within the budget holds at least
one piece unchanged (pigeonhole). Pieces are looked for exactly, all at once; around each hit the item is verified by
Myers' bit-parallel edit distance.
"""

import re
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.llm.common import map_batches, plain_text

# Edits allowed for each sign of an item, and signs of items looked for in one pass.
ERROR_RATE = 0.08
BLOCK_SIGNS = 4_000_000
WORD = re.compile(r"\w+")


def normal(text: str) -> str:
    """Words in lower case, one blank between them."""
    return " ".join(WORD.findall(text)).lower()


def places(text: str) -> list[int]:
    """For each sign of `normal(text)`, and its end, where it comes from in the text."""
    found: list[int] = []
    end = 0
    for match in WORD.finditer(text):
        if found:
            found.append(end)
        start, end = match.span()
        low = match[0].lower()
        found.extend(min(start + i, end - 1) for i in range(len(low)))
    return [*found, end]


def cut(length: int, pieces: int) -> list[tuple[int, int]]:
    edges = [length * i // pieces for i in range(pieces + 1)]
    return list(zip(edges, edges[1:]))


def nearest(pattern: str, text: str) -> tuple[int, int]:
    """Least edits between the pattern and any stretch of the text, and the first end of such a stretch (Myers 1999)."""
    size = len(pattern)
    masks: dict[str, int] = {}
    for i, sign in enumerate(pattern):
        masks[sign] = masks.get(sign, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << size - 1
    plus, minus, edits = full, 0, size
    best, end = size, 0
    for at, sign in enumerate(text, 1):
        equal = masks.get(sign, 0)
        carried = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            edits += 1
        elif down & top:
            edits -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(carried | up))
        minus = up & carried
        if edits < best:
            best, end = edits, at
    return best, end


class Items:
    """A block of items: their pieces in one automaton."""

    def __init__(self, items: list[tuple], error_rate: float):
        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for name, text in items:
            signs = normal(text or "")
            if not signs:
                continue
            budget = int(len(signs) * error_rate)
            number = len(self.items)
            self.items.append((name, signs, budget))
            for start, stop in cut(len(signs), budget + 1):
                pieces.setdefault(signs[start:stop], []).append((number, start))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()

    def search(self, text: str) -> Iterator[tuple]:
        """Item, edits, start and end in the text: for each item its nearest passage, the first of equals."""
        if not self.items:
            return
        signs = normal(text)
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for last, (length, uses) in self.automaton.iter(signs):
            for number, offset in uses:
                _, pattern, budget = self.items[number]
                start = last + 1 - length - offset
                if (number, start) in tried or (number in best and best[number][0] == 0):
                    continue
                tried.add((number, start))
                left = max(0, start - budget)
                edits, end = nearest(pattern, signs[left : start + len(pattern) + budget])
                if edits <= budget and (number not in best or (edits, left + end) < (best[number][0], best[number][2])):
                    best[number] = edits, left, left + end
        if not best:
            return
        where = places(text)
        for number, (edits, left, end) in sorted(best.items()):
            name, pattern, _ = self.items[number]
            _, length = nearest(pattern[::-1], signs[left:end][::-1])
            begin = end - length
            yield name, edits, where[begin], where[end - 1] + 1


def blocks(items: DataFrame, key: str, text: str, signs: int = BLOCK_SIGNS) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size. Items are a stated set of queries; one block at a time is on the driver."""
    block: list[tuple] = []
    held = 0
    for row in items.select(key, plain_text(text)).toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1])
        if held >= signs:
            yield block
            block, held = [], 0
    if block:
        yield block


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    error_rate: float = ERROR_RATE,
) -> DataFrame:
    """One row per row of `docs` and item that it holds: keys, `edits`, `start` and `stop` (code points in the text).

    Texts are compared in lower case by their words; an item may differ by `error_rate` edits a sign. Null or empty
    texts and items hold and are nothing; equal items are each reported, and so are repeated rows of `docs`. The
    nearest passage is told, the first of equals. Empty tables give no rows; other columns are left out. No shuffle.
    """
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc {kinds[0]}, item {kinds[1]}, edits int, start int, stop int"
    texts = docs.select(F.col(key).alias("doc"), plain_text(text).alias("text"))
    context = docs.sparkSession.sparkContext
    found = None
    for block in blocks(items, item_key, text):
        shared = context.broadcast(block)

        def task(shared=shared):
            sought = Items(shared.value, error_rate)

            def search(piece):
                rows = [
                    (doc, *hit)
                    for doc, one in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist())
                    for hit in sought.search(one)
                ]
                yield dict(zip(("doc", "item", "edits", "start", "stop"), zip(*rows) if rows else [[]] * 5))

            return search

        hits = map_batches(texts, schema, task)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.select(F.col("doc").alias(key), F.col("item").alias(item_key), "edits", "start", "stop")
