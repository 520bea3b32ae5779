"""Fill-in-middle documents: prefix, middle and suffix of a text, put in another order behind sentinels.

A text is cut at units (characters or words). Its UTF-8 bytes are seen as blocks of one size; a Fenwick tree over them
holds how many units end and how many code points start in each. A cut after k units is found by descending the tree in
powers of two, which gives the block and what lies before it; the place itself is then looked for in that block alone.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.llm.common import map_batches, plain_text

BLOCK_BYTES = 2048
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
ADDED = [
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("output", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
]


class Fenwick:
    """Prefix sums of units and of code points over blocks, with search by units."""

    def __init__(self, units: list[int], points: list[int]):
        self.size = len(units)
        self.units, self.points = [0, *units], [0, *points]
        for at in range(1, self.size + 1):
            above = at + (at & -at)
            if above <= self.size:
                self.units[above] += self.units[at]
                self.points[above] += self.points[at]

    def descend(self, wanted: int) -> tuple[int, int, int]:
        """The block in which the wanted-th unit ends, with the units and code points before that block."""
        block = units = points = 0
        step = 1 << self.size.bit_length()
        while step := step >> 1:
            further = block + step
            if further <= self.size and units + self.units[further] < wanted:
                block, units, points = further, units + self.units[further], points + self.points[further]
        return block, units, points


class Cutter:
    """Cuts of one text after given numbers of units."""

    def __init__(self, text: bytes, unit: str = "character", block: int = BLOCK_BYTES):
        data = np.frombuffer(text, np.uint8)
        self.block = block
        self.first = (data & 0xC0) != 0x80
        inside = self.first if unit == "character" else ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
        # A character ends before the next one starts, a word before the next blank.
        self.last = np.ones(len(data), bool)
        self.last[:-1] = self.first[1:] if unit == "character" else ~inside[1:]
        if unit != "character":
            self.last &= inside
        if len(data) > block:
            edges = np.arange(0, len(data), block)
            units, points = (np.add.reduceat(mask, edges, dtype=np.int64).tolist() for mask in (self.last, self.first))
        else:
            units, points = [int(np.count_nonzero(self.last))], [int(np.count_nonzero(self.first))]
        self.n = sum(units)
        self.tree = Fenwick(units, points)

    def after(self, units: int) -> tuple[int, int]:
        """(byte, code point) at which so many units have ended; (0, 0) for none."""
        if not units:
            return 0, 0
        block, before, points = self.tree.descend(units)
        start = block * self.block
        place = start + int(np.flatnonzero(self.last[start : start + self.block])[units - before - 1]) + 1
        return place, points + int(np.count_nonzero(self.first[start:place]))


def fill_in_middle(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    unit: str = "character",
    seed: int = 1,
    plain_from: int = PLAIN_FROM,
    spm_below: int = SPM_BELOW,
) -> DataFrame:
    """`df` with `n` (units), `form` (plain, psm or spm), `output`, `prefix_chars` and `middle_chars` of every row.

    Units are characters (code points) or words (runs without blanks). Four numbers drawn from the sha256 of seed and
    key decide: the prefix ends after the lesser of two places in 0..n, the middle after the greater; a text stays plain
    if its third number is `plain_from` or more in a hundred, if it is empty, or if it holds a sentinel.

    A null text is an empty one; a null key draws as an empty key. Repeated rows and equal keys draw alike. Columns of
    the names added are replaced, others kept. An empty table gives no rows. One text is one row's work, linear in its
    length; memory is that of a slice of rows, or of one text if that is longer.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("long") for part in range(4)]
    kept = [name for name in df.columns if name not in [field.name for field in ADDED]]
    # `key` and `text` may themselves bear a name that is replaced.
    asked = df.select(*kept, F.array(*draws).alias("_draws"), plain_text(text).alias("_text"))
    schema = T.StructType([*[df.schema[name] for name in kept], *ADDED])

    def start():
        def one(piece):
            found = [
                _transformed(whole, drawn, unit, plain_from, spm_below)
                for whole, drawn in zip(piece.column("_text").cast(pa.binary()).to_pylist(), piece.column("_draws").to_pylist())
            ]
            n, form, output, prefix, middle = zip(*found)
            yield {
                **{name: piece.column(piece.schema.get_field_index(name)) for name in kept},
                "n": n, "form": form, "output": pa.array(output, pa.binary()).cast(pa.string()),
                "prefix_chars": prefix, "middle_chars": middle,
            }

        return one

    return map_batches(asked, schema, start)


def _transformed(whole: bytes, drawn: list[int], unit: str, plain_from: int, spm_below: int):
    cutter = Cutter(whole, unit)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not whole or drawn[2] % 100 >= plain_from or any(mark in whole for mark in (p, s, m)):
        return cutter.n, "plain", whole, None, None
    places = sorted(draw % (cutter.n + 1) for draw in drawn[:2])
    (one, first), (two, second) = map(cutter.after, places)
    prefix, middle, suffix = whole[:one], whole[one:two], whole[two:]
    if drawn[3] % 100 < spm_below:
        return cutter.n, "spm", s + suffix + p + prefix + m + middle, first, second - first
    return cutter.n, "psm", p + prefix + s + suffix + m + middle, first, second - first


def restored(output: Column, form: Column) -> Column:
    """The text again, from what was made of it: no part holds a sentinel, so the first of each is the one set."""
    marks = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
    texts = {}
    for name, (_, inner, last) in marks.items():
        # Character places, from 1; the opening sentinel is at 1.
        at, end = F.instr(output, inner), F.instr(output, last)
        front = F.substring(output, F.lit(1 + len(PREFIX)), at - 1 - len(PREFIX))
        back = F.substring(output, at + len(inner), end - at - len(inner))
        middle = F.substring(output, end + len(last), F.char_length(output))
        texts[name] = F.concat(front, middle, back) if name == "psm" else F.concat(back, middle, front)
    return F.when(form == "psm", texts["psm"]).when(form == "spm", texts["spm"]).otherwise(output)
