"""Passages that a document of a lower id also has, found with suffix automata over words, and cut out.

Which documents can meet is settled first. Every window of `WINDOW` words has an anchor: the run of `ANCHOR` words in it
whose hash is least. Equal windows have equal anchors, so a window is shared only if its anchor occurs in two texts.
The stretches of windows around such anchors are dealt to shards by anchor. The distinct stretches of a shard are its
reference, as a suffix automaton in which every state knows the lowest document that holds its strings; all stretches of
the shard's documents are streamed through it. Where many documents meet one shard they are cut into pieces and the
reference is sent to each piece (as text, a tenth of its automaton's size, which each task builds).

Nothing is quadratic in copies: equal texts are one, a stretch meets one shard, and stretches of an anchor with very much
text around it are cut into single windows, and what one text repeats is one row. Hashes only ever bring texts together; what is removed is decided by words.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.llm.common import map_batches, plain_text
from quoteflow.llm.overlap import small_side
from quoteflow.sources import store

WINDOW = 13
ANCHOR = 6
# Words of reference in one automaton, of text around one anchor, and of passages streamed through one automaton by one task.
SHARD_WORDS = 100_000
ANCHOR_WORDS = 25_000
PIECE_WORDS = 500_000

# Bytes that part words.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
# Words hashed at a time, and places in a word that weigh differently.
STEP, PLACES = 1 << 17, 4096
NO_ID = (1 << 63) - 1


# Shuffle files go with the query they were for, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows from a closely packed table of their own; what was shuffled to make them is let go."""
    conf = df.sparkSession.conf
    before = {name: conf.get(name, None) for name in (CLEANUP, "spark.sql.parquet.compression.codec")}
    try:
        conf.set(CLEANUP, "true")
        conf.set("spark.sql.parquet.compression.codec", "zstd")
        return store.stored(df, label)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    numbers = (numbers ^ (numbers >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    numbers = (numbers ^ (numbers >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return numbers ^ (numbers >> np.uint64(32))


class Anchors:
    """Words of a batch of texts, and the stretches of windows with one anchor."""

    def __init__(self, window: int = WINDOW, anchor: int = ANCHOR):
        self.window, self.anchor = window, anchor
        self.sign = _mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
        self.blank = np.zeros(256, bool)
        self.blank[list(BLANKS)] = True
        self.sign[self.blank] = 0
        self.weight = _mixed(np.arange(1, PLACES + 1, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)

    def words(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text number) of every word; `edges` are the bounds of the texts in `data`."""
        inside = ~self.blank[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts_of_texts = edges[:-1][edges[:-1] < len(data)]
        first[starts_of_texts] |= inside[starts_of_texts]
        starts = np.flatnonzero(first)
        hashes = np.empty(len(starts), np.uint64)
        for at in range(0, len(starts), STEP):
            own = starts[at : at + STEP]
            stop = starts[at + STEP] if at + STEP < len(starts) else len(data)
            place = np.arange(own[0], stop) - np.repeat(own, np.diff(np.append(own, stop)))
            hashes[at : at + len(own)] = np.add.reduceat(self.sign[data[own[0] : stop]] * self.weight[place % PLACES], own - own[0])
        return _mixed(hashes), np.searchsorted(edges, starts, side="right") - 1

    def stretches(self, hashes: np.ndarray, text: np.ndarray):
        """(anchor, text number, first window, windows): runs of windows of one text with one anchor, in order."""
        windows = len(hashes) - self.window + 1
        if windows <= 0:
            return tuple(np.empty(0, np.int64) for _ in range(4))
        grams = np.zeros(len(hashes) - self.anchor + 1, np.uint64)
        for at in range(self.anchor):
            grams += hashes[at : at + len(grams)] * self.weight[at]
        grams = _mixed(grams)
        least = grams[:windows].copy()
        for at in range(1, self.window - self.anchor + 1):
            np.minimum(least, grams[at : at + windows], out=least)
        owner = text[:windows]
        whole = owner == text[self.window - 1 :]
        new = np.ones(windows, bool)
        new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        begins = np.flatnonzero(new & whole)
        # A stretch ends before the next one, or with the last whole window of its text.
        breaks = np.flatnonzero(new | ~whole)
        after = np.append(breaks, windows)
        ends = after[np.searchsorted(breaks, begins, side="right")]
        begin_of_text = np.searchsorted(text, owner[begins], side="left")
        return least[begins].view(np.int64), owner[begins], begins - begin_of_text, ends - begins


def _lists(values: np.ndarray, owner: np.ndarray, rows: int, kind) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes one after the other, and their bounds."""
    values = texts.cast(pa.large_binary())
    edges = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    held = values.buffers()[2]
    data = np.frombuffer(held, np.uint8)[edges[0] : edges[-1]] if held is not None else np.empty(0, np.uint8)
    return data, edges - edges[0]


def anchored(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """`texts` (doc, text, h1, h2) with `n_words`, and lists `anchors`, `starts` and `counts` of its stretches."""
    names = texts.columns
    schema = T.StructType([*texts.schema, *T._parse_datatype_string("n_words long, anchors array<long>, starts array<int>, counts array<int>")])

    def start():
        found = Anchors(window, anchor)

        def one(piece):
            rows = piece.num_rows
            hashes, text = found.words(*_bytes(piece.column(piece.schema.get_field_index("text"))))
            anchors, owner, first, count = found.stretches(hashes, text)
            yield {
                **{name: piece.column(piece.schema.get_field_index(name)) for name in names},
                "n_words": np.bincount(text, minlength=rows),
                "anchors": _lists(anchors, owner, rows, pa.int64()),
                "starts": _lists(first, owner, rows, pa.int32()),
                "counts": _lists(count, owner, rows, pa.int32()),
            }

        return one

    return map_batches(texts, schema, start)


class Automaton:
    """Suffix automaton over words of many passages; each state knows the lowest document with its strings.

    Passages are added from the lowest document on, so that is the document that made the state.
    """

    def __init__(self):
        self.number: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.lowest = [-1]

    def _state(self, following: dict[int, int], link: int, length: int, lowest: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.lowest.append(lowest)
        return len(self.link) - 1

    def _part(self, state: int, at: int, word: int) -> int:
        """The state of the strings of `at` and the word, parted from the longer strings of `state`."""
        if self.length[state] == self.length[at] + 1:
            return state
        twin = self._state(dict(self.next[state]), self.link[state], self.length[at] + 1, self.lowest[state])
        self.link[state] = twin
        while at >= 0 and self.next[at].get(word) == state:
            self.next[at][word] = twin
            at = self.link[at]
        return twin

    def add(self, passage: list[str], doc: int) -> None:
        last, following, link = 0, self.next, self.link
        for shown in passage:
            word = self.number.setdefault(shown, len(self.number))
            known = following[last].get(word)
            if known is not None:
                last = self._part(known, last, word)
                continue
            new = self._state({}, 0, self.length[last] + 1, doc)
            at = last
            while at >= 0 and word not in following[at]:
                following[at][word] = new
                at = link[at]
            link[new] = self._part(following[at][word], at, word) if at >= 0 else 0
            last = new

    def shared(self, passage: list[str], doc: int, window: int) -> list[tuple[int, int]]:
        """Maximal spans (first word, end) covered by windows that a document below `doc` holds.

        Matching statistics: the longest string of the automaton that ends at each word, cut to the window's length,
        since the shorter the string the lower its lowest document.
        """
        following, link, length, lowest = self.next, self.link, self.length, self.lowest
        number, state, held = self.number, 0, 0
        spans: list[tuple[int, int]] = []
        for place, shown in enumerate(passage):
            word = number.get(shown, -1)
            while state and word not in following[state]:
                state = link[state]
                held = length[state]
            state = following[state].get(word, 0)
            held = held + 1 if state else 0
            if held < window:
                continue
            held = window
            while length[link[state]] >= window:
                state = link[state]
            if lowest[state] < doc:
                first = place + 1 - window
                if spans and spans[-1][1] >= first:
                    first = spans.pop()[0]
                spans.append((first, place + 1))
        return spans


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _shared_spans(window: int):
    def find(reference: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
        automaton = Automaton()
        reference = reference.sort_values(["doc", "passage"])
        for passage, doc in zip(reference["passage"], reference["doc"]):
            automaton.add(passage.split(" "), doc)
        found = []
        for row, doc, starts, passage in zip(passages["row"], passages["doc"], passages["starts"], passages["passage"]):
            spans = automaton.shared(passage.split(" "), doc, window)
            here = [(first + start, end + start) for first, end in spans for start in starts]
            found += [(row, first, end) for first, end in _merged(here)]
        return pd.DataFrame(found, columns=["row", "first", "end"])

    return find


PASSAGES = "row long, doc long, anchor long, starts array<int>, words int, passage string"


def _columns(rows: list[tuple]) -> dict:
    row, doc, anchor, starts, words, passage = zip(*rows) if rows else ((),) * 6
    return {
        "row": row, "doc": doc, "anchor": anchor, "starts": starts, "words": words,
        "passage": pa.array(passage, pa.binary()).cast(pa.string()),
    }


def _passages(texts: DataFrame, window: int) -> DataFrame:
    """(`row`, `doc`, `anchor`, `starts`, `words`, `passage`): the stretches in `wanted`; one a text repeats is one row."""

    def task():
        def one(piece):
            column = {name: piece.column(piece.schema.get_field_index(name)) for name in piece.schema.names}
            parts = column["wanted"].flatten()
            counts = pa.compute.list_value_length(column["wanted"]).to_pylist()
            starts = parts.field("start").to_numpy()
            lengths = parts.field("count").to_numpy() + (window - 1)
            anchors = parts.field("anchor").to_numpy()
            out, at = [], 0
            for row, doc, text, count in zip(column["row"].to_pylist(), column["doc"].to_pylist(), column["text"].cast(pa.large_binary()), counts):
                words, own, held = text.as_py().split(), slice(at, at + count), {}
                for anchor, start, length in zip(anchors[own].tolist(), starts[own].tolist(), lengths[own].tolist()):
                    held.setdefault((anchor, length, b" ".join(words[start : start + length])), []).append(start)
                out += [(row, doc, anchor, places, length, passage) for (anchor, length, passage), places in held.items()]
                at += count
            yield _columns(out)

        return one

    return map_batches(texts, PASSAGES, task)


def _by_window(passages: DataFrame, window: int) -> DataFrame:
    """Passages cut into single windows, each its own anchor; a window that a passage repeats is one row."""

    def task():
        found = Anchors(window, window)

        def one(piece):
            column = {name: piece.column(piece.schema.get_field_index(name)) for name in piece.schema.names}
            anchors, owner, first, count = found.stretches(*found.words(*_bytes(column["passage"])))
            out, cut = [], np.searchsorted(owner, np.arange(piece.num_rows + 1)).tolist()
            rows = zip(column["row"].to_pylist(), column["doc"].to_pylist(), column["starts"].to_pylist(), column["passage"].cast(pa.large_binary()))
            for number, (row, doc, starts, passage) in enumerate(rows):
                words, own, held = passage.as_py().split(), slice(cut[number], cut[number + 1]), {}
                for anchor, place, windows in zip(anchors[own].tolist(), first[own].tolist(), count[own].tolist()):
                    for at in range(place, place + windows):
                        held.setdefault((anchor, b" ".join(words[at : at + window])), []).append(at)
                out += [
                    (row, doc, anchor, [start + place for start in starts for place in places], window, shown)
                    for (anchor, shown), places in held.items()
                ]
            yield _columns(out)

        return one

    return map_batches(passages, PASSAGES, task)


def dedup_substrings(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    shard_words: int = SHARD_WORDS,
    anchor_words: int = ANCHOR_WORDS,
    piece_words: int = PIECE_WORDS,
) -> DataFrame:
    """`key`, `n_words`, `n_removed` and `text` (the words kept, one blank between) of every row.

    A word goes when a window of `window` words that covers it also starts in a row with a lower key; windows are those
    of the input. Keys are whole numbers. Rows with equal keys remove nothing from each other; a null key stands after
    all others. A null text has no words; a text shorter than a window loses none. Repeated rows get equal results, an
    empty table none; other columns, whatever their names, are left out. Memory of a task is bounded by the words of a
    shard and a piece, or by its longest text.
    """
    if not 0 < anchor < window:
        raise ValueError("an anchor is shorter than a window")
    shown = plain_text(text)
    given = df.select(
        F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), shown.alias("text"),
        F.xxhash64(shown).alias("h1"), F.xxhash64(F.lit(1), shown).alias("h2"),
    )
    # Rows are numbered by being written.
    texts = stored(anchored(given, window, anchor).withColumn("row", F.monotonically_increasing_id()), "texts")

    # Equal texts are one, that of the lowest key; a higher key's loses all its windows.
    names = texts.where(F.size("anchors") > 0).select("row", "doc", "h1", "h2")
    firsts = names.groupBy("h1", "h2").agg(F.min(F.struct("doc", "row")).alias("low"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    copies = stored(
        names.join(firsts, ["h1", "h2"]).where(F.col("row") != F.col("low.row")).select(
            "row", F.col("low.row").alias("of"), (F.col("doc") > F.col("low.doc")).alias("gone")
        ),
        "copies",
    )

    # Anchors of two texts and more, and the texts that hold them.
    each = texts.where(F.size("anchors") > 0).join(small_side(copies.select("row")), "row", "left_anti")
    common = each.select(F.explode(F.array_distinct("anchors")).alias("anchor")).groupBy("anchor").agg(
        F.count(F.lit(1)).alias("texts")
    ).where("texts > 1").select("anchor")
    stretch = F.arrays_zip(F.col("anchors").alias("anchor"), F.col("starts").alias("start"), F.col("counts").alias("count"))
    held = each.select("row", F.inline(stretch)).join(common, "anchor", "left_semi")
    wanted = stored(held.groupBy("row").agg(F.collect_list(F.struct("anchor", "start", "count")).alias("wanted")), "wanted")
    passages = stored(_passages(texts.select("row", "doc", "text").join(wanted, "row"), window), "passages")

    # The distinct passages are the reference, each with its lowest document.
    def distinct(rows: DataFrame) -> DataFrame:
        return rows.groupBy("anchor", "passage").agg(F.min("doc").alias("doc"), F.first("words").alias("words"))

    reference = stored(distinct(passages), "reference")
    size = reference.groupBy("anchor").agg(F.sum("words").alias("n"))
    hot = stored(size.where(F.col("n") > anchor_words).select("anchor"), "hot")
    if not hot.isEmpty():
        hot = small_side(hot)
        cut = stored(_by_window(passages.join(hot, "anchor", "left_semi").select(passages.columns), window), "cut")
        passages = passages.join(hot, "anchor", "left_anti").select(passages.columns).unionByName(cut)
        reference = stored(reference.join(hot, "anchor", "left_anti").select(reference.columns).unionByName(distinct(cut)), "reference")
    spans = stored(_match(reference, passages, window, shard_words, piece_words), "spans")

    # A row with text and key of another has that one's spans.
    same = copies.where("not gone").join(spans.withColumnRenamed("row", "of"), "of").select("row", "spans")
    fate = spans.unionByName(same).withColumn("gone", F.lit(False)).unionByName(
        copies.where("gone").select("row", "gone"), allowMissingColumns=True
    )
    return _kept(texts.join(fate, "row", "left"), key)


def _match(reference: DataFrame, passages: DataFrame, window: int, shard_words: int, piece_words: int) -> DataFrame:
    """(`row`, `spans`): word spans of every text that texts of lower documents share, in order."""
    words = reference.agg(F.sum("words").alias("n")).first()["n"] or 0
    shards = max(1, -(-words // shard_words))
    shard = F.pmod(F.col("anchor"), F.lit(shards)).alias("shard")
    met = passages.select("row", "doc", "starts", "words", "passage", shard)
    sizes = met.groupBy("shard").agg(F.ceil(F.sum("words") / piece_words).cast("int").alias("pieces"))
    # One row per shard; read twice.
    sizes = small_side(stored(sizes, "sizes"))
    sent = reference.select("doc", "passage", shard).join(sizes, "shard").withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    ).drop("pieces")
    asked = met.join(sizes, "shard").withColumn("piece", F.pmod(F.xxhash64("row", "passage"), F.col("pieces")).cast("int"))
    found = sent.groupBy("shard", "piece").cogroup(
        asked.select("shard", "piece", "row", "doc", "starts", "passage").groupBy("shard", "piece")
    ).applyInPandas(_shared_spans(window), "row long, first int, end int")
    return found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"))


def _kept(rows: DataFrame, key: str) -> DataFrame:
    kind = rows.schema["key"].dataType
    schema = T.StructType([T.StructField(key, kind), *T._parse_datatype_string("n_words long, n_removed long, text string")])

    def task():
        def one(piece):
            texts, removed = [], []
            for text, spans, gone in zip(*(piece.column(piece.schema.get_field_index(n)).to_pylist() for n in ("text", "spans", "gone"))):
                words = text.encode().split()
                kept, at = [], 0
                for span in spans or ():
                    kept += words[at : span["first"]]
                    at = max(at, span["end"])
                kept = [] if gone else kept + words[at:]
                texts.append(b" ".join(kept))
                removed.append(len(words) - len(kept))
            yield {
                key: piece.column(piece.schema.get_field_index("key")), "n_words": piece.column(piece.schema.get_field_index("n_words")),
                "n_removed": removed, "text": pa.array(texts, pa.binary()).cast(pa.string()),
            }

        return one

    return map_batches(rows.select("key", "n_words", "text", "spans", "gone"), schema, task)
