"""Personal data in texts: fixed shapes, and spans that a semi-Markov conditional random field adds.

The model scores whole spans: what a candidate looks like from end to end, and the words on both sides. Candidates are
runs of a few neighbouring atoms (pieces without blanks) of a cluster of atoms with digits or at-signs; everything else
of a text can only be plain. Dynamic programming over a cluster, with spans of bounded length, chooses boundaries and
kinds together. It learns from a bounded sample of clusters in which the fixed shapes are the labels.
"""

import math
import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteflow.llm.common import map_batches, plain_text

KINDS = ["email", "ip", "card", "phone"]
PLAIN = len(KINDS)
# The shapes. E-mails are found from their at-sign, which gives the same as the whole pattern.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
# Atoms of clusters, the longest span in atoms, and what the model is fitted on.
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
ATOM = re.compile(r"[\w%+@(][\w.%+@()-]*[\w)]|[\w]")
LONGEST = 6
SAMPLE_CLUSTERS, SAMPLE_ATOMS, AROUND = 800, 30, 40
# Passes over the lessons: more over few, so that a small sample is learned as well.
EPOCHS, MOST_EPOCHS, LESSONS = 6, 40, 4_000
NEAREST_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, sign in enumerate(reversed(digits)):
        value = int(sign) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of fixed shapes: for each kind the leftmost matches that do not overlap, by start and kind."""
    found = []
    last = 0
    for match in DOMAIN.finditer(text) if "@" in text else ():
        start = at = match.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            last = match.end()
            found.append((start, 0, last))
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
    for match in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", match[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((match.start(), 2, match.end()))
    for match in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(NOT_DIGIT.sub("", match[0])) <= 15:
            found.append((match.start(), 3, match.end()))
    return sorted(found)


def clusters(text: str) -> list[list[tuple[int, int]]]:
    """Atoms (start, end) of neighbouring tokens with digits or at-signs, one blank between tokens."""
    out: list[list[tuple[int, int]]] = []
    last = -2
    for token in TOKEN.finditer(text):
        atoms = [(token.start() + m.start(), token.start() + m.end()) for m in ATOM.finditer(token[0])]
        if not atoms:
            continue
        if out and token.start() == last + 1:
            out[-1].extend(atoms)
        else:
            out.append(atoms)
        last = token.end()
    return out


def shape(span: str) -> str:
    """Letters as a, digits as 9, runs as one, other signs as they are; of a very long span the ends."""
    signs: list[str] = []
    for sign in span if len(span) <= 64 else span[:32] + span[-32:]:
        kind = "9" if sign.isdigit() else "a" if sign.isalpha() else sign
        if not signs or signs[-1] != kind:
            signs.append(kind)
    return "".join(signs)


def features(text: str, start: int, end: int, atoms: int) -> list[str]:
    span = text[start:end]
    digits = NOT_DIGIT.sub("", span)
    n = len(digits)
    before = NEAREST_WORD.findall(text[max(0, start - AROUND) : start])
    after = NEAREST_WORD.search(text[end : end + AROUND])
    parts = span.split(".")
    return [
        "any",
        f"shape {shape(span)}",
        f"digits {n if n < 20 else 20}",
        f"atoms {atoms}",
        f"luhn {12 <= n <= 19 and luhn(digits)} {len(digits) == len(span)}",
        f"octets {len(parts) == 4 and all(p.isascii() and p.isdigit() and octet(p) for p in parts)}",
        f"at {span.count('@') if span.count('@') < 3 else 3} {'.' in span.partition('@')[2]}",
        f"plus {span[0] == '+'} {9 <= n <= 15}",
        f"before {before[-1].lower() if before else ''}",
        f"after {after[0].lower() if after else ''}",
    ]


def segments(text: str, atoms: list[tuple[int, int]]) -> list[tuple[int, int, list[str]]]:
    """(first atom, atom after the last, features) of every candidate span."""
    return [
        (i, j, features(text, atoms[i][0], atoms[j - 1][1], j - i))
        for i in range(len(atoms)) for j in range(i + 1, min(len(atoms), i + LONGEST) + 1)
    ]


def scores(weights: dict[str, list[float]], found: list[str], atoms: int) -> list[tuple[int, float]]:
    """(kind, score); a plain span is one atom long."""
    totals = [0.0] * (PLAIN + 1)
    for name in found:
        for kind, weight in enumerate(weights.get(name, ())):
            totals[kind] += weight
    return list(enumerate(totals if atoms == 1 else totals[:PLAIN]))


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(one - top) for one in values))


def lesson(text: str, atoms: list[tuple[int, int]], spans: list[tuple[int, int, int]]):
    """Size, candidate spans and the labels by atoms; labels that end inside an atom or are too long are left plain."""
    first = {start: i for i, (start, _) in enumerate(atoms)}
    after = {end: i + 1 for i, (_, end) in enumerate(atoms)}
    gold: dict[tuple[int, int], int] = {}
    covered: set[int] = set()
    for start, kind, end in spans:
        if start in first and end in after and after[end] - first[start] <= LONGEST:
            inside = set(range(first[start], after[end]))
            if not inside & covered:
                gold[first[start], after[end]] = kind
                covered |= inside
    gold |= {(i, i + 1): PLAIN for i in range(len(atoms)) if i not in covered}
    return len(atoms), segments(text, atoms), gold


def fit(labelled: list[tuple[str, list[tuple[int, int]]]]) -> dict[str, list[float]]:
    """Weights by gradient steps on the likelihood of the labels. `labelled`: text and atoms of clusters.

    A number with a plus sign is learned a second time without it: the sign is often left out, and then no fixed shape
    finds the number. For that, a cluster with as many digits but no label teaches nothing: it may be such a number.
    """
    weights: dict[str, list[float]] = {}
    sums: dict[str, list[float]] = {}
    lessons = []
    for text, atoms in labelled:
        spans = base_spans(text)
        if spans or not 9 <= len(NOT_DIGIT.sub("", text[atoms[0][0] : atoms[-1][1]])) <= 15:
            lessons.append(lesson(text, atoms, spans))
        for start, kind, end in spans:
            if text[start] == "+":
                bare = text[:start] + " " + text[start + 1 :]
                there = [one for one in clusters(bare) if one[0][0] <= start + 1 < one[-1][1]]
                kept = [one for one in base_spans(bare) if one[2] <= start or one[0] >= end]
                lessons += [lesson(bare, one, [*kept, (start + 1, kind, end)]) for one in there]
    for _ in range(max(EPOCHS, min(MOST_EPOCHS, LESSONS // max(1, len(lessons))))):
        for n, spans, gold in lessons:
            scored = [(i, j, names, scores(weights, names, j - i)) for i, j, names in spans]
            upto, rest = [0.0] + [None] * n, [None] * n + [0.0]
            ending: dict[int, list] = {}
            starting: dict[int, list] = {}
            for one in scored:
                ending.setdefault(one[1], []).append(one)
                starting.setdefault(one[0], []).append(one)
            for j in range(1, n + 1):
                upto[j] = log_sum([upto[i] + score for i, _, _, of in ending[j] for _, score in of])
            for i in range(n - 1, -1, -1):
                rest[i] = log_sum([rest[j] + score for _, j, _, of in starting[i] for _, score in of])
            for i, j, names, of in scored:
                right = gold.get((i, j))
                for kind, score in of:
                    pull = (kind == right) - math.exp(min(0.0, upto[i] + score + rest[j] - upto[n]))
                    if abs(pull) < 1e-3:
                        continue
                    for name in names:
                        held = weights.setdefault(name, [0.0] * (PLAIN + 1))
                        past = sums.setdefault(name, [1.0] * (PLAIN + 1))
                        past[kind] += pull * pull
                        held[kind] += 0.5 * pull / math.sqrt(past[kind])
    return weights


def decode(weights: dict[str, list[float]], text: str, atoms: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the best division of a cluster."""
    best: list[tuple[float, int, int]] = [(0.0, 0, PLAIN)] + [(-math.inf, 0, PLAIN)] * len(atoms)
    for i, j, names in segments(text, atoms):
        for kind, score in scores(weights, names, j - i):
            if best[i][0] + score > best[j][0]:
                best[j] = best[i][0] + score, i, kind
    out, j = [], len(atoms)
    while j:
        _, i, kind = best[j]
        if kind != PLAIN:
            out.append((atoms[i][0], kind, atoms[j - 1][1]))
        j = i
    return out[::-1]


def sample(texts: DataFrame) -> list[tuple[str, list[tuple[int, int]]]]:
    """The clusters of lowest hash, with what stands around them: at most `SAMPLE_CLUSTERS` of `SAMPLE_ATOMS` atoms."""

    def task():
        def pick(piece):
            hashes, shown, starts, ends = [], [], [], []
            for text in piece.column(1).to_pylist():
                for atoms in clusters(text):
                    if len(atoms) <= SAMPLE_ATOMS and atoms[-1][1] - atoms[0][0] <= 20 * AROUND:
                        low = max(0, atoms[0][0] - AROUND)
                        around = text[low : atoms[-1][1] + AROUND]
                        hashes.append(xxhash.xxh3_64_intdigest(around) >> 1)
                        shown.append(around)
                        starts.append([start - low for start, _ in atoms])
                        ends.append([end - low for _, end in atoms])
            yield {"hash": hashes, "shown": shown, "starts": starts, "ends": ends}

        return pick

    found = map_batches(texts, "hash long, shown string, starts array<int>, ends array<int>", task)
    rows = found.dropDuplicates(["hash"]).orderBy("hash").limit(SAMPLE_CLUSTERS).collect()
    return [(row["shown"], list(zip(row["starts"], row["ends"]))) for row in rows]


def find_personal_data(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `spans` (kind, start, stop, base): code points, end exclusive, by start and then kind.

    Spans of fixed shape (`base`) stay as they are; spans of the model are added where they meet none. A null or empty
    text has none. Rows are worked on one by one, so repeated rows get equal spans; an empty table gives no rows; other
    columns are left out.
    """
    texts = df.select(F.col(key).alias("key"), plain_text(text).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(fit(sample(texts)))

    def task():
        weights = shared.value

        def search(piece):
            out = []
            for one in piece.column(1).to_pylist():
                found = base_spans(one)
                spans = [(start, kind, end, True) for start, kind, end in found]
                for atoms in clusters(one):
                    low, high = atoms[0][0], atoms[-1][1]
                    near = [(a, b) for a, _, b in found if a < high and low < b]
                    spans += [
                        (start, kind, end, False) for start, kind, end in decode(weights, one, atoms)
                        if not any(a < end and start < b for a, b in near)
                    ]
                out.append([{"kind": KINDS[k], "start": a, "stop": b, "base": base} for a, k, b, base in sorted(spans)])
            yield {"key": piece.column(0), "spans": out}

        return search

    kind = df.schema[key].dataType.simpleString()
    return map_batches(
        texts, f"key {kind}, spans array<struct<kind:string,start:int,stop:int,base:boolean>>", task
    ).withColumnRenamed("key", key)


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda one: F.concat_ws(":", one["kind"], one["start"].cast("string"), one["stop"].cast("string"))), ",")
