"""Small tables, and plain versions of the operators to hold them against."""

import re
from collections import Counter, defaultdict

BLANK = "[^\x20\x09-\x0d]+"
PROSE = "the mill by the river had stood empty for years before anyone thought to ask who owned the water that ran under it".split()


def documents(spark, rows, extra=True):
    """(doc_id, text) with columns of clashing names beside them."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.selectExpr("doc_id", "text", "'x' AS lang", "1 AS n_tokens", "2 AS key", "'y' AS shown", "3 AS counts", "4 AS line", "5 AS block")
    return df


class Union:
    def __init__(self, names):
        self.up = {name: name for name in names}

    def find(self, name):
        while self.up[name] != name:
            name = self.up[name]
        return name

    def join(self, one, other):
        one, other = sorted((self.find(one), self.find(other)))
        self.up[other] = one


def shingles(text, width=3):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def jaccard_components(rows):
    sets = {doc: shingles(text) for doc, text in rows}
    groups = Union(sets)
    for one in sets:
        for other in sets:
            both = len(sets[one] & sets[other])
            if one < other and sets[one] and sets[other] and 100 * both >= 90 * len(sets[one] | sets[other]):
                groups.join(one, other)
    return {doc: (len(held), groups.find(doc)) for doc, held in sets.items()}


def distance(one, other):
    row = list(range(len(other) + 1))
    for i, a in enumerate(one, 1):
        new = [i]
        for j, b in enumerate(other, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def nearest(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    best = min(row)
    return best, row.index(best)


def deduplicated(rows, lines, similarity=0.8, least_words=4):
    """What stays of each text, by comparing every pair of lines that agree in a block."""
    first, met = {}, []
    for doc, text in sorted(rows, key=lambda row: row[0]):
        for number, line in enumerate((text or "").split("\n")):
            shown = lines.normal(line)
            if len(shown.split()) >= least_words:
                met.append((doc, number, shown))
                first.setdefault(shown, (doc, number))
    distinct = sorted(first)
    groups = Union(distinct)
    held = defaultdict(list)
    for line, blocks in zip(distinct, lines.Hasher().blocks(distinct).tolist() if distinct else []):
        for place, block in enumerate(blocks):
            held[place, block].append(line)
    for members in held.values():
        for one in members:
            for other in members:
                if one < other and distance(one, other) <= int(max(len(one), len(other)) * (1 - similarity) + 1e-9):
                    groups.join(one, other)
    kept = {}
    for line in distinct:
        root = groups.find(line)
        kept[root] = min(kept.get(root, first[line]), first[line])
    gone = {(doc, number) for doc, number, shown in met if kept[groups.find(shown)] != (doc, number)}
    return {
        doc: None if text is None else "\n".join(line for i, line in enumerate(text.split("\n")) if (doc, i) not in gone)
        for doc, text in rows
    }


def text_counts(text):
    words = re.findall(BLANK, text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = [False] * len(words)
    for i in range(len(words) - 2):
        if windows[words[i], words[i + 1], words[i + 2]] > 1:
            covered[i : i + 3] = [True] * 3
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(BLANK, line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, sum(covered)
