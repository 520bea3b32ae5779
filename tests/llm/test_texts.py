"""BPE, quality rules, personal data, secrets, pages and benchmark passages against plain versions."""

import hashlib
import html as entities
import random
import re

import duckdb
import pytest
from helpers import PROSE, documents, nearest, text_counts
from pyspark.sql import functions as F

from quoteflow.llm import bpe, decontamination, html, pii, quality, secrets

FOLDER = "/root/testdata/sf0.001"
ODD = ["", " ", None, "a<|endoftext|>b  <|endoftext|>", "   x\n\n  y\t", "I'LL don't 12³ ½", "漢字かな 🙂 é\x85\x1c​", "ab" * 3000, "  x"]


def given(table):
    return duckdb.sql(f"SELECT * FROM '{FOLDER}/{table}.parquet'").fetchall()


@pytest.fixture(scope="module")
def texts():
    return [(row[0], row[1]) for row in given("documents")] + [(10_000 + i, text) for i, text in enumerate(ODD)] + [(10_000, "")]


def test_bpe_is_the_library(spark, texts):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    noise = [(20_000 + i, "".join(rng.choice("abcdethion ngSTé  \n　\x1c,.'s1") for _ in range(i % 60))) for i in range(600)]
    rows = texts + noise
    found = bpe.decode(bpe.encode(documents(spark, rows), path), path).select("doc_id", "text", "ids", "decoded", "lang").collect()
    assert len(found) == len(rows)
    for row in found:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == ids
        assert row["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(documents(spark, []), path).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, [140])], "k int, ids array<int>"), path).first()["decoded"] == "�"


def test_quality_counts_and_verdicts(spark, texts):
    junk = [(30_000 + i, " ".join(f"{word}{i}###" for word in PROSE * 4)) for i in range(8)]
    shouting = [(31_000 + i, " ".join(f"{word}{i}{j}!!".upper() for j in range(4) for word in PROSE)) for i in range(6)]
    fine = [(32_000 + i, "\n".join(" ".join(f"{word}{chr(97 + i)}{chr(97 + j)}" for word in PROSE) + "." for j in range(5))) for i in range(20)]
    rows = texts + junk + shouting + fine
    counted = quality.text_counts(documents(spark, rows))
    judged = quality.judge(counted).collect()
    assert len(judged) == len(rows)
    for row in judged:
        c = row["counts"]
        n, chars, symbols, lines, repeats = text_counts(row["text"] or "")
        assert (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert row["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert not (row["base_failed"] and row["kept"])
        if 30_000 <= row["doc_id"] < 32_000:
            assert not row["kept"]
        if row["doc_id"] >= 32_000:
            assert row["kept"]
    assert quality.judge(quality.text_counts(documents(spark, []))).count() == 0
    assert quality.fit([]) == {}


def test_quality_weights_follow_agreement():
    good, bad, odd = (1, 1, 1), (-1, -1, 1), (1, 1, -1)
    found = quality.fit([(good, 700), (bad, 100), (odd, 200)])
    assert found[good] > 0.9 and found[bad] < 0.1
    assert found == quality.fit([(odd, 200), (bad, 100), (good, 700)])


SHAPES = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def personal(text):
    found = []
    for kind, shape in enumerate(SHAPES):
        for match in shape.finditer(text):
            digits = re.sub("[^0-9]", "", match[0])
            wrong = (
                kind == 1 and any(int(part) > 255 for part in match[0].split("."))
                or kind == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or kind == 3 and not 9 <= len(digits) <= 15
            )
            if not wrong:
                found.append((match.start(), kind, match.end()))
    return sorted(found)


def test_personal_data(spark, texts):
    rng = random.Random(2)
    parts = ["a", "b.", "@", "@x", ".c", ".", "1", "23", "+", "+1", " ", "-", "(", "4.", ".256", "_", "%"]
    for _ in range(4_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == personal(text)
    planted = [(40_000 + i, f"🙂 call {name} +1 ({200 + i}) 555-{1000 + i} or mail {name}.{i}@host{i}.example.com today") for i, name in enumerate(PROSE)]
    bare = [(41_000, "call them 1 (317) 555-7713 or")]
    rows = texts + planted + bare
    found = {row["doc_id"]: row["spans"] for row in pii.find_personal_data(documents(spark, rows)).collect()}
    for doc, text in rows:
        base = [(s["start"], pii.KINDS.index(s["kind"]), s["stop"]) for s in found[doc] if s["base"]]
        assert base == personal(text or "") or doc == 10_000
        spans = sorted((s["start"], s["stop"]) for s in found[doc] if not s["base"])
        assert all(not (a < end and start < b) for a, b in spans for start, _, end in base)
    assert [(s["kind"], s["base"]) for s in found[41_000]] == [("phone", False)]
    assert pii.find_personal_data(documents(spark, [])).count() == 0


def test_semi_markov_best_division_is_the_best():
    text = "x +1 (200) 555-1000 y"
    atoms = pii.clusters(text)[0]
    weights = pii.fit([(f"x +1 ({i}) 555-{i + 7}00 y", pii.clusters(f"x +1 ({i}) 555-{i + 7}00 y")[0]) for i in range(200, 230)])

    def every(at):
        if at == len(atoms):
            yield 0.0, ()
        for i, j, names in pii.segments(text, atoms):
            if i == at:
                for kind, score in pii.scores(weights, names, j - i):
                    for rest, spans in every(j):
                        yield score + rest, ((i, j, kind), *spans)

    best = max(every(0))[1]
    assert pii.decode(weights, text, atoms) == [(atoms[i][0], kind, atoms[j - 1][1]) for i, j, kind in best if kind != pii.PLAIN]


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def hidden(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(spark, texts):
    rng = random.Random(5)
    odd = [(50_000 + i, "".join(rng.choice(["token", "=", " ", ":", "abc", "PassWord", "é🙂", '"', "AKIA", "B7", "ab12cd34ef56"]) for _ in range(12))) for i in range(300)]
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32)) for _ in range(40)]
    labelled = [(51_000 + i, f"the secret: {key} of {PROSE[i % len(PROSE)]}") for i, key in enumerate(keys)]
    new = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32))
    free = [(52_000, f"then {new} alone"), (52_001, "then internationalisationofthemillbytheriver alone")]
    rows = texts + odd + labelled + free
    found = {row["doc_id"]: row["spans"] for row in secrets.find_secrets(documents(spark, rows)).collect()}
    for doc, text in rows:
        base = [(s["start"], secrets.KINDS.index(s["kind"]), s["stop"]) for s in found[doc] if s["kind"] != "random"]
        assert base == hidden(text or "") or doc == 10_000
    assert [(s["kind"], s["value"]) for s in found[52_000]] == [("random", new)]
    assert found[52_001] == []
    assert secrets.find_secrets(documents(spark, [])).count() == 0


def test_pages(spark):
    pages = given("pages")
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {row["page_id"]: row["text"] for row in html.extract(df).collect()}
    for page, _, source in pages:
        article = re.search(r"<article>(.*?)(</article>|<footer|$)", source, re.S)[1]
        blocks = [re.sub(r"<(?!/?(p|h1|br)\b)[^>]*>", "", block) for block in re.split(r"</?(?:p|h1|br)>", article)]
        shown = [re.sub(r"\s+", " ", entities.unescape(block)).strip() for block in blocks]
        assert found[page] == "\n".join(filter(None, shown))


def test_pages_share_lines_outside_articles(spark):
    def page(own):
        return f"<body><div>All rights kept</div><div>{own}</div><div class='comments'>me too</div><p>Made by hand &amp; heart</p>"

    rows = [
        (1, "http://a.org/x/1", page("one")), (2, "http://a.org/x/2", page("two")), (3, "http://b.org/", page("three")),
        (4, None, None), (5, "not [an address", "<p>a<script>b</script>c"), (6, "http://c.org", ""), (7, "http://c.org", "<article>same"),
        (8, "http://c.org", "<article>same"), (9, "http://d.org", "<p>" * 3000 + "deep"), (10, "http://d.org", '<p title="a>b">x<br>y'),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(1)
    found = {row["page_id"]: row["text"] for row in html.extract(df).coalesce(1).collect()}
    assert found[3] == "All rights kept\nthree\nMade by hand & heart"
    assert found[1] in ("one", "All rights kept\none\nMade by hand & heart")
    assert [found[i] for i in (4, 5, 6, 7, 8, 9, 10)] == ["", "a\nc", "", "same", "same", "deep", "x\ny"]
    assert html.extract(df.limit(0)).count() == 0


def test_longest_common_lines():
    rng = random.Random(0)
    for _ in range(1_500):
        one, other = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(other) + 1) for _ in range(len(one) + 1)]
        for i, a in enumerate(one):
            for j, b in enumerate(other):
                table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
        common = [one[i] for i in sorted(html.shared_lines(one, other))]
        rest = iter(other)
        assert len(common) == table[-1][-1] and all(line in rest for line in common)


def test_benchmark_passages(spark):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(PROSE) + rng.choice("abcde") for _ in range(rng.randint(1, 30)))) for i in range(12)]
    items += [(100, None), (101, "!!!"), (102, items[3][1])]
    rows = []
    for i in range(150):
        number, text = rng.choice(items[:12])
        signs = list(text)
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(signs))
            signs[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "zz", "Q "])
            signs = signs or ["x"]
        rows.append((i, " ".join(rng.sample(PROSE, 5)) + "... " + "".join(signs) + "\n" + " ".join(rng.sample(PROSE, 5))))
    rows += [(900, None), (901, ""), (5, rows[5][1])]
    df = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contaminated(documents(spark, rows), df).collect()
    wanted = []
    for doc, text in rows:
        for item, passage in items:
            pattern, shown = decontamination.normal(passage or ""), decontamination.normal(text or "")
            if pattern:
                edits, _ = nearest(pattern, shown)
                if edits <= int(len(pattern) * decontamination.ERROR_RATE):
                    wanted.append((doc, item, edits))
    assert sorted((row["doc_id"], row["item_id"], row["edits"]) for row in found) == sorted(wanted)
    texts = dict(rows)
    for row in found:
        passage = decontamination.normal(texts[row["doc_id"]][row["start"] : row["stop"]])
        pattern = decontamination.normal(dict(items)[row["item_id"]])
        assert nearest(pattern, passage)[0] == row["edits"]
    assert decontamination.contaminated(documents(spark, []), df).count() == 0
    assert decontamination.contaminated(documents(spark, rows), df.limit(0)).count() == 0


def test_digests_are_of_what_was_found(spark):
    from quoteflow.llm import queries

    row = queries.op4_personal_data(spark, FOLDER).orderBy("doc_id").first()
    text = dict((r[0], r[1]) for r in given("documents"))[row["doc_id"]]
    base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in personal(text))
    assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
