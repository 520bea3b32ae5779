"""Message text, values and rules, each against rows written down by hand."""

import random
import datetime

import pytest
from pyspark.sql import functions as F

from quoteflow.functions import text as x
from quoteflow.functions import values as v
from quoteflow.operators import messages, records, routing

TODAY = datetime.date(2026, 3, 1)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "said, day, problem",
    [
        ("2026-04-05", "2026-04-05", ""), ("2026-04-05T10:00", "2026-04-05", ""), ("13/04/26", "2026-04-13", ""),
        ("04/13/2026", "2026-04-13", ""), ("05.05.26", "2026-05-05", ""), ("04/05/2026", None, v.DATE_AMBIGUOUS),
        ("31/02/2026", None, v.DATE_IMPOSSIBLE), ("12 Oct", "2026-10-12", ""), ("Oct 12, 27", "2027-10-12", ""),
        ("5 Jan", "2026-01-05", ""), ("1 December", "2026-12-01", ""), ("25/12", "2026-12-25", ""),
        ("5/6", None, v.DATE_AMBIGUOUS), ("soon", None, v.DATE_UNREADABLE), ("12 Foo 26", None, v.DATE_UNREADABLE),
        ("14/13/26", None, v.DATE_AMBIGUOUS), ("30-Feb-26.", None, v.DATE_IMPOSSIBLE), ("29 Feb", None, v.DATE_IMPOSSIBLE),
    ],
)
def test_dates(spark, said, day, problem):
    read = one(spark, v.parse_due_date(F.lit(said), F.lit(TODAY)).alias("d")).d
    assert (read.day and read.day.isoformat(), read.problem) == (day, problem)


def test_a_date_long_past_is_next_years(spark):
    late = one(spark, v.parse_due_date(F.lit("5 Jan"), F.lit(datetime.date(2026, 12, 1))).alias("d")).d
    assert late.day == datetime.date(2027, 1, 5)


def test_small_values(spark):
    row = one(
        spark,
        v.check_imo(F.lit("IMO 9074729")), v.check_imo(F.lit("9074728")), v.standardise_currency(F.lit("us$ only")),
        v.standardise_currency(F.lit("AEDX")), v.standardise_type(F.lit("deck & engine")), v.standardise_type(F.lit("fruit")),
        v.quantity_number(F.lit("1 000,5")), v.quantity_number(F.lit("2 coil")), v.quantity_number(F.lit("-1")),
        v.plain_number(F.lit("007")), v.plain_number(F.lit("7")), v.plain_number(F.lit("1.0")), v.plain_number(F.lit("0.5")),
    )
    assert list(row)[:6] == ["9074729", None, "USD", "AED", "DECK", "OTHERS"]
    assert [float(n) if n is not None else None for n in list(row)[6:]] == [1000.5, None, None, None, 7.0, None, 0.5]


def test_normalize_text_uses_the_compatible_form(spark):
    assert one(spark, x.normalize_text(F.lit("ﬁne\u00a0day  \r\n\r\n\n\nend\t"))) [0] == "fine day\n\nend"


def test_headers(spark):
    dump = "CAUTION: External\n\nFrom: A (a@b.c)\nSubject: one\nSubject: two\nUnknown: x\n\nFrom: quoted"
    cut = one(spark, x.split_headers(F.lit(dump)).alias("h")).h
    assert cut.headers == {"from": "A (a@b.c)", "subject": "two"} and cut.body == "Unknown: x\n\nFrom: quoted"
    bare = one(spark, x.split_headers(F.lit("Subject: no sender\nbody")).alias("h")).h
    assert bare.headers == {} and bare.body == "Subject: no sender\nbody"


def test_close_boundaries_are_taken_in_order(spark):
    """Hits at 1, 3, 9, 12, 20: 3 is close to 1 and 12 is close to 9, though neither is close to the hit before last."""
    lines = ["--Original Message--" if i in (1, 3, 9, 12, 20) else f"line {i}" for i in range(24)]
    cut = one(spark, x.split_thread(F.lit("\n".join(lines))).alias("t")).t
    assert cut.latest == "line 0" and len(cut.quoted) == 3 and cut.warnings == [x.SUSPICIOUS_SPLIT]
    assert cut.quoted[1].raw.split("\n")[1] == "line 10"


def test_a_quoted_header_needs_its_date_and_subject(spark):
    body = "new text that is long\nFrom: someone\nnot a header\nFrom: b\nSent: Monday\nTo: x\nSubject: s\n\nold"
    cut = one(spark, x.split_thread(F.lit(body)).alias("t")).t
    assert len(cut.quoted) == 1 or cut.quoted[0].from_address == "someone"
    assert cut.quoted[-1].subject == "s"


def test_boilerplate_keeps_values(spark):
    tail = "Kind regards,\nAnn\n\nBuyer\nFleet\nOffice\nwww.x.example\nmore"
    cut = one(spark, x.strip_boilerplate(F.lit("Please quote\nCAUTION: External mail\n" + tail)).alias("c")).c
    assert cut.applied == ["caution_banner", "signature"] and cut.text.endswith("Office")
    kept = one(spark, x.strip_boilerplate(F.lit("Hello\n" + tail + "\nprice 5 USD")).alias("c")).c
    assert kept.applied == [] and kept.text.endswith("USD")
    legal = one(spark, x.strip_boilerplate(F.lit("Hi\nConfidentiality & Disclaimer\nrest")).alias("c")).c
    assert legal.text == "Hi" and legal.applied == ["confidentiality_notice"]


def test_signals(spark):
    said = "VSL: NORTH STAR - eta\nE.T.A: 12-Oct-2026\nRFQ Ref: AB/1234\nU R G E N T and urgent\nQuote Before: 1-Jan-2027"
    found = one(spark, x.extract_signals(F.lit(said)).alias("s")).s
    assert (found.vessel_name, found.eta, found.rfq_reference) == ("NORTH STAR", "12-Oct-2026", "AB/1234")
    assert found.quote_due_date == "1-Jan-2027" and found.urgency_markers == ["U R G E N T", "URGENT"]


def test_html_and_entities(spark):
    page = "<head><title>t</title></head><body>a<b>b</b><script>x</script><!-- c -->&amp;lt; &copy;&#65;&#x42;</body>"
    assert one(spark, x.html_to_text(F.lit(page)))[0].strip().split("\n") == ["a", "b", "&lt; ©AB"]


def test_parts_pack_pages_in_order(spark):
    sizes = [1500, 1500, 1500, 9000, 10, 3990, 1]
    pages = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate(sizes)], "doc long, page_no long, text string")
    parts = {r.page_no: r.part_no for r in messages.chunk_parts(pages, "doc").collect()}
    assert [parts[i] for i in range(7)] == [1, 1, 2, 3, 4, 4, 5]


def test_regions_in_conflict_end_the_search(spark):
    regions = [
        ("a", {"ports": ["dubai"], "keywords": ["u.a.e.", "gulf"], "mailbox": ["a"]}),
        ("b", {"ports": ["tuas"], "keywords": ["sg"], "mailbox": ["b"]}),
    ]

    def find(hint=None, port=None, text="", mailbox=""):
        row = one(spark, routing.resolve_region(regions, F.lit(hint).cast("string"), F.lit(port).cast("string"), F.lit(text), F.lit(mailbox)).alias("r"))
        return row.r and (row.r.region, row.r.rule)

    assert find(hint=" A ") == ("a", "region_hint")
    assert find(port="Dubai or Tuas", mailbox="b@x") is None
    assert find(text="a message", mailbox="desk.b@x") == ("b", "mailbox")
    assert find(text="to U.A.E. now") == ("a", "keyword")


def test_policy_guardrails(spark):
    drafts = spark.createDataFrame(
        [
            ("NEW_RFQ", 0.9, False, "NORMAL", "LLM", False, True), ("SPAM_MARKETING", 0.9, None, "LOW", "LLM", True, False),
            ("INTERNAL", 0.97, None, "NORMAL", "RULES_FAST_PATH", True, False), ("NEW_RFQ", 0.5, True, "NORMAL", "LLM", True, False),
            ("CUSTOMER_ORDER_PO", 1.4, False, "NORMAL", "LLM", False, False),
        ],
        "category string, confidence double, answered_is_rfq boolean, priority string, decision_path string, strong_signal boolean, urgent boolean",
    )
    out = [tuple(r) for r in routing.finalize_policy(drafts).select(
        "recommended_action", "needs_human_review", "priority", "decision_path", F.array_join("rule_hits", ","), "confidence").collect()]
    assert out[0] == ("FORWARD_TO_DST", False, "URGENT", "LLM", "guardrail:is_rfq_mismatch", 0.9)
    assert out[1][:4] == ("IGNORE", True, "LOW", "LLM_WITH_GUARDRAIL_OVERRIDE")
    assert out[2][3] == "RULES_FAST_PATH" and out[2][1]
    assert out[3][0] == "HUMAN_REVIEW" and out[3][4] == "guardrail:low_confidence"
    assert out[4][0] == "ROUTE_TO_ORDER_TEAM" and out[4][5] == 1.0


def brute_names(names):
    taken, out = {"body.txt", "email.json"}, []
    for name in names:
        candidate, index = name, 2
        stem, _, suffix = name.rpartition(".")
        while candidate.lower() in taken:
            candidate = f"{stem} ({index}).{suffix}" if stem else f"{name} ({index})"
            index += 1
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def test_saved_names_equal_one_by_one(spark):
    mails = {
        1: ["a.txt", "A.txt", "a.txt"], 2: ["a (2).txt", "a.txt", "a.txt", "a.txt"], 3: ["body.txt", "Body.TXT", "x", "x"],
        4: ["a.txt", "a.txt", "a (2).txt", "a (2).txt"],
    }
    files = spark.createDataFrame(
        [(m, i, n) for m, names in mails.items() for i, n in enumerate(names)], "email_id long, ord long, filename string"
    )
    found = records.saved_names(files).orderBy("email_id", "ord").collect()
    for mail, names in mails.items():
        assert [r.saved_as for r in found if r.email_id == mail] == brute_names(names)
    safe = one(spark, *[records.safe_name(F.lit(n)) for n in ("..\\..\\.env", "C:\\x\\r?q.xlsx", " .. ", "/")])
    assert list(safe) == ["env", "r_q.xlsx", "attachment", "attachment"]


def test_saved_names_of_large_and_tangled_mails(spark):
    draw = random.Random(6)
    forms = ["a.txt", "A.TXT", "a (2).txt", "a (3).txt", "a (2) (2).txt", "a (02).txt", "a", "a (2)", "a (2) (3)", "body.txt", "body (2).txt", "b.c.txt", "b.c (2).txt"]
    mails = {n: draw.choices(forms, k=draw.randint(1, 40)) for n in range(60)}
    mails[100] = ["same.pdf"] * 10_000
    mails[101] = [name for i in range(300) for name in (f"t ({i}).x", "t.x")]
    mails[102] = [name for i in range(2, 40) for name in (f"t ({40 - i}).x", "t.x", "t (2).x")]
    files = spark.createDataFrame(
        [(m, i, n) for m, names in mails.items() for i, n in enumerate(names)], "email_id long, ord long, filename string"
    )
    found = records.saved_names(files.repartition(6)).orderBy("email_id", "ord").collect()
    for mail, names in mails.items():
        wanted = [f"same ({i}).pdf" if i > 1 else "same.pdf" for i in range(1, 10_001)] if mail == 100 else brute_names(names)
        assert [r.saved_as for r in found if r.email_id == mail] == wanted


def test_any_page_header_or_subject(spark):
    page = "<p>&#128512;&#X41;&#70000;&#146;&#0;&eacute;&amp;lt;</p>" + "<b></b>" * 100_000 + "z"
    people = ", ".join(f'"a, {i}" <u{i}@b.c>' for i in range(50_000))
    df = spark.createDataFrame([(page, people, "Re: " * 20_000 + "hi")], "page string, people string, subject string")
    row = df.select(
        x.html_to_text(F.col("page")).alias("page"), F.size(x.parse_addresses(F.col("people"))).alias("people"),
        F.length(F.regexp_extract("subject", x.SUBJECT_RUN, 1)).alias("run"),
    ).first()
    assert row["page"] == "\n\U0001f600A\U00011170’�é&lt;\nz"
    assert row["people"] == 50_000 and row["run"] == 79_999
    assert one(spark, v.strip(F.lit("\t\n Qty\r\n ")))[0] == "Qty"


def test_unknown_sizes(spark):
    rows = [
        (1, 1, None, True, False, True), (1, 2, None, False, False, True), (1, 3, 30_000_000, False, False, True),
        (1, 4, 20_000_000, False, False, True), (1, 5, 19_999_000, False, False, True), (1, 6, 100, True, None, None),
    ]
    kinds = "email_id long, ord long, size_bytes long, is_inline boolean, is_reference boolean, has_bytes boolean"
    files = spark.createDataFrame(rows, kinds).withColumn("data_bytes", F.lit(20_000))
    told = {row["ord"]: row["blocked"] for row in routing.attachment_budget(files).collect()}
    assert told == {1: None, 2: None, 3: routing.FILE_TOO_LARGE, 4: None, 5: None}
    told = {row["ord"] for row in routing.attachment_budget(files.drop("data_bytes")).collect()}
    assert told == {2, 3, 4, 5}


def test_large_grids_are_whole(spark):
    from quoteflow.operators import cells

    grid = spark.range(6_000).selectExpr("1L AS grid_id", "id AS row_no", "0L AS col_no", "'text' AS kind", "concat('v', id) AS value")
    wide = spark.range(80).selectExpr("2L AS grid_id", "0L AS row_no", "id AS col_no", "'text' AS kind", "concat('w', id) AS value")
    both = grid.unionByName(wide)
    assert cells.clean_cells(both).count() == 6_080
    cut = cells.clean_cells(both, 5_000, 64)
    assert cut.count() == 5_064 and cut.where("rows_truncated").select("grid_id").distinct().count() == 2
    late = spark.createDataFrame([(1, 40, 0, "Description"), (1, 40, 1, "Qty"), (1, 41, 0, "bolt")], "grid_id long, row_no long, col_no long, value string")
    assert cells.header_rows(late).count() == 1 and cells.header_rows(late, 30).count() == 0


def test_blank_keys_meet_nothing_and_stay(spark):
    from quoteflow.operators.common import left_join_filled

    rows = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "b")], "id int, key string")
    named = spark.createDataFrame([("a", "A"), ("", "never")], "key string, name string")
    found = {row["id"]: row["name"] for row in left_join_filled(rows, named, "key").collect()}
    assert found == {1: "A", 2: None, 3: None, 4: None}


def packed(lengths, limit):
    parts, part, held, size = [], 1, 0, 0
    for chars in lengths:
        if held and size + chars > limit:
            part, held, size = part + 1, 0, 0
        held, size = held + 1, size + chars
        parts.append(part)
    return parts


def test_parts_of_any_pages(spark):
    draw = random.Random(9)
    docs = {n: [draw.choice([1, 2, 7, 10, 11, 40]) for _ in range(draw.randint(1, 90))] for n in range(40)}
    docs |= {90: [1] * 100, 91: [30] * 5, 92: [10, 10, 1, 9, 10], 93: [4]}
    rows = [(doc, 3 * i, "x" * chars) for doc, lengths in docs.items() for i, chars in enumerate(lengths)]
    pages = spark.createDataFrame([*rows, (93, 1, "  "), (94, 0, None)], "doc long, page_no long, text string").repartition(5)
    found = messages.chunk_parts(pages, "doc", limit=10).collect()
    assert {(r.doc, r.page_no): r.part_no for r in found} == {
        (doc, 3 * i): part for doc, lengths in docs.items() for i, part in enumerate(packed(lengths, 10))
    }


def test_parts_of_a_hundred_thousand_pages(spark):
    pages = spark.range(100_000).select(F.lit(1).alias("doc"), F.col("id").alias("page_no"), F.repeat(F.lit("y"), (F.col("id") * 37 % 400).cast("int") + 1).alias("text"))
    found = messages.chunk_parts(pages, "doc").select("page_no", "part_no").orderBy("page_no").collect()
    assert [r.part_no for r in found] == packed([i * 37 % 400 + 1 for i in range(100_000)], 4000)
