"""People's actions as a stream: the same outcomes however they are cut into batches, and after a restart."""

import datetime
import random
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quoteflow.operators import quotes as g
from quoteflow.streaming import actions

RFQS, LINES = 6, 4


def action(kind, rfq, order, **more):
    base = {"kind": kind, "rfq_id": rfq, "ord": order, "acted_at": datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=order)}
    return base | more


def some_actions():
    draw = random.Random(8)
    out = []
    for order in range(240):
        rfq, line = draw.randint(0, RFQS), draw.randint(1, LINES + 1)
        kind = draw.choice(["inquiry", "offer", "offer", "offer", "approval", "confirmation"])
        if kind == "inquiry":
            names = draw.choices("AB", k=draw.randint(1, 2))
            letters = [{"supplier": name, "lines": sorted(draw.sample(range(1, LINES + 1), draw.randint(0, 2)))} for name in names]
            out.append(action(kind, rfq, order, letters=letters))
        elif kind == "offer":
            price = draw.choice([Decimal("0.00"), Decimal("10000001.00"), Decimal(draw.randint(1, 99)), None])
            out.append(action(kind, rfq, order, line_index=line, unit_price=price, clears=draw.random() < 0.2))
        elif kind == "approval":
            prices = [{"line_index": n, "unit_price": Decimal(draw.randint(1, 9))} for n in range(1, LINES + 1) if draw.random() < 0.9]
            prices += prices[:1] * (order % 2) + [{"line_index": 77, "unit_price": Decimal(1)}] * (order % 3 == 0)
            out.append(action(kind, rfq, order, margin_stock=float(draw.choice([5, 5, 5, 1001])), margin_jit=1.0, prices=prices))
        else:
            out.append(action(kind, rfq, order, line_index=line, item_code=draw.choice([None, "ab-1", "nothing"])))
    return out


def plainly(rows, existing, asked_before):
    """Statuses, letters and frozen prices of the actions, one after the other."""
    asked, offered, inquired, approved = set(asked_before), {}, set(existing), set()
    lines = {(rfq, line) for rfq in range(RFQS) for line in range(1, LINES + 1)}
    out = []
    for one in rows:
        rfq, line, order = one["rfq_id"], one.get("line_index"), one["ord"]
        if one["kind"] == "inquiry":
            names = [letter["supplier"] for letter in one["letters"]]
            sound = len(set(names)) == len(names) and rfq < RFQS and rfq not in inquired
            out.append(("inquiry", rfq, None, order, 204 if sound else 409, None, None))
            if sound:
                inquired.add(rfq)
                for letter in one["letters"]:
                    asked |= {(rfq, line) for line in letter["lines"]}
                    out += [("letter", rfq, line, order, None, None, None) for line in letter["lines"]]
        elif one["kind"] == "offer":
            price = one["unit_price"]
            if not one["clears"] and not (price is not None and 0 < price <= 10_000_000):
                status = 422
            elif (rfq, line) not in lines:
                status = 404
            else:
                status = 204 if one["clears"] or (rfq, line) in asked else 409
            out.append(("offer", rfq, line, order, status, None, None))
            if status == 204:
                offered[rfq, line] = None if one["clears"] else price
        elif one["kind"] == "approval":
            given = {price["line_index"] for price in one["prices"]}
            if not given or one["margin_stock"] > 1000:
                status = 422
            elif rfq >= RFQS:
                status = 404
            elif not set(range(1, LINES + 1)) <= given:
                status = 422
            else:
                status = 409 if rfq in approved else 204
            out.append(("approval", rfq, None, order, status, None, None))
            if status == 204:
                approved.add(rfq)
                for n in range(1, LINES + 1):
                    price = max(p["unit_price"] for p in one["prices"] if p["line_index"] == n)
                    out.append(("frozen", rfq, n, order, None, price, offered.get((rfq, n))))
        else:
            wrong = one["item_code"] == "nothing" or (rfq, line) not in lines
            out.append(("confirmation", rfq, line, order, 404 if wrong else 204, None, None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    lines = spark.createDataFrame([(rfq, line) for rfq in range(RFQS) for line in range(1, LINES + 1)], "rfq_id long, line_index long")
    rfqs = lines.select("rfq_id").distinct()
    codes = spark.createDataFrame([(0, "ab-1", "AB-1", "thing")], "kind int, raw string, code string, description string")
    codes = codes.withColumn("code_key", g.normalize_code(F.col("raw")))
    existing = spark.createDataFrame([(0,), (1,)], "rfq_id long")
    asked = spark.createDataFrame([(0, 1), (0, 2)], "rfq_id long, line_index long")
    return lines, rfqs, codes, existing, asked


def shown(df):
    return sorted(
        (tuple(r) for r in df.select("kind", "rfq_id", "line_index", "ord", "status", "unit_price", "offer_unit_price").collect()), key=repr
    )


@pytest.mark.parametrize("cuts", [[0, 240], [0, 7, 60, 61, 150, 240]])
def test_outcomes_of_any_batches_and_after_a_restart(spark, tables, tmp_path, cuts):
    rows = some_actions()
    schema = spark.createDataFrame([], actions.ACTIONS).schema
    source, out, log = (str(tmp_path / name) for name in ("in", "out", "log"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    for start, stop in zip(cuts, cuts[1:]):
        part = [tuple(one.get(name) for name in schema.names) for one in rows[start:stop]]
        random.Random(1).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        # Each run is a restart from what the last one left.
        actions.actions_stream(stream, *tables, out, log).awaitTermination()
    found = shown(spark.read.parquet(out))
    wanted = plainly(rows, {0, 1}, {(0, 1), (0, 2)})
    assert found == wanted
    assert {row[4] for row in wanted} == {204, 404, 409, 422, None}
    assert any(row[0] == "frozen" and row[6] is not None for row in wanted)
    # The same by tables.
    lines, rfqs, codes, existing, asked = tables
    df = spark.createDataFrame([tuple(one.get(name) for name in schema.names) for one in rows], schema)
    letters = df.where("kind = 'inquiry'").select("rfq_id", "ord", F.explode("letters").alias("l")).select("rfq_id", "ord", "l.supplier", "l.lines")
    judged = g.record_inquiries(letters, rfqs, existing)
    standing = g.standing_letters(letters.select("rfq_id", "ord", "supplier", F.explode("lines").alias("line_index")), judged)
    told = g.asked_lines(standing).unionByName(asked.withColumn("asked_ord", F.lit(-1).cast("long")))
    offered = g.record_offers(df.where("kind = 'offer'"), lines, told)
    assert sorted((r["rfq_id"], r["ord"], r["status"]) for r in offered.collect()) == sorted((r[1], r[3], r[4]) for r in wanted if r[0] == "offer")
    prices = df.where("kind = 'approval'").select("rfq_id", "ord", F.explode("prices").alias("p")).select("rfq_id", "ord", "p.*")
    approvals = df.where("kind = 'approval'").withColumnRenamed("acted_at", "approved_at")
    decided = g.approve_pricing(approvals, prices, lines)
    frozen = g.frozen_prices(decided, prices, lines, offered)
    assert sorted((r["rfq_id"], r["line_index"], r["approved_unit_price"], r["offer_unit_price"]) for r in frozen.collect()) == sorted(
        (r[1], r[2], r[5], r[6]) for r in wanted if r[0] == "frozen"
    )


def test_holes_meet_only_their_own_lines(spark, tables):
    lines = tables[0]
    approvals = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (9, 4)], "rfq_id long, ord long")
    prices = spark.createDataFrame([(0, 1, n) for n in range(1, 5)] + [(0, 2, 2), (0, 2, 2), (0, 2, 88)], "rfq_id long, ord long, line_index long")
    found = g.unpriced_lines(approvals, prices, lines)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 2, 1), (0, 2, 3), (0, 2, 4), (1, 3, 1), (1, 3, 2), (1, 3, 3), (1, 3, 4)]
