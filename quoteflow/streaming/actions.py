"""People's actions on requests as they arrive: what may happen once happens once, over all batches.

What an action needs from tables (does the request exist, has it that line, is that one of our codes) is settled by joins.
What it needs from the actions before it is kept by request in Spark's state store: whether letters went and about which
lines, what the suppliers last offered for them, whether the prices are approved. A batch costs what its own actions
cost, however many went before, and a restart takes up the state where it was.
"""

from collections import namedtuple
from collections.abc import Iterator
from operator import attrgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quoteflow.operators import quotes as g

INQUIRY, OFFER, APPROVAL, CONFIRMATION = "inquiry", "offer", "approval", "confirmation"
# What an action brings about, as rows of their own: a letter about a line, a line's frozen price.
LETTER, FROZEN = "letter", "frozen"
ACTIONS = """kind string, rfq_id long, ord long, acted_at timestamp_ntz, line_index long, item_code string,
    unit_price decimal(14,2), clears boolean, margin_stock double, margin_jit double,
    letters array<struct<supplier: string, lines: array<bigint>>>, prices array<struct<line_index: bigint, unit_price: decimal(14,2)>>"""
OUTCOMES = """kind string, rfq_id long, line_index long, ord long, status int, stored_code string, supplier string,
    unit_price decimal(14,2), margin_stock double, margin_jit double, acted_at timestamp_ntz,
    offer_unit_price decimal(14,2), offer_received_at timestamp_ntz"""
STATE = """inquired boolean, approved boolean, asked array<bigint>,
    offers array<struct<line_index: bigint, unit_price: decimal(14,2), acted_at: timestamp_ntz>>"""
FIELDS = [part.split()[0] for part in OUTCOMES.replace("(14,2)", "").split(",")]
NOTHING = dict.fromkeys(FIELDS)
# An action as it comes to be judged, after what tables say of it.
JUDGED = ["kind", "ord", "acted_at", "line_index", "unit_price", "clears", "margin_stock", "margin_jit", "letters", "prices", "refused", "asked_before"]
Action = namedtuple("Action", JUDGED)


def judge_request(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The actions of one request in their order, after its state; those already refused are only passed on.

    Requests are many and their actions few: what pandas takes to slice, sort and join columns is more than all that is
    done here. So an action is one value (`action`, an array of one struct), and so are all outcomes of a request.
    """
    inquired, approved, asked, offers = state.get if state.exists else (False, False, [], [])
    asked, offered = set(asked), {one[0]: (one[1], one[2]) for one in offers}
    out = []

    def tell(action, kind: str, status: int | None = None, **more) -> None:
        out.append({**NOTHING, "kind": kind, "rfq_id": key[0], "ord": action.ord, "status": status, "acted_at": action.acted_at, **more})

    actions = [Action(**one) for frame in frames for held in frame["action"].tolist() for one in held]
    actions.sort(key=attrgetter("ord"))
    for action in actions:
        refused = None if pd.isna(action.refused) else int(action.refused)
        if action.kind == INQUIRY:
            refused = refused or (g.CONFLICT if inquired else None)
            tell(action, INQUIRY, refused or g.OK)
            if not refused:
                inquired = True
                for letter in action.letters:
                    asked.update(int(line) for line in letter["lines"])
                    for line in letter["lines"]:
                        tell(action, LETTER, line_index=int(line), supplier=letter["supplier"])
        elif action.kind == OFFER:
            line = int(action.line_index)
            if not refused and not action.clears and not action.asked_before and line not in asked:
                refused = g.CONFLICT
            tell(action, OFFER, refused or g.OK, line_index=line)
            if not refused and action.clears:
                offered.pop(line, None)
            elif not refused:
                offered[line] = (action.unit_price, action.acted_at)
        elif action.kind == APPROVAL:
            refused = refused or (g.CONFLICT if approved else None)
            tell(action, APPROVAL, refused or g.OK, margin_stock=action.margin_stock, margin_jit=action.margin_jit)
            if not refused:
                approved = True
                highest: dict[int, object] = {}
                for one in action.prices:
                    line = int(one["line_index"])
                    highest[line] = max(one["unit_price"], highest.get(line, one["unit_price"]))
                for line, price in highest.items():
                    price_then, received = offered.get(line, (None, None))
                    tell(action, FROZEN, line_index=line, unit_price=price, margin_stock=action.margin_stock,
                         margin_jit=action.margin_jit, offer_unit_price=price_then, offer_received_at=received)
    kept = [(line, price, pd.Timestamp(at).to_pydatetime()) for line, (price, at) in sorted(offered.items())]
    state.update((inquired, approved, sorted(asked), kept))
    yield pd.DataFrame({"told": [out]})


def outcomes(
    actions: DataFrame, lines: DataFrame, rfqs: DataFrame, codes: DataFrame, existing: DataFrame, asked: DataFrame
) -> DataFrame:
    """Every action with its status, and a row for each letter that goes and each price that is frozen.

    `actions` is a stream with the columns of `ACTIONS`, arriving in the order of `ord`. `existing` names requests with
    letters from before the stream began, for which no others go, and `asked` the lines those letters asked about.
    """
    keys = ["rfq_id", "line_index"]

    def marked(df: DataFrame, on: list[str], name: str) -> DataFrame:
        return df.select(*on).distinct().withColumn(name, F.lit(True))

    def of(kind: str) -> DataFrame:
        return actions.where(F.col("kind") == kind)

    suppliers = F.col("letters.supplier")
    inquiries = of(INQUIRY).join(marked(rfqs, ["rfq_id"], "known"), "rfq_id", "left").join(
        marked(existing, ["rfq_id"], "asked_before"), "rfq_id", "left"
    )
    one_each = F.size(suppliers) == F.size(F.array_distinct(suppliers))
    sound = one_each & F.col("known").isNotNull() & F.col("asked_before").isNull()
    offers = of(OFFER).join(marked(lines, keys, "has_line"), keys, "left").join(marked(asked, keys, "asked_before"), keys, "left")
    # An approval carries as many prices as its request has lines, so it may meet those as an array.
    held = lines.groupBy("rfq_id").agg(F.collect_set("line_index").alias("lines"))
    approvals = of(APPROVAL).join(held, "rfq_id", "left")
    priced = F.col("prices.line_index")
    bad = F.when(
        F.size("prices") > 0,
        F.exists("prices", lambda one: (one["unit_price"] <= 0) | (one["unit_price"] > g.MOST_A_UNIT_COSTS)),
    )
    refused = g.approval_bounds(
        F.col("margin_stock"), F.col("margin_jit"), bad, F.col("lines"), F.size(F.array_except("lines", priced))
    )
    own = F.filter("prices", lambda one: F.array_contains(F.col("lines"), one["line_index"]))
    branches = [
        inquiries.withColumn("refused", F.when(~F.coalesce(sound, F.lit(False)), g.CONFLICT)),
        offers.withColumn(
            "refused", g.offer_bounds(F.col("unit_price"), F.col("clears"), F.col("has_line").isNotNull()).cast("int")
        ),
        approvals.withColumn("refused", refused.cast("int")).withColumn("prices", own),
    ]
    asked_before = [F.lit(False), F.col("asked_before").isNotNull(), F.lit(False)]
    names = [*actions.columns, "refused"]
    met = [df.select(*names, told.alias("asked_before")) for df, told in zip(branches, asked_before)]
    judged = (
        met[0].unionByName(met[1]).unionByName(met[2]).select("rfq_id", F.array(F.struct(*JUDGED)).alias("action")).groupBy("rfq_id")
        .applyInPandasWithState(judge_request, f"told array<struct<{OUTCOMES}>>", STATE, "append", GroupStateTimeout.NoTimeout)
        .select(F.explode("told").alias("told")).select("told.*")
    )
    # Confirmations depend on nothing that went before.
    confirmed = g.confirm_lines(of(CONFIRMATION).select("kind", *keys, "ord", "acted_at", "item_code"), lines, codes)
    empty = {name: F.lit(None).cast(judged.schema[name].dataType) for name in FIELDS if name not in confirmed.columns}
    return judged.unionByName(
        confirmed.withColumns(empty).withColumn("status", F.col("status").cast("int")).select(*FIELDS)
    )


def actions_stream(
    actions: DataFrame,
    lines: DataFrame,
    rfqs: DataFrame,
    codes: DataFrame,
    existing: DataFrame,
    asked: DataFrame,
    folder: str,
    checkpoint: str,
) -> StreamingQuery:
    """Write the outcomes of every action to `folder`, each once, until nothing is left to read."""
    return (
        outcomes(actions, lines, rfqs, codes, existing, asked).writeStream.format("parquet").outputMode("append")
        .option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
