"""Actions of a request come as single values, in several frames and out of order, and so do their outcomes."""

from datetime import datetime
from decimal import Decimal

import pandas as pd

from quoteflow.streaming.actions import APPROVAL, FIELDS, FROZEN, INQUIRY, JUDGED, LETTER, OFFER, judge_request


class State:
    exists, held = False, None

    @property
    def get(self):
        return self.held

    def update(self, value):
        self.exists, self.held = True, value


def action(kind, ord, **more):
    return [{**dict.fromkeys(JUDGED), "kind": kind, "ord": ord, "acted_at": datetime(2024, 1, ord), **more}]


def told(state, *frames):
    out = pd.concat(judge_request((7,), iter(pd.DataFrame({"rfq_id": 7, "action": one}) for one in frames), state))
    assert list(out.columns) == ["told"] and len(out) == 1
    assert all(list(row) == FIELDS for row in out["told"][0])
    return [(row["kind"], row["ord"], row["status"], row["line_index"], row["offer_unit_price"]) for row in out["told"][0]]


def test_actions_are_judged_in_order_over_frames_and_batches():
    state = State()
    offer = action(OFFER, 3, line_index=1, unit_price=Decimal("2.50"), clears=False, asked_before=False)
    inquiry = action(INQUIRY, 2, letters=[{"supplier": "s", "lines": [1]}])
    early = action(OFFER, 1, line_index=1, unit_price=Decimal("9.00"), clears=False, asked_before=False)
    assert told(state, [offer, early], [inquiry]) == [
        (OFFER, 1, 409, 1, None), (INQUIRY, 2, 204, None, None), (LETTER, 2, None, 1, None), (OFFER, 3, 204, 1, None),
    ]
    approval = action(APPROVAL, 4, prices=[{"line_index": 1, "unit_price": Decimal("3.00")}], margin_stock=0.1, margin_jit=0.1)
    assert told(state, [approval], [action(INQUIRY, 5, letters=[])]) == [
        (APPROVAL, 4, 204, None, None), (FROZEN, 4, None, 1, Decimal("2.50")), (INQUIRY, 5, 409, None, None),
    ]
