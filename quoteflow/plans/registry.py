"""All registered queries by name."""

from quoteflow.plans import evaluations, grids, mail, matching, quoting, requests, streams
from quoteflow.plans.base import Query

MODULES = [matching, mail, grids, requests, quoting, evaluations, streams]


def all_queries() -> list[Query]:
    found = [query for module in MODULES for query in module.QUERIES]
    names = [query.name for query in found]
    twice = {name for name in names if names.count(name) > 1}
    if twice:
        raise ValueError(f"registered twice: {sorted(twice)}")
    return found
