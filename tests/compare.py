"""Spark results against the check SQL: same columns, same rows, in any order."""

import datetime
import decimal
import math

import duckdb

from quoteflow.plans.base import TABLES


def check_engine(folder: str) -> duckdb.DuckDBPyConnection:
    engine = duckdb.connect()
    for table in TABLES:
        engine.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return engine


def plain(value):
    """A value both engines would show alike."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else ("float", repr(value + 0.0))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(one) for one in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def differences(df, engine, sql) -> str:
    """Empty when equal, else what differs first."""
    found = rows_of(df.columns, df.collect())
    result = engine.sql(sql)
    wanted = rows_of(result.columns, result.fetchall())
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} / {sorted(result.columns)}"
    if len(found) != len(wanted):
        only = [r for r in found if r not in set(wanted)][:2], [r for r in wanted if r not in set(found)][:2]
        return f"{len(found)} rows / {len(wanted)} rows, {only}"
    for one, other in zip(found, wanted):
        if one != other:
            return f"{one} / {other}"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    for name, kind in zip(result.columns, result.types):
        mine, theirs = kinds[name], str(kind).lower()
        same = {"int": "integer", "string": "varchar", "timestamp_ntz": "timestamp"}.get(mine, mine)
        if same != theirs.replace(" ", ""):
            return f"type of {name}: {mine} / {theirs}"
    return "" if found else "no rows"
