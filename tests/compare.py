"""Order-insensitive comparison of a DataFrame with DuckDB's answer."""

from __future__ import annotations

import datetime
import math


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bytes | bytearray):
        return bytes(v)
    return v


def bag(rows, names, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def assert_same(df, con, sql):
    rel = con.sql(sql)
    names = list(rel.columns)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    mine, theirs = bag(df.collect(), df.columns, order), bag(rel.fetchall(), names, order)
    assert len(mine) == len(theirs)
    assert mine == theirs
