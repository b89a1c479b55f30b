"""Comparison of a DataFrame with the oracle's answer."""

from __future__ import annotations

import math
import os
import re

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    """A value as both engines give it."""
    import datetime

    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return datetime.datetime(value.year, value.month, value.day)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows, ordered=False):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return out if ordered else sorted(out, key=repr)


def ends_in_order(sql):
    """Whether the statement itself, not a part in parentheses, has an ORDER BY."""
    depth, words = 0, []
    for token in re.findall(r"'(?:[^']|'')*'|[()]|\w+", sql):
        depth += {"(": 1, ")": -1}.get(token, 0)
        if depth == 0:
            words.append(token.upper())
    return any(a == "ORDER" and b == "BY" for a, b in zip(words, words[1:], strict=False))


def assert_same(df, con, sql):
    """Equal columns and rows, in the statement's order if it names one, floats to twelve digits."""
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    ordered = ends_in_order(sql)
    mine, theirs = rows_of(df.columns, df.collect(), ordered), rows_of(found.columns, found.fetchall(), ordered)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            same = x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-12))
            assert same, (a, b)
