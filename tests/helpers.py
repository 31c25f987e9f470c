from __future__ import annotations

import datetime
import decimal
import math

SMALL = "/root/testdata/sf0.001"


def plain(v):
    """A value that is equal to that of another engine if the two mean the same."""
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime | datetime.date):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return bytes(v) if isinstance(v, bytearray) else v


def same_rows(df, duck, sql: str) -> None:
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
    answer = duck.execute(sql)
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in answer.fetchall()), key=repr)
    assert got == want
