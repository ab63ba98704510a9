"""Rows of two engines in one form."""

import decimal
import math


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def same(df, relation):
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    at = [relation.columns.index(c) for c in names]
    ours = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in relation.fetchall())
    assert ours == theirs
