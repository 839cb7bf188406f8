"""Order-insensitive result digests shared by the oracle tool and the tests."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

import numpy as np


def canon(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return "%.9g" % v
    if isinstance(v, (np.floating,)):
        return canon(float(v))
    if isinstance(v, (np.integer,)):
        return str(int(v))
    if isinstance(v, decimal.Decimal):
        return "%.9g" % float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(canon(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines
