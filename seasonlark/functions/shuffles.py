"""Keyed permutations of 0 to n - 1 that need no state: a row's new place is computed from its old one.

A place is a digit pair (left below a, right below b, a b >= n) that goes through rounds of
left += f(right), right += f(left); a pair beyond n goes through them again, which ends
because the rounds are a bijection.  Fewer than max(a, b) pairs lie beyond n.
The same numbers come out of columns, of numpy and of SQL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 4
MASK = (1 << 32) - 1
#: Odd multipliers below 2^31, so that products of 32-bit numbers stay in 64 bits.
MIX_A, MIX_B, STEP = 0x2C1B3C6D, 0x297A2D39, 0x1E3779B1

def mixed(x: int | np.ndarray) -> int | np.ndarray:
    """32-bit mixing of numbers below 2^32."""
    x = ((x ^ (x >> 15)) * MIX_A) & MASK
    x = ((x ^ (x >> 12)) * MIX_B) & MASK
    return x ^ (x >> 15)


def new_places(places: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """New place of each of ``places`` among ``n`` under ``key`` (int64 arrays of one length)."""
    a = np.sqrt(n.astype(float)).astype(np.int64)
    a += (a * a < n) - ((a - 1) * (a - 1) >= n).astype(np.int64)
    b = -(-n // a)
    out, todo = places.astype(np.int64), np.ones(len(places), bool)
    while todo.any():
        m, o, k = a[todo], b[todo], key[todo]
        left, right = out[todo] // o, out[todo] % o
        for r in range(ROUNDS):
            left = (left + mixed((right + mixed((k + r * STEP) & MASK)) & MASK)) % m
            right = (right + mixed((left + mixed((k + (r + ROUNDS) * STEP) & MASK)) & MASK)) % o
        out[todo] = left * o + right
        todo = out >= n
    return out


def permuted(n: int, key: int) -> np.ndarray:
    """New places of 0 to n - 1 under ``key``."""
    every = np.arange(n, dtype=np.int64)
    return new_places(every, np.full(n, n, np.int64), np.full(n, key, np.int64))


@F.pandas_udf(T.LongType())
def permuted_column(place: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    """New place of each row's ``place`` among ``n`` under ``key``."""
    return pd.Series(new_places(*(c.to_numpy(np.int64) for c in (place, n, key))), index=place.index)


def permuted_sql(rows: str, place: str, n: str, key: str, keep: str) -> str:
    """DuckDB: a table of ``rows`` (a relation with BIGINT columns place, n, key and the columns ``keep``) with ``new_place``; for use behind WITH RECURSIVE.

    Words are mixed one step a level of subqueries, since an expression would double at every mention.
    """

    def mix(source: str, word: str, cols: str) -> str:
        sql = f"SELECT {cols}, ({word}) & {MASK} AS w FROM {source}"
        for shift, factor in ((15, MIX_A), (12, MIX_B)):
            sql = f"SELECT {cols}, (xor(w, w >> {shift}) * {factor}) & {MASK} AS w FROM ({sql})"
        return f"SELECT {cols}, xor(w, w >> 15) AS w FROM ({sql})"

    cols = f"{keep}, pl, n, ky, a, b, l, r"
    sql = f"SELECT {keep}, pl, n, ky, a, b, pl // b AS l, pl % b AS r FROM walk WHERE NOT done"
    for k in range(ROUNDS):
        for into, other, m, off in (("l", "r", "a", 0), ("r", "l", "b", ROUNDS)):
            sub = mix(f"({sql})", f"ky + {(k + off) * STEP}", cols)
            new = mix(f"({sub})", f"{other} + w", cols)
            kept = {"l": "l", "r": "r"} | {into: f"({into} + w) % {m} AS {into}"}
            sql = f"SELECT {keep}, pl, n, ky, a, b, {kept['l']}, {kept['r']} FROM ({new})"
    return f"""walk AS (SELECT {keep}, {place} AS pl, {n} AS n, {key} AS ky, CAST(ceil(sqrt({n})) AS BIGINT) AS a, CAST(ceil({n} / ceil(sqrt({n}))) AS BIGINT) AS b, false AS done FROM {rows}
UNION ALL SELECT {keep}, l * b + r AS pl, n, ky, a, b, l * b + r < n AS done FROM ({sql}))"""
