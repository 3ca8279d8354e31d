"""Joins whose small side is counted and weighed before it is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.plans.staging import stage

#: A side of at most so many rows and bytes is broadcast; beyond either the join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: A key with more rows is hot where a join is shuffled, in tables that are small themselves.
HOT_ROWS = 1_000


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: texts by their length, nested values by that of their JSON."""
    total = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif kind.startswith(("array", "map", "struct")):
            total = total + F.octet_length(F.to_json(F.struct(c))) + 16
        else:
            total = total + 8
    return total


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, bytes_: int = BROADCAST_BYTES) -> bool:
    """Whether a table may be broadcast; at most ``rows`` + 1 of its rows are looked at."""
    n, held = df.limit(rows + 1).select(_row_bytes(df).alias("b")).agg(F.count("*"), F.sum("b")).first()
    return n <= rows and (held or 0) <= bytes_


def _same(rows: DataFrame, other: str, keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(F.col(f"{other}{k}"))
    return same


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner", broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``rows`` with ``groups`` (one row a key, or few), safe for hot keys.

    ``groups`` is counted and weighed.  A small one is broadcast, so ``rows``
    never moves.  Beside a larger one the rows are counted by key.  Keys with
    more than ``hot_rows`` rows, and more than one in ``broadcast_rows`` of
    all, are hot; there are ``broadcast_rows`` of them at most, so their groups
    are broadcast to their rows, and only rows of other keys are shuffled.
    Keys compare null-safe.  ``how`` is ``inner`` or ``left``.  ``rows`` is
    read several times and should be a table.
    """
    right = groups.select(*[F.col(k).alias(f"__g_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    drop = [f"__g_{k}" for k in keys]
    if is_small(right, broadcast_rows):
        return rows.join(F.broadcast(right), _same(rows, "__g_", keys), how).drop(*drop)
    least = max(hot_rows, rows.count() // max(1, broadcast_rows))
    hot = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > least)
    hot = stage(hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys]), "hot-keys")
    is_hot = _same(rows, "__h_", keys)
    among = F.lit(True)
    for k in keys:
        among = among & F.col(f"__g_{k}").eqNullSafe(F.col(f"__h_{k}"))
    cold = rows.join(F.broadcast(hot), is_hot, "left_anti")
    cold = cold.join(right, _same(cold, "__g_", keys), how)
    if hot.isEmpty():
        return cold.drop(*drop)
    warm = rows.join(F.broadcast(hot), is_hot, "left_semi")
    warm = warm.join(F.broadcast(right.join(F.broadcast(hot), among, "left_semi")), _same(warm, "__g_", keys), how)
    return cold.unionByName(warm).drop(*drop)


def without(rows: DataFrame, out: DataFrame, same: Column, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows that ``same`` pairs with no row of ``out``; ``rows`` stays where it is if ``out`` is small.

    ``out`` is counted and weighed, broadcast up to ``broadcast_rows``, and
    joined by a shuffle beyond them.
    """
    return rows.join(F.broadcast(out) if is_small(out, broadcast_rows) else out, same, "left_anti")
