"""References to records that do not exist: orphans of simple, composite and time-bound keys."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pocketloom.runtime import BROADCAST_ROWS, small

MATCHES = ("simple", "partial", "full")


@dataclass(frozen=True)
class Lifetime:
    """When a target counts: from valid_from on and before valid_to, seen from the time of the referring row.

    A null valid_from never begins; a null valid_to never ends; without valid_to nothing ends. A reference whose own
    time is null finds no target.
    """

    at: str
    valid_from: str
    valid_to: str | None = None


def find_orphans(
    references: DataFrame,
    keys: list[str],
    targets: DataFrame,
    target_keys: list[str],
    match: str = "simple",
    lifetime: Lifetime | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The rows of references whose key no row of targets has; all columns of references are kept as they are.

    References are grouped by which of their key columns are null, and each such mask is anti-joined on the other
    columns. match tells what nulls mean, as in SQL:2016: simple, a key with a null is no reference; partial, its
    other columns must agree with some target; full, some but not all null is an orphan. A key that is null as a
    whole is never an orphan. Repeated references come out as often as they go in; repeated targets count once.
    Without targets every reference is an orphan.

    Targets are reduced to distinct keys (their earliest start, where nothing ends) before anything moves, and are
    broadcast only if counted to be at most broadcast_rows (0: not even counted); else both sides are shuffled by key, where a hot key of
    the referring side is split by adaptive execution, since an anti-join may split its left side.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    if not keys or len(keys) != len(target_keys):
        raise ValueError("keys and target_keys must name the same number of columns, at least one")
    parts = []
    for mask in product((True, False), repeat=len(keys)):  # True: the column has a value
        has = [(k, t) for k, t, there in zip(keys, target_keys, mask) if there]
        if not has or (match == "simple" and len(has) < len(keys)):
            continue
        own = reduce(Column.__and__, (F.col(f"`{k}`").isNotNull() if there else F.col(f"`{k}`").isNull() for k, there in zip(keys, mask)))
        rows = references.where(own)
        if match == "full" and len(has) < len(keys):
            parts.append(rows)
        else:
            parts.append(_anti(rows, has, targets, lifetime, broadcast_rows))
    return reduce(DataFrame.unionByName, parts)


def _anti(rows: DataFrame, has: list[tuple[str, str]], targets: DataFrame, lifetime: Lifetime | None, broadcast_rows: int) -> DataFrame:
    names = [f"__key{i}" for i in range(len(has))]
    side = targets.select(*(F.col(f"`{t}`").alias(n) for (_, t), n in zip(has, names)), *_times(lifetime)).dropna(subset=names)
    if lifetime is None:
        side = side.distinct()
    elif lifetime.valid_to is None:
        side = side.groupBy(*names).agg(F.min("__from").alias("__from"))
    else:
        side = side.distinct()
    if broadcast_rows > 0 and small(side, broadcast_rows):
        side = F.broadcast(side)
    on = reduce(Column.__and__, (rows[f"`{k}`"] == side[n] for (k, _), n in zip(has, names)))
    if lifetime is not None:
        on &= side["__from"] <= rows[f"`{lifetime.at}`"]
        if lifetime.valid_to is not None:
            on &= side["__to"].isNull() | (side["__to"] > rows[f"`{lifetime.at}`"])
    return rows.join(side, on, "left_anti")


def _times(lifetime: Lifetime | None) -> list[Column]:
    if lifetime is None:
        return []
    ends = [F.col(f"`{lifetime.valid_to}`").alias("__to")] if lifetime.valid_to else []
    return [F.col(f"`{lifetime.valid_from}`").alias("__from"), *ends]


def orphan_report(orphans: DataFrame, by: list[str], at: str) -> DataFrame:
    """Orphans counted by the given columns and the month of at, as yyyy-MM; rows without a time have month null."""
    month = F.date_format(F.col(at), "yyyy-MM").alias("month")
    return orphans.groupBy(*by, month).agg(F.count(F.lit(1)).alias("orphans"))
