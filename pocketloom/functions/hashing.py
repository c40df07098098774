"""Content hashes of poses and of sets of ligands."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECIMALS, HEX_DIGITS = 3, 16


def coordinate(value: float) -> str:
    """A coordinate with three decimals; what rounds to zero has no sign."""
    text = f"{round(float(value), DECIMALS):.{DECIMALS}f}"
    return text[1:] if text.startswith("-") and not text.strip("-0.") else text


def graph_hash(x: list[list[int]], pos: list[list[float]]) -> str:
    """The first 16 hex digits of the SHA-256 of node features and rounded positions, as compact JSON.

    Positions pass through single precision first, as graphs hold them.
    """
    rows = [[coordinate(v) for v in row] for row in np.asarray(pos, np.float32).tolist()]
    text = json.dumps({"pos": rows, "x": [list(map(int, r)) for r in x]}, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:HEX_DIGITS]


@F.pandas_udf(T.StringType())
def pose_hash(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """graph_hash of the columns x and pos; null if either is null."""
    for xs, poss in batches:
        yield pd.Series([None if x is None or p is None else graph_hash([list(r) for r in x], [list(r) for r in p]) for x, p in zip(xs, poss)], dtype=object)


def text_hash(column: Column) -> Column:
    return F.substring(F.sha2(column, 256), 1, HEX_DIGITS)


def membership_digest(values: DataFrame, column: str) -> str:
    """SHA-256 over the distinct values in order, each followed by a zero byte; streamed, not collected at once."""
    digest = hashlib.sha256()
    for row in values.select(column).dropna().distinct().orderBy(column).toLocalIterator():
        digest.update(row[0].encode() + b"\0")
    return digest.hexdigest()


def set_digest(values: DataFrame, column: str) -> str:
    """A fingerprint of the set of distinct values, the same in any order, summed up within the tasks."""
    each = values.select(column).dropna().distinct()
    parts = each.agg(F.count(F.lit(1)), *(F.bit_xor(F.xxhash64(F.lit(k), column)) for k in range(4))).first()
    return hashlib.sha256(repr(tuple(parts)).encode()).hexdigest()
