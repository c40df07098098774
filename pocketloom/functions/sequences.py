"""Protein sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pocketloom.functions.nulls import stripped

# Fixed value: the residues that a protein language model knows; all others become X.
RESIDUES = "ACDEFGHIKLMNPQRSTVWYX"


def normal_sequence(column: Column) -> Column:
    return F.regexp_replace(F.upper(stripped(column)), f"[^{RESIDUES}]", "X")


def truncated(column: Column, length: int) -> Column:
    """The first residues of a sequence; 0 leaves it as it is."""
    if length < 0:
        raise ValueError("length must not be negative")
    return column if length == 0 else F.substring(column, 1, length)
