"""Joins that look up one row, dense numbering, and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pocketloom.operators.contracts import ContractError, assert_unique
from pocketloom.runtime import BROADCAST_BYTES, BROADCAST_ROWS, materialize, row_bytes


def join_many_to_one(
    left: DataFrame, right: DataFrame, on: list[str] | list[tuple[str, str]], how: str = "inner", name: str = "the right side", unique: bool = False
) -> DataFrame:
    """left with the columns of right; a key that right repeats is an error. Null keys match nothing.

    on names columns of both sides, or pairs of a left and a right column. Columns of right keep their names, so they
    must not clash with others of left. One pass over the keys of right tells whether they repeat and whether right is
    small enough, in rows and bytes, to broadcast. unique says that right is grouped by its keys: then nothing is checked, and the join is
    left to adaptive execution.
    """
    pairs = [(x, x) if isinstance(x, str) else x for x in on]
    keys = [f"__r{i}" for i in range(len(pairs))]
    others = [c for c in right.columns if c not in {r for _, r in pairs}]
    clash = set(others) & set(left.columns)
    if clash:
        raise ContractError(f"both sides of the join have the columns {sorted(clash)}")
    side = right.select(*(F.col(f"`{r}`").alias(k) for (_, r), k in zip(pairs, keys)), *others).dropna(subset=keys)
    if not unique:
        counted = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(side)).alias("size"))
        rows, most, size = counted.agg(F.sum("n"), F.max("n"), F.sum("size")).first()
        if (most or 0) > 1:
            assert_unique(side, keys, name)
        if (rows or 0) <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES:
            side = F.broadcast(side)
    condition = reduce(Column.__and__, (left[f"`{x}`"] == side[k] for (x, _), k in zip(pairs, keys)))
    return left.join(side, condition, how).drop(*keys)


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left without a partner, as in a set difference by key."""
    return left.join(right.select(*on).distinct(), on, "left_anti")


def matched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left with a partner, as in a set intersection by key."""
    return left.join(right.select(*on).distinct(), on, "left_semi")


def with_protein_index(df: DataFrame, proteins: DataFrame) -> DataFrame:
    """df with protein_idx by uniprot_id; a protein that proteins lacks is an error."""
    out = materialize(join_many_to_one(df, proteins.select("uniprot_id", "protein_idx"), ["uniprot_id"], "left", "the protein table"), "indexed")
    gone = [r[0] for r in out.where("protein_idx IS NULL").select("uniprot_id").distinct().orderBy("uniprot_id").limit(10).collect()]
    if gone:
        raise ContractError(f"proteins without an index: {gone}")
    return out


def row_numbers(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with name: 0 and on, in the given order, which should be total.

    Rows are sorted by range over all tasks and written; then only the sizes of the ranges are added up, in a table of
    one row for each task, so that nothing is ordered in one place.
    """
    marked = materialize(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    sizes = marked.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__off"))
    low = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    out = marked.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__off") + low).drop("__part", "__off", "__at")


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the distinct values that are not null, in code-point order, numbered from 0."""
    return row_numbers(df.select(key).dropna().distinct(), [key], name).withColumn(name, F.col(name).cast("int"))


def index_from_dictionary(df: DataFrame, key: str, known: DataFrame | None, name: str) -> DataFrame:
    """(key, name) for the distinct values of key, numbered as in known, or from 0 where known is None. A value that
    known lacks is an error."""
    if known is None:
        return dense_index(df, key, name)
    out = join_many_to_one(df.select(key).dropna().distinct(), known.select(key, name), [key], "left", "the dictionary")
    gone = [r[0] for r in out.where(F.col(name).isNull()).select(key).orderBy(key).limit(10).collect()]
    if gone:
        raise ContractError(f"{key} values that the dictionary lacks: {gone}")
    return out


def with_batches(df: DataFrame, order: list[Column | str], size: int = 100, name: str = "batch_id") -> DataFrame:
    """Rows in order, size to a batch; size 0 makes one batch of all."""
    if size < 0:
        raise ContractError("the batch size must not be negative")
    if size == 0:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    return row_numbers(df, order, "__row").withColumn(name, F.floor(F.col("__row") / size)).drop("__row")


def with_round_robin(df: DataFrame, order: list[Column | str], jobs: int, most: int = 1000, name: str = "job_id") -> DataFrame:
    """Rows in order, dealt out to jobs one by one; below 0, to as many as there are rows, up to most. No more jobs than
    rows are used. 0 jobs leaves all rows to job 0, to be run where they are."""
    rows = df.count()
    k = min(most, rows) if jobs < 0 else min(jobs, rows)
    return row_numbers(df, order, "__row").withColumn(name, F.col("__row") % max(k, 1)).drop("__row")
