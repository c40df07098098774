"""Checks that tables and parameters must pass. What fails raises ContractError, a ValueError, with a few samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pocketloom.schemas import ACTIVE_SPLITS, ALL_SPLITS, COVERAGE_FLOOR

SAMPLES = 10


class ContractError(ValueError):
    pass


def require_columns(df: DataFrame, needed: list[str] | tuple[str, ...], name: str) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ContractError(f"{name} lacks the columns {missing}; it has {df.columns}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count; nulls are equal to each other."""
    return df.groupBy(*keys).count().where("count > 1")


def with_duplicate_flag(df: DataFrame, keys: list[str], flag: str = "is_duplicate") -> DataFrame:
    """df with a flag on every row whose key another row has too. Keys are counted first, so a hot key moves no rows to
    one task; the flags of repeated keys are then joined back, nulls being equal."""
    names = [f"__d{i}" for i in range(len(keys))]
    repeated = duplicate_keys(df, keys).select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)), F.lit(True).alias("__flag"))
    on = reduce(Column.__and__, (df[f"`{k}`"].eqNullSafe(repeated[n]) for k, n in zip(keys, names)))
    return df.join(repeated, on, "left").withColumn(flag, F.coalesce("__flag", F.lit(False))).drop(*names, "__flag")


def assert_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    repeated = duplicate_keys(df, keys).orderBy(*keys).limit(SAMPLES).collect()
    if repeated:
        raise ContractError(f"{name} repeats {keys}: {[tuple(r) for r in repeated]}")
    return df


def assert_empty(df: DataFrame, message: str) -> None:
    """Fails with the first rows of df if it has any."""
    rows = df.limit(SAMPLES).collect()
    if rows:
        raise ContractError(f"{message}: {[tuple(r) for r in rows]}")


def check_fractions(fractions: dict[str, float]) -> dict[str, float]:
    for name, value in fractions.items():
        if not 0 <= value <= 1:
            raise ContractError(f"the {name} fraction is {value}, not within 0 and 1")
    if sum(fractions.values()) > 1 + 1e-9:
        raise ContractError(f"the fractions sum to {sum(fractions.values()):.4f}, more than 1")
    return fractions


def sequence_violations(sequences: DataFrame) -> DataFrame:
    """One row with the number of breaches of each rule on (protein_idx double, sequence): null_fields, not_integral,
    repeated, outside (not within 0 .. rows - 1) and blank."""
    idx = F.col("protein_idx")
    whole = idx == F.floor(idx)
    return sequences.agg(
        F.count_if(idx.isNull() | F.col("sequence").isNull()).alias("null_fields"),
        F.count_if(~whole).alias("not_integral"),
        (F.count(idx) - F.count_distinct(idx)).alias("repeated"),
        (F.coalesce(F.count_if(idx < 0) + F.when(F.max(idx) >= F.count(F.lit(1)), F.lit(1)).otherwise(0), F.lit(0))).alias("outside"),
        F.count_if(F.trim("sequence") == "").alias("blank"),
    )


def assert_sequences(sequences: DataFrame) -> DataFrame:
    broken = {k: v for k, v in sequence_violations(sequences).first().asDict().items() if v}
    if broken:
        raise ContractError(f"the sequence table breaks its rules: {broken}")
    return sequences


def assert_index_range(examples: DataFrame, column: str, rows: int) -> DataFrame:
    most = examples.agg(F.max(column)).first()[0]
    if most is not None and most >= rows:
        raise ContractError(f"{column} is outside the ESM matrix range: at most {most}, the matrix has {rows} rows")
    return examples


def index_mismatches(examples: DataFrame, proteins: DataFrame) -> DataFrame:
    """Distinct (uniprot_id, protein_idx, expected): examples whose index isn't that of the protein table; expected is
    null where the protein is missing there."""
    expected = proteins.select(F.col("uniprot_id").cast("string"), F.col("protein_idx").alias("expected"))
    pairs = examples.select(F.col("uniprot_id").cast("string"), "protein_idx").distinct()
    return pairs.join(expected, "uniprot_id", "left").where(F.col("expected").isNull() | (F.col("expected") != F.col("protein_idx")))


def assert_index_agrees(examples: DataFrame, proteins: DataFrame) -> DataFrame:
    wrong = index_mismatches(examples, proteins)
    assert_empty(wrong.where("expected IS NULL").select("uniprot_id"), "proteins missing from the protein table")
    assert_empty(wrong, "protein_idx disagrees with the protein table")
    return examples


def assert_splits_filled(examples: DataFrame, active: tuple[str, ...], require_val: bool = True) -> DataFrame:
    n = examples.agg(F.count(F.lit(1)).alias("all"), *(F.count_if(F.col("split") == s).alias(s) for s in ("train", "val"))).first()
    if not n["all"]:
        raise ContractError("no examples are left after filtering")
    if not n["train"]:
        raise ContractError("no train examples are left after filtering")
    if require_val and "val" in active and not n["val"]:
        raise ContractError("no val examples are left after filtering")
    return examples


def split_violations(assignment: DataFrame, ligands: DataFrame, edges: DataFrame) -> DataFrame:
    """One row that counts what is wrong with an assignment (ligand, split): missing and extra ligands, illegal labels,
    and edges (src, dst) whose ends lie in different active splits."""
    active = assignment.where(F.col("split").isin(*ACTIVE_SPLITS))
    src, dst = active.select("ligand", "split").toDF("src", "s"), active.select("ligand", "split").toDF("dst", "d")
    crossing = edges.join(src, "src").join(dst, "dst").where("s <> d")
    counts = {
        "missing": ligands.join(assignment, "ligand", "left_anti"),
        "extra": assignment.join(ligands, "ligand", "left_anti"),
        "illegal": assignment.where(~F.coalesce(F.col("split").isin(*ALL_SPLITS), F.lit(False))),
        "crossing": crossing,
    }
    rows = reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("rule")) for k, df in counts.items()))
    return rows.agg(*(F.count_if(F.col("rule") == k).alias(k) for k in counts))


def assert_split_valid(assignment: DataFrame, ligands: DataFrame, edges: DataFrame) -> None:
    broken = {k: v for k, v in split_violations(assignment, ligands, edges).first().asDict().items() if v}
    if broken:
        raise ContractError(f"the split breaks its rules: {broken}")


def coverage_gaps(stats: DataFrame, floor: int = COVERAGE_FLOOR) -> DataFrame:
    """Proteins without val or test ligands, with their kept ligands; required where these are floor or more."""
    kept = F.col("total") - F.col("dropped")
    return stats.where("val = 0 OR test = 0").select("uniprot_id", kept.alias("kept"), "val", "test", (kept >= floor).alias("required"))


def assert_coverage(stats: DataFrame, floor: int = COVERAGE_FLOOR) -> None:
    assert_empty(coverage_gaps(stats, floor).where("required"), "proteins with enough kept ligands lack val or test ligands")
