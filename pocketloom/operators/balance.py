"""How a split spreads over proteins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pocketloom.schemas import ACTIVE_SPLITS, ALL_SPLITS, FRACTIONS


def protein_stats(members: DataFrame, assignment: DataFrame) -> DataFrame:
    """By protein: total ligands, ligands in each split, and the active ones in per cent of the total, dropped
    included. members holds (uniprot_id, ligand), of which repeats and nulls don't count."""
    pairs = members.select("uniprot_id", "ligand").dropna().distinct().join(assignment.select("ligand", "split"), "ligand", "left")
    counts = pairs.groupBy("uniprot_id").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("split") == s).alias(s) for s in ALL_SPLITS))
    return counts.withColumns({f"{s}_pct": F.lit(100.0) * F.col(s) / F.col("total") for s in ACTIVE_SPLITS})


def _deviations(stats: DataFrame, fractions: dict[str, float]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(s).alias("split"), F.abs(F.col(s) / F.col("total") - F.lit(fractions[s])).alias("deviation")) for i, s in enumerate(ACTIVE_SPLITS)))
    return stats.select("uniprot_id", F.explode(each).alias("d")).select("uniprot_id", "d.*")


def balance_penalty(stats: DataFrame, fractions: dict[str, float] = FRACTIONS) -> DataFrame:
    """One row, balance_penalty: the sum over proteins and active splits of how far the share is from its target."""
    return _deviations(stats, fractions).agg(F.coalesce(F.sum("deviation"), F.lit(0.0)).alias("balance_penalty"))


def worst_deviation(stats: DataFrame, fractions: dict[str, float] = FRACTIONS) -> DataFrame:
    """One row (uniprot_id, split, deviation): the share farthest from its target, the first by protein and split on a tie."""
    rows = _deviations(stats, fractions).where("deviation > 0")
    best = rows.agg(F.min(F.struct((-F.col("deviation")).alias("d"), "uniprot_id", "place", "split")).alias("b")).where("b IS NOT NULL")
    return best.select("b.uniprot_id", "b.split", (-F.col("b.d")).alias("deviation"))
