"""Ranks and duplicates of docking poses, also where one group holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of scores into which a group is cut for ranking, and parts of a key in which its first row is sought.
RANGES, PARTS = 64, 32


def with_pose_ranks(poses: DataFrame, groups: tuple[str, ...] = ("pdb_key", "ligand"), ties: tuple[str, ...] = ("source_sdf", "pose_id")) -> DataFrame:
    """poses with pose_rank, from 1 for the lowest glide_score of its group, and is_top_rank.

    Missing scores (null and NaN) come last; equal scores go by ties, of which nulls come last. Null group columns are
    equal to each other. Each group is cut at quantiles of all scores into RANGES ranges, which are ranked apart, in
    tasks of their own; the ranks of a range begin where the counts of the ranges before it end. Rows are shuffled
    once, by group and range.
    """
    score = F.when(~F.isnan("glide_score"), F.col("glide_score"))
    cuts = poses.agg(F.percentile_approx(score, [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []
    range_ = F.when(score.isNull(), RANGES).otherwise(sum((F.when(score > float(c), 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0)))
    # nulls are filled in and marked, so that the join below has plain equal keys and meets the windows' partitioning
    mask = sum((F.when(F.col(g).isNull(), 1 << i).otherwise(0) for i, g in enumerate(groups)), F.lit(0))
    rows = poses.withColumns({"__group": F.xxhash64(*groups), "__range": range_.cast("int"), "__mask": mask})
    rows = rows.withColumns({g: F.coalesce(g, F.lit("0" if rows.schema[g].dataType.typeName() != "string" else "").cast(rows.schema[g].dataType)) for g in groups})
    keys = ["__group", "__mask", *groups, "__range"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*keys[:-1]).orderBy("__range")) - F.col("__n")
    own = F.row_number().over(W.partitionBy(*keys).orderBy(score.asc_nulls_last(), *(F.asc_nulls_last(c) for c in ties)))
    out = rows.withColumn("__own", own).join(sizes.withColumn("__before", before).drop("__n"), keys)
    out = out.withColumns({"pose_rank": (F.col("__before") + F.col("__own")).cast("int"), **{g: F.when(F.col("__mask").bitwiseAND(1 << i) == 0, F.col(g)) for i, g in enumerate(groups)}})
    return out.select(*poses.columns, *(c for c in ["pose_rank"] if c not in poses.columns)).withColumn("is_top_rank", F.col("pose_rank") == 1)


def first_wins(df: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key by order, nulls last, and all others; null keys are one key. Rows that tie in all of
    order: any one is first. A key is cut into parts by a hash of order; only the first of each part meet."""
    part = F.pmod(F.xxhash64(*order), F.lit(PARTS))
    by = [F.asc_nulls_last(c) for c in order]
    local = df.withColumn("__part", part).withColumn("__a", F.row_number().over(W.partitionBy(key, "__part").orderBy(*by))).drop("__part")
    heads = local.where("__a = 1").withColumn("__b", F.row_number().over(W.partitionBy(key).orderBy(*by)))
    first = heads.where("__b = 1").drop("__a", "__b")
    return first, local.where("__a > 1").drop("__a").unionByName(heads.where("__b > 1").drop("__a", "__b"))


def minimum_scores(poses: DataFrame, groups: tuple[str, ...] = ("uniprot_id", "ligand"), score: str = "glide_score", name: str = "min_glide_score") -> DataFrame:
    """The lowest score of each group; rows with a missing group column or score don't count."""
    rows = poses.select(*groups, F.col(score).cast("double").alias(score)).dropna()  # dropna takes NaN as missing too
    return rows.groupBy(*groups).agg(F.min(score).alias(name))
