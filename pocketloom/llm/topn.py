"""Top N rows within every group, by per-group score histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pocketloom.runtime import broadcast_if_small, materialize, small, trimmed

#: Thresholds that are broadcast at most; further ones are joined by shuffling.
MAX_THRESHOLDS = 20_000
#: Cuts of the score range, at these shares of all scores: fine where the best scores are, even elsewhere.
CUTS = sorted({*(2.0**-k for k in range(1, 25)), *(i / 16 for i in range(1, 16))})


def first_of_each(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each key: the first by order, nulls last. A row whose key is null stands for itself.

    One shuffle, by a hash of the key; rows without a key are spread by a hash of their columns instead. The row is
    picked by looking back rather than by rank: a rank limit would sort before the shuffle too, to no avail as keys
    rarely repeat within a task. Rows that tie in all of order: any one.
    """
    lone = F.when(F.col(key).isNull(), F.xxhash64(*df.columns))
    spread = df.withColumn("__lone", lone).withColumn("__hash", F.xxhash64(key, "__lone"))
    w = W.partitionBy("__hash", key, "__lone").orderBy(*(F.asc_nulls_last(c) for c in order))
    before = F.lag(F.lit(True)).over(w)
    kept = spread.withColumn("__before", before).where(F.col(key).isNull() | F.col("__before").isNull())
    return kept.drop("__before", "__hash", "__lone")


def top_n_per_group(df: DataFrame, groups: list[str], score: str, ties: list[str], n: int = 3, rank: str = "rank_no") -> DataFrame:
    """The n rows of each group with the lowest score, numbered 1 to n in rank; equal scores go by ties, ascending.

    Rows whose score or whose group column is null, or whose score is NaN, take no part. Nulls among ties come last;
    rows equal in score and all ties are numbered in an undefined order, so ties should end in a unique column.
    An empty table gives an empty result; other columns are kept.

    df is read more than once, so it should be a written table. Rows that can't be among the n are dropped before they
    are ranked: see without_hopeless. What is left, little more than n rows of each large group, is ranked exactly.
    """
    rows = without_hopeless(df.where(F.col(score).isNotNull() & ~F.isnan(score)).dropna(subset=groups), groups, score, n)
    order = [F.asc(score), *(F.asc_nulls_last(c) for c in ties)]
    hashed = rows.withColumn("__h", F.xxhash64(*groups))  # a number is sorted faster than the strings behind it
    ranked = hashed.withColumn(rank, F.row_number().over(W.partitionBy("__h", *groups).orderBy(*order)))
    return ranked.where(F.col(rank) <= n).drop("__h")


def without_hopeless(rows: DataFrame, groups: list[str], score: str, n: int, most: int = MAX_THRESHOLDS) -> DataFrame:
    """rows, which have neither null groups nor scores, without those beyond the threshold of their group.

    A histogram of scores is counted for each group, within each task first. In every group of 8 n rows or more, the
    lowest bin at which it has n rows gives a threshold that at least n rows meet and no row among its first n exceeds.
    If at most `most` groups have a threshold, and these are small in bytes too, they are broadcast and nothing moves.
    Else those of the groups with 1 / most of all rows are broadcast, so that hot groups shrink in the tasks that read
    them, and the others are joined by shuffling by group, the partitioning in which ranks are found afterwards.
    Thresholds are joined on the group columns themselves; a hash goes along only to sort faster.
    """
    total, cuts = rows.agg(F.count(F.lit(1)), F.percentile_approx(score, CUTS, 100_000)).first()
    if not total:
        return rows
    bin_ = sum((F.when(F.col(score) > float(c), 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0)).cast("int")
    own = [f"__g{i}" for i in range(len(groups))]
    keyed = rows.select(F.xxhash64(*groups).alias("__h"), *(F.col(f"`{g}`").alias(o) for g, o in zip(groups, own)), bin_.alias("__bin"))
    counted = keyed.groupBy("__h", *own, "__bin").agg(F.count(F.lit(1)).alias("m"))
    w = W.partitionBy("__h", *own)
    upto = counted.withColumn("__size", F.sum("m").over(w)).withColumn("upto", F.sum("m").over(w.orderBy("__bin")))
    thresholds = upto.where((F.col("__size") >= 8 * n) & (F.col("upto") >= n)).groupBy("__h", *own).agg(F.min("__bin").alias("__cut"), F.first("__size").alias("__size"))
    thresholds = materialize(thresholds, "thresholds")

    def within(rows: DataFrame, cut: DataFrame) -> DataFrame:
        cut = cut.drop("__size")
        marked = rows.withColumns({"__h": F.xxhash64(*groups), "__b": bin_})
        on = reduce(Column.__and__, (marked[f"`{g}`"] == cut[o] for g, o in zip(groups, own)), marked["__h"] == cut["__h"])
        kept = marked.join(cut, on, "left").where(F.col("__cut").isNull() | (F.col("__b") <= F.col("__cut")))
        return kept.select(*(marked[f"`{c}`"] for c in rows.columns))

    if small(thresholds, most):
        return within(rows, F.broadcast(thresholds))
    hot = F.col("__size") * most >= total
    return within(within(rows, broadcast_if_small(thresholds.where(hot), most)), thresholds.where(~hot))


def best_poses(poses: DataFrame, n: int = 3) -> DataFrame:
    """row_id and rank_no of the n best poses of each uniprot_id and ligand, redelivered poses counted once."""
    upper = F.upper(trimmed("uniprot_id"))
    once = first_of_each(
        poses.select("row_id", "pose_id", "loaded_at", upper.alias("accession"), trimmed("ligand").alias("molecule"), "glide_score", "source_sdf"),
        "pose_id", ["loaded_at", "row_id"],
    ).drop("loaded_at")
    once = materialize(once.where(F.col("glide_score").isNotNull() & ~F.isnan("glide_score")).dropna(subset=["accession", "molecule"]), "poses")
    return top_n_per_group(once, ["accession", "molecule"], "glide_score", ["source_sdf", "pose_id", "row_id"], n).select("row_id", "rank_no")
