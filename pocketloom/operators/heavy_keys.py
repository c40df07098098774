"""Per-key results where a few keys hold most records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pocketloom.runtime import materialize

#: Slices into which the distinct values of a key are cut while its median is sought.
SLICES = 64
#: Distinct values of one key that may be ordered in one task; a slice with more is cut again.
AT_ONCE = 1_000_000


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows by key, null keys left out: counted in each task first, so a hot key moves one row a task."""
    keys = df.select(F.col(key).alias("__k")).where(F.col("__k").isNotNull())
    return keys.groupBy("__k").agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed("__k", key)


def heavy_keys(df: DataFrame, key: str, percent: int = 2) -> DataFrame:
    """The keys that hold at least percent of the rows whose key is not null, with their rows.

    Ties and repeated rows count as they stand; an empty table has no heavy key. At most 100 / percent keys come out.
    """
    counts = key_counts(df, key).toDF("__k", "__rows")
    total = counts.agg(F.sum("__rows")).first()[0] or 0
    return counts.where(F.col("__rows") * 100 >= F.lit(percent * total)).toDF(key, "rows")


def per_key_summary(df: DataFrame, key: str, item: str, value: str, at_once: int = AT_ONCE) -> DataFrame:
    """For each key that is not null: rows, distinct items, rows with a value, and the exact median of value.

    Null items are not counted as items; null and NaN values are no values, and a key without values has a null
    median. The median of an even number of values is the mean of the middle two. Repeated rows count.

    No task ever holds the rows of one key: rows are combined by (key, item) and by (key, value) before they move,
    in the task that reads them. The distinct values left are cut into SLICES slices at quantiles of each key's own
    distinct values, so that values far off or in another unit don't crowd the others into one slice. Counts tell
    exactly in which slice, or two, the middle lies. While that holds more than at_once distinct values of any key, it is
    cut again the same way; then only what is left is ordered.
    """
    rows = df.select(F.col(key).alias("__k"), F.col(item).alias("__i"), F.col(value).cast("double").alias("__v")).where(F.col("__k").isNotNull())
    items = (
        rows.groupBy("__k", "__i").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("__k").agg(F.sum("n").alias("rows"), F.count("__i").alias("items"))
    )
    values = rows.where(F.col("__v").isNotNull() & ~F.isnan("__v")).groupBy("__k", "__v").agg(F.count(F.lit(1)).alias("n"))
    values = materialize(values, "values")
    part = values.withColumns({"total": F.lit(None).cast("bigint"), "begin": F.lit(0).cast("bigint")})
    while True:
        part, most = middle_part(part)
        if most <= at_once:
            break
        part = materialize(part, "values")
    first, last = _middle_ranks()
    at = F.col("begin") + F.sum("n").over(W.partitionBy("__k").orderBy("__v"))
    hit = part.withColumn("at", at).where((F.col("at") >= first) & (F.col("at") - F.col("n") < last))
    medians = hit.groupBy("__k").agg(
        ((F.min("__v") + F.max("__v")) / 2).alias("median"), F.first("total").alias("n_values")
    )
    out = items.join(medians, "__k", "left")
    return out.select(F.col("__k").alias(key), "rows", "items", F.coalesce("n_values", F.lit(0)).alias("n_values"), "median")


def _middle_ranks() -> tuple[Column, Column]:
    return F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)


def middle_part(values: DataFrame) -> tuple[DataFrame, int]:
    """Of rows (__k, __v, n, total, begin), a key's distinct values with their counts, those in the slice or slices that
    hold the middle of total (null: of the counts' sum), and the most that any key has of them. begin counts the rows of
    the key below all of them. A slice that is a single value is never more than that."""
    shares = [i / SLICES for i in range(1, SLICES)]
    cuts = values.groupBy("__k").agg(F.percentile_approx("__v", shares, 1000).alias("cuts"), F.sum("n").alias("all"))
    sliced = values.join(cuts, "__k").withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col("__v"))))
    sliced = sliced.withColumn("total", F.coalesce("total", "all")).drop("cuts", "all")
    sizes = sliced.groupBy("__k", "slice").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("distinct"), F.first("total").alias("total"), F.first("begin").alias("begin"))
    upto = sizes.withColumn("end", F.col("begin") + F.sum("m").over(W.partitionBy("__k").orderBy("slice")))
    first, last = _middle_ranks()
    held = upto.where((F.col("end") >= first) & (F.col("end") - F.col("m") < last))
    held = held.groupBy("__k").agg(F.min("slice").alias("lo"), F.max("slice").alias("hi"), F.min(F.col("end") - F.col("m")).alias("below"), F.max("distinct").alias("distinct"))
    held = materialize(held, "middles")
    most = held.agg(F.max("distinct")).first()[0] or 0
    inside = sliced.join(held, "__k").where(F.col("slice").between(F.col("lo"), F.col("hi")))
    return inside.select("__k", "__v", "n", "total", F.col("below").alias("begin")), most
