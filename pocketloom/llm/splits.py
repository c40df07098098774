"""Splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pocketloom.llm.contraction import contract, edges_of, numbered, random_mate_hooks
from pocketloom.runtime import materialize

#: Default shares of the rows, smallest splits last to be named, largest first.
FRACTIONS = {"train": 0.97, "val": 0.015, "test": 0.015}
#: Slices by hash over which a running total is taken, so that no task orders a whole group.
SLICES = 256
#: A group of more than one part in so many of what the least split is to have is dealt by itself.
PARTS = 50
#: The golden ratio's fraction: multiples of it spread evenly over a period.
TURN = 0.6180339887498949


def related_groups(records: DataFrame, keys: list[str], links: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """records with a column group: equal for records that share a value in any of keys, directly or through others.

    links, with columns a and b, relates two values of the first key as well. Records without any key have a null
    group. The graph has a vertex for each key value, not for each record: a record is drawn into its first key that is
    not null, and edges join different key values of one record or link. Random-mate contraction finds its components.
    With a single key and no links there is no edge, and the key itself is the group. Values of different columns are
    different vertices even if equal. Group is the column and value of one vertex of the component; a
    column of that name that records has already gives way to it.
    """
    records = records.drop("group")
    vertex = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(k).cast("string"))) for i, k in enumerate(keys)]
    with_anchor = records.withColumn("__anchor", F.coalesce(*vertex))
    pairs = None
    for v in vertex[1:]:
        more = with_anchor.select(F.col("__anchor").alias("a"), v.alias("b")).dropna().where("a <> b").distinct()
        pairs = more if pairs is None else pairs.unionByName(more)
    if links is not None:
        more = links.select(F.concat(F.lit("0:"), "a").alias("a"), F.concat(F.lit("0:"), "b").alias("b")).dropna().where("a <> b").distinct()
        pairs = more if pairs is None else pairs.unionByName(more)
    if pairs is None:
        return with_anchor.withColumnRenamed("__anchor", "group")
    pairs = materialize(pairs, "pairs")
    vertices = numbered(pairs.select(F.explode(F.array("a", "b")).alias("key")), "key", in_order=False)
    roots = contract(edges_of(pairs, "a", "b", vertices, "key"), random_mate_hooks, seed)
    named = (
        roots.join(vertices.toDF("x", "__anchor"), "x").join(vertices.toDF("root", "__group"), "root").select("__anchor", "__group")
    )
    return with_anchor.join(materialize(named, "groups"), "__anchor", "left").withColumn("group", F.coalesce("__group", "__anchor")).drop("__anchor", "__group")


def conflicting_groups(grouped: DataFrame, split: str, allowed: list[str], keep: list[str]) -> DataFrame:
    """The groups whose records carry at least two of the allowed splits; distinct values of keep for each.

    Splits that are null or not allowed don't count; records with a null group belong to none.
    """
    mask = F.lit(0)
    for i, name in enumerate(allowed):
        mask = F.when(F.col(split) == name, F.lit(1 << i)).otherwise(mask)
    rows = grouped.where(F.col("group").isNotNull()).select("group", *keep, mask.alias("__mask"))
    small = rows.groupBy("group", *keep).agg(F.bit_or("__mask").alias("__mask"))  # hot groups shrink in their own tasks
    marks = small.groupBy("group").agg(F.bit_or("__mask").alias("__all")).where(F.bit_count("__all") >= 2)
    return small.join(marks, "group", "left_semi").select(*keep).distinct()


def assign_splits(grouped: DataFrame, stratum: str, fractions: dict[str, float] = FRACTIONS, seed: int = 7) -> DataFrame:
    """(group, split): every group lies in one split; splits get the given shares of the records, overall and as far as
    possible within each value of stratum.

    A group belongs to the stratum of most of its records (least value on a tie; null is a stratum too). Within its
    stratum, groups follow each other in hash order, and each takes the stretch of the running total that its records
    fill. What small splits are to have is reckoned from all records. A group heavier than that, for every small split,
    goes to the largest split. The other groups of more than one part in PARTS of it, at most PARTS / least share in
    number, are dealt in order on the driver, each small split getting its share of them as far as they fit. What is
    then left to fill comes from the light groups: their running total is marked off in whole periods in which the
    small split with the most to fill has room for a group of mean size; the middle of its stretch decides a group's
    split. Records without a group are not assigned. An empty table gives no rows. Ties in hash order go by the group's
    name, so the result depends on nothing but the data and seed.

    The running total is taken in four steps, over slices by hash, strata, slices of strata and last within one slice
    of one stratum; none of them brings a large part of the data together.
    """
    largest = max(fractions, key=lambda s: (fractions[s], s))
    total_share = sum(fractions.values())
    small_splits = [s for s in sorted(fractions) if s != largest and fractions[s] > 0]
    sizes = (
        grouped.where(F.col("group").isNotNull()).groupBy("group", F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
        .groupBy("group").agg(F.sum("n").alias("weight"), F.min(F.struct((-F.col("n")).alias("m"), "stratum"))["stratum"].alias("stratum"))
    )
    place = F.pmod(F.xxhash64("group", F.lit(seed)), F.lit(1 << 40))
    sizes = materialize(sizes.withColumns({"place": place, "slice": F.floor(place / (1 << 32)).cast("int"), "row": F.pmod(F.xxhash64("stratum", F.lit(seed)), F.lit(SLICES)).cast("int")}), "sizes")
    groups, rows = sizes.agg(F.count(F.lit(1)), F.sum("weight")).first()
    if not groups or not small_splits:
        return sizes.select("group", F.lit(largest).alias("split"))
    target = {s: round(fractions[s] / total_share * rows, 6) for s in small_splits}
    light_most, most = max(min(target.values()) / PARTS, 1.0), max(target.values())
    light = sizes.where(F.col("weight") <= light_most)
    mean, light_rows = light.agg(F.avg("weight"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    heavy = sizes.where(F.col("weight") > light_most)
    dealt = [(r["group"], r["weight"]) for r in heavy.where(F.col("weight") <= most).orderBy("row", "stratum", "place", "group").collect()]
    split_of, left = _deal(dealt, target, light_rows)
    kind = sizes.schema["group"].dataType.simpleString()
    named = sizes.sparkSession.createDataFrame([(g, split_of.get(g, largest)) for g, _ in dealt], f"group {kind}, split string")
    heavies = heavy.where(F.col("weight") > most).select("group", F.lit(largest).alias("split")).unionByName(named)
    if mean is None:
        return heavies
    periods = max(1, int(max(left.values()) / mean))
    at = (F.col("before") + F.col("weight") / 2) * (periods / light_rows)
    phase = at + F.floor(at) * TURN  # turned each period, lest groups of one size always meet the same phases
    phase = phase - F.floor(phase)
    room = max(light_rows, sum(left.values()))
    split, upto = F.lit(largest), 0.0
    for s in small_splits:
        split = F.when((phase >= upto) & (phase < upto + left[s] / room), F.lit(s)).otherwise(split)
        upto += left[s] / room
    return _running(light).select("group", split.alias("split")).unionByName(heavies)


def _deal(groups: list[tuple[str, int]], target: dict[str, float], light_rows: int) -> tuple[dict[str, str], dict[str, float]]:
    """The small splits of those groups (name, weight) that go to one, and what each small split has left to fill.

    In order, a split gets a group that fits once half of it is due by the weight so far. If light groups can't fill
    the rest, further groups that fit follow, heaviest first.
    """
    left, split_of = dict(target), {}
    total, seen = sum(w for _, w in groups) + light_rows, 0
    for g, w in groups:
        seen += w
        due = {s: left[s] - target[s] * (1 - seen / total) for s in target if w <= left[s]}
        s = max(due, key=due.get, default=None)
        if s is not None and due[s] >= w / 2:
            split_of[g] = s
            left[s] -= w
    for g, w in sorted((x for x in groups if x[0] not in split_of), key=lambda x: -x[1]):
        if sum(left.values()) <= light_rows:
            break
        s = max(left, key=left.get)
        if w <= left[s]:
            split_of[g] = s
            left[s] -= w
    return split_of, left


def _running(sizes: DataFrame) -> DataFrame:
    """sizes with before: the weight of all groups before it, in order of row, stratum, slice, place and group."""
    strata = sizes.groupBy("row", "stratum").agg(F.sum("weight").alias("w"))
    rows = strata.groupBy("row").agg(F.sum("w").alias("w"))  # SLICES rows at most
    rows = rows.select("row", (F.sum("w").over(W.orderBy("row")) - F.col("w")).alias("b0"))
    strata = strata.select("row", "stratum", (F.sum("w").over(W.partitionBy("row").orderBy("stratum")) - F.col("w")).alias("b1"))
    slices = sizes.groupBy("row", "stratum", "slice").agg(F.sum("weight").alias("w"))
    slices = slices.select("row", "stratum", "slice", (F.sum("w").over(W.partitionBy("row", "stratum").orderBy("slice")) - F.col("w")).alias("b2"))
    inner = F.sum("weight").over(W.partitionBy("row", "stratum", "slice").orderBy("place", "group")) - F.col("weight")
    offsets = (
        slices.join(strata.withColumnRenamed("row", "r").withColumnRenamed("stratum", "s"), (F.col("row") == F.col("r")) & F.col("stratum").eqNullSafe(F.col("s"))).drop("r", "s")
        .join(F.broadcast(rows), "row").select(F.col("row").alias("r"), F.col("stratum").alias("s"), F.col("slice").alias("l"), (F.col("b0") + F.col("b1") + F.col("b2")).alias("offset"))
    )
    placed = sizes.withColumn("inner", inner)
    on = (F.col("row") == F.col("r")) & F.col("stratum").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("l"))
    return placed.join(offsets, on).withColumn("before", F.col("inner") + F.col("offset")).drop("r", "s", "l", "offset", "inner")
