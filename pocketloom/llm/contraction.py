"""Connected components by contracting random stars of an edge table, a round at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pocketloom.runtime import discard, materialize

#: A round shrinks the graph by a constant share on average, so this many are never needed.
MAX_ROUNDS = 200


def numbered(values: DataFrame, name: str, in_order: bool = True) -> DataFrame:
    """(id, name): the distinct values that are not null, numbered and written down, by default in their order.

    In order, ids rise with the values, by code point, but have gaps. They are fixed from here on, also if executors are
    lost.
    """
    distinct = values.select(name).dropna().distinct()
    ordered = distinct.orderBy(name) if in_order else distinct
    return materialize(ordered.select(F.monotonically_increasing_id().alias("id"), name), "vertices")


def edges_of(pairs: DataFrame, a: str, b: str, vertices: DataFrame, name: str) -> DataFrame:
    """(u, v) with u < v: pairs of values as pairs of ids, without loops and repeats."""
    first = vertices.select(F.col("id").alias("i"), F.col(name).alias(a))
    second = vertices.select(F.col("id").alias("j"), F.col(name).alias(b))
    both = pairs.select(a, b).dropna().where(F.col(a) != F.col(b)).distinct()
    ids = both.join(first, a).join(second, b).select("i", "j")
    return ids.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")


def hash_order_hooks(edges: DataFrame, round_no: int, seed: int) -> DataFrame:
    """(x, to): every vertex hooks to the one of lowest hash among its neighbours and itself, hashes fresh each round."""
    h = lambda c: F.xxhash64(c, F.lit(seed), F.lit(round_no))
    low = _both_ways(edges).groupBy("x").agg(F.min_by("y", h("y")).alias("y"))
    return low.select("x", F.when(h("y") < h("x"), F.col("y")).otherwise(F.col("x")).alias("to"))


def random_mate_hooks(edges: DataFrame, round_no: int, seed: int) -> DataFrame:
    """(x, to): every vertex tosses a coin; tails with a neighbour that fell heads hook to the lowest such neighbour.

    A vertex with a single neighbour that finds no mate so hooks to it all the same if its own hash is the higher one,
    so that pairs and the leaves of stars don't wait for their coins. Heads are the lower half of the hashes: every hook
    leads to a lower hash, so hooks never run in circles. All others stay.
    """
    h = lambda c: F.xxhash64(c, F.lit(seed), F.lit(round_no))
    mate = F.min(F.when((h("x") >= 0) & (h("y") < 0), F.col("y")))
    only = F.when((F.count("y") == 1) & (h(F.min("y")) < h("x")), F.min("y"))
    return _both_ways(edges).groupBy("x").agg(F.coalesce(mate, only, F.col("x")).alias("to"))


def contract(edges: DataFrame, hooks: Callable[[DataFrame, int, int], DataFrame], seed: int = 7) -> DataFrame:
    """(x, root) for every vertex of edges (u, v): root is a vertex of its component, the same for all of it.

    Each round hooks vertices to neighbours, renames the ends of all edges accordingly and drops loops and repeats,
    until no edge is left. Then the renamings are unwound from the last to the first. Each round's hooks and edges are
    written to the shared folder, so that lineage stays short and a lost executor costs one round. Hubs are counted
    down within each task before their rows move; where one vertex has a large share of all edges, adaptive execution
    splits its side of the renaming joins. No edges, no vertices: the result is empty then.
    """
    written: list[DataFrame] = []
    edges = materialize(edges, "edges")
    for round_no in range(MAX_ROUNDS):
        if edges.isEmpty():
            return _unwind(written) if written else edges.toDF("x", "root")
        hook = materialize(hooks(edges, round_no, seed), "hooks")
        written.append(hook)
        a, b = hook.toDF("u", "nu"), hook.toDF("v", "nv")
        named = edges.join(a, "u").join(b, "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))
        fewer = named.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        fewer = materialize(fewer, "edges")
        discard(edges)  # hooks stay until the session ends: what is returned reads them
        edges = fewer
    raise RuntimeError(f"the graph was not contracted within {MAX_ROUNDS} rounds")


def _unwind(hooks: list[DataFrame]) -> DataFrame:
    """The hooks of all rounds followed to their end. Later rounds hold fewer vertices, so the joins grow from small."""
    known = None
    for i, hook in enumerate(reversed(hooks)):
        if known is None:
            known = hook.toDF("x", "root")
            continue
        later = known.toDF("to", "end")
        known = hook.join(later, "to", "left").select("x", F.coalesce("end", "to").alias("root"))
        if i % 4 == 3:
            known = materialize(known, "roots")
    return known


def linked_groups(pairs: DataFrame, a: str, b: str, seed: int = 7) -> DataFrame:
    """(ligand, group_ligand) for pairs of linked values in columns a and b: each linked value with the smallest value
    that can be reached from it, itself included.

    A pair with a null end or two equal ends links nothing, and a value in no other pair does not come out. Direction
    and repeats of pairs don't matter. Values are compared and ordered by code point.
    """
    ends = pairs.where(F.col(a) != F.col(b)).select(F.explode(F.array(a, b)).alias("ligand"))
    vertices = numbered(ends, "ligand")
    roots = materialize(contract(edges_of(pairs, a, b, vertices, "ligand"), hash_order_hooks, seed), "roots")
    least = roots.groupBy("root").agg(F.min("x").alias("id")).join(vertices.withColumnRenamed("ligand", "group_ligand"), "id").drop("id")
    members = roots.join(vertices.withColumnRenamed("id", "x"), "x")
    return members.join(least, "root").select("ligand", "group_ligand")
