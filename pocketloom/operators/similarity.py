"""All pairs of fingerprints at or above a Tanimoto threshold, and the conflict graph they make."""

from __future__ import annotations

import json
import warnings

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pocketloom.functions.chemistry import packed
from pocketloom.runtime import broadcast_if_small, materialize
from pocketloom.schemas import FINGERPRINT_BITS, TANIMOTO_THRESHOLD
from pocketloom.sources.files import delete, exists, read_text, write_text

#: Fingerprints of one block, and the most that a block grows to where there are many: blocks meet in pairs, each pair a
#: group of its own, so rows are copied as often as there are blocks.
BLOCK, MOST_BLOCK, BLOCKS = 4_000, 32_000, 500


def fingerprints(df: DataFrame, id_: str, bits: str, size: int = FINGERPRINT_BITS) -> DataFrame:
    """(id, n, w0 ...): the on-bits of each row packed into words, and their number. Rows without id or bits drop out."""
    known = df.where(F.col(id_).isNotNull() & F.col(bits).isNotNull())
    ones = F.array_distinct(F.col(bits))
    return known.select(F.col(id_).alias("id"), F.size(ones).alias("n"), *packed(ones, size))


def tanimoto_pairs(prints: DataFrame, threshold: float = TANIMOTO_THRESHOLD, block: int | None = None) -> DataFrame:
    """(src, dst, tanimoto), src < dst: pairs of ids with shared on-bits / on-bits of either >= threshold.

    Ids should be unique. Two empty fingerprints have no similarity and make no pair. The graph is dense by nature, a
    large part of all pairs may qualify at low thresholds, so it costs time in the square of the ids; what is saved is
    pairs whose numbers of on-bits alone rule them out: ids are put in order of that number and cut into blocks, and
    only blocks that can qualify are paired. Each pair of blocks is a group of its own by an equi-join, so that no side
    needs to be broadcast and no task gets more than block x block pairs.
    """
    words = [c for c in prints.columns if c.startswith("w")]
    rows = materialize(prints.withColumn("pop", F.col("n")), "prints")
    sizes = rows.groupBy("n").agg(F.count(F.lit(1)).alias("m")).where("n > 0").orderBy("n").collect()  # a row for each number of on-bits
    if block is None:
        block = max(BLOCK, min(MOST_BLOCK, sum(r["m"] for r in sizes) // BLOCKS))
    parts: list[tuple[int, int, int]] = []  # number of on-bits, its blocks from .. upto
    upto = 0
    for r in sizes:
        k = max(1, -(-r["m"] // block))
        parts.append((r["n"], upto, upto + k))
        upto += k
    ranges = [(lo, hi, lo2, hi2) for i, (n, lo, hi) in enumerate(parts) for m, lo2, hi2 in parts[i:] if n >= threshold * m - 1e-9]  # by number of on-bits
    spark = prints.sparkSession
    where = F.broadcast(spark.createDataFrame(parts, "n int, lo int, hi int")) if parts else None
    if where is None:
        return rows.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("tanimoto")).limit(0)
    placed = rows.join(where, "n").withColumn("block", (F.col("lo") + F.pmod(F.xxhash64("id"), F.col("hi") - F.col("lo"))).cast("int")).drop("lo", "hi", "pop")
    plan = spark.createDataFrame(ranges, "lo int, hi int, lo2 int, hi2 int").withColumn("a", F.explode(F.sequence("lo", F.col("hi") - 1)))
    plan = broadcast_if_small(plan.select("a", F.explode(F.sequence("lo2", F.col("hi2") - 1)).alias("b")).where("a <= b"))
    left = placed.select(F.col("block").alias("a"), F.col("id").alias("i"), F.col("n").alias("ni"), *(F.col(w).alias(f"i_{w}") for w in words)).join(plan, "a")
    right = placed.select(F.col("block").alias("b"), F.col("id").alias("j"), F.col("n").alias("nj"), *(F.col(w).alias(f"j_{w}") for w in words))
    right = right.join(plan, "b")
    met = left.join(right, ["a", "b"])
    shared = sum((F.bit_count(F.col(f"i_{w}").bitwiseAND(F.col(f"j_{w}"))) for w in words), F.lit(0))
    score = F.try_divide(shared.cast("double"), (F.col("ni") + F.col("nj") - shared).cast("double"))
    once = (F.col("a") < F.col("b")) | (F.col("i") < F.col("j"))
    hits = met.where(once & (score >= threshold)).select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), score.alias("tanimoto"))
    return hits.where("src <> dst")


def degrees(vertices: DataFrame, edges: DataFrame, vertex: str = "ligand") -> DataFrame:
    """(vertex, degree): how many edges (src, dst) each vertex has, 0 included."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias(vertex)).groupBy(vertex).agg(F.count(F.lit(1)).alias("degree"))
    return vertices.select(vertex).distinct().join(ends, vertex, "left").select(vertex, F.coalesce("degree", F.lit(0)).alias("degree"))


def cached_edges(spark, path: str | None, key: dict, build) -> DataFrame:
    """The edges kept at path if they were built under the same key, else those that build() gives, which are then kept.

    Edges are Parquet, the key a JSON file beside them, with the number of edges; a missing, broken or different key, and
    edges that are missing or broken, mean building anew. No path means no cache. The key is written last, so a run that
    breaks off leaves no key.
    """
    if path is None:
        return materialize(build(), "edges")
    mark, wanted = f"{path}/key.json", json.loads(json.dumps(key))
    if exists(spark, mark):
        kept = _kept_edges(spark, path, wanted)
        if kept is not None:
            return kept
        delete(spark, mark)
    build().write.mode("overwrite").parquet(f"{path}/edges")
    edges = spark.read.parquet(f"{path}/edges")
    write_text(spark, mark, json.dumps({"key": wanted, "edges": edges.count()}, sort_keys=True))
    return edges


def _kept_edges(spark, path: str, wanted: dict) -> DataFrame | None:
    """The edges kept at path, if their key is the one wanted and all of them are there and can be read."""
    try:
        kept = json.loads(read_text(spark, f"{path}/key.json"))
        edges = spark.read.parquet(f"{path}/edges")
        return edges if kept["key"] == wanted and edges.select("src", "dst").count() == kept["edges"] else None
    except (PySparkException, Py4JError, ValueError, TypeError, KeyError) as e:
        warnings.warn(f"the edges kept at {path} can't be read and are built anew: {str(e)[:200]}", stacklevel=3)
        return None
