"""Adding docked poses to the pose table: first delivery wins, later ones are logged, ranks cover the whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pocketloom.functions.chemistry import default_canonical
from pocketloom.functions.hashing import pose_hash
from pocketloom.functions.ids import grid_parts, pdb_key, pose_id, variant_ligand
from pocketloom.operators.contracts import assert_unique
from pocketloom.operators.ranking import first_wins, with_pose_ranks
from pocketloom.runtime import materialize
from pocketloom.schemas import POSE, POSE_DUPLICATE
from pocketloom.sources.files import delete, exists, move, names, read_text, write_text
from pocketloom.sources.tables import read_evolving, recover


def pose_rows(docked: DataFrame, canonical: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows of the pose table, not ranked yet, with mol_index, x and pos, from docked molecules (source_sdf, mol_index,
    variant, grid, glide_score, x, pos). A malformed variant or grid fails."""
    canonical = canonical or default_canonical()
    ligand = canonical(variant_ligand(F.col("variant")))
    named = docked.withColumns({"ligand": ligand, "grid": F.trim("grid"), "pose_hash": pose_hash("x", "pos")}).withColumn("__g", grid_parts(F.col("grid")))
    keyed = named.withColumns({"uniprot_id": F.col("__g.uniprot_id"), "pdb_id": F.col("__g.pdb_id"), "pdb_key": pdb_key(F.col("__g.pdb_id"), F.col("__g.uniprot_id"))})
    full = keyed.withColumns({"pose_id": pose_id(F.col("pdb_key"), F.col("ligand"), F.col("pose_hash")), "pose_rank": F.lit(0), "is_top_rank": F.lit(False)})
    return full.select(*POSE.fieldNames(), "mol_index", "x", "pos")


def merged(existing: DataFrame, incoming: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The new pose table and the log of what was left out.

    Of the incoming rows the first by (source_sdf, mol_index) of each pose_id enters, unless existing, or the store of
    graphs, has that pose_id already. Ranks are given anew over the whole table. The log has each row left out with the
    rank its pose_id has in the table (null if only the store has it) and where it was found. existing is read more than
    once, so it should be a written table.
    """
    return _merged(existing, incoming, stored)[:2]


def _merged(existing: DataFrame, incoming: DataFrame, stored: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As merged, and the incoming rows that entered."""
    keys = existing.select("pose_id", F.lit(True).alias("in_manifest")).distinct()
    store = (stored if stored is not None else existing.limit(0)).select("pose_id", F.lit(True).alias("in_store")).distinct()
    marked = materialize(incoming.join(keys, "pose_id", "left").join(store, "pose_id", "left"), "incoming")
    known = F.col("in_manifest").isNotNull() | F.col("in_store").isNotNull()
    first, later = first_wins(marked.where(~known), "pose_id", ["source_sdf", "mol_index"])
    entered = materialize(first.select(*incoming.columns), "entered")
    whole = materialize(existing.select(*POSE.fieldNames()).unionByName(entered.select(*POSE.fieldNames())), "union")  # read for the cuts, the sizes and the ranks
    table = materialize(with_pose_ranks(whole).select(*POSE.fieldNames()), "poses")
    assert_unique(table, ["pose_id"], "the pose table")
    # what came first in this very run is in both by the time a later one is met
    late = later.withColumns({"exists_in_manifest": F.lit(True), "exists_in_lmdb": F.lit(True)})
    old = marked.where(known).withColumns({"exists_in_manifest": F.coalesce("in_manifest", F.lit(False)), "exists_in_lmdb": F.coalesce("in_store", F.lit(False))})
    log = late.unionByName(old).drop("pose_rank").join(table.select("pose_id", "pose_rank"), "pose_id", "left")
    return table, log.select(*POSE_DUPLICATE.fieldNames()).orderBy("pose_id", "source_sdf"), entered


#: Buckets of the pose table and the store of graphs, by a hash of pdb_key and ligand: a batch rewrites those it touches.
BUCKETS = 256
_WITH_BUCKET = T.StructType([*POSE.fields, T.StructField("bucket", T.IntegerType())])


def bucket() -> Column:
    return F.pmod(F.xxhash64("pdb_key", "ligand"), F.lit(BUCKETS)).cast("int")


def ingest(incoming: DataFrame, manifest: str, graphs: str, duplicates: str) -> DataFrame:
    """Adds pose_rows to the tables at the three paths and returns the new pose table.

    All poses of a pdb_key and ligand, and so all of one pose_id and of one ranking group, lie in one bucket. Only the
    buckets that the batch has rows for are read, ranked and written anew. A table without buckets, or in CSV, is put
    into buckets first.

    What is to be written is written beside the manifest first: new buckets, new graphs and the log. Then a mark is set,
    and only then are these parts moved to their places. A run that breaks off before the mark leaves everything as it
    was; after it, the next run, or recover_ingest, finishes the moves. So a repeated batch repeats nothing: its poses
    are found in the tables, and each of its rows is logged as a duplicate then.
    """
    spark = incoming.sparkSession
    recover_ingest(spark, manifest, graphs, duplicates)
    incoming = materialize(incoming.withColumn("bucket", bucket()), "docked")
    _bucketed(spark, manifest)
    touched = [r[0] for r in incoming.select("bucket").distinct().orderBy("bucket").collect()]  # BUCKETS at most
    if touched:
        own = F.col("bucket").isin(touched)
        existing = materialize(spark.read.schema(_WITH_BUCKET).parquet(manifest).where(own).select(*POSE.fieldNames()), "existing")
        stored = spark.read.parquet(graphs).where(own).select("pose_id") if _folders(spark, graphs) else None
        table, log, entered = _merged(existing, incoming, stored)
        stage = f"{manifest}.stage"
        parts = {"poses": table.withColumn("bucket", bucket()), "graphs": entered.select("pose_id", "x", "pos", "bucket")}
        for name, df in parts.items():
            df.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{stage}/{name}")
        log.write.mode("overwrite").parquet(f"{stage}/log")
        write_text(spark, f"{stage}/READY", uuid.uuid4().hex)
        recover_ingest(spark, manifest, graphs, duplicates)
    return spark.read.schema(_WITH_BUCKET).parquet(manifest).select(*POSE.fieldNames())


def recover_ingest(spark: SparkSession, manifest: str, graphs: str, duplicates: str) -> None:
    """Finishes a batch that broke off after its mark, and drops what one left that broke off before."""
    stage = f"{manifest}.stage"
    if exists(spark, f"{stage}/READY"):
        batch = read_text(spark, f"{stage}/READY").strip()
        for b in _folders(spark, f"{stage}/poses"):
            move(spark, f"{stage}/poses/{b}", f"{manifest}/{b}")
        for b in _folders(spark, f"{stage}/graphs"):
            for i, part in enumerate(n for n in names(spark, f"{stage}/graphs/{b}") if n.startswith("part-")):
                move(spark, f"{stage}/graphs/{b}/{part}", f"{graphs}/{b}/{batch}-{i}.parquet")
        for i, part in enumerate(n for n in names(spark, f"{stage}/log") if n.startswith("part-")):
            move(spark, f"{stage}/log/{part}", f"{duplicates}/{batch}-{part}")
        delete(spark, f"{stage}/READY")
    delete(spark, stage)
    recover(spark, manifest)


def _folders(spark: SparkSession, path: str) -> list[str]:
    return [n for n in names(spark, path) if n.startswith("bucket=")]


def _bucketed(spark: SparkSession, manifest: str) -> None:
    """Puts a pose table that has no buckets into them."""
    if names(spark, manifest) and _folders(spark, manifest):
        return
    old = read_evolving(spark, manifest, POSE, {"pose_hash": ""}).withColumn("bucket", bucket())
    old.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{manifest}.new")
    if exists(spark, manifest):
        move(spark, manifest, f"{manifest}.old")
    move(spark, f"{manifest}.new", manifest)
    delete(spark, f"{manifest}.old")
