"""Orphan references and heavy keys over the project's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pocketloom.operators.heavy_keys import heavy_keys, per_key_summary
from pocketloom.operators.references import Lifetime, find_orphans, orphan_report
from pocketloom.queries.sql import trim
from pocketloom.runtime import accession, table, trimmed


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    proteins = table(spark, sf, "protein_manifest").withColumn("uniprot_id", accession("uniprot_id"))
    life = Lifetime("recorded_at", "added_at", "retired_at")
    parts = []
    for name in ("affinity_manifest", "affinity_split_manifest", "pose_manifest"):
        rows = table(spark, sf, name).select("row_id", "recorded_at", accession("uniprot_id").alias("key"))
        parts.append((name, "uniprot_id", find_orphans(rows, ["key"], proteins, ["uniprot_id"], lifetime=life)))
    rows = table(spark, sf, "affinity_split_manifest").select("row_id", "recorded_at", F.col("protein_idx").alias("key"))
    parts.append(("affinity_split_manifest", "protein_idx", find_orphans(rows, ["key"], proteins, ["protein_idx"], lifetime=life)))
    rows = table(spark, sf, "pose_manifest").select("row_id", "recorded_at", trimmed("ligand").alias("key"))
    ligands = table(spark, sf, "affinity_manifest").select(trimmed("ligand").alias("ligand"), "recorded_at")
    parts.append(("pose_manifest", "ligand", find_orphans(rows, ["key"], ligands, ["ligand"], lifetime=Lifetime("recorded_at", "recorded_at"), broadcast_rows=0)))
    named = [df.select(F.lit(t).alias("src_table"), F.lit(f).alias("ref_field"), "row_id", "recorded_at") for t, f, df in parts]
    return reduce(DataFrame.unionByName, named)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("src_table", "ref_field", "row_id")


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf), ["src_table", "ref_field"], "recorded_at")


def _accessions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "affinity_manifest").select(accession("uniprot_id").alias("uniprot_id"), trimmed("ligand").alias("ligand"), "affinity")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_keys(_accessions(spark, sf), "uniprot_id", 2).select("uniprot_id")


def p5_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = per_key_summary(_accessions(spark, sf), "uniprot_id", "ligand", "affinity")
    return out.select("uniprot_id", "rows", "items", "n_values", F.round("median", 6).alias("median"))


QUERIES = {f.__name__: f for f in (p4_found, p4_report, p5_found, p5_summary)}

def _reference(source: str, field: str, key: str, target: str, target_key: str, life: str) -> str:
    return f"""
        SELECT '{source}' AS src_table, '{field}' AS ref_field, r.row_id, r.recorded_at FROM {source} AS r
        WHERE {key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {target} AS t WHERE {target_key} = {key} AND {life})"""


_LIFE = "t.added_at <= r.recorded_at AND (t.retired_at IS NULL OR t.retired_at > r.recorded_at)"
_ORPHANS = " UNION ALL ".join(
    [
        *(_reference(s, "uniprot_id", f"upper({trim('r.uniprot_id')})", "protein_manifest", f"upper({trim('t.uniprot_id')})", _LIFE) for s in ("affinity_manifest", "affinity_split_manifest", "pose_manifest")),
        _reference("affinity_split_manifest", "protein_idx", "r.protein_idx", "protein_manifest", "t.protein_idx", _LIFE),
        _reference("pose_manifest", "ligand", trim("r.ligand"), f"(SELECT {trim('ligand')} AS ligand, min(recorded_at) AS seen FROM affinity_manifest GROUP BY 1)", "t.ligand", "t.seen <= r.recorded_at"),
    ]
)
ORACLES = {
    "p4_found": f"SELECT src_table, ref_field, row_id FROM ({_ORPHANS})",
    "p4_report": f"SELECT src_table, ref_field, strftime(recorded_at, '%Y-%m') AS month, count(*) AS orphans FROM ({_ORPHANS}) GROUP BY ALL",
    "p5_found": f"""
        WITH c AS (SELECT upper({trim('uniprot_id')}) AS uniprot_id, count(*) AS n FROM affinity_manifest WHERE {trim('uniprot_id')} IS NOT NULL GROUP BY 1)
        SELECT uniprot_id FROM c WHERE n * 100 >= 2 * (SELECT sum(n) FROM c)""",
    "p5_summary": f"""
        SELECT upper({trim('uniprot_id')}) AS uniprot_id, count(*) AS rows, count(DISTINCT {trim('ligand')}) AS items,
            count(*) FILTER (affinity IS NOT NULL AND NOT isnan(affinity)) AS n_values,
            round(median(affinity) FILTER (affinity IS NOT NULL AND NOT isnan(affinity)), 6) AS median
        FROM affinity_manifest WHERE {trim('uniprot_id')} IS NOT NULL GROUP BY 1""",
}
