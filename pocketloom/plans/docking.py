"""Tables of docking jobs: labels, batches and commands. Running them is a scheduler's work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pocketloom.functions.chemistry import default_canonical
from pocketloom.operators.contracts import ContractError, assert_unique
from pocketloom.operators.lookups import with_batches, with_round_robin

#: Poses kept for each docking mode.
MODES = {"fast": 1, "combindvs": 30, "combind": 100}
MOST_JOBS = 1000


def labelled(binding: DataFrame, canonical: Callable[[Column], Column] | None = None) -> DataFrame:
    """binding with SMILES, canonical_smiles, ligand_id and title; (title, uniprot_id) must be unique."""
    form = (canonical or default_canonical())(F.col("smiles"))
    out = binding.withColumns({"SMILES": form, "canonical_smiles": form, "ligand_id": form, "title": form})
    return assert_unique(out, ["title", "uniprot_id"], "the docking labels")


def of_protein(labels: DataFrame, uniprot_id: str) -> DataFrame:
    return labels.where(F.col("uniprot_id") == uniprot_id).select("SMILES", "title")


def ligprep_jobs(ligands: DataFrame, order: list[str], folder: str, size: int = 100, existing: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The ligands with their batch_id, and a job (command, input_smiles, output_mae) for each batch whose output isn't
    among existing."""
    rows = with_batches(ligands, order, size)
    name = F.concat(F.lit(f"{folder}/batch_"), F.col("batch_id").cast("string"))
    jobs = rows.select("batch_id").distinct().select("batch_id", F.lit("glide_ligprep").alias("command"), F.concat(name, F.lit(".csv")).alias("input_smiles"), F.concat(name, F.lit(".maegz")).alias("output_mae"))
    return rows, jobs.where(~F.col("output_mae").isin(*existing)) if existing else jobs


def write_batches(rows: DataFrame, path: str) -> None:
    """A folder of CSV files for each batch."""
    rows.write.mode("overwrite").partitionBy("batch_id").options(header="true", escape='"').csv(path)


def docking_jobs(batches: DataFrame, grid: str, mode: str = "combind") -> DataFrame:
    """A job for each prepared batch (output_mae) against a grid; poses is how many the mode keeps."""
    if mode not in MODES:
        raise ContractError(f"the docking mode must be one of {sorted(MODES)}")
    return batches.select(F.lit("glide_dock").alias("command"), F.lit(grid).alias("grid"), "output_mae", F.lit(MODES[mode]).alias("poses"))


def conversion_sources(files: DataFrame, name: str = "file") -> DataFrame:
    """(base, source, output): of base_pv.maegz and base_raw.maegz the former, if there, and the SDF to make of it."""
    base = F.regexp_extract(name, r"^(.*)_(pv|raw)\.maegz$", 1)
    kind = F.regexp_extract(name, r"^(.*)_(pv|raw)\.maegz$", 2)
    known = files.select(base.alias("base"), kind.alias("kind"), F.col(name).alias("f")).where("kind <> ''")
    best = known.groupBy("base").agg(F.coalesce(F.max(F.when(F.col("kind") == "pv", F.col("f"))), F.max(F.when(F.col("kind") == "raw", F.col("f")))).alias("source"))
    return best.withColumn("output", F.concat("base", F.lit(".sdf")))


def commands(jobs: DataFrame) -> DataFrame:
    """jobs with command_line: all their columns, in order, with a space between. The first column must be command, and
    there must be a row."""
    if not jobs.columns or jobs.columns[0] != "command":
        raise ContractError(f"the first column of a job table is command, not {jobs.columns[:1]}")
    if jobs.isEmpty():
        raise ContractError("there are no jobs")
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")) for c in jobs.columns]
    return jobs.withColumn("command_line", F.concat_ws(" ", *cells))


def dealt(jobs: DataFrame, order: list[str], workers: int = -1) -> DataFrame:
    """commands with job_id, dealt out round robin to at most MOST_JOBS workers."""
    return with_round_robin(commands(jobs), order, workers, MOST_JOBS)
