"""The linear baseline: affinity on the lowest Glide score, fitted on train, judged by split."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pocketloom.functions.nulls import lenient_double
from pocketloom.operators.contracts import ContractError, require_columns
from pocketloom.operators.lookups import join_many_to_one
from pocketloom.operators.metrics import fitted_line, metrics_by, with_prediction
from pocketloom.operators.ranking import minimum_scores
from pocketloom.runtime import materialize
from pocketloom.schemas import LINEAR_OUTPUT
from pocketloom.sources.experiments import LINEAR, Section, data_section, load, run_folder
from pocketloom.sources.runs import Run
from pocketloom.sources.tables import read_csv


def lowest_scores(poses: DataFrame) -> DataFrame:
    require_columns(poses, ["uniprot_id", "ligand", "glide_score"], "the pose table")
    return minimum_scores(poses.withColumn("glide_score", lenient_double(F.col("glide_score"))))


def rated(affinities: DataFrame, data: Section = data_section(LINEAR)) -> DataFrame:
    """(uniprot_id, ligand, true_affinity, split) of the active splits and wanted proteins, by the configured column
    names; rows with a missing ligand, split or number drop out."""
    names = {data.uniprot_id_column: "uniprot_id", data.ligand_column: "ligand", data.target_column: "true_affinity", data.split_column: "split"}
    require_columns(affinities, list(names), "the affinity-split table")
    rows = affinities.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    rows = rows.where(F.col("split").isin(*data.active_splits))
    if data.include_uniprot_ids:
        rows = rows.where(F.col("uniprot_id").cast("string").isin(*data.include_uniprot_ids))
    return rows.withColumn("true_affinity", lenient_double(F.col("true_affinity"))).dropna(subset=["ligand", "true_affinity", "split"])


def examples(poses: DataFrame, affinities: DataFrame, data: Section = data_section(LINEAR)) -> DataFrame:
    """Rated ligands that have a pose of the same protein, with its lowest score as min_glide_score."""
    return join_many_to_one(rated(affinities, data), lowest_scores(poses), ["uniprot_id", "ligand"], unique=True)


def predictions(joined: DataFrame) -> tuple[DataFrame, float, float]:
    """The examples with predicted_affinity, and the slope and intercept of the line through the train examples."""
    slope, intercept = fitted_line(joined.where("split = 'train'"), "min_glide_score", "true_affinity")
    return with_prediction(joined, "min_glide_score", slope, intercept), slope, intercept


def evaluate(
    spark: SparkSession, experiment: str | Path | None = None, poses: str | None = None, affinities: str | None = None, out: str | Path | None = None, root: str | Path = "."
) -> DataFrame:
    """Fits, predicts and writes predictions, results and plots of every split that has examples, from an experiment
    file or from paths. With an experiment the run folder must be free, and its metadata is written too."""
    config = load(LINEAR, experiment, root) if experiment is not None else None
    data = config.data if config else data_section(LINEAR)
    if config is not None:
        out = run_folder(config)
        poses, affinities = config.paths.pose_csv, config.paths.affinity_split_csv
    if poses is None or affinities is None or out is None:
        raise ContractError("give an experiment, or poses, affinities and out")
    run = Run.begin(spark, out, config is None or config.outputs.overwrite_existing_run, experiment)
    left, right = read_csv(spark, affinities), read_csv(spark, poses)
    if right.select("uniprot_id", "ligand", "glide_score").dropna().isEmpty():
        raise ContractError("the pose table has no scored poses")
    joined = materialize(examples(right, left, data), "examples")
    sizes = {r["split"]: r["count"] for r in joined.groupBy("split").count().collect()}
    if not sizes:
        raise ContractError("no affinity examples have a pose")
    if not sizes.get("train"):
        raise ContractError("no train examples are left after filtering")
    rows, slope, intercept = predictions(joined)
    rows = rows.select(*LINEAR_OUTPUT.fieldNames())
    by = {r["split"]: {"num_examples": r["num_examples"], "pearson_r": r["pearson_r"]} for r in metrics_by(rows, ["split"]).collect()}
    ordered = {s: {"pearson_r": v["pearson_r"], "num_examples": v["num_examples"], "slope": slope, "intercept": intercept} for s, v in by.items()}
    texts = {s: {k: v[k] for k in ("num_examples", "pearson_r", "slope", "intercept")} for s, v in ordered.items()}
    run.split_outputs(rows, texts, data.active_splits, ["uniprot_id", "ligand"], skip_empty=True)
    if config is not None and config.outputs.save_predictions_all:
        run.table("predict_vs_true_affinity_all.csv", rows.orderBy("split", "uniprot_id", "ligand"))
    if config is not None:
        meta = {
            "experiment_name": config.experiment_name, "include_uniprot_ids": list(data.include_uniprot_ids), "active_splits": list(data.active_splits),
            "slope": slope, "intercept": intercept, **{f"num_{s}": sizes.get(s, 0) for s in ("train", "val", "test")},
        }
        run.json("run_metadata.json", meta)
    return rows
