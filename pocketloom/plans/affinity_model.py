"""The affinity model's data, and a pyspark.ml regressor in place of the neural one."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pocketloom.functions.chemistry import ngram_bits, plain_canonical_or_null
from pocketloom.functions.nulls import lenient_double, stripped, whole_number
from pocketloom.operators.contracts import ContractError, assert_index_agrees, assert_splits_filled, require_columns
from pocketloom.operators.embeddings import scaled_target, target_moments, unscaled_target, with_descriptors
from pocketloom.operators.metrics import metrics_by, with_errors
from pocketloom.runtime import materialize
from pocketloom.schemas import FINGERPRINT_BITS, PREDICTION, PROTEIN
from pocketloom.sources.experiments import MODEL, Section, data_section, load, run_folder
from pocketloom.sources.matrices import read_matrix
from pocketloom.sources.files import exists, read_text
from pocketloom.sources.runs import Run, first_metric
from pocketloom.sources.tables import read_csv, read_csv_checked, read_manifest


def usable(affinities: DataFrame, data: Section = data_section(MODEL)) -> DataFrame:
    """(uniprot_id, protein_idx, ligand, ligand_idx, split, true_affinity) by the configured column names: active
    splits, wanted proteins, a number to learn, a whole index of 0 or more, and a ligand that is not blank."""
    names = {
        data.uniprot_id_column: "uniprot_id", data.protein_idx_column: "protein_idx", data.smiles_column: "ligand",
        data.ligand_idx_column: "ligand_idx", data.split_column: "split", data.target_column: "true_affinity",
    }
    require_columns(affinities, list(names), "the affinity-split table")
    rows = affinities.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())).where(F.col("split").isin(*data.active_splits))
    if data.include_uniprot_ids:
        rows = rows.where(F.col("uniprot_id").cast("string").isin(*data.include_uniprot_ids))
    rows = rows.withColumns({
        "true_affinity": lenient_double(F.col("true_affinity")), "protein_idx": whole_number(F.col("protein_idx")),
        "ligand_idx": whole_number(F.col("ligand_idx")), "ligand": stripped(F.col("ligand")),
    })
    return rows.dropna(subset=["ligand", "true_affinity", "split", "protein_idx"]).where("ligand <> '' AND protein_idx >= 0")


def valid_ligands(rows: DataFrame, canonical: Callable[[Column], Column] = plain_canonical_or_null, drop_invalid: bool = True) -> DataFrame:
    """Rows whose ligand has a canonical form, which replaces it; others drop out, or are an error."""
    parsed = rows.withColumn("__c", canonical(F.col("ligand")))
    if not drop_invalid:
        bad = [r[0] for r in parsed.where("__c IS NULL").select("ligand").limit(10).collect()]
        if bad:
            raise ContractError(f"ligands without a canonical form: {bad}")
    return parsed.where("__c IS NOT NULL").withColumn("ligand", F.col("__c")).drop("__c")


def model_rows(affinities: DataFrame, matrix: DataFrame, proteins: DataFrame | None, data: Section = data_section(MODEL), require_val: bool = True) -> DataFrame:
    """usable rows with the descriptor of their protein; indices must lie within the matrix and agree with proteins."""
    rows = materialize(usable(affinities, data), "examples")
    assert_splits_filled(rows, data.active_splits, require_val)
    out = with_descriptors(rows, matrix)
    if proteins is not None:
        assert_index_agrees(rows, proteins)
    return out


def summary(rows: DataFrame) -> DataFrame:
    """One row: rows, rows of each active split, distinct proteins and ligands, length of the descriptors."""
    return rows.agg(
        F.count(F.lit(1)).alias("rows_after_filtering"), *(F.count_if(F.col("split") == s).alias(f"num_{s}") for s in ("train", "val", "test")),
        F.count_distinct("uniprot_id").alias("unique_proteins"), F.count_distinct("ligand").alias("unique_ligands"), F.max(F.size("descriptor")).alias("x_d_dim"),
    )


def summary_text(config: Section, row: dict, shape: tuple[int, int]) -> str:
    fields = {
        "Experiment": config.experiment_name, "Output dir": run_folder(config), "Rows after filtering": row["rows_after_filtering"],
        "Train/val/test": f"{row['num_train']} / {row['num_val']} / {row['num_test']}", "Unique proteins": row["unique_proteins"],
        "Unique ligands": row["unique_ligands"], "ESM shape": list(shape), "Chemprop X_d dim": shape[1],
    }
    return "\n".join(f"{k}: {v}" for k, v in fields.items())


def _inputs(spark: SparkSession, config: Section) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    proteins = config.paths.protein_manifest_csv
    table = read_manifest(spark, proteins, PROTEIN) if proteins is not None else None
    return read_csv(spark, config.paths.affinity_split_csv), read_matrix(spark, config.paths.esm_embeddings_npy), table


def dry_run(spark: SparkSession, experiment: str | Path, root: str | Path = ".") -> str:
    config = load(MODEL, experiment, root, check_run=False)
    affinities, matrix, proteins = _inputs(spark, config)
    shape = (matrix.count(), matrix.agg(F.max(F.size("descriptor"))).first()[0])
    return summary_text(config, summary(model_rows(affinities, matrix, proteins, config.data)).first().asDict(), shape)


def features(rows: DataFrame, bits: Callable[[Column], Column] = ngram_bits, size: int = FINGERPRINT_BITS) -> DataFrame:
    """rows with vectors fingerprint (1 for each on-bit) and protein (the descriptor). The on-bits are written down
    first; else Spark would find them again for each of the size places."""
    known = materialize(rows.withColumn("__bits", bits(F.col("ligand"))), "bits")
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains("__bits", i.cast("int")).cast("double"))
    return known.withColumns({"fingerprint": array_to_vector(dense), "protein": array_to_vector(F.col("descriptor").cast("array<double>"))}).drop("__bits")


def regressor(epochs: int = 50, standardize: bool = True) -> Pipeline:
    """Descriptors standardised by what the train rows show, joined to the fingerprint, and a ridge regression."""
    scale = StandardScaler(inputCol="protein", outputCol="scaled", withMean=standardize, withStd=standardize)
    join = VectorAssembler(inputCols=["fingerprint", "scaled"], outputCol="features")
    fit = LinearRegression(featuresCol="features", labelCol="true_affinity", predictionCol="predicted_affinity", maxIter=epochs, regParam=0.1, solver="l-bfgs")
    return Pipeline(stages=[scale, join, fit])


def fitted(learn: DataFrame, epochs: int = 50, standardize: bool = True, scale_target: bool = True) -> tuple[PipelineModel, tuple[float, float]]:
    """The regressor fitted on train rows, and the moments by which their target was scaled first (0 and 1 if not)."""
    moments = target_moments(learn, "true_affinity") if scale_target else (0.0, 1.0)
    return regressor(epochs, standardize).fit(features(scaled_target(learn, "true_affinity", *moments))), moments


def predict(model: PipelineModel, rows: DataFrame, moments: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Predictions in the target's own scale, with their errors; declared columns only, as far as they are there."""
    out = with_errors(unscaled_target(model.transform(features(rows)), "predicted_affinity", *moments))
    return out.select(*(c for c in PREDICTION.fieldNames() if c in out.columns))


def epochs_tried(most: int) -> list[int]:
    """Numbers of epochs at which a fit is looked at: 1, 2, 4 and on, and the most there may be."""
    return sorted({most, *(1 << k for k in range(most.bit_length()) if 1 << k <= most)})


def fitted_early(learn: DataFrame, judge: DataFrame | None, training: Section, model: Section) -> tuple[PipelineModel, PipelineModel, list[dict], tuple[float, float]]:
    """The best fit by the monitored loss, the last one, the losses by epoch, and the moments of the target.

    Fits of 1, 2, 4 ... epochs follow the same path, so each goes on where the one before stood; after each the loss on
    judge is taken (where it has rows). Fitting ends at max_epochs, or once the monitored loss has not improved for
    patience epochs. Train loss is known for every epoch, validation loss for those looked at.
    """
    moments = target_moments(learn, "true_affinity") if model.normalize_targets else (0.0, 1.0)
    rows = materialize(features(scaled_target(learn, "true_affinity", *moments)), "learn")
    held = materialize(features(scaled_target(judge, "true_affinity", *moments)), "judge") if judge is not None else None
    best = last = None
    best_loss, best_epoch, val = float("inf"), 0, {}
    for k in epochs_tried(training.max_epochs):
        last = regressor(k, model.normalize_protein_descriptors).fit(rows)
        done = last.stages[-1].summary
        error = F.col("predicted_affinity") - F.col("true_affinity")
        val[k] = held is not None and last.transform(held).agg(F.avg(error * error)).first()[0]
        seen = {"val_loss": val[k], "train_loss": done.objectiveHistory[-1]}
        loss = first_metric({n: v for n, v in seen.items() if v not in (None, False)}, (training.monitor_metric, "train_loss"))
        if loss < best_loss:
            best, best_loss, best_epoch = last, loss, k
        if k - best_epoch >= training.patience or done.totalIterations < k:  # no better for long, or converged
            break
    losses = last.stages[-1].summary.objectiveHistory
    history = [{"epoch": i, "train_loss": x, "val_loss": val.get(i) or None} for i, x in enumerate(losses)]
    return best, last, history, moments


def train(spark: SparkSession, experiment: str | Path, root: str | Path = ".") -> DataFrame:
    """Fits on train, stops early by val, and writes what the outputs section asks for: checkpoints of the best and last
    fit, the model with all that is needed to use it, and predictions of train and val, or of these together; never of
    test. Loss history, results and metadata are always written."""
    config = load(MODEL, experiment, root)
    if config.outputs.evaluate_test_during_training:
        raise ContractError("test is evaluated apart, never during training")
    run = Run.begin(spark, run_folder(config), config.outputs.overwrite_existing_run, experiment)
    affinities, matrix, proteins = _inputs(spark, config)
    rows = materialize(valid_ligands(model_rows(affinities, matrix, proteins, config.data), drop_invalid=config.data.drop_invalid_smiles), "rows")
    judge = rows.where("split = 'val'") if "val" in config.data.active_splits else None
    best, last, losses, moments = fitted_early(rows.where("split = 'train'"), judge, config.training, config.model)
    facts = summary(rows).first().asDict()
    state = {"mean": moments[0], "deviation": moments[1], "columns": config.data, "active_splits": list(config.data.active_splits), "descriptor_length": facts["x_d_dim"], "fingerprint_bits": FINGERPRINT_BITS}
    if config.outputs.save_checkpoints:
        for name, model in (("best", best), ("last", last)):
            model.write().overwrite().save(run.path("checkpoints", name))
        run.json("checkpoints/target.json", state)
    if config.outputs.save_model_state_dict:
        best.write().overwrite().save(run.path("model", "pipeline"))
        run.json("model/target.json", state)
    run.table("loss_history.csv", spark.createDataFrame([(h["epoch"], h["train_loss"], h["val_loss"]) for h in losses], "epoch int, train_loss double, val_loss double").coalesce(1).orderBy("epoch"))
    run.losses("train_val_loss.png", losses)
    shown = [s for s in config.data.active_splits if s != "test"]
    done = _judged(run, predict(best, rows.where(F.col("split").isin(*shown)), moments), shown, rows, config.outputs)
    run.json("run_metadata.json", {"experiment_name": config.experiment_name, "active_splits": list(config.data.active_splits), "data": config.data, "epochs": len(losses) - 1, **facts})
    return done


def evaluate_test(spark: SparkSession, experiment: str | Path, model: str | Path | None = None, root: str | Path = ".") -> Path:
    """Predictions and results of test by a kept model (the run's own, else its best checkpoint), in a new folder named
    by the time."""
    config = load(MODEL, experiment, root, check_run=False)
    folder = run_folder(config)
    found = [p for p in (f"{folder}/model/pipeline", f"{folder}/checkpoints/best") if exists(spark, p)]
    if model is None and not found:
        raise FileNotFoundError(f"{folder} holds no model")
    path = str(model or found[0])
    kept, state = PipelineModel.load(path), json.loads(read_text(spark, f"{path.rsplit('/', 1)[0]}/target.json"))
    affinities, matrix, proteins = _inputs(spark, config)
    rows = valid_ligands(model_rows(affinities, matrix, proteins, config.data, require_val=False), drop_invalid=config.data.drop_invalid_smiles)
    test = materialize(rows.where("split = 'test'"), "test")
    if test.where(F.size("descriptor") != state["descriptor_length"]).limit(1).count():
        raise ContractError(f"the model was fitted with descriptors of length {state['descriptor_length']}")
    out = folder / time.strftime("test_evaluation_%Y%m%d_%H%M%S")
    _judged(Run.begin(spark, out), predict(kept, test, (state["mean"], state["deviation"])), ["test"], test)
    return out


def _judged(run: Run, predictions: DataFrame, splits: list[str], rows: DataFrame, outputs: Section | None = None) -> DataFrame:
    """Predictions, which must be as many as the rows of their splits, written as the outputs section says."""
    predictions = materialize(predictions, "predictions")
    wanted = rows.where(F.col("split").isin(*splits)).count()
    if predictions.count() != wanted:
        raise ContractError(f"{predictions.count()} predictions for {wanted} rows")
    by = {r["split"]: {k: r[k] for k in ("num_examples", "pearson_r", "rmse", "mae")} for r in metrics_by(predictions, ["split"]).collect()}
    run.split_outputs(predictions, by, splits, ["protein_idx", "ligand_idx"], skip_empty=False, tables=outputs is None or outputs.save_train_val_predictions)
    if outputs is not None and outputs.save_predictions_all:
        run.table("predict_vs_true_affinity_all.csv", predictions.orderBy("split", "protein_idx", "ligand_idx"))
    return predictions


def recorded_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions as a run wrote them."""
    from pocketloom.sources.tables import typed

    return typed(read_csv_checked(spark, path, PREDICTION.fieldNames()), PREDICTION)
