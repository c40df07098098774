import json

import numpy as np
import pytest
from pyspark.errors import PySparkException

from conftest import rows
from pocketloom.operators.contracts import ContractError
from pocketloom.operators.embeddings import mean_pooled, standard_moments, standardized, with_descriptors
from pocketloom.operators.metrics import metrics_by, with_errors
from pocketloom.plans import affinity_model, docking, linear
from pocketloom.plans.embedding import embedded, read_sequences
from pocketloom.plans.poses import pose_rows
from pocketloom.schemas import AFFINITY, POSE
from pocketloom.sources import experiments, runs, tables
from pocketloom.sources.matrices import read_matrix, write_matrix
from pocketloom.sources.sdf import read_docked


def test_csv_scan_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('uniprot_id,ligand,affinity,more\nP1,"C\\C ""x""",1.5,z\nNA, C ,nan,\n')
    df = tables.read_csv_checked(spark, str(tmp_path / "a.csv"), ["ligand"])
    assert rows(df) == [(None, " C ", None, None), ("P1", 'C\\C "x"', "1.5", "z")]
    assert rows(tables.read_manifest(spark, str(tmp_path / "a.csv"), AFFINITY)) == [(None, " C ", None), ("P1", 'C\\C "x"', 1.5)]
    with pytest.raises(ContractError, match=r"\['absent'\]"):
        tables.read_csv_checked(spark, str(tmp_path / "a.csv"), ["absent", "ligand"])
    out = tables.write_single_csv(df.orderBy("more"), tmp_path / "deep" / "b.csv")
    assert rows(tables.read_csv(spark, str(out))) == rows(df)
    tables.write_parquet(df, str(tmp_path / "p"))
    tables.append_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    with pytest.raises(FileExistsError, match="a.csv"):
        tables.guard_outputs(spark, [tmp_path / "a.csv", tmp_path / "new"], False)
    tables.guard_outputs(spark, [tmp_path / "a.csv"], True)


def test_strict_types_fail_and_lenient_ones_do_not(spark, tmp_path):
    (tmp_path / "a.csv").write_text("uniprot_id,ligand,affinity\nP1,C,1.5x\n")
    assert tables.read_manifest(spark, str(tmp_path / "a.csv"), AFFINITY, strict=False).first()["affinity"] is None
    with pytest.raises(PySparkException, match="not a number"):
        tables.read_manifest(spark, str(tmp_path / "a.csv"), AFFINITY).collect()


def test_evolving_table(spark, tmp_path):
    path = str(tmp_path / "poses.csv")
    assert tables.read_evolving(spark, path, POSE, {"pose_hash": ""}).schema.fieldNames() == POSE.fieldNames()
    columns = [c for c in POSE.fieldNames() if c != "pose_hash"]
    (tmp_path / "poses.csv").write_text(",".join(columns) + "\np,k,l,g,u,d,-1.5,1,True,s\n")
    row = tables.read_evolving(spark, path, POSE, {"pose_hash": ""}).first()
    assert (row["pose_hash"], row["glide_score"], row["pose_rank"], row["is_top_rank"]) == ("", -1.5, 1, True)
    (tmp_path / "poses.csv").write_text("pose_id\np\n")
    with pytest.raises(ContractError):
        tables.read_evolving(spark, path, POSE, {"pose_hash": ""})


def test_put_if_absent_and_replace(spark, tmp_path):
    path = str(tmp_path / "kv")
    a = spark.createDataFrame([("k", 2), ("k", 1), ("m", 3)], "key string, v int")
    assert rows(tables.put_if_absent(a, path, "key")) == [("k", 1), ("m", 3)]
    assert rows(tables.put_if_absent(spark.createDataFrame([("m", 9), ("n", 4)], a.schema), path, "key")) == [("n", 4)]
    assert rows(spark.read.parquet(path)) == [("k", 1), ("m", 3), ("n", 4)]
    tables.replace_parquet(spark.read.parquet(path).where("v > 3"), path)
    assert rows(spark.read.parquet(path)) == [("n", 4)] and not (tmp_path / "kv.old").exists()
    (tmp_path / "kv").rename(tmp_path / "kv.old")
    tables.recover(spark, path)
    assert rows(spark.read.parquet(path)) == [("n", 4)]


ATOM = "    1.2346    0.0000   -2.0000 C   0  0\n"


def block(props, atoms=ATOM, count=1):
    return f"title\n  prog\n\n{count:3d}  0  0  0  0  0            999 V2000\n{atoms}M  END\n" + "".join(f"> <{k}>\n{v}\n\n" for k, v in props.items()) + "$$$$\n"


def test_docked_sdf(spark, tmp_path):
    full = {"s_lp_Variant": "CC-1", "r_i_docking_score": "-7.5", "s_i_glide_gridfile": "9A_P1"}
    folder = tmp_path / "run_docked"
    folder.mkdir()
    (folder / "batch_0_docked.sdf").write_text(block(full) + block({"s_lp_Variant": "CC-1"}) + block(full, "garbage\n") + block(full | {"s_lp_Variant": "CO-2"}))
    (folder / "other.sdf").write_text(block(full))
    got = read_docked(spark, str(tmp_path)).orderBy("mol_index").collect()
    assert [(r["mol_index"], r["variant"], r["glide_score"]) for r in got] == [(0, "CC-1", -7.5), (3, "CO-2", -7.5)] and [list(p) for p in got[0]["pos"]] == [[1.2346, 0.0, -2.0]] and got[0]["x"] == [[6]]
    assert got[0]["source_sdf"] == str(folder / "batch_0_docked.sdf")
    row = pose_rows(read_docked(spark, str(tmp_path))).where("ligand = 'CC'").first()
    assert row["pose_id"] == f"9A_P1_CC_{row['pose_hash']}" and row["pose_rank"] == 0
    with pytest.raises(FileNotFoundError):
        read_docked(spark, str(folder))


def test_matrices(spark, tmp_path):
    df = spark.createDataFrame([(1, [9.0, 8.0]), (0, [1.0, 2.0])], "protein_idx int, descriptor array<float>")
    assert write_matrix(df, tmp_path / "m.npy") == (2, 2) and np.load(tmp_path / "m.npy").tolist() == [[1, 2], [9, 8]]
    assert rows(read_matrix(spark, tmp_path / "m.npy")) == rows(df)
    np.save(tmp_path / "v.npy", np.zeros(3))
    for bad in (lambda: read_matrix(spark, tmp_path / "v.npy"), lambda: write_matrix(df, tmp_path / "x.npy", dtype="int8")):
        with pytest.raises(ContractError):
            bad()


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 5.0]), ("a", [3.0, 5.0]), ("b", None)], "k string, v array<float>")
    assert rows(mean_pooled(df, "k", "v")) == [("a", [2.0, 5.0])]
    mean, deviation = standard_moments(df, "v")
    assert mean == [2.0, 5.0] and deviation == [1.0, 0.0]
    assert [r["z"] for r in standardized(df.where("k = 'a'"), "v", mean, deviation, "z").collect()] == [[-1.0, 0.0], [1.0, 0.0]]
    matrix = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "protein_idx int, descriptor array<float>")
    with pytest.raises(ContractError, match="outside the ESM matrix range"):
        with_descriptors(spark.createDataFrame([(9,)], "protein_idx int"), matrix)


def test_sequences_to_embeddings(spark, tmp_path):
    (tmp_path / "s.csv").write_text("protein_idx,sequence\n1,ac\n0, AAB \n")
    got = rows(embedded(read_sequences(spark, str(tmp_path / "s.csv"))))
    assert [r[0] for r in got] == [0, 1] and got[1][1][0] == 0.5 and got[0][1][-2] == 0 and sum(got[0][1]) == pytest.approx(1)
    (tmp_path / "s.csv").write_text("protein_idx,sequence\n2,AC\n0,AA\n")
    with pytest.raises(ContractError):
        read_sequences(spark, str(tmp_path / "s.csv"))


def write_inputs(tmp_path):
    (tmp_path / "affinity.csv").write_text("uniprot_id,protein_idx,ligand,ligand_idx,affinity,split\nP11111,0,CCO,0,6.0,train\nP22222,1,CCC,1,7.0,train\nP22222,1,CCN,2,8.0,val\nP22222,1,CNC,3,9.0,test\n")
    (tmp_path / "proteins.csv").write_text("uniprot_id,protein_idx\nP11111,0\nP22222,1\n")
    np.save(tmp_path / "esm.npy", np.array([[1, 2, 3], [9, 8, 7]], np.float32))
    config = {
        "experiment_name": "unit", "paths": {"affinity_split_csv": "affinity.csv", "protein_manifest_csv": "proteins.csv", "esm_embeddings_npy": "esm.npy", "runs_dir": "runs"},
        "data": {"include_uniprot_ids": ["P22222"], "active_splits": ["train", "val", "test"]}, "training": {"max_epochs": 2},
    }
    (tmp_path / "experiment.json").write_text(json.dumps(config))
    return tmp_path / "experiment.json", config


def test_model_rows_use_the_protein_index(spark, tmp_path):
    path, _ = write_inputs(tmp_path)
    config = experiments.load(experiments.MODEL, path, tmp_path)
    affinities, matrix, proteins = affinity_model._inputs(spark, config)
    got = affinity_model.model_rows(affinities, matrix, proteins, config.data)
    assert {(r["split"], r["ligand"]) for r in got.collect()} == {("train", "CCC"), ("val", "CCN"), ("test", "CNC")}
    assert got.where("split = 'train'").first()["descriptor"] == [9.0, 8.0, 7.0]
    text = affinity_model.dry_run(spark, path, tmp_path)
    assert "Rows after filtering: 3" in text and "Train/val/test: 1 / 1 / 1" in text and "Chemprop X_d dim: 3" in text and "ESM shape: [2, 3]" in text
    (tmp_path / "affinity.csv").write_text((tmp_path / "affinity.csv").read_text().replace("P22222,1", "P22222,9"))
    with pytest.raises(ContractError, match="outside the ESM matrix range"):
        affinity_model.dry_run(spark, path, tmp_path)


def test_train_and_evaluate(spark, tmp_path):
    path, config = write_inputs(tmp_path)
    done = affinity_model.train(spark, path, tmp_path)
    assert {r["split"] for r in done.collect()} == {"train", "val"}
    run = tmp_path / "runs" / "unit"
    assert not (run / "results_test.txt").exists() and (run / "results_val.txt").read_text().startswith("split: val\nnum_examples: 1\n")
    assert json.loads((run / "run_metadata.json").read_text())["num_train"] == 1 and (run / "experiment.json").exists()
    out = affinity_model.evaluate_test(spark, path, root=tmp_path)
    assert (out / "results_test.txt").exists() and (out / "predict_vs_true_affinity_test.csv").read_text().count("\n") == 2
    with pytest.raises(FileExistsError):
        affinity_model.train(spark, path, tmp_path)
    path.write_text(json.dumps(config | {"outputs": {"overwrite_existing_run": True, "evaluate_test_during_training": True}}))
    with pytest.raises(ContractError, match="never during training"):
        affinity_model.train(spark, path, tmp_path)


def test_training_stops_early_and_writes_what_is_asked_for(spark, tmp_path):
    path, config = write_inputs(tmp_path)
    lines = [f"P22222,1,{'C' * (i % 9 + 3)}{'NO'[i % 2]},{i},{5 + i % 9 / 3},{'train' if i % 4 else 'val'}" for i in range(60)]
    (tmp_path / "affinity.csv").write_text("\n".join(["uniprot_id,protein_idx,ligand,ligand_idx,affinity,split", *lines]) + "\n")
    outputs = {"save_train_val_predictions": False, "save_model_state_dict": False, "save_predictions_all": True}
    path.write_text(json.dumps(config | {"training": {"max_epochs": 40, "patience": 4}, "outputs": outputs}))
    affinity_model.train(spark, path, tmp_path)
    run = tmp_path / "runs" / "unit"
    assert not (run / "predict_vs_true_affinity_val.csv").exists() and not (run / "model").exists() and (run / "results_val.txt").exists()
    assert (run / "predict_vs_true_affinity_all.csv").read_text().count("\n") == 61 and (run / "checkpoints" / "best").is_dir() and (run / "checkpoints" / "last").is_dir()
    losses = [x.split(",") for x in (run / "loss_history.csv").read_text().splitlines()[1:]]
    assert [int(x[0]) for x in losses] == list(range(len(losses))) and losses[1][2] != "" and all(x[1] for x in losses)
    assert json.loads((run / "checkpoints" / "target.json").read_text())["descriptor_length"] == 3
    assert affinity_model.epochs_tried(50) == [1, 2, 4, 8, 16, 32, 50]


def test_usable_rows(spark):
    data = [("p", "1.0", " C ", "0", "5", "train"), ("p", "1.5", "C", "0", "5", "train"), ("p", "-1", "C", "0", "5", "train"), ("p", "1", " ", "0", "5", "train"), ("p", "1", "C", "0", "x", "train"), ("p", "1", "C", "0", "5", "dropped"), ("p", "1", None, "0", "5", "val")]
    got = affinity_model.usable(spark.createDataFrame(data, "uniprot_id string, protein_idx string, ligand string, ligand_idx string, affinity string, split string"))
    assert rows(got) == [("p", 1, "C", 0, "train", 5.0)]
    with pytest.raises(ContractError, match="canonical"):
        affinity_model.valid_ligands(got.withColumn("ligand", got.split.substr(9, 9)), drop_invalid=False)


def test_recorded_predictions_give_their_metrics(spark, tmp_path):
    lines = ["uniprot_id,protein_idx,ligand,ligand_idx,split,true_affinity,predicted_affinity,abs_error,squared_error"]
    pairs = [(5.0, 5.5), (6.0, 5.0), (7.5, 7.0)]
    lines += [f'P1,0,"C\\C=""{i}",{i},test,{t},{p},{abs(p - t)},{(p - t) ** 2}' for i, (t, p) in enumerate(pairs)]
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    rows_ = affinity_model.recorded_predictions(spark, str(tmp_path / "r.csv"))
    got = metrics_by(rows_, ["split"]).first()
    t, p = np.array(pairs).T
    assert got["pearson_r"] == pytest.approx(np.corrcoef(t, p)[0, 1], abs=1e-12) and got["rmse"] == pytest.approx(np.sqrt(((p - t) ** 2).mean()), abs=1e-12) and got["mae"] == pytest.approx(np.abs(p - t).mean(), abs=1e-12)
    again = with_errors(rows_.drop("abs_error", "squared_error"))
    assert rows(again.select(*rows_.columns)) == rows(rows_) and rows_.first()["ligand"].startswith("C\\C=")


AFFINITY_CSV = "uniprot_id,ligand,affinity,split\nP11111,CCO,6.0,train\nP22222,CCC,7.0,train\nP22222,CCN,8.0,val\nP11111,CCO,6.5,test\nP11111,CXX,6.5,test\n"
POSE_CSV = "uniprot_id,ligand,glide_score\nP11111,CCO,-5\nP11111,CCO,-4\nP22222,CCC,-6\nP22222,CCN,-7\nP22222,CCN,bad\n"


def test_linear_baseline(spark, tmp_path):
    (tmp_path / "a.csv").write_text(AFFINITY_CSV)
    (tmp_path / "p.csv").write_text(POSE_CSV)
    got = linear.evaluate(spark, poses=str(tmp_path / "p.csv"), affinities=str(tmp_path / "a.csv"), out=tmp_path / "out")
    assert {(r["ligand"], r["split"], r["min_glide_score"], round(r["predicted_affinity"], 6)) for r in got.collect()} == {("CCO", "train", -5.0, 6.0), ("CCC", "train", -6.0, 7.0), ("CCN", "val", -7.0, 8.0), ("CCO", "test", -5.0, 6.0)}
    text = (tmp_path / "out" / "results_train.txt").read_text().splitlines()
    assert text[:2] == ["split: train", "num_examples: 2"] and float(text[3].split()[1]) == pytest.approx(-1) and text[4].startswith("intercept: ")
    only = linear.examples(tables.read_csv(spark, str(tmp_path / "p.csv")), tables.read_csv(spark, str(tmp_path / "a.csv")), experiments.data_section(experiments.LINEAR, include_uniprot_ids=["P22222"]))
    assert only.count() == 2
    config = {"experiment_name": "line", "paths": {"pose_csv": "p.csv", "affinity_split_csv": "a.csv", "runs_dir": "runs"}}
    (tmp_path / "e.json").write_text(json.dumps(config))
    linear.evaluate(spark, tmp_path / "e.json", root=tmp_path)
    meta = json.loads((tmp_path / "runs" / "line" / "run_metadata.json").read_text())
    assert (meta["num_train"], meta["num_val"], meta["num_test"]) == (2, 1, 1) and meta["slope"] == pytest.approx(-1)
    with pytest.raises(FileExistsError):
        linear.evaluate(spark, tmp_path / "e.json", root=tmp_path)
    (tmp_path / "p.csv").write_text("uniprot_id,ligand,glide_score\n")
    with pytest.raises(ContractError):
        linear.evaluate(spark, poses=str(tmp_path / "p.csv"), affinities=str(tmp_path / "a.csv"), out=tmp_path / "out")


def test_experiment_files(tmp_path):
    path, config = write_inputs(tmp_path)
    got = experiments.load(experiments.MODEL, path, tmp_path)
    assert got.training.max_epochs == 2 and got.training.batch_size == 64 and got.data.include_uniprot_ids == ("P22222",) and got.paths.esm_embeddings_npy == tmp_path / "esm.npy"
    assert experiments.build(experiments.MODEL, {"paths": {"protein_manifest_csv": None}}, tmp_path).paths.protein_manifest_csv is None
    for change in ({"experiment_name": "a b"}, {"experiment_name": ""}, {"data": {"active_splits": ["val"]}}, {"model": {"aggregation": "sum"}}, {"model": {"message_passing": {"type": "atom"}}}, {"training": {"batch_size": 0}}):
        path.write_text(json.dumps(config | change))
        with pytest.raises(ContractError):
            experiments.load(experiments.MODEL, path, tmp_path)
    path.write_text(json.dumps(config | {"paths": {"affinity_split_csv": "gone.csv"}}))
    with pytest.raises(FileNotFoundError, match="gone.csv"):
        experiments.load(experiments.MODEL, path, tmp_path)


def test_run_folders_and_plots(spark, tmp_path):
    path, _ = write_inputs(tmp_path)
    run = runs.Run.begin(spark, tmp_path / "r", settings=path)
    assert (tmp_path / "r" / "experiment.json").read_text() == path.read_text()
    runs.Run.begin(spark, tmp_path / "r", True)
    (tmp_path / "file").write_text("x")
    for name, over in (("r", False), ("file", True)):
        with pytest.raises(FileExistsError):
            runs.Run.begin(spark, tmp_path / name, over)
    run.json("x.json", {"b": tmp_path, "a": experiments.build(experiments.LINEAR).outputs})
    assert json.loads((tmp_path / "r" / "x.json").read_text())["b"] == str(tmp_path)
    with pytest.raises(ContractError):
        run.losses("x.png", [])
    made = run.losses("x.png", [{"epoch": 0, "train_loss": 1.2, "val_loss": 1.5}, {"epoch": 1, "train_loss": 0.8, "val_loss": 1.0}])
    assert made is None or (tmp_path / "r" / "x.png").stat().st_size > 0
    assert runs.first_metric({"a": None, "b": 2}, ("a", "b")) == 2.0 and runs.first_metric({}, ("a",)) is None
    cells = runs.by_cell(spark.range(5000).selectExpr("id / 7.0 AS x", "id % 10 / 1.0 AS y"), "x", "y", 10)
    assert cells.count() <= 100 and cells.agg({"n": "sum"}).first()[0] == 5000


def test_docking_tables(spark, tmp_path):
    binding = spark.createDataFrame([(" CC", "P1"), ("CO", "P2")], "smiles string, uniprot_id string")
    labels = docking.labelled(binding)
    assert rows(docking.of_protein(labels, "P1")) == [("CC", "CC")]
    with pytest.raises(ContractError, match="repeats"):
        docking.labelled(binding.union(binding))
    batched, jobs = docking.ligprep_jobs(spark.range(250), ["id"], "/x", 100, existing=["/x/batch_1.maegz"])
    assert {r["batch_id"] for r in batched.collect()} == {0, 1, 2} and [r["output_mae"] for r in jobs.orderBy("batch_id").collect()] == ["/x/batch_0.maegz", "/x/batch_2.maegz"]
    assert rows(docking.docking_jobs(jobs, "g.zip", "fast"))[0] == ("glide_dock", "g.zip", "/x/batch_0.maegz", 1)
    with pytest.raises(ContractError):
        docking.docking_jobs(jobs, "g.zip", "slow")
    docking.write_batches(batched, str(tmp_path / "batches"))
    assert sorted(p.name for p in (tmp_path / "batches").glob("batch_id=*")) == ["batch_id=0", "batch_id=1", "batch_id=2"]
    files = spark.createDataFrame([("b_raw.maegz",), ("b_pv.maegz",), ("a_raw.maegz",), ("c.maegz",)], "file string")
    assert rows(docking.conversion_sources(files)) == [("a", "a_raw.maegz", "a.sdf"), ("b", "b_pv.maegz", "b.sdf")]
    table = spark.createDataFrame([("run", 1), ("run", 2)], "command string, n int")
    assert sorted(r["command_line"] for r in docking.dealt(table, ["n"], 1).collect()) == ["run 1", "run 2"]
    for bad in (table.limit(0), table.select("n", "command")):
        with pytest.raises(ContractError):
            docking.commands(bad)


def test_model_predictions_fit_as_many_epochs_as_production(monkeypatch):
    from types import SimpleNamespace

    from pocketloom.plans import affinity_model
    from pocketloom.queries import pipeline

    asked, rows = [], SimpleNamespace(where=lambda _: None)
    monkeypatch.setattr(affinity_model, "target_moments", lambda *_: (0.0, 1.0))
    monkeypatch.setattr(affinity_model, "scaled_target", lambda *_: None)
    monkeypatch.setattr(affinity_model, "features", lambda _: None)
    monkeypatch.setattr(affinity_model, "regressor", lambda epochs, _: asked.append(epochs) or SimpleNamespace(fit=lambda _: None))
    monkeypatch.setattr(pipeline, "materialize", lambda *_: rows)
    monkeypatch.setattr(pipeline, "_described", lambda *_: rows)
    monkeypatch.setattr(pipeline, "predict", lambda *_: None)
    pipeline.QUERIES["model_predictions"](None, "")
    assert asked == [50]


def test_vector_operators_work_on_all_components(spark):
    import numpy as np

    from pocketloom.operators.embeddings import mean_pooled, standard_moments, standardized, with_descriptors

    x = np.random.default_rng(1).normal(size=(6, 64))
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "protein_idx int, k int, descriptor array<double>")
    pooled = {r["k"]: r["pooled"] for r in mean_pooled(df, "k", "descriptor").collect()}
    assert all(np.allclose(pooled[k], x[k::2].mean(0)) for k in (0, 1))
    z = {r["protein_idx"]: r["z"] for r in standardized(df, "descriptor", *standard_moments(df, "descriptor"), "z").collect()}
    assert np.allclose([z[i] for i in range(6)], (x - x.mean(0)) / x.std(0))
    got = {r["protein_idx"]: r["descriptor"] for r in with_descriptors(df.select("protein_idx"), df).collect()}
    assert np.allclose([got[i] for i in range(6)], x)
