import math
import random

import pytest

from conftest import rows
from pocketloom.operators.balance import balance_penalty, protein_stats, worst_deviation
from pocketloom.operators.contracts import ContractError
from pocketloom.operators.metrics import fitted_line, metrics_by, with_errors, with_prediction
from pocketloom.operators.ranking import first_wins, minimum_scores, with_pose_ranks
from pocketloom.plans.poses import ingest, merged, pose_rows
from pocketloom.schemas import POSE

POSES = "pose_id string, pdb_key string, ligand string, glide_score double, source_sdf string"
DOCKED = "source_sdf string, mol_index int, variant string, grid string, glide_score double, x array<array<int>>, pos array<array<double>>"


def test_ranks_match_a_plain_sort(spark):
    rng = random.Random(4)
    data = [(f"p{i}", rng.choice(["k", None, "m"]), rng.choice(["CC", "CO"]) if i % 3 else "hot", rng.choice([None, float("nan"), *range(-9, 0)]), rng.choice([None, "a", "b"])) for i in range(1500)]
    data = [(a, b, c, float(d) if d is not None else None, e) for a, b, c, d, e in data]
    got = {r["pose_id"]: (r["pose_rank"], r["is_top_rank"]) for r in with_pose_ranks(spark.createDataFrame(data, POSES)).collect()}
    groups = {}
    for r in data:
        groups.setdefault(r[1:3], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[3] is None or r[3] != r[3], 0 if r[3] is None or r[3] != r[3] else r[3], r[4] is None, r[4] or "", r[0]))
        for i, r in enumerate(g):
            assert got[r[0]] == (i + 1, i == 0)
    assert with_pose_ranks(spark.createDataFrame([], POSES)).collect() == []


def test_first_wins(spark):
    df = spark.createDataFrame([("a", "s2", 1), ("a", "s1", 9), ("b", None, 0), (None, "s", 2), (None, "s", 1)], "k string, s string, n int")
    first, rest = first_wins(df, "k", ["s", "n"])
    assert rows(first) == rows(spark.createDataFrame([("a", "s1", 9), ("b", None, 0), (None, "s", 1)], df.schema)) and rows(rest) == [(None, "s", 2), ("a", "s2", 1)]


def test_minimum_scores(spark):
    df = spark.createDataFrame([("u", "l", -1.0), ("u", "l", float("nan")), ("u", "l", -2.0), (None, "l", -9.0), ("u", "m", None)], "uniprot_id string, ligand string, glide_score double")
    assert rows(minimum_scores(df)) == [("u", "l", -2.0)]


def docked(spark, items):
    return pose_rows(spark.createDataFrame([(s, i, f"{lig}-{i}", grid, score, [[6]], [[x, 0.0, 0.0]]) for s, i, lig, grid, score, x in items], DOCKED))


def test_merge_keeps_the_first_delivery_and_ranks_all(spark):
    old = docked(spark, [("s0", 0, "CC", "9A_P1", -5.0, 1.0)])
    new = docked(spark, [("s2", 0, "CC", "9A_P1", -9.0, 1.0), ("s1", 1, "CC", "9A_P1", -7.0, 2.0), ("s1", 0, "CC", "9A_P1", -6.0, 2.0), ("s1", 2, "CO", "9A_P1", -1.0, 3.0)])
    table, log = merged(old.select(*POSE.fieldNames()), new)
    got = sorted((r["ligand"], r["pose_rank"], r["glide_score"], r["source_sdf"], r["is_top_rank"]) for r in table.collect())
    assert got == [("CC", 1, -6.0, "s1", True), ("CC", 2, -5.0, "s0", False), ("CO", 1, -1.0, "s1", True)]
    assert sorted((r["source_sdf"], r["pose_rank"], r["exists_in_manifest"]) for r in log.collect()) == [("s1", 1, True), ("s2", 2, True)]


def test_ingest_is_repeatable(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("manifest", "graphs", "duplicates")]
    batch = docked(spark, [("s1", 0, "CC", "9A_P1", -6.0, 2.0), ("s1", 1, "CO", "9A_P1", -1.0, 3.0)])
    first = rows(ingest(batch, *paths))
    assert rows(ingest(batch, *paths)) == first and len(first) == 2
    assert spark.read.parquet(paths[0]).count() == 2 == spark.read.parquet(paths[1]).count() and spark.read.parquet(paths[2]).count() == 2


def test_duplicates_are_found_in_the_store_too_and_only_touched_buckets_change(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("manifest", "graphs", "duplicates")]
    first = [("s1", i, "C" * (i + 1), "9A_P1", -6.0, float(i)) for i in range(6)]
    ingest(docked(spark, first), *paths)
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "manifest").rglob("part-*")}
    assert len(stamps) == len({p.parent for p in stamps}) >= 4
    table = ingest(docked(spark, [("s2", 0, "CC", "9A_P1", -9.0, 1.0), ("s2", 1, "CC", "9A_P1", -7.0, 99.0)]), *paths)
    assert {(r["ligand"], r["pose_rank"], r["glide_score"]) for r in table.where("ligand = 'CC'").collect()} == {("CC", 1, -7.0), ("CC", 2, -6.0)} and table.count() == 7
    assert sum(p in stamps and p.stat().st_mtime_ns == stamps[p] for p in (tmp_path / "manifest").rglob("part-*")) == len(stamps) - 1
    log = spark.read.parquet(paths[2]).collect()
    assert [(r["source_sdf"], r["exists_in_manifest"], r["exists_in_lmdb"], r["pose_rank"]) for r in log] == [("s2", True, True, 2)]
    store = docked(spark, [("x", 0, "CN", "9A_P1", -1.0, 5.0)])
    log = merged(spark.createDataFrame([], POSE), store, store.select("pose_id"))[1].collect()
    assert [(r["exists_in_manifest"], r["exists_in_lmdb"], r["pose_rank"]) for r in log] == [(False, True, None)]


def test_a_batch_that_broke_off_is_finished_or_dropped(spark, tmp_path, monkeypatch):
    from pocketloom.plans import poses

    paths = [str(tmp_path / n) for n in ("manifest", "graphs", "duplicates")]
    batch = [("s1", 0, "CC", "9A_P1", -6.0, 2.0), ("s1", 1, "CO", "9A_P1", -1.0, 3.0), ("s2", 0, "CC", "9A_P1", -6.0, 2.0)]
    whole, moves = poses.move, []

    def breaks(spark, source, target):
        if len(moves) == 2 and "stage" in str(source):
            raise OSError("gone")
        moves.append(source)
        whole(spark, source, target)

    monkeypatch.setattr(poses, "move", breaks)
    with pytest.raises(OSError):
        ingest(docked(spark, batch), *paths)
    monkeypatch.setattr(poses, "move", whole)
    poses.recover_ingest(spark, *paths)
    assert spark.read.parquet(paths[0]).count() == 2 == spark.read.parquet(paths[1]).count() and spark.read.parquet(paths[2]).count() == 1
    (tmp_path / "manifest.stage" / "poses" / "bucket=1").mkdir(parents=True)
    poses.recover_ingest(spark, *paths)
    assert not (tmp_path / "manifest.stage").exists() and spark.read.parquet(paths[0]).count() == 2


def test_stream_of_docked_poses(spark, tmp_path):
    from pocketloom.streaming.poses import start_ingest

    data = [("s1", 0, "CC-1", "9A_P1", -6.0, [[6]], [[1.0, 0.0, 0.0]]), ("s2", 0, "CC-1", "9A_P1", -8.0, [[6]], [[2.0, 0.0, 0.0]])]
    for i, r in enumerate(data):
        spark.createDataFrame([r], DOCKED).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.createDataFrame([], DOCKED).schema).parquet(str(tmp_path / "in"))
        start_ingest(stream, *(str(tmp_path / n) for n in ("m", "g", "d")), checkpoint=str(tmp_path / "c")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "m")).count() == i + 1
    assert [r["pose_rank"] for r in spark.read.parquet(str(tmp_path / "m")).orderBy("glide_score").collect()] == [1, 2]


def test_line_and_metrics(spark):
    df = spark.createDataFrame([(-1.0, 2.0, "train"), (-2.0, 4.0, "train"), (-3.0, 7.0, "val")], "x double, true_affinity double, split string")
    slope, intercept = fitted_line(df.where("split = 'train'"), "x", "true_affinity")
    assert (round(slope, 9), round(intercept, 9)) == (-2.0, 0.0)
    out = with_errors(with_prediction(df, "x", slope, intercept))
    assert sorted((r["split"], round(r["abs_error"], 9), round(r["squared_error"], 9)) for r in out.collect()) == [("train", 0.0, 0.0), ("train", 0.0, 0.0), ("val", 1.0, 1.0)]
    by = {r["split"]: r for r in metrics_by(out, ["split"]).collect()}
    assert by["val"]["num_examples"] == 1 and math.isnan(by["val"]["pearson_r"]) and by["val"]["rmse"] == pytest.approx(1) and by["train"]["pearson_r"] == pytest.approx(1)
    none = metrics_by(out.limit(0), []).first()
    assert none["num_examples"] == 0 and all(math.isnan(none[k]) for k in ("pearson_r", "rmse", "mae"))
    flat = metrics_by(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "true_affinity double, predicted_affinity double"), []).first()
    assert math.isnan(flat["pearson_r"])
    for bad in (df.limit(0), df.limit(1), df.withColumn("x", df.x * 0)):
        with pytest.raises(ContractError):
            fitted_line(bad, "x", "true_affinity")


def test_balance(spark):
    members = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "b"), ("p", "c"), ("q", "a"), (None, "a")], "uniprot_id string, ligand string")
    split = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "dropped")], "ligand string, split string")
    stats = protein_stats(members, split)
    got = {r["uniprot_id"]: r for r in stats.collect()}
    assert got["p"]["total"] == 3 and got["p"]["dropped"] == 1 and got["p"]["test_pct"] == pytest.approx(100 / 3) and got["q"]["train_pct"] == 100
    f = {"train": 0.5, "val": 0.25, "test": 0.25}
    assert balance_penalty(stats, f).first()[0] == pytest.approx(abs(1 / 3 - 0.5) + 0.25 + abs(1 / 3 - 0.25) + 0.5 + 0.25 + 0.25)
    assert tuple(worst_deviation(stats, f).first()) == ("q", "train", 0.5)
    assert worst_deviation(stats.limit(0), f).collect() == [] and balance_penalty(stats.limit(0), f).first()[0] == 0
