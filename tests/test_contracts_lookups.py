import pytest

from conftest import rows
from pocketloom.operators import contracts as c
from pocketloom.operators.lookups import dense_index, index_from_dictionary, join_many_to_one, matched, unmatched, with_batches, with_protein_index, with_round_robin


def test_columns_and_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    with pytest.raises(c.ContractError, match="lacks"):
        c.require_columns(df, ["k", "z"], "the table")
    with pytest.raises(c.ContractError, match="repeats"):
        c.assert_unique(df, ["k"], "the table")
    assert c.assert_unique(df, ["k", "v"], "the table") is df
    assert rows(c.with_duplicate_flag(df, ["k"])) == [(None, 1, True), (None, 2, True), ("a", 3, False)]


def test_fractions():
    c.check_fractions({"train": 0.97, "val": 0.015, "test": 0.015})
    for bad in ({"train": 1.2}, {"train": -0.1}, {"train": 0.9, "val": 0.2}):
        with pytest.raises(c.ContractError):
            c.check_fractions(bad)


@pytest.mark.parametrize("data,rule", [([(0.0, "A"), (2.0, "A")], "outside"), ([(0.0, "A"), (0.0, "A")], "repeated"), ([(0.5, "A")], "not_integral"), ([(None, "A")], "null_fields"), ([(0.0, " ")], "blank"), ([(-1.0, "A")], "outside")])
def test_sequence_rules(spark, data, rule):
    with pytest.raises(c.ContractError, match=rule):
        c.assert_sequences(spark.createDataFrame(data, "protein_idx double, sequence string"))


def test_sequences_that_hold(spark):
    c.assert_sequences(spark.createDataFrame([(1.0, "A"), (0.0, "C")], "protein_idx double, sequence string"))
    c.assert_sequences(spark.createDataFrame([], "protein_idx double, sequence string"))


def test_examples(spark):
    e = spark.createDataFrame([("a", 9, "train")], "uniprot_id string, protein_idx int, split string")
    with pytest.raises(c.ContractError, match="outside the ESM matrix range"):
        c.assert_index_range(e, "protein_idx", 9)
    for table, message in (([("b", 1)], "missing"), ([("a", 1)], "disagrees")):
        with pytest.raises(c.ContractError, match=message):
            c.assert_index_agrees(e, spark.createDataFrame(table, "uniprot_id string, protein_idx int"))
    with pytest.raises(c.ContractError, match="no val"):
        c.assert_splits_filled(e, ("train", "val"))
    c.assert_splits_filled(e, ("train", "val"), require_val=False)
    for empty, message in ((e.limit(0), "no examples"), (e.withColumn("split", e.uniprot_id), "no train")):
        with pytest.raises(c.ContractError, match=message):
            c.assert_splits_filled(empty, ("train",))


def test_split_rules(spark):
    ligands = spark.createDataFrame([("a",), ("b",), ("c",)], "ligand string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    bad = spark.createDataFrame([("a", "train"), ("b", "test"), ("z", "odd")], "ligand string, split string")
    assert c.split_violations(bad, ligands, edges).first().asDict() == {"missing": 1, "extra": 1, "illegal": 1, "crossing": 1}
    with pytest.raises(c.ContractError):
        c.assert_split_valid(bad, ligands, edges)
    c.assert_split_valid(spark.createDataFrame([("a", "train"), ("b", "dropped"), ("c", "test")], "ligand string, split string"), ligands, edges)


def test_coverage(spark):
    stats = spark.createDataFrame([("big", 120, 10, 0, 5), ("small", 9, 0, 0, 0), ("good", 500, 0, 1, 1)], "uniprot_id string, total long, dropped long, val long, test long")
    assert rows(c.coverage_gaps(stats)) == [("big", 110, 0, 5, True), ("small", 9, 0, 0, False)]
    with pytest.raises(c.ContractError):
        c.assert_coverage(stats)
    c.assert_coverage(stats, floor=200)


def test_many_to_one(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("x", 3), (None, 4)], "k string, v int")
    right = spark.createDataFrame([("a", "A"), (None, "N")], "key string, w string")
    assert rows(join_many_to_one(left, right, [("k", "key")])) == [("a", 1, "A"), ("a", 2, "A")]
    assert len(rows(join_many_to_one(left, right, [("k", "key")], "left"))) == 4
    with pytest.raises(c.ContractError, match="repeats"):
        join_many_to_one(left, right.union(right), [("k", "key")])
    with pytest.raises(c.ContractError, match="both sides"):
        join_many_to_one(left, right.withColumnRenamed("w", "v"), [("k", "key")])
    proteins = spark.createDataFrame([("a", 0)], "uniprot_id string, protein_idx int")
    with pytest.raises(c.ContractError, match="'x'"):
        with_protein_index(left.dropna().withColumnRenamed("k", "uniprot_id"), proteins)
    keys = right.withColumnRenamed("key", "k")
    assert rows(unmatched(left, keys, ["k"])) == [(None, 4), ("x", 3)] and rows(matched(left, keys, ["k"])) == [("a", 1), ("a", 2)]


def test_numbering(spark):
    names = sorted({f"n{i * 7919 % 1000}" for i in range(700)})
    df = spark.createDataFrame([(n,) for n in names + names[:5]] + [(None,)], "k string").repartition(6)
    got = dense_index(df, "k", "idx")
    assert [r["k"] for r in got.orderBy("idx").collect()] == names and [r["idx"] for r in got.orderBy("idx").collect()] == list(range(len(names)))
    assert dense_index(df.limit(0), "k", "idx").collect() == []
    some = df.where("k < 'n2'")
    assert rows(index_from_dictionary(some, "k", got, "idx")) == sorted((n, i) for i, n in enumerate(names) if n < "n2")
    with pytest.raises(c.ContractError, match="lacks"):
        index_from_dictionary(df, "k", got.where("k < 'n5'"), "idx")


def test_batches_and_jobs(spark):
    df = spark.range(250).repartition(5)
    got = {r["id"]: r["batch_id"] for r in with_batches(df, ["id"], 100).collect()}
    assert got == {i: i // 100 for i in range(250)}
    assert {r["batch_id"] for r in with_batches(df, ["id"], 0).collect()} == {0} and with_batches(df.limit(0), ["id"]).collect() == []
    for jobs, most, k in ((7, 1000, 7), (-1, 40, 40), (900, 1000, 250), (0, 1000, 1)):
        assert {r["id"]: r["job_id"] for r in with_round_robin(df, ["id"], jobs, most).collect()} == {i: i % k for i in range(250)}
