import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pocketloom.functions.chemistry import ngram_bits, packed, plain_canonical, plain_canonical_or_null, sign_bits
from pocketloom.functions.hashing import coordinate, graph_hash, membership_digest, pose_hash, set_digest, text_hash
from pocketloom.functions.ids import grid_parts, normal_ids, pdb_key, pose_id, pose_id_by_number, subset_file, subset_slug, variant_ligand
from pocketloom.functions.nulls import clean_numbers, lenient_double, no_nan, present, strict_double, stripped, whole_number
from pocketloom.functions.sequences import normal_sequence, truncated


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("o")).first()["o"]


@pytest.mark.parametrize("text,want", [("1.5", 1.5), (" 2 ", 2.0), ("1e3", 1000.0), ("-.5", -0.5), ("1.5d", None), ("1.5f", None), ("nan", None), ("NaN", None), ("x", None), ("", None), (None, None), ("inf", float("inf"))])
def test_lenient_numbers(spark, text, want):
    assert one(spark, text, lenient_double) == want


def test_strict_numbers_and_whole_ones(spark):
    assert one(spark, "7.25", strict_double) == 7.25 and one(spark, None, strict_double) is None and one(spark, "nan", strict_double) is None
    for bad in ("1.5d", "x"):
        with pytest.raises(PySparkException, match="not a number"):
            one(spark, bad, strict_double)
    assert [one(spark, x, whole_number) for x in ("3.0", "3.5", "-2", "x", "9e99")] == [3, None, -2, None, None]


def test_missing_values(spark):
    assert [one(spark, x, present) for x in ("NA", "nan", "", "None", "na", "x")] == [None, None, None, None, "na", "x"]
    assert one(spark, float("nan"), no_nan, "double") is None
    assert clean_numbers(spark.createDataFrame([(float("nan"), 1)], "a double, b int")).first() == (None, 1)
    assert one(spark, "\t a b \n", stripped) == "a b"


def test_grids_and_keys(spark):
    assert tuple(one(spark, " 9KY5_P1_x ", grid_parts)) == ("9KY5", "P1_x")
    for bad in ("9KY5", "_P1", "9KY5_", None, " _ "):
        with pytest.raises(PySparkException, match="grid"):
            one(spark, bad, lambda c: grid_parts(c)["pdb_id"])
    assert one(spark, " a ", lambda c: pdb_key(c, F.lit("b "))) == "a_b"
    with pytest.raises(PySparkException, match="blank"):
        one(spark, " ", lambda c: pdb_key(c, F.lit("b")))
    assert one(spark, "k", lambda c: pose_id(c, F.lit("CC"), F.lit("h"))) == "k_CC_h" and one(spark, "k", lambda c: pose_id_by_number(c, F.lit("CC"), F.lit(3))) == "k_CC_3"


def test_variants(spark):
    assert one(spark, " C-C-12 ", variant_ligand) == "C-C"
    for bad in ("CC", "-3", "CC-x", None):
        with pytest.raises(PySparkException, match="variant"):
            one(spark, bad, variant_ligand)


def test_subset_ids():
    assert normal_ids([" b", "a", "", "b "]) == ("a", "b") and normal_ids(None) is None
    assert subset_slug(["b", "a"]) == "a_b" and subset_file("x.csv", ["a"]) == "a_x.csv" and subset_file("x.csv") == "x.csv"
    with pytest.raises(ValueError):
        normal_ids([" "])


def test_canonical_forms(spark):
    assert one(spark, " CC ", plain_canonical) == "CC" and one(spark, " ", plain_canonical_or_null) is None
    with pytest.raises(PySparkException):
        one(spark, " ", plain_canonical)


def test_fingerprints(spark):
    assert one(spark, [0.5, -1.0, 0.0, 2.0], sign_bits, "array<double>") == [0, 3]
    bits = one(spark, "CCOCCO", ngram_bits)
    assert bits == sorted(set(bits)) and len(bits) == 3 and all(0 <= b < 248 for b in bits)
    assert one(spark, "CC", ngram_bits) == []
    words = spark.createDataFrame([([0, 61, 62, 247],)], "b array<int>").select(*packed(F.col("b"))).first()
    assert tuple(words) == (1 | 1 << 61, 1, 0, 1 << 61)


def test_sequences(spark):
    assert one(spark, " acbzu\n", normal_sequence) == "ACXXX" and one(spark, "ACD", lambda c: truncated(c, 2)) == "AC" and one(spark, "ACD", lambda c: truncated(c, 0)) == "ACD"


def test_pose_hashes(spark):
    assert [coordinate(v) for v in (-0.0004, 0.0, -1.2345, 2, -0.0006)] == ["0.000", "0.000", "-1.234", "2.000", "-0.001"]
    text = json.dumps({"pos": [["0.100", "0.000", "-1.500"]], "x": [[6, 0]]}, separators=(",", ":"))
    want = hashlib.sha256(text.encode()).hexdigest()[:16]
    assert graph_hash([[6, 0]], [[0.1, -0.0001, -1.5]]) == want
    df = spark.createDataFrame([([[6, 0]], [[0.1, -0.0001, -1.5]]), (None, None)], "x array<array<int>>, pos array<array<double>>")
    assert [r[0] for r in df.select(pose_hash("x", "pos")).collect()] == [want, None]
    assert one(spark, "CC", text_hash) == hashlib.sha256(b"CC").hexdigest()[:16]
    ligands = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "ligand string")
    assert membership_digest(ligands, "ligand") == hashlib.sha256(b"a\0b\0").hexdigest()
    assert set_digest(ligands, "ligand") == set_digest(ligands.orderBy("ligand").repartition(3), "ligand") != set_digest(ligands.where("ligand = 'a'"), "ligand")
