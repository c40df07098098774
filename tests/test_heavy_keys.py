import random
from statistics import median

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pocketloom.operators.heavy_keys import heavy_keys, per_key_summary

ROWS = "k string, i string, v double"


def test_heavy_keys_count_repeats_but_no_nulls(spark):
    rows = [("a", "x", 1.0)] * 2 + [("b", "x", 1.0)] * 97 + [("c", "x", 1.0)] + [(None, "x", 1.0)] * 400
    assert sorted((r["k"], r["rows"]) for r in heavy_keys(spark.createDataFrame(rows, ROWS), "k", 2).collect()) == [("a", 2), ("b", 97)]
    assert heavy_keys(spark.createDataFrame([], ROWS), "k").collect() == []


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6))
def test_summary_is_exact(spark, seed):
    rng = random.Random(seed)
    values = [None, float("nan"), 0.0, -1e300, 1e300, *(rng.choice([rng.random() * 9, float(rng.randrange(4))]) for _ in range(30))]
    rows = [(rng.choice(["hot", "hot", "hot", f"k{rng.randrange(9)}", None]), rng.choice([None, "x", "y", "z"]), rng.choice(values)) for _ in range(300)]
    got = {r["k"]: (r["rows"], r["items"], r["n_values"], r["median"]) for r in per_key_summary(spark.createDataFrame(rows, ROWS), "k", "i", "v").collect()}
    want = {}
    for k in {r[0] for r in rows} - {None}:
        own = [r for r in rows if r[0] == k]
        numbers = [r[2] for r in own if r[2] is not None and r[2] == r[2]]
        want[k] = (len(own), len({r[1] for r in own} - {None}), len(numbers), median(numbers) if numbers else None)
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][:3] == w[:3] and (got[k][3] == w[3] or abs(got[k][3] - w[3]) <= 1e-9 * abs(w[3]))


def test_other_columns_may_be_called_anything(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 9)] * 3, "rows string, items int, median double, n int")
    assert [tuple(r) for r in heavy_keys(df, "rows").collect()] == [("a", 3)]
    assert [tuple(r) for r in per_key_summary(df.withColumnRenamed("rows", "slice"), "slice", "items", "median").collect()] == [("a", 3, 1, 3, 2.0)]


def test_infinite_values(spark):
    inf = float("inf")
    rows = [("a", None, v) for v in (inf, -inf, 1.0, 2.0, 3.0)] + [("b", None, inf)]
    assert sorted((r["k"], r["median"]) for r in per_key_summary(spark.createDataFrame(rows, ROWS), "k", "i", "v").collect()) == [("a", 2.0), ("b", inf)]


def test_no_rows_and_no_values(spark):
    assert per_key_summary(spark.createDataFrame([], ROWS), "k", "i", "v").collect() == []
    assert [tuple(r) for r in per_key_summary(spark.createDataFrame([("a", None, None)], ROWS), "k", "i", "v").collect()] == [("a", 1, 0, 0, None)]


def test_wrong_units_do_not_crowd_values_into_one_slice(spark):
    """A key with values in two units a billion apart: each step leaves a small part of its distinct values."""
    from pyspark.sql import functions as F

    from pocketloom.operators.heavy_keys import middle_part

    rows = spark.range(40_000).selectExpr("'hot' AS k", "'i' AS i", "CASE WHEN id % 50 = 0 THEN id * 1e9 ELSE 4 + id / 1e5 END AS v")
    values = rows.select(F.col("k").alias("__k"), F.col("v").alias("__v"), F.lit(1).cast("bigint").alias("n"), F.lit(40_000).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("begin"))
    once, most = middle_part(values)
    assert once.count() < 0.05 * 40_000 and most <= once.count() and middle_part(once)[0].count() < 100
    every = sorted(r["v"] for r in rows.collect())
    for at_once in (10**6, 20):
        assert per_key_summary(rows, "k", "i", "v", at_once).first()["median"] == (every[19_999] + every[20_000]) / 2
