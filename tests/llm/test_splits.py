import random
from collections import Counter, defaultdict

from pocketloom.llm.splits import FRACTIONS, assign_splits, conflicting_groups, related_groups

RECORDS = "row_id long, ligand string, author string, uniprot_id string"


def test_groups_join_records_through_any_key_and_links(spark):
    rows = [(1, "a", None, "u"), (2, "a", "x", "u"), (3, "b", "x", "u"), (4, "c", "y", "u"), (5, None, "y", "u"), (6, None, None, "u"), (7, "x", None, "u")]
    links = spark.createDataFrame([("c", "x"), ("c", "c"), (None, "a")], "a string, b string")
    got = {r["row_id"]: r["group"] for r in related_groups(spark.createDataFrame(rows, RECORDS), ["ligand", "author"], links).collect()}
    assert got[1] == got[2] == got[3] and got[4] == got[5] == got[7] and got[1] != got[4] and got[6] is None


def test_conflicts_count_only_allowed_splits(spark):
    rows = [("a", "train"), ("a", "test"), ("b", "train"), ("b", "dropped"), ("b", None), ("c", "val"), ("c", "val"), (None, "val"), (None, "test")]
    grouped = related_groups(spark.createDataFrame(rows, "ligand string, split string"), ["ligand"])
    assert [tuple(r) for r in conflicting_groups(grouped, "split", ["train", "val", "test"], ["ligand"]).collect()] == [("a",)]


def test_shares_hold_overall_and_by_stratum_and_groups_stay_whole(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for lig in range(6000):
        stratum = "big" if lig < 3000 else rng.choice(["m1", "m2", None, f"s{rng.randrange(40)}"])
        for _ in range(rng.choice([1, 1, 2, 3])):
            rows.append((i, f"l{lig}", None, stratum))
            i += 1
    rows += [(i + k, "giant", None, "big") for k in range(2000)]
    grouped = related_groups(spark.createDataFrame(rows, RECORDS), ["ligand"])
    fractions = {"train": 0.9, "val": 0.05, "test": 0.05}
    first = {r["group"]: r["split"] for r in assign_splits(grouped, "uniprot_id", fractions).collect()}
    again = {r["group"]: r["split"] for r in assign_splits(grouped.repartition(7), "uniprot_id", fractions).collect()}
    assert first == again and len(first) == 6001 and first["0:giant"] == "train"
    count, by = Counter(), defaultdict(Counter)
    for r in grouped.collect():
        count[first[r["group"]]] += 1
        by[r["uniprot_id"]][first[r["group"]]] += 1
    total = sum(count.values())
    assert abs(count["val"] / total - 0.05) < 0.01 and abs(count["test"] / total - 0.05) < 0.01
    for s in ("m1", "m2"):
        n = sum(by[s].values())
        assert abs(by[s]["val"] / n - 0.05) < 0.03


def _shares(spark, weights, fractions=FRACTIONS):
    grouped = spark.createDataFrame([(f"g{i}", i % 5, w) for i, w in enumerate(weights)], "group string, s int, w int").selectExpr("group", "s", "explode(sequence(1, w))")
    split = {r["group"]: r["split"] for r in assign_splits(grouped, "s", fractions).collect()}
    assert len(split) == len(weights)
    count = Counter()
    for i, w in enumerate(weights):
        count[split[f"g{i}"]] += w / sum(weights)
    return count


def test_small_splits_are_filled_whatever_the_weights(spark):
    """A giant of a third; only heavy groups; a giant, heavy groups and few light ones; a long tail; equal groups and unequal shares."""
    rng = random.Random(3)
    cases = [
        ([10_000] + [1] * 20_000, FRACTIONS),
        ([100] * 200, FRACTIONS),
        ([19_000] + [290] * 2 + [1] * 420, FRACTIONS),
        ([rng.choice([60, 90, 150]) for _ in range(300)] + [1] * 3000, FRACTIONS),
        ([max(1, 4000 // k) for k in range(1, 6000)], FRACTIONS),
        ([2] * 10_000, {"train": 0.88, "val": 0.07, "test": 0.05}),
    ]
    for weights, fractions in cases:
        got = _shares(spark, weights, fractions)
        for s in ("val", "test"):
            assert abs(got[s] / fractions[s] - 1) < 0.07, (len(weights), got)


def test_empty_and_keyless(spark):
    empty = related_groups(spark.createDataFrame([], RECORDS), ["ligand", "author"])
    assert assign_splits(empty, "uniprot_id").collect() == []
    lone = related_groups(spark.createDataFrame([(1, None, None, "u")], RECORDS), ["ligand"])
    assert assign_splits(lone, "uniprot_id").collect() == [] and lone.first()["group"] is None
