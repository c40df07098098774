import random

from pocketloom.llm.topn import best_poses, first_of_each, top_n_per_group

POSES = "row_id long, pose_id string, loaded_at int, uniprot_id string, ligand string, glide_score double, source_sdf string"


def brute(rows, n=3):
    seen = {}
    for r in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        seen.setdefault(("id", r[1]) if r[1] is not None else ("row", r[0]), r)
    groups = {}
    for r in seen.values():
        u, lig = (r[3] or "").strip().upper(), (r[4] or "").strip()
        if u and lig and r[5] is not None and r[5] == r[5]:
            groups.setdefault((u, lig), []).append(r)
    out = set()
    for g in groups.values():
        g.sort(key=lambda r: (r[5], (r[6] is None, r[6] or ""), (r[1] is None, r[1] or ""), r[0]))
        out |= {(r[0], i + 1) for i, r in enumerate(g[:n])}
    return out


def test_matches_brute_force_with_ties_nulls_and_redeliveries(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        hot = rng.random() < 0.5
        rows.append((
            i, rng.choice([None, f"p{rng.randrange(1500)}"]), rng.choice([None, rng.randrange(9)]), "A1" if hot else rng.choice([None, " a2", "\tA2 ", "", "A3"]),
            "CC" if hot else rng.choice([None, "CC", " CC", "CO", " "]), rng.choice([None, float("nan"), *[-rng.randrange(12) / 2 for _ in range(6)]]), rng.choice([None, "x", "y"]),
        ))
    got = best_poses(spark.createDataFrame(rows, POSES)).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_thresholds_keep_every_tie_in_a_hot_group(spark):
    df = spark.range(40_000).selectExpr("id", "'g' AS g", "cast(id % 50 AS double) AS s", "cast(NULL AS string) AS rank_no_")
    got = top_n_per_group(df, ["g"], "s", ["id"], 5)
    assert [(r["id"], r["rank_no"]) for r in got.orderBy("rank_no").collect()] == [(0, 1), (50, 2), (100, 3), (150, 4), (200, 5)]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], POSES)
    assert best_poses(empty).collect() == []
    odd = spark.createDataFrame([("g", 1.0, 7, 8)], "g string, s double, size int, upto int")
    assert top_n_per_group(odd, ["g"], "s", ["size"], 1).select("size", "upto", "rank_no").collect() == [(7, 8, 1)]


def test_rows_without_a_key_stand_for_themselves(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", 2), ("a", 1)], "k string, o int")
    assert sorted(map(tuple, first_of_each(df, "k", ["o"]).collect()), key=str) == [("a", 1), (None, 1), (None, 1)]


def test_every_large_group_has_a_threshold(spark):
    """25,000 groups of 40 rows and one of 200,000, with thresholds broadcast, in part, or not at all."""
    from pocketloom.llm.topn import without_hopeless

    rows = spark.range(1_200_000).selectExpr("CASE WHEN id < 1000000 THEN id % 25000 ELSE -1 END AS g", "abs(xxhash64(id) % 1000000) / 1.0 AS s", "id")
    want = {r["g"]: r["s"] for r in rows.groupBy("g").agg({"s": "min"}).withColumnRenamed("min(s)", "s").collect()}
    for most in (20_000, 50_000, 10):
        kept = without_hopeless(rows, ["g"], "s", 3, most)
        sizes = {r["g"]: r["count"] for r in kept.groupBy("g").count().collect()}
        assert len(sizes) == 25_001 and min(sizes.values()) >= 3 and sum(sizes.values()) < 0.25 * 1_200_000 and sizes[-1] < 200
        assert {r["g"]: r["s"] for r in kept.groupBy("g").agg({"s": "min"}).withColumnRenamed("min(s)", "s").collect()} == want


def test_groups_with_like_scores_high_above_the_others_lose_rows_too(spark):
    from pocketloom.llm.topn import without_hopeless

    rows = spark.range(100_000).selectExpr("id % 10 AS g", "(id % 10) * 1000 + abs(xxhash64(id) % 1000) / 1.0 AS s")
    assert without_hopeless(rows, ["g"], "s", 3).count() < 75_000
