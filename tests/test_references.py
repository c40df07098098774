import pytest

from pocketloom.operators.references import Lifetime, find_orphans, orphan_report

REFS = "row_id int, a string, b string, t int"
TARGETS = "x string, y string, row_id int"


def ids(df):
    return sorted(r["row_id"] for r in df.collect())


@pytest.fixture
def tables(spark):
    refs = [(1, "p", "q", 5), (2, "p", "z", 5), (3, None, "q", 5), (4, None, "z", 5), (5, "p", None, 5), (6, None, None, 5), (1, "p", "q", 5), (2, "p", "z", 5)]
    return spark.createDataFrame(refs, REFS), spark.createDataFrame([("p", "q", 9), ("p", "q", 9), (None, "z", 9)], TARGETS)


@pytest.mark.parametrize("broadcast_rows", [0, 100])
@pytest.mark.parametrize("match,want", [("simple", [2, 2]), ("partial", [2, 2]), ("full", [2, 2, 3, 4, 5])])
def test_composite_keys_with_partial_nulls(tables, match, want, broadcast_rows):
    got = find_orphans(tables[0], ["a", "b"], tables[1], ["x", "y"], match, broadcast_rows=broadcast_rows)
    assert ids(got) == want and got.columns == tables[0].columns


def test_partial_match_looks_at_the_other_columns(spark):
    refs = spark.createDataFrame([(1, None, "q", 0), (2, None, "w", 0)], REFS)
    targets = spark.createDataFrame([("p", "q", 0)], TARGETS)
    assert ids(find_orphans(refs, ["a", "b"], targets, ["x", "y"], "partial")) == [2]


def test_lifetimes_are_half_open(spark):
    refs = spark.createDataFrame([(i, "k", None, t) for i, t in enumerate([0, 1, 4, 5, 6, 9, None])] + [(9, "gone", None, 3)], REFS)
    targets = spark.createDataFrame([("k", 1, 5), ("k", 6, None), ("gone", None, None)], "k string, since int, until int")
    assert ids(find_orphans(refs, ["a"], targets, ["k"], lifetime=Lifetime("t", "since", "until"))) == [0, 3, 6, 9]
    assert ids(find_orphans(refs, ["a"], targets, ["k"], lifetime=Lifetime("t", "since"))) == [0, 6, 9]


def test_empty_sides_and_bad_arguments(tables):
    refs, targets = tables
    assert ids(find_orphans(refs.limit(0), ["a"], targets, ["x"])) == []
    assert ids(find_orphans(refs, ["a"], targets.limit(0), ["x"])) == [1, 1, 2, 2, 5]
    for bad in ({"match": "most"}, {"target_keys": ["x", "y"]}):
        with pytest.raises(ValueError):
            find_orphans(**({"references": refs, "keys": ["a"], "targets": targets, "target_keys": ["x"]} | bad))


def test_report(spark):
    df = spark.sql("SELECT 't' AS src, timestamp'2024-03-05' AS at UNION ALL SELECT 't', timestamp'2024-03-31' UNION ALL SELECT 't', NULL")
    assert sorted(map(tuple, orphan_report(df, ["src"], "at").collect()), key=str) == [("t", "2024-03", 2), ("t", None, 1)]
