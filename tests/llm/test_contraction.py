import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pocketloom.llm.contraction import contract, hash_order_hooks, linked_groups, random_mate_hooks


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def test_chains_stars_rings_loops_and_nulls(spark):
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(60)] + [("hub", f"s{i}") for i in range(50)] + [("r1", "r2"), ("r2", "r3"), ("r3", "r1")]
    pairs += [("me", "me"), (None, "x"), ("x", None), ("c3", "c4"), ("c4", "c3"), ("Z", "a"), ("é", "z")]
    got = linked_groups(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    assert {r["ligand"]: r["group_ligand"] for r in got} == brute(pairs) and len(got) == len(brute(pairs))


def test_no_links(spark):
    assert linked_groups(spark.createDataFrame([], "a string, b string"), "a", "b").collect() == []


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6))
def test_both_ways_of_hooking_find_the_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    edges = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    want = brute(edges)
    for hooks in (hash_order_hooks, random_mate_hooks):
        got = {r["x"]: r["root"] for r in contract(spark.createDataFrame(sorted(edges), "u long, v long"), hooks, seed).collect()}
        assert got.keys() == want.keys()
        assert len(set(zip(got.values(), (want[x] for x in got)))) == len(set(want.values())) == len(set(got.values()))
