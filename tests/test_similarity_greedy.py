import random

import numpy as np
import pytest

from conftest import rows
from pocketloom.operators import greedy
from pocketloom.operators.contracts import ContractError
from pocketloom.operators.similarity import cached_edges, degrees, fingerprints, tanimoto_pairs
from pocketloom.plans.manifests import affinity_split_table, affinity_table, annotated, memberships, split_table
from pocketloom.schemas import ALL_SPLITS


def prints(spark, data, size=248):
    return fingerprints(spark.createDataFrame(data, "k string, bits array<int>"), "k", "bits", size)


def brute(data, t):
    out = set()
    for i, (a, x) in enumerate(data):
        for b, y in data[i + 1 :]:
            if x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= t:
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("block", [3, 4000])
def test_pairs_match_brute_force(spark, block):
    rng = random.Random(1)
    data = [(f"k{i:03}", sorted(rng.sample(range(248), rng.randrange(1, 12)))) for i in range(150)]
    data += [("same1", data[0][1]), ("same2", data[0][1]), ("none1", []), ("none2", []), ("half", [0, 1]), ("quarter", [0, 1, 2, 3])]
    for t in (0.3, 0.5, 1.0):
        got = tanimoto_pairs(prints(spark, data), t, block).collect()
        assert len(got) == len({tuple(r)[:2] for r in got}) and {tuple(r)[:2] for r in got} == brute(data, t)
    assert tanimoto_pairs(prints(spark, [("a", None), ("b", [])])).collect() == []


def test_degrees(spark):
    v = spark.createDataFrame([("a",), ("b",), ("c",)], "ligand string")
    assert rows(degrees(v, spark.createDataFrame([("a", "b")], "src string, dst string"))) == [("a", 1), ("b", 1), ("c", 0)]


def test_cache_is_used_only_for_its_key(spark, tmp_path):
    calls = []

    def build(n):
        return lambda: (calls.append(n), spark.createDataFrame([(str(n), "z")], "src string, dst string"))[1]

    path = str(tmp_path / "cache")
    assert rows(cached_edges(spark, path, {"t": 1}, build(1))) == [("1", "z")] == rows(cached_edges(spark, path, {"t": 1}, build(2)))
    assert rows(cached_edges(spark, path, {"t": 2}, build(3))) == [("3", "z")] == rows(cached_edges(spark, path, {"t": 2}, build(4)))
    assert rows(cached_edges(spark, None, {"t": 2}, build(5))) == [("5", "z")] and calls == [1, 3, 5]


def test_targets_round_half_to_even():
    f = {"train": 0.9, "val": 0.05, "test": 0.05}
    assert greedy.target_counts(50, f) == {"test": 2, "val": 2, "train": 45} and greedy.target_counts(0, f) == {"test": 0, "val": 0, "train": 0}
    assert greedy.target_counts(10, {"train": 0.5, "val": 0.25, "test": 0.25}) == {"test": 2, "val": 2, "train": 5}
    assert greedy.fill_score(0.1, 0.4) == pytest.approx(0.3) and greedy.fill_score(0.5, 0.4) == pytest.approx(1.1)


def plain_greedy(ligands, near, proteins, targets, fractions, seed, barred):
    """Written by its rules alone, over sets."""
    rng = random.Random(seed)
    draw = {x: rng.random() for x in ligands}
    sizes = {p: sum(p in proteins[x] for x in ligands) for x in ligands for p in proteins[x]}
    inside = {s: set() for s in ALL_SPLITS}
    for x in sorted(ligands, key=lambda x: (len(near[x]), draw[x], x)):
        free = []
        for s in ("test", "val", "train"):
            rivals = set().union(*(inside[o] for o in ("train", "val", "test") if o != s))
            if not (s == "test" and x in barred) and len(inside[s]) < targets[s] and not near[x] & rivals:
                total = 0.0
                for p in sorted(proteins[x]):
                    share = sum(p in proteins[y] for y in inside[s]) / sizes[p]
                    total += fractions[s] - share if share < fractions[s] else share - fractions[s] + 1.0
                free.append((total, s))
        inside[min(free)[1] if free else "dropped"].add(x)
    return {x: s for s, own in inside.items() for x in own}


@pytest.mark.parametrize("seed", range(4))
def test_greedy_follows_its_rules(spark, seed):
    rng = random.Random(seed)
    ligands = [f"l{i:02}" for i in range(40)]
    edges = {(a, b) for a in ligands for b in ligands if a < b and rng.random() < 0.08}
    proteins = {x: set(rng.sample("pqrs", rng.randrange(1, 4))) for x in ligands}
    near = {x: {b if a == x else a for a, b in edges if x in (a, b)} for x in ligands}
    members = spark.createDataFrame([(p, x) for x in ligands for p in proteins[x]] + [(None, "l00"), ("p", None)], "uniprot_id string, ligand string")
    graph = greedy.load_graph(members, spark.createDataFrame(sorted(edges), "src string, dst string"))
    f = {"train": 0.6, "val": 0.2, "test": 0.2}
    results = greedy.run_restarts(graph, f, seed=seed, restarts=3)
    barred: set = set()
    for k, r in enumerate(results):
        want = plain_greedy(ligands, near, proteins, greedy.target_counts(40, f), f, seed + k, barred)
        assert dict(zip(graph.ligands, (ALL_SPLITS[i] for i in r.labels))) == want
        assert not barred & {x for x, s in want.items() if s == "test"}
        barred |= {x for x, s in want.items() if s == "test"}
    assert greedy.winner(results).score == max(r.score for r in results)


def test_greedy_limits(spark):
    with pytest.raises(ContractError):
        greedy.load_graph(spark.createDataFrame([], "uniprot_id string, ligand string"), spark.createDataFrame([], "src string, dst string"))
    graph = greedy.Graph(["a"], np.array([0, 0]), np.array([], np.int32), np.array([0, 1]), np.array([0]), np.array([1]), ["p"])
    with pytest.raises(ContractError):
        greedy.run_restarts(graph, restarts=0)


def test_from_binding_data_to_the_affinity_split_table(spark):
    rng = random.Random(8)
    ligands = ["".join(rng.choice("CNOPSF") for _ in range(rng.randrange(4, 14))) for _ in range(150)]
    binding = spark.createDataFrame([(rng.choice(["P1", "P2"]), f" {x} ", 1.0, f"{rng.random() * 9:.3f}") for x in sorted(set(ligands))], "uniprot_id string, smiles string, binding_affinity double, pIC50 string")
    affinity = affinity_table(binding)
    assert [c for c, _ in affinity.dtypes] == ["uniprot_id", "ligand", "affinity"]
    with pytest.raises(ContractError, match="repeats"):
        affinity_table(binding.union(binding))
    with pytest.raises(ContractError, match="lacks"):
        affinity_table(binding.drop("pIC50"))
    assert annotated(binding).columns[-4:] == ["raw_smiles", "canonical_smiles", "ligand", "affinity"]
    split, index, report = split_table(affinity, fractions={"train": 0.8, "val": 0.1, "test": 0.1}, floor=10**6)
    assert rows(index) == [("P1", 0), ("P2", 1)] and split.count() == len(set(ligands))
    assert report.startswith("split_manifest restart report\n\ntotal_ligands: ") and "(winner)" in report and report.count("\nP1 ") == 1 == report.count("\nP2 ")
    out = affinity_split_table(affinity, split, index, ["P1"])
    assert {r["protein_idx"] for r in out.collect()} == {0} and not {r["split"] for r in out.collect()} - {"train", "val", "test"}
    known = spark.createDataFrame([("P1", 7), ("P2", 3)], "uniprot_id string, protein_idx int")
    assert rows(split_table(affinity, ["P2"], known, floor=10**6)[1]) == [("P2", 3)]
    with pytest.raises(ContractError, match="P9"):
        memberships(affinity, ["P1", "P9"])
    with pytest.raises(ContractError, match="no ligands"):
        memberships(affinity, ["P9"])
