"""The greedy split: ligands of similar structure never in different active splits, balanced over proteins.

Every choice depends on all choices before it, so this runs on the driver, over arrays of the graph; MOST_EDGES bounds
what is brought there. Larger graphs need a split by connected components instead.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pocketloom.operators.contracts import ContractError, check_fractions
from pocketloom.schemas import ACTIVE_SPLITS, ALL_SPLITS, FRACTIONS, RESTARTS, SEED

MOST_EDGES = 50_000_000
MOST_MEMBERS = 20_000_000
#: The order in which splits are offered to a ligand.
OFFERED = ("test", "val", "train")


def target_counts(ligands: int, fractions: dict[str, float] = FRACTIONS) -> dict[str, int]:
    """Ligands wanted in each split: rounded half to even; test first, then val, then train, each from what is left."""
    check_fractions(fractions)
    out, left = {}, ligands
    for s in OFFERED:
        out[s] = min(left, round(ligands * fractions[s]))
        left -= out[s]
    return out


def fill_score(share: float, target: float) -> float:
    """How little a split is needed, lower is better: what is missing, or 1 and what is too much."""
    return target - share if share < target else share - target + 1.0


@dataclass(frozen=True)
class Graph:
    """Ligands in order, the neighbours of each (CSR), and the proteins of each (CSR), with the ligands of each protein."""

    ligands: list[str]
    starts: np.ndarray
    neighbours: np.ndarray
    member_starts: np.ndarray
    members: np.ndarray
    protein_sizes: np.ndarray
    proteins: list[str]


@dataclass(frozen=True)
class Restart:
    number: int
    seed: int
    labels: np.ndarray
    penalty: float

    def size(self, split: str) -> int:
        return int((self.labels == ALL_SPLITS.index(split)).sum())

    @property
    def kept(self) -> int:
        return len(self.labels) - self.size("dropped")

    @property
    def score(self) -> tuple[int, int, int, int, int, int]:
        return self.size("test"), self.size("val"), self.size("train"), self.kept, -round(self.penalty * 1_000_000), -self.number


def _csr(n: int, rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, rows))
    return np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int64), values[order]


def load_graph(members: DataFrame, edges: DataFrame) -> Graph:
    """From (uniprot_id, ligand) and edges (src, dst) of ligands, each edge once. Nulls and repeats don't count."""
    pairs = members.select(F.col("uniprot_id").cast("string").alias("uniprot_id"), F.col("ligand").cast("string").alias("ligand")).dropna().distinct()
    if pairs.count() > MOST_MEMBERS or edges.count() > MOST_EDGES:
        raise ContractError(f"the greedy split takes at most {MOST_EDGES} edges and {MOST_MEMBERS} memberships")
    known = pairs.toPandas()
    ligands, li = np.unique(known["ligand"].to_numpy(object), return_inverse=True)
    proteins, pi = np.unique(known["uniprot_id"].to_numpy(object), return_inverse=True)
    if not len(ligands):
        raise ContractError("there are no ligands to split")
    places = edges.sparkSession.createDataFrame([(x, i) for i, x in enumerate(ligands.tolist())], "ligand string, i int")
    numbered = edges.join(places.toDF("src", "i"), "src").join(places.toDF("dst", "j"), "dst").select("i", "j").toPandas()
    i, j = numbered["i"].to_numpy(np.int32), numbered["j"].to_numpy(np.int32)
    starts, neighbours = _csr(len(ligands), np.concatenate((i, j)), np.concatenate((j, i)))
    member_starts, own = _csr(len(ligands), li.astype(np.int32), pi.astype(np.int32))
    return Graph(ligands.tolist(), starts, neighbours, member_starts, own, np.bincount(pi, minlength=len(proteins)), proteins.tolist())


def assign(graph: Graph, targets: dict[str, int], fractions: dict[str, float], rng: random.Random, barred: np.ndarray) -> np.ndarray:
    """The split of each ligand, as its place in ALL_SPLITS.

    Ligands come by their number of neighbours, then by a random number drawn for each in order of name. A ligand may
    join a split that isn't full and in whose rivals it has no neighbour, test only if it isn't barred. Of these it
    takes the one whose fill scores, summed over its proteins in order of name, are lowest, the first by name on a tie;
    without any it is dropped. mask holds, bit by bit, in which active splits a ligand has neighbours.
    """
    n = len(graph.ligands)
    degree = np.diff(graph.starts)
    draws = np.fromiter((rng.random() for _ in range(n)), float, n)
    order = np.lexsort((np.arange(n), draws, degree))
    labels = np.full(n, ALL_SPLITS.index("dropped"), np.int8)
    mask = np.zeros(n, np.uint8)
    counts = {s: [0] * len(graph.proteins) for s in ACTIVE_SPLITS}
    filled = dict.fromkeys(ACTIVE_SPLITS, 0)
    place = {s: ACTIVE_SPLITS.index(s) for s in ACTIVE_SPLITS}
    sizes = graph.protein_sizes.tolist()
    for v in order.tolist():
        best: tuple[float, str] | None = None
        own = graph.members[graph.member_starts[v] : graph.member_starts[v + 1]].tolist()
        for s in OFFERED:
            if filled[s] >= targets[s] or (s == "test" and barred[v]) or int(mask[v]) & ~(1 << place[s]):
                continue
            score = 0.0
            for p in own:
                score += fill_score(counts[s][p] / sizes[p], fractions[s])
            if best is None or (score, s) < best:
                best = score, s
        if best is None:
            continue
        s = best[1]
        labels[v] = place[s]
        filled[s] += 1
        for p in own:
            counts[s][p] += 1
        mask[graph.neighbours[graph.starts[v] : graph.starts[v + 1]]] |= 1 << place[s]
    return labels


def penalty(graph: Graph, labels: np.ndarray, fractions: dict[str, float]) -> float:
    """Sum over proteins and active splits of how far a split's share of the protein's ligands is from its target."""
    owner = np.repeat(np.arange(len(graph.ligands)), np.diff(graph.member_starts))
    total = 0.0
    for s in ACTIVE_SPLITS:
        own = labels[owner] == ALL_SPLITS.index(s)
        got = np.bincount(graph.members[own], minlength=len(graph.proteins))
        total += float(np.abs(got / graph.protein_sizes - fractions[s]).sum())
    return total


def run_restarts(graph: Graph, fractions: dict[str, float] = FRACTIONS, seed: int = SEED, restarts: int = RESTARTS) -> list[Restart]:
    """One assignment for each restart; a ligand that was in test before may not be again."""
    if restarts <= 0:
        raise ContractError("there must be at least one restart")
    targets = target_counts(len(graph.ligands), fractions)
    barred = np.zeros(len(graph.ligands), bool)
    out = []
    for k in range(restarts):
        labels = assign(graph, targets, fractions, random.Random(seed + k), barred)
        barred |= labels == ALL_SPLITS.index("test")
        out.append(Restart(k, seed + k, labels, penalty(graph, labels, fractions)))
    return out


def winner(results: list[Restart]) -> Restart:
    return max(results, key=lambda r: r.score)


def as_table(graph: Graph, result: Restart, like: DataFrame) -> DataFrame:
    """(ligand, ligand_idx, split), ligands numbered in order of name."""
    rows = [(x, i, ALL_SPLITS[k]) for i, (x, k) in enumerate(zip(graph.ligands, result.labels.tolist()))]
    return like.sparkSession.createDataFrame(rows, "ligand string, ligand_idx int, split string")


def report(graph: Graph, results: list[Restart], edges: int, stats: list, fractions: dict[str, float] = FRACTIONS) -> str:
    """The text report of a split: totals, targets, the winner, each restart, and a table by protein.

    stats: rows of protein_stats, one for each protein.
    """
    best, targets = winner(results), target_counts(len(graph.ligands), fractions)
    # The labels and widths of the report.
    head = {
        "total_ligands": len(graph.ligands), "total_conflicts": edges, "targets": ", ".join(f"{s}={targets[s]}" for s in ACTIVE_SPLITS),
        "winning_restart": best.number, "winning_seed": best.seed, "winning_balance_penalty": f"{best.penalty:.6f}",
    }
    lines = ["split_manifest restart report", "", *(f"{k}: {v}" for k, v in head.items()), "", "restart_results:"]
    for r in results:
        counts = ", ".join(f"{s}={r.size(s)}" for s in ALL_SPLITS)
        mark = " (winner)" if r is best else ""
        lines.append(f"- restart={r.number}, seed={r.seed}, {counts}, kept={r.kept}, balance_penalty={r.penalty:.6f}{mark}")
    lines += ["", "per_protein_ligand_splits:", "Percentages are computed over total ligands per uniprot_id (including dropped ligands)."]
    columns = [("uniprot_id", -12), ("total", 6), ("train", 6), ("val", 6), ("test", 6), ("dropped", 8), ("train_pct", 10), ("val_pct", 9), ("test_pct", 10)]

    def cell(value: object, width: int) -> str:
        return f"{value:<{-width}}" if width < 0 else f"{value:>{width}}"

    lines.append(" ".join(cell(c, w) for c, w in columns))
    for row in sorted(stats, key=lambda r: r["uniprot_id"]):
        lines.append(" ".join(cell(f"{row[c]:.1f}%" if c.endswith("_pct") else row[c], w) for c, w in columns))
    return "\n".join(lines) + "\n"
