"""From raw binding data to the affinity, split, protein and affinity-split tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pocketloom.functions.chemistry import default_canonical, ngram_bits
from pocketloom.functions.hashing import set_digest
from pocketloom.functions.ids import normal_ids
from pocketloom.functions.nulls import strict_double
from pocketloom.operators import greedy
from pocketloom.operators.balance import protein_stats
from pocketloom.operators.contracts import ContractError, assert_coverage, assert_split_valid, assert_unique, require_columns
from pocketloom.operators.lookups import index_from_dictionary, join_many_to_one, unmatched, with_protein_index
from pocketloom.operators.similarity import cached_edges, fingerprints, tanimoto_pairs
from pocketloom.runtime import materialize
from pocketloom.schemas import ACTIVE_SPLITS, AFFINITY_SPLIT, COVERAGE_FLOOR, FINGERPRINT_BITS, FRACTIONS, RAW_BINDING, RESTARTS, SEED, TANIMOTO_THRESHOLD


def annotated(binding: DataFrame, canonical: Callable[[Column], Column] | None = None) -> DataFrame:
    """binding with raw_smiles, canonical_smiles, ligand, and affinity: its pIC50 as a number; what is none fails."""
    canonical = canonical or default_canonical()
    form = canonical(F.col("smiles"))
    return binding.withColumns({"raw_smiles": F.col("smiles"), "canonical_smiles": form, "ligand": form, "affinity": strict_double(F.col("pIC50"), "pIC50")})


def affinity_table(binding: DataFrame, canonical: Callable[[Column], Column] | None = None) -> DataFrame:
    """(uniprot_id, ligand, affinity) in order of the first two, which must be unique together."""
    require_columns(binding, RAW_BINDING.fieldNames(), "the binding data")
    out = annotated(binding, canonical).select("uniprot_id", "ligand", "affinity")
    return assert_unique(out, ["uniprot_id", "ligand"], "the affinity table").orderBy("uniprot_id", "ligand")


def memberships(affinity: DataFrame, include: Iterable[str] | None = None) -> DataFrame:
    """Distinct (uniprot_id, ligand) without nulls, of the given proteins if any are. A protein without rows, or no
    rows at all, is an error."""
    wanted = normal_ids(include)
    pairs = affinity.select(F.col("uniprot_id").cast("string"), F.col("ligand").cast("string")).dropna().distinct()
    if wanted:
        pairs = pairs.where(F.col("uniprot_id").isin(*wanted))
    pairs = materialize(pairs, "members")
    if pairs.isEmpty():
        raise ContractError(f"no ligands are left for the proteins {wanted or 'of the table'}")
    if wanted:
        asked = affinity.sparkSession.createDataFrame([(w,) for w in wanted], "uniprot_id string")
        gone = [r[0] for r in unmatched(asked, pairs, ["uniprot_id"]).orderBy("uniprot_id").collect()]
        if gone:
            raise ContractError(f"proteins without affinity rows: {gone}")
    return pairs


def conflict_edges(
    ligands: DataFrame, bits: Callable[[Column], Column] = ngram_bits, threshold: float = TANIMOTO_THRESHOLD, size: int = FINGERPRINT_BITS, cache: str | None = None
) -> DataFrame:
    """Edges (src, dst) between ligands (one column, ligand) of Tanimoto similarity threshold or more, kept at cache."""
    key = {"threshold": threshold, "size": size, "bits": getattr(bits, "__name__", str(bits)), "digest": set_digest(ligands, "ligand")}
    prints = lambda: fingerprints(ligands.select("ligand", bits(F.col("ligand")).alias("bits")), "ligand", "bits", size)
    return cached_edges(ligands.sparkSession, cache, key, lambda: tanimoto_pairs(prints(), threshold).select("src", "dst"))


def split_table(
    affinity: DataFrame, include: Iterable[str] | None = None, proteins: DataFrame | None = None, bits: Callable[[Column], Column] = ngram_bits,
    threshold: float = TANIMOTO_THRESHOLD, size: int = FINGERPRINT_BITS, fractions: dict[str, float] = FRACTIONS, seed: int = SEED,
    restarts: int = RESTARTS, floor: int = COVERAGE_FLOOR, cache: str | None = None,
) -> tuple[DataFrame, DataFrame, str]:
    """The split of all ligands (ligand, ligand_idx, split), the protein index (uniprot_id, protein_idx) and the report.

    proteins is the global index that a run over a subset must reuse; without it proteins are numbered from 0.
    """
    members = memberships(affinity, include)
    ligands = materialize(members.select("ligand").distinct(), "ligands")
    edges = conflict_edges(ligands, bits, threshold, size, cache)
    graph = greedy.load_graph(members, edges)
    results = greedy.run_restarts(graph, fractions, seed, restarts)
    split = materialize(greedy.as_table(graph, greedy.winner(results), affinity), "split")
    assert_split_valid(split, ligands, edges)
    stats = protein_stats(members, split)
    assert_coverage(stats, floor)
    report = greedy.report(graph, results, edges.count(), stats.collect(), fractions)
    index = index_from_dictionary(members, "uniprot_id", proteins, "protein_idx")
    return split.orderBy("split", "ligand_idx", "ligand"), index, report


def affinity_split_table(affinity: DataFrame, split: DataFrame, proteins: DataFrame, include: Iterable[str] | None = None) -> DataFrame:
    """Affinities with the split and index of their ligand and the index of their protein, active splits only, ordered
    by split, protein_idx and ligand_idx. (uniprot_id, ligand) must be unique, and every protein indexed."""
    active = split.where(F.col("split").isin(*ACTIVE_SPLITS)).select("ligand", "ligand_idx", "split")
    wanted = normal_ids(include)
    rows = affinity.select("uniprot_id", "ligand", "affinity")
    if wanted:
        rows = rows.where(F.col("uniprot_id").cast("string").isin(*wanted))
    joined = with_protein_index(join_many_to_one(rows, active, ["ligand"], name="the split table"), proteins)
    out = joined.select(*AFFINITY_SPLIT.fieldNames())
    return assert_unique(out, ["uniprot_id", "ligand"], "the affinity-split table").orderBy("split", "protein_idx", "ligand_idx")
