"""The pipeline's operators over the driver's tables. Roles: pose_manifest holds the poses, affinity_split_manifest the
rated ligands, embeddings the fingerprints (signs) and the descriptor matrix (by vec_id)."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pocketloom.functions.chemistry import plain_canonical_or_null, sign_bits
from pocketloom.functions.hashing import membership_digest, pose_hash, text_hash
from pocketloom.functions.ids import grid_parts, pdb_key, pose_id, variant_ligand
from pocketloom.functions.nulls import lenient_double, no_nan, strict_double, whole_number
from pocketloom.functions.sequences import normal_sequence, truncated
from pocketloom.operators import greedy
from pocketloom.operators.balance import balance_penalty, protein_stats, worst_deviation
from pocketloom.operators.contracts import ContractError, assert_index_agrees, assert_sequences, assert_unique, coverage_gaps, duplicate_keys, index_mismatches, sequence_violations, split_violations, with_duplicate_flag
from pocketloom.operators.embeddings import mean_pooled, standard_moments, standardized, with_descriptors
from pocketloom.operators.lookups import dense_index, index_from_dictionary, matched, unmatched, with_batches, with_round_robin
from pocketloom.operators.metrics import fit_line, metrics_by, with_errors
from pocketloom.operators.ranking import first_wins, minimum_scores, with_pose_ranks
from pocketloom.operators.similarity import degrees, fingerprints, tanimoto_pairs
from pocketloom.plans.affinity_model import fitted, predict, summary, usable, valid_ligands
from pocketloom.plans.docking import commands, conversion_sources, docking_jobs
from pocketloom.plans.linear import examples, predictions
from pocketloom.plans.manifests import affinity_split_table, annotated
from pocketloom.plans.poses import merged
from pocketloom.runtime import accession, materialize, scratch_dir, table, trimmed
from pocketloom.queries.sql import trim
from pocketloom.schemas import ALL_SPLITS
from pocketloom.sources.tables import read_csv_checked, typed, write_csv

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


_NUM = "(CASE WHEN isnan({0}) THEN NULL ELSE {0} END)"
_LABELS = "(SELECT DISTINCT lower(label) AS label, split AS named FROM split_labels)"
#: Rated rows with their keys and splits put in normal form.
_RATED = f"""
    rated AS (
        SELECT row_id, upper({trim('uniprot_id')}) AS uniprot_id, protein_idx, {trim('ligand')} AS ligand, ligand_idx, named AS split,
            {_NUM.format('affinity')} AS affinity
        FROM affinity_split_manifest LEFT JOIN {_LABELS} ON lower({trim('split')}) = label)"""
_POSES = f"""
    poses AS (
        SELECT row_id, pose_id, source_sdf, pdb_key, upper({trim('uniprot_id')}) AS uniprot_id, {trim('ligand')} AS ligand, {_NUM.format('glide_score')} AS glide_score, recorded_at
        FROM pose_manifest)"""


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "affinity_split_manifest").select(
        "row_id", accession("uniprot_id").alias("uniprot_id"), "protein_idx", trimmed("ligand").alias("ligand"), "ligand_idx",
        F.lower(trimmed("split")).alias("label"), no_nan(F.col("affinity")).alias("affinity"),
    )
    labels = table(spark, sf, "split_labels").select(F.lower("label").alias("label"), "split").distinct()
    return rows.join(labels, "label", "left").drop("label")


def _poses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pose_manifest").withColumns({"uniprot_id": accession("uniprot_id"), "ligand": trimmed("ligand"), "glide_score": no_nan(F.col("glide_score"))})


_LOWEST = "lowest AS (SELECT uniprot_id, ligand, min(glide_score) AS min_glide_score FROM poses WHERE uniprot_id IS NOT NULL AND ligand IS NOT NULL AND glide_score IS NOT NULL GROUP BY 1, 2)"
_EXAMPLES = f"""{_RATED}, {_POSES}, {_LOWEST},
    examples AS (
        SELECT uniprot_id, ligand, split, affinity AS true_affinity, min_glide_score FROM rated JOIN lowest USING (uniprot_id, ligand)
        WHERE split IN ('train', 'val', 'test') AND affinity IS NOT NULL)"""
_LINE = "line AS (SELECT regr_slope(true_affinity, min_glide_score) AS slope, regr_intercept(true_affinity, min_glide_score) AS intercept, count(*) AS n, count(DISTINCT min_glide_score) AS n_x FROM examples WHERE split = 'train')"
_PREDICTED = f"{_EXAMPLES}, {_LINE}, predicted AS (SELECT e.*, slope * min_glide_score + intercept AS predicted_affinity FROM examples AS e, line)"


@query(f"WITH {_POSES}, {_LOWEST} SELECT * FROM lowest")
def min_score(spark, sf):
    return minimum_scores(_poses(spark, sf))


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    return examples(_poses(spark, sf), _rated(spark, sf))


@query(f"WITH {_EXAMPLES}, {_LINE} SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, n, n_x FROM line")
def linear_fit(spark, sf):
    line = fit_line(_examples(spark, sf).where("split = 'train'"), "min_glide_score", "true_affinity")
    return line.select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "n", "n_x")


@query(f"WITH {_PREDICTED} SELECT uniprot_id, ligand, split, min_glide_score, true_affinity, round(predicted_affinity, 6) AS predicted_affinity FROM predicted")
def linear_predictions(spark, sf):
    rows = predictions(materialize(_examples(spark, sf), "examples"))[0]
    return rows.select("uniprot_id", "ligand", "split", "min_glide_score", "true_affinity", F.round("predicted_affinity", 6).alias("predicted_affinity"))


@query(f"""WITH {_PREDICTED} SELECT split, count(*) AS num_examples, round(corr(predicted_affinity, true_affinity), 6) AS pearson_r,
    round(sqrt(avg((predicted_affinity - true_affinity) ** 2)), 6) AS rmse, round(avg(abs(predicted_affinity - true_affinity)), 6) AS mae
    FROM predicted GROUP BY split""")
def linear_metrics(spark, sf):
    rows = predictions(materialize(_examples(spark, sf), "examples"))[0]
    return metrics_by(rows, ["split"]).select("split", "num_examples", *(F.round(c, 6).alias(c) for c in ("pearson_r", "rmse", "mae")))


@query(f"""WITH {_PREDICTED} SELECT uniprot_id, ligand, split, round(abs(predicted_affinity - true_affinity), 6) AS abs_error,
    round((predicted_affinity - true_affinity) ** 2, 6) AS squared_error FROM predicted""")
def prediction_errors(spark, sf):
    rows = with_errors(predictions(materialize(_examples(spark, sf), "examples"))[0])
    return rows.select("uniprot_id", "ligand", "split", F.round("abs_error", 6).alias("abs_error"), F.round("squared_error", 6).alias("squared_error"))


@query(f"WITH {_PREDICTED} SELECT split, min(true_affinity) AS low, max(true_affinity) AS high, round(min(predicted_affinity), 6) AS predicted_low, round(max(predicted_affinity), 6) AS predicted_high FROM predicted GROUP BY split")
def plot_axes(spark, sf):
    rows = predictions(materialize(_examples(spark, sf), "examples"))[0]
    return rows.groupBy("split").agg(F.min("true_affinity").alias("low"), F.max("true_affinity").alias("high"), F.round(F.min("predicted_affinity"), 6).alias("predicted_low"), F.round(F.max("predicted_affinity"), 6).alias("predicted_high"))


@query(f"WITH {_EXAMPLES} SELECT r.row_id FROM rated AS r WHERE split IN ('train', 'val', 'test') AND affinity IS NOT NULL AND ligand IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lowest AS l WHERE l.uniprot_id = r.uniprot_id AND l.ligand = r.ligand)")
def unmatched_examples(spark, sf):
    rows = _rated(spark, sf).where(F.col("split").isin("train", "val", "test")).dropna(subset=["affinity", "ligand"])
    return unmatched(rows, minimum_scores(_poses(spark, sf)), ["uniprot_id", "ligand"]).select("row_id")


@query("""
    SELECT row_id, CAST(row_number() OVER (PARTITION BY pdb_key, ligand ORDER BY CASE WHEN isnan(glide_score) THEN NULL ELSE glide_score END NULLS LAST,
        source_sdf NULLS LAST, pose_id NULLS LAST, row_id) AS INTEGER) AS pose_rank,
        row_number() OVER (PARTITION BY pdb_key, ligand ORDER BY CASE WHEN isnan(glide_score) THEN NULL ELSE glide_score END NULLS LAST,
        source_sdf NULLS LAST, pose_id NULLS LAST, row_id) = 1 AS is_top_rank FROM pose_manifest""")
def pose_rank(spark, sf):
    poses = table(spark, sf, "pose_manifest").select("row_id", "pdb_key", "ligand", "glide_score", "source_sdf", "pose_id")
    return with_pose_ranks(poses, ties=("source_sdf", "pose_id", "row_id")).select("row_id", "pose_rank", "is_top_rank")


_NTH = "SELECT row_id, pose_id, row_number() OVER (PARTITION BY pose_id ORDER BY source_sdf NULLS LAST, row_id) AS n FROM pose_manifest"


@query(f"SELECT row_id, pose_id FROM ({_NTH}) WHERE n = 1")
def first_wins_dedup(spark, sf):
    return first_wins(table(spark, sf, "pose_manifest").select("row_id", "pose_id", "source_sdf"), "pose_id", ["source_sdf", "row_id"])[0].select("row_id", "pose_id")


@query(f"SELECT row_id, pose_id FROM ({_NTH}) WHERE n > 1")
def first_wins_rest(spark, sf):
    return first_wins(table(spark, sf, "pose_manifest").select("row_id", "pose_id", "source_sdf"), "pose_id", ["source_sdf", "row_id"])[1].select("row_id", "pose_id")


#: The manifest as it stood before this day is the old one, what was recorded after came in a later run.
_DAY = "2024-09-01"
_OLD = f"old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pose_id ORDER BY source_sdf NULLS LAST, row_id) AS n FROM pose_manifest WHERE recorded_at < '{_DAY}' AND pose_id IS NOT NULL) WHERE n = 1)"
_INCOMING = f"incoming AS (SELECT *, row_number() OVER (PARTITION BY pose_id ORDER BY source_sdf NULLS LAST, CAST(row_id AS INTEGER)) AS n FROM pose_manifest WHERE (recorded_at >= '{_DAY}' OR recorded_at IS NULL) AND pose_id IS NOT NULL)"
_WHOLE = f"""{_OLD}, {_INCOMING},
    whole AS (SELECT row_id, pose_id, pdb_key, ligand, glide_score, source_sdf FROM old UNION ALL
        SELECT row_id, pose_id, pdb_key, ligand, glide_score, source_sdf FROM incoming WHERE n = 1 AND pose_id NOT IN (SELECT pose_id FROM old)),
    ranked AS (SELECT pose_id, CAST(row_number() OVER (PARTITION BY pdb_key, ligand ORDER BY CASE WHEN isnan(glide_score) THEN NULL ELSE glide_score END NULLS LAST,
        source_sdf NULLS LAST, pose_id) AS INTEGER) AS pose_rank FROM whole)"""


#: Graphs are stored of what was recorded before this day.
_STORED = "2024-06-01"


def _merged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    poses = table(spark, sf, "pose_manifest").where("pose_id IS NOT NULL").withColumn("mol_index", F.col("row_id").cast("int"))
    old = materialize(first_wins(poses.where(F.col("recorded_at") < _DAY), "pose_id", ["source_sdf", "mol_index"])[0], "old")
    new = poses.where((F.col("recorded_at") >= _DAY) | F.col("recorded_at").isNull())
    return merged(old, new, old.where(F.col("recorded_at") < _STORED))


@query(f"WITH {_WHOLE} SELECT * FROM ranked")
def incremental_ingest(spark, sf):
    return _merged(spark, sf)[0].select("pose_id", "pose_rank")


@query(f"""WITH {_WHOLE} SELECT i.pose_id, i.source_sdf, r.pose_rank, CAST(true AS BOOLEAN) AS exists_in_manifest,
        i.pose_id NOT IN (SELECT pose_id FROM old WHERE recorded_at >= '{_STORED}') AS exists_in_lmdb
    FROM incoming AS i JOIN ranked AS r USING (pose_id) WHERE i.n > 1 OR i.pose_id IN (SELECT pose_id FROM old)""")
def duplicate_log(spark, sf):
    return _merged(spark, sf)[1].select("pose_id", "source_sdf", "pose_rank", "exists_in_manifest", "exists_in_lmdb")


@query("SELECT uniprot_id, ligand, count(*) AS count FROM affinity_manifest GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return duplicate_keys(table(spark, sf, "affinity_manifest"), ["uniprot_id", "ligand"])


@query("SELECT row_id, count(*) OVER (PARTITION BY uniprot_id, ligand) > 1 AS is_duplicate FROM affinity_manifest")
def repeated_rows(spark, sf):
    return with_duplicate_flag(table(spark, sf, "affinity_manifest"), ["uniprot_id", "ligand"]).select("row_id", "is_duplicate")


@query(f"SELECT row_id, ligand AS raw_smiles, {trim('ligand')} AS ligand, {_NUM.format('affinity')} AS affinity FROM affinity_manifest")
def annotated_ligands(spark, sf):
    rows = table(spark, sf, "affinity_manifest").select("row_id", F.col("ligand").alias("smiles"), F.col("affinity").alias("pIC50"))
    return annotated(rows, trimmed).select("row_id", "raw_smiles", "ligand", "affinity")


@query(f"SELECT ligand, CAST(row_number() OVER (ORDER BY ligand) - 1 AS INTEGER) AS ligand_idx FROM (SELECT DISTINCT {trim('ligand')} AS ligand FROM affinity_manifest) WHERE ligand IS NOT NULL")
def ligand_index(spark, sf):
    return dense_index(table(spark, sf, "affinity_manifest").select(trimmed("ligand").alias("ligand")), "ligand", "ligand_idx")


_PROTEINS = f"proteins AS (SELECT DISTINCT upper({trim('uniprot_id')}) AS uniprot_id, protein_idx FROM protein_manifest WHERE {trim('uniprot_id')} IS NOT NULL)"


def _proteins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "protein_manifest").select(accession("uniprot_id").alias("uniprot_id"), "protein_idx").dropna(subset=["uniprot_id"]).distinct()


@query(f"WITH {_PROTEINS}, {_RATED} SELECT DISTINCT p.uniprot_id, p.protein_idx FROM proteins AS p JOIN rated AS r USING (uniprot_id)")
def protein_index(spark, sf):
    proteins = _proteins(spark, sf)
    known = matched(_rated(spark, sf), proteins, ["uniprot_id"])
    return index_from_dictionary(known, "uniprot_id", proteins, "protein_idx")


_PAIRS = """pairs AS (SELECT uniprot_id, ligand, round(avg(affinity), 6) AS affinity FROM (
        SELECT upper({u}) AS uniprot_id, {l} AS ligand, {a} AS affinity FROM affinity_manifest) WHERE uniprot_id IS NOT NULL AND ligand IS NOT NULL GROUP BY 1, 2)""".format(u=trim("uniprot_id"), l=trim("ligand"), a=_NUM.format("affinity"))
_SPLITS = "splits AS (SELECT ligand, min(split) AS split, CAST(min(ligand_idx) AS INTEGER) AS ligand_idx FROM rated WHERE ligand IS NOT NULL GROUP BY ligand)"


def _splits(spark: SparkSession, sf: str) -> DataFrame:
    return _rated(spark, sf).where("ligand IS NOT NULL").groupBy("ligand").agg(F.min("split").alias("split"), F.min("ligand_idx").alias("ligand_idx"))


@query(f"WITH {_RATED}, {_PAIRS}, {_SPLITS}, {_PROTEINS} SELECT uniprot_id, protein_idx, ligand, ligand_idx, affinity, split FROM pairs JOIN splits USING (ligand) JOIN proteins USING (uniprot_id) WHERE split IN ('train', 'val', 'test')")
def affinity_split_join(spark, sf):
    rows = table(spark, sf, "affinity_manifest").select(accession("uniprot_id").alias("uniprot_id"), trimmed("ligand").alias("ligand"), no_nan(F.col("affinity")).alias("affinity"))
    pairs = rows.dropna(subset=["uniprot_id", "ligand"]).groupBy("uniprot_id", "ligand").agg(F.round(F.avg("affinity"), 6).alias("affinity"))
    proteins = _proteins(spark, sf)
    return affinity_split_table(matched(pairs, proteins, ["uniprot_id"]), _splits(spark, sf), proteins)


_STATS = f"""{_RATED}, {_SPLITS}, stats AS (
    SELECT uniprot_id, count(*) AS total, {', '.join(f"count(*) FILTER (s.split = '{s}') AS {s}" for s in ALL_SPLITS)}
    FROM (SELECT DISTINCT uniprot_id, ligand FROM rated WHERE uniprot_id IS NOT NULL AND ligand IS NOT NULL) AS m LEFT JOIN splits AS s USING (ligand) GROUP BY 1)"""


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return protein_stats(_rated(spark, sf), _splits(spark, sf))


@query(f"WITH {_STATS} SELECT *, round(100.0 * train / total, 6) AS train_pct, round(100.0 * val / total, 6) AS val_pct, round(100.0 * test / total, 6) AS test_pct FROM stats")
def per_protein_stats(spark, sf):
    s = _stats(spark, sf)
    return s.select("uniprot_id", "total", *ALL_SPLITS, *(F.round(f"{x}_pct", 6).alias(f"{x}_pct") for x in ("train", "val", "test")))


_DEVIATIONS = f"""{_STATS}, deviations AS (
    SELECT uniprot_id, 0 AS place, 'train' AS split, abs(train / total - 0.97::DOUBLE) AS d FROM stats UNION ALL
    SELECT uniprot_id, 1, 'val', abs(val / total - 0.015::DOUBLE) FROM stats UNION ALL SELECT uniprot_id, 2, 'test', abs(test / total - 0.015::DOUBLE) FROM stats)"""


@query(f"WITH {_DEVIATIONS} SELECT round(sum(d), 6) AS balance_penalty FROM deviations")
def split_penalty(spark, sf):
    return balance_penalty(_stats(spark, sf)).select(F.round("balance_penalty", 6).alias("balance_penalty"))


@query(f"WITH {_DEVIATIONS} SELECT uniprot_id, split, round(d, 6) AS deviation FROM deviations ORDER BY d DESC, uniprot_id, place LIMIT 1")
def split_worst(spark, sf):
    return worst_deviation(_stats(spark, sf)).select("uniprot_id", "split", F.round("deviation", 6).alias("deviation"))


@query(f"WITH {_STATS} SELECT uniprot_id, total - dropped AS kept, val, test, total - dropped >= 100 AS required FROM stats WHERE val = 0 OR test = 0")
def split_coverage_gaps(spark, sf):
    return coverage_gaps(_stats(spark, sf))


_BITS = """bits AS (SELECT vec_id AS id, i FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, embedding FROM embeddings) WHERE embedding[i] > 0),
    n AS (SELECT id, count(*) AS n FROM bits GROUP BY id),
    edges AS (SELECT x.id AS src, y.id AS dst, count(*) / (any_value(p.n) + any_value(q.n) - count(*)) AS tanimoto
        FROM bits AS x JOIN bits AS y ON x.i = y.i AND x.id < y.id JOIN n AS p ON p.id = x.id JOIN n AS q ON q.id = y.id GROUP BY 1, 2
        HAVING count(*) / (any_value(p.n) + any_value(q.n) - count(*)) >= {0})"""


def _edges(spark: SparkSession, sf: str, threshold: float) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", sign_bits(F.col("embedding")).alias("bits"))
    return tanimoto_pairs(fingerprints(vectors, "vec_id", "bits", 64), threshold)


@query(f"WITH {_BITS.format('0.3::DOUBLE')} SELECT src, dst, round(tanimoto, 6) AS tanimoto FROM edges")
def tanimoto_030(spark, sf):
    return _edges(spark, sf, 0.3).withColumn("tanimoto", F.round("tanimoto", 6))


@query(f"WITH {_BITS.format('0.5::DOUBLE')} SELECT src, dst, round(tanimoto, 6) AS tanimoto FROM edges")
def tanimoto_050(spark, sf):
    return _edges(spark, sf, 0.5).withColumn("tanimoto", F.round("tanimoto", 6))


@query(f"WITH {_BITS.format('0.5::DOUBLE')} SELECT vec_id, (SELECT count(*) FROM edges WHERE src = vec_id OR dst = vec_id) AS degree FROM embeddings")
def conflict_degree(spark, sf):
    return degrees(table(spark, sf, "embeddings"), _edges(spark, sf, 0.5), "vec_id")


def _greedy(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors as ligands, their labels as proteins, conflicts between vectors of like signs."""
    name = F.lpad(F.col("vec_id").cast("string"), 6, "0")
    vectors = table(spark, sf, "embeddings").select(name.alias("ligand"), F.concat(F.lit("L"), "label").alias("uniprot_id"), sign_bits(F.col("embedding")).alias("bits"))
    edges = materialize(tanimoto_pairs(fingerprints(vectors, "ligand", "bits", 64), 0.5).select("src", "dst"), "edges")
    graph = greedy.load_graph(vectors, edges)
    best = greedy.winner(greedy.run_restarts(graph))
    return greedy.as_table(graph, best, vectors), vectors.select("ligand").distinct(), edges


@query()
def greedy_split(spark, sf):
    return _greedy(spark, sf)[0]


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS illegal, CAST(0 AS BIGINT) AS crossing")
def greedy_violations(spark, sf):
    return split_violations(*_greedy(spark, sf))


@query("SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // 100 AS batch_id FROM affinity_manifest")
def ligand_batches(spark, sf):
    return with_batches(table(spark, sf, "affinity_manifest").select("row_id"), ["row_id"], 100)


@query("SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) % 24 AS job_id FROM affinity_manifest")
def round_robin(spark, sf):
    return with_round_robin(table(spark, sf, "affinity_manifest").select("row_id"), ["row_id"], 24)


@query("SELECT p_partkey, substring(regexp_replace(upper(trim(p_name)), '[^ACDEFGHIKLMNPQRSTVWYX]', 'X', 'g'), 1, 12) AS sequence FROM part")
def sequence_normalise(spark, sf):
    return table(spark, sf, "part").select("p_partkey", truncated(normal_sequence(F.col("p_name")), 12).alias("sequence"))


_GRIDS = f"{trim('grid')} LIKE '_%\\_%_' ESCAPE '\\' AND strpos({trim('grid')}, '_') > 1"


@query(f"""SELECT row_id, split_part({trim('grid')}, '_', 1) AS pdb_id, substring({trim('grid')}, strpos({trim('grid')}, '_') + 1) AS uniprot_id, {trim('grid')} AS pdb_key
    FROM pose_manifest WHERE {_GRIDS}""")
def grid_parse(spark, sf):
    rows = table(spark, sf, "pose_manifest").select("row_id", trimmed("grid").alias("grid")).where(F.col("grid").rlike("^[^_]+_.*[^_\\s].*$"))
    parts = rows.withColumn("g", grid_parts(F.col("grid")))
    return parts.select("row_id", "g.pdb_id", "g.uniprot_id", pdb_key(F.col("g.pdb_id"), F.col("g.uniprot_id")).alias("pdb_key"))


@query(f"SELECT row_id, {trim('ligand')} AS ligand FROM affinity_manifest WHERE {trim('ligand')} IS NOT NULL")
def variant_parse(spark, sf):
    rows = table(spark, sf, "affinity_manifest").select("row_id", trimmed("ligand").alias("l")).dropna()
    return rows.select("row_id", variant_ligand(F.concat("l", F.lit("-"), F.col("row_id").cast("string"))).alias("ligand"))


@query("SELECT row_id, substring(sha256(ligand), 1, 16) AS content_hash, pdb_key || '_' || ligand || '_' || substring(sha256(ligand), 1, 16) AS pose_id FROM pose_manifest WHERE pdb_key IS NOT NULL AND ligand IS NOT NULL")
def content_hash(spark, sf):
    rows = table(spark, sf, "pose_manifest").select("row_id", "pdb_key", "ligand").dropna().withColumn("content_hash", text_hash(F.col("ligand")))
    return rows.select("row_id", "content_hash", pose_id(F.col("pdb_key"), F.col("ligand"), F.col("content_hash")).alias("pose_id"))


@query("SELECT vec_id % 16 AS key, round(avg(embedding[1]), 6) AS first, round(avg(embedding[64]), 6) AS last FROM embeddings GROUP BY 1")
def mean_pool(spark, sf):
    tokens = table(spark, sf, "embeddings").select((F.col("vec_id") % 16).alias("key"), "embedding")
    return mean_pooled(tokens, "key", "embedding").select("key", F.round(F.col("pooled")[0], 6).alias("first"), F.round(F.col("pooled")[63], 6).alias("last"))


@query("""WITH m AS (SELECT avg(embedding[1]) AS a, stddev_pop(embedding[1]) AS s, avg(embedding[64]) AS b, stddev_pop(embedding[64]) AS t FROM embeddings WHERE label < 8)
    SELECT vec_id, round((embedding[1] - a) / s, 6) AS first, round((embedding[64] - b) / t, 6) AS last FROM embeddings, m""")
def standardise(spark, sf):
    vectors = table(spark, sf, "embeddings")
    out = standardized(vectors, "embedding", *standard_moments(vectors.where("label < 8"), "embedding"), "z")
    return out.select("vec_id", F.round(F.col("z")[0], 6).alias("first"), F.round(F.col("z")[63], 6).alias("last"))


_USABLE = f"""{_RATED}, usable AS (SELECT row_id, uniprot_id, protein_idx, ligand, ligand_idx, split, affinity AS true_affinity FROM rated
    WHERE split IN ('train', 'val', 'test') AND affinity IS NOT NULL AND ligand IS NOT NULL AND protein_idx >= 0)"""


@query(f"WITH {_USABLE} SELECT uniprot_id, protein_idx, ligand, ligand_idx, split, true_affinity FROM usable")
def usable_examples(spark, sf):
    return valid_ligands(usable(_rated(spark, sf)), plain_canonical_or_null)


def _described(spark: SparkSession, sf: str) -> DataFrame:
    matrix = table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("protein_idx"), F.col("embedding").alias("descriptor"))
    rows = usable(_rated(spark, sf))
    return with_descriptors(matched(rows, matrix, ["protein_idx"]), matrix)


@query(f"WITH {_USABLE} SELECT uniprot_id, protein_idx, ligand, round(CAST(embedding[1] AS DOUBLE), 6) AS first, len(embedding) AS dim FROM usable JOIN embeddings ON vec_id = protein_idx")
def descriptor_gather(spark, sf):
    d = F.col("descriptor")
    return _described(spark, sf).select("uniprot_id", "protein_idx", "ligand", F.round(d[0].cast("double"), 6).alias("first"), F.size(d).cast("bigint").alias("dim"))


@query(f"""WITH {_USABLE} SELECT count(*) AS rows_after_filtering, count(*) FILTER (split = 'train') AS num_train, count(*) FILTER (split = 'val') AS num_val,
    count(*) FILTER (split = 'test') AS num_test, count(DISTINCT uniprot_id) AS unique_proteins, count(DISTINCT ligand) AS unique_ligands,
    CAST(max(len(embedding)) AS INTEGER) AS x_d_dim FROM usable JOIN embeddings ON vec_id = protein_idx""")
def dry_run_summary(spark, sf):
    return summary(_described(spark, sf))


@query()
def model_predictions(spark, sf):
    """Of the regressor fitted on the train rows, for all active splits."""
    rows = materialize(_described(spark, sf), "rows")
    model, moments = fitted(rows.where("split = 'train'"))
    return predict(model, rows, moments)


@query(f"WITH {_USABLE}, {_PROTEINS} SELECT DISTINCT u.uniprot_id, u.protein_idx, p.protein_idx AS expected FROM usable AS u LEFT JOIN proteins AS p USING (uniprot_id) WHERE p.protein_idx IS NULL OR p.protein_idx <> u.protein_idx")
def index_disagreements(spark, sf):
    return index_mismatches(usable(_rated(spark, sf)), _proteins(spark, sf))


@query("""SELECT count(*) FILTER (protein_idx IS NULL OR ligand IS NULL) AS null_fields, CAST(0 AS BIGINT) AS not_integral, count(protein_idx) - count(DISTINCT protein_idx) AS repeated,
    count(*) FILTER (protein_idx < 0) + CASE WHEN max(protein_idx) >= count(*) THEN 1 ELSE 0 END AS outside, count(*) FILTER (trim(ligand) = '') AS blank FROM affinity_split_manifest""")
def sequence_rule_breaches(spark, sf):
    return sequence_violations(table(spark, sf, "affinity_split_manifest").select(F.col("protein_idx").cast("double").alias("protein_idx"), F.col("ligand").alias("sequence")))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS lenient, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS strict, CAST(json_extract_string(props, '$.k') AS INTEGER) AS whole FROM events")
def numeric_casts(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", lenient_double(k).alias("lenient"), strict_double(k, "k").alias("strict"), whole_number(k).alias("whole"))


@query(f"WITH {_RATED} SELECT split, count(*) AS rows, count(DISTINCT uniprot_id) AS proteins, count(DISTINCT ligand) AS ligands FROM rated WHERE split IN ('train', 'val', 'test') GROUP BY split")
def split_counts(spark, sf):
    rows = _rated(spark, sf).where(F.col("split").isin("train", "val", "test"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("uniprot_id").alias("proteins"), F.count_distinct("ligand").alias("ligands"))


_LIGANDS = f"SELECT DISTINCT {trim('ligand')} AS ligand FROM {{0}} WHERE {trim('ligand')} IS NOT NULL"


def _ligands(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name).select(trimmed("ligand").alias("ligand")).dropna().distinct()


@query(f"{_LIGANDS.format('pose_manifest')} EXCEPT {_LIGANDS.format('affinity_manifest')}")
def ligand_difference(spark, sf):
    return unmatched(_ligands(spark, sf, "pose_manifest"), _ligands(spark, sf, "affinity_manifest"), ["ligand"])


@query(f"{_LIGANDS.format('pose_manifest')} INTERSECT {_LIGANDS.format('affinity_manifest')}")
def ligand_intersection(spark, sf):
    return matched(_ligands(spark, sf, "pose_manifest"), _ligands(spark, sf, "affinity_manifest"), ["ligand"])


@query(f"WITH {_RATED} SELECT ligand, count(DISTINCT uniprot_id) AS proteins FROM rated WHERE ligand IS NOT NULL AND uniprot_id IS NOT NULL GROUP BY ligand")
def ligand_memberships(spark, sf):
    pairs = _rated(spark, sf).select("ligand", "uniprot_id").dropna().distinct()
    return pairs.groupBy("ligand").agg(F.count("uniprot_id").alias("proteins"))


_BASE = "regexp_replace(source_sdf, '_docked\\.sdf$', '')"


@query(f"""SELECT base, CASE WHEN bool_or(e) THEN base || '_pv.maegz' ELSE base || '_raw.maegz' END AS source, base || '.sdf' AS output
    FROM (SELECT {_BASE} AS base, row_id % 7 = 0 AS e FROM pose_manifest WHERE source_sdf IS NOT NULL) GROUP BY base""")
def docked_sources(spark, sf):
    base = F.regexp_replace("source_sdf", r"_docked\.sdf$", "")
    names = table(spark, sf, "pose_manifest").where("source_sdf IS NOT NULL").select(F.concat(base, F.when(F.col("row_id") % 7 == 0, "_pv.maegz").otherwise("_raw.maegz")).alias("file"))
    return conversion_sources(names)


@query("SELECT DISTINCT 'glide_dock ' || '/grids/9KY5.zip ' || source_sdf || ' 30' AS command_line FROM pose_manifest WHERE source_sdf IS NOT NULL")
def job_commands(spark, sf):
    batches = table(spark, sf, "pose_manifest").select(F.col("source_sdf").alias("output_mae")).dropna().distinct()
    return commands(docking_jobs(batches, "/grids/9KY5.zip", "combindvs")).select("command_line")


@query("SELECT match_id, ligand_a, ligand_b, round(score, 6) AS score FROM ligand_match")
def csv_round_trip(spark, sf):
    """Through CSV and back, ends with surrounding white space and backslashes included."""
    rows = table(spark, sf, "ligand_match").select("match_id", "ligand_a", "ligand_b", "score")
    path = write_csv(rows, f"{scratch_dir(spark)}/pocketloom/csv-{uuid.uuid4().hex}")
    back = typed(read_csv_checked(spark, path, rows.columns), rows.schema)
    return back.withColumn("score", F.round("score", 6))


_DIRTY = """SELECT row_id, CASE row_id % 6 WHEN 0 THEN CAST(row_id / 4 AS VARCHAR) WHEN 1 THEN 'n/a' WHEN 2 THEN ' 7.50 ' WHEN 3 THEN '1.5x' WHEN 4 THEN NULL ELSE '-3' END AS t,
    CASE row_id % 6 WHEN 0 THEN row_id / 4 WHEN 2 THEN 7.5 WHEN 5 THEN -3 END AS n FROM affinity_manifest"""


@query(f"SELECT row_id, CAST(n AS DOUBLE) AS lenient, CASE WHEN n = floor(n) THEN CAST(n AS INTEGER) END AS whole FROM ({_DIRTY})")
def dirty_numbers(spark, sf):
    """Text of which some is no number: lenient and whole readings of it."""
    k = F.col("row_id") % 6
    text = F.when(k == 0, (F.col("row_id") / 4).cast("string")).when(k == 1, "n/a").when(k == 2, " 7.50 ").when(k == 3, "1.5x").when(k == 5, "-3")
    rows = table(spark, sf, "affinity_manifest").select("row_id", text.alias("t"))
    return rows.select("row_id", lenient_double(F.col("t")).alias("lenient"), whole_number(F.col("t")).alias("whole"))


def _outcome(action) -> str:
    """passes, or fails where a contract or a row of it does."""
    try:
        out = action()
        if isinstance(out, DataFrame):
            out.write.format("noop").mode("overwrite").save()
    except (ContractError, PySparkException) as e:
        if isinstance(e, ContractError) or "USER_RAISED_EXCEPTION" in str(e):
            return "fails"
        raise
    return "passes"


def _fails_if(name: str, condition: str) -> str:
    return f"SELECT '{name}' AS contract, CASE WHEN {condition} THEN 'fails' ELSE 'passes' END AS outcome"


_ANY = "EXISTS (SELECT 1 FROM {0})".format
_CONTRACTS = " UNION ALL ".join((
    _fails_if("protein_index", _ANY("rated ANTI JOIN proteins USING (uniprot_id) WHERE uniprot_id IS NOT NULL")),
    _fails_if("affinity_split_join", _ANY("(SELECT * FROM pairs JOIN splits USING (ligand) WHERE split IN ('train', 'val', 'test')) ANTI JOIN proteins USING (uniprot_id)")),
    _fails_if("descriptor_range", "(SELECT max(protein_idx) FROM usable) >= (SELECT count(*) FROM embeddings)"),
    _fails_if("index_agrees", _ANY("usable AS u LEFT JOIN proteins AS p USING (uniprot_id) WHERE p.protein_idx IS NULL OR p.protein_idx <> u.protein_idx")),
    _fails_if("unique_affinities", _ANY("(SELECT 1 FROM affinity_manifest GROUP BY uniprot_id, ligand HAVING count(*) > 1)")),
    _fails_if("unique_pairs", _ANY("(SELECT 1 FROM pairs GROUP BY uniprot_id, ligand HAVING count(*) > 1)")),
    _fails_if("grids", _ANY(f"pose_manifest WHERE grid IS NULL OR NOT ({_GRIDS})")),
    _fails_if("good_grids", _ANY(f"(SELECT * FROM pose_manifest WHERE {_GRIDS}) WHERE NOT ({_GRIDS})")),
    _fails_if("variants", _ANY("pose_manifest WHERE ligand IS NULL OR NOT regexp_full_match(ligand, '.+-[0-9]+')")),
    _fails_if("strict_numbers", _ANY(f"({_DIRTY}) WHERE t IS NOT NULL AND n IS NULL")),
    _fails_if("sequences", "true"),
))


@query(f"WITH {_USABLE}, {_PAIRS}, {_SPLITS}, {_PROTEINS} {_CONTRACTS}")
def contract_outcomes(spark, sf):
    """Which contracts the tables as they stand keep and which they break, nothing filtered out before."""
    rated, proteins = _rated(spark, sf), _proteins(spark, sf)
    raw = table(spark, sf, "affinity_manifest")
    rows = raw.select(accession("uniprot_id").alias("uniprot_id"), trimmed("ligand").alias("ligand"), no_nan(F.col("affinity")).alias("affinity"))
    pairs = rows.dropna(subset=["uniprot_id", "ligand"]).groupBy("uniprot_id", "ligand").agg(F.round(F.avg("affinity"), 6).alias("affinity"))
    matrix = table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("protein_idx"), F.col("embedding").alias("descriptor"))
    examples_ = usable(rated)
    grids = table(spark, sf, "pose_manifest").select(trimmed("grid").alias("grid"), "ligand")
    k = F.col("row_id") % 6
    dirty = F.when(k == 0, (F.col("row_id") / 4).cast("string")).when(k == 1, "n/a").when(k == 2, " 7.50 ").when(k == 3, "1.5x").when(k == 5, "-3")
    tried = {
        "protein_index": lambda: index_from_dictionary(rated, "uniprot_id", proteins, "protein_idx"),
        "affinity_split_join": lambda: affinity_split_table(pairs, _splits(spark, sf), proteins),
        "descriptor_range": lambda: with_descriptors(examples_, matrix),
        "index_agrees": lambda: assert_index_agrees(examples_, proteins),
        "unique_affinities": lambda: assert_unique(raw, ["uniprot_id", "ligand"], "affinities"),
        "unique_pairs": lambda: assert_unique(pairs, ["uniprot_id", "ligand"], "pairs"),
        "grids": lambda: grids.select(grid_parts(F.col("grid"))),
        "good_grids": lambda: grids.where(F.col("grid").rlike("^[^_]+_.*[^_\\s].*$")).select(grid_parts(F.col("grid"))),
        "variants": lambda: grids.select(variant_ligand(F.col("ligand"))),
        "strict_numbers": lambda: raw.select(strict_double(dirty, "t")),
        "sequences": lambda: assert_sequences(table(spark, sf, "affinity_split_manifest").select(F.col("protein_idx").cast("double").alias("protein_idx"), F.col("ligand").alias("sequence"))),
    }
    return spark.createDataFrame([(name, _outcome(f)) for name, f in tried.items()], "contract string, outcome string")


_CELLS = "list_aggregate(list_transform(range(1, 22), lambda i: '[' || list_aggregate(list_transform(range(3 * i - 2, 3 * i + 1), lambda k: '\"' || replace(printf('%.3f', CAST(embedding[k] AS DOUBLE)), '-0.000', '0.000') || '\"'), 'string_agg', ',') || ']'), 'string_agg', ',')"


@query(f"""SELECT vec_id, substring(sha256('{{"pos":[' || {_CELLS} || '],"x":[[' || label || ']]}}'), 1, 16) AS pose_hash FROM embeddings""")
def graph_hashes(spark, sf):
    """Content hashes of graphs: components three by three as positions, the label as the feature of a node."""
    e = F.col("embedding")
    pos = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.transform(F.slice(e, i * 3 + 1, 3), lambda v: v.cast("double")))
    rows = table(spark, sf, "embeddings").select("vec_id", F.array(F.array(F.col("label").cast("int"))).alias("x"), pos.alias("pos"))
    return rows.select("vec_id", pose_hash("x", "pos").alias("pose_hash"))


@query("SELECT key, i, round(avg(v), 6) AS value FROM (SELECT vec_id % 16 AS key, unnest(range(1, 65)) - 1 AS i, unnest(embedding) AS v FROM embeddings) GROUP BY 1, 2")
def mean_pool_components(spark, sf):
    tokens = table(spark, sf, "embeddings").select((F.col("vec_id") % 16).alias("key"), "embedding")
    every = mean_pooled(tokens, "key", "embedding").select("key", F.posexplode("pooled").alias("i", "value"))
    return every.select("key", F.col("i").cast("bigint").alias("i"), F.round("value", 6).alias("value"))


@query("""WITH c AS (SELECT vec_id, label, unnest(range(1, 65)) - 1 AS i, unnest(embedding) AS v FROM embeddings),
    m AS (SELECT i, avg(v) AS a, stddev_pop(v) AS s FROM c WHERE label < 8 GROUP BY i) SELECT vec_id, i, round((v - a) / s, 6) AS value FROM c JOIN m USING (i)""")
def standardise_components(spark, sf):
    vectors = table(spark, sf, "embeddings")
    out = standardized(vectors, "embedding", *standard_moments(vectors.where("label < 8"), "embedding"), "z").select("vec_id", F.posexplode("z").alias("i", "value"))
    return out.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("value", 6).alias("value"))


@query(f"WITH {_USABLE} SELECT uniprot_id, protein_idx, ligand, list_aggregate(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)), 'sum')::BIGINT AS total FROM usable JOIN embeddings ON vec_id = protein_idx")
def descriptor_sums(spark, sf):
    """Every component of each descriptor, in thousandths, added up."""
    total = F.aggregate("descriptor", F.lit(0).cast("bigint"), lambda acc, x: acc + F.floor(x.cast("double") * 1000))
    return _described(spark, sf).select("uniprot_id", "protein_idx", "ligand", total.alias("total"))


@query(f"SELECT sha256(string_agg(ligand || chr(0), '' ORDER BY ligand)) AS digest FROM ({_LIGANDS.format('affinity_manifest')})")
def membership_digests(spark, sf):
    return spark.createDataFrame([(membership_digest(_ligands(spark, sf, "affinity_manifest"), "ligand"),)], "digest string")


_SHARE = "CAST(round_even(count(*) * 0.015, 0) AS BIGINT)"


@query(f"SELECT count(*) AS ligands, {_SHARE} AS test_wanted, least(count(*) - {_SHARE}, {_SHARE}) AS val_wanted, true AS within_targets, true AS some_kept, CAST(0 AS BIGINT) AS crossing FROM embeddings")
def greedy_targets(spark, sf):
    """What the greedy split was to reach: no split beyond its target, ligands kept, and no edge across splits."""
    split, ligands, edges = _greedy(spark, sf)
    wanted = greedy.target_counts(ligands.count())
    n = split.agg(F.count(F.lit(1)).alias("ligands"), *(F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")))
    crossing = split_violations(split, ligands, edges).first()["crossing"]
    within = (F.col("train") <= wanted["train"]) & (F.col("val") <= wanted["val"]) & (F.col("test") <= wanted["test"])
    return n.select("ligands", *(F.lit(wanted[s]).cast("bigint").alias(f"{s}_wanted") for s in ("test", "val")), within.alias("within_targets"), (F.col("train") + F.col("val") + F.col("test") > 0).alias("some_kept"), F.lit(crossing).cast("bigint").alias("crossing"))


@query(f"WITH {_USABLE} SELECT split, count(*) AS rows, CAST(0 AS BIGINT) AS without_prediction, CAST(0 AS BIGINT) AS wrong_errors, true AS better_than_the_mean FROM usable JOIN embeddings ON vec_id = protein_idx WHERE split = 'train' GROUP BY split")
def model_rules(spark, sf):
    """What must hold of model_predictions: a prediction for each row, errors that fit it, and on train, where it was
    fitted, a squared error below that of the mean."""
    rows = model_predictions(spark, sf).where("split = 'train'")
    off = (F.abs(F.abs(F.col("true_affinity") - F.col("predicted_affinity")) - F.col("abs_error")) > 1e-9) | (F.abs(F.col("abs_error") * F.col("abs_error") - F.col("squared_error")) > 1e-6)
    out = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("predicted_affinity").isNull()).alias("without_prediction"), F.count_if(off).alias("wrong_errors"),
        (F.avg("squared_error") < F.var_pop("true_affinity")).alias("better_than_the_mean"),
    )
    return out
