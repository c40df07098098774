"""Tables of the pipeline: columns, types, and the defaults of its parameters."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, DOUBLE, BOOLEAN = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# The columns of the tables, in their order, and the defaults of the pipeline.
RAW_BINDING = _struct(uniprot_id=STRING, smiles=STRING, binding_affinity=DOUBLE, pIC50=DOUBLE)
AFFINITY = _struct(uniprot_id=STRING, ligand=STRING, affinity=DOUBLE)
SPLIT = _struct(ligand=STRING, ligand_idx=INT, split=STRING)
PROTEIN = _struct(uniprot_id=STRING, protein_idx=INT)
SEQUENCE = _struct(protein_idx=INT, sequence=STRING)
AFFINITY_SPLIT = _struct(uniprot_id=STRING, protein_idx=INT, ligand=STRING, ligand_idx=INT, affinity=DOUBLE, split=STRING)
POSE = _struct(
    pose_id=STRING, pose_hash=STRING, pdb_key=STRING, ligand=STRING, grid=STRING, uniprot_id=STRING,
    pdb_id=STRING, glide_score=DOUBLE, pose_rank=INT, is_top_rank=BOOLEAN, source_sdf=STRING,
)
POSE_DUPLICATE = _struct(
    pose_id=STRING, pose_hash=STRING, source_sdf=STRING, pdb_key=STRING, ligand=STRING, glide_score=DOUBLE,
    pose_rank=INT, exists_in_manifest=BOOLEAN, exists_in_lmdb=BOOLEAN,
)
PREDICTION = _struct(
    uniprot_id=STRING, protein_idx=INT, ligand=STRING, ligand_idx=INT, split=STRING, true_affinity=DOUBLE,
    predicted_affinity=DOUBLE, abs_error=DOUBLE, squared_error=DOUBLE,
)
LINEAR_OUTPUT = _struct(uniprot_id=STRING, ligand=STRING, split=STRING, min_glide_score=DOUBLE, true_affinity=DOUBLE, predicted_affinity=DOUBLE)

ACTIVE_SPLITS = ("train", "val", "test")
ALL_SPLITS = (*ACTIVE_SPLITS, "dropped")
FRACTIONS = {"train": 0.97, "val": 0.015, "test": 0.015}
TANIMOTO_THRESHOLD = 0.3
FINGERPRINT_BITS = 248
SEED = 7
RESTARTS = 3
#: Kept ligands from which on a protein must have both val and test ligands.
COVERAGE_FLOOR = 100
