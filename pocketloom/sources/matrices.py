"""Dense matrices: .npy files at the edge, a row of array<float> for each index within."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pocketloom.operators.contracts import ContractError


def read_matrix(spark: SparkSession, path: str | Path, index: str = "protein_idx", vector: str = "descriptor") -> DataFrame:
    """(index, vector) from a two-dimensional .npy file; a row for each protein, so it is read on the driver."""
    matrix = np.load(path, allow_pickle=False)
    if matrix.ndim != 2:
        raise ContractError(f"{path} must hold a matrix, not an array of shape {matrix.shape}")
    return spark.createDataFrame([(i, row) for i, row in enumerate(matrix.astype(np.float32).tolist())], f"{index} int, {vector} array<float>")


def write_matrix(df: DataFrame, path: str | Path, index: str = "protein_idx", vector: str = "descriptor", dtype: str = "float32") -> tuple[int, int]:
    """The vectors in order of index, as a .npy file of the given type; its shape. Lengths must agree."""
    if dtype not in ("float16", "float32", "float64"):
        raise ContractError(f"{dtype} is no float type")
    rows = [r[0] for r in df.orderBy(index).select(F.col(vector)).toLocalIterator()]
    if len({len(r) for r in rows}) > 1:
        raise ContractError("the vectors are of different lengths")
    out = np.array(rows, dtype).reshape(len(rows), -1)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    np.save(path, out)
    return out.shape
