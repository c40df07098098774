"""Embedding protein sequences by a pluggable model, mean-pooled over residues."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pocketloom.functions.nulls import strict_double
from pocketloom.functions.sequences import RESIDUES, normal_sequence, truncated
from pocketloom.operators.contracts import assert_sequences
from pocketloom.schemas import SEQUENCE
from pocketloom.sources.tables import read_csv_checked


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(protein_idx, sequence) in order of index: whole numbers 0 .. rows - 1, each once, sequences not blank."""
    raw = read_csv_checked(spark, path, SEQUENCE.fieldNames())
    rows = raw.select(strict_double(F.col("protein_idx"), "protein_idx").alias("protein_idx"), "sequence")
    return assert_sequences(rows).select(F.col("protein_idx").cast("int"), "sequence").orderBy("protein_idx")


def one_hot(sequence: str) -> np.ndarray:
    """Residues as rows of 0 and 1; the stand-in for a language model where none is installed."""
    return np.eye(len(RESIDUES), dtype=np.float32)[[RESIDUES.index(r) for r in sequence]]


def embedded(sequences: DataFrame, model: Callable[[str], np.ndarray] = one_hot, longest: int = 0) -> DataFrame:
    """(protein_idx, descriptor): the mean of the model's rows for each residue. model runs in the tasks, text by text,
    over normalised sequences, cut to longest residues unless that is 0."""
    rows = sequences.select("protein_idx", truncated(normal_sequence(F.col("sequence")), longest).alias("sequence"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"protein_idx": batch["protein_idx"], "descriptor": [model(s).mean(axis=0).astype(np.float32).tolist() for s in batch["sequence"]]})

    return rows.mapInPandas(run, "protein_idx int, descriptor array<float>")
