"""Pluggable chemistry: canonical forms and fingerprints. RDKit is used where it is installed, else plain text forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pocketloom.functions.ids import required_text
from pocketloom.functions.nulls import stripped
from pocketloom.schemas import FINGERPRINT_BITS

#: Bits in a word of a packed fingerprint; the sign bit stays clear.
WORD = 62


def plain_canonical(column: Column) -> Column:
    """Not chemistry: the text without surrounding white space; blank fails."""
    return required_text(column, "smiles")


def plain_canonical_or_null(column: Column) -> Column:
    """As plain_canonical, but null for blank text."""
    return F.nullif(stripped(column), F.lit(""))


def rdkit_canonical(strict: bool = True) -> Callable[[Column], Column]:
    """Canonical SMILES by RDKit; text that can't be parsed fails, or gives null if not strict."""

    @F.pandas_udf("string")
    def canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from rdkit import Chem

        def one(text: str | None) -> str | None:
            mol = Chem.MolFromSmiles(text.strip()) if text and text.strip() else None
            if mol is None and strict:
                raise ValueError(f"not a SMILES string: {text!r}")
            return Chem.MolToSmiles(mol) if mol is not None else None

        for batch in batches:
            yield batch.map(one, na_action=None)

    return canonical


def default_canonical(strict: bool = True) -> Callable[[Column], Column]:
    try:
        import rdkit  # noqa: F401
    except ImportError:
        return plain_canonical if strict else plain_canonical_or_null
    return rdkit_canonical(strict)


def sign_bits(vector: Column) -> Column:
    """On-bits of a vector: the places, from 0, of its positive components."""
    at = F.transform(vector, lambda x, i: F.when(x > 0, i))
    return F.filter(at, lambda i: i.isNotNull())


def ngram_bits(text: Column, n: int = 3, size: int = FINGERPRINT_BITS) -> Column:
    """On-bits of text: its runs of n characters, each hashed to one of size bits. Not chemistry."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(text, i, n)), F.lit(size)).cast("int"))))


def morgan_bits(radius: int = 2, size: int = FINGERPRINT_BITS) -> Callable[[Column], Column]:
    """On-bits of a Morgan fingerprint by RDKit."""

    @F.pandas_udf("array<int>")
    def bits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from rdkit import Chem
        from rdkit.Chem import rdFingerprintGenerator

        generator = rdFingerprintGenerator.GetMorganGenerator(radius=radius, fpSize=size)
        for batch in batches:
            yield batch.map(lambda s: list(generator.GetFingerprint(Chem.MolFromSmiles(s)).GetOnBits()))

    return bits


def packed(bits: Column, size: int = FINGERPRINT_BITS) -> list[Column]:
    """The on-bits as words of WORD bits each, w0 and on."""
    def word(k: int) -> Column:
        own = F.filter(bits, lambda b: (b >= k * WORD) & (b < (k + 1) * WORD))
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b - k * WORD)))

    return [word(k).alias(f"w{k}") for k in range(-(-size // WORD))]
