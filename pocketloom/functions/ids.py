"""Keys of ligands, grids and poses, as column expressions that fail on malformed input."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pocketloom.functions.nulls import stripped


def _fail(message: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), F.coalesce(value, F.lit("null"))))


def required_text(column: Column, name: str) -> Column:
    """Text without surrounding white space; null or blank fails."""
    text = stripped(column)
    return F.when(F.coalesce(text, F.lit("")) == "", _fail(f"{name} is blank: ", column)).otherwise(text)


def pdb_key(pdb_id: Column, uniprot_id: Column) -> Column:
    return F.concat_ws("_", required_text(pdb_id, "pdb_id"), required_text(uniprot_id, "uniprot_id"))


def grid_parts(grid: Column) -> Column:
    """A struct of pdb_id and uniprot_id: the grid's name cut at its first underscore; both must have text."""
    text = stripped(grid)
    at = F.locate("_", text)
    left, right = text.substr(F.lit(1), at - 1), text.substr(at + 1, F.length(text))
    good = (at > 1) & (at < F.length(text)) & (stripped(left) != "") & (stripped(right) != "")
    bad = ~F.coalesce(good, F.lit(False))
    return F.struct(
        F.when(bad, _fail("grid is not like pdb_uniprot: ", grid)).otherwise(left).alias("pdb_id"),
        F.when(bad, _fail("grid is not like pdb_uniprot: ", grid)).otherwise(right).alias("uniprot_id"),
    )


def variant_ligand(variant: Column) -> Column:
    """The ligand of a variant such as CCO-12: everything before the last dash and number; no match fails."""
    text = stripped(variant)
    pattern = r"^([\s\S]+)-(\d+)$"
    good = F.coalesce(text.rlike(pattern), F.lit(False))
    return F.when(good, F.regexp_extract(text, pattern, 1)).otherwise(_fail("variant is not like ligand-number: ", variant))


def pose_id(key: Column, ligand: Column, content_hash: Column) -> Column:
    return F.concat_ws("_", key, ligand, content_hash)


def pose_id_by_number(key: Column, ligand: Column, number: Column) -> Column:
    return F.concat_ws("_", required_text(key, "pdb_key"), ligand, number.cast("string"))


def normal_ids(ids: Iterable[str] | None) -> tuple[str, ...] | None:
    """Ids without white space and blanks, each once, in order. None stays None; nothing left is an error."""
    if ids is None:
        return None
    out = tuple(sorted({x for x in (str(i).strip() for i in ids) if x}))
    if not out:
        raise ValueError("a protein subset needs at least one id that is not blank")
    return out


def subset_slug(ids: Iterable[str]) -> str:
    return "_".join(normal_ids(ids) or ())


def subset_file(name: str, ids: Iterable[str] | None = None) -> str:
    """The name of an output of a run over a protein subset, or over all proteins."""
    return name if ids is None else f"{subset_slug(ids)}_{name}"
