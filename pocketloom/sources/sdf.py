"""Docked poses in SDF files: blocks split at $$$$, with properties, atoms and bonds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The properties that a docked pose must carry.
VARIANT, SCORE, GRID = "s_lp_Variant", "r_i_docking_score", "s_i_glide_gridfile"
PATTERN = "*_docked/batch_*_docked.sdf"
SCHEMA = "source_sdf string, mol_index int, variant string, grid string, glide_score double, x array<array<int>>, pos array<array<double>>"


def parse_block(block: str) -> dict | None:
    """One molecule of a V2000 block: its properties, atoms as x (the place of the element's symbol among ELEMENTS, -1
    if unknown) and pos; None if it can't be parsed."""
    lines = block.lstrip("\n").split("\n") if not block.startswith("\n") else block.split("\n")
    at = next((i for i, line in enumerate(lines[:6]) if "V2000" in line), None)
    if at is None:
        return None
    try:
        n = int(lines[at][0:3])
        atoms = lines[at + 1 : at + 1 + n]
        pos = [[float(a[0:10]), float(a[10:20]), float(a[20:30])] for a in atoms]
        x = [[_number(a[31:34].strip())] for a in atoms]
    except (ValueError, IndexError):
        return None
    if len(pos) != n:
        return None
    props: dict[str, str] = {}
    name = None
    for line in lines[at + 1 + n :]:
        if line.startswith(">"):
            name = line[line.find("<") + 1 : line.rfind(">")] if "<" in line else None
            if name:
                props[name] = ""
        elif name and line.strip():
            props[name] = f"{props[name]}\n{line}" if props[name] else line
        elif name:
            name = None
    return {"props": props, "x": x, "pos": pos}


# Symbols of the elements by atomic number, as far as ligands have them.
ELEMENTS = "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe".split()


def _number(symbol: str) -> int:
    return ELEMENTS.index(symbol) + 1 if symbol in ELEMENTS else -1


def read_docked(spark: SparkSession, folder: str, pattern: str = PATTERN) -> DataFrame:
    """Every docked pose below folder, by file and place in it. Molecules that can't be parsed or lack one of the three
    properties are left out; no file at all is an error. A file is read by one task, so files should be of a batch each.
    """
    try:
        files = spark.read.format("binaryFile").load(f"{folder}/{pattern}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no {pattern} below {folder}") from None
        raise

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                for i, block in enumerate(bytes(content).decode("utf-8", "replace").replace("\r\n", "\n").split("$$$$\n")):
                    mol = parse_block(block) if block.strip() else None
                    if mol and {VARIANT, SCORE, GRID} <= mol["props"].keys():
                        p = mol["props"]
                        rows.append((path, i, p[VARIANT].strip(), p[GRID].strip(), float(p[SCORE]), mol["x"], mol["pos"]))
                yield pd.DataFrame(rows, columns=["source_sdf", "mol_index", "variant", "grid", "glide_score", "x", "pos"])

    return files.select("path", "content").mapInPandas(scan, SCHEMA).withColumn("source_sdf", F.regexp_replace("source_sdf", "^file:/*", "/"))
