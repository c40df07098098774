"""CSV at the edges, Parquet within: checked scans and guarded sinks."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pocketloom.functions.nulls import lenient_double, present, strict_double
from pocketloom.operators.contracts import ContractError, require_columns
from pocketloom.sources.files import delete, exists, joined, move, names

#: Quotes are doubled within quoted fields; backslashes are plain characters, as SMILES have them.
CSV = {"header": "true", "escape": '"', "quote": '"', "inferSchema": "false"}


def read_csv(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """All columns as text, missing tokens as null. Fields may hold line breaks only if line_breaks says so, as files
    can't be split among tasks then."""
    raw = spark.read.options(**CSV, multiLine=str(line_breaks).lower()).csv(str(path))
    return raw.select(*(present(F.col(f"`{c}`")).alias(c) for c in raw.columns))


def read_csv_checked(spark: SparkSession, path: str, required: Iterable[str]) -> DataFrame:
    """As read_csv; fails before any row is read if a required column is missing. Other columns are kept."""
    return require_columns(read_csv(spark, path), list(required), str(path))


def typed(df: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """The columns of schema in its order, text cast to its types. Text that isn't a number fails, or gives null if not
    strict; booleans are true, 1 or yes in any case."""
    number = (lambda c, n: strict_double(c, n)) if strict else (lambda c, n: lenient_double(c))
    out = []
    for f in schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("double", "float", "integer", "long"):
            c = number(c, f.name).cast(f.dataType)
        elif kind == "boolean":
            c = F.lower(F.trim(c.cast("string"))).isin("true", "1", "1.0", "yes")
        out.append(c.alias(f.name))
    return df.select(*out)


def read_manifest(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """A table by its schema: a folder or file of Parquet, or CSV."""
    path = str(path)
    if path.endswith(".csv"):
        return typed(read_csv_checked(spark, path, schema.fieldNames()), schema, strict)
    df = require_columns(spark.read.parquet(path), schema.fieldNames(), path)
    return df.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))


def read_evolving(spark: SparkSession, path: str, schema: T.StructType, addable: dict[str, object]) -> DataFrame:
    """A table that may be absent (then empty) or lack just the columns of addable, which get the value given there.
    Lacking any other column is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = read_csv(spark, path) if str(path).endswith(".csv") else spark.read.parquet(str(path))
    missing = [c for c in schema.fieldNames() if c not in raw.columns]
    if set(missing) - set(addable):
        raise ContractError(f"{path} lacks the columns {missing}; it has {raw.columns}")
    raw = raw.withColumns({c: F.lit(addable[c]) for c in missing})
    return typed(raw, schema)


def guard_outputs(spark: SparkSession, paths: Iterable[str | Path], overwrite: bool) -> None:
    """Fails, naming all, if any output exists, on whatever file system, and may not be replaced."""
    there = [str(p) for p in paths if exists(spark, p)]
    if there and not overwrite:
        raise FileExistsError(f"outputs exist already: {', '.join(there)}; allow overwriting to replace them")


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(str(path))
    return str(path)


def replace_parquet(df: DataFrame, path: str) -> str:
    """Writes df beside the table at path and then puts it in its place, so that a run that breaks off leaves the old
    table, at path or at path.old. df may read path."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    if exists(spark, path):
        move(spark, path, f"{path}.old")
    move(spark, f"{path}.new", path)
    delete(spark, f"{path}.old")
    return str(path)


def recover(spark: SparkSession, path: str) -> None:
    """Undoes a replacement that broke off between its two steps."""
    if not exists(spark, path) and exists(spark, f"{path}.old"):
        move(spark, f"{path}.old", path)


_CSV_OUT = {"escape": '"', "quote": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str) -> str:
    """A folder of CSV parts with headers, replaced if there; for edges of the pipeline, in as many parts as tasks."""
    df.write.mode("overwrite").options(**_CSV_OUT | {"header": "true", "emptyValue": '""'}).csv(str(path))
    return str(path)


def write_single_csv(df: DataFrame, path: str | Path) -> str:
    """One CSV file, in the order of df. The tasks write parts beside it, which are then joined byte by byte; no row
    passes through Python."""
    spark, parts = df.sparkSession, f"{path}.parts"
    df.write.mode("overwrite").options(**_CSV_OUT | {"header": "false"}).csv(parts)
    head = ",".join(f'"{c.replace(chr(34), chr(34) * 2)}"' if set(c) & set(',"\n\r') else c for c in df.columns)
    joined(spark, head + "\n", (f"{parts}/{n}" for n in names(spark, parts) if n.startswith("part-")), path)
    delete(spark, parts)
    return str(path)


def append_parquet(df: DataFrame, path: str) -> str:
    return write_parquet(df, path, "append")


def put_if_absent(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key the table at path lacks, one for each key; returns the rows that were written.

    The table is the only record of what is there, so a run that breaks off can be repeated.
    """
    from pocketloom.operators.ranking import first_wins
    from pocketloom.runtime import materialize

    spark = df.sparkSession
    fresh = first_wins(df, key, [c for c in df.columns if c != key and not isinstance(df.schema[c].dataType, (T.MapType,))])[0]
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(str(path)).select(key), key, "left_anti").select(*df.columns)
    fresh = materialize(fresh, "fresh")
    append_parquet(fresh, path)
    return fresh
