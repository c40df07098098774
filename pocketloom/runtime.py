"""What every operator shares: tables, the scratch folder, size-checked broadcasts, key normal forms."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pocketloom.sources.files import delete

#: Rows and bytes up to which a table may be broadcast.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20

#: White space as Python's str.strip() understands it: blanks, tabs, line breaks, no-break and typographic spaces.
SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

_made: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of its own; on a cluster that would be lost with its
    machine, so there it is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pocketloom-"))
    return context.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/pocketloom/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._pocketloom_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes what materialize() wrote for df; only for tables that nothing reads any more."""
    path = getattr(df, "_pocketloom_path", None)
    if path and path in _made:
        delete(_made.pop(path), path)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_made.items()):
        try:
            delete(spark, path)
        except Exception:  # the session may have ended before
            pass


def row_bytes(df: DataFrame, columns: list[str] | None = None) -> Column:
    """About how many bytes a row takes: the length of text, eight for each number, nested values as JSON."""
    total = F.lit(0).cast("bigint")
    for f in df.schema.fields if columns is None else [df.schema[c] for c in columns]:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            total = total + F.coalesce(F.array_size(c), F.lit(0)) * 8 + 16
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        else:
            total = total + 8
    return total


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most that many rows and bytes; reads no more rows of it than that."""
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    return n <= rows and (size or 0) <= most_bytes


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its rows and bytes were checked to be within the bounds, else df for a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df


def trimmed(column: Column | str) -> Column:
    """Text without surrounding white space; null if nothing is left."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.btrim(c.cast("string"), F.lit(SPACE)), F.lit(""))


def accession(column: Column | str) -> Column:
    """The form in which uniprot_id is compared: trimmed, upper case, blank as null."""
    return F.upper(trimmed(column))
