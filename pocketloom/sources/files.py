"""Files of any file system that Spark can reach, by Hadoop's interface: looked up, written and moved by the driver."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str | Path):
    """The file system of a path, and the path as Hadoop has it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str | Path) -> bool:
    fs, where = located(spark, path)
    return fs.exists(where)


def is_folder(spark: SparkSession, path: str | Path) -> bool:
    fs, where = located(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def delete(spark: SparkSession, path: str | Path) -> None:
    fs, where = located(spark, path)
    fs.delete(where, True)


def move(spark: SparkSession, source: str | Path, target: str | Path) -> None:
    """source in place of target, which goes; the folder above target is made if it is missing."""
    fs, to = located(spark, target)
    fs.delete(to, True)
    fs.mkdirs(to.getParent())
    if not fs.rename(located(spark, source)[1], to):
        raise OSError(f"{source} could not be moved to {target}")


def names(spark: SparkSession, folder: str | Path) -> list[str]:
    """What a folder holds, in order; nothing where it is missing."""
    fs, where = located(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def write_bytes(spark: SparkSession, path: str | Path, content: bytes) -> None:
    fs, where = located(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str | Path, text: str) -> None:
    write_bytes(spark, path, text.encode())


def read_text(spark: SparkSession, path: str | Path) -> str:
    return spark.read.text(str(path), wholetext=True).first()[0]


def joined(spark: SparkSession, head: str, parts: Iterable[str], path: str | Path) -> None:
    """head and then the bytes of all parts, in order, as one file; streamed in the JVM."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, where = located(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(head.encode()))
        for p in parts:
            source = located(spark, p)
            stream = source[0].open(source[1])
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            stream.close()
    finally:
        out.close()
