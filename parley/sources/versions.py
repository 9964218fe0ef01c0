"""A table whose rewrites are seen whole or not at all.

Each version is a folder of its own; a small pointer file names the current one and is replaced in one
step by a rename. Readers take the version the pointer names when they begin, and keep it: a rewrite
writes beside what is being read, and one that fails leaves the pointer as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the current version, or None where nothing was published yet."""
    where = _path(spark, f"{path}/{POINTER}")
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return None
    source = system.open(where)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
    return f"{path}/{name}"


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a fresh folder, then make it the current version."""
    name = f"version-{uuid.uuid4().hex}"
    write(f"{path}/{name}")
    fresh, pointer = _path(spark, f"{path}/{POINTER}-{name}"), _path(spark, f"{path}/{POINTER}")
    conf = spark._jsc.hadoopConfiguration()
    out = fresh.getFileSystem(conf).create(fresh)
    out.write(bytearray(name.encode()))
    out.close()
    jvm, system = spark._jvm, fresh.getFileSystem(conf)
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf)
    context.rename(system.makeQualified(fresh), system.makeQualified(pointer), how)
    return f"{path}/{name}"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines of the current version; none before the first."""
    found = current(spark, path)
    return spark.read.text(found) if found else spark.createDataFrame([], "value string")


def append_records(path: str, new: DataFrame, line: str = "record") -> str:
    """Read, extend and rewrite: a new version with the lines of the current one and those of ``new``.

    Old lines are carried as they are, so no field of them changes or gets lost.
    """
    spark = new.sparkSession
    lines = read_lines(spark, path).unionByName(new.selectExpr(f"`{line}` AS value"))
    return publish(spark, path, lambda folder: lines.write.text(folder))
