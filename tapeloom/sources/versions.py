"""A folder of Parquet versions: each write is a folder of its own, and a small pointer file, written last, makes it count.

A version without a pointer (a write that broke off), or whose files aren't as its pointer says, is passed over.
"""

from __future__ import annotations

import json
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The Hadoop file system and path of a name: any store that Spark can use."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def _sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Sizes of a folder's data files by name; none if it isn't there."""
    fs, p = _at(spark, path)
    found = fs.listStatus(p) if fs.exists(p) else []
    return {s.getPath().getName(): s.getLen() for s in found if s.getPath().getName().endswith(".parquet")}


def _pointers(spark: SparkSession, folder: str) -> list[dict]:
    """What the pointers say, by version; unreadable ones are left out. There is a line for each write."""
    fs, p = _at(spark, f"{folder}/pointers")
    if not fs.exists(p):
        return []
    out = []
    for (line,) in spark.read.option("ignoreCorruptFiles", True).text(f"{folder}/pointers").collect():
        try:
            pointer = json.loads(line)
            out.append({"version": int(pointer["version"]), "rows": int(pointer["rows"]), "files": dict(pointer["files"])})
        except (ValueError, KeyError, TypeError):
            continue
    return sorted(out, key=lambda x: x["version"])


def write(rows: DataFrame, folder: str, version: int) -> int:
    """Writes `rows` as a version; one of the same number is replaced, so that a write can be done again. Gives its rows."""
    spark = rows.sparkSession
    delete(spark, f"{folder}/pointers/{version}.json")
    rows.write.mode("overwrite").parquet(f"{folder}/v{version}")
    n = spark.read.schema(rows.schema).parquet(f"{folder}/v{version}").count()
    told = json.dumps({"version": version, "rows": n, "files": _sizes(spark, f"{folder}/v{version}")})
    fs, p = _at(spark, f"{folder}/pointers/{version}.json")
    out = fs.create(p, True)
    out.write(bytearray(told.encode()))
    out.close()
    return n


def sound(spark: SparkSession, folder: str) -> list[int]:
    """Versions whose files are all there, as long as they were, with footers that tell as many rows."""
    good = []
    for x in _pointers(spark, folder):
        if _sizes(spark, f"{folder}/v{x['version']}") != x["files"]:
            continue
        try:
            if not x["files"] or spark.read.parquet(f"{folder}/v{x['version']}").count() == x["rows"]:
                good.append(x["version"])
        except (PySparkException, Py4JJavaError):
            continue
    return good


def following(spark: SparkSession, folder: str) -> int:
    """A number that no version has had, sound or not."""
    fs, p = _at(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=-1) + 1


def read(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """All sound versions together; an empty table if there is none."""
    paths = [f"{folder}/v{v}" for v in sound(spark, folder)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
