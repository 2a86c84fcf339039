"""Versions of a table and batches of a stream, each made visible by one commit that can be put once only.

A commit is a small file that is put if nothing has its name: by a hard link on local disks, by a rename that never
replaces elsewhere. Data is written first, below a name of its own, so a run that fails at whatever step leaves what was visible before.
"""

from __future__ import annotations

import json
import os
import re
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: The folder of each batch, as a partition of its own.
_BATCH = "__batch"


class Conflict(Exception):
    """Another commit has taken the place that this one was built for."""


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a file with its whole text, or returns False where the name is taken: of several that try at once, one succeeds."""
    jvm, fs, at = _fs(spark, path)
    fs.mkdirs(at.getParent())
    part = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid4().hex}.part")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            try:
                os.link(part.toUri().getPath(), at.toUri().getPath())
                return True
            except FileExistsError:
                return False
        if fs.exists(at):
            return False
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(part, at, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
    finally:
        if fs.exists(part):
            fs.delete(part, False)


def _names(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    _, fs, at = _fs(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(at) if re.fullmatch(pattern, x.getPath().getName())) if fs.exists(at) else []


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(path).collect()))


def head(spark: SparkSession, root: str) -> int:
    """The number of the last version below root, 0 without any."""
    found = _names(spark, f"{root}/commits", r"\d{20}")
    return int(found[-1]) if found else 0


def publish(spark: SparkSession, state: DataFrame, root: str, base: int | None = None) -> int:
    """Writes a new version below root and commits it as the one after `base`, the version that the state was built on (None: the last when the call begins).

    If another version has been committed since, that one stays and this raises Conflict: its state was built on
    an old version and has to be worked out again. Returns the new version's number.
    """
    last = head(spark, root)
    base = last if base is None else base
    if base != last:
        raise Conflict(f"version {last} has been published since version {base}")
    path = f"version-{base + 1:020d}-{uuid4().hex}"
    state.write.parquet(f"{root}/{path}")
    if not put_if_absent(spark, f"{root}/commits/{base + 1:020d}", json.dumps({"base": base, "path": path, "schema": state.schema.jsonValue()})):
        raise Conflict(f"version {base + 1} has been published meanwhile")
    return base + 1


def published(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """A version by number, the last by default."""
    number = number or head(spark, root)
    if not number:
        raise FileNotFoundError(f"no version below {root}")
    commit = _read(spark, f"{root}/commits/{number:020d}")
    return spark.read.schema(T.StructType.fromJson(commit["schema"])).parquet(f"{root}/{commit['path']}")


def superseded(spark: SparkSession, root: str) -> list[str]:
    """Folders of versions that no reader of the last one needs: older ones, and those whose commit was refused or never tried. Removing them is up to the owner."""
    last = head(spark, root)
    kept = _read(spark, f"{root}/commits/{last:020d}")["path"] if last else None
    return [x for x in _names(spark, root, r"version-\d{20}-[0-9a-f]{32}") if x != kept and int(x.split("-")[1]) <= last]


def append_once(rows: DataFrame, root: str, query: str, batch: int, by: tuple[str, ...] = ()) -> bool:
    """Appends a batch of a query to the table below root, once: what is committed is left alone, and what a failed attempt has written is never read.

    by: columns that the batch's files are partitioned by. False where the batch was there. For foreachBatch, whose batches
    come again after a failure, with their numbers.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", query) or batch < 0:
        raise ValueError("a query has a name of letters, digits and _.-, and batches count from 0")
    spark, name = rows.sparkSession, f"{query}@{batch:020d}"
    _, fs, at = _fs(spark, f"{root}/commits/{name}")
    if fs.exists(at):
        return False
    path = f"data/{_BATCH}={name}-{uuid4().hex}"
    rows.write.partitionBy(*by).parquet(f"{root}/{path}")
    return put_if_absent(spark, f"{root}/commits/{name}", json.dumps({"path": path, "schema": rows.schema.jsonValue()}))


def appended(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all committed batches. All batches have the columns of the first."""
    names = _names(spark, f"{root}/commits", r"[A-Za-z0-9_.-]+@\d{20}")
    if not names:
        raise FileNotFoundError(f"no batch below {root}")
    paths = spark.read.text([f"{root}/commits/{n}" for n in names]).select(F.get_json_object("value", "$.path").alias("path")).collect()
    schema = T.StructType.fromJson(_read(spark, f"{root}/commits/{names[0]}")["schema"])
    read = spark.read.schema(T.StructType([*schema, T.StructField(_BATCH, T.StringType())])).option("basePath", f"{root}/data")
    return read.parquet(*(f"{root}/{r.path}" for r in paths)).select(*schema.names)
