"""Tables that are made once and read by all who ask for the same.

A stored table is a folder with a folder for each version and a manifest that
names the current one and its origin: parameters, inputs and code. A version is
written whole before the manifest is replaced in one step, so a reader sees the
table before or after, and a build that fails leaves the one before.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tripweave.sources.scratch import shared_folder

MANIFEST = "_manifest.json"


@cache
def _code() -> str:
    """Digest of this package's files, so that other code makes other tables."""
    digest = hashlib.sha256()
    root = Path(__file__).resolve().parents[1]
    for path in sorted(root.rglob("*.py")):
        digest.update(str(path.relative_to(root)).encode() + path.read_bytes())
    return digest.hexdigest()


def _path(spark: SparkSession, *parts: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _conf(spark: SparkSession):
    return spark._jsparkSession.sessionState().newHadoopConf()


def _files(df: DataFrame) -> list[tuple[str, int, int]]:
    """Names, sizes and times of the files that ``df`` reads, from one listing a folder."""
    spark, found, names = df.sparkSession, [], set()
    jvm = spark.sparkContext._jvm
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()  # the optimizer may leave files out
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() == "LogicalRelation" and hasattr(leaf.relation(), "location"):
            names.update(leaf.relation().location().inputFiles())
    for folder in sorted({n.rpartition("/")[0] for n in names}):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))  # names come encoded
        for status in path.getFileSystem(_conf(spark)).listStatus(path):
            name = status.getPath().toUri().toString()
            if name in names or name.replace("file:/", "file:///", 1) in names:
                found.append((name, status.getLen(), status.getModificationTime()))
    return sorted(found)


def _plan(df: DataFrame) -> str:
    """The plan of ``df`` without the numbers that Spark gives to columns."""
    text = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    return re.sub(r"#\d+L?|plan_id=\d+|\(\d+\)", "#", text) + str(df.semanticHash())


def origin(parameters: object, *inputs: DataFrame, plans: bool = False) -> str:
    """Digest of parameters, input files with sizes and times, and this code.

    With ``plans`` what is done to the files before counts as well.
    """
    parts = [repr(parameters), _code(), *[repr(_files(df)) for df in inputs]]
    parts += [_plan(df) for df in inputs] if plans else []
    return hashlib.sha256("\n".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What is known of the table at ``path``: its current ``version`` and ``origin``."""
    file = _path(spark, path, MANIFEST)
    fs = file.getFileSystem(_conf(spark))
    if not fs.exists(file):
        return None
    stream = fs.open(file)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _replace_manifest(spark: SparkSession, path: str, content: dict) -> None:
    jvm = spark.sparkContext._jvm
    new, file = _path(spark, path, f"_manifest-{uuid.uuid4().hex}.tmp"), _path(spark, path, MANIFEST)
    stream = new.getFileSystem(_conf(spark)).create(new, True)
    try:
        stream.write(json.dumps(content).encode())
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(file.toUri(), _conf(spark)).rename(new, file, options)


def _drop_old(spark: SparkSession, path: str, kept: set[str | None]) -> None:
    root = _path(spark, path)
    fs = root.getFileSystem(_conf(spark))
    for status in fs.listStatus(root):
        if status.isDirectory() and status.getPath().getName().startswith("v-") and status.getPath().getName() not in kept:
            fs.delete(status.getPath(), True)


def replace(spark: SparkSession, path: str, table: DataFrame, made_from: str, write: Callable[[DataFrame, str], None] | None = None) -> None:
    """Write ``table`` as a new version, with ``write(table, folder)``, and put it in the place of the current one.

    The version before stays for readers that have begun; older ones go.
    """
    before = manifest(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{version}"
    table.write.parquet(folder) if write is None else write(table, folder)
    _replace_manifest(spark, path, {"version": version, "origin": made_from, "schema": table.schema.json()})
    _drop_old(spark, path, {version, before and before["version"]})


def current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of the table at ``path``."""
    known = manifest(spark, path)
    if known is None:
        raise FileNotFoundError(f"no finished table at {path}")
    schema = T.StructType.fromJson(json.loads(known["schema"]))  # an empty table has no file to tell it
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{known['version']}")


def stored(spark: SparkSession, name: str, parameters: object, inputs: list[DataFrame], build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` as a table in the shared folder, made only if no one made the same before.

    What is the same is told by the name, ``parameters``, the plans and files of
    ``inputs``, and this code.
    """
    made_from = origin((name, parameters), *inputs, plans=True)
    path = f"{shared_folder(spark)}/store/{name}-{made_from[:32]}"
    known = manifest(spark, path)
    if known is None or known["origin"] != made_from:
        replace(spark, path, build(), made_from)
    return current(spark, path)
