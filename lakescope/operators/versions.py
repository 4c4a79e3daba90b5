"""Result tables refreshed database by database, each refresh committed at once by a manifest.

A table is a folder with ``data/<id>`` folders, written once and never changed, and ``manifests/<version>.json``. A
manifest names the data folders that are current and the databases each is current for; readers follow the
newest. A refresh writes its data, then its manifest (under another name, renamed when complete): until
then readers see the old rows, and a writer that dies leaves no trace but files that nothing names. A database
refreshed to no rows has none afterwards. One writer at a time: a second that commits the same version fails.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescope.session import delete_path, path_exists


def _folder(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    if not path_exists(spark, path):
        return []
    fs, at = _folder(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The newest manifest, or that of a version: {version, schema, folders: {folder: [databases]}}."""
    found = [n for n in _names(spark, f"{path}/manifests") if n.endswith(".json")]
    if version is not None:
        found = [n for n in found if int(n[:-5]) == version]
    if not found:
        return None
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/manifests/{found[-1]}", wholetext=True).collect()))


def _commit(spark: SparkSession, path: str, entry: dict) -> None:
    fs, at = _folder(spark, f"{path}/manifests/{entry['version']:012d}.json")
    if fs.exists(at):
        raise RuntimeError(f"another writer has committed version {entry['version']} of {path}")
    _, draft = _folder(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    if not fs.rename(draft, at):
        raise RuntimeError(f"version {entry['version']} of {path} could not be committed")


def refresh(df: DataFrame, path: str, databases: list[str]) -> int:
    """Replace all rows of the given databases by those that ``df`` has of them; returns the version committed."""
    spark = df.sparkSession
    old = manifest(spark, path) or {"version": 0, "folders": {}}
    folder = f"data/{uuid.uuid4().hex}"
    df.filter(F.col("database_name").isin(databases)).write.partitionBy("database_name").parquet(f"{path}/{folder}")
    kept = {f: [d for d in of if d not in databases] for f, of in old["folders"].items()}
    entry = {"version": old["version"] + 1, "schema": df.schema.json(),
             "folders": {f: of for f, of in kept.items() if of} | {folder: sorted(databases)}}
    _commit(spark, path, entry)
    return entry["version"]


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of the given one while its files are kept."""
    now = manifest(spark, path, version)
    if now is None:
        raise ValueError(f"no version of {path} is committed")
    schema = T.StructType.fromJson(json.loads(now["schema"]))
    parts = [spark.read.schema(schema).option("basePath", f"{path}/{f}").parquet(f"{path}/{f}").filter(
        F.col("database_name").isin(of)).select(*schema.names) for f, of in now["folders"].items()]
    return reduce(DataFrame.unionByName, parts)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete manifests before the newest, and data that it does not name, once no reader uses them; returns folders deleted."""
    now = manifest(spark, path)
    gone = [f for f in _names(spark, f"{path}/data") if now is None or f"data/{f}" not in now["folders"]]
    for f in gone:
        delete_path(spark, f"{path}/data/{f}")
    for name in _names(spark, f"{path}/manifests"):
        if now is None or name != f"{now['version']:012d}.json":
            delete_path(spark, f"{path}/manifests/{name}")
    return len(gone)
