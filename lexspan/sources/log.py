"""Append-only tables with a log of commits.

Data is written to a folder of its own first; it becomes visible when an entry of the log names it. Entries are numbered,
and an entry is made only if its number is free, so of writers at the same time one gets it; the others look at what has
been committed meanwhile, check their keys against it and try the next number. A writer that fails before its entry leaves
nothing that a reader sees. The store must refuse to link or rename onto a name that is taken, as local disks and HDFS do.
"""

from __future__ import annotations

import contextlib
import json
import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .stage import delete

LOG, DATA = "_log", "data"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _create(spark: SparkSession, path: str, content: str) -> bool:
    """Make a file with this content in one step; False if there is one already."""
    system, where = _file_system(spark, path)
    name = unquote(urlparse(system.makeQualified(where).toString()).path)
    if system.getScheme() == "file":
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(name), prefix=".", suffix=".tmp") as made:
            made.write(content)
            made.flush()
            try:
                os.link(made.name, name)
            except FileExistsError:
                return False
        return True
    beside = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}.tmp")
    out = system.create(beside, True)
    out.write(bytearray(content.encode()))
    out.close()
    taken = not system.rename(beside, where)
    if taken:
        system.delete(beside, False)
    return not taken


def entries(spark: SparkSession, path: str) -> list[dict]:
    """The log in order: version, data (folder), rows."""
    system, where = _file_system(spark, f"{path}/{LOG}")
    if not system.exists(where):
        return []
    names = sorted(n for n in (s.getPath().getName() for s in system.listStatus(where)) if n.endswith(".json") and not n.startswith("."))
    if not names:
        return []
    found = spark.read.schema("version long, data string, rows long").json([f"{path}/{LOG}/{n}" for n in names]).collect()  # a row a commit
    out = sorted((r.asDict() for r in found), key=lambda r: r["version"])
    if [e["version"] for e in out] != list(range(len(out))):
        raise ValueError(f"the log of {path} has gaps")
    return out


def _data(spark: SparkSession, path: str, some: list[dict], schema: StructType) -> DataFrame:
    folders = [f"{path}/{DATA}/{e['data']}" for e in some]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema: StructType | str, version: int | None = None) -> DataFrame:
    """What is committed, all of it or up to a version (included)."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    some = entries(spark, path)
    return _data(spark, path, some if version is None else some[: version + 1], schema)


def append(rows: DataFrame, path: str, key: list[str]) -> int:
    """Append rows whose keys are new; the version committed. A key that is stored already, or twice in this write, is
    refused, also if another writer stores it at the same time."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    mine = f"{path}/{DATA}/{name}"
    try:
        rows.write.parquet(mine)
        held = spark.read.schema(rows.schema).parquet(mine)
        if held.groupBy(*key).count().where("count > 1").limit(1).count():
            raise ValueError("a key is twice in this write")
        n, checked = held.count(), 0
        while True:
            known = entries(spark, path)
            if _data(spark, path, known[checked:], rows.schema).join(held.select(*key), key, "left_semi").limit(1).count():
                raise ValueError("a key is stored already")
            checked = len(known)
            entry = json.dumps({"version": checked, "data": name, "rows": n})
            if _create(spark, f"{path}/{LOG}/{checked:020d}.json", entry):
                return checked
    except BaseException:
        with contextlib.suppress(Exception):
            delete(spark, mine)
        raise
