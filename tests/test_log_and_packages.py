"""Commits of several writers, and packages written by tasks."""

import os
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from lexspan.sources import log, package, text

SCHEMA = "id long, x string"


def stored(spark, path, **kw):
    return sorted(tuple(r) for r in log.read(spark, path, SCHEMA, **kw).collect())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_appends_are_numbered_and_read_by_version(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stored(spark, path) == []
    assert [text.append(frame(spark, (1, "a"), (2, "b")), path, ["id"]), text.append(frame(spark, (3, "c")), path, ["id"])] == [0, 1]
    assert stored(spark, path) == [(1, "a"), (2, "b"), (3, "c")] and stored(spark, path, version=0) == [(1, "a"), (2, "b")]
    for bad in (frame(spark, (3, "z")), frame(spark, (4, "d"), (4, "e"))):
        with pytest.raises(ValueError):
            text.append(bad, path, ["id"])
    assert len(stored(spark, path)) == 3 and len(os.listdir(f"{path}/data")) == 2


def test_writers_at_the_same_time(spark, tmp_path):
    """Eight writers, four of them with the same key: one of those wins, all others are stored."""
    path, done = str(tmp_path / "t"), []

    def work(k):
        try:
            done.append(("ok", k, text.append(frame(spark, (0 if k % 2 else k, str(k)), (100 + k, "own")), path, ["id"])))
        except ValueError:
            done.append(("refused", k, None))

    threads = [threading.Thread(target=work, args=(k,)) for k in range(1, 9)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [k for how, k, _ in done if how == "ok"]
    assert sum(k % 2 for k in won) == 1 and {k for k in won if k % 2 == 0} == {2, 4, 6, 8}
    assert sorted(v for how, _, v in done if how == "ok") == [0, 1, 2, 3, 4]
    assert [r[0] for r in stored(spark, path)] == sorted([0, *(k for k in won if k % 2 == 0), *(100 + k for k in won)])
    assert len(os.listdir(f"{path}/data")) == 5


def test_a_loser_checks_what_was_committed_meanwhile(spark, tmp_path, monkeypatch):
    path, real, raced = str(tmp_path / "t"), log._create, []

    def overtaken(s, where, content):
        if not raced:
            raced.append(1)
            monkeypatch.setattr(log, "_create", real)
            log.append(frame(spark, (7, "other")), path, ["id"])
        return real(s, where, content)

    monkeypatch.setattr(log, "_create", overtaken)
    with pytest.raises(ValueError, match="stored already"):
        log.append(frame(spark, (7, "late")), path, ["id"])
    assert stored(spark, path) == [(7, "other")]


def test_a_failed_writer_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    log.append(frame(spark, (1, "a")), path, ["id"])
    broken = frame(spark, (2, "b")).withColumn("x", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        log.append(broken, path, ["id"])
    os.makedirs(f"{path}/data/left-by-a-killed-writer")
    assert stored(spark, path) == [(1, "a")] and len(log.entries(spark, path)) == 1


def test_packages_are_written_by_tasks(spark, tmp_path):
    rows = [(f"a{i:04d}", bytes([i % 256]) * (i % 90)) for i in range(500)]
    frames = [spark.createDataFrame(rows[::step], "artifact string, bytes binary").repartition(n) for step, n in ((1, 7), (-1, 2))]
    for name, df in zip("xy", frames):
        package.export(df, str(tmp_path / name), {"run": 1}, room=40_000)
    files = {name: {f: (tmp_path / name / f).read_bytes() for f in sorted(os.listdir(tmp_path / name))} for name in "xy"}
    assert files["x"] == files["y"] and len(files["x"]) > 3 and all(f.endswith(".zip") for f in files["x"])
    back = package.read_packages(spark, str(tmp_path / "x")).collect()
    assert all(r.error is None for r in back) and sorted((r.artifact, bytes(r.bytes)) for r in back) == rows
    order = [[n for n in zipfile.ZipFile(tmp_path / "x" / f).namelist() if n != package.MANIFEST] for f in files["x"]]
    assert all(n == sorted(n) for n in order)


def test_exports_that_are_refused_leave_no_package(spark, tmp_path):
    twice = spark.createDataFrame([("a", b"1"), ("a", b"2")], "artifact string, bytes binary")
    with pytest.raises(package.PackageError, match="twice"):
        package.export(twice, str(tmp_path / "t"), {})
    broken = spark.createDataFrame([("a", b"1"), ("b", b"2")], "artifact string, bytes binary").withColumn("bytes", F.when(F.col("artifact") == "b", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("bytes")))
    with pytest.raises(Exception, match="lost"):
        package.export(broken, str(tmp_path / "u"), {})
    assert not any(f.endswith(".zip") for _, _, files in os.walk(tmp_path) for f in files)
    package.export(twice.limit(0), str(tmp_path / "e"), {})
