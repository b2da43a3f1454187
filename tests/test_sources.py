import io
import json
import zipfile

import pytest

from lexspan.sources import package, text
from lexspan.streaming import arriving


def test_literal_files_keep_line_ends(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿um\r\ndois\rtrês".encode())
    assert text.literal_files(spark, str(tmp_path)).first().text == "﻿um\r\ndois\rtrês"
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xff")
    with pytest.raises(Exception, match="not UTF-8"):
        text.literal_files(spark, str(tmp_path)).collect()


def test_append_refuses_known_keys(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id int, x string")
    text.append(rows, str(tmp_path / "t"), ["id"])
    with pytest.raises(ValueError):
        text.append(rows, str(tmp_path / "t"), ["id"])
    with pytest.raises(ValueError):
        text.append(rows.union(rows), str(tmp_path / "u"), ["id"])


def test_tables_have_clean_cells(spark, tmp_path):
    text.write_table(spark.createDataFrame([("a\tb\nc",)], "x string"), str(tmp_path / "t"))
    assert "".join(p.read_text() for p in (tmp_path / "t").glob("*.csv")).replace("x\n", "") == "a b c\n"


def test_package_round_trip(spark, tmp_path):
    raw = package.write({"b": b"2222", "a": b"1111"}, {"run": 1})
    assert raw == package.write({"a": b"1111", "b": b"2222"}, {"run": 1})
    assert package.read(raw) == ({"run": 1}, {"a": b"1111", "b": b"2222"})
    (tmp_path / "good.zip").write_bytes(raw)
    (tmp_path / "bad.zip").write_bytes(raw[:-10])
    got = {(r.artifact, bytes(r.bytes or b""), r.error is None) for r in package.read_packages(spark, str(tmp_path)).collect()}
    assert got == {("a", b"1111", True), ("b", b"2222", True), (None, b"", False)}


def changed(raw: bytes, edit) -> bytes:
    files = {i.filename: zipfile.ZipFile(io.BytesIO(raw)).read(i) for i in zipfile.ZipFile(io.BytesIO(raw)).infolist()}
    edit(files)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


@pytest.mark.parametrize(
    "edit",
    [
        lambda f: f.update({"vectors/000000.float32.bin": b"xxxx"}),
        lambda f: f.update({"../evil": b"x"}),
        lambda f: f.update({"vectors/../x.float32.bin": b"x"}),
        lambda f: f.update({"vectors/000009.float32.bin": b"x"}),
        lambda f: f.pop("manifest.json"),
        lambda f: f.update({"manifest.json": b'{"files":[],"files":[],"meta":{}}'}),
        lambda f: f.update({"manifest.json": b'{"files":[],"meta":NaN}'}),
        lambda f: f.update({"manifest.json": b"[" * 100 + b"]" * 100}),
    ],
)
def test_hostile_packages(edit):
    with pytest.raises(package.PackageError):
        package.read(changed(package.write({"a": b"1111"}, {}), edit))


def test_arriving_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(json.dumps({"doc_id": 1, "text": "Um sai. Dois vêm."}))
    for _ in range(2):
        arriving.run(arriving.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
