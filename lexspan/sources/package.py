"""Portable packages of vector runs: reproducible ZIP files, and a reader that trusts nothing in them."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators import scan

# Limits of a package.
ZIP_BYTES, MEMBER_BYTES, TOTAL_BYTES, DEPTH = 64 << 20, 96 << 20, 128 << 20, 64
MANIFEST, VECTORS = "manifest.json", "vectors/"
STAMP = (1980, 1, 1, 0, 0, 0)


class PackageError(ValueError):
    """The package is refused; nothing of it is used."""


def strict_json(raw: bytes):
    """JSON without repeated keys, non-finite numbers or deep nesting."""

    def pairs(items):
        if len({k for k, _ in items}) < len(items):
            raise PackageError("repeated key")
        return dict(items)

    def refuse(name):
        raise PackageError(f"not a number: {name}")

    depth = most = 0
    inside = escaped = False
    for c in raw.decode("utf-8"):
        if inside:
            inside, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            inside = True
        else:
            depth += (c in "[{") - (c in "]}")
            most = max(most, depth)
    if most > DEPTH:
        raise PackageError("nested too deeply")
    try:
        return json.loads(raw, object_pairs_hook=pairs, parse_constant=refuse)
    except ValueError as e:
        raise PackageError(str(e)) from e


def write(vectors: dict[str, bytes], meta: dict) -> bytes:
    """Sorted members, a fixed time and stored bytes: equal content gives equal packages."""
    files = {f"{VECTORS}{i:06d}.float32.bin": (k, vectors[k]) for i, k in enumerate(sorted(vectors))}
    listed = [{"artifact": k, "bytes": len(b), "path": path, "sha256": hashlib.sha256(b).hexdigest()} for path, (k, b) in files.items()]
    manifest = json.dumps({"files": listed, "meta": meta}, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for path, raw in sorted({MANIFEST: manifest, **{p: b for p, (_, b) in files.items()}}.items()):
            z.writestr(zipfile.ZipInfo(path, STAMP), raw)
    return out.getvalue()


#: Bytes that a package holds at most beside its members' own: names, digests and headers of each.
BESIDE = 512


def _folder(path: str):
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class PackageWriter(DataSourceWriter):
    """Each task writes whole packages beside their place; the commit moves them there by name."""

    def __init__(self, path: str, meta: str):
        self.path, self.meta, self.beside = path, meta, f"_beside-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, folder = _folder(self.path)
        names, meta = [], json.loads(self.meta)
        for number, members in groupby(rows, key=lambda r: r["package"]):
            # One package is held at a time: its size is bounded when the members are dealt.
            raw = write({r["artifact"]: bytes(r["bytes"]) for r in members}, {**meta, "package": number})
            if len(raw) > ZIP_BYTES:
                raise PackageError("package too large")
            name = f"package-{number:08d}.zip"
            system.create_dir(f"{folder}/{self.beside}", recursive=True)
            # A task that runs twice writes under another name each time.
            made = f"{self.beside}/{uuid.uuid4().hex}-{name}"
            with system.open_output_stream(f"{folder}/{made}") as out:
                out.write(raw)
            names.append(made)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _folder(self.path)
        for message in messages:
            for made in message.names if message else []:
                system.move(f"{folder}/{made}", f"{folder}/{made.rpartition('/')[2].partition('-')[2]}")
        self._clear(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_folder(self.path))

    def _clear(self, system, folder: str) -> None:
        if system.get_file_info(f"{folder}/{self.beside}").type != pyarrow.fs.FileType.NotFound:
            system.delete_dir(f"{folder}/{self.beside}")


class Packages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_packages"

    def schema(self) -> str:
        return "package long, artifact string, bytes binary"

    def writer(self, schema, overwrite: bool) -> PackageWriter:
        return PackageWriter(self.options["path"], self.options.get("meta", "{}"))


def export(artifacts: DataFrame, path: str, meta: dict, room: int = ZIP_BYTES // 2) -> None:
    """artifacts: artifact (unique), bytes. Packages of about `room` bytes in order of the artifacts' names, each written by
    the task that holds its members; no bytes pass the driver, and equal artifacts give equal packages. An artifact that
    would fill more than half a package is refused, and so is one that comes twice."""
    spark = artifacts.sparkSession
    size = F.octet_length("bytes") + F.octet_length("artifact") + BESIDE
    checked = F.when(size <= ZIP_BYTES // 2, size).otherwise(F.raise_error(F.concat(F.lit("artifact too large: "), "artifact")).cast("int"))
    sized = artifacts.select("artifact", checked.cast("long").alias("size"))
    if sized.groupBy("artifact").count().where("count > 1").limit(1).count():
        raise PackageError("an artifact comes twice")
    placed = scan.running(sized, [F.col("artifact")], {"upto": "size"}).select("artifact", F.floor((F.col("upto") - 1) / room).alias("package"))
    rows = artifacts.select("artifact", "bytes").join(placed, "artifact").repartition("package").sortWithinPartitions("package", "artifact")
    spark.dataSource.register(Packages)
    rows.select("package", "artifact", "bytes").write.format("vector_packages").option("meta", json.dumps(meta)).mode("append").save(path)


def _inflated(z: zipfile.ZipFile, info: zipfile.ZipInfo, raw: bytes) -> bytes:
    """A member's bytes, inflated no further than the size that it declares."""
    at = info.header_offset
    if raw[at : at + 4] != b"PK\x03\x04":
        raise PackageError("no local header")
    name, extra = struct.unpack("<HH", raw[at + 26 : at + 30])
    data = raw[at + 30 + name + extra : at + 30 + name + extra + info.compress_size]
    if info.compress_type == zipfile.ZIP_STORED:
        out = data
    elif info.compress_type == zipfile.ZIP_DEFLATED:
        inflate = zlib.decompressobj(-15)
        try:
            out = inflate.decompress(data, info.file_size + 1)
        except zlib.error as e:
            raise PackageError("damaged member") from e
    else:
        raise PackageError("unknown compression")
    if len(out) != info.file_size or zlib.crc32(out) != info.CRC:
        raise PackageError("a member's size or checksum differs from what it declares")
    return out


def read(raw: bytes) -> tuple[dict, dict[str, bytes]]:
    """(meta, vectors by artifact). Names, sizes, digests and the set of members must be those that the manifest lists."""
    if len(raw) > ZIP_BYTES:
        raise PackageError("package too large")
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except (zipfile.BadZipFile, ValueError, OSError) as e:
        raise PackageError("not a package") from e
    infos = z.infolist()
    names = [i.filename for i in infos]
    allowed = all(n == MANIFEST or (n.startswith(VECTORS) and n.endswith(".float32.bin") and "/" not in n[len(VECTORS) :] and ".." not in n) for n in names)
    if len(set(names)) < len(names) or MANIFEST not in names or not allowed or any(i.flag_bits & 1 for i in infos):
        raise PackageError("members are repeated, missing, encrypted or not allowed")
    if any(i.file_size > MEMBER_BYTES for i in infos) or sum(i.file_size for i in infos) > TOTAL_BYTES:
        raise PackageError("members too large")
    data = {i.filename: _inflated(z, i, raw) for i in infos}
    manifest = strict_json(data.pop(MANIFEST))
    if not isinstance(manifest, dict) or set(manifest) != {"files", "meta"} or not isinstance(manifest["files"], list):
        raise PackageError("unknown manifest")
    out = {}
    for f in manifest["files"]:
        if not isinstance(f, dict) or set(f) != {"artifact", "bytes", "path", "sha256"} or f["path"] not in data:
            raise PackageError("the manifest names another file")
        b = data.pop(f["path"])
        if len(b) != f["bytes"] or hashlib.sha256(b).hexdigest() != f["sha256"]:
            raise PackageError("a file differs from its digest")
        out[f["artifact"]] = b
    if data:
        raise PackageError("a file is not listed")
    return manifest["meta"], out


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(path, artifact, bytes, error): packages under a path, each parsed in a task; a refused one gives its reason."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(name, k, b, None) for k, b in read(content)[1].items()]
                except PackageError as e:
                    rows.append((name, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "artifact", "bytes", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInPandas(parse, "path string, artifact string, bytes binary, error string")
