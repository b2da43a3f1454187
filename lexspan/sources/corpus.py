"""Corpus folders: a manifest, fragments as JSON lines, and their vectors as a float32 matrix.

No file is read as one row. Lines are read in Spark's own byte ranges, each numbered inside its range; the ranges' counts,
added up in file order, give the lines of the whole folder their numbers. The matrix is read by ranges of rows, each task
seeking to its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import scan
from .package import strict_json

FRAGMENT = "frag string, block string, work string, volume int, section string, frag_no int, start_pos long, end_pos long, pages array<int>, text string, header string, sha256 string"
#: Byte ranges up to this number are broadcast: three numbers and a name each.
FEW = 100_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, line) of a file, or of a folder's files in the order of their names. Rows count from 0 over all files."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    ranges = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    placed = scan.running(ranges, [F.col("file"), F.col("block")], {"upto": "n"}).select("file", "block", "first", (F.col("upto") - F.col("n")).alias("before"))
    placed = F.broadcast(placed) if placed.count() <= FEW else placed
    return raw.join(placed, ["file", "block"]).select((F.col("before") + F.col("id") - F.col("first")).alias("row"), "line")


def _opened(path: str):
    system, inner = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system.open_input_file(inner)


def _header(file) -> tuple[tuple[int, ...], np.dtype, bool, int]:
    """Shape, type, column order and where the numbers begin."""
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, kind = read(file)
    return shape, kind, by_column, file.tell()


class Rows(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def _checked(self, file) -> tuple[int, int, int]:
        shape, kind, by_column, at = _header(file)
        if kind != np.dtype("<f4") or len(shape) != 2 or by_column:
            raise ValueError(f"the matrix holds {kind} {shape}, not rows of float32")
        if file.size() != at + 4 * shape[0] * shape[1]:
            raise ValueError("the matrix is cut short or goes on behind its last row")
        return shape[0], shape[1], at

    def partitions(self) -> list[InputPartition]:
        with _opened(self.path) as file:
            rows, dims, _ = self._checked(file)
        step = max(1, self.range_bytes // (4 * max(dims, 1)))
        return [Rows(k, min(k + step, rows)) for k in range(0, rows, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with _opened(self.path) as file:
            _, dims, at = self._checked(file)
            some = max(1, (1 << 20) // (4 * max(dims, 1)))
            for k in range(partition.begin, partition.end, some):
                n = min(some, partition.end - k)
                values = np.frombuffer(file.read_at(4 * n * dims, at + 4 * k * dims), "<f4")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dims + 1, dims, dtype=np.int32) if dims else np.zeros(n + 1, np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + n)), lists], names=["row", "v"])


class Matrix(DataSource):
    """Rows of a float32 matrix in one .npy file. Option range_bytes: how much of it a task reads."""

    @classmethod
    def name(cls) -> str:
        return "float32_matrix"

    def schema(self) -> str:
        return "row long, v array<float>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options.get("range_bytes", 64 << 20)))


def matrix(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """(row, v)."""
    spark.dataSource.register(Matrix)
    return spark.read.format("float32_matrix").option("range_bytes", range_bytes).load(path)


def corpus(spark: SparkSession, folder: str, range_bytes: int = 64 << 20) -> tuple[dict, DataFrame, DataFrame]:
    """A corpus folder: manifest.json (fragments, blocks, dims, references, vectors: the two file names), fragments as JSON
    lines and their vectors as a float32 matrix in one .npy file. (manifest, fragments with row, vectors as row and v);
    row i of the matrix belongs to line i, by number and never by the order of a table. Another count, type or shape than
    the manifest's is an error, and so is a blank line or one that does not fit the schema."""
    raw = {r["path"].rsplit("/", 1)[-1]: r["content"] for r in spark.read.format("binaryFile").load(f"{folder}/manifest.json").collect()}
    manifest = strict_json(bytes(raw["manifest.json"]))
    for key in ("references", "vectors"):
        name = manifest.get(key)
        if not isinstance(name, str) or "/" in name or name in ("", ".", ".."):
            raise ValueError(f"{key} names no file of the folder")
    lines = numbered_lines(spark, f"{folder}/{manifest['references']}")
    line = F.when(F.col("line").rlike(r"\S"), F.col("line")).otherwise(F.raise_error(F.concat(F.lit("blank line "), F.col("row").cast("string"))).cast("string"))
    fragments = lines.select("row", F.from_json(line, FRAGMENT + ", entry_sha256 string", {"mode": "FAILFAST"}).alias("f")).select("row", "f.*")
    dims, rows = manifest["dims"], manifest["fragments"]
    vectors = matrix(spark, f"{folder}/{manifest['vectors']}", range_bytes)
    wrong = F.concat(F.lit("the matrix holds float32 rows of "), F.size("v").cast("string"), F.lit(f" numbers, the manifest says {rows} of {dims}"))
    vectors = vectors.select("row", F.when((F.size("v") == dims) & (F.col("row") < rows), F.col("v")).otherwise(F.raise_error(wrong).cast("array<float>")).alias("v"))
    found, held = fragments.agg(F.count("*").alias("n"), F.count_distinct("block").alias("b")).first(), vectors.select("row").count()
    if (found["n"], found["b"]) != (rows, manifest["blocks"]):
        raise ValueError(f"{found['n']} fragments in {found['b']} blocks, the manifest says {rows} in {manifest['blocks']}")
    if held != rows:
        raise ValueError(f"the matrix holds {held} float32 rows, the manifest says {rows}")
    return manifest, fragments, vectors
