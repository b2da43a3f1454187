"""Versions, lineage, integrity and idempotent writes over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical, sha256


def accepted(submissions: DataFrame) -> DataFrame:
    """Blank texts are refused."""
    return submissions.where(F.col("text").rlike(r"\S"))


def latest(rows: DataFrame, parent: str, order: str) -> DataFrame:
    """The newest row of each parent; partial maxima are taken before the shuffle."""
    cols = [c for c in rows.columns if c != parent]
    return rows.groupBy(parent).agg(F.max_by(F.struct(*cols), F.struct(order)).alias("r")).select(parent, *(F.col(f"r.{c}").alias(c) for c in cols))


def history(runs: DataFrame, imports: DataFrame, parent: str, order: str, on: str) -> DataFrame:
    """Runs newest first within their parent, with what was imported for them, if anything."""
    place = Window.partitionBy(parent).orderBy(F.desc(order))
    return runs.join(imports, on, "left").withColumn("place", F.row_number().over(place))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key).distinct(), key, "left_anti")


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def fresh(arriving: DataFrame, known: DataFrame, *key: str) -> DataFrame:
    """Insert or ignore: rows whose key is not known yet, once each."""
    return arriving.dropDuplicates(list(key)).join(known.select(*key), list(key), "left_anti")


def import_actions(arriving: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """Same id and content: nothing to do; same id and other content: conflict; else insert."""
    rows = arriving.select(key, F.col(digest).alias("new")).join(known.select(key, F.col(digest).alias("old")), key, "left")
    return rows.select(key, F.when(F.col("old").isNull(), "insert").when(F.col("old") == F.col("new"), "same").otherwise("conflict").alias("action"))


def compare_and_swap(drafts: DataFrame, updates: DataFrame) -> DataFrame:
    """drafts: id, revision, busy, state; updates: id, expected, state. An update holds if the revision is the expected
    one and nobody is busy; the table format commits the result."""
    rows = drafts.join(updates.select("id", "expected", F.col("state").alias("new")), "id", "left")
    ok = F.coalesce((F.col("revision") == F.col("expected")) & ~F.col("busy"), F.lit(False))
    return rows.select("id", (F.col("revision") + ok.cast("int")).alias("revision"), "busy", F.when(ok, F.col("new")).otherwise(F.col("state")).alias("state"), F.when(F.col("expected").isNull(), "untouched").when(ok, "swapped").otherwise("refused").alias("outcome"))


def snapshot(rows: DataFrame, *key: str) -> DataFrame:
    """A digest of each key's rows, to be compared before a commit."""
    cols = sorted(c for c in rows.columns if c not in key)
    line = canonical(F.struct(*cols))
    return rows.groupBy(*key).agg(sha256(F.array_join(F.array_sort(F.collect_list(sha256(line))), "")).alias("snapshot"))


def lineage_breaks(child: DataFrame, parent: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Children whose copy of a parent's field differs, or whose parent is missing."""
    p = parent.select(key, *(F.col(c).alias(f"parent_{c}") for c in fields), F.lit(True).alias("there"))
    rows = child.join(p, key, "left")
    differs = [F.when(~F.col(c).eqNullSafe(F.col(f"parent_{c}")), F.lit(c)) for c in fields]
    checks = F.when(F.col("there").isNull(), F.array(F.lit("parent"))).otherwise(F.filter(F.array(*differs), lambda x: x.isNotNull()))
    return rows.select(*child.columns, F.explode(checks).alias("check"))


def as_record(rows: DataFrame, *columns: str) -> DataFrame:
    """One JSON object a row: keys sorted, compact, non-ASCII literal, nulls kept."""
    return rows.select(canonical(F.struct(*sorted(columns or rows.columns))).alias("record"))


def local_time(ts: Column, zone: str = "America/Sao_Paulo", form: str = "dd/MM/yyyy HH:mm") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), form)


def steps(latest_of: DataFrame, names: list[str]) -> DataFrame:
    """latest_of: id and a ready flag for each step. A step is open if all before it are ready."""
    out, before = [], F.lit(True)
    for name in names:
        out.append(before.alias(f"{name}_open"))
        before = before & F.coalesce(F.col(name), F.lit(False))
    return latest_of.select("id", *out)


def split_run(run: DataFrame) -> tuple[DataFrame, DataFrame]:
    """run: run_id, ord, artifact_id, vector (base64). The manifest without bytes, and each artifact's bytes once."""
    manifest = run.select("run_id", "ord", "artifact_id", F.sha2(F.unbase64("vector"), 256).alias("bytes_sha256"))
    return manifest, run.select("artifact_id", F.unbase64("vector").alias("bytes")).dropDuplicates(["artifact_id"])


def read_run(manifest: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The run again; a missing artifact or changed bytes is named, not passed over."""
    rows = manifest.join(artifacts, "artifact_id", "left")
    fault = F.when(F.col("bytes").isNull(), "missing").when(F.sha2("bytes", 256) != F.col("bytes_sha256"), "changed")
    return rows.select("run_id", "ord", "artifact_id", F.base64("bytes").alias("vector"), fault.alias("fault"))


def failed_run(spark, run_id: str, reason: str) -> DataFrame:
    return spark.createDataFrame([(run_id, "failed", reason, 0)], "run_id string, status string, reason string, vectors int")


def response_format(models: DataFrame) -> DataFrame:
    """models: model, supported (array). The strictest response format a model supports."""
    has = lambda x: F.array_contains("supported", x)
    return models.select("model", F.when(has("structured_outputs"), "json_schema").when(has("response_format"), "json_object").otherwise("text").alias("format"))
