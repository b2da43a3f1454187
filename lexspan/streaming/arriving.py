"""An extension: documents that arrive in a stream go through preparation, segmentation and context units.

Each micro-batch is a table like any other, so the batch operators serve; a document's rows depend on it alone, so no
state is kept between batches. Batches are written under their number: a batch that runs twice replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import context, segment
from ..sources.stage import safe_unions

SCHEMA = "doc_id long, text string"


def arriving(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def units_of(docs: DataFrame) -> DataFrame:
    found = segment.periods(segment.with_periods(segment.tokens(segment.pieces(docs))))
    return context.with_digests(context.windows(found), docs)


def run(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        safe_unions(batch.sparkSession)
        units_of(batch.dropDuplicates(["doc_id"])).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
