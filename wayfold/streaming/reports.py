"""Reports as a stream: running counts that recovery can read at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import check_report

SCHEMA = "split string, u string, y string, k_noisy int"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Transition reports from JSON files as they arrive; nothing else is read of them."""
    return check_report(spark.readStream.schema(SCHEMA).json(path))


def running_counts(reports: DataFrame) -> DataFrame:
    """Counts by split, u, y and k_noisy; the state holds a row for each, however many reports come."""
    return reports.groupBy("split", "u", "y", "k_noisy").agg(F.count("*").alias("n"))


def keep_counts(reports: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the counts after each batch of files, whole, so that a restart repeats nothing."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return running_counts(reports).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
