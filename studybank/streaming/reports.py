"""Incremental labelling of newly arriving reports (Structured Streaming).

The labelling operators are per report, so a stream needs no state of its
own: every micro-batch of new reports is labelled with the batch job and its
rows are written under ``<out>/batch_id=<n>``.  A micro-batch is written beside
and replaces exactly its own folder when it is committed, so a retried batch (after
executor or driver loss) is not duplicated, no reader of ``out`` meets half of one, and the
query checkpoint in the shared folder records which files were consumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studybank.plans import labeller

REPORT_SCHEMA = "study_id string, report string"


def report_stream(spark: SparkSession, source: str, fmt: str = "parquet",
                  schema: str = REPORT_SCHEMA, max_files: int = 100) -> DataFrame:
    """Streaming DataFrame of ``(study_id, report)`` rows from new files."""
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", max_files).load(source))


def label_stream(reports: DataFrame, phrases: DataFrame, patterns: DataFrame, out: str,
                 checkpoint: str, available_now: bool = True):
    """Start the labelling query; returns the ``StreamingQuery``."""
    def each(batch: DataFrame, batch_id: int) -> None:
        rows = labeller.label_rows(batch, phrases, patterns)
        # only this batch's folder is replaced, when the whole batch is written
        (rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))

    writer = reports.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="30 seconds")
    return writer.start()
