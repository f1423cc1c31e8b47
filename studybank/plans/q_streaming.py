"""Registered streaming query: reports arrive as files and are labelled
micro-batch by micro-batch; the union of all batches equals the batch job."""

from __future__ import annotations

from pyspark.sql import functions as F

from studybank.plans import bindings as B
from studybank.plans.q_text import LABELLER
from studybank.plans.registry import register
from studybank.session import shared_dir
from studybank.streaming.reports import label_stream, report_stream


@register("stream_label_reports", LABELLER + "SELECT study_id, cat, val, sents FROM rows")
def q_stream(spark, sf_dir):
    src = shared_dir(spark, "report_stream_in")
    B.reports(spark, sf_dir).repartition(4).write.mode("overwrite").parquet(src)
    out = shared_dir(spark, "report_stream_out")
    q = label_stream(report_stream(spark, src, max_files=1), B.phrases(spark), B.patterns(spark),
                     out, shared_dir(spark, "report_stream_ckpt"))
    q.awaitTermination()
    return spark.read.parquet(out).select("study_id", "cat", F.col("val").cast("int").alias("val"),
                                          "sents")
