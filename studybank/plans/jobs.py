"""The pipeline's jobs from files to files: sectioning, pairing and splitting, cutting bank and queries, embedding the bank.

Each reads its inputs with the library's readers and writes its outputs with its writers; nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studybank.operators import encode, labels, sections, splits
from studybank.operators.text import split_on_dot
from studybank.session import cut_lineage
from studybank.sources import readers, writers


def section_reports(reports: DataFrame, overrides: DataFrame, concat: bool = False) -> DataFrame:
    """``(study_id, report)``: the passage of each report (study_id, text) that stands for it.

    The last section of the first name that occurs of impression, findings, last paragraph and comparison; with ``concat``
    the first three in that order, one after the other.  Studies with an override take its slice or section instead (left out
    with ``concat``, as they have no sections to join).

    Reports without an override are read and split once; the others, which the overrides' steps read again and again, are
    put by as they are found."""
    if concat:
        parts = sections.split_sections(reports)
        own = reports.join(overrides.select("study_id"), "study_id", "left_anti").select("study_id")
        made = sections.concat_sections(parts, names=("impression", "findings", "last_paragraph"))
        return own.join(made, "study_id", "left").select("study_id", F.coalesce("report", F.lit("")).alias("report"))
    keys = overrides.select("study_id")
    plain = sections.pick_section(sections.split_sections(reports.join(keys, "study_id", "left_anti")))
    own = cut_lineage(reports.join(keys, "study_id", "left_semi"), "overridden")
    changed = sections.apply_overrides(own, sections.split_sections(own), overrides).select("study_id", "report")
    return plain.unionByName(changed).select("study_id", F.coalesce("report", F.lit("")).alias("report"))


def create_section_files(spark: SparkSession, tree: str, out: str, overrides: DataFrame | None = None, concat: bool = False,
                         no_split: bool = False, max_rows: int = 10_000) -> None:
    """Report tree -> headerless ``(study_id, report)`` CSV files of at most ``max_rows`` rows (one file with ``no_split``)."""
    reports = readers.read_report_tree(spark, tree).select("study_id", "text")
    rows = section_reports(reports, sections.overrides_table(spark) if overrides is None else overrides, concat)
    writers.write_sectioned(rows, out, max_rows=max_rows, single=no_split)


def get_subset(images: DataFrame, reports: DataFrame, out: str, subset: float = 1.0, train: float = 0.9, test: float = 0.5,
               seed: int = 42) -> DataFrame:
    """Images (study_id, path) and reports (study_id, report) paired by study, cut into train, test and val by study and
    written as one table partitioned by split; the studies and rows of each split.  No study is in two of them."""
    rows = splits.study_split(labels.pair_studies(images, reports), "study_id", subset, train, test, seed)
    writers.write_splits(rows.select("study_id", "path", "report", "split"), out)
    return splits.split_counts(images.sparkSession.read.parquet(out))


def bank_query_split(rows: DataFrame, bank_ratio: float, query_ratio: float, key: str, seed: int = 42) -> DataFrame:
    """``rows`` with a ``role``: an exact sample of ``bank_ratio`` of train and val is the bank, one of ``query_ratio`` of test the
    queries; rows of neither sample are left out.  ``key`` tells rows apart."""
    bank = splits.exact_sample(rows.where(F.col("split").isin("train", "val")), key, ratio=bank_ratio, seed=seed)
    query = splits.exact_sample(rows.where(F.col("split") == "test"), key, ratio=query_ratio, seed=seed)
    return bank.withColumn("role", F.lit("bank")).unionByName(query.withColumn("role", F.lit("query")))


def bank_texts(rows: DataFrame, long: DataFrame | None = None, sentences: bool = False) -> DataFrame:
    """``(study_id, target)``: the distinct texts of (study_id, report) that are embedded; null reports are left out.

    With ``long`` (sentence labels) a study's labelled sentences take the place of its report; ``sentences`` cuts texts at
    full stops.  Line breaks are deleted."""
    texts = rows.select("study_id", "report").dropna().distinct()
    if long is not None:
        texts = labels.expand_sentences(texts, long)
    if sentences:
        texts = split_on_dot(texts, "report", keep_order=False)
    return texts.select("study_id", F.translate("report", "\n\r", "").alias("target"))


def embed_bank(rows: DataFrame, configs: DataFrame | list, out: str, decode: Callable[[DataFrame], DataFrame] | None = None,
               long: DataFrame | None = None, max_rows: int = 50_000, registry=None) -> None:
    """Text side (and with ``decode``, which gives (study_id, target, image) of rows, the image side) of every model of a config
    over ``rows`` (study_id, path, report), written as embedding batches (study_id, target, embs) by case and side."""
    spark = rows.sparkSession
    keys = ["study_id", "target"]
    texts = bank_texts(rows, long).withColumn("report", F.col("target"))
    embs = encode.embed_models(texts, encode.models(spark, configs, "text", registry), "report", keys, "text")
    if decode is not None:
        embs = embs.unionByName(encode.embed_models(decode(rows), encode.models(spark, configs, "image", registry), "image", keys, "image"))
    writers.write_embeddings(embs, out, max_rows=max_rows)
