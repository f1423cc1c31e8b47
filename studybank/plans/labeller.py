"""Report labelling job: clean -> sentences -> mentions -> unmention filter ->
assertion -> label rows -> document vectors / long sentence labels.

Every step works within one report row, so the whole job is map-only and
reports that share a study id are labelled apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studybank import constants as K
from studybank.functions.text import clean_report
from studybank.operators import labels as L
from studybank.operators import mentions as M
from studybank.operators.text import split_sentences
from studybank.session import deals, spread

MENTION_COLUMNS = ("sent_idx", "offset", "observation", "phrase", "start", "end", "ann_id", "doc_offset",
                   "length", "mention", "status", "label")


def cleaned(reports: DataFrame, key: str = "study_id", col: str = "report") -> DataFrame:
    """Cleaned text per report; null reports are labelled as empty documents."""
    return reports.select(key, F.coalesce(clean_report(F.col(col)), F.lit("")).alias("text"))


def sentences(reports: DataFrame, key: str = "study_id", col: str = "report") -> DataFrame:
    return split_sentences(cleaned(spread(reports.select(key, col)), key, col), "text", key)


def annotated(reports: DataFrame, phrases: DataFrame, patterns: DataFrame,
              key: str = "study_id", col: str = "report",
              merge_unmentions: bool = False) -> DataFrame:
    """``key, report, text, sentences, found``: a row per report, its mentions as a list."""
    docs = spread(reports.select(key, F.col(col).alias("report"))).withColumn(
        "text", F.coalesce(clean_report(F.col("report")), F.lit("")))
    return M.document_mentions(docs, M.expand_unmentions(phrases, merge=merge_unmentions), patterns)


def mentions(reports: DataFrame, phrases: DataFrame, patterns: DataFrame,
             key: str = "study_id", col: str = "report",
             merge_unmentions: bool = False) -> DataFrame:
    """Annotated, asserted mentions:
    ``key, sent_idx, offset, observation, phrase, start, end, ann_id,
    doc_offset, length, mention, status, label, sentence``."""
    docs = annotated(reports, phrases, patterns, key, col, merge_unmentions)
    rows = F.transform("found", lambda m: F.struct(
        *[m[c].alias(c) for c in MENTION_COLUMNS], F.get(F.col("sentences"), m["pos"]).alias("sentence")))
    return docs.select(key, F.inline(rows))


def _label_lists(reports, phrases, patterns, key, col) -> DataFrame:
    docs = annotated(reports, phrases, patterns, key, col)
    rows = L.label_list(F.col("sentences"), F.col("found"), F.col("text"))
    return docs.select(key, "report", rows.alias("rows"))


def label_rows(reports: DataFrame, phrases: DataFrame, patterns: DataFrame,
               key: str = "study_id", col: str = "report", rules: bool = False) -> DataFrame:
    """Long label rows ``key, cat, val, sents``, with ``rules`` also the rule each row comes from."""
    docs = annotated(reports, phrases, patterns, key, col)
    # inlined as an expression: of a plain column Spark infers a filter (the list is not empty), which it moves below the
    # deal of the reports, where each scan task would do all the matching once more
    out = docs.select(key, F.inline(L.label_list(F.col("sentences"), F.col("found"), F.col("text"))))
    return out if rules else out.drop("rule")


def document_vectors(reports: DataFrame, phrases: DataFrame, patterns: DataFrame,
                     key: str = "study_id", col: str = "report",
                     categories=K.CATEGORIES) -> DataFrame:
    """One resolved vector per report row."""
    docs = _label_lists(reports, phrases, patterns, key, col)
    seen, *values = L.resolved_vector(F.col("rows"), categories)
    return docs.select(key, seen).select(key, *values)


def sentence_table(reports: DataFrame, phrases: DataFrame, patterns: DataFrame,
                   key: str = "study_id", col: str = "report") -> DataFrame:
    """``mimic_id, report, cat, vals, sents``: every report row with its label
    rows (null cat/vals/sents when it has none).

    A report stands on each of its rows, so the reports are dealt into partitions that a writer stores them in once."""
    rows = reports.select(key, col)
    rows = rows.repartition(deals(rows.select(F.octet_length(col).alias("n")), "n"))
    return (_label_lists(rows, phrases, patterns, key, col)
            .select(F.col(key).alias("mimic_id"), "report", F.inline_outer("rows"))
            .select("mimic_id", "report", "cat", F.col("val").alias("vals"), "sents"))
