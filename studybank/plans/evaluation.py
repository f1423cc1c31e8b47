"""Evaluation of retrieval from an embedding bank, as one job.

queries = exact sample of the query table; bank rows with the same text count once (within a batch or overall);
exact cosine top-``max_k``, re-cut to ``k``; label cells of queries and retrieved rows at study or sentence
level; per-query scores, BLEU of the retrieved texts against the query's report, and one metrics row with the columns
that name the run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studybank.operators.labels import attach_report, label_cells
from studybank.operators.metrics import query_scores, retrieval_metrics, retrieved_bleu, retrieved_texts
from studybank.operators.retrieve import dedupe_bank, topk, topk_cut
from studybank.operators.splits import exact_sample
from studybank.session import cut_lineage


@dataclass(frozen=True)
class Run:
    """What a row of the metrics history is about: where bank and queries come from, and how queries were sampled."""

    bank: str
    query: str
    test_size: int = 50
    random_state: int = 0


@dataclass(frozen=True)
class Evaluation:
    """One evaluation: the retrieved rows, a row of scores a query, and the metrics row."""

    top: DataFrame
    scores: DataFrame
    metrics: DataFrame


def evaluate(queries: DataFrame, bank: DataFrame, long: DataFrame, run: Run, *, k: int = 2, max_k: int = 10,
             query_level: str = "study", bank_level: str = "sentence", unique_text: str | None = "batch",
             bleu: bool = False) -> Evaluation:
    """``queries``: (query_id, study_id, target, embs); ``bank``: (bank_id, batch_id, pos, study_id, target, embs);
    ``long``: sentence labels (mimic_id, report, cat, vals, sents).

    ``unique_text``: a text counts once in its ``batch``, once overall (``global``), or as often as it occurs
    (None); the first row by (batch_id, pos) stands for it.  A level says whether a row has its study's labels or its own
    sentence's; either is the highest value of each category.  A study with several reports is compared to the least."""
    # sample, result and retrieved rows are small and used several times: each is written once
    asked = cut_lineage(exact_sample(queries, "query_id", n=run.test_size, seed=run.random_state), "eval-queries")
    searched = dedupe_bank(bank, "target", unique_text, "batch_id") if unique_text else bank
    top = cut_lineage(topk_cut(topk(asked, searched, max_k), k, max_k), "eval-top")
    held = top.select("bank_id").distinct()
    rows = cut_lineage(bank.select("bank_id", "study_id", "target").join(held, "bank_id", "left_semi"), "eval-rows")
    scores = query_scores(asked, top, label_cells(asked, long, query_level, "query_id"),
                          label_cells(rows, long, bank_level, "bank_id"))
    if bleu:
        reports = attach_report(asked.select("query_id", "study_id"), long)
        scores = scores.join(retrieved_bleu(reports, retrieved_texts(top, rows)), "query_id", "left").withColumn(
            "bleu", F.when(F.col("status") == "evaluated", F.col("bleu")))
    about = [F.lit(run.bank).alias("bank"), F.lit(run.query).alias("query"), F.lit(run.test_size).alias("test_size"),
             F.lit(run.random_state).alias("random_state")]
    return Evaluation(top, scores, retrieval_metrics(scores, k).select("*", *about))
