"""Flagship: label-overlap retrieval evaluation of a vector bank.

queries = exact 10 % hash sample of the vectors (seeded), bank = the rest;
exact cosine top-``max_k`` per query, re-cut to ``k``; label cells compared per
query; one summary row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studybank.operators.metrics import query_scores, retrieval_metrics
from studybank.operators.retrieve import topk, topk_cut
from studybank.operators.splits import split_off
from studybank.plans import bindings as B

QUERY_RATIO = 0.1
SEED = 42


def roles(spark: SparkSession, sf_dir: str, ratio: float = QUERY_RATIO,
          seed: int = SEED) -> DataFrame:
    return split_off(B.vectors(spark, sf_dir), "vec_id", ratio=ratio, seed=seed)


def retrieval_topk(spark: SparkSession, sf_dir: str, max_k: int = 10) -> DataFrame:
    r = roles(spark, sf_dir)
    query = r.where(F.col("role") == "query")
    bank = r.where(F.col("role") == "bank")
    return topk(query, bank, max_k, query_key="vec_id", bank_key="vec_id",
                vec="embedding")


def evaluate(query: DataFrame, bank: DataFrame, labels: DataFrame, k: int = 2,
             max_k: int = 10, key: str = "vec_id", vec: str = "embedding",
             block_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(per-query scores, one-row metrics) for any query / bank / label tables."""
    top = topk_cut(topk(query, bank, max_k, query_key=key, bank_key=key, vec=vec,
                        block_rows=block_rows), k, max_k)
    scores = query_scores(query.select(F.col(key).alias("query_id")), top, labels, labels)
    return scores, retrieval_metrics(scores, k)


def retrieval_eval(spark: SparkSession, sf_dir: str, k: int = 2, max_k: int = 10) -> DataFrame:
    r = roles(spark, sf_dir)
    query = r.where(F.col("role") == "query")
    bank = r.where(F.col("role") == "bank")
    _, metrics = evaluate(query, bank, B.vector_labels(spark, sf_dir), k, max_k)
    return metrics
