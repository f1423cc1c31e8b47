"""The corpus pipeline: toxic documents go, one of every group of near copies stays, documents that hold
test items go, the rest is mixed by source and dealt over shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever
their names.  An empty table stays empty in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from studybank.llm import decontam, jaccard, mixing, sharding, toxicity
from studybank.llm.common import prepare, stored, table

SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels of these documents, doesn't reject.

    Null and empty texts are scored like others; repeated rows share a fate."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least doc_id, null last, then the least digest of the text.

    Texts without words (null counts as empty) are copies of equal texts only; of repeated rows one stays."""
    prepare(spark)
    return jaccard.keep_one(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item.

    A null or empty text holds none, a null or empty item is in none; repeated rows share a fate."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document is there as often as it is taken.

    A null source is one of its own; documents without words, null texts among them, are never taken; each of several
    repeated rows is taken as often as one."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row; rows that the mix repeats are rows like others, null ids and texts too."""
    prepare(spark)
    return sharding.place_documents(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_test_items),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: The stages' models and sketches have no SQL; tests/llm/test_stages.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
