"""Row-level text operators: sentence splitting, joining, token padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studybank import constants as K
from studybank.operators.spans import SENTENCES_TYPE, sentence_lists



def split_on_dot(df: DataFrame, col: str = "report", keep_order: bool = True) -> DataFrame:
    """One row per '.'-piece of ``col``; empty pieces dropped, whitespace-only
    pieces kept.  ``piece_idx`` keeps the order within the report."""
    others = [c for c in df.columns if c != col]
    out = df.select(*others, F.posexplode(F.split(F.col(col), r"\.", -1)).alias("piece_idx", col))
    out = out.where(F.length(col) > 0)
    return out if keep_order else out.drop("piece_idx")


def split_sentences(df: DataFrame, col: str = "text", key: str = "study_id") -> DataFrame:
    """``(key, sent_idx, offset, text)``: sentences of a cleaned report with
    their character offsets in it, counted within the row: rows that share a
    key stay apart, and nothing is shuffled."""
    lists = F.arrow_udf(sentence_lists, SENTENCES_TYPE)
    return df.select(key, F.inline(lists(F.col(col))))


def join_ranked(df: DataFrame, key: str, rank: str, col: str,
                sep: str = K.SENTENCE_JOIN, out: str = "joined") -> DataFrame:
    """Join ``col`` per ``key`` in ``rank`` order with ``sep``.  A group is the
    handful of rows of one key (k retrieved rows, sentences of one report)."""
    return df.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(col).alias("t")))),
        lambda x: x["t"]), sep).alias(out))


#: A word of a dictionary: a letter, then letters and marks.
WORD = r"\p{L}[\p{L}\p{M}]*"


def word_dictionary(df: DataFrame, col: str = "text", by: str = "lang", share: float = 0.0) -> DataFrame:
    """``(by, word, texts)``: every word of the whole texts of each ``by``, lower-cased, and how many texts hold it.

    ``share`` leaves out words that fewer than that part of the texts hold; it is a cut by frequency, not a rank, so no
    language is sorted in one place.  Counts are added up before their shuffle.  Null texts and a null ``by`` have no words."""
    rows = df.where(F.col(by).isNotNull() & F.col(col).isNotNull())
    words = rows.select(by, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(col)), F.lit(WORD), F.lit(0)))).alias("word"))
    found = words.groupBy(by, "word").agg(F.count(F.lit(1)).alias("texts"))
    if not share:
        return found
    total = rows.groupBy(F.col(by).alias("_by")).agg((F.count(F.lit(1)) * share).alias("_least"))
    return found.join(total, F.col(by) == F.col("_by")).where(F.col("texts") >= F.col("_least")).drop("_by", "_least")


def word_tokens(text: Column) -> Column:
    """Lower-case word tokens (the stand-in for a subword tokenizer)."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def pad_tokens(df: DataFrame, ids: str = "input_ids", batch: str = "batch_id",
               max_len: int = K.MAX_TOKENS, pad_id: int = 0) -> DataFrame:
    """Truncate ``ids`` to ``max_len`` and pad to the longest row of its batch,
    with the matching ``attention_mask``.  The batch max is a window over one
    batch (bounded by the batch size)."""
    cut = F.slice(F.col(ids), 1, max_len)
    w = Window.partitionBy(batch)
    out = df.withColumn("_ids", cut).withColumn("_w", F.max(F.size("_ids")).over(w))
    pad = F.col("_w") - F.size("_ids")
    return (out.withColumn("attention_mask", F.concat(
        F.array_repeat(F.lit(1), F.size("_ids")), F.array_repeat(F.lit(0), pad)))
        .withColumn(ids, F.concat(F.col("_ids"), F.array_repeat(F.lit(pad_id), pad)))
        .drop("_ids", "_w"))
