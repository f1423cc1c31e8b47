"""Dictionary mention finding, unmention filtering and assertion status.

Dictionaries (phrases, patterns) are configuration: they are read once with a
hard row bound and travel with the matching function (``operators/spans.py``),
so the whole step is map-only and linear in the text and its matches.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studybank import constants as K
from studybank.operators.spans import (
    DOCUMENT_TYPE, SPANS_TYPE, Assertion, Matcher, document_lists, span_lists)

MAX_DICTIONARY_ROWS = 100_000


def _bounded_rows(df: DataFrame, limit: int = MAX_DICTIONARY_ROWS) -> list:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"dictionary larger than {limit} rows")
    return rows


def load_phrases(lines: DataFrame, kind: str) -> DataFrame:
    """Phrase files read as ``(path, value)`` lines -> ``(observation, phrase,
    kind)``; observation = file stem with '_' -> ' ' title-cased; phrase =
    stripped line with '_' -> ' '; blank lines dropped."""
    stem = F.regexp_extract(F.col("path"), r"([^/]*?)(\.[^./]*)?$", 1)
    return lines.select(
        F.initcap(F.replace(stem, F.lit("_"), F.lit(" "))).alias("observation"),
        F.replace(F.btrim(F.col("value")), F.lit("_"), F.lit(" ")).alias("phrase"),
        F.lit(kind).alias("kind"),
    ).where(F.col("phrase") != "")


def expand_unmentions(phrases: DataFrame, merge: bool = False) -> DataFrame:
    """Add positional unmentions ("over the left heart", ...) for Cardiomegaly
    and Enlarged Cardiomediastinum; by default they *replace* the loaded
    unmentions of those two observations.  A generator over a fixed 12-item
    array, not a join."""
    positional = [p + q for p in K.UNMENTION_PREFIXES for q in K.UNMENTION_QUALIFIERS]
    pos = F.explode(F.array(*[F.lit(x) for x in positional])).alias("_pos")
    mentions = phrases.where(F.col("kind") == "mention")
    card = (mentions.where((F.col("observation") == K.CARDIOMEGALY)
                           & ~F.col("phrase").isin(*K.UNMENTION_SKIP))
            .select("observation", "phrase", pos)
            .select("observation", F.concat_ws(" ", "_pos", F.replace(
                F.col("phrase"), F.lit("the "), F.lit(""))).alias("phrase")))
    ecm = (mentions.where(F.col("observation") == K.ENLARGED_CARDIOMEDIASTINUM)
           .select("observation", "phrase", pos)
           .select("observation", F.concat_ws(" ", "_pos", "phrase").alias("phrase")))
    computed = card.unionByName(ecm).withColumn("kind", F.lit("unmention"))
    kept = phrases if merge else phrases.where(
        (F.col("kind") == "mention")
        | ~F.col("observation").isin(K.CARDIOMEGALY, K.ENLARGED_CARDIOMEDIASTINUM))
    return kept.unionByName(computed)


def _rows_of(phrases: DataFrame, *kinds: str) -> list[list[tuple[str, str]]]:
    """(observation, phrase) rows of each kind."""
    rows = _bounded_rows(phrases.select("observation", "phrase", "kind"))
    return [[(r["observation"], r["phrase"]) for r in rows if r["kind"] == kind] for kind in kinds]


def _finder(matcher: Matcher):
    return F.arrow_udf(lambda t: span_lists(t, matcher), SPANS_TYPE)


def _exploded(sentences: DataFrame, matcher: Matcher, text: str) -> DataFrame:
    return sentences.select("*", F.inline(_finder(matcher)(F.col(text))))


def phrase_spans(sentences: DataFrame, phrases: DataFrame, kind: str | tuple[str, ...] = "mention",
                 text: str = "text") -> DataFrame:
    """``(…sentence columns, observation, phrase, start, end)`` for every match
    of every phrase of ``kind`` in every sentence: ``[start, end)`` in code
    points, matches of one phrase do not overlap.  Several kinds are found in one
    pass over the sentences; each row then also has its ``kind``."""
    if isinstance(kind, str):
        return _exploded(sentences, Matcher(*_rows_of(phrases, kind)), text)
    lists = [F.transform(_finder(Matcher(rows))(F.col(text)), lambda s: s.withField("kind", F.lit(k)))
             for k, rows in zip(kind, _rows_of(phrases, *kind))]
    return sentences.select("*", F.inline(F.concat(*lists)))


def filtered_spans(sentences: DataFrame, phrases: DataFrame, text: str = "text") -> DataFrame:
    """Mention spans with unmention overlaps already removed, per sentence
    and map-side: a mention of observation *o* is dropped when it overlaps any
    unmention span of *o* in the same sentence."""
    return _exploded(sentences, Matcher(*_rows_of(phrases, "mention", "unmention")), text)


def document_mentions(docs: DataFrame, phrases: DataFrame, patterns: DataFrame,
                      text: str = "text") -> DataFrame:
    """``docs`` with ``sentences`` (texts) and ``found`` (annotated, asserted
    mentions, in ``ann_id`` order) as list columns.  Everything is computed
    within the row, so rows that share a key stay apart and nothing is shuffled."""
    matcher = Matcher(*_rows_of(phrases, "mention", "unmention"))
    assertion = Assertion([(r["role"], r["pattern"]) for r in _bounded_rows(patterns.select("role", "pattern"))])
    label = F.arrow_udf(lambda t: document_lists(t, matcher, assertion), DOCUMENT_TYPE)
    return docs.withColumn("_d", label(F.col(text))).select(*docs.columns, "_d.sentences", "_d.found")


def drop_unmentions(mentions: DataFrame, unmentions: DataFrame,
                    keys=("study_id", "sent_idx", "text")) -> DataFrame:
    """Anti-join: drop a mention whose span overlaps an unmention span of the
    same observation in the same sentence (``s < ue and e > us``).  Sentences are the
    same if their texts are, too: two reports of one study don't block each other."""
    u = unmentions.select(*keys, "observation", F.col("start").alias("_us"),
                          F.col("end").alias("_ue"))
    cond = [mentions[k] == u[k] for k in (*keys, "observation")]
    cond.append(mentions["start"] < u["_ue"])
    cond.append(mentions["end"] > u["_us"])
    return mentions.join(u, cond, "left_anti")


def assert_status(mentions: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """Status of each mention: pre-negation uncertainty, then negation, then
    post-negation uncertainty, else positive.  A pattern ``A{m}B`` fires when
    the text before the mention ends with ``A`` and the text after it starts
    with ``B``.  Adds ``status`` and ``label`` (1 / 0 / -1)."""
    assertion = Assertion([(r["role"], r["pattern"]) for r in _bounded_rows(patterns.select("role", "pattern"))])
    status = F.arrow_udf(lambda t, s, e: pa.array(
        [assertion.status(*m) for m in zip(t.to_pylist(), s.to_pylist(), e.to_pylist())], pa.string()), "string")
    out = mentions.withColumn("status", status(text, "start", "end"))
    return out.withColumn("label", F.when(F.col("status") == "negative", F.lit(K.NEGATIVE))
                          .when(F.col("status") == "uncertain", F.lit(K.UNCERTAIN))
                          .otherwise(F.lit(K.POSITIVE)).cast("int"))
