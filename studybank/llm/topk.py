"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Vectors are integer weights per component.  Query blocks meet candidate blocks on a grid
(each side is sent once per block of the other, packed), of bounded bytes.  In a cell of the grid,
each component is a term with a posting list of the candidates that have it, made once for a tile of
candidates; every query with the term scatters its weighted postings into dense score arrays, which are
all that is dense.  A partition of the scores selects the cell's k best, and one window merges the cells.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studybank.llm.blocks import PACK_BYTES, Rows, component_bytes, packed
from studybank.llm.common import stored

#: Bytes of components of the queries and of the candidates that meet in one cell of the grid.
QUERY_BYTES, CELL_BYTES = 1 << 23, 1 << 25
#: Scores held at a time: queries by candidates.
TILE_QUERIES, TILE_ROWS = 128, 2048
_NONE = np.iinfo(np.int64).min


def usable(vec: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(odd, F.lit(False))


def quantised(vec: Column) -> Column:
    """floor(256 x) of each component, computed in double."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * 256).cast("long"))


class Postings:
    """Posting lists of some rows: for each term, the rows that have it (numbered from 0) and their weights."""

    def __init__(self, rows: Rows, which: np.ndarray):
        size = rows.lengths[which]
        row = np.repeat(np.arange(len(which)), size)
        term = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        weight = rows.parts[np.repeat(rows.first[which], size) + term].astype(np.int64)
        some = np.flatnonzero(weight)
        order = some[np.argsort(term[some], kind="stable")]
        self.size = len(which)
        self.row, self.weight = row[order], weight[order]
        self.terms, first = np.unique(term[order], return_index=True)
        self.first = np.append(first, len(order))

    def of(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        return self.row[self.first[at]:self.first[at + 1]], self.weight[self.first[at]:self.first[at + 1]]


def accumulate(queries: Postings, cands: Postings) -> np.ndarray:
    """Score of every candidate for every query, term at a time."""
    acc = np.zeros((queries.size, cands.size), dtype=np.int64)
    _, mine, theirs = np.intersect1d(queries.terms, cands.terms, assume_unique=True, return_indices=True)
    for i, j in zip(mine, theirs):
        (has, own), (posting, other) = queries.of(i), cands.of(j)
        weighted = np.multiply.outer(own, other)
        if weighted.shape == acc.shape:
            acc += weighted
        else:
            acc[np.ix_(has, posting)] += weighted
    return acc


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    at = at[scores[at] != _NONE]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _cell(k: int):
    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found: list[list] = [[], [], []]
        if len(q) and len(c):
            queries, cands = Rows(q), Rows(c)
            order = np.argsort(cands.ids, kind="stable")
            c_ids = cands.ids[order]
            asked = [np.arange(i, min(i + TILE_QUERIES, len(queries.ids))) for i in range(0, len(queries.ids), TILE_QUERIES)]
            terms = [Postings(queries, rows) for rows in asked]
            kept: list[list] = [[] for _ in queries.ids]
            for j in range(0, len(c_ids), TILE_ROWS):
                ids, postings = c_ids[j:j + TILE_ROWS], Postings(cands, order[j:j + TILE_ROWS])
                for rows, own in zip(asked, terms):
                    acc = accumulate(own, postings)
                    acc[queries.ids[rows, None] == ids[None]] = _NONE
                    for r, row in zip(rows, acc):
                        at = _best(row, ids, k)
                        kept[r].append((ids[at], row[at]))
            for r, parts in enumerate(kept):
                ids, scores = (np.concatenate(x) for x in zip(*parts))
                at = _best(scores, ids, k)
                found[0].append(np.full(len(at), queries.ids[r]))
                found[1].append(ids[at])
                found[2].append(scores[at])
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
        return pd.DataFrame({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})
    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k best rows of ``vectors`` for each row of ``queries`` (both vec_id, embedding).

    query_id, rank from 1, vec_id, score: the integer inner product of the quantised vectors,
    ties to the smaller vec_id.  Rows with the query's own vec_id are left out.
    Vectors that are null or hold a null or non-finite component, and rows with null vec_id, take no
    part; missing components of a shorter (or empty) vector count as 0.  Repeated rows of
    ``vectors`` are candidates each; of queries with one vec_id the least vector is used.
    Other columns are ignored."""
    spark = vectors.sparkSession

    def ready(df):
        return df.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
            F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("q"))

    asked = ready(queries).groupBy("id").agg(F.min("q").alias("q"))
    asked, every = stored(asked, "topk-queries"), ready(vectors)
    size = component_bytes(every)
    cells = max(2 * spark.sparkContext.defaultParallelism, math.ceil(size / CELL_BYTES))
    groups = max(1, math.ceil(component_bytes(asked) / QUERY_BYTES))
    pack = max(1 << 12, min(PACK_BYTES, size // (2 * cells)))
    qs = packed(asked, groups, "g", PACK_BYTES).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    cs = packed(every, cells, "c", pack).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    best = (qs.groupBy("g", "c").cogroup(cs.groupBy("g", "c"))
            .applyInPandas(_cell(k), "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
