"""Hard-negative mining with exact integer products by Strassen's recursion.

Anchors and candidates are packed into blocks of bounded bytes, which meet on a grid.  A cell multiplies tiles of
anchors and candidates; products of 64-bit integers are split into seven smaller ones, odd sides filled
with a zero row or column, down to leaves.  Two passes over the grid: the first keeps a heap of the best candidates of
an anchor's own label, heaps of all cells are merged; the second keeps, for each score of a positive, a heap of the best
candidates of other labels whose scores lie in its window, again merged over the cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studybank.llm.blocks import PACK_BYTES, Rows, component_bytes, packed
from studybank.llm.common import stored
from studybank.llm.topk import quantised, usable

#: Bytes of components of the anchors and of the candidates of a cell.
ANCHOR_BYTES, CELL_BYTES = 1 << 24, 1 << 25
#: Anchors and candidates of a tile, and components multiplied at a time.
TILE_ANCHORS, TILE_ROWS, SLAB = 512, 4096, 1024
#: Least side that is split again.
LEAF = 64
_NONE = np.iinfo(np.int64).min


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product: in floating point where every sum is below 2^53, otherwise in integers."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), dtype=np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _even(m: np.ndarray) -> np.ndarray:
    """With a zero row and column where the sides are odd."""
    rows, cols = m.shape[0] % 2, m.shape[1] % 2
    return np.pad(m, ((0, rows), (0, cols))) if rows or cols else m


def _quarters(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    r, c = m.shape[0] // 2, m.shape[1] // 2
    return m[:r, :c], m[:r, c:], m[r:, :c], m[r:, c:]


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two int64 matrices, exact wherever the result fits (sums of parts wrap round and come back)."""
    if min(a.shape[0], a.shape[1], b.shape[1]) < LEAF:
        return _leaf(a, b)
    a11, a12, a21, a22 = _quarters(_even(a))
    b11, b12, b21, b22 = _quarters(_even(b))
    with np.errstate(over="ignore"):
        m1 = strassen(a11 + a22, b11 + b22)
        m2 = strassen(a21 + a22, b11)
        m3 = strassen(a11, b12 - b22)
        m4 = strassen(a22, b21 - b11)
        m5 = strassen(a11 + a12, b22)
        m6 = strassen(a21 - a11, b11 + b12)
        m7 = strassen(a12 - a22, b21 + b22)
        out = np.block([[m1 + m4 - m5 + m7, m3 + m5], [m2 + m4, m1 - m2 + m3 + m6]])
    return out[:a.shape[0], :b.shape[1]]


def _products(a: Rows, rows_a: np.ndarray, b: Rows, rows_b: np.ndarray) -> np.ndarray:
    """Inner products of all pairs, a slab of components at a time; rows that end before a slab don't enter it."""
    out = np.zeros((len(rows_a), len(rows_b)), dtype=np.int64)
    most = min(a.lengths[rows_a].max(initial=0), b.lengths[rows_b].max(initial=0))
    for lo in range(0, int(most), SLAB):
        i, j = np.flatnonzero(a.lengths[rows_a] > lo), np.flatnonzero(b.lengths[rows_b] > lo)
        hi = min(int(most), lo + SLAB)
        part = strassen(a.slab(rows_a[i], lo, hi), np.ascontiguousarray(b.slab(rows_b[j], lo, hi).T))
        if part.shape == out.shape:
            out += part
        else:
            out[np.ix_(i, j)] += part
    return out


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest of each row that aren't _NONE; of ties, the first columns."""
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
        above, tied = scores > kth, (scores == kth) & (kth != _NONE)
        i, j = np.nonzero(tied)
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        keep = nth < (k - above.sum(axis=1))[i]
        above[i[keep], j[keep]] = True
        return np.nonzero(above)
    return np.nonzero(scores != _NONE)


class _Heaps:
    """The k best (score, id) of each of n heaps; merging more in keeps the k best of all."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), _NONE, dtype=np.int64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)

    def merge(self, heap: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """New members (heap number, score, id)."""
        if not len(heap):
            return
        touched = np.unique(heap)
        h = np.concatenate((np.repeat(touched, self.k), heap))
        s = np.concatenate((self.scores[touched].ravel(), score))
        d = np.concatenate((self.ids[touched].ravel(), ids))
        order = np.lexsort((d, ~s, h))  # ~s falls as s rises, without overflow
        h, s, d = h[order], s[order], d[order]
        nth = np.arange(len(h)) - np.searchsorted(h, h)
        keep = nth < self.k
        self.scores[h[keep], nth[keep]], self.ids[h[keep], nth[keep]] = s[keep], d[keep]

    def members(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(heap, score, id) of all members."""
        at, nth = np.nonzero(self.scores != _NONE)
        return at, self.scores[at, nth], self.ids[at, nth]


def _tiles(rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for lo in range(0, len(rows), size):
        yield rows[lo:lo + size]


def _positives_of_cell(k: int):
    def mine(anchors: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        a, c = Rows(anchors), Rows(cands)
        heaps = _Heaps(len(a.ids), k)
        for label in np.unique(a.labels):
            rows_a = np.flatnonzero(a.labels == label)
            rows_c = np.flatnonzero(c.labels == label)
            rows_c = rows_c[np.argsort(c.ids[rows_c], kind="stable")]
            for tc in _tiles(rows_c, TILE_ROWS):
                for ta in _tiles(rows_a, TILE_ANCHORS):
                    s = _products(a, ta, c, tc)
                    s[a.ids[ta][:, None] == c.ids[tc][None]] = _NONE
                    i, j = _best(s, k)
                    heaps.merge(ta[i], s[i, j], c.ids[tc[j]])
        at, score, ids = heaps.members()
        return pd.DataFrame({"anchor_id": a.ids[at], "positive_id": ids, "positive_score": score})
    return mine


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and highest integer between ``low`` and ``high`` per cent of ``score``."""
    return -(-low * score // 100), high * score // 100


def _negatives_of_cell(k: int, low: int, high: int):
    def mine(anchors: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        a, c = Rows(anchors), Rows(cands)
        wanted = [(r, int(p), *_window(int(p), low, high)) for r, scores in enumerate(a.wants) for p in scores]
        wanted = [w for w in wanted if w[2] <= w[3]]
        heaps = _Heaps(len(wanted), k)
        row = np.array([w[0] for w in wanted], dtype=np.int64)
        least = np.array([w[2] for w in wanted], dtype=np.int64)
        most = np.array([w[3] for w in wanted], dtype=np.int64)
        by_id = np.argsort(c.ids, kind="stable")
        for tc in _tiles(by_id, TILE_ROWS):
            for ta in _tiles(np.unique(row), TILE_ANCHORS):
                s = _products(a, ta, c, tc)
                s[(a.labels[ta][:, None] == c.labels[tc][None]) | (a.ids[ta][:, None] == c.ids[tc][None])] = _NONE
                lo, hi = np.searchsorted(row, (ta[0], ta[-1] + 1))
                at = np.searchsorted(ta, row[lo:hi])
                for part in _tiles(np.arange(hi - lo), TILE_ANCHORS):
                    # a score that the heap's last member beats, or that lies beyond the window, is no member
                    floor = np.maximum(least[lo + part], heaps.scores[lo + part, k - 1])
                    one = s[at[part]]
                    one[(one < floor[:, None]) | (one > most[lo + part][:, None])] = _NONE
                    live = np.flatnonzero((one != _NONE).any(axis=1))
                    i, j = _best(one[live], k)
                    heaps.merge(lo + part[live[i]], one[live[i], j], c.ids[tc[j]])
        at, score, ids = heaps.members()
        return pd.DataFrame({"anchor_id": a.ids[row[at]], "positive_score": np.array([w[1] for w in wanted], dtype=np.int64)[at],
                             "negative_id": ids, "negative_score": score})
    return mine


def _grid(anchors: DataFrame, cands: DataFrame, cell, schema: str) -> DataFrame:
    """``cell`` applied to every block of anchors with every block of candidates."""
    spark = cands.sparkSession
    size = component_bytes(cands)
    cells = max(2 * spark.sparkContext.defaultParallelism, math.ceil(size / CELL_BYTES))
    groups = max(1, math.ceil(component_bytes(anchors) / ANCHOR_BYTES))
    pack = max(1 << 12, min(PACK_BYTES, size // (2 * cells)))
    a = packed(anchors, groups, "g", PACK_BYTES).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    c = packed(cands, cells, "c", pack).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return a.groupBy("g", "c").cogroup(c.groupBy("g", "c")).applyInPandas(cell, schema)


def _ranked(df: DataFrame, keys: list[str], score: str, ident: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), ident)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(anchors: DataFrame, vectors: DataFrame, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``anchors`` against all of
    ``vectors`` (both vec_id, embedding, label).

    Scores are inner products of floor(256 x), exact as long as they fit in a long; higher first, ties to the smaller
    vec_id.  An anchor's positives are its best ``positives`` rows of its own label.  For each, the best ``negatives`` rows of
    other labels are kept whose scores lie between ``low`` and ``high`` per cent of the positive's (none for a score
    below 0).  Rows with an anchor's own vec_id are left out.  Rows with a null vec_id, label or vector, or a
    null or non-finite component, take no part.  Missing components of a shorter (or empty) vector count as 0.  Rows equal
    in vec_id, label and components count once; of several anchors with one vec_id the least is used.  Other columns are
    ignored; empty tables give no rows."""
    def ready(df):
        usual = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
        return df.filter(usual).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
                                       quantised(F.col("embedding")).alias("q")).distinct()

    cands = stored(ready(vectors), "negatives-rows")
    asked = stored(ready(anchors).groupBy("id").agg(F.min(F.struct("q", "label")).alias("m"))
                   .select("id", "m.label", "m.q"), "negatives-anchors")
    found = _grid(asked, cands, _positives_of_cell(positives),
                  "anchor_id long, positive_id long, positive_score long")
    best = stored(_ranked(found, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "negatives-positives")
    # at most ``positives`` scores an anchor
    wants = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("wants"))
    asked = asked.join(wants, "id")
    mined = _grid(asked, cands, _negatives_of_cell(negatives, low, high),
                  "anchor_id long, positive_score long, negative_id long, negative_score long")
    mined = _ranked(mined, ["anchor_id", "positive_score"], "negative_score", "negative_id", negatives)
    return best.join(mined, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
