"""Benchmark decontamination: shared word pairs as seeds, then Smith-Waterman alignment.

An alignment of score 2 * m - e (m words matched, e edits) has at most e + 1 runs of matched words, so one that
reaches the threshold t of an item of L words shares at least (2 * t - 1) * L - 1 word pairs with it, and its
edits shift it by at most 2 * (1 - t) * L words.  Places of a document that share so many pairs with an item
are aligned with it word by word, no other can hold a copy; the best local
alignment's score, against that of the item with itself, tells edited copies from chance.
The documents are never shuffled: the test items come to them, a block of bounded size at a time.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studybank.llm.common import HashSet, distinct, shingle_hashes, word_hashes

#: Words of the shortest item that may be edited; shorter ones must be held as they are.
MIN_WORDS = 8
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of the item's own score.
THRESHOLD = 0.6
#: UTF-8 bytes of the test items that are sent to all tasks at a time.
BLOCK_BYTES = 32 << 20
#: Cells of alignments, and matches of seeds (more if one document has more), held at a time.
CELLS, MATCHES = 1 << 21, 1 << 20

HITS = "array<struct<item_id:bigint,score:double,start_word:int,end_word:int>>"


class Items:
    """A block of test items: words, seeds sorted by hash, and how many seeds a copy shares at least.

    Seeds are all word pairs, or all words where a copy needn't share a pair."""

    def __init__(self, ids: list[int], texts: list[str], threshold: float = THRESHOLD):
        h, doc, _, _ = word_hashes(texts)
        cut = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.ids = ids
        self.words = [h[a:b] for a, b in zip(cut, cut[1:])]
        length = np.diff(cut)
        self.bar = np.where(length < MIN_WORDS, 1.0, threshold)
        pairs = np.ceil((2 * self.bar - 1) * length - 1 - 1e-9).astype(np.int64)
        size = np.where(pairs > 0, 2, 1)
        self.need = np.where(pairs > 0, pairs, np.maximum(1, np.ceil(self.bar * length - 1e-9).astype(np.int64)))
        #: Words by which leads of one copy can differ, and at least the item's own.
        self.unit = np.maximum(length, np.ceil(2 * (1 - self.bar) * length).astype(np.int64))
        self.sizes = [int(n) for n in np.unique(size[length > 0])]
        found = []
        for n in self.sizes:
            gram, of, at = shingle_hashes(h, doc, n)
            own = size[of] == n
            found.append((gram[own], of[own], at[own] - cut[of[own]]))
        none = np.zeros(0, dtype=np.int64)
        found.append((none.view(np.uint64), none, none))
        self.put(*(np.concatenate(x) for x in zip(*found)))

    def put(self, gram: np.ndarray, of: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(gram, kind="stable")
        self.gram, self.of, self.at = gram[order], of[order], at[order]
        self.set = HashSet(self.gram)

    def grams(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """N-grams of texts of the sizes of the seeds: (hash, text number, first word)."""
        found = [shingle_hashes(h, doc, n) for n in self.sizes] or [shingle_hashes(h[:0], doc[:0], 1)]
        return tuple(np.concatenate(x) for x in zip(*found))

    def drop_frequent(self, seen: dict[int, int]) -> None:
        """Leave out seeds that no document has, and the most frequent ones of an item, up to half of those that a copy
        shares beyond one; it then shares as many less.  ``seen``: documents with each n-gram."""
        n = np.array([seen.get(int(g), 0) for g in self.gram.view(np.int64)], dtype=np.int64)
        order = np.lexsort((self.at, -n, self.of))
        of = self.of[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        often = (rank < (self.need[of] - 1) // 2) & (n[order] > 0)
        kept = order[~often & (n[order] > 0)]
        self.need = self.need - np.bincount(of[often], minlength=len(self.need))
        self.put(self.gram[kept], self.of[kept], self.at[kept])

    def occurrences(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``gram``, seed) of every match."""
        lo = np.searchsorted(self.gram, gram, side="left")
        n = np.searchsorted(self.gram, gram, side="right") - lo
        at = np.repeat(np.arange(len(gram)), n)
        return at, lo[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of ``item`` in each row of ``windows``: score, and end (a place after the last word).

    Smith-Waterman with linear gaps, a row of the matrix at a time; gaps along the row are a
    running maximum."""
    slope = np.arange(windows.shape[1], dtype=np.int32) * -GAP
    before = np.zeros((len(windows), windows.shape[1] + 1), dtype=np.int32)
    best, end = np.zeros(len(windows), dtype=np.int32), np.zeros(len(windows), dtype=np.int64)
    for w in item:
        row = before[:, :-1] + np.where(windows == w, np.int32(MATCH), np.int32(MISMATCH))
        np.maximum(row, before[:, 1:] + np.int32(GAP), out=row)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        top = row.argmax(axis=1)
        value = row[np.arange(len(row)), top]
        better = value > best
        best[better], end[better] = value[better], top[better] + 1
        before[:, 1:] = row
    return best, end


def _windows(items: Items, first: np.ndarray, last: np.ndarray, doc, gram, at):
    """Distinct (item, document, start, end) around places with enough seeds, in words of the batch, by item."""
    place, seed = items.occurrences(gram)
    item, d = items.of[seed], doc[place]
    unit = items.unit[item]
    lead = at[place] - first[d] - items.at[seed]  # where the item would begin in the text
    # all seeds of one copy have leads in two neighbouring steps; every word of the item counts once in a step
    step = np.floor_divide(lead, unit)
    order = np.lexsort((items.at[seed], step, d, item))
    rows = np.stack([item, d, step, items.at[seed]])[:, order]
    rows = rows[:, np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)))] if rows.shape[1] else rows
    new = np.flatnonzero(np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)))) if rows.shape[1] else rows[0]
    count = np.diff(np.concatenate((new, [rows.shape[1]])))
    item, d, step = rows[:3, new]
    if len(new) > 1:
        next_to = (item[1:] == item[:-1]) & (d[1:] == d[:-1]) & (step[1:] == step[:-1] + 1)
        count = count + np.concatenate((np.where(next_to, count[1:], 0), [0]))
    enough = np.flatnonzero(count >= items.need[item])
    item, d, step = item[enough], d[enough], step[enough]
    unit = items.unit[item]
    start = (step - 1) * unit
    return item, d, np.maximum(start, 0) + first[d], np.minimum(start + 4 * unit + first[d], last[d])


def find(items: Items, texts) -> list[list[tuple]]:
    """For each text its (item_id, score, start_word, end_word), one for each item that it holds a copy of."""
    h, doc, _, _ = word_hashes(texts)
    out: list[list[tuple]] = [[] for _ in range(len(texts))]
    gram, of, at = items.grams(h, doc)
    near, _ = items.set.places(gram)
    if not len(near):
        return out
    near = near[np.argsort(of[near], kind="stable")]
    gram, of, at = gram[near], of[near], at[near]
    first, last = (np.searchsorted(doc, np.arange(len(texts)), side=s) for s in ("left", "right"))
    # whole documents at a time, of about MATCHES matches
    matches = np.cumsum(np.searchsorted(items.gram, gram, side="right") - np.searchsorted(items.gram, gram, side="left"))
    ends = np.flatnonzero(np.concatenate((of[1:] != of[:-1], [True]))) + 1
    part = matches[ends - 1] // MATCHES
    ends = ends[np.concatenate((part[1:] != part[:-1], [True]))]
    best: dict[tuple, tuple] = {}
    for lo, hi in zip([0, *ends], ends):
        _align_all(items, h, first, _windows(items, first, last, of[lo:hi], gram[lo:hi], at[lo:hi]), best)
    for (d, i), (score, a, b) in sorted(best.items()):
        out[d].append((items.ids[i], -score, a, b))
    return out


def _align_all(items: Items, h: np.ndarray, first: np.ndarray, windows: tuple, best: dict[tuple, tuple]) -> None:
    """Align every window with its item; ``best`` gets the best of each (text number, item)."""
    item, d, start, end = windows
    begin = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else []
    for lo, hi in zip(begin, [*begin[1:], len(item)]):
        own, i = np.arange(lo, hi), item[lo]
        word = items.words[i]
        width = 4 * int(items.unit[i])
        for some in np.array_split(own, len(own) * width // CELLS + 1):
            if not len(some):
                continue
            cols = start[some][:, None] + np.arange(width)
            inside = cols < end[some][:, None]
            rows = np.where(inside, h[np.minimum(cols, len(h) - 1)], np.uint64(0))
            score, stop = align(word, rows)
            good = np.flatnonzero(score >= items.bar[i] * MATCH * len(word) - 1e-9)
            if not len(good):
                continue
            # the same alignment backwards from its end gives its beginning
            back = stop[good][:, None] - 1 - np.arange(width)
            mirrored = np.where(back >= 0, np.take_along_axis(rows[good], np.maximum(back, 0), axis=1), np.uint64(0))
            _, taken = align(word[::-1], mirrored)
            for g, n in zip(good, taken):
                a = int(start[some[g]] - first[d[some[g]]] + stop[g])
                hit = (-float(score[g]) / (MATCH * len(word)), a - int(n), a)
                key = (int(d[some[g]]), int(i))
                best[key] = min(best.get(key, hit), hit)


def blocks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> Iterator[Items]:
    """The test items in blocks of at most about BLOCK_BYTES, with seeds chosen by their counts in ``docs``."""
    usable = benchmark.filter("item_id is not null and text is not null").select("item_id", "text")
    size = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // BLOCK_BYTES + 1
    for k in range(n):
        part = usable if n == 1 else usable.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        rows = sorted((r["item_id"], r["text"]) for r in part.distinct().collect())
        if not rows:
            continue
        items = Items([r[0] for r in rows], [r[1] for r in rows], threshold)
        items.drop_frequent(_counts(docs, items))
        yield items


def _counts(docs: DataFrame, items: Items) -> dict[int, int]:
    """Documents of the corpus that hold each n-gram of the items (at most as many rows as n-grams)."""
    packed = pickle.dumps(items)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pickle.loads(packed)
        for b in batches:
            h, doc, _, _ = word_hashes(list(b["text"]))
            gram, of, _ = own.grams(h, doc)
            met, i = own.set.places(gram)
            g, n = np.unique(distinct(i * len(b) + of[met]) // max(1, len(b)), return_counts=True)
            yield pd.DataFrame({"g": own.set.known[g].view(np.int64), "n": n.astype(np.int64)})

    seen = docs.select("text").mapInPandas(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    return {r["g"]: r["n"] for r in seen.collect()}


def hits_of(items: Items, text: Column) -> Column:
    """Array of the items that a text holds a copy of (HITS); null texts have none."""
    packed = pickle.dumps(items)

    @F.pandas_udf("string")
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = pickle.loads(packed)
        for t in texts:
            yield pd.Series([json.dumps([dict(zip(("item_id", "score", "start_word", "end_word"), x)) for x in found])
                             if found else None for found in find(own, list(t))], dtype=object)

    return F.from_json(search(text), HITS)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word: test items that documents hold a copy of, edited or not.

    ``score`` is the best local alignment's over the item's own (1: all words in order), at least
    ``threshold``.  Words are lower-cased runs of letters and digits, counted from 0.  Items of fewer than
    MIN_WORDS words count only whole and unedited (score 1); null items and items without words take no part; repeated
    items count once, items of one id and different texts each.  Null and empty texts match nothing; repeated documents
    are reported each.  Other columns are ignored."""
    out = None
    for items in blocks(docs, benchmark, threshold):
        part = (docs.select("doc_id", hits_of(items, F.col("text")).alias("hits"))
                .filter("hits is not null").select("doc_id", F.inline("hits")))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.select("doc_id", F.inline(F.from_json(F.lit(None).cast("string"), HITS))).limit(0)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no copy of a test item."""
    for items in blocks(docs, benchmark, threshold):
        docs = docs.filter(hits_of(items, F.col("text")).isNull())
    return docs
