"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studybank.session import cut_lineage, ensure_checkpoint_dir, ship_package

#: Rows in one Arrow batch of text: bounds a Python worker's memory when texts are long.
TEXT_BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Ship the package, find the shared folder, bound Arrow batches."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to and read back from the shared folder; survives lost executors."""
    return cut_lineage(df, f"llm-{name}")


def inline_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small driver-side table as a SQL literal (JVM only).

    The callers state the bound of ``rows``; it never grows with the data."""
    text = json.dumps(rows, separators=(",", ":"))
    one = spark.range(1).select(F.from_json(F.lit(text), f"array<struct<{schema}>>").alias("r"))
    return one.select(F.inline("r"))


def text_md5(text: Column) -> Column:
    """md5 of the text's UTF-8 bytes; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text, null 0."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, over an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Bytes that belong to words: ASCII letters, digits and every byte of a non-ASCII letter.
_WORD_BYTE = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 57), (97, 122), (128, 255)):
    _WORD_BYTE[_lo:_hi + 1] = True


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of many texts as 64-bit hashes.

    Returns (hash of each word, text number of each word, start and end byte of each
    word in the lower-cased UTF-8 of its text).  A word is a run of ASCII letters,
    digits and non-ASCII characters.  Null texts have no words."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    starts = np.concatenate(([0], np.cumsum(np.array([len(r) + 1 for r in raw], dtype=np.int64))))
    joined = b" ".join(raw) + b" " * 9  # a separator after each text, room for the last load
    isw = _WORD_BYTE[np.frombuffer(joined, dtype=np.uint8)]
    edge = np.flatnonzero(isw[1:] != isw[:-1]) + 1
    if len(isw) and isw[0]:
        edge = np.concatenate(([0], edge))
    w0, w1 = edge[::2], edge[1::2]
    loads = np.ndarray((len(joined) - 7,), dtype="<u8", buffer=joined, strides=(1,))
    size = w1 - w0
    with np.errstate(over="ignore"):
        h = size.astype(np.uint64) * _MIX
        live = np.arange(len(w0))
        for lo in range(0, int(size.max(initial=0)), 8):
            if lo:
                live = live[size[live] > lo]
            left = np.minimum(size[live] - lo, 8)
            h[live] = mix64(h[live] + (loads[w0[live] + lo] & _KEEP[left]))
    first = np.searchsorted(w0, starts)
    doc = np.repeat(np.arange(len(raw)), np.diff(first))
    return h, doc, w0 - starts[doc], w1 - starts[doc]


#: The low n bytes of a load, n from 0 to 8.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort."""
    x = np.sort(x)
    return x if len(x) < 2 else x[np.concatenate(([True], x[1:] != x[:-1]))]


def shingle_hashes(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every run of n consecutive words of one text: (hash, text number, first word)."""
    if len(h) < n:
        z = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), z, z
    with np.errstate(over="ignore"):
        out = h[:len(h) - n + 1].copy()
        for i in range(1, n):
            out *= _MIX
            out += h[i:len(h) - n + 1 + i]
        out ^= out >> np.uint64(32)
    keep = np.flatnonzero(doc[:len(h) - n + 1] == doc[n - 1:])
    return out[keep], doc[keep], keep


class HashSet:
    """Sorted distinct hashes with a quick first test, for looking many hashes up."""

    def __init__(self, hashes: np.ndarray):
        self.known = distinct(hashes)
        bits = max(10, int(len(self.known)).bit_length() + 4)
        self.low = np.uint64((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, dtype=bool)
        self.maybe[(self.known & self.low).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``hashes`` that are known, their places in ``known``)."""
        at = np.flatnonzero(self.maybe[(hashes & self.low).astype(np.int64)])
        if not len(self.known) or not len(at):
            return at[:0], at[:0]
        i = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        same = self.known[i] == hashes[at]
        return at[same], i[same]


def grouped(batches, key: str):
    """Consecutive rows of one ``key`` from Arrow-fed pandas batches, as dicts of arrays.

    The rows must be sorted by key; a group may span batches."""
    held: dict | None = None
    for b in batches:
        if not len(b):
            continue
        cols = {c: b[c].to_numpy() for c in b.columns}
        if held is not None:
            cols = {c: np.concatenate([held[c], cols[c]]) for c in cols}
        k = cols[key]
        cut = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))
        for lo, hi in zip(cut, cut[1:]):
            yield {c: v[lo:hi] for c, v in cols.items()}
        held = {c: v[cut[-1]:] for c, v in cols.items()}
    if held is not None:
        yield held


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of the undirected ``edges`` (x, y): (x, root), root the least node.

    Every node goes to its least neighbour (or itself), which contracts the graph; a few rounds
    leave no edge, then the maps are chained.  Each round is written to the shared folder, so
    joins have plain exchanges below them and a hot node can be split."""
    e = stored(edges.filter("x <> y").select("x", "y").distinct(), f"{name}-edges")
    maps = []
    while e.head(1):
        both = e.union(e.select("y", "x"))
        m = stored(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("root")), f"{name}-map")
        maps.append(m)
        one, two = m.toDF("x", "a"), m.toDF("y", "b")
        e = stored(e.join(one, "x").join(two, "y").select(F.col("a").alias("x"), F.col("b").alias("y"))
                   .filter("x <> y").distinct(), f"{name}-edges")
    if not maps:
        return e.select("x", F.col("y").alias("root"))
    out = maps.pop()
    while maps:
        last = out.toDF("root", "further")
        out = stored(maps.pop().join(last, "root", "left").select("x", F.coalesce("further", "root").alias("root")),
                     f"{name}-roots")
    return out
