"""Exact-size, seeded, leak-free sampling and splitting.

Every row is ranked by ``md5("<seed>:<key>")`` (ties by key).  A global
``row_number()`` would put all rows in one task, so the rank is built in two
steps: count rows per hash prefix (a table of at most ``16**digits`` rows, a
proven bound, so it is broadcast), prefix-sum those counts, and add a
``row_number()`` inside each prefix bucket.  The result is independent of input
order and partitioning, and DuckDB's ``md5`` gives the same hex, so every split
can be checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK = "rank"
TOTAL = "n_total"


def hash_key(key: str | Column, seed: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    # a null key hashes like an empty one, so that its row has a bucket and is kept
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(k.cast("string"), F.lit(""))))


def hash_rank(df: DataFrame, key: str, seed: int = 42, digits: int = 4) -> DataFrame:
    """Add ``rank`` (1..n, unique) and ``n_total`` to ``df``; ``key`` must be unique."""
    h = hash_key(key, seed)
    hashed = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, digits))
    counts = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # bounded: at most 16**digits rows
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy()).alias(TOTAL),
    )
    within = Window.partitionBy("_b").orderBy("_h", key)
    return (
        hashed.join(F.broadcast(offsets), "_b")
        .withColumn(RANK, (F.col("_off") + F.row_number().over(within)).cast("long"))
        .drop("_b", "_off")
    )


def _bucket_offsets(hashed: DataFrame, digits: int) -> DataFrame:
    counts = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # bounded: at most 16**digits rows, so the un-partitioned window is small
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        "_b", "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy()).alias(TOTAL),
    )


def hash_segments(df: DataFrame, key: str, cuts, seed: int = 42, digits: int = 4,
                  out: str = "segment") -> DataFrame:
    """Add ``segment`` = number of cut points below the row's hash rank.

    ``cuts(total)`` returns ascending cut points (Columns) given the row count.
    Only rows of buckets that straddle a cut point are ranked with a window;
    every other row is decided by a broadcast join against the bucket table,
    so the big side is never shuffled.  ``key`` must be unique."""
    hashed = df.withColumn("_h", hash_key(key, seed)).withColumn(
        "_b", F.substring("_h", 1, digits))
    offsets = _bucket_offsets(hashed, digits)
    cut_cols = cuts(F.col(TOTAL))
    first = F.col("_off") + 1
    last = F.col("_off") + F.col("_n")

    def seg_of(rank: Column) -> Column:
        return sum((c < rank).cast("int") for c in cut_cols)

    offsets = offsets.select(
        "_b", "_off",
        *[c.alias(f"_c{i}") for i, c in enumerate(cut_cols)],
        seg_of(first).alias("_lo"), seg_of(last).alias("_hi"))
    joined = hashed.join(F.broadcast(offsets), "_b")
    cut_named = [F.col(f"_c{i}") for i in range(len(cut_cols))]
    easy = joined.where(F.col("_lo") == F.col("_hi")).withColumn(out, F.col("_lo"))
    within = Window.partitionBy("_b").orderBy("_h", key)
    rank = F.col("_off") + F.row_number().over(within)
    hard = joined.where(F.col("_lo") != F.col("_hi")).withColumn(
        out, sum((c < rank).cast("int") for c in cut_named))
    drop = ["_h", "_b", "_off", "_lo", "_hi", *[f"_c{i}" for i in range(len(cut_cols))]]
    return easy.unionByName(hard).drop(*drop)


def _target(total: Column, n: int | None, ratio: float | None) -> Column:
    if (n is None) == (ratio is None):
        raise ValueError("give exactly one of n or ratio")
    if n is not None:
        return F.when(total >= F.lit(n), F.lit(n).cast("long")).otherwise(
            F.raise_error(F.lit(f"sample larger than population ({n})")).cast("long"))
    return F.floor(total.cast("double") * F.lit(float(ratio))).cast("long")


def exact_sample(df: DataFrame, key: str, n: int | None = None, ratio: float | None = None,
                 seed: int = 42) -> DataFrame:
    """Uniform sample without replacement of exactly ``n`` rows, or of
    ``int(count * ratio)`` rows; deterministic for a seed, independent of
    input order and partitioning."""
    seg = hash_segments(df, key, lambda total: [_target(total, n, ratio)], seed, out="_seg")
    return seg.where(F.col("_seg") == 0).drop("_seg")


def ranked_sample(df: DataFrame, key: str, n: int | None = None,
                  ratio: float | None = None, seed: int = 42) -> DataFrame:
    """Like :func:`exact_sample` but also returns the sample order ``rank``
    (needs a window over every hash bucket)."""
    ranked = hash_rank(df, key, seed)
    return ranked.where(F.col(RANK) <= _target(F.col(TOTAL), n, ratio)).drop("_h", TOTAL)


def split_off(df: DataFrame, key: str, n: int | None = None, ratio: float | None = None,
              seed: int = 42, role: str = "role", picked: str = "query",
              rest: str = "bank") -> DataFrame:
    """Label every row ``picked`` (the exact sample) or ``rest`` in one pass."""
    seg = hash_segments(df, key, lambda total: [_target(total, n, ratio)], seed, out="_seg")
    return seg.withColumn(role, F.when(F.col("_seg") == 0, F.lit(picked))
                          .otherwise(F.lit(rest))).drop("_seg")


def split_sizes(total: Column, subset: float, train: float, test: float):
    n_sub = F.floor(total.cast("double") * F.lit(float(subset)))
    n_train = F.floor(n_sub.cast("double") * F.lit(float(train)))
    n_test = F.floor((n_sub - n_train).cast("double") * F.lit(float(test)))
    return [n_train, n_train + n_test, n_sub]


def study_split(df: DataFrame, key: str = "study_id", subset: float = 1.0,
                train: float = 0.9, test: float = 0.5, seed: int = 42,
                out: str = "split", digits: int = 4) -> DataFrame:
    """Split rows by study into train / test / val with truncated sizes:
    ``sub = int(N*subset)``, ``train = int(sub*train)``,
    ``test = int((sub-train)*test)``, ``val = sub - train - test``.
    Studies outside the subset are dropped; all rows of a study share a split.

    Only distinct study ids are shuffled (to count them per hash bucket); the
    rows themselves are assigned by a broadcast join with the bucket table, plus
    a join with the few studies of buckets that straddle a cut point."""
    names = F.array(F.lit("train"), F.lit("test"), F.lit("val"))
    hashed = df.withColumn("_h", hash_key(key, seed)).withColumn(
        "_b", F.substring("_h", 1, digits))
    studies = hashed.select(key, "_h", "_b").where(F.col(key).isNotNull()).distinct()
    offsets = _bucket_offsets(studies, digits)
    cut_cols = split_sizes(F.col(TOTAL), subset, train, test)
    first, last = F.col("_off") + 1, F.col("_off") + F.col("_n")
    offsets = offsets.select(
        "_b", "_off", *[c.alias(f"_c{i}") for i, c in enumerate(cut_cols)],
        sum((c < first).cast("int") for c in cut_cols).alias("_lo"),
        sum((c < last).cast("int") for c in cut_cols).alias("_hi"))
    cut_named = [F.col(f"_c{i}") for i in range(3)]
    rank = F.col("_off") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    hard = (studies.join(F.broadcast(offsets), "_b")
            .where(F.col("_lo") != F.col("_hi"))
            .select(key, sum((c < rank).cast("int") for c in cut_named).alias("_hseg")))
    rows = (hashed.join(F.broadcast(offsets.select("_b", "_lo", "_hi")), "_b")
            .join(hard, key, "left")
            .withColumn("_seg", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
                        .otherwise(F.col("_hseg"))))
    return (rows.where(F.col("_seg") < 3)
            .withColumn(out, F.element_at(names, F.col("_seg") + 1))
            .drop("_h", "_b", "_lo", "_hi", "_hseg", "_seg"))


def split_leaks(df: DataFrame, key: str = "study_id", split: str = "split") -> DataFrame:
    """Studies that occur in more than one split (must be empty); pairwise check."""
    return (df.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("splits"))
            .where(F.size("splits") > 1))


def split_counts(df: DataFrame, key: str = "study_id", split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.countDistinct(key).alias("studies"),
                                 F.count(F.lit(1)).alias("rows"))


def assign_batches(df: DataFrame, key: str, size: int, seed: int = 42,
                   drop_last: bool = True) -> DataFrame:
    """Shuffle rows (hash order) and cut into batches of ``size``; the last,
    partial batch is dropped when ``drop_last``.  Adds ``batch_id`` and ``pos``."""
    ranked = hash_rank(df, key, seed)
    r = F.col(RANK) - 1
    out = ranked.withColumn("batch_id", F.floor(r / size).cast("int")) \
                .withColumn("pos", (r % size).cast("int"))
    if drop_last:
        out = out.where(F.col("batch_id") < F.floor(F.col(TOTAL) / size))
    return out.drop("_h", TOTAL, RANK)


def sample_sentences(df: DataFrame, col: str, key: str, n: int, seed: int = 42,
                     out: str = "caption") -> DataFrame:
    """Pick ``n`` random '.'-pieces of a report (seeded by key and piece
    index), strip them and join with '. ' in the order they were drawn."""
    pieces = F.filter(F.split(F.translate(F.col(col), "\n\r", ""), r"\.", -1),
                      lambda s: F.length(s) > 0)
    keyed = F.transform(
        pieces,
        lambda s, i: F.struct(
            F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"),
                              i.cast("string"))).alias("h"),
            i.alias("i"), s.alias("s")))
    drawn = F.slice(F.array_sort(keyed), 1, n)
    return df.withColumn(out, F.array_join(
        F.transform(drawn, lambda x: F.btrim(x["s"], F.lit(" \t\n\r\f\u000b"))), ". "))
