"""Mixing sources to target weights by weighted fair queueing.

Each source sends its documents in a shuffled order, up to ``epochs`` times over.  A
document's virtual finish time is the source's words up to and with it, divided by
the source's target.  All (document, epoch) pairs are range-sorted by that time
and the sort is cut where the words reach the total budget.

Within a source the pairs are taken in order, so the cut comes down to one (epoch, last
shuffle key) per source: the last pass over the documents needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studybank.llm.common import inline_table, stored, text_md5

#: A word, and what separates words (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
#: Most sources; their totals and cuts are held by the driver. More raise an error.
MAX_SOURCES = 100_000
#: Ranges of virtual time for each unit of it, and of a range that is cut again.
RANGES = 1024
#: Pairs sorted together at the cut; cuts that a double's digits are told apart by.
EDGE, RESOLVED = 20_000, 6


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(seed: int) -> Column:
    """Place of a document in its source's shuffled order: equal for repeated rows only."""
    ident = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                        text_md5(F.col("text")))
    return F.md5(ident.cast("binary"))


def targets(sizes: dict, weights=(1, 2, 3), epochs: int = 3) -> dict:
    """Words each source should give, from the words it has.

    Sources by code point, null last, weigh ``weights`` in turn and share the total of all
    sizes; none gets more than ``epochs`` times its size, the excess is reshared by
    weight.  That is one level for all: target = min(cap, level x weight)."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, left_w = sum(sizes.values()), sum(weight.values())
    capped, level = 0, None
    for s in sorted(order, key=lambda s: (epochs * sizes[s] / weight[s], order.index(s))):
        level = (total - capped) / left_w
        if level <= epochs * sizes[s] / weight[s]:
            break
        capped, left_w = capped + epochs * sizes[s], left_w - weight[s]
    return {s: min(float(epochs * sizes[s]), level * weight[s]) for s in order}


def mix(docs: DataFrame, weights=(1, 2, 3), epochs: int = 3, seed: int = 7) -> DataFrame:
    """``docs`` (doc_id, text, source and others) with size, source_size, target, copies, taken.

    ``copies`` is how often the mix takes the document (0 to ``epochs``), ``taken`` its
    words times that.  A source misses its target by less than one document.  Null text has size
    0; a null source is a source of its own, the last; repeated rows share a fate, which can
    take the total over the budget by their copies; an empty table stays empty.  Columns of
    the input named like a new one are replaced."""
    spark = docs.sparkSession
    new = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*new)
    keyed = docs.select(F.col("source").alias("src"), words(F.col("text")).alias("n"),
                        shuffle_key(seed).alias("k"))
    keyed = stored(keyed.groupBy("src", "k").agg(F.sum("n").alias("n")), "mix-keys")
    rows = keyed.groupBy("src").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not rows:
        return docs.select("*", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("source_size"),
                           F.lit(0.0).alias("target"), F.lit(0).alias("copies"), F.lit(0).cast("long").alias("taken"))
    sizes = {r["src"]: r["n"] for r in rows}
    goal = targets(sizes, weights, epochs)
    budget = sum(sizes.values())
    sources = [{"src": s, "sid": i, "source_size": sizes[s], "target": goal[s]} for i, s in enumerate(goal)]
    side = F.broadcast(inline_table(spark, sources, "src string, sid int, source_size long, target double"))

    bucket = F.substring("k", 1, 3).alias("b")
    by_id = keyed.join(side, keyed["src"].eqNullSafe(side["src"])).select("sid", "k", "n", "source_size", "target", bucket)
    sums = by_id.groupBy("sid", "b").agg(F.sum("n").alias("bn"))
    before = Window.partitionBy("sid").orderBy("b")
    sums = sums.select("sid", "b", (F.sum("bn").over(before) - F.col("bn")).alias("base"))
    inside = Window.partitionBy("sid", "b").orderBy("k")
    cum = (by_id.join(sums, ["sid", "b"])
           .select("sid", "k", "n", "source_size", "target",
                   (F.col("base") + F.sum("n").over(inside)).alias("cum")))
    pairs = stored(cum.filter("n > 0").select(
        "sid", "k", "n", F.explode(F.expr(f"sequence(0, {epochs - 1})")).alias("e"),
        "source_size", "target", "cum"), "mix-pairs")
    pairs = pairs.select("sid", "k", "e", "n",
                         ((F.col("e") * F.col("source_size") + F.col("cum")) / F.col("target")).alias("v"))
    took = _until(pairs, budget)
    last = {r["sid"]: r["m"] for r in
            pairs.filter(took).groupBy("sid").agg(F.max(F.struct("e", "k")).alias("m")).collect()}
    for s in sources:
        m = last.get(s["sid"])
        s |= {"full": m["e"] if m else 0, "until": m["k"] if m else ""}
    cuts = F.broadcast(inline_table(
        spark, sources, "src string, sid int, source_size long, target double, full int, until string"))
    # the row travels as one column, so no column of its own can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("of"), words(F.col("text")).alias("size"),
                       shuffle_key(seed).alias("key"))
    out = rows.join(cuts, F.col("of").eqNullSafe(F.col("src")), "left")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("full") + F.when(F.col("key") <= F.col("until"), 1).otherwise(0))
    out = out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *new)


def _until(pairs: DataFrame, budget: int) -> Column:
    """Condition for the pairs (v, sid, k, e, n) that come before the words reach ``budget``, in the order of v, sid, k, e.

    Words are counted by range of virtual time; the range in which the budget ends is cut into ranges again until few
    pairs are in it (or, after RESOLVED cuts, only pairs of one time), and only those are sorted."""
    inside, below, x, given = F.lit(True), F.lit(False), F.col("v"), 0
    for depth in range(RESOLVED):
        r = F.least(F.floor(x * RANGES), F.lit(4 * RANGES)).cast("int")
        # at most 4 * RANGES + 1 rows
        rows = (pairs.filter(inside).groupBy(r.alias("r")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect())
        cut = None
        for at, n, count in sorted((g["r"], g["n"], g["rows"]) for g in rows):
            if given + n > budget:
                cut = at
                break
            given += n
        if cut is None:
            return below | inside
        below, inside = below | (inside & (r < cut)), inside & (r == cut)
        if count <= EDGE:
            break
        x = x * RANGES - cut
    order = Window.partitionBy("one").orderBy("v", "sid", "k", "e")
    edge = (pairs.filter(inside).withColumn("one", F.lit(0)).withColumn("run", F.sum("n").over(order))
            .filter(F.col("run") <= budget - given).agg(F.max(F.struct("v", "sid", "k", "e")).alias("m")).first()["m"])
    if edge is None:
        return below
    at = F.struct(F.lit(edge["v"]).cast("double").alias("v"), F.lit(edge["sid"]).alias("sid"),
                  F.lit(edge["k"]).alias("k"), F.lit(edge["e"]).alias("e"))
    return below | (inside & (F.struct("v", "sid", "k", "e") <= at))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns."""
    out = mix(docs, **options).filter("copies > 0")
    return (out.select(F.struct(*docs.columns).alias("row"), F.explode(F.expr("sequence(1, copies)")).alias("copy"))
            .select("row.*"))
