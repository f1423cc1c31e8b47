"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``SLOTS`` places.  Every shard owns several virtual nodes; a place belongs to
the next node clockwise.  A shard takes rows up to its bound; rows that find it full
continue clockwise to the next node of a shard with room.  Only DataFrame functions touch
the rows: the driver sees one count per place, and the table of ranges it makes from
them is of bounded size, whatever the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studybank.llm.common import byte_size, inline_table, stored

SLOTS = 1 << 14
NODES = 64
#: Copies of one key that one row is exploded into.
PIECE = 10_000


def ring(spark, shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise; of two at one place the lower shard stays.

    A shard's nodes don't depend on how many other shards there are."""
    spots = (spark.range(shards * nodes).select(
        (F.col("id") / nodes).cast("int").alias("shard"),
        F.pmod(F.xxhash64(F.lit("node"), F.floor(F.col("id") / nodes), F.col("id") % nodes),
               F.lit(SLOTS)).cast("int").alias("place"))
        .groupBy("place").agg(F.min("shard").alias("shard")).collect())
    return sorted((r["place"], r["shard"]) for r in spots)


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows each shard may hold; without slack they add up to ``rows`` and differ by one at most."""
    if slack:
        return [math.ceil(rows / shards * (1 + slack))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def ranges(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[dict]:
    """Who takes what: for ranks lo to hi-1 of a place, the shard and its first slot."""
    room, used, out = list(room), [0] * len(room), []
    nxt, i = 0, 0
    for place in sorted(counts):
        while nxt < len(nodes) and nodes[nxt][0] < place:
            nxt += 1
        lo, left, i = 0, counts[place], nxt
        while left:
            shard = nodes[i % len(nodes)][1]
            n = min(left, room[shard])
            if n:
                out.append({"place": place, "lo": lo, "hi": lo + n, "shard": shard, "base": used[shard]})
                room[shard] -= n
                used[shard] += n
                lo, left = lo + n, left - n
            i += 1
    return out


def place_documents(docs: DataFrame, shards: int = 40, nodes: int = NODES, slack: float = 0.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes plus 16, ``slot`` counts from 0 within a shard without
    gaps.  The key of a row is its doc_id and text, so repeated rows (and null ids) meet
    at one place: they are counted first and spread as counts, so a hot key is no
    large group.  Null text counts as empty.  Without slack, shards differ by one row at most.
    Other columns are ignored."""
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    size = byte_size(F.col("text")) + F.lit(16)
    keys = docs.select("doc_id", size.cast("long").alias("size"), crc.cast("long").alias("text_crc32"))
    keys = (keys.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("h", F.xxhash64("doc_id", "size", "text_crc32"))
            .withColumn("place", F.pmod("h", F.lit(SLOTS)).cast("int")))
    keys = stored(keys, "shard-keys")
    # one count per place: at most SLOTS rows
    counts = {r["place"]: r["n"] for r in keys.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    room = capacities(sum(counts.values()), shards, slack)
    parts = ranges(counts, ring(spark, shards, nodes), room)
    # at most one range per place and one more each time a shard fills up
    side = F.broadcast(inline_table(spark, parts, "place int, lo long, hi long, shard int, base long"))
    run = Window.partitionBy("place").orderBy("h", "doc_id", "size", "text_crc32")
    ranked = keys.withColumn("to", F.sum("n").over(run)).withColumn("from", F.col("to") - F.col("n"))
    met = ranked.join(side, "place").filter((F.col("from") < F.col("hi")) & (F.col("to") > F.col("lo")))
    first, last = F.greatest("from", "lo"), F.least("to", "hi") - 1
    met = met.withColumns({"first": first, "last": last})
    # copies of one key beyond PIECE are dealt over tasks before they become rows
    many = F.col("last") - F.col("first") >= PIECE
    hot = met.filter(many).withColumn("first", F.explode(F.sequence("first", "last", F.lit(PIECE).cast("long"))))
    hot = hot.withColumn("last", F.least("last", F.col("first") + (PIECE - 1))).repartition("first", "shard")
    return (met.filter(~many).unionByName(hot).withColumn("rank", F.explode(F.sequence("first", "last")))
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("base") + F.col("rank") - F.col("lo")).alias("slot")))
