"""Jaccard join of word shingles by chosen paths.

Texts with equal shingle sets are one class before anything else.  A class has a sketch of
minhashes, its tokens.  In every run a class follows the tokens that a hash of the path so far
chooses; classes that arrive at one path share those tokens.  Paths with few classes are compared
by brute force on their sketches.  In larger ones every class is first compared with some leaders,
which settles groups of near copies, as no token splits them: if a leader is near each class, the
path is done; if few classes are left over, they are compared with all that may be near them;
if many are, these are split again by the next chosen token, one that few classes of the path have.
Runs are repeated until the target recall.  Groups of classes linked by their sketches are then compared exactly, every pair once, on
their whole shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studybank.llm.common import (
    _MIX, components, distinct, grouped, mix64, shingle_hashes, stored, text_md5, word_hashes)

#: Words of a shingle; least similarity.
WORDS, THRESHOLD = 5, 0.8
#: Minhashes of a sketch.
TOKENS = 64
#: A path chooses 1 / KEEP tokens of a class on average. Below THRESHOLD by three deviations of a
#: sketch's similarity, so that paths shared by similar classes don't die out.
KEEP = 0.65
#: Sketch similarity of a candidate: five deviations below THRESHOLD.
NEAR = THRESHOLD - 5 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / TOKENS)
#: Target recall, and the least chance that one run joins a pair at the threshold (paths of four tokens).
RECALL, CHANCE = 0.9995, 0.45
#: Classes compared by brute force at a time; splits of a path.
LIMIT, DEPTH = 512, 4
#: Leaders of a large path on average; its classes compared with them by one task.
LEADERS, BLOCK = 64, 4096
#: A class this like a leader has no class at THRESHOLD that isn't near that leader itself: distances add up at most, and
#: three deviations are added.
SURE = NEAR + (1 - THRESHOLD) + 3 * math.sqrt(NEAR * (1 - NEAR) / TOKENS)
#: Texts whose keys are broadcast to find them (32 bytes each); more are found by a shuffle.
FEW = 200_000

_ODD = mix64(np.arange(1, TOKENS + 1, dtype=np.uint64) * _MIX) | np.uint64(1)


def shingle_sets(texts) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text of one to four words has one shingle, all of them; a text without words has none."""
    h, doc, _, _ = word_hashes(texts)
    gram, of, _ = shingle_hashes(h, doc, WORDS)
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    sets = [distinct(gram[a:b]) for a, b in zip(cut, cut[1:])]
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i in np.flatnonzero((np.diff(cut) > 0) & (np.diff(cut) < WORDS)):
        own = h[cut[i]:cut[i + 1]]
        sets[i] = shingle_hashes(own, np.zeros(len(own), dtype=np.int64), len(own))[0]
    return sets


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """TOKENS minhashes of 32 bits of each set; zeros for an empty set."""
    out = np.zeros((len(sets), TOKENS), dtype=np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        flat = np.concatenate([sets[i] for i in some])
        at = np.cumsum([0] + [len(sets[i]) for i in some[:-1]])
        with np.errstate(over="ignore"):
            for t in range(TOKENS):
                out[some, t] = np.minimum.reduceat(flat * _ODD[t], at) >> np.uint64(32)
    return out


def _described(texts: pd.Series) -> pd.DataFrame:
    sets = shingle_sets(list(texts))
    sketches = _sketches(sets)
    with np.errstate(over="ignore"):
        sig = [(mix64(s).sum(dtype=np.uint64).tobytes() + mix64(s ^ _MIX).sum(dtype=np.uint64).tobytes()) if len(s)
               else hashlib.md5(b"no words:" + (t or "").encode("utf-8", "surrogatepass")).digest()
               for s, t in zip(sets, texts)]
    return pd.DataFrame({"sig": sig, "n": np.array([len(s) for s in sets], dtype=np.int32),
                         "sketch": [x.tobytes() for x in sketches]})


def _chosen(tokens: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, longer path) of every token that a row's path chooses."""
    with np.errstate(over="ignore"):
        u = mix64((tokens * _MIX) ^ paths[:, None])
    row, col = np.nonzero(u < np.uint64(int(2 ** 64 / (KEEP * TOKENS))))
    return row, mix64(u[row, col] ^ _MIX)


def _tokens(sketches) -> np.ndarray:
    """Minhashes marked with their places."""
    s = np.frombuffer(b"".join(sketches), dtype=np.uint32).reshape(-1, TOKENS)
    return s.astype(np.uint64) | (np.arange(TOKENS, dtype=np.uint64) << np.uint64(32))


def _first_paths(runs: int):
    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tokens, sig = _tokens(b["sketch"]), b["sig"].to_numpy()
            for r in range(runs):
                root = np.full(len(b), mix64(np.array([r + 1], dtype=np.uint64))[0])
                row, path = _chosen(tokens, root)
                yield pd.DataFrame({"path": path.view(np.int64), "sig": sig[row]})
    return choose


def _roots(linked: np.ndarray) -> np.ndarray:
    """First member of each member's component in a symmetric matrix of links."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            new = np.zeros(len(linked), dtype=bool)
            new[i] = True
            while new.any():
                root[new] = i
                new = linked[new].any(axis=0) & (root < 0)
    return root


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(x, y): a class and another it is linked to by sketches; a spanning forest of each path.

    For a pair of blocks, of which the second begins at ``second``, only links between the blocks' own
    components are left to tell (0: one block)."""
    for b in batches:
        xs, ys = [], []
        for sig, sketch, second in zip(b["sig"], b["sketch"], b["second"]):
            s = np.frombuffer(b"".join(sketch), dtype=np.uint32).reshape(len(sig), TOKENS)
            if len(sig) <= 32:
                same = (s[:, None] == s[None]).sum(axis=2)
            else:
                same = np.zeros((len(sig), len(sig)), dtype=np.uint8)
                for t in range(TOKENS):
                    same += s[:, None, t] == s[None, :, t]
            linked = same >= NEAR * TOKENS
            root = _roots(linked)
            tell = root != np.arange(len(sig))
            if second:
                inner = np.concatenate((_roots(linked[:second, :second]), _roots(linked[second:, second:]) + second))
                tell &= inner == np.arange(len(sig))
            for i in np.flatnonzero(tell):
                xs.append(sig[i])
                ys.append(sig[root[i]])
        yield pd.DataFrame({"x": xs, "y": ys}, dtype=object)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal minhashes of every sketch of ``a`` and every one of ``b``."""
    same = np.zeros((len(a), len(b)), dtype=np.uint8)
    for t in range(TOKENS):
        same += a[:, None, t] == b[None, :, t]
    return same


def _of_one(root: np.ndarray, near: np.ndarray) -> None:
    """Joins, in ``root``, the columns that one row of ``near`` names."""
    for cols in np.unique(near, axis=0):
        at = np.flatnonzero(cols)
        if len(at) > 1:
            roots = np.unique(root[at])
            root[np.isin(root, roots)] = roots[0]


def _compared_with_leaders(members: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
    """For each class of a block: y, its most alike leader if that is near (null if not), and their sketches' similarity;
    for leaders that a class is near to both: a row of the two, without similarity."""
    if not len(members):
        return pd.DataFrame({"path": [], "sig": [], "y": [], "share": []}, dtype=object)
    path = members["path"].iloc[0]
    sigs = members["sig"].to_numpy()
    names = list(leaders["m_sig"].iloc[0]) if len(leaders) else []
    if not names:
        return pd.DataFrame({"path": path, "sig": sigs, "y": None, "share": 0.0})
    a = np.frombuffer(b"".join(members["sketch"]), dtype=np.uint32).reshape(-1, TOKENS)
    b = np.frombuffer(b"".join(leaders["m_sketch"].iloc[0]), dtype=np.uint32).reshape(-1, TOKENS)
    same = _agreement(a, b)
    near = same >= NEAR * TOKENS
    best = same.argmax(axis=1)
    y = np.array(names, dtype=object)[best]
    y[~near.any(axis=1)] = None
    root = np.arange(len(names))
    _of_one(root, near)
    two = np.flatnonzero(root != np.arange(len(names)))
    return pd.DataFrame({"path": path, "sig": np.concatenate((sigs, np.array(names, dtype=object)[two])),
                         "y": np.concatenate((y, np.array(names, dtype=object)[root[two]])),
                         "share": np.concatenate((same.max(axis=1) / TOKENS, np.full(len(two), np.nan)))})


def _next_paths(members: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
    """Longer paths of the classes of a block, by tokens that few classes of the path have.

    Tokens that a quarter of the leaders have, such as those of a passage that all texts of a path hold, would keep the
    path together; alike classes share most of their other tokens as well.  A class that has no others chooses among all."""
    if not len(members):
        return pd.DataFrame({"path": np.zeros(0, dtype=np.int64), "sig": []})
    tokens, sig = _tokens(members["sketch"]), members["sig"].to_numpy()
    common = np.zeros(tokens.shape, dtype=bool)
    if len(leaders):
        led = _tokens(leaders["m_sketch"].iloc[0])
        for t in range(TOKENS):
            values, n = np.unique(led[:, t], return_counts=True)
            common[:, t] = np.isin(tokens[:, t], values[n >= max(3, len(led) / 4)])
    common[common.all(axis=1)] = False
    rare = (~common).sum(axis=1)
    path = np.uint64(np.int64(members["path"].iloc[0]).view(np.uint64))
    with np.errstate(over="ignore"):
        u = mix64((tokens * _MIX) ^ path)
    below = np.minimum(2.0 ** 64 / (KEEP * rare), 2.0 ** 64 - 4096).astype(np.uint64)
    row, col = np.nonzero(~common & (u < below[:, None]))
    return pd.DataFrame({"path": mix64(u[row, col] ^ _MIX).view(np.int64), "sig": sig[row]})


def _with_leaders(members: DataFrame, leads, of, schema: str) -> DataFrame:
    """``of`` applied to the classes (path, sig, sketch, size) of every path, in blocks, each with all leaders of the path (about
    LEADERS, or LIMIT at most); ``leads`` says which classes lead."""
    blocks = F.ceil(F.col("size") / BLOCK)
    leaders = members.filter(leads).groupBy("path").agg(
        F.collect_list("sig").alias("m_sig"), F.collect_list("sketch").alias("m_sketch"), F.max(blocks).alias("n"))
    leaders = leaders.select(F.col("path").alias("of"), "m_sig", "m_sketch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("at"))
    dealt = members.select("path", F.pmod(F.xxhash64("sig"), blocks).alias("block"), "sig", "sketch")
    return dealt.groupBy("path", "block").cogroup(leaders.groupBy("of", "at")).applyInPandas(of, schema)


def _led(members: DataFrame, leads) -> DataFrame:
    return stored(_with_leaders(members, leads, _compared_with_leaders, "path long, sig binary, y binary, share double"), "jaccard-led")


def _by_hash():
    """About LEADERS classes of each path."""
    return F.pmod(F.xxhash64("path", "sig"), F.col("size")) < LEADERS


def _settled(large: DataFrame, sketches: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """(links found in paths over LIMIT, classes (path, sig, size) of those that must be split)."""
    members = large.join(sketches, "sig")
    led = _led(members, _by_hash())
    links = [led.filter("y IS NOT NULL").select(F.col("sig").alias("x"), "y")]
    left = stored(led.filter("y IS NULL").groupBy("path").agg(F.count(F.lit(1)).alias("open")), "jaccard-open")
    # classes that a leader is surely near are done: whatever is at THRESHOLD to them is near that leader too
    rest = led.filter((F.col("share") < SURE) & ~F.isnan("share")).join(left, "path")
    few = rest.filter(F.col("open") <= LIMIT)
    if few.head(1):
        sizes = few.groupBy("path").agg(F.count(F.lit(1)).alias("size"))
        again = _led(few.select("path", "sig", F.col("y").isNull().alias("open")).join(sizes, "path").join(sketches, "sig"),
                     F.col("open"))
        links.append(again.filter("y IS NOT NULL").select(F.col("sig").alias("x"), "y"))
    many = rest.filter(F.col("open") > LIMIT).select("path", "sig")
    if not many.head(1):
        return links, None
    return links, many.join(many.groupBy("path").agg(F.count(F.lit(1)).alias("size")), "path")


def _block_pairs(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """Classes of paths over LIMIT as blocks of about LIMIT, each with itself and each other of its path: a row for a pair."""
    own = F.pmod(F.xxhash64("sig"), F.ceil(F.col("size") / LIMIT))
    packed = stored(large.withColumn("own", own).join(sketches, "sig").groupBy("path", "own").agg(
        F.collect_list(F.struct("sig", "sketch")).alias("m")), "jaccard-blocks")
    one, two = packed.toDF("path", "a", "m"), packed.toDF("path", "b", "n")
    both = F.when(F.col("a") == F.col("b"), F.col("m")).otherwise(F.concat("m", "n"))
    second = F.when(F.col("a") == F.col("b"), 0).otherwise(F.size("m"))
    return (one.join(two, "path").filter("a <= b").select(both.alias("m"), second.alias("second"))
            .select(F.col("m.sig").alias("sig"), F.col("m.sketch").alias("sketch"), "second"))


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of blocks of the token matrices."""
    sets = a + b
    values, token = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.bincount(token) > 1
    number = np.cumsum(shared) - 1
    row, token = row[shared[token]], number[token[shared[token]]]
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    step = 4096
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    for lo in range(0, int(shared.sum()), step):
        i, j = np.searchsorted(token, (lo, lo + step))
        m = np.zeros((len(sets), min(step, int(shared.sum()) - lo)), dtype=np.float32)
        m[row[i:j], token[i:j] - lo] = 1
        out += m[:len(a)] @ m[len(a):].T
    return out


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For every class of a cell: links to texts of other classes of the cell, and its local root.

    A cell holds one block of a group against itself or against another block."""
    for g in grouped(batches, "cell"):
        sets = [np.frombuffer(x, dtype=np.uint64) for x in g["set"]]
        n, copies, side = np.array([len(s) for s in sets]), g["copies"].astype(np.int64), g["side"]
        one = np.flatnonzero(side == 0)
        two = np.flatnonzero(side == 1)
        own = not len(two) and bool(g["whole"][0])
        if not own and (not len(one) or not len(two)):
            continue
        if own:
            two = one
        both = _common([sets[i] for i in one], [sets[i] for i in two])
        linked = both / (n[one][:, None] + n[two] - both) >= THRESHOLD
        full = np.zeros((len(sets), len(sets)), dtype=bool)
        full[np.ix_(one, two)] = linked
        full |= full.T
        np.fill_diagonal(full, False)
        some = np.flatnonzero(full.any(axis=1))
        if not len(some):
            continue
        root = _roots(full[np.ix_(some, some)])
        yield pd.DataFrame({"x": g["sig"][some], "y": g["sig"][some[root]],
                            "links": (full[some] @ copies).astype(np.int64)})


def _blocked(rows: DataFrame, group: str, size: str) -> DataFrame:
    """Rows of groups over LIMIT sent to every pair of blocks that their own block is in.

    Adds cell, side (0: the lesser block) and whole (the block against itself)."""
    blocks = F.ceil(F.col(size) / LIMIT).cast("int")
    own = F.pmod(F.xxhash64("sig"), blocks.cast("long")).cast("int")
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    a, b = F.least("_own", "_other"), F.greatest("_own", "_other")
    name = F.concat_ws(":", F.hex(F.col(group)), a.cast("string"), b.cast("string"))
    return (rows.withColumn("cell", name).withColumn("side", (F.col("_own") > a).cast("int"))
            .withColumn("whole", a == b).drop("_own", "_other"))


def _dealt(df: DataFrame) -> DataFrame:
    """Rows of a cell together and in order (a cell has at most about 2 * LIMIT rows)."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, "cell").sortWithinPartitions("cell")


def runs_for(recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - CHANCE))


def classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, md5 (of the text), sig (of its shingle set), class_id, links for every row of ``docs`` (doc_id, text).

    Rows whose shingle sets have a Jaccard similarity of THRESHOLD or more are linked; a class is a connected
    component, its id the least doc_id.  ``links`` counts the other rows a row is linked to, copies among them.
    Texts without words are linked to equal texts only (null counts as empty).  Repeated rows are copies.
    Null doc_ids are no class id unless a class has no other.  A pair at the threshold is missed with
    a chance of 1 - ``recall`` at most, a closer one with less; no pair below it is linked."""
    spark = docs.sparkSession
    sets = stored(docs.select("doc_id", text_md5(F.col("text")).alias("md5"),
                              F.pandas_udf(_described, "sig binary, n int, sketch binary")("text").alias("d"))
                  .select("doc_id", "md5", "d.*"), "jaccard-sets")
    reps = stored(sets.groupBy("sig").agg(
        F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"),
        F.min("doc_id").alias("least"), F.min("md5").alias("md5")), "jaccard-classes")
    sketches = reps.filter("n > 0").select("sig", "sketch")

    rows = sketches.mapInPandas(_first_paths(runs_for(recall)), "path long, sig binary")
    leaves, large, links = None, None, []
    for depth in range(DEPTH):
        sizes = stored(rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "jaccard-paths")
        met = stored(rows.join(sizes, "path"), "jaccard-met")
        small = met.filter(F.col("size") <= LIMIT)
        leaves = small if leaves is None else leaves.union(small)
        large = met.filter(F.col("size") > LIMIT)
        if not large.head(1):
            large = None
            break
        more, large = _settled(large, sketches)
        links += more
        if large is None:
            break
        rows = stored(_with_leaders(large.join(sketches, "sig"), _by_hash(), _next_paths, "path long, sig binary"), "jaccard-split")
    rows = leaves.select("path", "sig").join(sketches, "sig").groupBy("path").agg(
        F.collect_list(F.struct("sig", "sketch")).alias("m")).select(
        F.col("m.sig").alias("sig"), F.col("m.sketch").alias("sketch"), F.lit(0).alias("second"))
    if large is not None:
        rows = rows.unionByName(_block_pairs(large, sketches))
    found = rows.mapInPandas(_candidates, "x binary, y binary")
    for more in links:
        found = found.union(more)
    groups = components(found, "jaccard-near").toDF("sig", "near")

    sizes = stored(groups.groupBy("near").agg(F.count(F.lit(1)).alias("size")), "jaccard-near-sizes")
    members = stored(groups.join(sizes, "near").join(reps.select("sig", "md5", "copies"), "sig"), "jaccard-members")
    wanted = members.select("md5").distinct()
    texts = docs.select(text_md5(F.col("text")).alias("md5"), "text")
    if members.count() <= FEW:  # only texts of groups are shuffled
        texts = texts.join(F.broadcast(wanted), "md5", "left_semi")
    texts = texts.groupBy("md5").agg(F.first("text").alias("text"))

    def as_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(set=[s.tobytes() for s in shingle_sets(list(b["text"]))])

    whole = members.join(texts, "md5").select("near", "size", "sig", "copies", "text").mapInPandas(
        as_sets, "near binary, size long, sig binary, copies long, set binary")
    dealt = _dealt(_blocked(whole, "near", "size").select("cell", "side", "whole", "sig", "copies", "set"))
    links = stored(dealt.mapInPandas(_verified, "x binary, y binary, links long"), "jaccard-links")
    roots = components(links, "jaccard-classes").toDF("sig", "root")
    number = links.groupBy(F.col("x").alias("sig")).agg(F.sum("links").alias("links"))
    own = roots.join(reps.select("sig", "least"), "sig")
    root_least = stored(own.groupBy("root").agg(F.min("least").alias("class_least")), "jaccard-roots")
    own = stored(own.join(root_least, "root").select("sig", "class_least"), "jaccard-own")
    known = stored(reps.join(own, "sig", "left").join(number, "sig", "left").select(
        "sig", F.coalesce("class_least", "least").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "jaccard-known")
    return sets.select("doc_id", "md5", "sig").join(known, "sig").select("doc_id", "md5", "sig", "class_id", "links")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each class: that of the least doc_id (nulls last), then the least text digest."""
    every = classes(docs.select("doc_id", "text"), **options)
    # a class without any id is told apart by its shingle set
    of = F.when(F.col("class_id").isNull(), F.col("sig"))
    best = every.groupBy("class_id", of.alias("_s")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "md5")).alias("k"))
    kept = stored(best.select("k.doc_id", "k.md5"), "jaccard-kept")
    # the row travels as one column, so no column of its own can clash
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_md5(F.col("text")).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("digest") == F.col("md5"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["id", "digest"]).select("row.*")
