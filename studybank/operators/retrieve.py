"""Exact cosine top-k of every query against a bank, without collecting the bank.

One plan for every size (cost |Q|·|B|·d at most, emitted rows at most |Q|·k per
cell, never |Q|·|B|): both sides are packed where they lie into blocks of raw
components, sized by bytes and dealt over the rows and columns of a grid; every
group of queries meets every cell of the bank once, as in a blocked matrix
product.  The grid is rectangular: a bank vector is sent once for each group of
queries (``QUERY_BYTES``), a query once for each cell of the bank
(``BANK_BYTES``).  Within a cell the rows lie in tiles round pivots; a query keeps
a running heap of its k best and skips a tile whose radius puts every row of it
below the heap (angles obey the triangle inequality, so nothing is lost).  The final
top-k is a ``row_number() <= k`` window on ``query_id``, before whose shuffle Spark
puts a partial ``WindowGroupLimit``.  No vector reaches the driver, which only learns
the rows and components of both sides.

The top-k within each of many groups of the bank has |Q|·groups·k rows.  A group that is not
large lies in one cell, so these rows are final where they are made: they are ranked there, handed on
a few at a time and not shuffled.

Ties are broken by the smaller ``bank_id``; zero vectors score 0; rows without a
vector take no part.  Scores are computed in float64 so they agree with a SQL
evaluation to ~1e-15.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the queries and of the bank rows that meet in a cell, and of one packed block.
QUERY_BYTES, BANK_BYTES, PACK_BYTES = 1 << 24, 1 << 25, 1 << 20
#: Queries and bank rows that meet in a cell if the top-k is wanted for each group: a cell gives at most their product.
GROUP_QUERIES, GROUP_ROWS = 1024, 2048
#: Cells for each core, if groups lie whole in cells.
CORE_CELLS = 4
#: Queries scored at a time; bank rows of a tile.
QUERY_CHUNK, TILE_ROWS = 512, 2048
#: Rounding that a bound may be wrong by.
_SLACK = 1e-9


def _schema(group: str | None, group_type=T.LongType()) -> T.StructType:
    fields = [T.StructField("query_id", T.LongType(), False)]
    if group:
        fields.append(T.StructField(group, group_type, True))
    fields += [T.StructField("bank_id", T.LongType(), False),
               T.StructField("sim", T.DoubleType(), False)]
    return T.StructType(fields)


def _normalise(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(n > 0, m / np.where(n > 0, n, 1.0), 0.0)
    return out


def _packed(df: DataFrame, ident: str, cell: str, cells: int, rows: int | None, group: str | None = None) -> DataFrame:
    """Blocks of rows (``ident``, v[, group][, cell]) as binary, of about PACK_BYTES (``rows`` rows at most), dealt over ``cells``
    if the rows have no ``cell`` yet.

    A block holds one value of ``group`` and of ``cell``."""
    from pyspark import TaskContext
    own_cell = cell in df.columns
    alike = [c for c in (group, cell if own_cell else None) if c]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            sizes = np.diff(b.column("v").offsets.to_numpy())
            width = int(sizes.max(initial=0))
            if (sizes != width).any():
                raise ValueError("vectors of different lengths")
            most = max(1, min(rows or b.num_rows, PACK_BYTES // max(1, 8 * width)))
            cuts = set(range(0, b.num_rows, most)) | {b.num_rows}
            for c in alike:
                values = b.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                cuts |= set((np.flatnonzero(values[1:] != values[:-1]) + 1).tolist())
            ends = sorted(cuts)
            for lo, hi in zip(ends, ends[1:]):
                part = b.slice(lo, hi - lo)
                own = part.column("v").flatten().to_numpy(zero_copy_only=False)
                block = {cell: pa.array([(at + 31 * seq) % cells], pa.int64()),
                         "ids": [part.column(ident).to_numpy().astype(np.int64).tobytes()],
                         "width": pa.array([width], pa.int32()), "kind": [own.dtype.str], "parts": [own.tobytes()]}
                for c in alike:
                    block[c] = part.column(c).slice(0, 1)
                yield pa.RecordBatch.from_pydict(block)
                seq += 1

    fields = [T.StructField(cell, T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("width", T.IntegerType()),
              T.StructField("kind", T.StringType()), T.StructField("parts", T.BinaryType())]
    if group:
        fields.append(T.StructField(group, df.schema[group].dataType))
    return df.mapInArrow(pack, T.StructType(fields))


def _unpacked(packs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors of length 1 or 0) in the order of the ids."""
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in packs["ids"]])
    m = np.concatenate([np.frombuffer(x, kind).astype(np.float64).reshape(-1, width)
                        for x, kind, width in zip(packs["parts"], packs["kind"], packs["width"])])
    order = np.argsort(ids, kind="stable")
    return ids[order], _normalise(m[order])


def _tiles(unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(places, pivot, radius): rows of unit length by their nearest pivot, some rows spread over all.

    Every row lies within the radius (an angle) of its pivot; rows of length 0 have no angle, so their tile is never
    skipped."""
    n = len(unit)
    if n <= 2 * TILE_ROWS:
        return [(np.arange(n), np.zeros(unit.shape[1]), math.pi)]
    count = -(-n // TILE_ROWS)
    pivots = unit[np.linspace(0, n - 1, count).astype(np.int64)]
    near = np.empty(n, dtype=np.int64)
    cosine = np.empty(n)
    for lo in range(0, n, TILE_ROWS):
        s = unit[lo:lo + TILE_ROWS] @ pivots.T
        near[lo:lo + TILE_ROWS] = s.argmax(axis=1)
        cosine[lo:lo + TILE_ROWS] = s.max(axis=1)
    empty = ~unit.any(axis=1)
    out = []
    for p in range(count):
        places = np.flatnonzero(near == p)
        for lo in range(0, len(places), 2 * TILE_ROWS):
            own = places[lo:lo + 2 * TILE_ROWS]
            wide = empty[own].any() or not pivots[p].any()
            out.append((own, pivots[p], math.pi if wide else float(np.arccos(np.clip(cosine[own].min(), -1, 1)))))
    return out


def _local_topk(qids: np.ndarray, qn: np.ndarray, bids: np.ndarray, bn: np.ndarray,
                k: int) -> tuple[pd.DataFrame, int]:
    """Top-k (by sim desc, bank_id asc) of each query within one cell's bank rows, and how many pairs were scored."""
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    tiles, scored = _tiles(bn), 0
    pivots = np.stack([t[1] for t in tiles])
    radius = np.array([t[2] for t in tiles])
    for lo in range(0, len(qids), QUERY_CHUNK):
        q = qn[lo:lo + QUERY_CHUNK]
        angle = np.arccos(np.clip(q @ pivots.T, -1, 1)) - radius
        bound = np.where(radius < math.pi, np.cos(np.maximum(angle, 0)), 1.0) + _SLACK
        best = np.full((len(q), k), -np.inf)
        ids = np.full((len(q), k), np.iinfo(np.int64).max)
        for t in np.argsort(-bound.mean(axis=0), kind="stable"):
            live = np.flatnonzero(bound[:, t] >= best[:, k - 1])
            if not len(live):
                continue
            places = tiles[t][0]
            s = q[live] @ bn[places].T
            scored += s.size
            rows, cols = _highest(s, min(k, len(places)))
            add = s[rows, cols].reshape(len(live), -1)
            every = np.concatenate((best[live], add), axis=1)
            names = np.concatenate((ids[live], bids[places][cols].reshape(len(live), -1)), axis=1)
            order = np.lexsort((names, -every), axis=-1)[:, :k]
            best[live] = np.take_along_axis(every, order, axis=1)
            ids[live] = np.take_along_axis(names, order, axis=1)
        i, j = np.nonzero(best > -np.inf)
        for column, values in zip(found, (qids[lo:lo + QUERY_CHUNK][i], ids[i, j], best[i, j])):
            column.append(values)
    cols = [np.concatenate(c) for c in found]
    return pd.DataFrame({"query_id": cols[0], "bank_id": cols[1], "sim": cols[2]}), scored


def _highest(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest of each row; of ties, the first columns."""
    if k == s.shape[1]:
        return np.nonzero(np.ones_like(s, dtype=bool))
    kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
    above, ties = s > kth, s == kth
    need = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (ties & (np.cumsum(ties, axis=1) <= need)))


def _final_topk(scored: DataFrame, k: int, group: str | None = None) -> DataFrame:
    keys = ["query_id"] + ([group] if group else [])
    w = Window.partitionBy(*keys).orderBy(F.desc("sim"), F.asc("bank_id"))
    return (scored.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .select(*keys, F.col("rank").cast("int").alias("rank"), "bank_id", "sim"))


def _sizes(q: DataFrame, b: DataFrame) -> dict[str, tuple[int, int]]:
    """(rows, bytes as packed) of both sides, in one pass."""
    def side(df: DataFrame, name: str) -> DataFrame:
        each = 4 if isinstance(df.schema["v"].dataType.elementType, T.FloatType) else 8
        return df.select(F.lit(name).alias("side"), (F.size("v").cast("long") * each + 8).alias("n"))

    rows = side(q, "q").unionAll(side(b, "b")).groupBy("side").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    found = {r["side"]: (r["rows"], r["n"]) for r in rows.collect()}
    return {name: found.get(name, (0, 0)) for name in "qb"}


def _grid(sizes: dict[str, tuple[int, int]], cores: int, grouped: bool, block_rows: int | None) -> tuple[int, int]:
    """Groups of queries and cells of the bank, from the (rows, bytes) of both sides."""
    def blocks(side: str, most: int, rows: int | None = None) -> int:
        n, size = sizes[side]
        return max(1, math.ceil(size / most), math.ceil(n / rows) if rows else 1)

    groups = blocks("q", QUERY_BYTES, GROUP_QUERIES if grouped else None)
    cells = blocks("b", BANK_BYTES, GROUP_ROWS if grouped else None)
    if block_rows:
        # as many as there are blocks, if these are few: a cell for each core and side
        packs = {side: max(1, math.ceil(sizes[side][0] / block_rows)) for side in "qb"}
        return max(groups, min(cores, packs["q"])), max(cells, min(cores, packs["b"]))
    return groups, max(cells, min(cores, blocks("b", PACK_BYTES)))


def topk(query: DataFrame, bank: DataFrame, k: int, *, query_key: str = "query_id",
         bank_key: str = "bank_id", vec: str = "embs", group: str | None = None,
         block_rows: int | None = None) -> DataFrame:
    """Exact top-k bank rows per query: ``(query_id, [group,] rank, bank_id, sim)``.

    ``group`` (e.g. ``batch_id``) gives the top-k within each bank batch instead of over the whole bank; a batch lies whole
    in a cell, unless it has more than GROUP_ROWS rows: large ones are sorted and cut, and a cell of theirs has
    GROUP_QUERIES x GROUP_ROWS at most, as its rows to give grow with both.  ``block_rows`` sets the rows of the packed blocks instead of their bytes; how many
    blocks meet in a cell still goes by bytes, so the cells don't grow with the product of the blocks."""
    if k <= 0:
        raise ValueError("k must be positive")
    q = query.select(F.col(query_key).cast("long").alias("query_id"), F.col(vec).alias("v")).where("v IS NOT NULL")
    bcols = [F.col(bank_key).cast("long").alias("bank_id"), F.col(vec).alias("v")]
    if group:
        bcols.append(F.col(group))
    b = bank.select(*bcols).where("v IS NOT NULL")
    sizes = _sizes(q, b)

    cores = query.sparkSession.sparkContext.defaultParallelism
    if group:
        # each has more than GROUP_ROWS rows of the bank, so they are few
        large = b.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP_ROWS).select(F.col(group).alias("_large"))
        if large.isEmpty():
            return _whole_groups(q, b, k, group, sizes, cores, block_rows)
        same = F.col(group).eqNullSafe(F.col("_large"))
        cut = _grid_topk(q, b.join(large, same, "left_semi"), k, group, sizes, cores, block_rows)
        return _whole_groups(q, b.join(large, same, "left_anti"), k, group, sizes, cores, block_rows).unionByName(cut)
    return _grid_topk(q, b, k, group, sizes, cores, block_rows)


def _grid_topk(q: DataFrame, b: DataFrame, k: int, group: str | None, sizes: dict, cores: int, block_rows: int | None) -> DataFrame:
    """The top-k by scoring in the cells of the grid, merged by a window."""
    groups, cells = _grid(sizes, cores, group is not None, block_rows)
    if group:
        b = b.repartitionByRange(cells, group, "bank_id").sortWithinPartitions(group, "bank_id")
    qs = _packed(q, "query_id", "_g", groups, block_rows or (GROUP_QUERIES if group else None)).withColumn("_c", _every(cells))
    bs = _packed(b, "bank_id", "_c", cells, block_rows or (GROUP_ROWS if group else None), group).withColumn("_g", _every(groups))
    schema = _schema(group, b.schema[group].dataType if group else None)

    def score(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if len(queries) == 0 or len(rows) == 0:
            return pd.DataFrame(columns=schema.names)
        qids, qn = _unpacked(queries)
        parts = [(None, rows)] if not group else _by_value(rows, group)
        out = []
        for value, packs in parts:
            out.append(_local_topk(qids, qn, *_unpacked(packs), k)[0])
            if group:
                out[-1].insert(1, group, pd.Series([None if pd.isna(value) else value] * len(out[-1]), index=out[-1].index, dtype=object))
        return pd.concat(out)

    scored = qs.groupBy("_g", "_c").cogroup(bs.groupBy("_g", "_c")).applyInPandas(score, schema)
    return _final_topk(scored, k, group)


def _shares(sizes: dict[str, tuple[int, int]], cores: int) -> tuple[int, int]:
    """Groups of queries and cells of the bank by their bytes alone: what a cell gives isn't held, so few are enough."""
    n, size = sizes["b"]
    return (max(1, math.ceil(sizes["q"][1] / QUERY_BYTES)),
            max(1, math.ceil(size / BANK_BYTES), min(CORE_CELLS * cores, math.ceil(n / GROUP_ROWS))))


def _whole_groups(q: DataFrame, b: DataFrame, k: int, group: str, sizes: dict, cores: int, block_rows: int | None) -> DataFrame:
    """The top-k within groups of the bank that lie in one cell each: final and ranked where they are made.

    A query may come more than once; its rows are in one group of queries and share its k places."""
    groups, cells = _shares(sizes, cores)
    kind = b.schema[group].dataType
    if groups > 1:
        q = q.withColumn("_g", F.pmod(F.hash("query_id"), F.lit(groups)).cast("long")).repartition(groups, "_g").sortWithinPartitions("_g")
    b = b.withColumn("_c", F.pmod(F.hash(group), F.lit(cells)).cast("long"))
    b = b.repartition(cells, "_c").sortWithinPartitions("_c", group, "bank_id")
    qs = _packed(q, "query_id", "_g", groups, block_rows or GROUP_QUERIES).withColumn("_c", _every(cells))
    bs = _packed(b, "bank_id", "_c", cells, block_rows or GROUP_ROWS, group).withColumn("_g", _every(groups))
    both = bs.withColumn("_q", F.lit(False)).unionByName(qs.withColumns({group: F.lit(None).cast(kind), "_q": F.lit(True)}))
    schema = T.StructType([*_schema(group, kind).fields, T.StructField("rank", T.IntegerType(), False)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = pa.Table.from_batches(list(batches))
        side = packs.column("_q").to_numpy()
        blocks = packs.select(["ids", "width", "kind", "parts"]).to_pandas()
        if side.all() or not side.any():
            return
        qids, qn = _unpacked(blocks[side])
        again = bool((qids[1:] == qids[:-1]).any())
        values = packs.column(group).filter(pa.array(~side)).combine_chunks().dictionary_encode(null_encoding="encode")
        own, codes = blocks[~side], values.indices.to_numpy()
        for code, value in enumerate(values.dictionary):
            bids, bn = _unpacked(own[codes == code])
            for lo, hi in _by_query(qids, GROUP_QUERIES):
                found = _ranked(_local_topk(qids[lo:hi], qn[lo:hi], bids, bn, k)[0], k, again)
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(found["query_id"], pa.int64()), group: pa.repeat(value, len(found)),
                    "bank_id": pa.array(found["bank_id"], pa.int64()), "sim": pa.array(found["sim"], pa.float64()),
                    "rank": pa.array(found["rank"], pa.int32())})

    # more partitions than cells, so that few of them have two
    dealt = both.repartition(4 * groups * cells, "_g", "_c")
    top = dealt.groupBy("_g", "_c").applyInArrow(score, schema)
    return top.select("query_id", group, "rank", "bank_id", "sim")


def _by_query(qids: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` of the sorted ids; equal ones stay together."""
    lo = 0
    while lo < len(qids):
        hi = int(np.searchsorted(qids, qids[min(lo + most, len(qids)) - 1], side="right"))
        yield lo, hi
        lo = hi


def _ranked(found: pd.DataFrame, k: int, again: bool) -> pd.DataFrame:
    """The k best rows of each query with their ranks; a query's rows lie together, and in order unless it came ``again``."""
    if again:
        found = found.sort_values(["query_id", "sim", "bank_id"], ascending=[True, False, True], kind="stable")
    place = found.groupby("query_id", sort=False).cumcount()
    return found.assign(rank=place + 1)[place < k]


def _by_value(rows: pd.DataFrame, group: str) -> list[tuple]:
    """Rows of each value of ``group``, null among them."""
    codes, values = pd.factorize(rows[group], use_na_sentinel=False)
    return [(value, rows[codes == i]) for i, value in enumerate(values)]


def _every(blocks: int):
    """A row for each block of the other side."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))


def topk_cut(top: DataFrame, k: int, max_k: int | None = None) -> DataFrame:
    """Re-cut a stored top-``max_k`` result to ``k``; asking for more than was
    stored is an error rather than a silent truncation."""
    if max_k is not None and k > max_k:
        raise ValueError(f"k={k} exceeds the stored max_k={max_k}")
    return top.where(F.col("rank") <= k)


def dedupe_bank(bank: DataFrame, target: str = "target", scope: str = "global",
                batch: str = "batch_id", pos: str = "pos") -> DataFrame:
    """Keep one bank row per target text: the first by (batch, pos) overall
    (``scope='global'``) or the first within each batch (``scope='batch'``).

    Uses ``min(struct)`` per group, which aggregates partially on the map side,
    so a text repeated in a third of all rows does not land in one task."""
    if scope not in ("global", "batch"):
        raise ValueError("scope must be 'global' or 'batch'")
    keys = [target] if scope == "global" else [batch, target]
    others = [c for c in bank.columns if c not in (batch, pos, *keys)]
    first = F.min(F.struct(batch, pos, *others)).alias("_first")
    agg = bank.groupBy(*keys).agg(first)
    return agg.select(*[F.col(kk) for kk in keys],
                      *[F.col(f"_first.{c}").alias(c) for c in (batch, pos, *others)
                        if c not in keys]).select(*bank.columns)
