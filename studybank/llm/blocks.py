"""Integer vectors packed into blocks of bounded bytes, and the rows of several blocks.

Vectors may differ in length; a block takes the bytes of its components, not of the longest row times the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of components (as longs) of a block; one row at least.
PACK_BYTES = 1 << 20


def component_bytes(rows: DataFrame) -> int:
    """Bytes of all components ``q``, as longs."""
    return rows.agg(F.sum(F.size("q").cast("long") * 8).alias("b")).first()["b"] or 0


def _narrow(x: np.ndarray) -> np.ndarray:
    """In the smallest integer type that holds all values."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    for t in (np.int16, np.int32):
        if np.iinfo(t).min <= low and high <= np.iinfo(t).max:
            return x.astype(t)
    return x


def packed(rows: DataFrame, cells: int, name: str, pack_bytes: int) -> DataFrame:
    """Blocks of rows (id, q and, if they have them, label and wants) as binary, of about ``pack_bytes`` of components, dealt
    over ``cells`` in a column ``name``."""
    from pyspark import TaskContext

    def flat(column) -> tuple[bytes, np.ndarray]:
        return np.diff(column.offsets.to_numpy()).astype(np.int32).tobytes(), column.flatten().to_numpy(zero_copy_only=False)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            sizes = np.diff(b.column("q").offsets.to_numpy())
            ends = np.cumsum(sizes.astype(np.int64) * 8)
            lo = 0
            while lo < b.num_rows:
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + pack_bytes, side="right")))
                part = b.slice(lo, hi - lo)
                lengths, values = flat(part.column("q"))
                values = _narrow(values.astype(np.int64))
                block = {name: pa.array([(at + 31 * seq) % cells], pa.int32()),
                         "ids": [part.column("id").to_numpy().astype(np.int64).tobytes()],
                         "lengths": [lengths], "kind": [values.dtype.str], "parts": [values.tobytes()]}
                if labelled:
                    block["labels"] = [part.column("label").to_numpy().astype(np.int64).tobytes()]
                if wanting:
                    counts, wants = flat(part.column("wants"))
                    block |= {"counts": [counts], "wants": [wants.astype(np.int64).tobytes()]}
                yield pa.RecordBatch.from_pydict(block)
                lo, seq = hi, seq + 1

    labelled, wanting = "label" in rows.columns, "wants" in rows.columns
    return rows.mapInArrow(pack, f"{name} int, ids binary, lengths binary, kind string, parts binary"
                           + ", labels binary" * labelled + ", counts binary, wants binary" * wanting)


class Rows:
    """Rows of one side of a cell: ids, components of any number each and, if packed, labels and wanted scores."""

    def __init__(self, packs: pd.DataFrame):
        def joined(name, kind):
            return np.concatenate([np.frombuffer(x, kind) for x in packs[name]] or [np.zeros(0, kind)])

        self.ids = joined("ids", np.int64)
        self.labels = joined("labels", np.int64) if "labels" in packs else None
        self.lengths = joined("lengths", np.int32).astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.parts = np.concatenate([np.frombuffer(x, k) for x, k in zip(packs["parts"], packs["kind"])] or [np.zeros(0, np.int16)])
        counts = joined("counts", np.int32) if "counts" in packs else []
        self.wants = np.split(joined("wants", np.int64), np.cumsum(counts)[:-1]) if len(counts) else []

    def slab(self, rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Components lo to hi of ``rows``, 0 where a row has none."""
        take = np.clip(self.lengths[rows] - lo, 0, hi - lo)
        out = np.zeros((len(rows), hi - lo), dtype=np.int64)
        i = np.repeat(np.arange(len(rows)), take)
        j = np.arange(len(i)) - np.repeat(np.cumsum(take) - take, take)
        out[i, j] = self.parts[self.first[rows][i] + lo + j]
        return out


