"""Batch embedding through pluggable encoders, pooling and projection.

An encoder is any object with ``name``, ``dim``, ``kind`` (``"text"`` or
``"image"``), ``load()`` and ``encode(pandas.Series) -> ndarray(n, dim)``.  It
is loaded once per task inside an Arrow pass; output vectors are L2-normalised.
Tokenisation stays JVM-side (``word_tokens``), and so does whatever an encoder's
optional ``prepare(Column) -> Column`` makes of the tokens or the image; the Python
side only turns numbers into vectors.

Bundled encoders are deterministic baselines (hashed n-grams for text, grid
means for images); a user plugs a real model in by registering a class with
the same protocol.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studybank.operators.text import word_tokens


class Encoder(Protocol):
    name: str
    dim: int
    kind: str

    def load(self) -> None: ...

    def encode(self, batch: pd.Series) -> np.ndarray: ...


def gram_bucket(gram: str, dim: int) -> int:
    return int(hashlib.md5(gram.encode("utf-8")).hexdigest()[:8], 16) % dim


class HashedNgramEncoder:
    """Counts of unigrams and bigrams hashed (md5 prefix) into ``dim`` buckets."""
    kind = "text"

    def __init__(self, dim: int = 64, name: str = "hashed-ngrams"):
        self.dim, self.name = dim, name

    def load(self) -> None:
        pass

    def prepare(self, tokens: Column) -> Column:
        """Bucket of every gram (``gram_bucket``), JVM-side."""
        def grams(t: Column) -> Column:
            pairs = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.size(t)),
                               lambda a, b: F.concat(a, F.lit(" "), b))
            return F.transform(F.concat(t, pairs), lambda g: F.pmod(
                F.conv(F.substring(F.md5(g.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(self.dim)).cast("int"))

        # bound once: named three times, the tokens would be split three times
        return F.transform(F.array(tokens), grams)[0]

    def encode(self, batch: pd.Series) -> np.ndarray:
        """Counts of buckets; all texts of the batch in one pass."""
        sizes = np.array([0 if b is None else len(b) for b in batch], dtype=np.int64)
        if not sizes.sum():
            return np.zeros((len(batch), self.dim))
        flat = np.concatenate([np.asarray(b, dtype=np.int64) for b in batch if b is not None])
        cells = np.repeat(np.arange(len(batch)), sizes) * self.dim + flat
        return np.bincount(cells, minlength=len(batch) * self.dim).reshape(len(batch), self.dim).astype(np.float64)


class GridMeanEncoder:
    """Mean intensity of a ``grid`` x ``grid`` partition of each channel of a
    decoded image (Spark image struct fields), 3 channels."""
    kind = "image"

    def __init__(self, grid: int = 4, name: str = "grid-means"):
        self.grid, self.name = grid, name
        self.dim = grid * grid * 3

    def load(self) -> None:
        pass

    def encode(self, batch: pd.Series) -> np.ndarray:
        """Images of one shape are one array."""
        out = np.zeros((len(batch), self.dim), dtype=np.float64)
        for rows, px in by_shape(batch):
            px = np.repeat(px, 3, axis=3) if px.shape[3] == 1 else px[..., :3]
            cells = [px[:, r][:, :, c].reshape(len(rows), -1, 3).mean(axis=1) if len(r) and len(c) else np.zeros((len(rows), 3))
                     for r in np.array_split(np.arange(px.shape[1]), self.grid)
                     for c in np.array_split(np.arange(px.shape[2]), self.grid)]
            out[rows] = np.concatenate(cells, axis=1)
        return out


def by_shape(batch: pd.Series):
    """(places, pixels as (n, height, width, channels)) of the images (struct rows) of each shape."""
    shapes: dict[tuple, list[int]] = {}
    for r, img in enumerate(batch):
        shapes.setdefault((int(img["height"]), int(img["width"]), int(img["nChannels"])), []).append(r)
    for shape, rows in shapes.items():
        raw = b"".join(bytes(batch.iloc[r]["data"]) for r in rows)
        yield np.array(rows), np.frombuffer(raw, dtype=np.uint8).reshape(len(rows), *shape)


REGISTRY = {"hashed-ngrams": HashedNgramEncoder, "grid-means": GridMeanEncoder}


def _normalise(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(n > 0, m / np.where(n > 0, n, 1.0), 0.0)


def _input(encoder, col: str) -> Column:
    """What ``encode`` gets: tokens of a text or the image struct, prepared by the encoder if it does that."""
    x = word_tokens(F.col(col)) if encoder.kind == "text" else F.col(col)
    return encoder.prepare(x) if hasattr(encoder, "prepare") else x


def _keys(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def embed(df: DataFrame, encoder, col: str, keys: list[str], out: str = "embs",
          precision: str = "float") -> DataFrame:
    """``keys + [out]``: L2-normalised vectors of ``col``.  Text columns are
    tokenised JVM-side first; image columns are the image struct."""
    src = df.select(*keys, _input(encoder, col).alias("_x"))
    dtype = np.float32 if precision == "float" else np.float64

    def run(batches):
        encoder.load()
        for pdf in _in_parts(batches):
            vecs = _normalise(encoder.encode(pdf["_x"])).astype(dtype)
            res = pdf[keys].copy()
            res[out] = list(vecs)
            yield res

    return src.mapInPandas(run, f"{_keys(df, keys)}, `{out}` array<{precision}>")


#: Rows of a batch that are encoded at a time.
PART_ROWS = 500


def _in_parts(batches):
    """Batches of at most PART_ROWS rows, as what an encoder makes beside its vectors grows with the rows it gets."""
    for pdf in batches:
        for lo in range(0, len(pdf), PART_ROWS):
            yield pdf.iloc[lo:lo + PART_ROWS].reset_index(drop=True)


#: Most models of one config table; more raise an error.
MAX_CONFIGS = 10_000
#: Most parameters of all projections of a config together, which every executor holds.
MAX_PARAMS = 50_000_000


@dataclass
class Model:
    """One side of a model: the encoder, and the projection (weights, bias) its vectors go through, if any."""

    case: str
    encoder: object
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None


def read_projection(spark: SparkSession, model_path: str, side: str) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of one side (``image`` or ``text``) from a model folder: Parquet rows (side, row, weights, bias), one
    for each output dimension.  At most MAX_PARAMS numbers are read."""
    rows = spark.read.schema("side string, row int, weights array<double>, bias double").parquet(model_path).where(F.col("side") == side)
    size = rows.agg(F.sum(F.size("weights").cast("long")).alias("n")).first()["n"] or 0
    if not 0 < size <= MAX_PARAMS:
        raise ValueError(f"{model_path} holds {size} weights for {side}")
    got = sorted(rows.collect(), key=lambda r: r["row"])
    return np.array([r["weights"] for r in got], dtype=np.float64), np.array([r["bias"] or 0.0 for r in got])


def models(spark: SparkSession, configs: DataFrame | list, side: str, registry=None) -> list[Model]:
    """The ``side`` (``image`` or ``text``) of every model of a config table (``read_model_config``).

    ``case`` names the model pair and its width (``out_<image[:3]><text[:3]>_<embed_dim>``).  An entry with
    ``add_projection`` has both its sides projected to ``embed_dim`` by the weights of its ``model_path``; another text encoder
    is made with that width, an image encoder with its own."""
    registry = registry or REGISTRY
    rows = configs if isinstance(configs, list) else [
        r.asDict() for r in configs.limit(MAX_CONFIGS + 1).collect()]
    if len(rows) > MAX_CONFIGS:
        raise ValueError(f"more than {MAX_CONFIGS} model configs")
    out, params = [], 0
    for cfg in rows:
        case = f"out_{cfg['image_encoder'][:3]}{cfg['text_encoder'][:3]}_{cfg['embed_dim']}"
        kind = registry[cfg[f"{side}_encoder"]]
        if not cfg["add_projection"]:
            out.append(Model(case, kind(dim=int(cfg["embed_dim"])) if side == "text" else kind()))
            continue
        weights, bias = read_projection(spark, cfg["model_path"], side)
        if weights.shape != (int(cfg["embed_dim"]), kind().dim):
            raise ValueError(f"{cfg['model_path']}: {side} weights of shape {weights.shape}")
        params += weights.size
        out.append(Model(case, kind(), weights, bias))
    if params > MAX_PARAMS:
        raise ValueError("projections too large to broadcast")
    return out


def embed_models(df: DataFrame, sides: list[Model], col: str, keys: list[str], embed_type: str, out: str = "embs",
                 precision: str = "float") -> DataFrame:
    """``keys + [case, embed_type, out]``: a row for every row and model, all models in one pass over ``df``.

    What encoders share (the same class and width) is encoded once; projected vectors are normalised after projection."""
    distinct = {(type(m.encoder).__name__, m.encoder.dim): m.encoder for m in sides}
    prepared: dict[str, tuple[str, Column]] = {}
    inputs = {}
    for name, encoder in distinct.items():
        x = _input(encoder, col)
        # encoders without a step of their own read one column
        label = f"_x{len(prepared)}" if hasattr(encoder, "prepare") else "_plain"
        inputs[name] = label
        prepared.setdefault(label, (label, x))
    src = df.select(*keys, *[x.alias(label) for label, x in prepared.values()])
    dtype = np.float32 if precision == "float" else np.float64
    shared = df.sparkSession.sparkContext.broadcast([(m.case, (type(m.encoder).__name__, m.encoder.dim), m.weights, m.bias) for m in sides])

    def run(batches):
        for encoder in distinct.values():
            encoder.load()
        for pdf in _in_parts(batches):
            raw = {name: encoder.encode(pdf[inputs[name]]) for name, encoder in distinct.items()}
            for case, name, weights, bias in shared.value:
                x = raw[name] if weights is None else raw[name] @ weights.T + bias
                res = pdf[keys].copy()
                res["case"], res["embed_type"] = case, embed_type
                res[out] = list(_normalise(x).astype(dtype))
                yield res

    return src.mapInPandas(run, f"{_keys(df, keys)}, `case` string, embed_type string, `{out}` array<{precision}>")


def embed_config(configs: DataFrame | list, texts: DataFrame | None = None, images: DataFrame | None = None,
                 key: str = "study_id", col: str = "report", image: str = "image", registry=None,
                 precision: str = "float") -> DataFrame:
    """(key, case, embed_type, embs) for every configured model: its text side over ``texts`` (``key``, ``col``), its image side over
    ``images`` (``key``, image struct).  One pass over either table, however many models there are."""
    parts = []
    for kind, df, c in (("text", texts, col), ("image", images, image)):
        if df is not None:
            parts.append(embed_models(df, models(df.sparkSession, configs, kind, registry), c, [key], kind, precision=precision))
    if not parts:
        raise ValueError("neither texts nor images")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def embed_all(text_df: DataFrame, configs: DataFrame | list, key: str = "study_id",
              col: str = "report", registry=None) -> DataFrame:
    """Text side of every configured model without projections, a pass for each (``embed_config`` has both sides in one);
    ``case`` names the model pair (``out_<image[:3]><text[:3]>``).  ``configs`` is the (bounded) model
    config table, e.g. from ``read_model_config``."""
    registry = registry or REGISTRY
    rows = configs if isinstance(configs, list) else [
        r.asDict() for r in configs.limit(MAX_CONFIGS + 1).collect()]
    if len(rows) > MAX_CONFIGS:
        raise ValueError(f"more than {MAX_CONFIGS} model configs")
    out = None
    for cfg in rows:
        enc = registry[cfg["text_encoder"]](dim=int(cfg["embed_dim"]))
        case = f"out_{cfg['image_encoder'][:3]}{cfg['text_encoder'][:3]}_{cfg['embed_dim']}"
        e = embed(text_df, enc, col, [key]).withColumn("case", F.lit(case)) \
            .withColumn("embed_type", F.lit("text"))
        out = e if out is None else out.unionByName(e)
    return out


#: Vocabulary bytes that are broadcast; a larger one is joined by a shuffle, with frequent tokens spread.
VOCAB_BYTES, SPREAD = 32 << 20, 32


def masked_mean_pool(tokens: DataFrame, vocab: DataFrame, key: str = "doc_id",
                     ids: str = "input_ids", mask: str = "attention_mask",
                     vocab_id: str = "token_id", vec: str = "vector", dim: int = 64,
                     out: str = "pooled") -> DataFrame:
    """sum(vector(token) x mask) / max(sum(mask), 1e-9) per document.

    A document's tokens are counted first; then each of its different tokens meets its vector once and the vectors, times
    their counts, are summed dimension by dimension in one aggregation, partly before its shuffle: no row for a
    dimension or for a repeated token.  A vocabulary of at most VOCAB_BYTES is broadcast; a larger one is joined
    by token, each token spread over SPREAD places so that a frequent one is no hot key.
    Unknown tokens add nothing but count.  Documents without unmasked tokens get a zero vector."""
    t = tokens.select(key, F.explode(F.arrays_zip(F.col(ids).alias("t"), F.col(mask).alias("m"))).alias("z")).where(
        F.col("z.m") == 1).groupBy(key, F.col("z.t").alias("_tid")).agg(F.count(F.lit(1)).alias("_n"))
    v = vocab.select(F.col(vocab_id).alias("_vid"), F.col(vec).alias("_v"))
    size = v.agg(F.sum(F.size("_v").cast("long") * 8 + 16).alias("b")).first()["b"] or 0
    if size <= VOCAB_BYTES:
        met = t.join(F.broadcast(v), F.col("_tid") == F.col("_vid"), "left")
    else:
        t = t.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(SPREAD)).cast("int"))
        v = v.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        met = t.join(v, (F.col("_tid") == F.col("_vid")) & (F.col("_s") == F.col("_p")), "left")
    sums = [F.sum(F.get("_v", F.lit(i)).cast("double") * F.col("_n")).alias(f"_d{i}") for i in range(dim)]
    pooled = met.groupBy(key).agg(F.sum("_n").alias("_total"), *sums)
    total = F.greatest(F.col("_total").cast("double"), F.lit(1e-9))
    pooled = pooled.select(key, F.array(*[F.coalesce(F.col(f"_d{i}"), F.lit(0.0)) / total for i in range(dim)]).alias(out))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return (tokens.select(key).distinct().join(pooled, key, "left")
            .select(key, F.coalesce(F.col(out), zeros).alias(out)))


def project(df: DataFrame, col: str, weights: np.ndarray, bias: np.ndarray | None = None,
            out: str = "projected", max_params: int = 50_000_000) -> DataFrame:
    """``W . x + b`` per row with NumPy on Arrow batches; ``W`` is a model
    parameter of checked size, broadcast once."""
    w = np.asarray(weights, dtype=np.float64)
    if w.size > max_params:
        raise ValueError("projection matrix too large to broadcast")
    b = np.zeros(w.shape[0]) if bias is None else np.asarray(bias, dtype=np.float64)
    shared = df.sparkSession.sparkContext.broadcast((w, b))
    keep = [c for c in df.columns if c != col]
    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    schema = (key_schema + ", " if key_schema else "") + f"`{out}` array<double>"

    def run(batches):
        wm, bv = shared.value
        for pdf in batches:
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[col]]) if len(pdf) else \
                np.zeros((0, wm.shape[1]))
            res = pdf[keep].copy()
            res[out] = list(x @ wm.T + bv)
            yield res

    return df.mapInPandas(run, schema)
