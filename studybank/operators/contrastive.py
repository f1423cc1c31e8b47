"""In-batch contrastive scoring of paired image / text vectors.

Input: ``(batch_id, pos, img, txt)`` with L2-normalised vectors and a bounded
batch size (``assign_batches`` gives exactly B rows per batch).  Each batch is
gathered into one row (B vectors per side, bounded by construction) and every
B x B matrix is computed there with native higher-order functions, so no pair
rows are ever emitted and every batch is scored in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studybank import constants as K
from studybank.functions.vectors import dot

INIT_SCALE = math.exp(math.log(1.0 / K.CONTRASTIVE_INIT_TEMPERATURE))


def gather_batches(pairs: DataFrame, batch: str = "batch_id", pos: str = "pos",
                   img: str = "img", txt: str = "txt") -> DataFrame:
    """One row per batch: ``imgs``/``txts`` arrays in ``pos`` order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(img).alias("i"),
                                                 F.col(txt).alias("t"))))
    return pairs.groupBy(batch).agg(items.alias("_it")).select(
        batch, F.transform("_it", lambda x: x["i"]).alias("imgs"),
        F.transform("_it", lambda x: x["t"]).alias("txts"))


def _matrix(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: dot(x, y) * F.lit(scale)))


def _row_sum(row: Column) -> Column:
    return F.aggregate(row, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def batch_logits(batches: DataFrame, scale: float = INIT_SCALE) -> DataFrame:
    """``(batch_id, i, logits)``: row i of img . txt^T x scale."""
    m = _matrix(F.col("imgs"), F.col("txts"), scale)
    return batches.select("batch_id", F.posexplode(m).alias("i", "logits")).select(
        "batch_id", F.col("i").cast("int").alias("i"), "logits")


def pairwise_similarities(batches: DataFrame) -> DataFrame:
    """``(batch_id, i, ii, tt, it, ti)`` rows of the four similarity matrices."""
    mats = batches.select(
        "batch_id",
        _matrix(F.col("imgs"), F.col("imgs")).alias("ii"),
        _matrix(F.col("txts"), F.col("txts")).alias("tt"),
        _matrix(F.col("imgs"), F.col("txts")).alias("it"),
        _matrix(F.col("txts"), F.col("imgs")).alias("ti"))
    zipped = F.arrays_zip("ii", "tt", "it", "ti")
    return mats.select("batch_id", F.posexplode(zipped).alias("i", "r")).select(
        "batch_id", F.col("i").cast("int").alias("i"), F.col("r.ii").alias("ii"),
        F.col("r.tt").alias("tt"), F.col("r.it").alias("it"), F.col("r.ti").alias("ti"))


def _stack(col) -> "np.ndarray":
    return np.stack([np.asarray(v, dtype=np.float64) for v in col])


def _lse_rows(x: "np.ndarray") -> "np.ndarray":
    mx = x.max(axis=1, keepdims=True)
    return (mx + np.log(np.exp(x - mx).sum(axis=1, keepdims=True)))[:, 0]


def _ce_np(logits: "np.ndarray") -> float:
    return float(np.mean(_lse_rows(logits) - np.diag(logits)))


def _acc_np(logits: "np.ndarray") -> float:
    return float(np.mean(np.argmax(logits, axis=1) == np.arange(len(logits))))


def sinkhorn_np(cost: "np.ndarray", eps: float = K.SINKHORN_EPSILON,
                rounds: int = K.SINKHORN_ROUNDS) -> "np.ndarray":
    """Sinkhorn soft assignment of one square cost matrix (rows sum to 1)."""
    p = np.exp((cost - cost.max()) / eps)
    p = p / p.sum()
    n = p.shape[0]
    for _ in range(rounds):
        p = p / p.sum(axis=0, keepdims=True) / n
        p = p / p.sum(axis=1, keepdims=True) / n
    return p * n


def _kl_np(target: "np.ndarray", logits: "np.ndarray", temp: float) -> float:
    z = logits * temp
    logp = z - _lse_rows(z)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(target > 0, target * (np.log(np.where(target > 0, target, 1.0)) - logp), 0.0)
    return float(terms.sum() / len(target))


SCORE_SCHEMA = "batch_id long, loss double, accuracy double, kl double"


def batch_scores(pairs: DataFrame, scale: float = INIT_SCALE, temp: float = 1.0,
                 eps: float = K.SINKHORN_EPSILON, rounds: int = K.SINKHORN_ROUNDS,
                 batch: str = "batch_id") -> DataFrame:
    """``(batch_id, loss, accuracy, kl)`` per batch of paired vectors
    ``(batch_id, pos, img, txt)``: symmetric cross entropy of the scaled logits
    against the diagonal, mean of both argmax accuracies (ties: lowest index)
    and the Sinkhorn-target KL term.  Dense B x B algebra runs in NumPy per
    batch (``applyInPandas``; a batch is bounded by the batch size)."""
    def score(pdf):
        pdf = pdf.sort_values("pos")
        img, txt = _stack(pdf["img"]), _stack(pdf["txt"])
        raw = img @ txt.T
        logits = raw * scale
        loss = (_ce_np(logits) + _ce_np(logits.T)) / 2
        acc = (_acc_np(logits) + _acc_np(logits.T)) / 2
        ii, tt, ti = img @ img.T, txt @ txt.T, txt @ img.T
        t_img = sinkhorn_np(-(ii + tt + raw), eps, rounds)
        t_txt = sinkhorn_np(-(ii + tt + ti), eps, rounds)
        kl = (_kl_np(t_img, raw, temp) + _kl_np(t_txt, raw.T, temp)) / 2
        return pd.DataFrame({"batch_id": [int(pdf[batch].iloc[0])], "loss": [loss],
                             "accuracy": [acc], "kl": [kl]})

    src = pairs.select(F.col(batch).cast("long").alias("batch_id"), "pos", "img", "txt")
    return src.groupBy("batch_id").applyInPandas(score, SCORE_SCHEMA)


def sinkhorn_targets(pairs: DataFrame, side: str = "img", eps: float = K.SINKHORN_EPSILON,
                     rounds: int = K.SINKHORN_ROUNDS) -> DataFrame:
    """``(batch_id, i, row)``: Sinkhorn targets of the image (or text) cost."""
    def run(pdf):
        pdf = pdf.sort_values("pos")
        img, txt = _stack(pdf["img"]), _stack(pdf["txt"])
        third = img @ txt.T if side == "img" else txt @ img.T
        t = sinkhorn_np(-(img @ img.T + txt @ txt.T + third), eps, rounds)
        return pd.DataFrame({"batch_id": int(pdf["batch_id"].iloc[0]),
                             "i": np.arange(len(t), dtype=np.int32), "row": list(t)})

    src = pairs.select(F.col("batch_id").cast("long").alias("batch_id"), "pos", "img", "txt")
    return src.groupBy("batch_id").applyInPandas(run, "batch_id long, i int, row array<double>")


def transport_costs(batches: DataFrame) -> DataFrame:
    """Image and text cost matrices: -(ii + tt + it) and -(ii + tt + ti)."""
    ii = _matrix(F.col("imgs"), F.col("imgs"))
    tt = _matrix(F.col("txts"), F.col("txts"))
    it = _matrix(F.col("imgs"), F.col("txts"))
    ti = _matrix(F.col("txts"), F.col("imgs"))
    staged = batches.select("batch_id", ii.alias("ii"), tt.alias("tt"), it.alias("it"),
                            ti.alias("ti"))

    def cost(third: str) -> Column:
        return F.transform("ii", lambda row, i: F.transform(
            row, lambda x, j: -(x + F.col("tt")[i][j] + F.col(third)[i][j])))

    return staged.select("batch_id", cost("it").alias("img_cost"), cost("ti").alias("txt_cost"))


def validation_summary(scores: DataFrame) -> DataFrame:
    """Mean loss and accuracy over batches and the batch with the lowest loss."""
    return scores.agg(F.avg("loss").alias("val_loss"), F.avg("accuracy").alias("val_acc"),
                      F.min_by("batch_id", F.struct("loss", "batch_id")).alias("best_batch"),
                      F.count(F.lit(1)).cast("long").alias("batches"))
