"""Registered contrastive batch-scoring queries.

Paired vectors: each embedding (image side) with its successor (text side),
shuffled into batches of 8 by the seeded hash order (last partial batch dropped).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from studybank.operators import contrastive as C
from studybank.operators.splits import assign_batches
from studybank.plans import bindings as B
from studybank.plans.registry import register, rounded

BATCH = 8
SCALE = C.INIT_SCALE

PAIRS = f"""
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pr AS (SELECT a.vec_id, a.e AS img, n.e AS txt FROM v a JOIN v n ON n.vec_id = a.vec_id + 1),
rk AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS r,
              count(*) OVER () AS n FROM pr),
p AS (SELECT CAST(floor(r / {BATCH}) AS INTEGER) AS batch_id, CAST(r % {BATCH} AS INTEGER) AS pos, img, txt
      FROM rk WHERE floor(r / {BATCH}) < floor(n / {BATCH})),
lg AS (SELECT a.batch_id, a.pos AS i, b.pos AS j, list_dot_product(a.img, b.txt) * {SCALE!r} AS logit,
              list_dot_product(a.img, b.img) AS ii, list_dot_product(a.txt, b.txt) AS tt,
              list_dot_product(a.img, b.txt) AS it, list_dot_product(a.txt, b.img) AS ti
       FROM p a JOIN p b ON a.batch_id = b.batch_id)
"""

SCORES = f"""
WITH {PAIRS},
rmx AS (SELECT batch_id, i, max(logit) AS mx FROM lg GROUP BY ALL),
cmx AS (SELECT batch_id, j, max(logit) AS mx FROM lg GROUP BY ALL),
rl AS (SELECT l.batch_id, l.i, any_value(r.mx) + ln(sum(exp(l.logit - r.mx))) AS lse
       FROM lg l JOIN rmx r ON r.batch_id = l.batch_id AND r.i = l.i GROUP BY l.batch_id, l.i),
cl AS (SELECT l.batch_id, l.j, any_value(c.mx) + ln(sum(exp(l.logit - c.mx))) AS lse
       FROM lg l JOIN cmx c ON c.batch_id = l.batch_id AND c.j = l.j GROUP BY l.batch_id, l.j),
dg AS (SELECT batch_id, i, logit FROM lg WHERE i = j),
ce AS (SELECT rl.batch_id, avg(rl.lse - dg.logit) AS a FROM rl JOIN dg ON dg.batch_id = rl.batch_id AND dg.i = rl.i
       GROUP BY rl.batch_id),
ce2 AS (SELECT cl.batch_id, avg(cl.lse - dg.logit) AS b FROM cl JOIN dg ON dg.batch_id = cl.batch_id AND dg.i = cl.j
        GROUP BY cl.batch_id),
ra AS (SELECT l.batch_id, l.i, min(l.j) AS am FROM lg l JOIN rmx r ON r.batch_id = l.batch_id AND r.i = l.i
       WHERE l.logit = r.mx GROUP BY l.batch_id, l.i),
ca AS (SELECT l.batch_id, l.j, min(l.i) AS am FROM lg l JOIN cmx c ON c.batch_id = l.batch_id AND c.j = l.j
       WHERE l.logit = c.mx GROUP BY l.batch_id, l.j),
acc AS (SELECT batch_id, avg(CASE WHEN am = i THEN 1.0 ELSE 0.0 END) AS a FROM ra GROUP BY batch_id),
acc2 AS (SELECT batch_id, avg(CASE WHEN am = j THEN 1.0 ELSE 0.0 END) AS b FROM ca GROUP BY batch_id),
sc AS (SELECT ce.batch_id, (ce.a + ce2.b) / 2 AS loss, (acc.a + acc2.b) / 2 AS accuracy
       FROM ce JOIN ce2 USING (batch_id) JOIN acc USING (batch_id) JOIN acc2 USING (batch_id))
"""


def _sinkhorn_sql(name: str, cost: str) -> str:
    """CTE chain: Sinkhorn targets ``<name>(batch_id, i, j, t)`` of a cost expression."""
    parts = [f"{name}_c AS (SELECT batch_id, i, j, {cost} AS c FROM lg)",
             f"{name}_0 AS (SELECT batch_id, i, j, exp((c - max(c) OVER (PARTITION BY batch_id)) / {C.K.SINKHORN_EPSILON!r}) AS p FROM {name}_c)",
             f"{name}_1 AS (SELECT batch_id, i, j, p / sum(p) OVER (PARTITION BY batch_id) AS p FROM {name}_0)"]
    prev = f"{name}_1"
    for r in range(C.K.SINKHORN_ROUNDS):
        parts.append(f"{name}_a{r} AS (SELECT batch_id, i, j, p / sum(p) OVER (PARTITION BY batch_id, j) "
                     f"/ count(*) OVER (PARTITION BY batch_id, j) AS p FROM {prev})")
        parts.append(f"{name}_b{r} AS (SELECT batch_id, i, j, p / sum(p) OVER (PARTITION BY batch_id, i) "
                     f"/ count(*) OVER (PARTITION BY batch_id, i) AS p FROM {name}_a{r})")
        prev = f"{name}_b{r}"
    parts.append(f"{name} AS (SELECT batch_id, i, j, p * count(*) OVER (PARTITION BY batch_id, i) AS t FROM {prev})")
    return ",\n".join(parts)


def _pairs(spark, sf_dir):
    v = B.vectors(spark, sf_dir)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("txt"))
    pairs = v.select("vec_id", F.col("embedding").alias("img")).join(nxt, "vec_id")
    return assign_batches(pairs, "vec_id", BATCH, seed=42)


def _batches(spark, sf_dir):
    return C.gather_batches(_pairs(spark, sf_dir))


def _round_arr(c):
    return F.transform(c, lambda x: F.round(x, 9))


@register("batch_logits", f"""
WITH {PAIRS}
SELECT batch_id, CAST(i AS INTEGER) AS i, list(round(logit, 9) ORDER BY j) AS logits FROM lg GROUP BY batch_id, i
""")
def q_batch_logits(spark, sf_dir):
    out = C.batch_logits(_batches(spark, sf_dir), SCALE)
    return out.select("batch_id", "i", _round_arr(F.col("logits")).alias("logits"))


@register("pairwise_similarities", f"""
WITH {PAIRS}
SELECT batch_id, CAST(i AS INTEGER) AS i, list(round(ii, 9) ORDER BY j) AS ii, list(round(tt, 9) ORDER BY j) AS tt,
       list(round(it, 9) ORDER BY j) AS it, list(round(ti, 9) ORDER BY j) AS ti
FROM lg GROUP BY batch_id, i
""")
def q_pairwise(spark, sf_dir):
    out = C.pairwise_similarities(_batches(spark, sf_dir))
    return out.select("batch_id", "i", *[_round_arr(F.col(c)).alias(c) for c in ("ii", "tt", "it", "ti")])


@register("symmetric_cross_entropy", SCORES + "SELECT batch_id, round(loss, 9) AS loss FROM sc")
def q_ce(spark, sf_dir):
    return rounded(C.batch_scores(_pairs(spark, sf_dir), SCALE).select("batch_id", "loss"))


@register("in_batch_accuracy", SCORES + "SELECT batch_id, round(accuracy, 9) AS accuracy FROM sc")
def q_acc(spark, sf_dir):
    return rounded(C.batch_scores(_pairs(spark, sf_dir), SCALE).select("batch_id", "accuracy"))


@register("validation_summary", SCORES + """
SELECT round(avg(loss), 9) AS val_loss, round(avg(accuracy), 9) AS val_acc,
       CAST(arg_min(batch_id, loss) AS BIGINT) AS best_batch, count(*) AS batches FROM sc
""")
def q_validation(spark, sf_dir):
    return rounded(C.validation_summary(C.batch_scores(_pairs(spark, sf_dir), SCALE)))


@register("optimal_transport_cost", f"""
WITH {PAIRS}
SELECT batch_id, CAST(i AS INTEGER) AS i, list(round(-(ii + tt + it), 9) ORDER BY j) AS img_cost,
       list(round(-(ii + tt + ti), 9) ORDER BY j) AS txt_cost
FROM lg GROUP BY batch_id, i
""")
def q_transport(spark, sf_dir):
    costs = C.transport_costs(_batches(spark, sf_dir))
    z = F.arrays_zip(F.col("img_cost").alias("a"), F.col("txt_cost").alias("b"))
    return costs.select("batch_id", F.posexplode(z).alias("i", "r")).select(
        "batch_id", F.col("i").cast("int").alias("i"),
        _round_arr(F.col("r.a")).alias("img_cost"), _round_arr(F.col("r.b")).alias("txt_cost"))


@register("sinkhorn", f"""
WITH {PAIRS}, {_sinkhorn_sql('ti_', '-(ii + tt + it)')}
SELECT batch_id, CAST(i AS INTEGER) AS i, list(round(t, 9) ORDER BY j) AS row, round(sum(t), 9) AS row_sum
FROM ti_ GROUP BY batch_id, i
""")
def q_sinkhorn(spark, sf_dir):
    """Sinkhorn targets of the image costs; each row sums to 1 (checked in tests
    against a NumPy restatement)."""
    sk = C.sinkhorn_targets(_pairs(spark, sf_dir), "img")
    return sk.select("batch_id", "i", _round_arr(F.col("row")).alias("row"),
                     F.round(F.aggregate("row", F.lit(0.0), lambda a, x: a + x), 9).alias("row_sum"))


@register("kl_distillation", f"""
WITH {PAIRS}, {_sinkhorn_sql('ti_', '-(ii + tt + it)')}, {_sinkhorn_sql('tx_', '-(ii + tt + ti)')},
zs AS (SELECT batch_id, i, j, 'i' AS side, it AS z FROM lg UNION ALL SELECT batch_id, i, j, 't', ti FROM lg),
mx AS (SELECT batch_id, i, side, max(z) AS m FROM zs GROUP BY ALL),
ls AS (SELECT zs.batch_id, zs.i, zs.side, any_value(mx.m) + ln(sum(exp(zs.z - mx.m))) AS lse
       FROM zs JOIN mx ON mx.batch_id = zs.batch_id AND mx.i = zs.i AND mx.side = zs.side
       GROUP BY zs.batch_id, zs.i, zs.side),
lp AS (SELECT zs.batch_id, zs.i, zs.j, zs.side, zs.z - ls.lse AS lp
       FROM zs JOIN ls ON ls.batch_id = zs.batch_id AND ls.i = zs.i AND ls.side = zs.side),
li AS (SELECT batch_id, i, j, lp FROM lp WHERE side = 'i'),
lt AS (SELECT batch_id, i, j, lp FROM lp WHERE side = 't'),
ki AS (SELECT a.batch_id, sum(CASE WHEN a.t > 0 THEN a.t * (ln(a.t) - l.lp) ELSE 0 END) / count(DISTINCT a.i) AS k
       FROM ti_ a JOIN li l ON l.batch_id = a.batch_id AND l.i = a.i AND l.j = a.j GROUP BY a.batch_id),
kt AS (SELECT a.batch_id, sum(CASE WHEN a.t > 0 THEN a.t * (ln(a.t) - l.lp) ELSE 0 END) / count(DISTINCT a.i) AS k
       FROM tx_ a JOIN lt l ON l.batch_id = a.batch_id AND l.i = a.i AND l.j = a.j GROUP BY a.batch_id)
SELECT CAST(ki.batch_id AS BIGINT) AS batch_id, round((ki.k + kt.k) / 2, 9) AS kl FROM ki JOIN kt USING (batch_id)
""")
def q_kl(spark, sf_dir):
    return rounded(C.batch_scores(_pairs(spark, sf_dir), SCALE).select("batch_id", "kl"))
