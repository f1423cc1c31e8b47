"""Registered retrieval queries: split, top-k, cosine, dedupe, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from studybank.functions.vectors import cosine, l2_normalise, norm
from studybank.operators.metrics import query_scores, retrieval_metrics, skip_accounting
from studybank.operators.retrieve import dedupe_bank, topk, topk_cut
from studybank.operators.splits import exact_sample
from studybank.plans import bindings as B
from studybank.plans import flagship
from studybank.plans.registry import register, rounded

MAX_K = 10
K = 2

# --- shared SQL pieces --------------------------------------------------------
ROLES = """
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) AS rk,
             count(*) OVER () AS n FROM v),
q AS (SELECT vec_id, e, label FROM r WHERE rk <= floor(n * CAST(0.1 AS DOUBLE))),
b AS (SELECT vec_id, e, label FROM r WHERE rk > floor(n * CAST(0.1 AS DOUBLE)))
"""

COS = ("CASE WHEN sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) > 0 "
       "THEN list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * "
       "sqrt(list_dot_product({b}, {b}))) ELSE 0.0 END")

TOPK = f"""
s AS (SELECT q.vec_id AS query_id, b.vec_id AS bank_id, {COS.format(a='q.e', b='b.e')} AS sim
      FROM q, b),
t AS (SELECT query_id, bank_id, sim,
             row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, bank_id) AS rank
      FROM s QUALIFY rank <= {MAX_K})
"""

SCORES_T = """
per AS (
  SELECT t.query_id,
         count(*) AS n_rows,
         count(bb.label) AS num_preds,
         any_value(qq.label) AS ql,
         count(DISTINCT CASE WHEN bb.label = qq.label THEN bb.label END) AS n_hits,
         count(DISTINCT coalesce(CAST(bb.label AS VARCHAR), '~')) AS n_vec
  FROM t JOIN v bb ON bb.vec_id = t.bank_id JOIN v qq ON qq.vec_id = t.query_id
  WHERE t.rank <= {k} GROUP BY t.query_id),
sc AS (
  SELECT *, CASE WHEN num_preds = 0 THEN 'no_bank_labels'
                 WHEN ql IS NULL THEN 'no_query_labels' ELSE 'evaluated' END AS status
  FROM per)
"""
SCORES = SCORES_T.format(k=K)


def metrics_sql(k: int, extra: str = "") -> str:
    """Flagship summary row for any k (``extra``: more select items)."""
    return f"""
WITH {ROLES}, {TOPK}, {SCORES_T.format(k=k)},
m AS (
  SELECT count(*) AS n_all,
         sum(CASE WHEN status = 'evaluated' AND n_hits > 0 THEN 1 ELSE 0 END) AS hits,
         avg(CASE WHEN status = 'evaluated' THEN n_hits / num_preds END) AS p,
         avg(CASE WHEN status = 'evaluated' THEN n_hits / 1.0 END) AS r,
         avg(CASE WHEN status = 'evaluated' THEN CAST(n_rows - n_vec AS DOUBLE) END) AS d,
         sum(CASE WHEN status = 'evaluated' THEN 1 ELSE 0 END) AS ev
  FROM sc)
SELECT round(hits / n_all, 9) AS flat_hit, CAST(hits AS BIGINT) AS hits,
       round(p, 9) AS precision, round(r, 9) AS recall,
       round(CASE WHEN p + r = 0 THEN NULL ELSE 2 * p * r / (p + r) END, 9) AS f1,
       round(d, 9) AS duplicates, CAST({k} AS INTEGER) AS k, CAST(ev AS BIGINT) AS test_instances{extra}
FROM m
"""


def _roles(spark, sf_dir):
    r = flagship.roles(spark, sf_dir)
    return r.where(F.col("role") == "query"), r.where(F.col("role") == "bank")


@register("retrieval_metrics", f"""
WITH {ROLES}, {TOPK}, {SCORES},
m AS (
  SELECT count(*) AS n_all,
         sum(CASE WHEN status = 'evaluated' AND n_hits > 0 THEN 1 ELSE 0 END) AS hits,
         avg(CASE WHEN status = 'evaluated' THEN n_hits / num_preds END) AS p,
         avg(CASE WHEN status = 'evaluated' THEN n_hits / 1.0 END) AS r,
         avg(CASE WHEN status = 'evaluated' THEN CAST(n_rows - n_vec AS DOUBLE) END) AS d,
         sum(CASE WHEN status = 'evaluated' THEN 1 ELSE 0 END) AS ev
  FROM sc)
SELECT round(hits / n_all, 9) AS flat_hit, CAST(hits AS BIGINT) AS hits,
       round(p, 9) AS precision, round(r, 9) AS recall,
       round(CASE WHEN p + r = 0 THEN NULL ELSE 2 * p * r / (p + r) END, 9) AS f1,
       round(d, 9) AS duplicates, CAST({K} AS INTEGER) AS k, CAST(ev AS BIGINT) AS test_instances
FROM m
""")
def q_retrieval_metrics(spark, sf_dir):
    return rounded(flagship.retrieval_eval(spark, sf_dir, k=K, max_k=MAX_K))


@register("topk_merge", f"""
WITH {ROLES}, {TOPK}
SELECT query_id, CAST(rank AS INTEGER) AS rank, bank_id, round(sim, 9) AS sim FROM t
""")
def q_topk_merge(spark, sf_dir):
    q, b = _roles(spark, sf_dir)
    return rounded(topk(q, b, MAX_K, query_key="vec_id", bank_key="vec_id", vec="embedding"))


@register("join_similarity", f"""
WITH {ROLES}, {TOPK}
SELECT query_id, CAST(rank AS INTEGER) AS rank, bank_id, round(sim, 9) AS sim FROM t
""")
def q_join_similarity(spark, sf_dir):
    """The same scoring over many small blocks."""
    q, b = _roles(spark, sf_dir)
    return rounded(topk(q, b, MAX_K, query_key="vec_id", bank_key="vec_id", vec="embedding", block_rows=64))


@register("topk_cut", f"""
WITH {ROLES}, {TOPK}
SELECT query_id, CAST(rank AS INTEGER) AS rank, bank_id, round(sim, 9) AS sim FROM t
WHERE rank <= {K}
""")
def q_topk_cut(spark, sf_dir):
    q, b = _roles(spark, sf_dir)
    top = topk(q, b, MAX_K, query_key="vec_id", bank_key="vec_id", vec="embedding")
    return rounded(topk_cut(top, K, MAX_K))


# bank "files": the bank is stored in files of 100 vectors (by vec_id range)
@register("topk_per_batch", f"""
WITH {ROLES},
s AS (SELECT q.vec_id AS query_id, CAST(floor(b.vec_id / 100) AS INTEGER) AS batch_id,
             b.vec_id AS bank_id, {COS.format(a='q.e', b='b.e')} AS sim FROM q, b),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, batch_id ORDER BY sim DESC, bank_id)
      AS rank FROM s QUALIFY rank <= {MAX_K})
SELECT query_id, batch_id, CAST(rank AS INTEGER) AS rank, bank_id, round(sim, 9) AS sim FROM t
""")
def q_topk_per_batch(spark, sf_dir):
    q, b = _roles(spark, sf_dir)
    b = b.withColumn("batch_id", F.floor(F.col("vec_id") / 100).cast("int"))
    return rounded(topk(q, b, MAX_K, query_key="vec_id", bank_key="vec_id",
                        vec="embedding", group="batch_id"))


@register("cosine_similarity", f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.vec_id, round({COS.format(a='a.e', b='n.e')}, 9) AS sim
FROM v a JOIN v n ON n.vec_id = a.vec_id + 1
""")
def q_cosine(spark, sf_dir):
    """Cosine of each vector with its successor (an equi-join, no pair explosion)."""
    v = B.vectors(spark, sf_dir)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("nxt"))
    return rounded(v.join(nxt, "vec_id").select("vec_id", cosine("embedding", "nxt").alias("sim")))


@register("l2_normalise", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS nrm FROM v)
SELECT vec_id, round(nrm, 9) AS norm_in,
       list_transform(e, lambda x: round(CASE WHEN nrm > 0 THEN x / nrm ELSE 0.0 END, 9)) AS unit
FROM s
""")
def q_l2(spark, sf_dir):
    v = B.vectors(spark, sf_dir)
    unit = l2_normalise("embedding", element_type="double")
    return v.select("vec_id", F.round(norm("embedding"), 9).alias("norm_in"),
                    F.transform(unit, lambda x: F.round(x, 9)).alias("unit"))


@register("dedupe_keep_first", """
WITH bank AS (
  SELECT CAST(floor(doc_id / 100) AS INTEGER) AS batch_id, CAST(doc_id - 100 * floor(doc_id / 100) AS INTEGER) AS pos,
         's' || CAST(doc_id AS VARCHAR) AS study_id, text AS target FROM documents)
SELECT batch_id, pos, study_id, target FROM bank
QUALIFY row_number() OVER (PARTITION BY target ORDER BY batch_id, pos) = 1
""")
def q_dedupe(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    bank = d.select(F.floor(F.col("doc_id") / 100).cast("int").alias("batch_id"),
                    (F.col("doc_id") - F.floor(F.col("doc_id") / 100) * 100).cast("int").alias("pos"),
                    F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("study_id"),
                    F.col("text").alias("target"))
    return dedupe_bank(bank, "target", scope="global")


@register("dedupe_keep_first_batch", """
WITH bank AS (
  SELECT CAST(floor(doc_id / 100) AS INTEGER) AS batch_id, CAST(doc_id - 100 * floor(doc_id / 100) AS INTEGER) AS pos,
         's' || CAST(doc_id AS VARCHAR) AS study_id, text AS target FROM documents)
SELECT batch_id, pos, study_id, target FROM bank
QUALIFY row_number() OVER (PARTITION BY batch_id, target ORDER BY pos) = 1
""")
def q_dedupe_batch(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    bank = d.select(F.floor(F.col("doc_id") / 100).cast("int").alias("batch_id"),
                    (F.col("doc_id") - F.floor(F.col("doc_id") / 100) * 100).cast("int").alias("pos"),
                    F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("study_id"),
                    F.col("text").alias("target"))
    return dedupe_bank(bank, "target", scope="batch")


def _scores(spark, sf_dir):
    q, b = _roles(spark, sf_dir)
    top = topk_cut(topk(q, b, MAX_K, query_key="vec_id", bank_key="vec_id", vec="embedding"),
                   K, MAX_K)
    labels = B.vector_labels(spark, sf_dir)
    return query_scores(q.select(F.col("vec_id").alias("query_id")), top, labels, labels)


@register("overlap_precision_recall", f"""
WITH {ROLES}, {TOPK}, {SCORES}
SELECT query_id, status,
       round(CASE WHEN status = 'evaluated' THEN n_hits / num_preds END, 9) AS precision,
       round(CASE WHEN status = 'evaluated' THEN n_hits / 1.0 END, 9) AS recall,
       status = 'evaluated' AND n_hits > 0 AS flat_hit
FROM sc
""")
def q_overlap(spark, sf_dir):
    return rounded(_scores(spark, sf_dir).select("query_id", "status", "precision", "recall",
                                                 "flat_hit"))


@register("class_hits", f"""
WITH {ROLES}, {TOPK}, {SCORES}
SELECT query_id, CAST(n_hits AS INTEGER) AS n_hits,
       CASE WHEN n_hits > 0 THEN [CAST(ql AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END AS hit_classes
FROM sc
""")
def q_class_hits(spark, sf_dir):
    return _scores(spark, sf_dir).select("query_id", "n_hits", "hit_classes")


@register("count_matches", f"""
WITH {ROLES}, {TOPK}, {SCORES}
SELECT query_id, CAST(n_rows AS INTEGER) AS n_rows, CAST(num_preds AS INTEGER) AS num_preds,
       CAST(CASE WHEN ql IS NULL THEN 0 ELSE 1 END AS INTEGER) AS query_cells
FROM sc
""")
def q_count_matches(spark, sf_dir):
    return _scores(spark, sf_dir).select("query_id", "n_rows", "num_preds", "query_cells")


@register("distinct_vectors", f"""
WITH {ROLES}, {TOPK}, {SCORES}
SELECT query_id, CAST(n_rows - n_vec AS INTEGER) AS duplicates FROM sc WHERE status = 'evaluated'
""")
def q_distinct_vectors(spark, sf_dir):
    return _scores(spark, sf_dir).where(F.col("status") == "evaluated").select(
        "query_id", F.col("duplicates").cast("int").alias("duplicates"))


@register("skip_accounting", f"""
WITH {ROLES}, {TOPK}, {SCORES}
SELECT status, count(*) AS queries FROM sc GROUP BY status
""")
def q_skip(spark, sf_dir):
    return skip_accounting(_scores(spark, sf_dir))


@register("join_query_result_labels", f"""
WITH {ROLES}, {TOPK}
SELECT t.query_id, CAST(t.rank AS INTEGER) AS rank, t.bank_id, qq.label AS query_label,
       bb.label AS row_label, coalesce(qq.label = bb.label, false) AS same
FROM t JOIN v qq ON qq.vec_id = t.query_id JOIN v bb ON bb.vec_id = t.bank_id
WHERE t.rank <= {K}
""")
def q_join_query_result_labels(spark, sf_dir):
    q, b = _roles(spark, sf_dir)
    top = topk_cut(topk(q, b, MAX_K, query_key="vec_id", bank_key="vec_id", vec="embedding"),
                   K, MAX_K)
    v = B.vectors(spark, sf_dir)
    ql = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    bl = v.select(F.col("vec_id").alias("bank_id"), F.col("label").alias("row_label"))
    return (top.join(ql, "query_id").join(bl, "bank_id")
            .select("query_id", "rank", "bank_id", "query_label", "row_label",
                    F.coalesce(F.col("query_label") == F.col("row_label"), F.lit(False))
                    .alias("same")))


@register("sample_queries", """
SELECT vec_id FROM embeddings
QUALIFY row_number() OVER (ORDER BY md5('7:' || CAST(vec_id AS VARCHAR)), vec_id) <= 50
""")
def q_sample_queries(spark, sf_dir):
    """Fixed-size query sample (the evaluation default, 50 queries)."""
    return exact_sample(B.vectors(spark, sf_dir).select("vec_id"), "vec_id", n=50, seed=7)


@register("exact_sample", """
SELECT doc_id FROM documents
QUALIFY row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id)
        <= floor(count(*) OVER () * CAST(0.25 AS DOUBLE))
""")
def q_exact_sample(spark, sf_dir):
    return exact_sample(B.table(spark, sf_dir, "documents").select("doc_id"), "doc_id",
                        ratio=0.25, seed=42)
