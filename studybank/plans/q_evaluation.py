"""Registered queries of the whole evaluation: texts counted once, labels by level, BLEU, run columns, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from studybank.plans import bindings as B
from studybank.plans import evaluation, flagship
from studybank.plans.q_retrieval import COS
from studybank.plans.registry import register, rounded
from studybank.session import cut_lineage, shared_dir
from studybank.sources import readers as R
from studybank.sources import writers as W

K, MAX_K = 2, 10
RUN = evaluation.Run(bank="embeddings/bank", query="embeddings/query", test_size=50, random_state=3)

INPUT = f"""
x AS (SELECT v.vec_id, 's' || CAST(v.vec_id // 2 AS VARCHAR) AS study_id, v.vec_id // 100 AS batch_id, v.label,
             coalesce(d.text, 'vector ' || CAST(v.vec_id AS VARCHAR)) AS target, CAST(v.embedding AS DOUBLE[]) AS e,
             row_number() OVER (ORDER BY md5('42:' || CAST(v.vec_id AS VARCHAR)), v.vec_id) AS rk, count(*) OVER () AS n
      FROM embeddings v LEFT JOIN documents d ON d.doc_id = v.vec_id),
q AS (SELECT * FROM x WHERE rk <= floor(n * CAST(0.1 AS DOUBLE))
      QUALIFY row_number() OVER (ORDER BY md5('{RUN.random_state}:' || CAST(vec_id AS VARCHAR)), vec_id) <= {RUN.test_size}),
cell AS (SELECT doc_id AS vec_id, 'quality' AS cat, CASE WHEN doc_id % 5 = 0 AND quality IS NOT NULL THEN -1 ELSE quality END AS vals FROM labels
         UNION ALL SELECT doc_id, 'toxic', CASE WHEN doc_id % 5 = 0 AND toxic IS NOT NULL THEN -1 ELSE toxic END FROM labels
         UNION ALL SELECT vec_id, 'group ' || CAST(label % 4 AS VARCHAR), 1 - label % 3 FROM embeddings WHERE label IS NOT NULL),
long AS (SELECT x.study_id AS mimic_id, x.target AS sents, cat, vals FROM x JOIN cell USING (vec_id)),
study AS (SELECT mimic_id, cat, max(vals) AS val FROM long WHERE vals IS NOT NULL GROUP BY ALL),
sentence AS (SELECT mimic_id, sents, cat, max(vals) AS val FROM long WHERE vals IS NOT NULL GROUP BY ALL)
"""


def scores_sql(unique: bool, bank_level: str) -> str:
    """Common table expressions up to a row of scores a query (sc), for either kind of bank."""
    first = "QUALIFY row_number() OVER (PARTITION BY batch_id, target ORDER BY vec_id) = 1" if unique else ""
    same = "l.mimic_id = b.study_id" + (" AND l.sents = b.target" if bank_level == "sentence" else "")
    return f"""
{INPUT},
b AS (SELECT * FROM x WHERE rk > floor(n * CAST(0.1 AS DOUBLE)) {first}),
t AS (SELECT query_id, bank_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, bank_id) AS rank
      FROM (SELECT q.vec_id AS query_id, b.vec_id AS bank_id, {COS.format(a='q.e', b='b.e')} AS sim FROM q, b)
      QUALIFY rank <= {K}),
qc AS (SELECT q.vec_id AS query_id, l.cat, l.val FROM q JOIN study l ON l.mimic_id = q.study_id),
rc AS (SELECT t.query_id, t.rank, l.cat, l.val FROM t JOIN b ON b.vec_id = t.bank_id JOIN {bank_level} l ON {same}),
sig AS (SELECT t.query_id, t.rank, coalesce(list(rc.cat || ':' || CAST(rc.val AS VARCHAR) ORDER BY rc.cat)
               FILTER (WHERE rc.cat IS NOT NULL), []) AS g
        FROM t LEFT JOIN rc USING (query_id, rank) GROUP BY ALL),
per AS (SELECT q.vec_id AS query_id,
               (SELECT count(*) FROM t WHERE t.query_id = q.vec_id) AS n_rows,
               (SELECT count(*) FROM rc WHERE rc.query_id = q.vec_id) AS num_preds,
               (SELECT count(*) FROM qc WHERE qc.query_id = q.vec_id) AS query_cells,
               (SELECT count(DISTINCT rc.cat) FROM rc JOIN qc USING (query_id, cat, val) WHERE rc.query_id = q.vec_id) AS n_hits,
               (SELECT count(DISTINCT g) FROM sig WHERE sig.query_id = q.vec_id) AS n_vec
        FROM q),
sc AS (SELECT *, CASE WHEN num_preds = 0 THEN 'no_bank_labels' WHEN query_cells = 0 THEN 'no_query_labels'
                      ELSE 'evaluated' END AS status FROM per)
"""


#: BLEU-2 of the retrieved texts, joined in rank order, against the least report of the query's study.
BLEU_SQL = """
pair AS (SELECT q.vec_id AS query_id, (SELECT min(sents) FROM long WHERE mimic_id = q.study_id) AS ref,
                (SELECT string_agg(b.target, '. ' ORDER BY t.rank) FROM t JOIN b ON b.vec_id = t.bank_id
                 WHERE t.query_id = q.vec_id) AS cand FROM q),
tok AS (SELECT query_id,
               list_filter(string_split(regexp_replace(replace(replace(coalesce(ref, ''), chr(10), ''), chr(13), ''),
                                                       '[^0-9a-zA-Z ]+', ' ', 'g'), ' '), lambda w: w <> '') AS r,
               list_filter(string_split(regexp_replace(cand, '[^0-9a-zA-Z ]+', ' ', 'g'), ' '), lambda w: w <> '') AS c FROM pair),
gram AS (SELECT query_id, 1 AS n, 'c' AS side, unnest(c) AS gram FROM tok UNION ALL SELECT query_id, 1, 'r', unnest(r) FROM tok
         UNION ALL SELECT query_id, 2, 'c', unnest(list_transform(range(greatest(len(c) - 1, 0)), lambda i: c[i + 1] || ' ' || c[i + 2])) FROM tok
         UNION ALL SELECT query_id, 2, 'r', unnest(list_transform(range(greatest(len(r) - 1, 0)), lambda i: r[i + 1] || ' ' || r[i + 2])) FROM tok),
cnt AS (SELECT query_id, n, gram, count(*) FILTER (WHERE side = 'c') AS cc, count(*) FILTER (WHERE side = 'r') AS rc FROM gram GROUP BY ALL),
m AS (SELECT query_id, sum(CASE WHEN n = 1 THEN least(cc, rc) END) AS m1, sum(CASE WHEN n = 2 THEN least(cc, rc) END) AS m2 FROM cnt GROUP BY query_id),
bl AS (SELECT query_id, CASE WHEN coalesce(m1, 0) = 0 OR coalesce(m2, 0) = 0 OR len(c) = 0 THEN 0.0
                        ELSE (CASE WHEN len(c) > len(r) THEN 1.0 ELSE exp(1 - len(r) / len(c)) END)
                             * exp(0.5 * ln(m1 / greatest(1, len(c))) + 0.5 * ln(m2 / greatest(1, len(c) - 1))) END AS bleu
       FROM tok LEFT JOIN m USING (query_id))
"""

METRICS_SQL = f"""
SELECT round(sum(CASE WHEN status = 'evaluated' AND n_hits > 0 THEN 1 ELSE 0 END) / count(*), 9) AS flat_hit,
       CAST(sum(CASE WHEN status = 'evaluated' AND n_hits > 0 THEN 1 ELSE 0 END) AS BIGINT) AS hits,
       round(avg(CASE WHEN status = 'evaluated' THEN n_hits / num_preds END), 9) AS precision,
       round(avg(CASE WHEN status = 'evaluated' THEN n_hits / query_cells END), 9) AS recall,
       round(2 * avg(CASE WHEN status = 'evaluated' THEN n_hits / num_preds END) * avg(CASE WHEN status = 'evaluated' THEN n_hits / query_cells END)
             / nullif(avg(CASE WHEN status = 'evaluated' THEN n_hits / num_preds END)
                      + avg(CASE WHEN status = 'evaluated' THEN n_hits / query_cells END), 0), 9) AS f1,
       round(avg(CASE WHEN status = 'evaluated' THEN CAST(n_rows - n_vec AS DOUBLE) END), 9) AS duplicates,
       CAST({K} AS INTEGER) AS k, CAST(sum(CASE WHEN status = 'evaluated' THEN 1 ELSE 0 END) AS BIGINT) AS test_instances"""

RUN_SQL = f"""'{RUN.bank}' AS bank, '{RUN.query}' AS query, CAST({RUN.test_size} AS INTEGER) AS test_size,
       CAST({RUN.random_state} AS INTEGER) AS random_state"""


def _bank(spark, sf_dir):
    """The bank's rows, written once: an evaluation reads them many times, each of which would join all documents."""
    return cut_lineage(B.bank_rows(spark, sf_dir), "eval-bank")


def _sides(spark, sf_dir, bank):
    role = flagship.roles(spark, sf_dir).select("vec_id", "role")
    rows = bank.join(role, "vec_id")
    return (rows.where("role = 'query'").select(F.col("vec_id").alias("query_id"), "study_id", "target", "embs"),
            rows.where("role = 'bank'").select(F.col("vec_id").alias("bank_id"), "batch_id", "pos", "study_id", "target", "embs"))


def _text_bank(spark, sf_dir, bank, bleu: bool) -> evaluation.Evaluation:
    return evaluation.evaluate(*_sides(spark, sf_dir, bank), B.bank_sentence_labels(spark, sf_dir, bank), RUN, k=K, max_k=MAX_K,
                               bleu=bleu)


@register("evaluate_text_bank", f"""
WITH {scores_sql(True, 'sentence')}, {BLEU_SQL}
SELECT query_id, status, CAST(n_rows AS INTEGER) AS n_rows, CAST(num_preds AS INTEGER) AS num_preds,
       CAST(query_cells AS INTEGER) AS query_cells, CAST(n_hits AS INTEGER) AS n_hits,
       status = 'evaluated' AND n_hits > 0 AS flat_hit,
       round(CASE WHEN status = 'evaluated' THEN n_hits / num_preds END, 9) AS precision,
       round(CASE WHEN status = 'evaluated' THEN n_hits / query_cells END, 9) AS recall,
       CAST(CASE WHEN status = 'evaluated' THEN n_rows - n_vec END AS INTEGER) AS duplicates,
       round(CASE WHEN status = 'evaluated' THEN bl.bleu END, 9) AS bleu
FROM sc LEFT JOIN bl USING (query_id)
""")
def q_evaluate_text_bank(spark, sf_dir):
    """Scores of sampled queries (their studies' labels) against a bank of texts (their sentences' labels), each text once
    a batch, with the BLEU of what was retrieved."""
    return rounded(_text_bank(spark, sf_dir, _bank(spark, sf_dir), bleu=True).scores.drop("hit_classes"))


@register("evaluate_study_bank", f"WITH {scores_sql(False, 'study')}{METRICS_SQL}, {RUN_SQL} FROM sc")
def q_evaluate_study_bank(spark, sf_dir):
    """The metrics row where bank rows have their studies' labels and equal texts all count."""
    bank = _bank(spark, sf_dir)
    out = evaluation.evaluate(*_sides(spark, sf_dir, bank), B.bank_sentence_labels(spark, sf_dir, bank), RUN, k=K, max_k=MAX_K,
                              bank_level="study", unique_text=None)
    return rounded(out.metrics)


@register("metrics_runs", f"""
WITH {scores_sql(True, 'sentence')}, {BLEU_SQL},
one AS ({METRICS_SQL}, {RUN_SQL}, round(avg(CASE WHEN status = 'evaluated' THEN bl.bleu END), 9) AS bleu
        FROM sc LEFT JOIN bl USING (query_id))
SELECT *, 'with bleu' AS "case" FROM one UNION ALL SELECT * REPLACE (NULL AS bleu), 'plain' FROM one
""")
def q_metrics_runs(spark, sf_dir):
    """Two cases appended to one history, one of them without BLEU, and the other written twice as by a retried job."""
    out, bank = shared_dir(spark, "metrics"), _bank(spark, sf_dir)
    plain = rounded(_text_bank(spark, sf_dir, bank, bleu=False).metrics).withColumn("case", F.lit("plain"))
    scored = rounded(_text_bank(spark, sf_dir, bank, bleu=True).metrics).withColumn("case", F.lit("with bleu"))
    scored = cut_lineage(scored, "metrics-row")  # one row, written twice below
    for row in (plain, scored, scored):
        W.append_metrics(row, out)
    return R.read_metrics(spark, out)
