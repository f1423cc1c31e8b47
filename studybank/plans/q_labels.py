"""Registered label / join / projection / set / split queries."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from studybank.functions.text import has_letters
from studybank.operators import labels as L
from studybank.operators import splits as S
from studybank.plans import bindings as B
from studybank.plans.registry import register

CATS = ["quality", "toxic"]

# long labels as SQL (same binding as bindings.long_labels)
LONG = """
long AS (
  SELECT 's' || CAST(l.doc_id AS VARCHAR) AS mimic_id, d.text AS report, u.cat,
         CAST(CASE WHEN l.doc_id % 5 = 0 AND u.vals IS NOT NULL THEN -1 ELSE u.vals END AS INTEGER) AS vals,
         unnest(coalesce(string_split(d.text, '.'), [NULL])) AS sents
  FROM labels l
  CROSS JOIN LATERAL (VALUES ('quality', l.quality), ('toxic', l.toxic)) AS u(cat, vals)
  JOIN documents d ON d.doc_id = l.doc_id)
"""

REPORTS = "reports AS (SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id, text AS report FROM documents)"
IMAGES = "images AS (SELECT 's' || CAST(page_id AS VARCHAR) AS study_id, url AS path FROM pages)"
EMBS = ("embs AS (SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id, "
        "unnest(coalesce(string_split(text, '.'), [NULL])) AS target FROM documents)")


def _embs(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("study_id"),
                    B.pieces("text").alias("target"))


def _pairs(spark, sf_dir):
    return L.pair_studies(B.images(spark, sf_dir), B.reports(spark, sf_dir))


@register("pivot_labels", f"""
WITH {LONG}
SELECT mimic_id, cat, vals,
       CASE WHEN cat = 'quality' THEN vals END AS quality,
       CASE WHEN cat = 'toxic' THEN vals END AS toxic
FROM long
""")
def q_pivot(spark, sf_dir):
    long = B.long_labels(spark, sf_dir).select("mimic_id", "cat", "vals")
    return L.pivot_labels(long, CATS)


@register("study_label_max", f"""
WITH {LONG}
SELECT mimic_id, CAST(max(CASE WHEN cat = 'quality' THEN vals END) AS INTEGER) AS quality,
       CAST(max(CASE WHEN cat = 'toxic' THEN vals END) AS INTEGER) AS toxic
FROM long GROUP BY mimic_id
""")
def q_study_max(spark, sf_dir):
    return L.collapse_labels(B.long_labels(spark, sf_dir), ["mimic_id"], CATS)


@register("sentence_label_max", f"""
WITH {LONG}
SELECT mimic_id, sents, CAST(max(CASE WHEN cat = 'quality' THEN vals END) AS INTEGER) AS quality,
       CAST(max(CASE WHEN cat = 'toxic' THEN vals END) AS INTEGER) AS toxic
FROM long WHERE mimic_id IS NOT NULL AND sents IS NOT NULL GROUP BY mimic_id, sents
""")
def q_sentence_max(spark, sf_dir):
    return L.collapse_labels(B.long_labels(spark, sf_dir), ["mimic_id", "sents"], CATS)


@register("join_study_labels", f"""
WITH {LONG}, {EMBS},
lab AS (SELECT mimic_id, CAST(max(CASE WHEN cat = 'quality' THEN vals END) AS INTEGER) AS quality,
               CAST(max(CASE WHEN cat = 'toxic' THEN vals END) AS INTEGER) AS toxic
        FROM long GROUP BY mimic_id)
SELECT e.study_id, e.target, lab.quality, lab.toxic FROM embs e LEFT JOIN lab ON e.study_id = lab.mimic_id
""")
def q_join_study_labels(spark, sf_dir):
    return L.attach_labels(_embs(spark, sf_dir), B.long_labels(spark, sf_dir), "study", CATS)


@register("join_sentence_labels", f"""
WITH {LONG}, {EMBS},
lab AS (SELECT mimic_id, sents, CAST(max(CASE WHEN cat = 'quality' THEN vals END) AS INTEGER) AS quality,
               CAST(max(CASE WHEN cat = 'toxic' THEN vals END) AS INTEGER) AS toxic
        FROM long WHERE sents IS NOT NULL GROUP BY mimic_id, sents)
SELECT e.study_id, e.target, lab.quality, lab.toxic FROM embs e
LEFT JOIN lab ON e.study_id = lab.mimic_id AND e.target = lab.sents
""")
def q_join_sentence_labels(spark, sf_dir):
    return L.attach_labels(_embs(spark, sf_dir), B.long_labels(spark, sf_dir), "sentence", CATS)


@register("join_report_text", f"""
WITH {LONG}, {EMBS},
rep AS (SELECT mimic_id, min(report) AS report FROM long GROUP BY mimic_id)
SELECT e.study_id, e.target, rep.report FROM embs e LEFT JOIN rep ON e.study_id = rep.mimic_id
""")
def q_join_report_text(spark, sf_dir):
    return L.attach_report(_embs(spark, sf_dir), B.long_labels(spark, sf_dir, dealt=True))


@register("join_reports_long_labels", f"""
WITH {LONG}, {REPORTS}
SELECT r.study_id AS mimic_id, r.report, l.cat, l.vals, l.sents
FROM reports r LEFT JOIN long l ON l.mimic_id = r.study_id
""")
def q_join_reports_long(spark, sf_dir):
    long = B.long_labels(spark, sf_dir).select(
        F.col("mimic_id").alias("study_id"), "cat", F.col("vals").alias("val"), "sents")
    return L.sentence_labels(long, B.reports(spark, sf_dir))


@register("join_study_sentences", f"""
WITH {LONG}, {REPORTS}
SELECT DISTINCT r.study_id, l.sents AS report
FROM reports r JOIN long l ON l.mimic_id = r.study_id
WHERE l.mimic_id IS NOT NULL AND l.report IS NOT NULL AND l.cat IS NOT NULL
  AND l.vals IS NOT NULL AND l.sents IS NOT NULL
""")
def q_join_study_sentences(spark, sf_dir):
    return L.expand_sentences(B.reports(spark, sf_dir), B.long_labels(spark, sf_dir))


@register("join_image_report", f"""
WITH {REPORTS}, {IMAGES}
SELECT i.study_id, i.path, r.report FROM images i JOIN reports r ON r.study_id = i.study_id
""")
def q_join_image_report(spark, sf_dir):
    return _pairs(spark, sf_dir)


SPLIT_SQL = f"""
WITH {REPORTS}, {IMAGES},
pairs AS (SELECT i.study_id, i.path, r.report FROM images i JOIN reports r ON r.study_id = i.study_id),
st AS (SELECT study_id, row_number() OVER (ORDER BY md5('42:' || study_id), study_id) AS rk,
              count(*) OVER () AS n FROM (SELECT DISTINCT study_id FROM pairs)),
sz AS (SELECT study_id, rk, floor(n * CAST(1.0 AS DOUBLE)) AS n_sub FROM st),
sz2 AS (SELECT *, floor(n_sub * CAST(0.9 AS DOUBLE)) AS n_train FROM sz),
sz3 AS (SELECT *, floor((n_sub - n_train) * CAST(0.5 AS DOUBLE)) AS n_test FROM sz2),
asg AS (SELECT study_id, CASE WHEN rk <= n_train THEN 'train' WHEN rk <= n_train + n_test THEN 'test'
                              WHEN rk <= n_sub THEN 'val' END AS split FROM sz3),
splits AS (SELECT p.study_id, p.path, p.report, a.split FROM pairs p JOIN asg a ON a.study_id = p.study_id
           WHERE a.split IS NOT NULL)
"""


def _splits(spark, sf_dir):
    return S.study_split(_pairs(spark, sf_dir), "study_id", 1.0, 0.9, 0.5, seed=42)


@register("study_split", SPLIT_SQL + "SELECT study_id, path, split FROM splits")
def q_study_split(spark, sf_dir):
    return _splits(spark, sf_dir).select("study_id", "path", "split")


@register("split_leak_audit", SPLIT_SQL + """
SELECT study_id, list_sort(list(DISTINCT split)) AS splits FROM splits GROUP BY study_id
HAVING count(DISTINCT split) > 1
""")
def q_split_leaks(spark, sf_dir):
    return S.split_leaks(_splits(spark, sf_dir))


@register("count_studies_images", SPLIT_SQL + """
SELECT split, count(DISTINCT study_id) AS studies, count(*) AS rows FROM splits GROUP BY split
""")
def q_split_counts(spark, sf_dir):
    return S.split_counts(_splits(spark, sf_dir))


@register("join_split_members", SPLIT_SQL + """
SELECT r.study_id, 'member' AS side FROM reports r WHERE r.study_id IN (SELECT study_id FROM splits WHERE split = 'train')
UNION ALL
SELECT r.study_id, 'outside' AS side FROM reports r WHERE r.study_id NOT IN (SELECT study_id FROM splits WHERE split = 'train')
""")
def q_members(spark, sf_dir):
    train = _splits(spark, sf_dir).where(F.col("split") == "train")
    rep = B.reports(spark, sf_dir).select("study_id")
    return (L.members(rep, train, keep=True).withColumn("side", F.lit("member"))
            .unionByName(L.members(rep, train, keep=False).withColumn("side", F.lit("outside"))))


@register("except_studies", SPLIT_SQL + """
SELECT study_id FROM reports EXCEPT SELECT study_id FROM splits WHERE split = 'train'
""")
def q_except(spark, sf_dir):
    train = _splits(spark, sf_dir).where(F.col("split") == "train").select("study_id")
    return B.reports(spark, sf_dir).select("study_id").subtract(train)


@register("intersect_studies", SPLIT_SQL + """
SELECT study_id FROM splits WHERE split = 'train'
INTERSECT SELECT study_id FROM splits WHERE split = 'test'
""")
def q_intersect(spark, sf_dir):
    s = _splits(spark, sf_dir)
    return (s.where(F.col("split") == "train").select("study_id")
            .intersect(s.where(F.col("split") == "test").select("study_id")))


@register("union_splits", SPLIT_SQL + """
SELECT study_id, path, 'bank' AS role FROM splits WHERE split = 'train'
UNION ALL SELECT study_id, path, 'bank' AS role FROM splits WHERE split = 'val'
UNION ALL SELECT study_id, path, 'query' AS role FROM splits WHERE split = 'test'
""")
def q_union_splits(spark, sf_dir):
    s = _splits(spark, sf_dir).select("study_id", "path", "split")
    bank = (s.where(F.col("split") == "train").unionByName(s.where(F.col("split") == "val"))
            .select("study_id", "path", F.lit("bank").alias("role")))
    query = s.where(F.col("split") == "test").select("study_id", "path", F.lit("query").alias("role"))
    return bank.unionByName(query)


@register("union_files", """
SELECT 'r' || CAST(doc_id AS VARCHAR) AS study_id, text AS report FROM documents
UNION ALL SELECT 'b' || CAST(item_id AS VARCHAR) AS study_id, text AS report FROM benchmark
""")
def q_union_files(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("study_id"),
        F.col("text").alias("report"))
    b = B.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("study_id"),
        F.col("text").alias("report"))
    return d.unionByName(b)


@register("distinct_rows", "SELECT DISTINCT text, lang FROM documents")
def q_distinct_rows(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("text", "lang").distinct()


@register("distinct_pairs", f"WITH {LONG} SELECT DISTINCT mimic_id, report FROM long")
def q_distinct_pairs(spark, sf_dir):
    return B.long_labels(spark, sf_dir).select("mimic_id", "report").distinct()


@register("value_counts", f"WITH {LONG} SELECT vals, count(*) AS count FROM long GROUP BY vals")
def q_value_counts(spark, sf_dir):
    return L.value_counts(B.long_labels(spark, sf_dir), "vals")


@register("null_vector_predicate", f"""
WITH {LONG}, {EMBS},
lab AS (SELECT mimic_id, max(CASE WHEN cat = 'quality' THEN vals END) AS quality,
               max(CASE WHEN cat = 'toxic' THEN vals END) AS toxic FROM long GROUP BY mimic_id)
SELECT e.study_id, coalesce(lab.quality, lab.toxic) IS NULL AS no_labels
FROM embs e LEFT JOIN lab ON e.study_id = lab.mimic_id
""")
def q_null_vector(spark, sf_dir):
    att = L.attach_labels(_embs(spark, sf_dir), B.long_labels(spark, sf_dir), "study", CATS)
    return att.select("study_id", L.all_null(CATS).alias("no_labels"))


@register("project_columns", f"WITH {LONG} SELECT mimic_id, report FROM long")
def q_project(spark, sf_dir):
    return B.long_labels(spark, sf_dir, dealt=True).drop("cat", "vals", "sents", "index").select(
        "mimic_id", "report")


@register("rename_columns", f"WITH {LONG} SELECT mimic_id AS study_id, sents AS report FROM long")
def q_rename(spark, sf_dir):
    return (B.long_labels(spark, sf_dir).select("mimic_id", "sents")
            .withColumnsRenamed({"mimic_id": "study_id", "sents": "report"}))


@register("drop_nulls", """
SELECT doc_id, quality, toxic FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL
""")
def q_drop_nulls(spark, sf_dir):
    return B.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").dropna("any")


@register("filter_has_letters", """
SELECT page_id, html FROM pages WHERE regexp_matches(html, '[A-Za-z]')
""")
def q_has_letters(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", "html").where(has_letters("html"))


@register("drop_empty_strings", """
SELECT doc_id, piece FROM (
  SELECT doc_id, unnest(string_split(text, '.')) AS piece FROM documents) WHERE piece <> ''
""")
def q_drop_empty(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    return (d.select("doc_id", F.explode(F.split("text", r"\.", -1)).alias("piece"))
            .where(F.col("piece") != ""))


@register("row_count_audit", f"""
WITH {REPORTS}, {IMAGES}
SELECT 'pairs' AS stage, count(*) AS rows FROM images i JOIN reports r ON r.study_id = i.study_id
""")
def q_row_audit(spark, sf_dir):
    """Counts gathered with ``observe`` while the data flows (no extra job)."""
    obs = Observation("pairs")
    pairs = _pairs(spark, sf_dir).observe(obs, F.count(F.lit(1)).alias("rows"))
    pairs.write.format("noop").mode("overwrite").save()
    n = obs.get["rows"]
    return spark.createDataFrame([("pairs", int(n))], "stage string, rows long")
