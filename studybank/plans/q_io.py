"""Registered source / sink queries: each writes data derived from the driver
tables to the shared checkpoint folder in the pipeline's format and reads it
back with the matching reader, so the result can be checked against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from studybank.operators import labels as L
from studybank.operators import splits as SP
from studybank.plans import bindings as B
from studybank.plans import flagship
from studybank.plans.q_labels import LONG, SPLIT_SQL, _pairs
from studybank.plans.q_retrieval import ROLES, SCORES_T, TOPK, metrics_sql
from studybank.plans.registry import register, rounded
from studybank.session import shared_dir
from studybank.sources import readers as R
from studybank.sources import writers as W

TREE_SQL = """
SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id,
       substring('p' || CAST(10000000 + doc_id // 3 AS VARCHAR), 1, 3) AS "group",
       'p' || CAST(10000000 + doc_id // 3 AS VARCHAR) AS patient, text
FROM documents
"""


def _tree_input(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    patient = F.concat(F.lit("p"), (F.lit(10000000) + F.floor(F.col("doc_id") / 3)).cast("long")
                       .cast("string"))
    return d.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("study_id"),
                    F.substring(patient, 1, 3).alias("group"), patient.alias("patient"), "text")


def _write_tree(spark, sf_dir) -> str:
    root = shared_dir(spark, "report_tree")
    W.materialise(W.write_text_tree(_tree_input(spark, sf_dir), root))
    return root


@register("src_report_tree", TREE_SQL)
def q_report_tree(spark, sf_dir):
    return R.read_report_tree(spark, _write_tree(spark, sf_dir))


@register("src_text_folder", """
SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id, 'this is a photo of ' || text || '.' AS report FROM documents
""")
def q_text_folder(spark, sf_dir):
    return R.read_text_folder(spark, _write_tree(spark, sf_dir), templated=True)


@register("src_sectioned_csv", """
SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id, text AS report FROM documents
""")
def q_sectioned_csv(spark, sf_dir):
    out = shared_dir(spark, "sectioned")
    W.write_sectioned(B.reports(spark, sf_dir), out, max_rows=300)
    return R.read_sectioned(spark, out)


@register("sink_sectioned", """
SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id, text AS report, true AS file_within_limit FROM documents
""")
def q_sink_sectioned(spark, sf_dir):
    """The rows read back, and whether the file of each keeps to 300 rows."""
    out = shared_dir(spark, "sectioned")
    W.write_sectioned(B.reports(spark, sf_dir), out, max_rows=300)
    back = R.read_sectioned(spark, out).select("*", F.col("_metadata.file_path").alias("file"))
    sizes = back.groupBy("file").agg((F.count(F.lit(1)) <= 300).alias("file_within_limit"))
    return back.join(sizes, "file").drop("file")


@register("src_split_csv", SPLIT_SQL + """
SELECT study_id, path, report, 'train' AS split FROM splits WHERE split = 'train'
""")
def q_split_csv(spark, sf_dir):
    s = SP.study_split(_pairs(spark, sf_dir), "study_id", 1.0, 0.9, 0.5, seed=42)
    out = shared_dir(spark, "split_csv")
    train = s.where(F.col("split") == "train").withColumn(
        "index", F.monotonically_increasing_id())
    W.write_split_csv(train, out)
    return R.read_split(spark, out, "train")


@register("sink_splits", SPLIT_SQL + "SELECT study_id, path, split FROM splits")
def q_sink_splits(spark, sf_dir):
    s = SP.study_split(_pairs(spark, sf_dir), "study_id", 1.0, 0.9, 0.5, seed=42)
    out = shared_dir(spark, "splits")
    W.write_splits(s.select("study_id", "path", "split"), out)
    return spark.read.parquet(out).select("study_id", "path", "split")


@register("src_label_csvs", f"""
WITH {LONG} SELECT mimic_id, nullif(report, '') AS report, cat, vals, nullif(sents, '') AS sents FROM long
""")
def q_label_csvs(spark, sf_dir):
    """A CSV cell can't tell an empty text from none: both are read as null."""
    out, texts = shared_dir(spark, "labels_csv"), shared_dir(spark, "label_texts_csv")
    W.write_sentence_labels(B.long_labels(spark, sf_dir, digest=True), out, texts, B.labelled_reports(spark, sf_dir))
    return R.read_sentence_labels(spark, out, texts)


@register("sink_sentence_labels", f"WITH {LONG} SELECT count(*) AS rows FROM long")
def q_sink_sentence_labels(spark, sf_dir):
    out, texts = shared_dir(spark, "labels_csv"), shared_dir(spark, "label_texts_csv")
    W.write_sentence_labels(B.long_labels(spark, sf_dir, digest=True), out, texts, B.labelled_reports(spark, sf_dir))
    return R.read_sentence_labels(spark, out, texts).agg(F.count(F.lit(1)).cast("long").alias("rows"))


ROLE_SQL = """
WITH r AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) AS rk,
                  count(*) OVER () AS n FROM embeddings)
SELECT vec_id, label, CASE WHEN rk <= floor(n * CAST(0.1 AS DOUBLE)) THEN 'query' ELSE 'bank' END AS role
FROM r
"""


@register("src_embedding_batches", ROLE_SQL.replace(
    "SELECT vec_id, label, CASE", "SELECT vec_id, label, 'c1' AS \"case\", CASE").replace(
    "END AS role", "END AS embed_type"))
def q_embedding_batches(spark, sf_dir):
    roles = flagship.roles(spark, sf_dir)
    out = shared_dir(spark, "embeddings")
    W.write_embeddings(roles.select("vec_id", "label", F.col("embedding").alias("embs"),
                                    F.lit("c1").alias("case"), F.col("role").alias("embed_type")),
                       out, max_rows=100)
    return R.read_embeddings(spark, out).select("vec_id", "label", "case", "embed_type")


@register("sink_bank_query", ROLE_SQL)
def q_sink_bank_query(spark, sf_dir):
    out = shared_dir(spark, "bank_query")
    W.write_bank_query(flagship.roles(spark, sf_dir).select("vec_id", "label", "role"), out)
    return spark.read.parquet(out).select("vec_id", "label", "role")


@register("src_report_csv", "SELECT text AS report FROM documents")
def q_report_csv(spark, sf_dir):
    out = shared_dir(spark, "reports_csv")
    (B.table(spark, sf_dir, "documents").select("text").write.mode("overwrite")
     .option("quoteAll", True).option("escape", '"').csv(out))
    return R.read_reports(spark, out)


@register("src_phrase_dictionary", """
SELECT DISTINCT CASE lang WHEN 'en' THEN 'En Words' WHEN 'fr' THEN 'Fr Words' WHEN 'de' THEN 'De Words'
                          ELSE 'Es Words' END AS observation,
       lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS phrase, 'mention' AS kind
FROM documents WHERE regexp_extract(text, '^([A-Za-z]+)', 1) <> ''
""")
def q_phrase_dictionary(spark, sf_dir):
    """Phrase folders per language (``<lang>_words``) holding the distinct
    ASCII first words of its documents, one per line (a blank line included)."""
    out = shared_dir(spark, "phrases")
    d = B.table(spark, sf_dir, "documents")
    word = F.lower(F.regexp_extract("text", r"^([A-Za-z]+)", 1))
    W.write_phrases(d.select(F.concat("lang", F.lit("_words")).alias("observation"), word.alias("phrase")), out)
    return R.read_phrase_folders(spark, out, "mention").distinct()


HISTORY_SQL = ("SELECT * FROM (" + metrics_sql(1, ", 'k1' AS \"case\"") + ") UNION ALL SELECT * FROM ("
               + metrics_sql(2, ", 'k2' AS \"case\"") + ")")


@register("sink_metrics_append", HISTORY_SQL)
def q_metrics_append(spark, sf_dir):
    """Metrics of two cases appended to one history table and read back."""
    out = shared_dir(spark, "metrics")
    for k in (1, 2):
        m = rounded(flagship.retrieval_eval(spark, sf_dir, k=k)).withColumn("case", F.lit(f"k{k}"))
        W.append_metrics(m, out)
    return R.read_metrics(spark, out)


@register("src_metrics_history", "SELECT \"case\", k, hits, test_instances FROM (" + HISTORY_SQL + ")")
def q_metrics_history(spark, sf_dir):
    return q_metrics_append(spark, sf_dir).select("case", "k", "hits", "test_instances")


@register("sink_preds_json", f"""
WITH {ROLES}, {TOPK}, {SCORES_T.format(k=2)},
outs AS (SELECT query_id, list('vector ' || CAST(bank_id AS VARCHAR) ORDER BY rank) AS out FROM t
         WHERE rank <= 2 GROUP BY query_id)
SELECT CAST(sc.query_id AS VARCHAR) AS study_id, 'vector ' || CAST(sc.query_id AS VARCHAR) AS query,
       CASE WHEN sc.n_hits > 0 THEN [CAST(sc.ql AS VARCHAR)] END AS hit_classes, outs.out
FROM sc JOIN outs ON outs.query_id = sc.query_id WHERE sc.status = 'evaluated'
""")
def q_preds(spark, sf_dir):
    """Prediction records of the flagship written as JSON and read back."""
    from studybank.operators.metrics import predictions, query_scores
    from studybank.operators.retrieve import topk, topk_cut
    r = flagship.roles(spark, sf_dir)
    q = r.where(F.col("role") == "query").withColumn("study_id", F.col("vec_id").cast("string")) \
         .withColumn("target", F.concat(F.lit("vector "), F.col("vec_id").cast("string")))
    b = r.where(F.col("role") == "bank").withColumn(
        "target", F.concat(F.lit("vector "), F.col("vec_id").cast("string")))
    top = topk_cut(topk(q, b, 10, query_key="vec_id", bank_key="vec_id", vec="embedding"), 2, 10)
    labels = B.vector_labels(spark, sf_dir)
    scores = query_scores(q.select(F.col("vec_id").alias("query_id")), top, labels, labels)
    preds = predictions(q.withColumnRenamed("vec_id", "query_id"), top,
                        b.withColumnRenamed("vec_id", "bank_id"), scores)
    out = shared_dir(spark, "preds")
    W.write_preds(preds, out)
    return spark.read.schema("study_id string, query string, hit_classes array<string>, "
                             "out array<string>").json(out)


__all__ = ["L"]
