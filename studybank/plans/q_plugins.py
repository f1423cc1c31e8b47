"""Registered queries for the user plug-in surface: pattern / config files,
user encoders, user dictionaries and overrides, user category lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from studybank import constants as K
from studybank.operators import encode as E
from studybank.operators import labels as L
from studybank.operators import sections as S
from studybank.plans import bindings as B
from studybank.plans import labeller
from studybank.plans.q_encode import TEXT_DIM, write_model_config
from studybank.plans.q_text import LABELLER, _q, labeller_sql, sectioned_reports
from studybank.plans.registry import register
from studybank.session import shared_dir
from studybank.sources import readers as R
from studybank.sources import writers as W


@register("src_assertion_patterns", LABELLER + "SELECT status, count(*) AS mentions FROM lab GROUP BY status")
def q_patterns(spark, sf_dir):
    """Pattern files (one per role) read back and used to assert the document
    mentions; result: mentions per status."""
    root = shared_dir(spark, "patterns")
    files = {}
    for role in ("pre_uncertain", "negation", "post_uncertain"):
        files[role] = f"{root}/{role}"
        lines = [(p,) for r, p in B.DEMO_PATTERNS if r == role] + [("",)]
        spark.createDataFrame(lines, "value string").coalesce(1).write.text(files[role])
    pats = R.read_patterns(spark, files)
    m = labeller.mentions(B.reports(spark, sf_dir), B.phrases(spark), pats)
    return m.groupBy("status").agg(F.count(F.lit(1)).alias("mentions"))


@register("src_model_config", """
SELECT c AS "case", count(*) AS reports
FROM documents, (VALUES ('out_grihas_16'), ('out_grihas_32')) AS t(c) GROUP BY c
""")
def q_model_config(spark, sf_dir):
    configs = R.read_model_config(spark, write_model_config(spark))
    return E.embed_config(configs, texts=B.reports(spark, sf_dir)).groupBy("case").agg(
        F.count(F.lit(1)).alias("reports"))


@register("sink_embeddings", """
SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id, 'c1' AS "case", 'text' AS embed_type FROM documents
""")
def q_sink_embeddings(spark, sf_dir):
    emb = E.embed(B.reports(spark, sf_dir), E.HashedNgramEncoder(dim=TEXT_DIM), "report", ["study_id"])
    out = shared_dir(spark, "embeddings_out")
    W.write_embeddings(emb.withColumn("case", F.lit("c1")).withColumn("embed_type", F.lit("text")),
                       out, max_rows=200)
    return R.read_embeddings(spark, out).select("study_id", "case", "embed_type")


class TokenLengthEncoder:
    """A user encoder: share of tokens of length 1..7 and 8+ (protocol demo)."""
    kind = "text"
    name = "token-lengths"
    dim = 8

    def load(self) -> None:
        pass

    def encode(self, batch):
        out = np.zeros((len(batch), self.dim))
        for r, toks in enumerate(batch):
            for t in (toks if toks is not None else []):
                out[r, min(len(t), 8) - 1] += 1
        return out


@register("encoder_plugin", """
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS tk
           FROM documents),
c AS (SELECT doc_id, least(length(unnest(tk)), 8) - 1 AS b FROM t),
n AS (SELECT doc_id, b, count(*) AS cnt FROM c GROUP BY ALL),
z AS (SELECT doc_id, sqrt(sum(cnt * cnt)) AS nz FROM n GROUP BY doc_id),
g AS (SELECT t.doc_id, r.b FROM t, range(8) r(b)),
v AS (SELECT g.doc_id, g.b, coalesce(n.cnt / z.nz, 0.0) AS x FROM g
      LEFT JOIN n ON n.doc_id = g.doc_id AND n.b = g.b LEFT JOIN z ON z.doc_id = g.doc_id)
SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id, list(round(x, 9) ORDER BY b) AS embs FROM v GROUP BY doc_id
""")
def q_encoder_plugin(spark, sf_dir):
    out = E.embed(B.reports(spark, sf_dir), TokenLengthEncoder(), "report", ["study_id"],
                  precision="double")
    return out.select("study_id", F.transform("embs", lambda x: F.round(x, 9)).alias("embs"))


@register("sectioner_overrides")
def q_sectioner_overrides(spark, sf_dir):
    """The fixed per-study override table applied to the sectioned reports
    (studies without an entry take the priority pick)."""
    rep = sectioned_reports(spark, sf_dir)
    return S.apply_overrides(rep, S.split_sections(rep), S.overrides_table(spark))


PLUGIN_PHRASES_SQL = """
WITH w AS (SELECT lang, lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS phrase FROM documents),
c AS (SELECT lang, phrase, count(*) AS n FROM w WHERE phrase <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, phrase) AS rk FROM c)
SELECT upper(substr(lang, 1, 1)) || substr(lang, 2) || ' Words' AS observation,
       ' ' || phrase || ' ' AS phrase, 'mention' AS kind FROM r WHERE rk <= 3
"""


@register("phrase_plugin", labeller_sql(PLUGIN_PHRASES_SQL) + """
SELECT cat, count(*) AS rows FROM rows GROUP BY cat
""")
def q_phrase_plugin(spark, sf_dir):
    """A user dictionary built from the data (each language's most frequent
    ASCII first words) labels the reports."""
    d = B.table(spark, sf_dir, "documents")
    w = F.lower(F.regexp_extract("text", r"^([A-Za-z]+)", 1))
    top = (d.where(w != "").groupBy("lang", w.alias("phrase")).count()
           .withColumn("r", F.row_number().over(
               __import__("pyspark.sql").sql.Window.partitionBy("lang").orderBy(F.desc("count"), "phrase")))
           .where(F.col("r") <= 3))
    phrases = top.select(F.concat(F.initcap("lang"), F.lit(" Words")).alias("observation"),
                         F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")).alias("phrase"),
                         F.lit("mention").alias("kind"))
    rows = labeller.label_rows(B.reports(spark, sf_dir), phrases, B.patterns(spark))
    return rows.groupBy("cat").agg(F.count(F.lit(1)).alias("rows"))


CHOSEN = ["Cardiomegaly", "Edema", "Lung Opacity", "No Finding"]


@register("category_list", LABELLER + f"""
, wide AS (SELECT study_id, {", ".join(f'CAST(max(CASE WHEN cat = {_q(c)} THEN val END) AS INTEGER) AS "{c}"' for c in CHOSEN)}
           FROM resolved GROUP BY study_id)
SELECT r.study_id, {", ".join(f'w."{c}"' for c in CHOSEN)} FROM reports r LEFT JOIN wide w ON w.study_id = r.study_id
""")
def q_category_list(spark, sf_dir):
    return labeller.document_vectors(B.reports(spark, sf_dir), B.phrases(spark), B.patterns(spark),
                                     categories=CHOSEN)


__all__ = ["K"]
