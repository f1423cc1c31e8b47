"""Registered queries of the jobs from files to files, of planted leaks and of dictionaries of whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from studybank.operators import splits as S
from studybank.operators.sections import overrides_table
from studybank.operators.text import word_dictionary
from studybank.plans import bindings as B
from studybank.plans import jobs
from studybank.plans.q_encode import write_model_config
from studybank.plans.q_labels import SPLIT_SQL, _splits
from studybank.plans.q_text import sectioned_reports
from studybank.plans.registry import register
from studybank.session import shared_dir
from studybank.sources import readers as R
from studybank.sources import writers as W


# every fourth study has an override of its own, a slice or a section that its report lacks
_OVERRIDE = "doc_id % 4 = 0"


@register("job_section_files")
def q_job_section_files(spark, sf_dir):
    """A tree of report files sectioned into CSV files and read back (no study of this input is in the fixed overrides).
    Its SQL is that of ``last_section_pick``."""
    tree, out = shared_dir(spark, "tree"), shared_dir(spark, "sectioned")
    text = sectioned_reports(spark, sf_dir)
    patient = F.concat(F.lit("p10"), F.substring(F.md5("study_id"), 1, 4))
    W.materialise(W.write_text_tree(text.select("study_id", F.lit("p10").alias("group"), patient.alias("patient"), "text"), tree))
    jobs.create_section_files(spark, tree, out, max_rows=500)
    return R.read_sectioned(spark, out).select("study_id", F.coalesce("report", F.lit("")).alias("report"))


@register("job_section_overrides", f"""
SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id,
       CASE WHEN doc_id % 8 = 0 THEN substring(text, 4, 40) ELSE '' END AS report
FROM documents WHERE {_OVERRIDE} AND text IS NOT NULL
""")
def q_job_section_overrides(spark, sf_dir):
    """Overrides that do occur in the data: slices, and sections that the report lacks (an empty passage)."""
    d = B.table(spark, sf_dir, "documents").where(f"{_OVERRIDE} AND text IS NOT NULL")
    sid = F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("study_id")
    own = d.select(sid, F.when(F.col("doc_id") % 8 != 0, "technique").alias("section_name"),
                   F.when(F.col("doc_id") % 8 == 0, 3).alias("start"), F.when(F.col("doc_id") % 8 == 0, 43).alias("end"))
    overrides = overrides_table(spark).unionByName(own)
    return jobs.section_reports(d.select(sid, "text"), overrides)


@register("job_subset", SPLIT_SQL + """
SELECT split, count(DISTINCT study_id) AS studies, count(*) AS rows FROM splits GROUP BY split
""")
def q_job_subset(spark, sf_dir):
    return jobs.get_subset(B.images(spark, sf_dir), B.reports(spark, sf_dir), shared_dir(spark, "subset"))


@register("job_bank_query", SPLIT_SQL + """,
bank AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || path), path) AS r, count(*) OVER () AS n FROM splits WHERE split IN ('train', 'val')),
query AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || path), path) AS r, count(*) OVER () AS n FROM splits WHERE split = 'test')
SELECT study_id, path, 'bank' AS role FROM bank WHERE r <= floor(n * CAST(0.3 AS DOUBLE))
UNION ALL SELECT study_id, path, 'query' FROM query WHERE r <= floor(n * CAST(0.6 AS DOUBLE))
""")
def q_job_bank_query(spark, sf_dir):
    """Bank and queries cut from their own splits with a ratio each."""
    rows = jobs.bank_query_split(_splits(spark, sf_dir), bank_ratio=0.3, query_ratio=0.6, key="path")
    return rows.select("study_id", "path", "role")


@register("job_embed_bank", """
WITH t AS (SELECT DISTINCT 's' || CAST(doc_id AS VARCHAR) AS study_id, text FROM documents WHERE text IS NOT NULL)
SELECT study_id, replace(replace(text, chr(10), ''), chr(13), '') AS target, c AS "case", 'text' AS embed_type, d AS width
FROM t, (VALUES ('out_grihas_16', 16), ('out_grihas_32', 32)) AS m(c, d)
""")
def q_job_embed_bank(spark, sf_dir):
    """The bank's texts embedded with every model of a config, written as batches and read back."""
    out = shared_dir(spark, "bank")
    configs = R.read_model_config(spark, write_model_config(spark))
    jobs.embed_bank(B.reports(spark, sf_dir), configs, out)
    return R.read_embeddings(spark, out).select("study_id", "target", "case", "embed_type", F.size("embs").alias("width"))


# the splits with some train studies put into test as well
LEAKY_SQL = SPLIT_SQL + """,
leaky AS (SELECT study_id, split FROM splits
          UNION ALL SELECT study_id, 'test' FROM splits WHERE split = 'train' AND md5(study_id) LIKE '0%')
"""


def _leaky(spark, sf_dir):
    rows = _splits(spark, sf_dir).select("study_id", "split")
    leaks = rows.where((F.col("split") == "train") & F.md5(F.col("study_id")).startswith("0"))
    return rows.unionAll(leaks.withColumn("split", F.lit("test")))


@register("split_leaks_planted", LEAKY_SQL + """
SELECT study_id, list_sort(list(DISTINCT split)) AS splits FROM leaky GROUP BY study_id HAVING count(DISTINCT split) > 1
""")
def q_split_leaks_planted(spark, sf_dir):
    return S.split_leaks(_leaky(spark, sf_dir))


@register("intersect_studies_planted", LEAKY_SQL + """
SELECT study_id FROM leaky WHERE split = 'train' INTERSECT SELECT study_id FROM leaky WHERE split = 'test'
""")
def q_intersect_planted(spark, sf_dir):
    rows = _leaky(spark, sf_dir)
    return (rows.where("split = 'train'").select("study_id").intersect(rows.where("split = 'test'").select("study_id")))


WORDS_SQL = """
w AS (SELECT lang, unnest(list_distinct(regexp_extract_all(lower(text), '\\p{L}[\\p{L}\\p{M}]*'))) AS word FROM documents WHERE lang IS NOT NULL),
c AS (SELECT lang, word, count(*) AS texts FROM w GROUP BY ALL)
"""


@register("dictionary_words", f"""
WITH {WORDS_SQL}
SELECT upper(substr(lang, 1, 1)) || substr(lang, 2) || ' Words' AS observation, word AS phrase, 'mention' AS kind FROM c
""")
def q_dictionary_words(spark, sf_dir):
    """Phrase folders per language with every word of its whole texts, written as rows and read back."""
    out = shared_dir(spark, "words")
    words = word_dictionary(B.table(spark, sf_dir, "documents"))
    W.write_phrases(words.select(F.concat("lang", F.lit("_words")).alias("observation"), F.col("word").alias("phrase")), out)
    return R.read_phrase_folders(spark, out, "mention").distinct()


@register("dictionary_frequent_words", f"""
WITH {WORDS_SQL}, n AS (SELECT lang, count(*) * 0.2 AS least FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang)
SELECT lang, word, texts FROM c JOIN n USING (lang) WHERE texts >= least
""")
def q_frequent_words(spark, sf_dir):
    """Words that a fifth of a language's texts hold."""
    return word_dictionary(B.table(spark, sf_dir, "documents"), share=0.2)
