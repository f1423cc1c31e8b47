"""How the driver's tables stand in for the pipeline's inputs.

* reports: ``documents`` -> ``study_id = 's' || doc_id``, ``report = text``
* images: ``pages`` -> ``study_id = 's' || page_id``, ``path = url``
* vectors: ``embeddings`` -> ``vec_id``, ``embedding`` (64 floats), one label
* labels: ``labels`` unpivoted -> ``(doc_id, 'quality' | 'toxic', value)``; an
  uncertain (-1) value is derived where ``doc_id % 5 = 0`` so that every label
  code occurs
* phrase and assertion dictionaries: small literal tables over tokens that
  occur in ``documents`` (the report vocabulary of the real corpus is absent)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studybank.session import deals
from studybank.sources.writers import text_digest


#: Labels whose ids every task may hold, so that the reports needn't be shuffled to meet them.
LABEL_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("study_id"),
                    F.col("text").alias("report"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("study_id"),
                    F.col("url").alias("path"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def vector_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long label cells of the vectors: category = the row's label, value 1."""
    return (vectors(spark, sf_dir).where(F.col("label").isNotNull())
            .select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("cat"),
                    F.lit(1).alias("val")))


def bank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as rows of a bank: ``(vec_id, study_id, batch_id, pos, target, embs)``.  A vector's text is the document of
    its id (its own name if there is none), two neighbours are one study, a batch holds 100."""
    v, d = vectors(spark, sf_dir), table(spark, sf_dir, "documents")
    name = F.concat(F.lit("vector "), F.col("vec_id").cast("string"))
    return v.join(d.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left").select(
        "vec_id", _study_of("vec_id").alias("study_id"), F.floor(F.col("vec_id") / 100).cast("int").alias("batch_id"),
        (F.col("vec_id") % 100).cast("int").alias("pos"), F.coalesce("text", name).alias("target"),
        F.col("embedding").alias("embs"))


def bank_sentence_labels(spark: SparkSession, sf_dir: str, bank: DataFrame | None = None) -> DataFrame:
    """Sentence labels of ``bank_rows`` (``bank``, if they are at hand): ``(mimic_id, report, cat, vals, sents)``, cells of quality and toxic (as in
    ``long_labels``) and one of four groups of vector labels with the values 1, 0 and -1."""
    bank = bank_rows(spark, sf_dir) if bank is None else bank
    rows = bank.select("vec_id", F.col("study_id").alias("mimic_id"), F.col("target").alias("sents"))
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), F.expr(
        "stack(2, 'quality', quality, 'toxic', toxic) as (cat, vals)"))
    lab = lab.withColumn("vals", F.when((F.col("vec_id") % 5 == 0) & F.col("vals").isNotNull(), F.lit(-1))
                         .otherwise(F.col("vals")))
    own = vectors(spark, sf_dir).where("label IS NOT NULL").select(
        "vec_id", F.concat(F.lit("group "), (F.col("label") % 4).cast("string")).alias("cat"),
        (F.lit(1) - F.col("label") % 3).alias("vals"))
    cells = lab.select("vec_id", "cat", F.col("vals").cast("int").alias("vals")).unionAll(
        own.select("vec_id", "cat", F.col("vals").cast("int").alias("vals")))
    return rows.join(cells, "vec_id").select("mimic_id", F.col("sents").alias("report"), "cat", "vals", "sents")


def _study_of(ident: str):
    return F.concat(F.lit("s"), F.floor(F.col(ident) / 2).cast("string"))


def pieces(text: str):
    """A row for each '.'-piece of a text; one null row for a null text."""
    return F.explode_outer(F.split(F.col(text), r"\.", -1))


def _labelled(doc: DataFrame, lab: DataFrame) -> DataFrame:
    """The documents that have labels."""
    ids = lab.select("doc_id")
    return doc.join(F.broadcast(ids.distinct()) if ids.count() <= LABEL_ROWS else ids, "doc_id", "left_semi")


def labelled_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(report)``: the reports of ``long_labels``, not repeated for their labels and pieces."""
    doc = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("report"))
    return _labelled(doc, table(spark, sf_dir, "labels")).select("report")


def label_deals(spark: SparkSession, sf_dir: str) -> int:
    """Number of partitions for rows that repeat the labelled reports."""
    size = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n"))
    return deals(size.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"), "n")


def long_labels(spark: SparkSession, sf_dir: str, dealt: bool = False, digest: bool = False) -> DataFrame:
    """``(mimic_id, report, cat, vals, sents)`` long sentence labels built from
    ``labels`` x ``documents``: a row for each '.'-piece of the report, all with
    the report's label.  For results that keep ``report``, ``dealt`` puts the labelled
    reports, by ``mimic_id``, into partitions that a writer stores them in once.  ``digest`` adds the report's digest, made once for all
    its rows."""
    lab = table(spark, sf_dir, "labels")
    name = F.concat(F.lit("s"), F.col("doc_id").cast("string"))
    doc = table(spark, sf_dir, "documents").select("doc_id", "text")
    if dealt or digest:
        doc = _labelled(doc, lab)
    if dealt:
        doc = doc.select(name.alias("mimic_id"), "text").repartition(label_deals(spark, sf_dir), "mimic_id")
    if digest:
        doc = doc.withColumn("digest", text_digest("text"))
    cells = lab.select("doc_id", F.expr(
        "stack(2, 'quality', quality, 'toxic', toxic) as (cat, vals)"))
    cells = cells.withColumn(
        "vals", F.when((F.col("doc_id") % 5 == 0) & F.col("vals").isNotNull(), F.lit(-1))
        .otherwise(F.col("vals")))
    rows = cells.withColumn("mimic_id", name)
    return rows.join(doc, "mimic_id" if dealt else "doc_id").select(
        "mimic_id",
        F.col("text").alias("report"),
        "cat",
        F.col("vals").cast("int").alias("vals"),
        pieces("text").alias("sents"),
        *(["digest"] if digest else []),
    )


# Demo dictionaries bound to the driver vocabulary (not clinical content).
DEMO_PHRASES = [
    ("Cardiomegaly", "th", "mention"),
    ("Cardiomegaly", "that the", "unmention"),
    ("Edema", "and", "mention"),
    ("Edema", "and the", "unmention"),
    ("Lung Opacity", "with", "mention"),
    ("Pleural Effusion", "of the", "mention"),
    ("Support Devices", "for", "mention"),
    ("Enlarged Cardiomediastinum", "this", "mention"),
    ("No Finding", "is", "mention"),
]

DEMO_PATTERNS = [
    ("pre_uncertain", "(^| )be {m}"),
    ("negation", "(^| )(not|no|without) ([a-z]+ ){0,2}{m}"),
    ("negation", "(^| )to {m}"),
    ("post_uncertain", "{m}[a-z]* (is|was)( |$)"),
    ("post_uncertain", "(^| )was {m}"),
]


def phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEMO_PHRASES, "observation string, phrase string, kind string")


def patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEMO_PATTERNS, "role string, pattern string")
