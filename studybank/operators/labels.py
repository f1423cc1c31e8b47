"""Label tables: long <-> wide, the two collapse rules, document labels and
the joins that attach labels to embeddings.

Long form ``(id, cat, val)`` is canonical; wide vectors are derived with an
explicit category list (never inferred).  All collapses use partial
aggregates (``max``, ``bool_or``, ``count``) so no group is gathered in one
place even when one study holds a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studybank import constants as K
from studybank.session import deals


def pivot_labels(long: DataFrame, categories=K.CATEGORIES, cat: str = "cat",
                 val: str = "vals") -> DataFrame:
    """One column per category holding ``val`` on that category's rows and
    null elsewhere (0 stays a value)."""
    return long.select("*", *[F.when(F.col(cat) == c, F.col(val)).cast("int").alias(c)
                              for c in categories])


def collapse_labels(long: DataFrame, keys, categories=K.CATEGORIES, cat: str = "cat",
                    val: str = "vals", drop_null_keys: bool = True) -> DataFrame:
    """Evaluation collapse: per key and category the *maximum* value
    (1 > 0 > -1; {0,-1} -> 0).  Rows with a null key are dropped."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    src = long
    if drop_null_keys:
        for k in keys:
            src = src.where(F.col(k).isNotNull())
    return src.groupBy(*keys).agg(*[
        F.max(F.when(F.col(cat) == c, F.col(val))).cast("int").alias(c)
        for c in categories])


def resolve_rule(v: Column) -> list[Column]:
    """Aggregates that resolve conflicting mentions of one category:
    {0,-1} -> -1 (wins even with 1 present), else {0,1} -> 1, else {-1,1} -> 1,
    else the shared value."""
    has0 = F.bool_or(v == K.NEGATIVE)
    hasu = F.bool_or(v == K.UNCERTAIN)
    has1 = F.bool_or(v == K.POSITIVE)
    return [F.when(has0 & hasu, F.lit(K.UNCERTAIN))
            .when(has0 & has1, F.lit(K.POSITIVE))
            .when(hasu & has1, F.lit(K.POSITIVE))
            .otherwise(F.min(v)).cast("int")]


def resolve_conflicts(long: DataFrame, keys, cat: str = "cat", val: str = "val",
                      out: str = "val") -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return long.groupBy(*keys, cat).agg(resolve_rule(F.col(val))[0].alias(out))


def label_list(sentences: Column, found: Column, passage: Column) -> Column:
    """``(cat, val, sents, rule)`` label rows of one document, as a list,
    before conflict resolution:

    * each mention outside ``No Finding`` gives (observation, label, sentence);
    * a positive/uncertain mention whose text is ``chf`` or ``heart failure``
      also gives (Cardiomegaly, -1, sentence);
    * a document where no mention outside Support Devices is positive or
      uncertain gives (No Finding, 1, whole passage) — documents without any
      mention included.

    ``sentences`` and ``found`` are the lists of ``mentions.document_mentions``."""
    def row(cat, val, sents, rule):
        return F.struct(cat.alias("cat"), val.cast("int").alias("val"), sents.alias("sents"),
                        F.lit(rule).alias("rule"))

    def asserted(m):
        return m["label"].isin(K.POSITIVE, K.UNCERTAIN)

    own = F.transform(F.filter(found, lambda m: m["observation"] != K.NO_FINDING),
                      lambda m: row(m["observation"], m["label"], F.get(sentences, m["pos"]), "mention"))
    hf = F.transform(F.filter(found, lambda m: asserted(m) & m["mention"].isin(*K.HEART_FAILURE_TEXTS)),
                     lambda m: row(F.lit(K.CARDIOMEGALY), F.lit(K.UNCERTAIN), F.get(sentences, m["pos"]),
                                   "heart_failure"))
    finding = F.exists(found, lambda m: (m["observation"] != K.SUPPORT_DEVICES) & asserted(m))
    none = F.filter(F.array(row(F.lit(K.NO_FINDING), F.lit(K.POSITIVE), passage, "no_finding")), lambda m: ~finding)
    return F.concat(own, hf, none)


def resolved_vector(rows: Column, categories=K.CATEGORIES) -> list[Column]:
    """The columns of one document's resolved vector from its list of label rows (``resolve_rule``)."""
    seen = F.array_distinct(F.transform(rows, lambda r: F.concat_ws(":", r["cat"], r["val"].cast("string"))))

    def value(c: str) -> Column:
        has0, hasu, has1 = (F.array_contains(F.col("_seen"), f"{c}:{v}")
                            for v in (K.NEGATIVE, K.UNCERTAIN, K.POSITIVE))
        return (F.when(has0 & hasu, F.lit(K.UNCERTAIN)).when(has1, F.lit(K.POSITIVE))
                .when(has0, F.lit(K.NEGATIVE)).when(hasu, F.lit(K.UNCERTAIN)).cast("int").alias(c))
    return [seen.alias("_seen"), *[value(c) for c in categories]]


def attach_labels(embs: DataFrame, long: DataFrame, level: str = "study",
                  categories=K.CATEGORIES, key: str = "study_id",
                  target: str = "target") -> DataFrame:
    """Left-join collapsed label vectors to embeddings: study level on
    ``study_id = mimic_id``, sentence level on (``study_id, target``) =
    (``mimic_id, sents``).  No embedding row is lost."""
    if level == "study":
        lab = collapse_labels(long, ["mimic_id"], categories)
        return embs.join(lab, embs[key] == lab["mimic_id"], "left").drop("mimic_id")
    if level == "sentence":
        lab = collapse_labels(long, ["mimic_id", "sents"], categories)
        cond = (embs[key] == lab["mimic_id"]) & (embs[target] == lab["sents"])
        return embs.join(lab, cond, "left").drop("mimic_id", "sents")
    raise ValueError("level must be 'study' or 'sentence'")


def label_cells(rows: DataFrame, long: DataFrame, level: str, ident: str, key: str = "study_id",
                target: str = "target") -> DataFrame:
    """``(id, cat, val)``: the non-null label cells of ``rows`` (``ident``, study, text), the highest value of each category
    over the row's study (``level="study"``) or over its sentence (``"sentence"``: equal study and text)."""
    own = rows.select(F.col(ident).alias("id"), F.col(key).alias("_k"), F.col(target).alias("_t"))
    lab = long.where("vals IS NOT NULL").select("mimic_id", "sents", "cat", "vals")
    same = F.col("_k") == F.col("mimic_id")
    if level == "sentence":
        same &= F.col("_t") == F.col("sents")
    elif level != "study":
        raise ValueError("level must be 'study' or 'sentence'")
    return own.join(lab, same).groupBy("id", "cat").agg(F.max("vals").alias("val"))


def attach_report(embs: DataFrame, long: DataFrame, key: str = "study_id",
                  every: bool = False) -> DataFrame:
    """Attach the report text of each study: the smallest, so the join never fans out, or with
    ``every`` a row for each different text of the study.

    ``long`` repeats a report on each of its rows: equal ones are merged by hash where they lie, as the minimum of
    strings would sort (and spill) every row with its whole report.  The count, always above 0, keeps the optimizer
    from leaving that step out before the minimum.

    If a study has many rows, its report stands on each.  Rows of ``long`` that are dealt by ``mimic_id`` (see
    ``session.deals``) stay where they are, in partitions that a writer stores the reports in once."""
    rep = long.groupBy("mimic_id", "report").agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").drop("_n")
    if not every:
        rep = rep.groupBy("mimic_id").agg(F.min("report").alias("report"))
    return embs.join(rep, embs[key] == rep["mimic_id"], "left").drop("mimic_id")


def expand_sentences(studies: DataFrame, long: DataFrame, key: str = "study_id",
                     drop_null: bool = True) -> DataFrame:
    """Study rows -> one row per distinct labelled sentence of the study
    (``report`` becomes the sentence)."""
    lab = long.where(F.col("sents").isNotNull()) if drop_null else long
    if drop_null:
        lab = lab.dropna()
    sents = lab.select(F.col("mimic_id").alias(key), F.col("sents").alias("report")).distinct()
    others = [c for c in studies.columns if c != "report"]
    return studies.select(*others).join(sents, key).distinct()


def sentence_labels(label_rows: DataFrame, reports: DataFrame, key: str = "study_id",
                    report: str = "report") -> DataFrame:
    """``(mimic_id, report, cat, vals, sents)``: every report with the label rows
    of its key (null cat/vals/sents when it has none).

    A report stands on each of its rows, so the join's partitions are those that a writer stores the reports in once."""
    labels = label_rows.select(key, "cat", F.col("val").cast("int").alias("vals"), "sents")
    texts = reports.select(key, F.col(report).alias("report"))
    texts = texts.repartition(deals(texts.select(F.octet_length("report").alias("n")), "n"), key)
    return texts.join(labels, key, "left").withColumnRenamed(key, "mimic_id")


def pair_studies(images: DataFrame, reports: DataFrame, key: str = "study_id") -> DataFrame:
    """Images x reports on the study (M:N inner join)."""
    return images.join(reports, key, "inner")


def members(df: DataFrame, sample: DataFrame, key: str = "study_id",
            keep: bool = True) -> DataFrame:
    """Rows whose study is (semi-join) or is not (anti-join) in ``sample``."""
    return df.join(sample.select(key), key, "left_semi" if keep else "left_anti")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def all_null(cols) -> Column:
    """True when every listed column is null."""
    return F.coalesce(*[F.col(c) for c in cols]).isNull()
