"""Writers: every output of the pipeline.  Distributed writes only (no driver
buffering); output batching is ``maxRecordsPerFile``, not a row counter."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Every cell is quoted and written whole: Spark's default cuts the white space at both ends.
CSV = {"quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_sectioned(df: DataFrame, out: str, max_rows: int = 10000, single: bool = False) -> None:
    """Headerless ``(study_id, report)`` CSV, files of at most ``max_rows`` rows
    (or one file)."""
    data = df.select("study_id", "report")
    if single:
        data = data.coalesce(1)
    (data.write.mode("overwrite").option("maxRecordsPerFile", max_rows)
     .options(**CSV).csv(out))


def write_splits(df: DataFrame, out: str) -> None:
    """train / val / test in one table partitioned by ``split``."""
    df.write.mode("overwrite").partitionBy("split").parquet(out)


def write_split_csv(df: DataFrame, out: str) -> None:
    """Split rows as CSV with a header and an index column."""
    (df.select("index", "study_id", "path", "report").write.mode("overwrite")
     .option("header", True).options(**CSV).csv(out))


def write_bank_query(df: DataFrame, out: str) -> None:
    df.write.mode("overwrite").partitionBy("role").parquet(out)


def write_embeddings(df: DataFrame, out: str, max_rows: int = 50000) -> None:
    """Embedding batches partitioned by ``case`` and ``embed_type``."""
    (df.write.mode("overwrite").option("maxRecordsPerFile", max_rows)
     .partitionBy("case", "embed_type").parquet(out))


def text_digest(col: str) -> Column:
    return F.sha2(F.col(col).cast("binary"), 256)


def write_sentence_labels(df: DataFrame, out: str, texts: str | None = None, reports: DataFrame | None = None) -> None:
    """Label rows ``(mimic_id, report, cat, vals, sents)`` as compressed CSV with a header.

    With a folder ``texts``, each different report is written there once, as ``(digest, report)``, and the label rows hold
    its digest: a report's text is not written again for each of its sentences.  Rows may bring it as ``digest``,
    and ``reports`` the reports ``(report)`` of all rows, if they are at hand without being repeated."""
    csv = CSV | {"header": True, "compression": "gzip"}
    if texts:
        reports = (df if reports is None else reports).select("report").where("report IS NOT NULL").distinct()
        reports.select(text_digest("report").alias("digest"), "report").write.mode("overwrite").options(**csv).csv(texts)
        df = df.withColumn("report", F.col("digest") if "digest" in df.columns else text_digest("report"))
    df.drop("digest").write.mode("overwrite").options(**csv).csv(out)


def write_preds(df: DataFrame, out: str) -> None:
    df.select("study_id", "query", "hit_classes", "out").write.mode("overwrite").json(out)


#: Columns that tell one run of a case from another.
RUN_COLUMNS = ("k", "bank", "query", "test_size", "random_state")


def append_metrics(df: DataFrame, out: str) -> None:
    """Append metrics rows to the history (no read-modify-write), in a folder for each case and run.

    A run is named by a digest of its RUN_COLUMNS, those it has; the same run written again, as by a retried job,
    replaces its own folder and no other.  Rows may have columns that earlier ones lack."""
    named = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("~"))) for c in RUN_COLUMNS if c in df.columns]
    (df.withColumn("run", F.md5(F.concat_ws("\n", *named))).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("case", "run").parquet(out))


def store_of(path: str):
    """(file system, path on it) of a path or URI (local, mounted, or a store that Arrow reaches), on any executor."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def put_file(path: str, data: bytes) -> None:
    """One file, whole or not at all: written under another name that no reader lists, then renamed.  A task that is run again
    replaces its files by equal ones."""
    store, place = store_of(path)
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    draft = f"{place}.{uuid.uuid4().hex}.tmp"
    try:
        with store.open_output_stream(draft) as out:
            out.write(data)
        store.move(draft, place)
    except BaseException:
        from pyarrow import fs
        if store.get_file_info(draft).type == fs.FileType.File:
            store.delete_file(draft)
        raise


def write_text_tree(df: DataFrame, root: str, key: str = "study_id", group: str = "group",
                    patient: str = "patient", text: str = "text") -> DataFrame:
    """One text file per row under ``root/group/patient/key.txt``, written by the
    executors; returns ``(path)`` of the written files."""
    path = F.concat_ws("/", F.lit(root.rstrip("/")), F.col(group), F.col(patient), F.concat(F.col(key), F.lit(".txt")))
    return write_files(df.select(path.alias("path"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")))


def write_files(df: DataFrame, path_col: str = "path", data_col: str = "data") -> DataFrame:
    """Write binary cells to the given paths (executor side); returns the paths."""
    def run(batches):
        for pdf in batches:
            for p, b in zip(pdf[path_col], pdf[data_col]):
                put_file(p, bytes(b))
            yield pdf[[path_col]]
    return df.select(path_col, data_col).mapInPandas(run, f"{path_col} string")


def write_phrases(df: DataFrame, out: str) -> None:
    """Distinct phrases ``(observation, phrase)``, one a line, in a folder ``<observation>`` each of any number of files."""
    df.select("observation", "phrase").distinct().write.mode("overwrite").partitionBy("observation").text(out)


def write_images(df: DataFrame, out: str) -> None:
    """Resized images as Parquet rows ``(path, height, width, nChannels, data)``."""
    df.select("path", "height", "width", "nChannels", "data").write.mode("overwrite").parquet(out)


def materialise(df: DataFrame) -> None:
    """Run a writer plan that returns rows (file writers above) to completion."""
    df.write.format("noop").mode("overwrite").save()
