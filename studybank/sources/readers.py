"""Readers: every input format of the pipeline, with explicit schemas.

All readers are lazy DataFrame scans.  A report tree is listed and read by the executors; of its files the driver
learns only how many there are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studybank.functions.text import file_stem, parent_stem, template
from studybank.session import cut_lineage, deals
from studybank.sources.writers import store_of

SECTIONED_SCHEMA = "study_id string, report string"
SPLIT_SCHEMA = "index long, study_id string, path string, report string"
LABEL_SCHEMA = "mimic_id string, report string, cat string, vals int, sents string"
LABEL_TEXT_SCHEMA = "digest string, report string"
REPORT_SCHEMA = "report string"


#: Bytes of small files that one task reads; tasks for each core, at least.
TASK_BYTES, CORE_TASKS = 64 << 20, 4
#: Names of a folder, and bytes of texts, that a task hands on at a time.
LIST_ROWS, GIVE_BYTES = 10_000, 4 << 20


def in_few_tasks(files: DataFrame) -> DataFrame:
    """A scan of whole files with tasks by their bytes.

    Spark counts the opening of a file as 4 MB, so a folder of small files makes a task (and its report to the driver) for
    every 32 of them; a task here takes many such splits."""
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(CORE_TASKS * cores, -(-size // TASK_BYTES)))


def _entries(store, place: str, name: re.Pattern) -> Iterator[tuple[str, bool, int]]:
    """(name, is a folder, bytes) of what a folder holds under fitting names; a local one is not held in memory."""
    from pyarrow import fs
    if not isinstance(store, fs.LocalFileSystem):
        for x in store.get_file_info(fs.FileSelector(place)):
            if name.fullmatch(x.base_name):
                yield x.base_name, x.type == fs.FileType.Directory, x.size or 0
        return
    with os.scandir(place) as found:
        for x in found:
            if name.fullmatch(x.name) and os.path.exists(x.path):
                yield x.name, x.is_dir(), x.stat().st_size


def _inside(root: str, name: str, folders: bool) -> Callable:
    """A step from folders (paths below ``root``) to the ``(path, bytes)`` of the folders, or else files, in them."""
    fits = re.compile(name, re.DOTALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(root)
        for b in batches:
            rows: list[tuple[str, int]] = []
            for folder in b.column("path").to_pylist():
                for found, is_folder, size in _entries(store, top + folder, fits):
                    if is_folder == folders:
                        rows.append((f"{folder}/{found}", size))
                    if len(rows) >= LIST_ROWS:
                        yield _named(rows)
                        rows = []
            yield _named(rows)
    return run


def _named(rows: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": pa.array([r[0] for r in rows], pa.string()), "bytes": pa.array([r[1] for r in rows], pa.int64())})


def _contents(root: str) -> Callable:
    """A step from files (paths below ``root``) to their paths, written as in a URI, and contents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(root)
        for b in batches:
            paths, data, held = [], [], 0
            for path in b.column("path").to_pylist():
                with store.open_input_stream(top + path, compression=None) as file:
                    data.append(file.read())
                paths.append(_as_uri(path))
                held += len(data[-1])
                if held >= GIVE_BYTES:
                    yield pa.RecordBatch.from_pydict({"_p": pa.array(paths, pa.string()), "data": pa.array(data, pa.binary())})
                    paths, data, held = [], [], 0
            yield pa.RecordBatch.from_pydict({"_p": pa.array(paths, pa.string()), "data": pa.array(data, pa.binary())})
    return run


def _as_uri(path: str) -> str:
    """The path as ``_metadata.file_path`` has it."""
    return re.sub(r"[^\w/@,;:$&+=.!~'()*-]", lambda m: m.group() if m.group() > "\xa0" and m.group().isprintable() else quote(m.group(), safe=""), path)


def _tree_files(spark: SparkSession, root: str) -> DataFrame | None:
    """``(_p, text)`` of the files ``<root>/p??/p*/s*.txt``, listed and read by the executors through Arrow's file systems.

    A listing by Spark's reader takes a path of its own for every file a glob fits, and the driver keeps them all.  None, if
    ``root`` is a pattern itself or in a store that Arrow doesn't reach.  As with Spark's reader, no file at all is an error
    and empty files are left out."""
    if re.search(r"[*?\[{\\]", root):
        return None
    try:
        store, top = store_of(root)
        groups = [(f"/{name}",) for name, is_folder, _ in _entries(store, top, re.compile("p..", re.DOTALL)) if is_folder]
    except (pa.ArrowException, ImportError):
        return None
    tasks = CORE_TASKS * spark.sparkContext.defaultParallelism
    patients = spark.createDataFrame(groups, "path string").mapInArrow(_inside(root, "p.*", True), "path string, bytes long")
    found = patients.repartition(tasks, "path").mapInArrow(_inside(root, r"s.*\.txt", False), "path string, bytes long")
    files = cut_lineage(found, "report_list")
    n, size = files.agg(F.count("path"), F.sum("bytes")).first()
    if not n:
        raise FileNotFoundError(f"no reports p??/p*/s*.txt in {root}")
    dealt = files.where("bytes > 0").select("path").repartition(max(tasks, -(-size // TASK_BYTES)), "path")
    return dealt.mapInArrow(_contents(root), "_p string, data binary").select(F.col("data").cast("string").alias("text"), "_p")


def read_report_tree(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/pNN/pNNNNNNNN/sNNNNNNNN.txt`` -> ``(study_id, group, patient, text)``;
    one row per file with its whole text.  Group folders are ``p`` + 2 chars,
    patient folders start with ``p``, report files with ``s``."""
    df = _tree_files(spark, root.rstrip("/"))
    if df is None:
        files = spark.read.text(f"{root.rstrip('/')}/p??/p*/s*.txt", wholetext=True)
        df = in_few_tasks(files.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_p")))
    parts = F.regexp_extract("_p", r"/(p[^/]{2})/(p[^/]*)/(s[^/]*)\.txt$", 0)
    return (df.where(parts != "")
            .select(F.regexp_extract("_p", r"/(s[^/]*)\.txt$", 1).alias("study_id"),
                    F.regexp_extract("_p", r"/(p[^/]{2})/p[^/]*/s[^/]*\.txt$", 1).alias("group"),
                    F.regexp_extract("_p", r"/(p[^/]*)/s[^/]*\.txt$", 1).alias("patient"),
                    "text"))


def read_sectioned(spark: SparkSession, folder: str) -> DataFrame:
    """Headerless ``(study_id, report)`` CSV files of a folder (recursively);
    quoted fields may hold quotes and newlines."""
    return (spark.read.schema(SECTIONED_SCHEMA)
            .option("header", False).option("multiLine", True)
            .option("quote", '"').option("escape", '"')
            .option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
            .csv(folder))


def read_text_folder(spark: SparkSession, folder: str, templated: bool = False) -> DataFrame:
    """``**/*.txt`` -> ``(study_id = file stem, report = whole text)``, with the
    optional caption template."""
    df = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt")
          .text(folder, wholetext=True))
    text = template(F.col("value")) if templated else F.col("value")
    return in_few_tasks(df.select(file_stem(F.col("_metadata.file_path")).alias("study_id"), text.alias("report")))


def list_images(spark: SparkSession, folder: str, fmt: str = "png",
                level: str = "study") -> DataFrame:
    """Image files -> ``(study_id, path)``; the key is the parent folder
    (study level) or the file stem (file level).  Only the path column is read;
    file contents are pruned away."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
          .option("pathGlobFilter", f"*.{fmt}").load(folder).select("path"))
    df = in_few_tasks(df)
    key = parent_stem(F.col("path")) if level == "study" else file_stem(F.col("path"))
    return df.select(key.alias("study_id"), "path")


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Split CSV with a header and a stored index column -> ``(study_id, path, report)``."""
    df = (spark.read.schema(SPLIT_SCHEMA).option("header", True).option("multiLine", True)
          .option("escape", '"').csv(path))
    out = df.drop("index")
    return out.withColumn("split", F.lit(split)) if split else out


def read_sentence_labels(spark: SparkSession, folder: str, texts: str | None = None) -> DataFrame:
    """Union of all label CSVs under a folder (header, fixed schema; compressed or not); with ``texts``, the folder of their
    reports, each row's digest is replaced by its report.

    A report stands on each of its rows, so the join's partitions are those that a writer stores the reports in once."""
    def csv(schema: str, where: str) -> DataFrame:
        return (spark.read.schema(schema).option("header", True).option("multiLine", True)
                .option("escape", '"').option("recursiveFileLookup", True)
                .option("pathGlobFilter", "*.{csv,csv.gz}").csv(where))

    rows = csv(LABEL_SCHEMA, folder)
    if not texts:
        return rows
    reports = csv(LABEL_TEXT_SCHEMA, texts)
    reports = reports.repartition(deals(reports.select(F.octet_length("report").alias("n")), "n"), "digest")
    return rows.withColumnRenamed("report", "digest").join(reports, "digest", "left").select(*rows.columns)


def read_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Embedding batches (Parquet, partitioned by case / embed_type)."""
    return spark.read.parquet(folder)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One report per line of a headerless CSV; a missing report stays null."""
    return (spark.read.schema(REPORT_SCHEMA).option("header", False).option("multiLine", True)
            .option("escape", '"').csv(path))


def read_phrases(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Phrase files ``<observation>.txt`` -> ``(observation, phrase, kind)``."""
    from studybank.operators.mentions import load_phrases
    lines = spark.read.text(f"{folder.rstrip('/')}/*.txt").select(
        "value", F.col("_metadata.file_path").alias("path"))
    return load_phrases(lines, kind)


def read_phrase_folders(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The phrase folders of ``write_phrases`` -> ``(observation, phrase, kind)``."""
    from studybank.operators.mentions import load_phrases
    lines = spark.read.schema("value string, observation string").text(folder)
    return load_phrases(lines.select("value", F.concat("observation", F.lit(".txt")).alias("path")), kind)


def read_patterns(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Assertion pattern files in fixed roles -> ``(role, pattern)``."""
    out = None
    for role, path in paths.items():
        df = spark.read.text(path).select(F.lit(role).alias("role"),
                                          F.btrim(F.col("value")).alias("pattern"))
        out = df if out is None else out.unionByName(df)
    return out.where(F.col("pattern") != "")


MODEL_SCHEMA = T.StructType([T.StructField("models", T.ArrayType(T.StructType([
    T.StructField("model_path", T.StringType()), T.StructField("image_encoder", T.StringType()),
    T.StructField("text_encoder", T.StringType()), T.StructField("add_projection", T.BooleanType()),
    T.StructField("embed_dim", T.IntegerType())])))])


def read_model_config(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON config -> one row per model entry."""
    return (spark.read.schema(MODEL_SCHEMA).option("multiLine", True).json(path)
            .select(F.explode("models").alias("m")).select("m.*"))


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics history of all cases and runs; columns that a run lacks are null."""
    return spark.read.option("mergeSchema", True).parquet(folder).drop("run")


def read_images(spark: SparkSession, folder: str, mode: str = "drop") -> DataFrame:
    """Decoded images ``(path, height, width, nChannels, mode, data)``.
    ``mode='drop'`` skips unreadable files; ``'fail'`` aborts on them."""
    df = (spark.read.format("image").option("recursiveFileLookup", True)
          .option("dropInvalid", mode == "drop").load(folder))
    df = in_few_tasks(df)
    if mode == "fail":
        # undecodable files come back with height -1: stop the job on them
        df = df.withColumn("image", F.when(F.col("image.height") < 0, F.raise_error(
            F.concat(F.lit("unreadable image "), F.col("image.origin")))).otherwise(F.col("image")))
    return df.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"),
                     F.col("image.width").alias("width"), F.col("image.nChannels").alias("nChannels"),
                     F.col("image.mode").alias("mode"), F.col("image.data").alias("data"))
