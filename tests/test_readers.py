"""Readers for the plug-in files: assertion patterns, phrase files, model config."""

import json
import re

import pytest
from pyspark.sql import functions as F

from studybank.session import shared_dir
from studybank.sources import readers as R
from studybank.sources import writers as W


def _write(spark, path, body):
    df = spark.createDataFrame([(path, bytearray(body.encode()))], "path string, data binary")
    W.materialise(W.write_files(df))


def test_read_patterns_roles_and_blank_lines(spark):
    root = shared_dir(spark, "pat_test")
    files = {"negation": f"{root}/neg.txt", "pre_uncertain": f"{root}/pre.txt"}
    _write(spark, files["negation"], "(^| )no {m}\n\n  \n(^| )not {m}\n")
    _write(spark, files["pre_uncertain"], "(^| )may {m}\n")
    got = sorted((r.role, r.pattern) for r in R.read_patterns(spark, files).collect())
    assert got == [("negation", "(^| )no {m}"), ("negation", "(^| )not {m}"),
                   ("pre_uncertain", "(^| )may {m}")]


def test_phrase_dictionary_gathers_no_vocabulary(spark, monkeypatch):
    """A language's words are written as rows, in several files, not as one cell."""
    from studybank.plans import q_io
    from studybank.sources import writers as W
    plans = []
    seen = W.write_files
    monkeypatch.setattr(W, "write_files", lambda df, *a: plans.append(df) or seen(df, *a))
    got = sorted(map(tuple, q_io.q_phrase_dictionary(spark, "/root/testdata/sf0.001").collect()))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text").collect()
    first = {(r.lang, m.group().lower()) for r in docs if (m := re.match("[A-Za-z]+", r.text or ""))}
    assert got == sorted((lang.capitalize() + " Words", w, "mention") for lang, w in first)
    assert not plans


def test_read_phrases_observation_names(spark):
    root = shared_dir(spark, "phr_test")
    _write(spark, f"{root}/pleural_effusion.txt", "effusion\n\npleural_fluid\n")
    rows = sorted((r.observation, r.phrase, r.kind) for r in R.read_phrases(spark, root, "mention").collect())
    assert rows == [("Pleural Effusion", "effusion", "mention"),
                    ("Pleural Effusion", "pleural fluid", "mention")]


def test_read_model_config(spark):
    path = shared_dir(spark, "cfg_test") + "/config.json"
    cfg = {"models": [{"model_path": "m", "image_encoder": "grid-means",
                       "text_encoder": "hashed-ngrams", "add_projection": True, "embed_dim": 8}]}
    _write(spark, path, json.dumps(cfg, indent=2))
    rows = R.read_model_config(spark, path).collect()
    assert len(rows) == 1 and rows[0].embed_dim == 8 and rows[0].add_projection is True


def test_label_csvs_hold_each_report_once(spark, tmp_path):
    """The rows come back with their reports, which are not written again for each sentence."""
    texts = ['a "quoted", text\n' * 600, "short", None]
    rows = [(f"s{i % 4}", texts[i % 3], "A", i % 2, f"piece {i}") for i in range(300)] + [(None, texts[0], "B", None, None)] * 2
    long = spark.createDataFrame(rows, "mimic_id string, report string, cat string, vals int, sents string").repartition(3)
    out, apart = str(tmp_path / "labels"), str(tmp_path / "texts")
    W.write_sentence_labels(long, out, apart)
    back = R.read_sentence_labels(spark, out, apart)
    assert back.columns == long.columns
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.csv")) < 10 * len(texts[0])
    W.write_sentence_labels(long, out)
    assert sorted(map(tuple, R.read_sentence_labels(spark, out).collect()), key=str) == sorted(rows, key=str)


def test_small_files_are_read_in_few_tasks(spark, tmp_path):
    """Tasks go by bytes: a folder of small files doesn't make one for every few of them."""
    for i in range(120):
        (tmp_path / f"p1{i % 5}" / f"p10{i % 7}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"p1{i % 5}" / f"p10{i % 7}" / f"s{i}.txt").write_text(f"text {i}\nof it")
    key = "spark.sql.files.openCostInBytes"
    was = spark.conf.get(key)
    most = 4 * spark.sparkContext.defaultParallelism
    spark.conf.set(key, str(128 << 20))
    try:
        tree, folder = R.read_report_tree(spark, str(tmp_path)), R.read_text_folder(spark, str(tmp_path))
        assert most < 120 and tree.rdd.getNumPartitions() <= most and folder.rdd.getNumPartitions() <= most
        assert sorted(r.text for r in tree.collect()) == sorted(r.report for r in folder.collect()) == sorted(f"text {i}\nof it" for i in range(120))
        assert {(r.study_id, r.group, r.patient) for r in tree.collect()} == {(f"s{i}", f"p1{i % 5}", f"p10{i % 7}") for i in range(120)}
    finally:
        spark.conf.set(key, was)


def test_a_report_tree_is_listed_and_read_by_the_executors(spark, tmp_path):
    """The plan holds no path for each report, and the rows are those of Spark's own reader, which patterns still go to."""
    files = {f"p1{i % 3}/p10{i % 7}/s{i}.txt": f"text {i}\n\r\nof it".encode() for i in range(90)}
    files |= {"p10/p1 0/s a%+é  [1].txt": b"odd name", "p10/p100/s500.txt": b"", "p10/p100/s501.txt": b"\xff caf\xe9\x00",
              "p10/p100/x1.txt": b"no report", "p10/p100/s1.text": b"no", "p100/p1/s2.txt": b"no group", "p10/q1/s3.txt": b"no patient",
              "p10/p100/deep/s4.txt": b"too deep", "p 1/p1/s5.txt": b"a group that URIs write longer", "p10/s6.txt": b"no patient"}
    for name, data in files.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_bytes(data)
    (tmp_path / "tree" / "p10" / "p100" / "s7.txt").mkdir()

    def rows(df):
        return sorted(map(tuple, df.selectExpr("study_id", "`group`", "patient", "hex(cast(text AS binary)) AS text").collect()))
    whole = R.read_report_tree(spark, str(tmp_path / "tree"))
    assert not [f for f in whole.inputFiles() if f.endswith(".txt")]
    assert rows(whole) == rows(R.read_report_tree(spark, str(tmp_path / "[t]ree"))) and whole.count() == 92
    assert rows(R.read_report_tree(spark, f"file:{tmp_path}/tree/")) == rows(whole)
    for nothing in (tmp_path / "tree" / "p11", tmp_path / "none"):
        with pytest.raises(Exception):
            R.read_report_tree(spark, str(nothing)).collect()


def test_label_rows_come_back_with_reports_that_a_file_holds_once(spark, tmp_path):
    """Rows of a report stay together in small partitions, so that the Parquet writer's dictionary has it once; files are compressed."""
    texts = [f"report {i} " + "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(20_000)) for i in range(150)]
    long = spark.createDataFrame([(f"s{i}", t, "A", i % 2) for i, t in enumerate(texts)], "mimic_id string, report string, cat string, vals int")
    long = long.withColumn("sents", F.explode(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("piece "), i.cast("string")))))
    out, apart = str(tmp_path / "labels"), str(tmp_path / "texts")
    W.write_sentence_labels(long.withColumn("digest", W.text_digest("report")), out, apart, long.select("report").distinct())
    assert not list(tmp_path.rglob("*.csv")) and list(tmp_path.rglob("*.csv.gz"))
    back = R.read_sentence_labels(spark, out, apart)
    assert back.columns == ["mimic_id", "report", "cat", "vals", "sents"]
    threshold, was = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(threshold, "-1")
    try:
        back.write.option("compression", "none").parquet(str(tmp_path / "back"))
    finally:
        spark.conf.set(threshold, was)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "back")).collect())) == sorted(map(tuple, long.collect()))
    assert sum(p.stat().st_size for p in (tmp_path / "back").rglob("*.parquet")) < 3 * sum(map(len, texts))
    # plain files of others are read as well
    long.drop("digest").where("vals = 1").write.option("header", True).options(**W.CSV).csv(str(tmp_path / "labels" / "more"))
    assert R.read_sentence_labels(spark, out).count() == 30 * (150 + 75)
