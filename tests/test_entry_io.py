"""Driver contract, encoders, images, readers and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from studybank.operators import encode as E
from studybank.operators import images as I
from studybank.plans import bindings as B
from studybank.session import shared_dir
from studybank.sources import readers as R
from studybank.sources import writers as W
from studybank.streaming.reports import label_stream, report_stream

from conftest import SF


def test_entry_contract(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.columns == ["flat_hit", "hits", "precision", "recall", "f1", "duplicates", "k",
                          "test_instances"]
    qs, sql = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 118


def test_hashed_encoder_matches_rule(spark):
    df = spark.createDataFrame([("a", "The the cat"), ("b", "")], "study_id string, report string")
    out = {r.study_id: np.array(r.embs) for r in
           E.embed(df, E.HashedNgramEncoder(dim=16), "report", ["study_id"], precision="double").collect()}
    want = np.zeros(16)
    for g in ["the", "the", "cat", "the the", "the cat"]:
        want[E.gram_bucket(g, 16)] += 1
    assert np.allclose(out["a"], want / np.linalg.norm(want))
    assert np.allclose(out["b"], 0)


def test_masked_mean_pool(spark):
    tokens = spark.createDataFrame([(1, [1, 2, 0], [1, 1, 0]), (2, [0, 0], [0, 0])],
                                   "doc_id int, input_ids array<int>, attention_mask array<int>")
    vocab = spark.createDataFrame([(0, [9.0, 9.0]), (1, [1.0, 2.0]), (2, [3.0, 4.0])],
                                  "token_id int, vector array<double>")
    got = {r.doc_id: r.pooled for r in E.masked_mean_pool(tokens, vocab, dim=2).collect()}
    assert got == {1: [2.0, 3.0], 2: [0.0, 0.0]}


def test_image_pipeline_and_error_policy(spark):
    root = shared_dir(spark, "img_test")
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    colour = np.stack([grey, grey, grey], axis=2)
    files = spark.createDataFrame(
        [(f"{root}/s1/a.png", bytearray(I.png_bytes(grey))),
         (f"{root}/s2/b.png", bytearray(I.png_bytes(colour))),
         (f"{root}/s3/broken.png", bytearray(b"not an image"))], "path string, data binary")
    W.materialise(W.write_files(files))
    assert R.list_images(spark, root).count() == 3
    imgs = R.read_images(spark, root, mode="drop")
    assert imgs.count() == 2
    with pytest.raises(Exception):
        R.read_images(spark, root, mode="fail").collect()
    rgb = I.to_rgb(imgs)
    assert {r.nChannels for r in rgb.collect()} == {3}
    big = I.resize(rgb, 6)
    assert {(r.height, r.width) for r in big.collect()} == {(6, 8)}
    boxes = I.crop_boxes(big, mode="random", seed=1).collect()
    for r in boxes:
        assert 0 <= r.box_x <= r.width - r.box_side and 0 <= r.box_y <= r.height - r.box_side
        assert r.box_side * r.box_side >= 0.75 * r.height * r.width - 2 * r.box_side - 1
    t = I.to_tensor(I.crop_boxes(big, mode="center"), size=4).collect()
    assert all(len(r.tensor) == 3 * 4 * 4 for r in t)


def test_sectioned_csv_quotes_and_newlines(spark):
    out = shared_dir(spark, "csv_test")
    df = spark.createDataFrame([("s1", 'say "hi",\nnext line'), ("s2", "")],
                               "study_id string, report string")
    W.write_sectioned(df, out)
    back = {r.study_id: r.report for r in R.read_sectioned(spark, out).collect()}
    assert back["s1"] == 'say "hi",\nnext line'


def test_streaming_equals_batch(spark):
    src = shared_dir(spark, "stream_in")
    reports = B.reports(spark, SF)
    reports.repartition(3).write.parquet(src)
    out = shared_dir(spark, "stream_out")
    q = label_stream(report_stream(spark, src, max_files=1), B.phrases(spark), B.patterns(spark),
                     out, shared_dir(spark, "stream_ckpt"))
    q.awaitTermination()
    from studybank.plans import labeller
    batch = labeller.label_rows(reports, B.phrases(spark), B.patterns(spark))
    streamed = spark.read.parquet(out).drop("batch_id")
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0


def test_csv_keeps_white_space_at_the_ends(spark, tmp_path):
    from studybank.sources import readers as R
    from studybank.sources import writers as W
    rows = [("s1", " a b "), ("s2", "\nx\n"), ("s3", '"q", r')]
    W.write_sectioned(spark.createDataFrame(rows, "study_id string, report string"), str(tmp_path / "out"))
    assert sorted(map(tuple, R.read_sectioned(spark, str(tmp_path / "out")).collect())) == rows
