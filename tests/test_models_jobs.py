"""Both sides of a model config, pooling by counts, images of mixed shapes, whole files, jobs from files to files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from studybank.operators import encode as E
from studybank.operators import images as I
from studybank.operators.text import word_dictionary
from studybank.plans import jobs
from studybank.session import shared_dir
from studybank.sources import readers as R
from studybank.sources import writers as W


def image_rows(spark):
    rng = np.random.default_rng(2)
    px = [rng.integers(0, 256, (h, w, c), dtype=np.uint8) for h, w, c in ((4, 4, 1), (6, 5, 3), (4, 4, 3), (4, 4, 1), (3, 9, 4), (6, 5, 3))]
    rows = [(f"s{i}", *p.shape, bytearray(p.tobytes())) for i, p in enumerate(px)]
    return px, spark.createDataFrame(rows, "study_id string, height int, width int, nChannels int, data binary")


def rgb(p):
    return np.repeat(p, 3, axis=2) if p.shape[2] == 1 else p[:, :, 2::-1]


def test_images_of_mixed_shapes_keep_their_places(spark):
    px, df = image_rows(spark)
    got = {r.study_id: np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels) for r in I.to_rgb(df.coalesce(1)).collect()}
    assert all((got[f"s{i}"] == rgb(p)).all() for i, p in enumerate(px))
    sized = {r.study_id: (r.height, r.width) for r in I.resize(I.to_rgb(df.coalesce(1)), 12).collect()}
    assert sized == {"s0": (12, 12), "s1": (14, 12), "s2": (12, 12), "s3": (12, 12), "s4": (12, 36), "s5": (14, 12)}
    flat = I.to_tensor(I.crop_boxes(I.to_rgb(df.coalesce(1)), mode="center"), size=4, mean=[0] * 3, std=[1] * 3).collect()
    one = {r.study_id: np.array(r.tensor).reshape(3, 4, 4) for r in flat}["s2"]
    assert np.allclose(one * 255, rgb(px[2]).transpose(2, 0, 1), atol=1e-4)


def test_both_sides_of_every_model_in_one_pass(spark):
    px, images = image_rows(spark)
    rng = np.random.default_rng(5)
    weights = {"text": rng.normal(size=(3, 64)), "image": rng.normal(size=(3, 48))}
    path = shared_dir(spark, "weights")
    spark.createDataFrame([(side, i, [float(x) for x in row], i / 7) for side, w in weights.items() for i, row in enumerate(w)],
                          "side string, row int, weights array<double>, bias double").write.parquet(path)
    cfg = [{"model_path": "none", "image_encoder": "grid-means", "text_encoder": "hashed-ngrams", "add_projection": False, "embed_dim": 8},
           {"model_path": path, "image_encoder": "grid-means", "text_encoder": "hashed-ngrams", "add_projection": True, "embed_dim": 3}]
    texts = spark.createDataFrame([("s0", "The the cat"), ("s1", ""), ("s2", None)], "study_id string, report string")
    images = I.to_rgb(images).withColumn("image", I.image_struct(None))
    out = E.embed_config(cfg, texts=texts, images=images, precision="double")
    assert str(out._jdf.queryExecution().executedPlan()).count("MapInPandas") == 2  # one for each side
    got = {(r.study_id, r["case"], r.embed_type): np.array(r.embs) for r in out.collect()}
    assert len(got) == 2 * 3 + 2 * 6

    def unit(x):
        return x / np.linalg.norm(x) if np.linalg.norm(x) else x

    grams = ["the", "the", "cat", "the the", "the cat"]
    for dim, case in ((8, "out_grihas_8"), (64, "out_grihas_3")):
        plain = np.bincount([E.gram_bucket(g, dim) for g in grams], minlength=dim).astype(float)
        for study, x in (("s0", plain), ("s1", 0 * plain), ("s2", 0 * plain)):
            x = x if dim == 8 else weights["text"] @ x + np.arange(3) / 7
            assert np.allclose(got[study, case, "text"], unit(x))
    means = np.array([rgb(px[2])[2 * i // 2:2 * i // 2 + 1, j:j + 1].mean(axis=(0, 1)) for i in range(4) for j in range(4)]).ravel()
    assert np.allclose(got["s2", "out_grihas_8", "image"], unit(means))
    assert np.allclose(got["s2", "out_grihas_3", "image"], unit(weights["image"] @ means + np.arange(3) / 7))
    with pytest.raises(ValueError):
        E.embed_config([cfg[1] | {"embed_dim": 4}], texts=texts)


def test_pooling_by_counts_broadcast_or_spread(spark, monkeypatch):
    rng = np.random.default_rng(1)
    docs = [(i, [int(x) for x in rng.integers(0, 3, 40)] + [9], [1] * 38 + [0, 1, 1]) for i in range(60)] + [(99, [1], [0])]
    vectors = {0: [1.0, 2.0], 1: [0.5, -1.0], 2: [3.0, 0.0]}
    tokens = spark.createDataFrame(docs, "doc_id int, input_ids array<int>, attention_mask array<int>")
    vocab = spark.createDataFrame(list(vectors.items()), "token_id int, vector array<double>")
    want = {}
    for i, ids, mask in docs:
        kept = [t for t, m in zip(ids, mask) if m]
        total = sum((np.array(vectors.get(t, [0, 0])) for t in kept), np.zeros(2))
        want[i] = (total / max(len(kept), 1e-9)).tolist()
    for size in (E.VOCAB_BYTES, 0):  # 9 is no token of the vocabulary
        monkeypatch.setattr(E, "VOCAB_BYTES", size)
        got = {r.doc_id: r.pooled for r in E.masked_mean_pool(tokens, vocab, dim=2).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)


def test_a_file_is_written_whole_or_not_at_all(spark, monkeypatch):
    root = shared_dir(spark, "files")
    W.put_file(f"{root}/a/b.txt", b"one")
    W.put_file(f"file:{root.removeprefix('file:')}/a/b.txt", b"two")
    folder = root.removeprefix("file:") + "/a"
    assert open(folder + "/b.txt", "rb").read() == b"two"

    class Broken(bytes):
        def __buffer__(self, flags):
            raise OSError("lost")

    with pytest.raises(Exception):
        W.put_file(f"{root}/a/c.txt", Broken(b"half"))
    assert os.listdir(folder) == ["b.txt"]


def test_every_word_of_whole_texts(spark):
    rows = [("en", "The cat. THE dog's 2nd café"), ("en", "cat"), ("fr", "le chat"), (None, "no"), ("en", None)]
    got = {(r.lang, r.word): r.texts for r in word_dictionary(spark.createDataFrame(rows, "lang string, text string")).collect()}
    assert got == {("en", w): n for w, n in (("the", 1), ("cat", 2), ("dog", 1), ("s", 1), ("nd", 1), ("café", 1))} | {
        ("fr", "le"): 1, ("fr", "chat"): 1}
    often = word_dictionary(spark.createDataFrame(rows, "lang string, text string"), share=0.7).collect()
    assert {(r.lang, r.word) for r in often} == {("en", "cat"), ("fr", "le"), ("fr", "chat")}


def test_jobs_from_files_to_files(spark):
    tree, out = shared_dir(spark, "tree"), shared_dir(spark, "out")
    body = "HDR\n FINDINGS: all clear\n IMPRESSION: no change\n"
    rows = [("s1", "p10", "p1000", body), ("s2", "p10", "p1001", "plain text"), ("s50525523", "p11", "p1100", "x" * 400)]
    W.materialise(W.write_text_tree(spark.createDataFrame(rows, "study_id string, `group` string, patient string, text string"), tree))
    jobs.create_section_files(spark, tree, out)
    got = {r.study_id: r.report for r in R.read_sectioned(spark, out).fillna("").collect()}
    assert got["s1"] == "no change" and got["s50525523"] == "x" * (349 - 201) and set(got) == {"s1", "s2", "s50525523"}
    joined = shared_dir(spark, "out")
    jobs.create_section_files(spark, tree, joined, concat=True, no_split=True)
    got = {r.study_id: r.report for r in R.read_sectioned(spark, joined).fillna("").collect()}
    assert got["s1"] == "no changeall clear" and set(got) == {"s1", "s2"}

    images = spark.createDataFrame([(f"s{i % 40}", f"i{i}") for i in range(80)], "study_id string, path string")
    reports = spark.createDataFrame([(f"s{i}", f"text {i}\nof it.more") for i in range(40)], "study_id string, report string")
    folder = shared_dir(spark, "subset")
    counts = {r.split: (r.studies, r.rows) for r in jobs.get_subset(images, reports, folder, 1.0, 0.5, 0.5).collect()}
    assert counts == {"train": (20, 40), "test": (10, 20), "val": (10, 20)}
    cut = jobs.bank_query_split(spark.read.parquet(folder), 0.5, 0.25, "path")
    assert {(r.role, r.split): r["count"] for r in cut.groupBy("role", "split").count().collect()}[("query", "test")] == 5
    assert cut.where("role = 'bank'").count() == 30
    texts = jobs.bank_texts(spark.read.parquet(folder), sentences=True)
    assert texts.count() == 80 and texts.where("target = 'text 3of it'").count() == 1
    bank = shared_dir(spark, "bank")
    cfg = [{"model_path": "none", "image_encoder": "grid-means", "text_encoder": "hashed-ngrams", "add_projection": False, "embed_dim": 8}]
    jobs.embed_bank(spark.read.parquet(folder), cfg, bank)
    assert R.read_embeddings(spark, bank).where("size(embs) = 8 AND embed_type = 'text'").count() == 40


def test_encoders_get_parts_of_a_batch(spark, monkeypatch):
    """An encoder gets few rows of a batch at a time, and every row has its vector."""
    import pandas as pd
    from studybank.operators import encode
    monkeypatch.setattr(encode, "PART_ROWS", 50, raising=False)
    frame = pd.DataFrame({"k": range(130), "v": [f"text {i}" for i in range(130)]})
    parts = list(encode._in_parts(iter([frame, frame[:0], frame[:50]])))
    assert [len(p) for p in parts] == [50, 50, 30, 50] and all(p.index[0] == 0 for p in parts)
    assert pd.concat(parts).equals(pd.concat([frame[:50], frame[50:100].reset_index(drop=True), frame[100:].reset_index(drop=True), frame[:50]]))

    class Most:
        kind, name, dim = "text", "most", 1

        def load(self):
            pass

        def encode(self, batch):
            if len(batch) > 500:
                raise ValueError(f"{len(batch)} rows at once")
            return np.ones((len(batch), 1))

    df = spark.range(3000).select(F.col("id").cast("string").alias("study_id"), F.lit("a text").alias("report")).coalesce(1)
    assert encode.embed(df, Most(), "report", ["study_id"]).select("study_id").distinct().count() == 3000
    sides = [encode.Model("c", Most())]
    assert encode.embed_models(df, sides, "report", ["study_id"], "text").count() == 3000


def test_plain_reports_are_read_once_for_their_sections(spark):
    """Whatever steps the overrides take, a report is read once to find whether it has one and once to be split."""
    from studybank.operators.sections import overrides_table
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(f"s{i}", f"X\n FINDINGS: clear {i}\n IMPRESSION: change {i}\n") for i in range(50)] + [
        ("s7", "X\n NOTE: second of s7\n"), ("s8", None), (None, "X\n FINDINGS: of none\n"), ("s50525523", "x" * 400)]
    reports = spark.createDataFrame(rows, "study_id string, text string").mapInArrow(counted, "study_id string, text string")
    own = spark.createDataFrame([("s1", None, 2, 5), ("s2", "findings", None, None), ("s3", "history", None, None), ("s7", "note", None, None),
                                 ("s9", "findings", 0, 1), ("gone", "note", None, None)], "study_id string, section_name string, start int, end int")
    overrides = overrides_table(spark).unionByName(own)
    made = jobs.section_reports(reports, overrides)
    got = sorted(map(tuple, made.collect()), key=str)
    want = [(f"s{i}", f"change {i}") for i in range(50) if i not in (1, 2, 3, 7, 8, 9)] + [
        ("s1", " FI"), ("s2", "clear 2"), ("s3", ""), ("s7", "second of s7"), ("s8", "change 8"), ("s9", "X"), ("s9", "clear 9"),
        (None, "of none"), ("s50525523", "x" * 148)]
    assert got == sorted(want, key=str)
    assert read.value <= 2 * len(rows)
    assert int(str(overrides_table(spark)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20
