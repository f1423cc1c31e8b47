"""Retrieval metrics, top-k, splits and contrastive golden cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from studybank.operators import contrastive as C
from studybank.operators.metrics import query_scores, retrieval_metrics
from studybank.operators.retrieve import dedupe_bank, topk
from studybank.operators.splits import (assign_batches, exact_sample, split_leaks,
                                        study_split)
from studybank.plans import bindings as B
from studybank.plans import flagship

from conftest import SF


def test_retrieval_metrics_golden(spark):
    # categories A, B, C; k = 2 (FIXTURES 2.7)
    cells = [(1, "A", 1), (1, "B", 0), (3, "A", -1), (3, "C", 1), (4, "A", 1),
             (11, "A", 1), (12, "A", 1), (12, "B", 1),
             (21, "A", 1), (22, "B", 0),
             (31, "A", 0), (31, "C", 1), (32, "A", 0), (32, "C", 1)]
    labels = spark.createDataFrame(cells, "id long, cat string, val int")
    top = spark.createDataFrame([(q, r, q * 10 + r) for q in (1, 2, 3, 4) for r in (1, 2)],
                                "query_id long, rank int, bank_id long")
    queries = spark.createDataFrame([(q,) for q in (1, 2, 3, 4)], "query_id long")
    sc = query_scores(queries, top, labels, labels)
    by = {r.query_id: r for r in sc.collect()}
    assert by[1].status == "evaluated" and by[1].precision == pytest.approx(1 / 3)
    assert by[1].recall == pytest.approx(0.5) and by[1].duplicates == 0
    assert by[2].status == "no_query_labels"
    assert by[3].precision == pytest.approx(0.25) and by[3].duplicates == 1
    assert by[3].hit_classes == ["C"]
    assert by[4].status == "no_bank_labels"
    m = retrieval_metrics(sc, 2).collect()[0]
    assert m.flat_hit == pytest.approx(0.5) and m.hits == 2
    assert m.precision == pytest.approx(0.2916667, abs=1e-6)
    assert m.recall == pytest.approx(0.5)
    assert m.f1 == pytest.approx(0.3684211, abs=1e-6)
    assert m.duplicates == pytest.approx(0.5) and m.test_instances == 2


def test_flagship_golden_values(spark):
    # FIXTURES 2.12 at sf0.001: queries are vec_id % 10 = 0 there
    v = B.vectors(spark, SF)
    q = v.where(F.col("vec_id") % 10 == 0)
    b = v.where(F.col("vec_id") % 10 != 0)
    for block_rows in (2048, 64):
        _, m = flagship.evaluate(q, b, B.vector_labels(spark, SF), block_rows=block_rows)
        r = m.collect()[0]
        assert (r.hits, r.test_instances) == (7, 50)
        assert r.flat_hit == pytest.approx(0.14) and r.precision == pytest.approx(0.07)
        assert r.f1 == pytest.approx(0.0933333, abs=1e-6) and r.duplicates == pytest.approx(0.12)


def test_topk_edge_cases(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, embs array<double>")
    b = spark.createDataFrame([(10, [2.0, 0.0]), (5, [1.0, 0.0]), (7, [0.0, 1.0])],
                              "bank_id long, embs array<double>")
    for block_rows in (2048, 1):
        got = topk(q, b, 2, block_rows=block_rows).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.rank, r.bank_id) for r in got] == [
            (1, 1, 5), (1, 2, 10), (2, 1, 5), (2, 2, 7)]
        assert all(r.sim == 0.0 for r in got if r.query_id == 2)
        assert topk(q, b, 10, block_rows=block_rows).count() == 6   # k > bank size


def test_topk_is_the_same_at_any_block_size(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(300)]
    v = spark.createDataFrame(rows, "id long, embs array<double>")
    q, b = v.where("id < 40"), v.where("id >= 40")
    a = topk(q, b, 5, query_key="id", bank_key="id")
    c = topk(q, b, 5, query_key="id", bank_key="id", block_rows=16)
    key = lambda r: (r.query_id, r.rank, r.bank_id)
    assert sorted(map(key, a.collect())) == sorted(map(key, c.collect()))
    # numpy brute force
    m = np.array([r[1] for r in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = m[:40] @ m[40:].T
    want = {(qi, rank + 1, int(40 + j)) for qi in range(40)
            for rank, j in enumerate(np.lexsort((np.arange(260), -s[qi]))[:5])}
    assert set(map(key, a.collect())) == want


def test_dedupe_scope(spark):
    bank = spark.createDataFrame([(0, 0, "s1", "same"), (1, 0, "s2", "same"), (1, 1, "s3", "other")],
                                 "batch_id int, pos int, study_id string, target string")
    assert dedupe_bank(bank, scope="batch").count() == 3
    g = dedupe_bank(bank, scope="global").collect()
    assert sorted(r.study_id for r in g) == ["s1", "s3"]


@pytest.mark.parametrize("n,subset,sizes", [(100, 1.0, (90, 5, 5)), (101, 0.5, (45, 2, 3)),
                                            (1000, 1.0, (900, 50, 50))])
def test_study_split_sizes(spark, n, subset, sizes):
    rows = [(f"s{i}", f"p{i}_{j}") for i in range(n) for j in range(1 + i % 3)]
    df = spark.createDataFrame(rows, "study_id string, path string")
    out = study_split(df, "study_id", subset, 0.9, 0.5, seed=3)
    counts = {r.split: r.c for r in out.groupBy("split").agg(
        F.countDistinct("study_id").alias("c")).collect()}
    assert (counts.get("train", 0), counts.get("test", 0), counts.get("val", 0)) == sizes
    assert split_leaks(out).count() == 0
    # every image of a chosen study is kept
    kept = out.select("study_id").distinct()
    assert out.count() == df.join(kept, "study_id").count()
    # independent of input order and partitioning
    again = study_split(df.repartition(7).orderBy(F.rand(1)), "study_id", subset, 0.9, 0.5, seed=3)
    assert sorted(map(tuple, out.select("study_id", "split").distinct().collect())) == \
        sorted(map(tuple, again.select("study_id", "split").distinct().collect()))


def test_exact_sample_exact_and_stable(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    s1 = exact_sample(df, "k", n=123, seed=9)
    assert s1.count() == 123
    s2 = exact_sample(df.repartition(13), "k", n=123, seed=9)
    assert sorted(r.k for r in s1.collect()) == sorted(r.k for r in s2.collect())
    assert exact_sample(df, "k", ratio=0.1).count() == 500


def test_assign_batches_drop_last(spark):
    df = spark.range(0, 70).withColumnRenamed("id", "k")
    out = assign_batches(df, "k", 8)
    assert out.count() == 64
    sizes = {r.batch_id: r.c for r in out.groupBy("batch_id").agg(F.count("*").alias("c")).collect()}
    assert set(sizes.values()) == {8} and len(sizes) == 8


def test_contrastive_golden(spark):
    pairs = spark.createDataFrame([(0, 0, [1.0, 0.0], [1.0, 0.0]), (0, 1, [0.0, 1.0], [0.6, 0.8])],
                                  "batch_id int, pos int, img array<double>, txt array<double>")
    lg = C.batch_logits(C.gather_batches(pairs)).orderBy("i").collect()
    assert lg[0].logits == pytest.approx([14.285714, 8.571429], abs=1e-6)
    assert lg[1].logits == pytest.approx([0.0, 11.428571], abs=1e-6)
    sc = C.batch_scores(pairs).collect()[0]
    assert sc.loss == pytest.approx(0.0147871, abs=1e-6) and sc.accuracy == 1.0
    for r in C.sinkhorn_targets(pairs).collect():
        assert sum(r.row) == pytest.approx(1.0)


def test_sinkhorn_rows_sum_to_one():
    rng = np.random.default_rng(1)
    t = C.sinkhorn_np(rng.normal(size=(5, 5)))
    assert np.allclose(t.sum(axis=1), 1.0)
