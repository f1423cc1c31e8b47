"""Nothing is dropped silently: null keys, large config tables, studies with two texts."""

import pytest
from pyspark.sql import functions as F

from studybank.operators import encode, labels, splits


def test_null_keys_are_sampled_like_others(spark):
    df = spark.createDataFrame([(None, 0)] + [(str(i), i) for i in range(1, 8)], "k string, v int")
    assert splits.exact_sample(df, "k", n=8).count() == 8
    assert splits.hash_rank(df, "k").agg(F.count_distinct("rank")).first()[0] == 8
    part = splits.hash_segments(df, "k", lambda total: [F.lit(3)], 1)
    assert {r["segment"]: r["count"] for r in part.groupBy("segment").count().collect()} == {0: 3, 1: 5}


def test_no_model_config_is_left_out(spark, monkeypatch):
    text = spark.createDataFrame([("a", "some words")], "study_id string, report string")
    rows = [("img", "hash", 4 + i) for i in range(4)]
    configs = spark.createDataFrame(rows, "image_encoder string, text_encoder string, embed_dim int")

    class Width:
        def __init__(self, dim):
            self.dim = dim
    seen = []
    monkeypatch.setattr(encode, "embed", lambda df, enc, col, keys: seen.append(enc.dim) or df)
    encode.embed_all(text, configs, registry={"hash": Width})
    assert seen == [4, 5, 6, 7]
    monkeypatch.setattr(encode, "MAX_CONFIGS", 3)
    with pytest.raises(ValueError):
        encode.embed_all(text, configs, registry={"hash": Width})


def test_both_texts_of_a_study(spark):
    embs = spark.createDataFrame([("s", 1)], "study_id string, v int")
    long = spark.createDataFrame([("s", "one"), ("s", "two"), ("s", "two")], "mimic_id string, report string")
    assert [r.report for r in labels.attach_report(embs, long).collect()] == ["one"]
    assert sorted(r.report for r in labels.attach_report(embs, long, every=True).collect()) == ["one", "two"]


def test_reports_are_merged_before_they_are_sorted(spark):
    """Long labels repeat a report on each sentence: its rows meet a hash aggregate first, not a sort of them all."""
    long = spark.createDataFrame([("s1", "two", "A", 1, "x"), ("s1", "one", "A", 0, "y"), ("s2", None, "A", 1, None)] * 3,
                                 "mimic_id string, report string, cat string, vals int, sents string")
    embs = spark.createDataFrame([("s1", "x"), ("s2", "y"), ("s3", "z")], "study_id string, target string")
    out = labels.attach_report(embs, long)
    assert sorted(map(tuple, out.select("study_id", "report").collect()), key=str) == [("s1", "one"), ("s2", None), ("s3", None)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    # leaves come last: the lowest aggregate over the long rows takes report as a key
    lowest = [x for x in plan.splitlines() if "Aggregate" in x][-1]
    assert "HashAggregate(keys=[mimic_id" in lowest and "SortAggregate" not in lowest


def test_files_hold_an_attached_report_once(spark, tmp_path):
    """The reports of studies with many rows are dealt once, into partitions that a writer stores them in once."""
    from studybank.plans import q_labels
    texts = [f"report {i} " + "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(20_000)) + "." * 30 for i in range(150)]
    docs = [*enumerate(texts), (3, "a smaller one"), (150, None), (151, "no label"), (None, "no id")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cells = [(i, 1, 0) for i in range(151)] + [(7, None, 1), (900, 1, 1), (None, 1, 1)]
    spark.createDataFrame(cells, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    threshold, was = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(threshold, "-1")
    try:
        made = q_labels.q_join_report_text(spark, str(tmp_path))
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4  # documents, labels, their ids, pieces
        made.write.option("compression", "none").parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set(threshold, was)
    least = {f"s{i}": t for i, t in enumerate(texts)} | {"s3": "a smaller one"}
    want = [(None if i is None else f"s{i}", piece, least.get(f"s{i}")) for i, t in docs for piece in ([None] if t is None else t.split("."))]
    got = [(r.study_id, r.target, r.report) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(p.stat().st_size for p in (tmp_path / "out").rglob("*.parquet")) < 4 * sum(map(len, texts))


def test_reports_are_not_shuffled_to_find_the_labelled(spark, tmp_path, monkeypatch):
    """Lengths are taken before the join that counts partitions; texts meet a set of ids, unless these are too many."""
    from studybank.plans import bindings
    spark.createDataFrame([(i, f"text {i}") for i in range(9)] + [(3, "again"), (4, None), (None, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in (3, 4, 4, 70)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sized = []
    monkeypatch.setattr(bindings, "deals", lambda df, col: sized.append(df) or 3)
    threshold, was = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(threshold, "-1")
    try:
        bindings.label_deals(spark, str(tmp_path))
        below = sized[0]._jdf.queryExecution().optimizedPlan().toString().split("Join LeftSemi")[1]
        assert "octet_length" in below
        for most, broadcast in ((100, True), (2, False)):
            monkeypatch.setattr(bindings, "LABEL_ROWS", most)
            found = bindings.labelled_reports(spark, str(tmp_path))
            assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) == broadcast
            assert sorted((r.report for r in found.collect()), key=str) == [None, "again", "text 3", "text 4"]
    finally:
        spark.conf.set(threshold, was)
