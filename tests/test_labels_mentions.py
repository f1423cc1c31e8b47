"""Golden cases for mention spans, unmentions, assertion and label rules."""

from pyspark.sql import functions as F

from studybank import constants as K
from studybank.operators import labels as L
from studybank.operators import mentions as M
from studybank.plans import labeller


def _spans(spark, text, phrase):
    sents = spark.createDataFrame([("s", 0, 0, text)], "study_id string, sent_idx int, offset int, text string")
    ph = spark.createDataFrame([("Obs", phrase, "mention")], "observation string, phrase string, kind string")
    return sorted((r.start, r.end) for r in M.phrase_spans(sents, ph).collect())


def test_mention_spans_golden(spark):
    s = "no heart failure. heart failure or chf, heart failure"
    assert _spans(spark, s, "heart failure") == [(3, 16), (18, 31), (40, 53)]
    assert _spans(spark, s, "heart") == [(3, 8), (18, 23), (40, 45)]
    assert _spans(spark, s, "chf") == [(35, 38)]
    assert _spans(spark, "heartheart", "heart") == [(0, 5), (5, 10)]
    assert _spans(spark, "nothing here", "heart") == []


def test_unmention_expand_golden(spark):
    ph = spark.createDataFrame([("Cardiomegaly", "the heart", "mention"),
                                ("Cardiomegaly", "cardiomegaly", "mention"),
                                ("Cardiomegaly", "loaded one", "unmention"),
                                ("Edema", "kept", "unmention")],
                               "observation string, phrase string, kind string")
    out = M.expand_unmentions(ph)
    un = {r.phrase for r in out.where((F.col("kind") == "unmention")
                                      & (F.col("observation") == "Cardiomegaly")).collect()}
    assert len(un) == 12
    assert {"over the heart", "in the left heart", "overly the superior heart"} <= un
    assert "loaded one" not in un
    assert out.where(F.col("phrase") == "kept").count() == 1
    merged = M.expand_unmentions(ph, merge=True)
    assert merged.where(F.col("phrase") == "loaded one").count() == 1


def test_unmention_overlap_dropped(spark):
    sents = spark.createDataFrame([("s", 0, 0, "over the left heart"), ("t", 0, 0, "the heart")],
                                  "study_id string, sent_idx int, offset int, text string")
    ph = spark.createDataFrame([("Cardiomegaly", "heart", "mention"),
                                ("Cardiomegaly", "over the left heart", "unmention")],
                               "observation string, phrase string, kind string")
    joined = M.drop_unmentions(M.phrase_spans(sents, ph, "mention"),
                               M.phrase_spans(sents, ph, "unmention"))
    fused = M.filtered_spans(sents, ph)
    for df in (joined, fused):
        assert [(r.study_id, r.start) for r in df.collect()] == [("t", 4)]


def test_assertion_cascade(spark):
    rows = [("s", 0, 0, "no edema", 3, 8), ("s", 1, 0, "may be edema", 7, 12),
            ("s", 2, 0, "edema is possible", 0, 5), ("s", 3, 0, "edema", 0, 5),
            ("s", 4, 0, "not may be edema", 11, 16)]
    m = spark.createDataFrame(rows, "study_id string, sent_idx int, offset int, text string, start int, end int")
    pats = spark.createDataFrame([("pre_uncertain", "(^| )may (be )?{m}"),
                                  ("negation", "(^| )(no|not) ([a-z]+ ){0,2}{m}"),
                                  ("post_uncertain", "{m} is possible")], "role string, pattern string")
    got = {r.sent_idx: (r.status, r.label) for r in M.assert_status(m, pats).collect()}
    assert got == {0: ("negative", 0), 1: ("uncertain", -1), 2: ("uncertain", -1),
                   3: ("positive", 1), 4: ("uncertain", -1)}


def test_conflict_resolution_vs_max(spark):
    sets = {"a": [1], "b": [0], "c": [-1], "d": [0, -1], "e": [0, 1], "f": [-1, 1],
            "g": [0, -1, 1], "h": [1, 1]}
    resolved = {"a": 1, "b": 0, "c": -1, "d": -1, "e": 1, "f": 1, "g": -1, "h": 1}
    maxed = {"a": 1, "b": 0, "c": -1, "d": 0, "e": 1, "f": 1, "g": 1, "h": 1}
    rows = [(k, "Edema", v) for k, vs in sets.items() for v in vs]
    df = spark.createDataFrame(rows, "mimic_id string, cat string, val int")
    got = {r.mimic_id: r.val for r in L.resolve_conflicts(df, "mimic_id", "cat", "val").collect()}
    assert got == resolved
    mx = {r.mimic_id: r.Edema for r in L.collapse_labels(df.withColumnRenamed("val", "vals"),
                                                         ["mimic_id"], ["Edema"]).collect()}
    assert mx == maxed


def test_labeller_rules(spark):
    reports = spark.createDataFrame([
        ("s1", "Heart failure. No edema."),            # chf rule + negated edema
        ("s2", "No edema."),                           # only negated -> No Finding
        ("s3", "Tube in place."),                      # only a support device -> No Finding
        ("s4", "Edema."),                              # positive finding -> no No Finding
        ("s5", None),                                  # null report -> empty document
    ], "study_id string, report string")
    phrases = spark.createDataFrame([("Edema", "edema", "mention"),
                                     ("Cardiomegaly", "heart failure", "mention"),
                                     ("Support Devices", "tube", "mention")],
                                    "observation string, phrase string, kind string")
    patterns = spark.createDataFrame([("negation", "(^| )no {m}")], "role string, pattern string")
    vec = {r.study_id: r.asDict() for r in
           labeller.document_vectors(reports, phrases, patterns).collect()}
    assert vec["s1"]["Cardiomegaly"] == 1 and vec["s1"]["Edema"] == 0
    assert vec["s1"]["No Finding"] is None
    assert vec["s2"]["No Finding"] == 1 and vec["s2"]["Edema"] == 0
    assert vec["s3"]["No Finding"] == 1 and vec["s3"]["Support Devices"] == 1
    assert vec["s4"]["No Finding"] is None and vec["s4"]["Edema"] == 1
    assert vec["s5"]["No Finding"] == 1
    rows = labeller.label_rows(reports, phrases, patterns)
    hf = rows.where((F.col("study_id") == "s1") & (F.col("cat") == K.CARDIOMEGALY)).collect()
    assert sorted(r.val for r in hf) == [-1, 1]
    long = labeller.sentence_table(reports, phrases, patterns)
    nf = long.where((F.col("mimic_id") == "s2") & (F.col("cat") == K.NO_FINDING)).collect()
    assert [r.sents for r in nf] == ["no edema."]


def test_pivot_and_attach(spark):
    long = spark.createDataFrame([("s1", "r1", "A", 0, "x"), ("s1", "r1", "B", 1, "y"),
                                  ("s2", "r2", "A", -1, None)],
                                 "mimic_id string, report string, cat string, vals int, sents string")
    piv = L.pivot_labels(long, ["A", "B"]).collect()
    assert [(r.A, r.B) for r in piv] == [(0, None), (None, 1), (-1, None)]
    embs = spark.createDataFrame([("s1", "x"), ("s3", "z")], "study_id string, target string")
    st = {r.study_id: (r.A, r.B) for r in L.attach_labels(embs, long, "study", ["A", "B"]).collect()}
    assert st == {"s1": (0, 1), "s3": (None, None)}
    se = {r.study_id: (r.A, r.B) for r in L.attach_labels(embs, long, "sentence", ["A", "B"]).collect()}
    assert se == {"s1": (0, None), "s3": (None, None)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labelling_is_map_only_and_rows_stay_apart(spark):
    reports = spark.createDataFrame([("s1", "No edema. Edema is here."), ("s1", "Tube. No edema."), ("s2", "")],
                                    "study_id string, report string")
    phrases = spark.createDataFrame([("Edema", "edema", "mention"), ("Support Devices", "tube", "mention")],
                                    "observation string, phrase string, kind string")
    patterns = spark.createDataFrame([("negation", "(^| )no {m}")], "role string, pattern string")
    found = sorted((r.ann_id, r.doc_offset, r.mention, r.label, r.sentence)
                   for r in labeller.mentions(reports, phrases, patterns).collect())
    assert found == [(0, 0, "tube", 1, "tube."), (0, 3, "edema", 0, "no edema."),
                     (1, 9, "edema", 0, "no edema."), (1, 10, "edema", 1, "edema is here.")]
    vectors = labeller.document_vectors(reports, phrases, patterns)
    got = sorted((r["study_id"], r["Edema"], r["No Finding"]) for r in vectors.collect())
    assert got == [("s1", 0, 1), ("s1", 1, None), ("s2", None, 1)]
    assert "Exchange" not in _plan(labeller.cleaned(reports))
    assert "hashpartitioning" not in _plan(vectors)


def test_sentence_offsets_count_within_the_row(spark):
    df = spark.createDataFrame([("s", "one. two."), ("s", "three. four.")], "study_id string, text string")
    from studybank.operators.text import split_sentences
    got = sorted((r.text, r.sent_idx, r.offset) for r in split_sentences(df).collect())
    assert got == [("four.", 1, 7), ("one.", 0, 0), ("three.", 0, 0), ("two.", 1, 5)]


def test_regex_and_self_overlapping_phrases(spark):
    assert _spans(spark, "aaaaa", "aa") == [(0, 2), (2, 4)]
    assert _spans(spark, "edema oedema", "o?edema") == [(0, 5), (6, 12)]
    assert _spans(spark, "h\u00e9 \U0001f600 edema", "edema") == [(5, 10)]


def test_spans_equal_brute_force():
    import random
    import re

    from studybank.operators.spans import Matcher
    rng = random.Random(7)
    for _ in range(200):
        units = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 12))) for _ in range(4)]
        ment = [(rng.choice("XY"), "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))) for _ in range(4)]
        unm = [(rng.choice("XY"), "".join(rng.choice("ab ") for _ in range(rng.randint(1, 4)))) for _ in range(2)]
        want = []
        for i, (o, p) in enumerate(sorted(set(ment))):
            for u, unit in enumerate(units):
                gone = [m.span() for q, x in unm if q == o for m in re.finditer(re.escape(x), unit)]
                want += [(u, m.start(), i, m.end()) for m in re.finditer(re.escape(p), unit)
                         if not any(m.start() < e and m.end() > s for s, e in gone)]
        row, unit, start, end = Matcher(ment, unm).find(units)
        assert list(zip(unit.tolist(), start.tolist(), row.tolist(), end.tolist())) == sorted(want)


def test_many_phrases_and_one_long_sentence_take_linear_time(spark):
    import time
    words = [f"w{i}x" for i in range(300)]
    reports = spark.createDataFrame([("s", " ".join(words[i % 300] for i in range(20_000)))],
                                    "study_id string, report string")
    phrases = spark.createDataFrame([("Cardiomegaly", w, "mention") for w in words],
                                    "observation string, phrase string, kind string")
    patterns = spark.createDataFrame([("negation", "(^| )(no|not) ([a-z]+ ){0,2}{m}")], "role string, pattern string")
    begin = time.time()
    found = labeller.mentions(reports, phrases, patterns)
    assert found.select("ann_id", "label").agg(F.count("*"), F.max("ann_id")).collect()[0][:] == (20_000, 19_999)
    assert time.time() - begin < 20


def test_spread_counts_no_partitions_of_a_shuffle(spark):
    from studybank.session import spread
    grouped = spark.range(100).groupBy((F.col("id") % 3).alias("k")).count()
    assert spread(grouped) is grouped
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() >= 8


def test_reports_of_one_study_keep_their_own_mentions(spark):
    sents = spark.createDataFrame([("s1", 0, "no and here"), ("s1", 0, "and the rest")], "study_id string, sent_idx int, text string")
    ph = spark.createDataFrame([("Edema", "and", "mention"), ("Edema", "and the", "unmention")], "observation string, phrase string, kind string")
    kept = M.drop_unmentions(M.phrase_spans(sents, ph, "mention"), M.phrase_spans(sents, ph, "unmention"))
    assert [r.text for r in kept.collect()] == ["no and here"]


def test_texts_of_a_batch_are_matched_in_parts(monkeypatch):
    """The same lists, however many texts a batch has; the matcher never gets more than a part and one text of it."""
    import pyarrow as pa
    from studybank.operators import spans
    texts = pa.array([f"no heart failure {i}. chf or not! more" if i % 7 else (None if i % 2 else "") for i in range(500)], pa.string())
    matcher = spans.Matcher([("A", "heart failure"), ("B", "chf"), ("B", "(or|no)")], [("B", "chf or")])
    assertion = spans.Assertion([("negation", "(^| )no {m}"), ("post_uncertain", "{m} or")])
    work = (lambda t: spans.document_lists(t, matcher, assertion), lambda t: spans.span_lists(t, matcher), spans.sentence_lists)
    whole = [w(texts).to_pylist() for w in work]
    most, find = [], spans.Matcher.find
    monkeypatch.setattr(spans.Matcher, "find", lambda self, units: most.append(sum(map(len, units))) or find(self, units))
    monkeypatch.setattr(spans, "PART_BYTES", 300, raising=False)
    assert [w(texts).to_pylist() for w in work] == whole
    assert max(most) < 300 + 50 and [w(texts[:0]).to_pylist() for w in work] == [[], [], []]


def test_reports_are_matched_once_after_their_deal(spark, tmp_path):
    """Label rows of a scan in few partitions: the dictionary is matched above the deal only, and not a second time below it."""
    spark.createDataFrame([("s1", "No edema."), ("s2", None)], "study_id string, report string").coalesce(1).write.parquet(str(tmp_path / "r"))
    reports = spark.read.parquet(str(tmp_path / "r"))
    phrases = spark.createDataFrame([("Edema", "edema", "mention")], "observation string, phrase string, kind string")
    patterns = spark.createDataFrame([("negation", "(^| )no {m}")], "role string, pattern string")
    rows = labeller.label_rows(reports, phrases, patterns)
    plan = _plan(rows)
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Exchange")
    assert sorted((r.study_id, r.cat, r.val, r.sents) for r in rows.collect()) == [
        ("s1", "Edema", 0, "no edema."), ("s1", "No Finding", 1, "no edema."), ("s2", "No Finding", 1, "")]


def test_kinds_of_phrases_are_found_in_one_pass(spark):
    sents = spark.createDataFrame([("s", 0, "no and here, and the rest"), ("t", 1, "nothing"), (None, 2, None)],
                                  "study_id string, sent_idx int, text string")
    ph = spark.createDataFrame([("Edema", "and", "mention"), ("Edema", "and the", "unmention"), ("Edema", "and", "unmention"),
                                ("Other", "n(o|e)", "mention")], "observation string, phrase string, kind string")
    both = M.phrase_spans(sents, ph, ("mention", "unmention"))
    apart = [M.phrase_spans(sents, ph, k).withColumn("kind", F.lit(k)) for k in ("mention", "unmention")]
    assert both.columns == apart[0].columns
    assert sorted(map(str, both.collect())) == sorted(map(str, apart[0].unionAll(apart[1]).collect()))
    assert _plan(both).count("ArrowEvalPython") == 1


def test_expanded_dictionary_and_overlaps_clean_the_documents_once(spark, tmp_path):
    from studybank.plans import q_text
    spark.createDataFrame([(1, "It is and the. That the rest, and"), (2, None)], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    counts = q_text.q_unmention_expand(spark, str(tmp_path))
    assert _plan(counts).count("documents.parquet") <= 1
    got = {(r.observation, r.phrase, r.kind): r.spans for r in counts.collect()}
    assert got[("Edema", "and", "mention")] == 2 and got[("Edema", "and the", "unmention")] == 1
    assert got[("No Finding", "is", "mention")] == 1 and got[("Lung Opacity", "with", "mention")] == 0
    kept = q_text.q_unmention_overlap(spark, str(tmp_path))
    assert "documents.parquet" not in _plan(kept)
    assert sorted((r.observation, r.sent_idx, r.start) for r in kept.where("observation = 'Edema'").collect()) == [("Edema", 1, 15)]


def _long_reports(spark, to, n=24):
    """Reports of 100,000 bytes with 40 pieces each, in one file, and their labels."""
    docs = [(i, ". ".join(f"{i} {j} " + "x" * 2490 for j in range(40))) for i in range(n)] + [(n, None)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(i, i % 3, 1) for i in range(n)] + [(1, 0, None)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(
        f"{to}/labels.parquet")
    return sum(len(t or "") for _, t in docs)


def test_repeated_reports_are_dealt_so_that_files_hold_them_once(spark, tmp_path, monkeypatch):
    """Rows that repeat whole reports: written, they take little more than the reports, however few partitions were read."""
    from studybank import session
    from studybank.plans import q_labels, q_text
    texts = _long_reports(spark, str(tmp_path))
    monkeypatch.setattr(session, "DEAL_BYTES", 300_000, raising=False)
    codec = spark.conf.get("spark.sql.parquet.compression.codec")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.parquet.compression.codec", "uncompressed")
    try:
        for query, rows in ((q_labels.q_project, 25 * 80), (q_labels.q_join_reports_long, 25 * 80 + 1), (q_text.q_sentence_long, None)):
            out = tmp_path / query.__name__
            query(spark, str(tmp_path)).write.parquet(str(out))
            got = spark.read.parquet(str(out))
            assert rows is None or got.count() == rows
            assert sum(f.stat().st_size for f in out.glob("*.parquet")) < 6 * texts
            assert got.select("report").distinct().where("report IS NOT NULL").count() == 24
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.parquet.compression.codec", codec)
