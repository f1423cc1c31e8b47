"""Golden cases for cleaning, sectioning, normalisation, sentences and BLEU."""

import random

import pytest
from pyspark.sql import functions as F

from studybank.functions.text import clean_report, normalise_section
from studybank.operators import sections as S
from studybank.operators.metrics import bleu2
from studybank.operators.text import split_on_dot, split_sentences


def test_clean_report_golden(spark):
    cases = [
        ("No edema and/or effusion.. Heart/lungs clear,stable",
         "no edema or effusion. heart or lungs clear, stable"),
        ("A/B/C 1.5 cm", "a or b or c 1. 5 cm"),
        ("x. . y", "x. y"),
        ("Line one.\nLine  two", "line one. line two"),
        ("", ""),
        (" Tab\tand space ", "tab and space"),
    ]
    df = spark.createDataFrame([(a,) for a, _ in cases], "t string")
    got = [r[0] for r in df.select(clean_report("t")).collect()]
    assert got == [b for _, b in cases]


def test_section_split_golden(spark):
    rows = [("a", "HDR\n FINDINGS: Clear lungs.\n IMPRESSION: No acute process.\n"),
            ("b", "X\n CHEST, PA LATERAL:\n\n INDICATION: cough\n"),
            ("c", "X\n FINDINGS:\n IMPRESSION: y\n"),
            ("d", "plain text")]
    df = spark.createDataFrame(rows, "study_id string, text string")
    got = {}
    for r in S.split_sections(df).collect():
        got.setdefault(r.study_id, []).append((r.name, r.text))
    assert got["a"] == [("preamble", "HDR\n "), ("findings", "Clear lungs."),
                        ("impression", "No acute process.\n")]
    assert got["b"] == [("preamble", "X\n "), ("indication", "cough\n")]
    assert got["c"] == [("preamble", "X\n "), ("findings", " IMPRESSION: y\n")]
    assert got["d"] == [("full report", "plain text")]


def test_section_split_matches_line_rule_on_random_texts(spark):
    """Against the line-based SQL of the registered query, over made-up texts."""
    import duckdb
    import pandas as pd

    from studybank.plans.q_sections_sql import SECTION_ORACLES
    rnd = random.Random(7)
    parts = ["\n FINDINGS: ", "\n IMPRESSION:\n", "\n HISTORY: ", "\n CHEST, TWO VIEWS:\n",
             "abc", "No acute.", "\n", " ", "\n \n", "x", "\n COMPARISON: ", "lower: y"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(300)]
    texts.append("A" * 5 + "\n FINDINGS: " + ("word " * 90000))  # > 400 kB
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "lang": "none", "text": texts}))
    res = con.execute(SECTION_ORACLES["section_split"])
    names = [d[0] for d in res.description]
    df = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "study_id string, text string")
    secs = S.split_sections(df).select(*names).collect()
    assert sorted(map(tuple, secs)) == sorted(map(tuple, res.fetchall()))
    raw = S._with_sections(df, "text", "secs", normalise=False).select("study_id", "secs").collect()
    for r in raw:
        t = texts[int(r.study_id[1:])]
        for s in r.secs:  # starts index the original text
            assert t[s["start"]:s["start"] + len(s["text"])] == s["text"]


def test_last_paragraph_and_pick(spark):
    df = spark.createDataFrame([("e", "X\n HISTORY: abc\n \n para two\n \n three"),
                                ("f", "")], "study_id string, text string")
    secs = S.split_sections(df)
    lp = secs.where(F.col("name") == "last_paragraph").collect()
    assert [(r.text, r.start) for r in lp] == [(" para two\n \n three", 15)]
    picked = {r.study_id: r.report for r in S.pick_section(secs).collect()}
    assert picked == {"e": "para two\n \n three", "f": ""}


def test_section_normalise_golden(spark):
    cases = {"conclusion": "impression", "chest, two views": "findings",
             "impresson": "impression", "prior comparison films": "comparison",
             "portable ap": "findings", "note": "note", "ndication": "impression",
             " FINDINGS ": "findings"}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    got = [r[0] for r in df.select(normalise_section(F.col("n"))).collect()]
    assert got == list(cases.values())


def test_overrides(spark):
    rep = spark.createDataFrame([("s1", "0123456789 FINDINGS"), ("s2", "X\n NOTE: keep me\n"),
                                 ("s3", "X\n FINDINGS: f\n")], "study_id string, text string")
    ov = spark.createDataFrame([("s1", None, 2, 5), ("s2", "note", None, None),
                                ("s3", "history", None, None)],
                               "study_id string, section_name string, start int, end int")
    out = {r.study_id: (r.report, r.status)
           for r in S.apply_overrides(rep, S.split_sections(rep), ov).collect()}
    assert out == {"s1": ("234", "ok"), "s2": ("keep me", "ok"), "s3": (None, "missing_section")}


def test_sentences_offsets(spark):
    text = "a b. c d! e? f"
    df = spark.createDataFrame([("s", text), ("e", "")], "study_id string, text string")
    rows = split_sentences(df, "text", "study_id").orderBy("sent_idx").collect()
    assert [(r.sent_idx, r.offset, r.text) for r in rows] == [
        (0, 0, "a b."), (1, 5, "c d!"), (2, 10, "e?"), (3, 13, "f")]
    for r in rows:
        assert text[r.offset:r.offset + len(r.text)] == r.text


def test_split_on_dot_keeps_whitespace_pieces(spark):
    df = spark.createDataFrame([("s", "a. .b..")], "study_id string, report string")
    got = [r.report for r in split_on_dot(df, "report").orderBy("piece_idx").collect()]
    assert got == ["a", " ", "b"]


@pytest.mark.parametrize("ref,cand,want", [
    ("the heart is normal in size", "the heart is normal", 0.6065307),
    ("no effusion", "no effusion. no effusion", 0.4082483),
    ("a b", "c d", 0.0),
    ("a b", "", 0.0),
])
def test_bleu2_golden(spark, ref, cand, want):
    df = spark.createDataFrame([(1, ref, cand)], "id int, ref string, cand string")
    got = bleu2(df, "id", "ref", "cand").collect()[0]["bleu"]
    assert got == pytest.approx(want, abs=1e-6)


def test_bleu2_of_a_long_text(spark):
    text = " ".join(f"w{i * i % 7919}" for i in range(20000))
    df = spark.createDataFrame([(1, text, text)], "id long, ref string, cand string")
    assert bleu2(df, "id", "ref", "cand").collect()[0]["bleu"] == pytest.approx(1.0)
