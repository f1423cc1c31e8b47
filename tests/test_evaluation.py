"""Packed top-k, in-row BLEU and the whole evaluation against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from studybank.operators import retrieve
from studybank.operators.labels import label_cells
from studybank.operators.metrics import bleu2, retrieved_bleu, retrieved_texts
from studybank.plans import evaluation
from studybank.session import shared_dir
from studybank.sources import readers as R
from studybank.sources import writers as W


def plain_bleu(ref, cand):
    if not cand:
        return 0.0
    logs = 0.0
    for n in (1, 2):
        c, r = (Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1)) for t in (cand, ref))
        hits = sum((c & r).values())
        if not hits:
            return 0.0
        logs += 0.5 * math.log(hits / max(1, len(cand) - n + 1))
    return (1.0 if len(cand) > len(ref) else math.exp(1 - len(ref) / len(cand))) * math.exp(logs)


def test_bleu_counts_repeats_like_multisets(spark):
    rng = random.Random(1)
    pairs = [(i, *(" ".join(rng.choice("ab abc a1 x".split()) for _ in range(rng.randint(0, 30))) for _ in "rc")) for i in range(150)]
    pairs += [(200, "a a a b", "a a"), (201, "", "a"), (202, "a", ""), (203, "a-b\na", "a b a"), (204, "a " * 9000, "a " * 8999 + "b")]
    out = bleu2(spark.createDataFrame(pairs, "id long, ref string, cand string"), "id", "ref", "cand")
    got = {r.id: r.bleu for r in out.collect()}
    for i, ref, cand in pairs:
        ref, cand = (t.replace("\n", "").replace("-", " ").split() for t in (ref, cand))
        assert got[i] == pytest.approx(plain_bleu(ref, cand)), i
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def vectors(n, d, seed=0, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    if clusters:
        x = rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)] * 8 + x
    x[3], x[5] = 0, x[4]
    return x.astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("clusters", [0, 12])
def test_tiles_and_heaps_lose_no_row(monkeypatch, clusters):
    monkeypatch.setattr(retrieve, "TILE_ROWS", 20)
    monkeypatch.setattr(retrieve, "QUERY_CHUNK", 16)
    x = vectors(900, 8, clusters=clusters)
    unit = retrieve._normalise(x)
    got, scored = retrieve._local_topk(np.arange(60), unit[:60], np.arange(900), unit, 4)
    s = np.round(unit[:60] @ unit.T, 12)
    for q, rows in got.groupby("query_id"):
        best = sorted(range(900), key=lambda j: (-s[q, j], j))[:4]
        assert [b for _, b in sorted(zip(-np.round(rows.sim, 12), rows.bank_id))] == best
    # bounds skip most of a bank that lies in clusters
    assert scored <= 60 * 900 and (not clusters or scored < 0.5 * 60 * 900)


def test_blocks_are_packed_and_sent_to_few_cells(spark, monkeypatch):
    x = vectors(400, 16)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embs array<float>").repartition(4)
    q, b = v.where("id < 80"), v.where("id >= 80")
    brute = retrieve._normalise(x[:80]) @ retrieve._normalise(x[80:]).T
    want = {(i, 80 + j) for i in range(80) for j in sorted(range(320), key=lambda j: (-round(brute[i, j], 12), j))[:3]}
    for query_bytes, bank_bytes, pack in ((1 << 24, 1 << 25, 1 << 20), (900, 2000, 500)):
        monkeypatch.setattr(retrieve, "QUERY_BYTES", query_bytes)
        monkeypatch.setattr(retrieve, "BANK_BYTES", bank_bytes)
        monkeypatch.setattr(retrieve, "PACK_BYTES", pack)
        got = retrieve.topk(q, b, 3, query_key="id", bank_key="id").collect()
        assert {(r.query_id, r.bank_id) for r in got} == want and len(got) == 240
    by = b.withColumn("batch", (F.col("id") % 3).cast("string")).withColumn("batch", F.when(F.col("batch") != "2", F.col("batch")))
    got = retrieve.topk(q, by, 2, query_key="id", bank_key="id", group="batch").collect()
    assert len(got) == 80 * 3 * 2
    for r in got:
        own = [j for j in range(80, 400) if (str(j % 3) if j % 3 < 2 else None) == r.batch]
        assert r.bank_id in sorted(own, key=lambda j: (-round(brute[r.query_id, j - 80], 12), j))[:2]


def test_whole_evaluation(spark):
    """Distinct texts, labels of a study or of a sentence, several cells with 0 and -1, BLEU of the joined texts."""
    rng = random.Random(3)
    texts = [f"text {i} of {rng.choice('abc')}" for i in range(12)]
    bank = [(i, i // 20, i % 20, f"s{i % 15}", rng.choice(texts), [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    asked = [(i, f"s{i % 15}", "img", [rng.gauss(0, 1) for _ in range(4)]) for i in range(20)]
    long = [(f"s{rng.randint(0, 14)}", f"report {rng.randint(0, 2)}\nof it", rng.choice("ABCD"), rng.choice([1, 0, -1, None]), rng.choice(texts))
            for _ in range(250)]
    run = evaluation.Run("bank", "query", test_size=10, random_state=5)
    frames = (spark.createDataFrame(asked, "query_id long, study_id string, target string, embs array<double>"),
              spark.createDataFrame(bank, "bank_id long, batch_id int, pos int, study_id string, target string, embs array<double>"),
              spark.createDataFrame(long, "mimic_id string, report string, cat string, vals int, sents string"))
    for level, unique in (("sentence", "batch"), ("study", None), ("study", "global")):
        out = evaluation.evaluate(*frames, run, k=3, max_k=5, bank_level=level, unique_text=unique, bleu=True)
        scores = {r.query_id: r for r in out.scores.collect()}
        assert len(scores) == 10
        kept, seen = [], set()
        for b in bank:
            k = (b[1] if unique == "batch" else 0, b[4])
            if unique is None or k not in seen:
                kept.append(b)
                seen.add(k)

        def cells(study, text=None):
            found = {}
            for m, _, c, v, s in long:
                if m == study and v is not None and (text is None or s == text):
                    found[c] = max(v, found.get(c, -1))
            return found

        def cosine(a, b):
            return round(sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b), 12)

        for q, r in scores.items():
            _, study, _, e = asked[q]
            rows = sorted(kept, key=lambda b: (-cosine(e, b[5]), b[0]))[:3]
            own, got = cells(study), [cells(b[3], b[4] if level == "sentence" else None) for b in rows]
            n = sum(map(len, got))
            hits = {c for g in got for c in g if own.get(c) == g[c]}
            assert r.status == ("no_bank_labels" if not n else "no_query_labels" if not own else "evaluated")
            if r.status == "evaluated":
                assert (r.precision, r.recall) == (pytest.approx(len(hits) / n), pytest.approx(len(hits) / len(own)))
                assert r.duplicates == 3 - len({tuple(sorted(g.items())) for g in got})
                ref = min((x for m, x, *_ in long if m == study), default="").replace("\n", "").split()
                assert r.bleu == pytest.approx(plain_bleu(ref, ". ".join(b[4] for b in rows).replace(".", " ").split()))
        m = out.metrics.first()
        done = [r for r in scores.values() if r.status == "evaluated"]
        assert m.recall == pytest.approx(sum(r.recall for r in done) / len(done)) and m.test_instances == len(done)
        assert (m.bank, m.query, m.test_size, m.random_state) == ("bank", "query", 10, 5)


def test_label_levels(spark):
    long = spark.createDataFrame([("s1", "A", 0, "x"), ("s1", "A", -1, "y"), ("s1", "B", None, "x"), (None, "A", 1, "x"), ("s2", "A", 1, None)],
                                 "mimic_id string, cat string, vals int, sents string")
    rows = spark.createDataFrame([(1, "s1", "x"), (2, "s1", "y"), (3, "s2", "x"), (4, None, "x")], "i long, study_id string, target string")
    assert {tuple(r) for r in label_cells(rows, long, "study", "i").collect()} == {(1, "A", 0), (2, "A", 0), (3, "A", 1)}
    assert {tuple(r) for r in label_cells(rows, long, "sentence", "i").collect()} == {(1, "A", 0), (2, "A", -1)}


def test_retrieved_texts_keep_rank_order(spark):
    top = spark.createDataFrame([(1, 2, 10), (1, 1, 11), (2, 1, 12)], "query_id long, rank int, bank_id long")
    bank = spark.createDataFrame([(10, "b b"), (11, "a"), (12, None)], "bank_id long, target string")
    reports = spark.createDataFrame([(1, "a b b"), (2, None), (3, "a")], "query_id long, report string")
    texts = retrieved_texts(top, bank)
    assert {r.query_id: r.texts for r in texts.collect()}[1] == ["a", "b b"]
    assert {r.query_id: r.bleu for r in retrieved_bleu(reports, texts).collect()} == {1: pytest.approx(1.0), 2: 0.0}


def test_a_run_written_twice_is_one_row_and_schemas_grow(spark):
    out = shared_dir(spark, "metrics")
    row = spark.createDataFrame([("a", 2, 0, 0.5)], "case string, k int, random_state int, f1 double")
    W.append_metrics(row, out)
    W.append_metrics(row.withColumn("f1", F.lit(0.6)), out)          # the same run again
    W.append_metrics(row.withColumn("random_state", F.lit(1)), out)
    W.append_metrics(row.withColumn("random_state", F.lit(2)).withColumn("bleu", F.lit(0.1)), out)
    got = sorted((r.random_state, r.f1, r.bleu) for r in R.read_metrics(spark, out).fillna(-1.0).collect())
    assert got == [(0, 0.6, -1.0), (1, 0.5, -1.0), (2, 0.5, 0.1)]


def test_grid_grows_with_the_rows_not_with_their_product():
    """Small blocks share cells; with a group, a cell's queries and bank rows, whose product it may give, stay few."""
    def sizes(n):
        return {"q": (n // 10, n // 10 * 264), "b": (n, n * 264)}
    small, large = (np.prod(retrieve._grid(sizes(n), 12, False, 64)) for n in (100_000, 600_000))
    assert large <= 2 * small <= 2 * 12 * 12
    for n in (100_000, 600_000):
        groups, cells = retrieve._grid(sizes(n), 12, True, None)
        assert (n // 10 / groups) * (n / cells) <= 1 << 21
    # a cell never has fewer rows than a block
    assert retrieve._grid({"q": (5, 100), "b": (9, 100)}, 12, False, 64) == (1, 1)


def test_cells_of_a_grouped_search_give_few_rows(spark, monkeypatch):
    """What one call of the scoring returns is bounded, whatever the number of queries and groups."""
    x = vectors(600, 8)
    v = spark.createDataFrame([(i, i // 5, r.tolist()) for i, r in enumerate(x)], "id long, batch int, embs array<double>").repartition(2)
    whole = {(r.query_id, r.batch, r.rank, r.bank_id) for r in retrieve.topk(v, v, 2, query_key="id", bank_key="id", group="batch").collect()}
    monkeypatch.setattr(retrieve, "GROUP_QUERIES", 40, raising=False)
    monkeypatch.setattr(retrieve, "GROUP_ROWS", 50, raising=False)
    top = retrieve.topk(v, v, 2, query_key="id", bank_key="id", group="batch")
    assert {(r.query_id, r.batch, r.rank, r.bank_id) for r in top.collect()} == whole and len(whole) == 600 * 120 * 2
    sizes = retrieve._sizes(v.select(F.col("embs").alias("v")), v.select(F.col("embs").alias("v")))
    assert min(retrieve._grid(sizes, 1, True, None)) >= 12


def test_metrics_runs_join_the_documents_once(spark, tmp_path, monkeypatch):
    """Every evaluation of the history reads the bank's rows as they were written, in the labels, too."""
    from studybank.plans import bindings, q_evaluation
    rows = [(i, [float(i % 5), 1.0], i % 3) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(i, f"text {i % 7}") for i in range(30)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 4, 1) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    calls, whole = [], bindings.bank_rows
    monkeypatch.setattr(bindings, "bank_rows", lambda *a: calls.append(a) or whole(*a))
    got = q_evaluation.q_metrics_runs(spark, str(tmp_path)).collect()
    assert sorted(r["case"] for r in got) == ["plain", "with bleu"] and len(calls) == 1


def test_results_of_whole_groups_are_not_shuffled(spark, monkeypatch):
    """Groups that lie in one cell give final rows; large groups are cut and merged; queries may come twice."""
    x = np.round(vectors(500, 6), 2)
    v = spark.createDataFrame([(i, None if i % 50 == 49 else min(i // 7, 40), r.tolist()) for i, r in enumerate(x)],
                              "id long, batch int, embs array<double>").repartition(3)
    q = v.where("id % 4 = 0").select("id", "embs")
    q = q.unionAll(q.where("id < 100")).repartition(5)

    def found(df):
        return sorted(((r.query_id, r.batch, r["rank"], r.bank_id, round(r.sim, 9)) for r in df.collect()), key=str)
    unit = retrieve._normalise(x)
    rows = {}
    for i in [i for i in range(500) if i % 4 == 0] + list(range(0, 100, 4)):
        for j in range(500):
            rows.setdefault((i, None if j % 50 == 49 else min(j // 7, 40)), []).append((-float(np.round(unit[i] @ unit[j], 9)), j))
    want = sorted(((i, g, rank, j, -s) for (i, g), r in rows.items() for rank, (s, j) in enumerate(sorted(r)[:3], 1)), key=str)

    def whole(got):
        # near ties may change places
        assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[4] for x in got], [x[4] for x in want], atol=2e-9)
        assert len({x[:4] for x in got}) >= 0.9 * len({x[:4] for x in want})
    top = retrieve.topk(q, v, 3, query_key="id", bank_key="id", group="batch")
    assert "Window" not in top._jdf.queryExecution().executedPlan().toString()
    whole(found(top))
    for name, value in (("GROUP_QUERIES", 30), ("GROUP_ROWS", 40), ("QUERY_BYTES", 3000), ("PACK_BYTES", 200)):
        monkeypatch.setattr(retrieve, name, value)
    cut = retrieve.topk(q, v, 3, query_key="id", bank_key="id", group="batch")
    assert "Window" in cut._jdf.queryExecution().executedPlan().toString()  # batch 40 has more than 40 rows
    whole(found(cut))


def test_few_shares_send_vectors_to_few_cells():
    def sizes(n):
        return {"q": (n // 10, n // 10 * 264), "b": (n, n * 264)}
    for n in (100_000, 600_000):
        groups, cells = retrieve._shares(sizes(n), 12)
        assert groups * n + cells * n // 10 <= 10 * n  # rows sent
        assert sizes(n)["q"][1] <= groups * retrieve.QUERY_BYTES and sizes(n)["b"][1] <= cells * retrieve.BANK_BYTES
    assert retrieve._shares({"q": (5, 100), "b": (9, 100)}, 12) == (1, 1)
