"""Label-overlap retrieval metrics, skip accounting, BLEU-2 and predictions.

Label vectors are long tables ``(id, cat, val)`` holding only the non-null
cells.  Per query, everything needed (the query's cells and the cells of its k
retrieved rows) is gathered with one ``groupBy(query_id)``: the group is bounded
by ``(k + 1) * #categories`` entries whatever the data size, and all counts are
then computed with higher-order array functions in the same stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studybank.functions.text import alnum_tokens, strip_newlines

SCORE_COLUMNS = ["query_id", "status", "n_rows", "num_preds", "query_cells", "n_hits",
                 "hit_classes", "flat_hit", "precision", "recall", "duplicates"]


def query_scores(queries: DataFrame, top: DataFrame, query_labels: DataFrame,
                 bank_labels: DataFrame, query_key: str = "query_id",
                 label_key: str = "id") -> DataFrame:
    """Per-query scores.

    ``queries``: one row per query (``query_key``); ``top``: ``(query_id, rank,
    bank_id)`` already cut to k; ``query_labels`` / ``bank_labels``:
    ``(label_key, cat, val)`` non-null cells.

    * ``status``: ``no_bank_labels`` when no retrieved row has any label (checked
      first), ``no_query_labels`` when the query has none, else ``evaluated``;
    * ``n_hits``: classes where some retrieved row has the query's value;
    * ``precision`` = hits / labelled cells over the k rows; ``recall`` = hits /
      the query's labelled classes; ``duplicates`` = rows - distinct label vectors
      (an all-null vector counts as one value).
    """
    q_ids = queries.select(F.col(query_key).cast("long").alias("query_id")).distinct()
    row_cells = (
        top.select("query_id", "rank", "bank_id")
        .join(bank_labels.select(F.col(label_key).alias("bank_id"), "cat",
                                 F.col("val").cast("int").alias("val")),
              "bank_id", "left")
        .select("query_id", "rank", "cat", "val", F.lit(None).cast("int").alias("qval"))
    )
    q_cells = (
        query_labels.select(F.col(label_key).cast("long").alias("query_id"), "cat",
                            F.col("val").cast("int").alias("qval"))
        .join(q_ids, "query_id", "left_semi")
        .select("query_id", F.lit(None).cast("int").alias("rank"), "cat",
                F.lit(None).cast("int").alias("val"), "qval")
    )
    gathered = row_cells.unionByName(q_cells).groupBy("query_id").agg(
        F.collect_list(F.when(F.col("rank").isNotNull(),
                              F.struct("rank", "cat", "val"))).alias("rows"),
        F.collect_list(F.when(F.col("rank").isNull(),
                              F.struct("cat", "qval"))).alias("qs"),
    )
    rows, qs = F.col("rows"), F.col("qs")
    labelled = F.filter(rows, lambda r: r["cat"].isNotNull())
    ranks = F.array_distinct(F.transform(rows, lambda r: r["rank"]))
    hit_rows = F.filter(labelled, lambda r: F.exists(
        qs, lambda q: (q["cat"] == r["cat"]) & (q["qval"] == r["val"])))
    hit_classes = F.array_sort(F.array_distinct(F.transform(hit_rows, lambda r: r["cat"])))
    signatures = F.transform(ranks, lambda rk: F.array_sort(F.transform(
        F.filter(labelled, lambda r: r["rank"] == rk),
        lambda r: F.struct(r["cat"].alias("cat"), r["val"].alias("val")))))
    scored = gathered.select(
        "query_id",
        F.size(ranks).alias("n_rows"),
        F.size(labelled).alias("num_preds"),
        F.size(qs).alias("query_cells"),
        F.size(hit_classes).alias("n_hits"),
        hit_classes.alias("hit_classes"),
        (F.size(ranks) - F.size(F.array_distinct(signatures))).alias("duplicates"),
    )
    out = q_ids.join(scored, "query_id", "left").fillna(
        0, ["n_rows", "num_preds", "query_cells", "n_hits", "duplicates"])
    status = (F.when(F.col("num_preds") == 0, F.lit("no_bank_labels"))
              .when(F.col("query_cells") == 0, F.lit("no_query_labels"))
              .otherwise(F.lit("evaluated")))
    ev = status == "evaluated"
    return out.select(
        "query_id",
        status.alias("status"),
        "n_rows", "num_preds", "query_cells", "n_hits",
        F.coalesce("hit_classes", F.array().cast("array<string>")).alias("hit_classes"),
        (ev & (F.col("n_hits") > 0)).alias("flat_hit"),
        F.when(ev, F.col("n_hits") / F.col("num_preds")).alias("precision"),
        F.when(ev, F.col("n_hits") / F.col("query_cells")).alias("recall"),
        F.when(ev, F.col("duplicates")).alias("duplicates"),
    )


def retrieval_metrics(scores: DataFrame, k: int) -> DataFrame:
    """One row: flat-hit rate over all queries, hits, macro precision / recall
    over evaluated queries, F1 of those means (NULL when undefined), mean
    duplicates, k and the evaluated count; mean BLEU if the scores have it."""
    ev = F.col("status") == "evaluated"
    with_bleu = "bleu" in scores.columns
    agg = scores.agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("flat_hit").cast("int")).alias("_hits"),
        F.avg(F.when(ev, F.col("precision"))).alias("precision"),
        F.avg(F.when(ev, F.col("recall"))).alias("recall"),
        F.avg(F.when(ev, F.col("duplicates").cast("double"))).alias("duplicates"),
        F.sum(ev.cast("long")).alias("test_instances"),
        *([F.avg(F.when(ev, F.col("bleu"))).alias("bleu")] if with_bleu else []),
    )
    p, r = F.col("precision"), F.col("recall")
    return agg.select(
        F.try_divide(F.col("_hits").cast("double"), F.col("_n")).alias("flat_hit"),
        F.coalesce(F.col("_hits"), F.lit(0)).cast("long").alias("hits"),
        p.alias("precision"), r.alias("recall"),
        F.try_divide(2 * p * r, p + r).alias("f1"),
        F.col("duplicates"),
        F.lit(k).cast("int").alias("k"),
        F.col("test_instances").cast("long").alias("test_instances"),
        *([F.col("bleu")] if with_bleu else []),
    )


def skip_accounting(scores: DataFrame) -> DataFrame:
    return scores.groupBy("status").agg(F.count(F.lit(1)).alias("queries"))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: named twice, its whole expression would be computed twice."""
    return F.transform(F.array(value), use)[0]


def _bigrams(tokens: Column) -> Column:
    """Pairs of neighbouring tokens, joined by a blank (tokens hold none)."""
    return F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.size(tokens)),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def _numbered(grams: Column) -> Column:
    """Each gram with its occurrence's number (``the``, ``the`` -> ``0 the``, ``1 the``): a multiset as a set.

    The grams are sorted, so equal ones are runs; a run is numbered from its first place.  One sort, then linear."""
    def number(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(s) - 1)
        firsts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def runs(starts: Column) -> Column:
            def run(first: Column, nth: Column) -> Column:
                last = F.coalesce(F.get(starts, nth + 1), F.size(s)) - first - 1
                return F.transform(F.sequence(F.lit(0), last), lambda o: F.concat(o.cast("string"), F.lit(" "), F.get(s, first)))
            return F.flatten(F.transform(starts, run))

        return F.when(F.size(s) > 0, _bound(firsts, runs)).otherwise(F.array().cast("array<string>"))

    return _bound(F.sort_array(grams), number)


def clipped_matches(cand: Column, ref: Column) -> Column:
    """How many of the candidate's grams the reference holds, each counted as often as both hold it."""
    def matches(x: Column) -> Column:
        # first occurrences as plain sets, only the repeats are numbered
        more = F.array_intersect(_numbered(_repeats(x["c"])), _numbered(_repeats(x["r"])))
        return F.size(F.array_intersect(x["c"], x["r"])) + F.size(more)

    return _bound(F.struct(cand.alias("c"), ref.alias("r")), matches)


def _repeats(grams: Column) -> Column:
    """The grams without the first occurrence of each."""
    return _bound(F.sort_array(grams), lambda s: F.filter(s, lambda g, i: (i > 0) & (g == F.get(s, i - 1))))


def bleu2_score(cand: Column, ref: Column) -> Column:
    """Sentence BLEU with weights (0.5, 0.5) of two token arrays, within the row.

    Zero unigram or bigram overlap (or an empty candidate) gives 0; brevity penalty ``exp(1 - r/c)`` when ``c <= r``."""
    def score(x: Column) -> Column:
        c, r = x["c"], x["r"]
        m1, m2 = clipped_matches(c, r), clipped_matches(_bigrams(c), _bigrams(r))
        found = F.struct(F.size(c).alias("c"), F.size(r).alias("r"), m1.alias("m1"), m2.alias("m2"))
        return _bound(found, _bleu2_of)

    return _bound(F.struct(cand.alias("c"), ref.alias("r")), score)


def _bleu2_of(n: Column) -> Column:
    penalty = F.when(n["c"] > n["r"], F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(n["r"].cast("double"), n["c"].cast("double"))))
    geo = F.exp(0.5 * F.log(n["m1"] / F.greatest(F.lit(1), n["c"])) + 0.5 * F.log(n["m2"] / F.greatest(F.lit(1), n["c"] - 1)))
    return F.when((n["c"] == 0) | (n["m1"] == 0) | (n["m2"] == 0), F.lit(0.0)).otherwise(penalty * geo)


def report_tokens(text: Column) -> Column:
    """Tokens of a reference report: newlines deleted, ``[^0-9a-zA-Z ]`` runs as spaces, split."""
    return alnum_tokens(strip_newlines(text))


def bleu2(df: DataFrame, key: str, ref: str, cand: str, out: str = "bleu") -> DataFrame:
    """``(key, bleu)``: BLEU-2 of each row's candidate text against its reference text, both cleaned alike.

    All within the row, so nothing is shuffled; work is a sort of each row's tokens, and a text of any length is one row's."""
    return df.select(key, bleu2_score(report_tokens(F.col(cand)), report_tokens(F.col(ref))).alias(out))


def retrieved_texts(top: DataFrame, bank: DataFrame, bank_key: str = "bank_id", text: str = "target") -> DataFrame:
    """``(query_id, texts)``: the retrieved texts of each query in rank order (at most k a query)."""
    own = top.select("query_id", "rank", "bank_id").join(
        bank.select(F.col(bank_key).alias("bank_id"), F.col(text).alias("_t")), "bank_id")
    return own.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "_t"))), lambda x: x["_t"]).alias("texts"))


def retrieved_bleu(reports: DataFrame, texts: DataFrame, key: str = "query_id", report: str = "report") -> DataFrame:
    """``(query_id, bleu)``: BLEU-2 of a query's retrieved texts, joined by ``". "`` in rank order, against its own report.

    ``texts`` is the result of ``retrieved_texts``.  A null report counts as empty, null texts are left out of the joined one.
    Only the reference loses its newlines; in the joined text they are spaces like any other mark."""
    pairs = reports.select(F.col(key).alias("query_id"), F.coalesce(report, F.lit("")).alias("_ref")).join(texts, "query_id")
    made = alnum_tokens(F.array_join("texts", ". "))
    return pairs.select("query_id", bleu2_score(made, report_tokens(F.col("_ref"))).alias("bleu"))


def predictions(queries: DataFrame, top: DataFrame, bank: DataFrame, scores: DataFrame,
                query_key: str = "query_id", query_text: str = "target",
                bank_key: str = "bank_id", bank_text: str = "target") -> DataFrame:
    """Prediction records ``(study_id, query, hit_classes, out)`` for evaluated
    queries; ``out`` lists the retrieved texts in rank order."""
    outs = retrieved_texts(top, bank, bank_key, bank_text).withColumnRenamed("texts", "out")
    q = queries.select(F.col(query_key).alias("query_id"), "study_id",
                       strip_newlines(F.col(query_text)).alias("query"))
    return (scores.where(F.col("status") == "evaluated")
            .select("query_id", F.when(F.size("hit_classes") > 0, F.col("hit_classes"))
                    .alias("hit_classes"))
            .join(q, "query_id").join(outs, "query_id", "left")
            .select("query_id", "study_id", "query", "hit_classes", "out"))
