"""Registered text, section, mention and labeller queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from studybank import constants as K
from studybank.functions import text as T
from studybank.operators import labels as L
from studybank.operators import mentions as M
from studybank.operators import sections as S
from studybank.operators import splits as SP
from studybank.operators.metrics import bleu2
from studybank.operators.spans import split_pattern
from studybank.operators.text import join_ranked, pad_tokens, split_on_dot, word_tokens
from studybank.plans import bindings as B
from studybank.plans import labeller
from studybank.plans.registry import register, rounded
from studybank.session import cut_lineage, spread

# ----------------------------------------------------------------------------
# SQL building blocks (DuckDB / RE2: no look-around, so the slash rule runs twice)
# ----------------------------------------------------------------------------
WS_SQL = T.WS


def clean_sql(c: str) -> str:
    t = f"replace(lower({c}), 'and/or', 'or')"
    t = f"regexp_replace({t}, '([a-zA-Z])/([a-zA-Z])', '\\1 or \\2', 'g')"
    t = f"regexp_replace({t}, '([a-zA-Z])/([a-zA-Z])', '\\1 or \\2', 'g')"
    t = f"replace({t}, '..', '.')"
    t = f"regexp_replace({t}, '([.,])', '\\1 ', 'g')"
    t = f"regexp_replace({t}, '{WS_SQL}+', ' ', 'g')"
    t = f"regexp_replace({t}, '^ | $', '', 'g')"
    t = f"regexp_replace({t}, '\\. +\\.', '.', 'g')"
    return t


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


REPORTS = "reports AS (SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id, text AS report FROM documents)"
CLEAN = f"clean AS (SELECT study_id, coalesce({clean_sql('report')}, '') AS text FROM reports)"
SENTS = """
sp AS (SELECT study_id, string_split(regexp_replace(text, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS ps
       FROM clean),
sx AS (SELECT study_id, ps, unnest(range(len(ps))) AS i FROM sp),
sents AS MATERIALIZED (SELECT study_id, CAST(i AS INTEGER) AS sent_idx,
                 CAST(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x) + 1)), 0) AS INTEGER) AS "offset",
                 ps[i + 1] AS text
          FROM sx WHERE length(ps[i + 1]) > 0)
"""


def _phrases_sql(phr: str | None = None) -> str:
    """Dictionary CTEs; ``phr`` is an optional SQL query producing
    ``(observation, phrase, kind)`` instead of the demo list."""
    vals = ", ".join(f"({_q(o)}, {_q(p)}, {_q(k)})" for o, p, k in B.DEMO_PHRASES)
    pos = ", ".join(f"({_q(a + b)})" for a in K.UNMENTION_PREFIXES for b in K.UNMENTION_QUALIFIERS)
    skip = ", ".join(_q(x) for x in K.UNMENTION_SKIP)
    card, ecm = _q(K.CARDIOMEGALY), _q(K.ENLARGED_CARDIOMEDIASTINUM)
    phr_cte = (f"phr(observation, phrase, kind) AS (VALUES {vals})" if phr is None
               else f"phr AS ({phr})")
    return f"""
{phr_cte},
pos(p) AS (VALUES {pos}),
ment_ph AS (SELECT observation, phrase FROM phr WHERE kind = 'mention'),
unm_ph AS (
  SELECT observation, phrase FROM phr WHERE kind = 'unmention' AND observation NOT IN ({card}, {ecm})
  UNION ALL
  SELECT m.observation, pos.p || ' ' || replace(m.phrase, 'the ', '') FROM ment_ph m, pos
  WHERE m.observation = {card} AND m.phrase NOT IN ({skip})
  UNION ALL
  SELECT m.observation, pos.p || ' ' || m.phrase FROM ment_ph m, pos WHERE m.observation = {ecm})
"""


def _spans_sql(name: str, table: str) -> str:
    return f"""
{name}_m AS (
  SELECT s.study_id, s.sent_idx, s."offset", s.text, p.observation, p.phrase,
         regexp_extract_all(s.text, p.phrase) AS ms, string_split_regex(s.text, p.phrase) AS gs
  FROM sents s, {table} p WHERE regexp_matches(s.text, p.phrase)),
{name}_x AS (SELECT *, unnest(range(len(ms))) AS i FROM {name}_m),
{name} AS MATERIALIZED (
  SELECT study_id, sent_idx, "offset", text, observation, phrase,
         CAST(coalesce(list_sum(list_transform(gs[1:i + 1], lambda g: length(g))), 0)
              + coalesce(list_sum(list_transform(ms[1:i], lambda m: length(m))), 0) AS INTEGER) AS start,
         CAST(coalesce(list_sum(list_transform(gs[1:i + 1], lambda g: length(g))), 0)
              + coalesce(list_sum(list_transform(ms[1:i + 1], lambda m: length(m))), 0) AS INTEGER) AS "end"
  FROM {name}_x)
"""


def _fires_sql(pattern: str) -> str:
    pre, post = split_pattern(pattern)
    conds = []
    if pre:
        conds.append(f"regexp_matches(substring(text, 1, start), {_q(f'(?:{pre})$')})")
    if post:
        conds.append(f"regexp_matches(substring(text, \"end\" + 1), {_q(f'^(?:{post})')})")
    return "(" + " AND ".join(conds or ["TRUE"]) + ")"


def _status_sql() -> str:
    def any_of(role):
        c = [_fires_sql(p) for r, p in B.DEMO_PATTERNS if r == role]
        return "(" + " OR ".join(c or ["FALSE"]) + ")"
    return (f"CASE WHEN {any_of('pre_uncertain')} THEN 'uncertain' "
            f"WHEN {any_of('negation')} THEN 'negative' "
            f"WHEN {any_of('post_uncertain')} THEN 'uncertain' ELSE 'positive' END")


def labeller_sql(phr: str | None = None) -> str:
    return LABELLER_T.replace("@@PHRASES@@", _phrases_sql(phr))


LABELLER_T = f"""
WITH {REPORTS}, {CLEAN}, {SENTS}, @@PHRASES@@,
{_spans_sql('found', 'ment_ph')},
{_spans_sql('unfound', 'unm_ph')},
kept AS MATERIALIZED (
  SELECT f.* FROM found f WHERE NOT EXISTS (
    SELECT 1 FROM unfound u WHERE u.study_id = f.study_id AND u.sent_idx = f.sent_idx
      AND u.observation = f.observation AND f.start < u."end" AND f."end" > u.start)),
ann AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY study_id ORDER BY sent_idx, start, observation, phrase) - 1
                 AS INTEGER) AS ann_id,
         CAST("offset" + start AS INTEGER) AS doc_offset, CAST("end" - start AS INTEGER) AS length,
         substring(text, start + 1, "end" - start) AS mention
  FROM kept),
asserted AS (
  SELECT *, {_status_sql()} AS status FROM ann),
lab AS MATERIALIZED (
  SELECT *, CAST(CASE status WHEN 'negative' THEN 0 WHEN 'uncertain' THEN -1 ELSE 1 END AS INTEGER) AS label
  FROM asserted),
own AS (SELECT study_id, observation AS cat, label AS val, text AS sents FROM lab
        WHERE observation <> 'No Finding'),
hf AS (SELECT study_id, 'Cardiomegaly' AS cat, -1 AS val, text AS sents FROM lab
       WHERE label IN (1, -1) AND mention IN ('chf', 'heart failure')),
found_doc AS (SELECT DISTINCT study_id FROM lab WHERE observation <> 'Support Devices' AND label IN (1, -1)),
nf AS (SELECT c.study_id, 'No Finding' AS cat, 1 AS val, c.text AS sents FROM clean c
       WHERE c.study_id NOT IN (SELECT study_id FROM found_doc)),
rows AS (SELECT study_id, cat, CAST(val AS INTEGER) AS val, sents FROM own
         UNION ALL SELECT study_id, cat, CAST(val AS INTEGER), sents FROM hf
         UNION ALL SELECT study_id, cat, CAST(val AS INTEGER), sents FROM nf),
resolved AS (
  SELECT study_id, cat, CAST(CASE WHEN bool_or(val = 0) AND bool_or(val = -1) THEN -1
                                  WHEN bool_or(val = 0) AND bool_or(val = 1) THEN 1
                                  WHEN bool_or(val = -1) AND bool_or(val = 1) THEN 1
                                  ELSE min(val) END AS INTEGER) AS val
  FROM rows GROUP BY study_id, cat)
"""
LABELLER = LABELLER_T.replace("@@PHRASES@@", _phrases_sql())



def _reports(spark, sf_dir):
    return B.reports(spark, sf_dir)


def _sents(spark, sf_dir):
    return labeller.sentences(_reports(spark, sf_dir))


def _phr(spark):
    return M.expand_unmentions(B.phrases(spark))


# ----------------------------------------------------------------------------
# row-level text
# ----------------------------------------------------------------------------
@register("clean_report", f"WITH {REPORTS}, {CLEAN} SELECT study_id, text FROM clean")
def q_clean(spark, sf_dir):
    return labeller.cleaned(spread(_reports(spark, sf_dir)))


@register("strip_newlines", """
SELECT doc_id, replace(replace(text, chr(10), ''), chr(13), '') AS text FROM documents
""")
def q_strip(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.strip_newlines("text").alias("text"))


@register("split_sentences_dot", """
SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id, CAST(i AS INTEGER) AS piece_idx, ps[i + 1] AS report
FROM (SELECT doc_id, ps, unnest(range(len(ps))) AS i FROM
        (SELECT doc_id, string_split(text, '.') AS ps FROM documents))
WHERE length(ps[i + 1]) > 0
""")
def q_split_dot(spark, sf_dir):
    return split_on_dot(_reports(spark, sf_dir), "report")


@register("split_sentences", f"""
WITH {REPORTS}, {CLEAN}, {SENTS} SELECT study_id, sent_idx, "offset", text FROM sents
""")
def q_split_sentences(spark, sf_dir):
    return _sents(spark, sf_dir)


@register("alnum_clean", """
SELECT doc_id, list_filter(string_split(regexp_replace(text, '[^0-9a-zA-Z ]+', ' ', 'g'), ' '),
                           lambda w: w <> '') AS tokens
FROM documents
""")
def q_alnum(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.alnum_tokens("text").alias("tokens"))


@register("join_sentences", """
SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id,
       array_to_string(list_filter(string_split(text, '.'), lambda p: length(p) > 0), '. ') AS joined
FROM documents
WHERE len(list_filter(string_split(text, '.'), lambda p: length(p) > 0)) > 0
""")
def q_join_sentences(spark, sf_dir):
    pieces = split_on_dot(_reports(spark, sf_dir), "report")
    return join_ranked(pieces, "study_id", "piece_idx", "report")


@register("template_text", """
SELECT item_id, 'this is a photo of ' || text || '.' AS caption FROM benchmark
""")
def q_template(spark, sf_dir):
    b = B.table(spark, sf_dir, "benchmark")
    return b.select("item_id", T.template("text").alias("caption"))


@register("path_keys", """
SELECT page_id, regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1) AS stem,
       regexp_extract(url, '([^/]*)/[^/]*$', 1) AS parent
FROM pages
""")
def q_path_keys(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages")
    return p.select("page_id", T.file_stem("url").alias("stem"), T.parent_stem("url").alias("parent"))


@register("path_rewrite", """
SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN 'http:_res/' || substring(url, 7) ELSE url END AS path
FROM pages
""")
def q_path_rewrite(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages")
    return p.select("page_id", T.rewrite_root("url", "http:").alias("path"))


@register("tokens_pad_truncate", """
WITH t AS (
  SELECT doc_id, CAST(floor(doc_id / 32) AS INTEGER) AS batch_id,
         list_transform(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''),
                        lambda w: length(w)) AS ids
  FROM documents),
c AS (SELECT doc_id, batch_id, ids[1:128] AS ids FROM t),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS mx FROM c)
SELECT doc_id, batch_id, list_concat(ids, list_transform(range(mx - len(ids)), lambda x: 0)) AS input_ids,
       list_concat(list_transform(range(len(ids)), lambda x: 1), list_transform(range(mx - len(ids)), lambda x: 0))
         AS attention_mask
FROM w
""")
def q_pad(spark, sf_dir):
    """Word tokens (ids = token length, a stand-in vocabulary), cut at 128 and
    padded to the longest row of each batch of 32 documents."""
    d = B.table(spark, sf_dir, "documents")
    t = d.select("doc_id", F.floor(F.col("doc_id") / 32).cast("int").alias("batch_id"),
                 F.transform(word_tokens(F.col("text")), lambda w: F.length(w)).alias("input_ids"))
    return pad_tokens(t, "input_ids", "batch_id", K.MAX_TOKENS)


@register("sample_sentences", """
WITH p AS (SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id,
                  list_filter(string_split(replace(replace(text, chr(10), ''), chr(13), ''), '.'),
                              lambda s: length(s) > 0) AS ps FROM documents),
k AS (SELECT study_id, list_transform(ps, lambda s, i: {'h': md5('42:' || study_id || ':' || CAST(i - 1 AS VARCHAR)),
                                                       'i': i - 1, 's': s}) AS ks FROM p)
SELECT study_id, array_to_string(list_transform(list_sort(ks)[1:3],
         lambda x: trim(x.s, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))), '. ') AS caption
FROM k
""")
def q_sample_sentences(spark, sf_dir):
    return SP.sample_sentences(_reports(spark, sf_dir), "report", "study_id", 3, seed=42).select(
        "study_id", "caption")


@register("shuffle_batch", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rk,
                  count(*) OVER () AS n FROM documents)
SELECT doc_id, CAST(floor(rk / 64) AS INTEGER) AS batch_id, CAST(rk % 64 AS INTEGER) AS pos
FROM r WHERE floor(rk / 64) < floor(n / 64)
""")
def q_shuffle_batch(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("doc_id")
    return SP.assign_batches(d, "doc_id", 64, seed=42)


# ----------------------------------------------------------------------------
# sections: reports with headers are built from the documents
# ----------------------------------------------------------------------------
def sectioned_reports(spark, sf_dir):
    """en: FINDINGS + IMPRESSION; fr: a study-wide header; de: HISTORY with
    blank-line paragraphs; es: no header at all."""
    d = B.table(spark, sf_dir, "documents")
    first = F.split(F.col("text"), r"\.", 2).getItem(0)
    rest = F.coalesce(F.get(F.split(F.col("text"), r"\.", 2), 1), F.lit(""))
    nl = F.lit("\n")
    text = (F.when(F.col("lang") == "en", F.concat(F.lit("HDR"), nl, F.lit(" FINDINGS: "), first,
                                                   nl, F.lit(" IMPRESSION: "), rest))
            .when(F.col("lang") == "fr", F.concat(F.lit("EXAM"), nl, F.lit(" CHEST, TWO VIEWS: "),
                                                  F.col("text")))
            .when(F.col("lang") == "de", F.concat(F.lit("X"), nl, F.lit(" HISTORY: "),
                                                  F.replace(F.col("text"), nl, F.lit("\n \n"))))
            .otherwise(F.col("text")))
    return d.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("study_id"),
                    text.alias("text"))


def _sections(spark, sf_dir):
    return S.split_sections(sectioned_reports(spark, sf_dir), "text", "study_id")


@register("section_split")
def q_section_split(spark, sf_dir):
    return _sections(spark, sf_dir)


@register("section_drop_empty")
def q_section_drop_empty(spark, sf_dir):
    """Sections before and after the empty-body filter, per study."""
    rep = S._with_sections(sectioned_reports(spark, sf_dir), "text", "_s")
    return rep.select("study_id", F.size("_s").alias("raw"),
                      F.size(S.drop_empty_body(F.col("_s"))).alias("kept"))


@register("last_paragraph")
def q_last_paragraph(spark, sf_dir):
    return _sections(spark, sf_dir).where(F.col("name") == "last_paragraph")


@register("last_section_pick")
def q_last_section_pick(spark, sf_dir):
    return S.pick_section(_sections(spark, sf_dir))


@register("report_concat")
def q_report_concat(spark, sf_dir):
    return S.concat_sections(_sections(spark, sf_dir))


@register("impression_filter")
def q_impression_filter(spark, sf_dir):
    return S.only_impression(_sections(spark, sf_dir))


def _overrides(spark, sf_dir):
    """Data-derived overrides: src3 documents get a slice [5, 60), src4
    documents get their 'preamble' section picked by name."""
    d = B.table(spark, sf_dir, "documents")
    sid = F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("study_id")
    sl = d.where(F.col("source") == "src3").select(
        sid, F.lit(None).cast("string").alias("section_name"),
        F.lit(5).alias("start"), F.lit(60).alias("end"))
    nm = d.where(F.col("source") == "src4").select(
        sid, F.lit("preamble").alias("section_name"),
        F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    return sl.unionByName(nm)


@register("join_overrides")
def q_join_overrides(spark, sf_dir):
    rep = sectioned_reports(spark, sf_dir)
    return S.apply_overrides(rep, S.split_sections(rep), _overrides(spark, sf_dir))


@register("custom_slice", """
SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id, substring(text, 6, 55) AS report
FROM documents WHERE source = 'src3'
""")
def q_custom_slice(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("study_id"), "text")
    ov = _overrides(spark, sf_dir).where(F.col("start").isNotNull())
    return d.join(ov, "study_id").select(
        "study_id", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("report"))


def _normalise_sql(c: str) -> str:
    name = f"lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)))"
    whens = " ".join(f"WHEN {name} = {_q(k)} THEN {_q(v)}" for k, v in K.SECTION_NAME_MAP.items())
    mains = " ".join(f"WHEN contains({name}, {_q(m)}) THEN {_q(m)}" for m in K.MAIN_SECTIONS)
    import re as _re
    alt = "(" + "|".join(_re.escape(t) for t in K.STUDY_WIDE_TERMS) + ")"
    return (f"CASE {whens} {mains} WHEN regexp_matches({name}, {_q(alt)}) THEN 'findings' "
            f"ELSE {name} END")


@register("section_normalise", f"""
WITH h AS (SELECT doc_id, unnest(coalesce(string_split(lower(text), '.'), [NULL])) AS header FROM documents)
SELECT doc_id, header, {_normalise_sql('header')} AS name FROM h
""")
def q_section_normalise(spark, sf_dir):
    """Header candidates: every '.'-piece of each document."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    return d.select("doc_id", B.pieces("text").alias("header")).select(
        "doc_id", "header", T.normalise_section(F.col("header")).alias("name"))


# ----------------------------------------------------------------------------
# mentions and labels
# ----------------------------------------------------------------------------
@register("unmention_expand", f"""
WITH {REPORTS}, {CLEAN}, {SENTS}, {_phrases_sql()}, {_spans_sql('found', 'ment_ph')}, {_spans_sql('unfound', 'unm_ph')},
expanded AS (SELECT observation, phrase, 'unmention' AS kind FROM unm_ph
             UNION ALL SELECT observation, phrase, 'mention' AS kind FROM ment_ph),
hits AS (SELECT observation, phrase, 'unmention' AS kind, count(*) AS n FROM unfound GROUP BY ALL
         UNION ALL SELECT observation, phrase, 'mention' AS kind, count(*) AS n FROM found GROUP BY ALL)
SELECT observation, phrase, kind, coalesce(n, 0) AS spans FROM expanded LEFT JOIN hits USING (observation, phrase, kind)
""")
def q_unmention_expand(spark, sf_dir):
    """The expanded dictionary, and how many spans each phrase has in the documents."""
    phr, key = _phr(spark), ["observation", "phrase", "kind"]
    spans = M.phrase_spans(_sents(spark, sf_dir), phr, ("mention", "unmention"))
    hits = spans.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return phr.select(*key).join(hits, key, "left").select(*key, F.coalesce("n", F.lit(0)).alias("spans"))


@register("mention_spans", f"""
WITH {REPORTS}, {CLEAN}, {SENTS}, {_phrases_sql()}, {_spans_sql('found', 'ment_ph')}
SELECT study_id, sent_idx, observation, phrase, start, "end" FROM found
""")
def q_mention_spans(spark, sf_dir):
    found = M.phrase_spans(_sents(spark, sf_dir), _phr(spark), "mention")
    return found.select("study_id", "sent_idx", "observation", "phrase", "start", "end")


@register("join_phrase_match", f"""
WITH {REPORTS}, {CLEAN}, {SENTS}, {_phrases_sql()}
SELECT s.study_id, s.sent_idx, p.observation, p.phrase
FROM sents s, ment_ph p WHERE regexp_matches(s.text, p.phrase)
""")
def q_phrase_match(spark, sf_dir):
    found = M.phrase_spans(_sents(spark, sf_dir), _phr(spark), "mention")
    return found.select("study_id", "sent_idx", "observation", "phrase").distinct()


@register("join_unmention_overlap", LABELLER + """
SELECT study_id, sent_idx, observation, phrase, start, "end" FROM kept
""")
def q_unmention_overlap(spark, sf_dir):
    # both sides of the join come from one pass over the documents
    spans = cut_lineage(M.phrase_spans(_sents(spark, sf_dir), _phr(spark), ("mention", "unmention")).drop("offset"), "spans")
    kept = M.drop_unmentions(spans.where("kind = 'mention'"), spans.where("kind = 'unmention'"))
    return kept.select("study_id", "sent_idx", "observation", "phrase", "start", "end")


def _mentions(spark, sf_dir):
    return labeller.mentions(_reports(spark, sf_dir), B.phrases(spark), B.patterns(spark))


@register("mention_annotation", LABELLER + """
SELECT study_id, ann_id, observation, phrase, doc_offset, length, mention FROM ann
""")
def q_mention_annotation(spark, sf_dir):
    return _mentions(spark, sf_dir).select("study_id", "ann_id", "observation", "phrase",
                                           "doc_offset", "length", "mention")


@register("assert_cascade", LABELLER + """
SELECT study_id, ann_id, observation, status, label FROM lab
""")
def q_assert(spark, sf_dir):
    return _mentions(spark, sf_dir).select("study_id", "ann_id", "observation", "status", "label")


def _label_rows(spark, sf_dir):
    return labeller.label_rows(_reports(spark, sf_dir), B.phrases(spark), B.patterns(spark))


HF_PHRASES = [("Cardiomegaly", "chf", "mention"), ("Edema", "heart failure", "mention")]
HF_REPORTS = """reports AS (SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id,
    replace(replace(text, ' the ', ' chf '), ' and ', ' heart failure ') AS report FROM documents)"""


@register("heart_failure_rule", labeller_sql(
    " UNION ALL ".join(f"SELECT {_q(o)} AS observation, {_q(p)} AS phrase, {_q(k)} AS kind" for o, p, k in HF_PHRASES)
).replace(REPORTS, HF_REPORTS) + "SELECT study_id, cat, CAST(val AS INTEGER) AS val, sents FROM hf")
def q_heart_failure(spark, sf_dir):
    """The rule's rows over the documents, two frequent words of which become the two texts it looks for."""
    report = F.replace(F.replace("report", F.lit(" the "), F.lit(" chf ")), F.lit(" and "), F.lit(" heart failure "))
    phrases = spark.createDataFrame(HF_PHRASES, "observation string, phrase string, kind string")
    rows = labeller.label_rows(_reports(spark, sf_dir).withColumn("report", report), phrases, B.patterns(spark),
                               rules=True)
    return rows.where(F.col("rule") == "heart_failure").drop("rule")


@register("no_finding_rule", LABELLER + "SELECT study_id, cat, CAST(val AS INTEGER) AS val, sents FROM nf")
def q_no_finding(spark, sf_dir):
    return _label_rows(spark, sf_dir).where(F.col("cat") == K.NO_FINDING)


@register("sentence_label_long", LABELLER + """
SELECT r.study_id AS mimic_id, r.report, x.cat, x.val AS vals, x.sents
FROM reports r LEFT JOIN rows x ON x.study_id = r.study_id
""")
def q_sentence_long(spark, sf_dir):
    return labeller.sentence_table(_reports(spark, sf_dir), B.phrases(spark), B.patterns(spark))


@register("label_conflict_resolve", LABELLER + "SELECT study_id, cat, val FROM resolved")
def q_resolve(spark, sf_dir):
    return L.resolve_conflicts(_label_rows(spark, sf_dir), "study_id", "cat", "val")


def _vector_sql() -> str:
    cols = ", ".join(
        f'CAST(max(CASE WHEN cat = {_q(c)} THEN val END) AS INTEGER) AS "{c}"' for c in K.CATEGORIES)
    return LABELLER + f"""
, wide AS (SELECT study_id, {cols} FROM resolved GROUP BY study_id)
SELECT r.study_id, {", ".join(f'w."{c}"' for c in K.CATEGORIES)}
FROM reports r LEFT JOIN wide w ON w.study_id = r.study_id
"""


@register("doc_label_vector", _vector_sql())
def q_doc_vector(spark, sf_dir):
    return labeller.document_vectors(_reports(spark, sf_dir), B.phrases(spark), B.patterns(spark))


@register("bleu2", """
WITH p AS (SELECT c.doc_id, coalesce(r.text, '') AS ref, coalesce(c.text, '') AS cand
           FROM documents c LEFT JOIN documents r ON r.doc_id = xor(c.doc_id, 1)),
t AS (SELECT doc_id,
             list_filter(string_split(regexp_replace(replace(replace(ref, chr(10), ''), chr(13), ''),
                                                     '[^0-9a-zA-Z ]+', ' ', 'g'), ' '), lambda w: w <> '') AS r,
             list_filter(string_split(regexp_replace(replace(replace(cand, chr(10), ''), chr(13), ''),
                                                     '[^0-9a-zA-Z ]+', ' ', 'g'), ' '), lambda w: w <> '') AS c
      FROM p),
g AS (
  SELECT doc_id, 1 AS n, 'c' AS side, unnest(c) AS gram FROM t
  UNION ALL SELECT doc_id, 1, 'r', unnest(r) FROM t
  UNION ALL SELECT doc_id, 2, 'c', unnest(list_transform(range(greatest(len(c) - 1, 0)),
                                                         lambda i: c[i + 1] || ' ' || c[i + 2])) FROM t
  UNION ALL SELECT doc_id, 2, 'r', unnest(list_transform(range(greatest(len(r) - 1, 0)),
                                                         lambda i: r[i + 1] || ' ' || r[i + 2])) FROM t),
cnt AS (SELECT doc_id, n, gram, sum(CASE WHEN side = 'c' THEN 1 ELSE 0 END) AS cc,
               sum(CASE WHEN side = 'r' THEN 1 ELSE 0 END) AS rc FROM g GROUP BY ALL),
m AS (SELECT doc_id, sum(CASE WHEN n = 1 THEN least(cc, rc) END) AS m1,
             sum(CASE WHEN n = 2 THEN least(cc, rc) END) AS m2 FROM cnt GROUP BY doc_id),
j AS (SELECT t.doc_id, len(t.c) AS cl, len(t.r) AS rl, coalesce(m.m1, 0) AS m1, coalesce(m.m2, 0) AS m2
      FROM t LEFT JOIN m ON m.doc_id = t.doc_id)
SELECT doc_id, round(CASE WHEN m1 = 0 OR m2 = 0 OR cl = 0 THEN 0.0
                      ELSE (CASE WHEN cl > rl THEN 1.0 ELSE exp(1 - rl / cl) END)
                           * exp(0.5 * ln(m1 / greatest(1, cl)) + 0.5 * ln(m2 / greatest(1, cl - 1))) END, 9) AS bleu
FROM j
""")
def q_bleu2(spark, sf_dir):
    """Every document against its neighbour (the id with the lowest bit turned; an empty text if there is none)."""
    d = B.table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    cand = d.select("doc_id", text.alias("cand"))
    ref = d.select(F.col("doc_id").bitwiseXOR(F.lit(1)).alias("doc_id"), text.alias("ref"))
    pairs = cand.join(ref, "doc_id", "left").fillna("", ["ref"])
    return rounded(bleu2(pairs, "doc_id", "ref", "cand"))
