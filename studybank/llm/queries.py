"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studybank.llm import (
    chat, decontam, jaccard, langid, mixing, negatives, sharding, suffixes, tokens, topk, toxicity, warc, whitening)
from studybank.llm.common import table
from studybank.session import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return put


@query("op1_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS payload_digest,
                  strlen(coalesce(html, '')) AS payload_bytes FROM pages),
g AS (SELECT payload_digest, max(page_id) AS m FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN g.m IS NULL OR g.m = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.m <> p.page_id THEN g.m END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives."""
    pages = table(spark, sf_dir, "pages")
    path = shared_dir(spark, "warc")
    warc.write_warc(pages, path)
    read = warc.read_warc(spark, path, payloads=False)
    sure = F.when(F.col("verified"), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("digest differs in page "), F.col("page_id").cast("string"))))
    return read.select("page_id", "payload_bytes", sure.alias("payload_digest"), "record_type", "refers_to")


@query("op2_mixing", """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
                  md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, 1 + sid % 3 AS weight, 3 * source_size / (1 + sid % 3) AS fill,
             sum(source_size) OVER () AS total, sum(1 + sid % 3) OVER () AS all_w FROM s),
f AS (SELECT *, (total - coalesce(sum(3 * source_size) OVER o, 0))::DOUBLE
                / (all_w - coalesce(sum(weight) OVER o, 0)) AS lev FROM w
      WINDOW o AS (ORDER BY fill, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min(lev, (fill, sid)) AS lev FROM f WHERE lev <= fill),
t AS (SELECT source, sid, source_size, least(3.0::DOUBLE * source_size, lv.lev * weight) AS target FROM w, lv),
c AS (SELECT sid, source_size, target, k, n, sum(n) OVER (PARTITION BY sid ORDER BY k) AS cum
      FROM (SELECT sid, source_size, target, k, sum(size)::BIGINT AS n
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL) WHERE n > 0),
p AS (SELECT sid, k, n, e, (e * source_size + cum)::DOUBLE / target AS v FROM c, range(3) AS r(e)),
x AS (SELECT sid, max((e, k)) AS m FROM (
        SELECT *, sum(n) OVER (ORDER BY v, sid, k, e) AS run FROM p)
      WHERE run <= (SELECT sum(size) FROM d) GROUP BY sid)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.source_size, t.target,
       CAST(CASE WHEN d.size = 0 THEN 0 ELSE d.size * (coalesce(x.m[1], 0) + CASE WHEN d.k <= coalesce(x.m[2], '') THEN 1 ELSE 0 END)
            END AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN x USING (sid)""")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query("op3_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score FROM p
QUALIFY rank <= 5""")
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every vector whose vec_id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


@query("op5_chat", """
WITH c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn, role, text) AS t
           FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) GROUP BY conv_id),
l AS (SELECT *, list_reverse(list_filter(t, lambda x: x.role = 'assistant'))[1].text AS said,
             len(t) - list_position(list_reverse(list_transform(t, lambda x: x.role)), 'assistant') + 1 AS pos FROM c),
r AS (SELECT a.conv_id, a.t,
        CASE WHEN a.pos IS NULL THEN a.t
             WHEN b.said IS NULL THEN list_concat(a.t[1:a.pos - 1], a.t[a.pos + 1:])
             ELSE list_concat(list_append(a.t[1:a.pos - 1], struct_pack(role := 'assistant', text := b.said)), a.t[a.pos + 1:])
        END AS u
      FROM l a LEFT JOIN l b ON b.conv_id = xor(a.conv_id, 1)),
n AS (SELECT *, coalesce(list_position(list_transform(range(1, greatest(len(t), len(u)) + 1),
        lambda i: i <= len(t) AND i <= len(u) AND t[i] IS NOT DISTINCT FROM u[i]), false) - 1, len(t)) AS n_common FROM r),
k AS (SELECT *, t[n_common + 1:] AS ct, u[n_common + 1:] AS ru FROM n),
s AS (SELECT *, list_transform(ct, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) AS cl,
             list_transform(ru, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) AS rl FROM k)
SELECT conv_id, CAST(n_common AS INTEGER) AS n_common,
  coalesce(array_to_string(list_transform(t[1:n_common], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(cl, ''), '') AS chosen, coalesce(array_to_string(rl, ''), '') AS rejected,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(ct) + 1), lambda i: ct[i].role = 'assistant'), lambda i:
    (coalesce(list_sum(list_transform(cl[1:i - 1], lambda y: length(y))), 0)::BIGINT + 22)::VARCHAR || '-' ||
    (list_sum(list_transform(cl[1:i], lambda y: length(y)))::BIGINT - 1)::VARCHAR), ','), '') AS chosen_spans,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(ru) + 1), lambda i: ru[i].role = 'assistant'), lambda i:
    (coalesce(list_sum(list_transform(rl[1:i - 1], lambda y: length(y))), 0)::BIGINT + 22)::VARCHAR || '-' ||
    (list_sum(list_transform(rl[1:i], lambda y: length(y)))::BIGINT - 1)::VARCHAR), ','), '') AS rejected_spans
FROM s""")
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with the last answer of its neighbour (conv_id with
    the lowest bit turned)."""
    convs = chat.conversations(table(spark, sf_dir, "conversations"))
    out = chat.preference_pairs(convs, chat.with_swapped_answer(convs))

    def flat(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")

    return out.withColumns({c: flat(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards whose counts differ by one at most."""
    out = sharding.place_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op6_langid")
def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op7_decontam")
def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))


@query("op9_jaccard", """
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text,
                            regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE
         WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE ['?' || text] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE m / (x.n + y.n - m) >= 0.8),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS class_id,
       (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS links FROM documents d""")
def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies, and number of links, of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.classes(docs).select("doc_id", "class_id", "links")


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 200 bytes cover in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.without_repeats(docs, texts=False).drop("kept")


#: Vocabulary file of op11, by its name among the public tokenizers.
VOCABULARY = "word_bpe_49k.json"


@query("op11_tokens")
def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, through a cache that this query begins empty."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # white space only separates this vocabulary's tokens, and case is dropped
    tokenizer = tokens.load(public_tokenizers.path(VOCABULARY), fold_space=True, fold_case=True)
    return tokens.token_counts(docs, tokenizer, shared_dir(spark, "token-cache"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the four leading components."""
    return whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op13_negatives", """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
             AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
             list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM p WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM pos JOIN p USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""")
def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose vec_id is divisible by 50, some labels changed first."""
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.hard_negatives(vectors.filter("vec_id % 50 = 0"), vectors)
