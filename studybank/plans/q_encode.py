"""Registered embedding, pooling, projection and image queries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studybank.constants import IMAGE_MEAN, IMAGE_STD
from studybank.operators import encode as E
from studybank.operators import images as I
from studybank.operators.text import pad_tokens, word_tokens
from studybank.plans import bindings as B
from studybank.plans.registry import register
from studybank.session import shared_dir
from studybank.sources import readers as R
from studybank.sources import writers as W

TEXT_DIM = 32


def _round_arr(c, d=9):
    return F.transform(c, lambda x: F.round(x, d))


@register("embed_text", f"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'),
                                      lambda w: w <> '') AS tk FROM documents),
g AS (SELECT doc_id, unnest(tk) AS gram FROM t
      UNION ALL SELECT doc_id, unnest(list_transform(range(greatest(len(tk) - 1, 0)),
                                                     lambda i: tk[i + 1] || ' ' || tk[i + 2])) FROM t),
c AS (SELECT doc_id, CAST('0x' || substr(md5(gram), 1, 8) AS BIGINT) % {TEXT_DIM} AS b, count(*) AS n
      FROM g GROUP BY ALL),
z AS (SELECT doc_id, sqrt(sum(n * n)) AS nz FROM c GROUP BY doc_id),
grid AS (SELECT t.doc_id, r.b FROM t, range({TEXT_DIM}) r(b)),
v AS (SELECT grid.doc_id, grid.b, coalesce(c.n / z.nz, 0.0) AS x
      FROM grid LEFT JOIN c ON c.doc_id = grid.doc_id AND c.b = grid.b LEFT JOIN z ON z.doc_id = grid.doc_id)
SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id, list(round(x, 9) ORDER BY b) AS embs FROM v GROUP BY doc_id
""")
def q_embed_text(spark, sf_dir):
    enc = E.HashedNgramEncoder(dim=TEXT_DIM)
    out = E.embed(B.reports(spark, sf_dir), enc, "report", ["study_id"], precision="double")
    return out.select("study_id", _round_arr(F.col("embs")).alias("embs"))


MODEL_CONFIG = {"models": [
    {"model_path": "baseline-a", "image_encoder": "grid-means", "text_encoder": "hashed-ngrams",
     "add_projection": False, "embed_dim": 16},
    {"model_path": "baseline-b", "image_encoder": "grid-means", "text_encoder": "hashed-ngrams",
     "add_projection": True, "embed_dim": 32}]}
#: Widths of the bundled encoders, which the second model projects.
SIDES = {"text": 64, "image": 48}


def write_model_config(spark) -> str:
    """The config as a JSON file, and a folder of projection weights for each model that asks for one.

    Weights are a fixed rule: W[j][i] = sin(i + 1) * cos(j + 1), b[j] = j / 10."""
    import json
    root = shared_dir(spark, "model_config")
    models = [m | {"model_path": f"{root}/{m['model_path']}"} for m in MODEL_CONFIG["models"]]
    for m in models:
        if m["add_projection"]:
            width = F.when(F.col("side") == "text", SIDES["text"]).otherwise(SIDES["image"])
            rows = spark.range(m["embed_dim"]).select(F.explode(F.array(F.lit("text"), F.lit("image"))).alias("side"),
                                                      F.col("id").cast("int").alias("row"))
            (rows.withColumn("weights", F.transform(F.sequence(F.lit(1), width), lambda i: F.sin(i) * F.cos(F.col("row") + 1)))
             .withColumn("bias", F.col("row") / 10.0).write.mode("overwrite").parquet(m["model_path"]))
    spark.createDataFrame([(json.dumps({"models": models}),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{root}/config")
    return f"{root}/config"


@register("multi_model_embed", """
SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id, c AS "case", 'text' AS embed_type, d AS dim
FROM documents, (VALUES ('out_grihas_16', 16), ('out_grihas_32', 32)) AS t(c, d)
""")
def q_multi_model(spark, sf_dir):
    """Every model of a JSON config (read with the config reader) embeds the
    reports in one pass, keyed by ``case``."""
    configs = R.read_model_config(spark, write_model_config(spark))
    return E.embed_config(configs, texts=B.reports(spark, sf_dir)).select("study_id", "case", "embed_type",
                                                                          F.size("embs").alias("dim"))


def _vector_sql(ident: str, values: str) -> str:
    """Vectors of both models from a table (ident, values): normalised as they are, and projected first."""
    unit = "list_transform(p, lambda y: round(CASE WHEN sqrt(list_dot_product(p, p)) > 0 THEN y / sqrt(list_dot_product(p, p)) ELSE 0.0 END, 6))"
    return f"""
SELECT {ident}, c AS "case", {unit} AS embs FROM (
  SELECT {ident}, 'out_grihas_16' AS c, plain AS p FROM {values}
  UNION ALL
  SELECT {ident}, 'out_grihas_32', list_transform(range(32), lambda j: list_dot_product(wide,
         list_transform(range(len(wide)), lambda i: sin(i + 1) * cos(j + 1))) + j / 10.0) FROM {values})
"""


@register("multi_model_texts", f"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'),
                                      lambda w: w <> '') AS tk FROM documents),
g AS (SELECT doc_id, unnest(tk) AS gram FROM t
      UNION ALL SELECT doc_id, unnest(list_transform(range(greatest(len(tk) - 1, 0)),
                                                     lambda i: tk[i + 1] || ' ' || tk[i + 2])) FROM t),
h AS (SELECT doc_id, CAST('0x' || substr(md5(gram), 1, 8) AS BIGINT) AS h, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT doc_id, 16 AS width, h % 16 AS b, sum(n) AS n FROM h GROUP BY ALL
      UNION ALL SELECT doc_id, 64, h % 64, sum(n) FROM h GROUP BY ALL),
grid AS (SELECT t.doc_id, w.width, r.b FROM t, (VALUES (16), (64)) w(width), range(64) r(b) WHERE r.b < w.width),
v AS (SELECT grid.doc_id, grid.width, list(CAST(coalesce(c.n, 0) AS DOUBLE) ORDER BY grid.b) AS x
      FROM grid LEFT JOIN c ON c.doc_id = grid.doc_id AND c.width = grid.width AND c.b = grid.b GROUP BY ALL),
sides AS (SELECT 's' || CAST(a.doc_id AS VARCHAR) AS study_id, a.x AS plain, b.x AS wide FROM v a JOIN v b ON a.doc_id = b.doc_id
         WHERE a.width = 16 AND b.width = 64)
{_vector_sql('study_id', 'sides')}
""")
def q_multi_model_texts(spark, sf_dir):
    """The text vectors of both models, one of them projected."""
    configs = R.read_model_config(spark, write_model_config(spark))
    out = E.embed_config(configs, texts=B.reports(spark, sf_dir), precision="double")
    return out.select("study_id", "case", _round_arr(F.col("embs"), 6).alias("embs"))


def _tokens(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    t = d.select("doc_id", F.floor(F.col("doc_id") / 32).cast("int").alias("batch_id"),
                 F.transform(word_tokens(F.col("text")), lambda w: F.length(w)).alias("input_ids"))
    return pad_tokens(t, "input_ids", "batch_id")


@register("masked_mean_pool", """
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')[1:128]
                  AS tk FROM documents),
u AS (SELECT doc_id, length(unnest(tk)) AS tid FROM t),
n AS (SELECT doc_id, count(*) AS cnt FROM u GROUP BY doc_id),
e AS (SELECT vec_id, unnest(range(len(embedding))) AS d, unnest(embedding) AS x FROM embeddings),
s AS (SELECT u.doc_id, e.d, sum(CAST(e.x AS DOUBLE)) AS sx FROM u JOIN e ON e.vec_id = u.tid GROUP BY ALL),
p AS (SELECT s.doc_id, list(round(sx / greatest(CAST(n.cnt AS DOUBLE), 1e-9), 9) ORDER BY d) AS pooled
      FROM s JOIN n ON n.doc_id = s.doc_id GROUP BY s.doc_id)
SELECT t.doc_id, coalesce(p.pooled, list_transform(range(64), lambda i: 0.0)) AS pooled
FROM t LEFT JOIN p ON p.doc_id = t.doc_id
""")
def q_pool(spark, sf_dir):
    """Token ids (word lengths) pooled over a vocabulary table (the vectors,
    keyed by ``vec_id``)."""
    vocab = B.vectors(spark, sf_dir).select(F.col("vec_id").alias("token_id"),
                                            F.col("embedding").alias("vector"))
    out = E.masked_mean_pool(_tokens(spark, sf_dir), vocab, "doc_id")
    return out.select("doc_id", _round_arr(F.col("pooled")).alias("pooled"))


PROJ_OUT, PROJ_IN = 8, 64


def projection_weights():
    """A fixed parameter rule: W[j][i] = sin(i + 1) * cos(j + 1), b[j] = j / 10."""
    w = np.array([[math.sin(i + 1) * math.cos(j + 1) for i in range(PROJ_IN)] for j in range(PROJ_OUT)])
    return w, np.arange(PROJ_OUT) / 10.0


@register("linear_project", f"""
SELECT vec_id, list_transform(range({PROJ_OUT}), lambda j:
         round(list_dot_product(CAST(embedding AS DOUBLE[]),
                                list_transform(range({PROJ_IN}), lambda i: sin(i + 1) * cos(j + 1))) + j / 10.0, 9))
       AS projected
FROM embeddings
""")
def q_project(spark, sf_dir):
    w, b = projection_weights()
    out = E.project(B.vectors(spark, sf_dir).select("vec_id", "embedding"), "embedding", w, b)
    return out.select("vec_id", _round_arr(F.col("projected")).alias("projected"))


# ----------------------------------------------------------------------------
# images: every vector becomes an 8 x 8 picture (grey for even labels, colour
# for odd ones) written under <shared>/pNN/s<vec_id>/<vec_id>.png
# ----------------------------------------------------------------------------
@F.pandas_udf(T.BinaryType())
def _vector_png(vec: pd.Series, label: pd.Series) -> pd.Series:
    out = []
    for v, lab in zip(vec, label):
        x = np.asarray(v, dtype=np.float64)
        span = x.max() - x.min()
        g = np.zeros(64) if span == 0 else (x - x.min()) / span * 255
        g = np.rint(g).astype(np.uint8).reshape(8, 8)
        px = g if (lab or 0) % 2 == 0 else np.stack([g, g[::-1], 255 - g], axis=2)
        out.append(I.png_bytes(px))
    return pd.Series(out)


def write_vector_images(spark, sf_dir) -> str:
    root = shared_dir(spark, "images")
    v = B.vectors(spark, sf_dir)
    path = F.concat(F.lit(root + "/p"), F.floor(F.col("vec_id") / 100).cast("string"),
                    F.lit("/s"), F.col("vec_id").cast("string"), F.lit("/"),
                    F.col("vec_id").cast("string"), F.lit(".png"))
    W.materialise(W.write_files(v.select(path.alias("path"),
                                         _vector_png("embedding", "label").alias("data"))))
    return root


def _images(spark, sf_dir):
    return R.read_images(spark, write_vector_images(spark, sf_dir), mode="drop")


def _sid(c="path"):
    """Study key of an image: its parent folder (paths hold a run-specific root)."""
    from studybank.functions.text import parent_stem
    return parent_stem(F.col(c)).alias("study_id")


@register("src_image_listing", """
SELECT 's' || CAST(vec_id AS VARCHAR) AS study_id, CAST(vec_id AS VARCHAR) AS file FROM embeddings
""")
def q_image_listing(spark, sf_dir):
    from studybank.functions.text import file_stem
    lst = R.list_images(spark, write_vector_images(spark, sf_dir), "png", "study")
    return lst.select("study_id", file_stem(F.col("path")).alias("file"))


@register("image_error_policy", """
SELECT CASE WHEN coalesce(label, 0) % 2 = 0 THEN 1 ELSE 3 END AS "nChannels", count(*) AS images
FROM embeddings GROUP BY ALL
""")
def q_image_policy(spark, sf_dir):
    """Decodable images per channel count (unreadable files are dropped)."""
    return _images(spark, sf_dir).groupBy("nChannels").agg(F.count(F.lit(1)).alias("images"))


@register("image_to_rgb", """
SELECT 's' || CAST(vec_id AS VARCHAR) AS study_id, 8 AS height, 8 AS width, 3 AS "nChannels", 192 AS bytes
FROM embeddings
""")
def q_to_rgb(spark, sf_dir):
    rgb = I.to_rgb(_images(spark, sf_dir))
    return rgb.select(_sid(), "height", "width", "nChannels", F.length("data").alias("bytes"))


@register("resize_shorter_side", """
SELECT 's' || CAST(vec_id AS VARCHAR) AS study_id, 32 AS height, 32 AS width, 3072 AS bytes FROM embeddings
""")
def q_resize(spark, sf_dir):
    out = I.resize(I.to_rgb(_images(spark, sf_dir)), 32)
    return out.select(_sid(), "height", "width", F.length("data").alias("bytes"))


@register("random_crop_box", """
WITH u AS (SELECT 's' || CAST(vec_id AS VARCHAR) AS study_id,
                  CAST('0x' || substr(md5('42:s' || CAST(vec_id AS VARCHAR) || ':s'), 1, 8) AS BIGINT) / 4294967296.0 AS us,
                  CAST('0x' || substr(md5('42:s' || CAST(vec_id AS VARCHAR) || ':x'), 1, 8) AS BIGINT) / 4294967296.0 AS ux,
                  CAST('0x' || substr(md5('42:s' || CAST(vec_id AS VARCHAR) || ':y'), 1, 8) AS BIGINT) / 4294967296.0 AS uy
           FROM embeddings),
b AS (SELECT *, CAST(least(32, greatest(1, floor(sqrt((0.75 + (1.0 - 0.75) * us) * 32 * 32)))) AS INTEGER) AS side FROM u)
SELECT study_id, 32 AS height, 32 AS width, CAST(floor(ux * (32 - side + 1)) AS INTEGER) AS box_x,
       CAST(floor(uy * (32 - side + 1)) AS INTEGER) AS box_y, side AS box_side FROM b
""")
def q_crop(spark, sf_dir):
    imgs = I.resize(I.to_rgb(_images(spark, sf_dir)), 32).withColumn("study_id", _sid())
    out = I.crop_boxes(imgs, seed=42, mode="random", key="study_id")
    return out.select("study_id", "height", "width", "box_x", "box_y", "box_side")


@register("tensor_normalise")
def q_tensor(spark, sf_dir):
    out = I.to_tensor(I.crop_boxes(I.resize(I.to_rgb(_images(spark, sf_dir)), 32), mode="center"),
                      size=16)
    return out.select("path", F.size("tensor").alias("n"), F.round(F.array_max("tensor"), 4).alias("mx"))


@register("embed_image", """
SELECT 's' || CAST(vec_id AS VARCHAR) AS study_id, 12 AS dim FROM embeddings
""")
def q_embed_image(spark, sf_dir):
    imgs = I.to_rgb(_images(spark, sf_dir)).withColumn("image", I.image_struct(None)) \
        .withColumn("study_id", _sid())
    return E.embed(imgs, E.GridMeanEncoder(grid=2), "image", ["study_id"]).select(
        "study_id", F.size("embs").alias("dim"))


#: Pixels of the pictures of ``write_vector_images``, as (row, column, channel) lists in RGB order.
PIXELS_SQL = """
e AS (SELECT vec_id, coalesce(label, 0) % 2 = 0 AS grey, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
s AS (SELECT *, list_min(x) AS lo, list_max(x) - list_min(x) AS span FROM e),
g AS (SELECT vec_id, grey, list_transform(x, lambda y: CASE WHEN span = 0 THEN 0.0 ELSE round_even((y - lo) / span * 255, 0) END) AS g FROM s),
px AS (SELECT 's' || CAST(vec_id AS VARCHAR) AS study_id, g AS red,
              CASE WHEN grey THEN g ELSE list_transform(range(64), lambda i: g[(7 - i // 8) * 8 + i % 8 + 1]) END AS green,
              CASE WHEN grey THEN g ELSE list_transform(g, lambda y: 255 - y) END AS blue FROM g)
"""


@register("image_pixels", f"""
WITH {PIXELS_SQL}
SELECT study_id, CAST(list_sum(red) AS BIGINT) AS red, CAST(list_sum(green) AS BIGINT) AS green, CAST(list_sum(blue) AS BIGINT) AS blue,
       CAST(list_sum(list_transform(range(64), lambda i: (i + 1) * (red[i + 1] + 2 * green[i + 1] + 3 * blue[i + 1]))) AS BIGINT) AS placed
FROM px
""")
def q_image_pixels(spark, sf_dir):
    """Sums of each channel after the decoder and the RGB step, and a sum that depends on every pixel's place."""
    rgb = I.to_rgb(_images(spark, sf_dir))
    values = rgb.withColumn("hex", F.hex("data")).withColumn("at", F.expr("sequence(0, 191)")).select(
        _sid(), F.transform("at", lambda i: F.conv(F.substring("hex", i * 2 + 1, F.lit(2)), 16, 10).cast("long")).alias("v"))

    def total(weight):
        return F.aggregate(F.expr("sequence(0, 191)"), F.lit(0).cast("long"),
                           lambda acc, i: acc + (F.get("v", i) * weight(i)).cast("long"))

    def channel(c):
        return total(lambda i: F.when(i % 3 == c, 1).otherwise(0))

    return values.select("study_id", channel(0).alias("red"), channel(1).alias("green"), channel(2).alias("blue"),
                         total(lambda i: (F.floor(i / 3) + 1) * (i % 3 + 1)).alias("placed"))


@register("image_tensors", f"""
WITH {PIXELS_SQL}
SELECT study_id, 192 AS n, [CAST(list_sum(red) AS BIGINT), CAST(list_sum(green) AS BIGINT), CAST(list_sum(blue) AS BIGINT)] AS sums FROM px
""")
def q_image_tensors(spark, sf_dir):
    """The normalised tensors of whole pictures in their own size, each channel's mean taken back to its sum of pixels."""
    out = I.to_tensor(I.crop_boxes(I.to_rgb(_images(spark, sf_dir)), mode="center"), size=8)

    def pixels(c):
        part = F.slice("tensor", 64 * c + 1, 64)
        total = F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
        return F.round((total * IMAGE_STD[c] + 64 * IMAGE_MEAN[c]) * 255).cast("long")

    return out.select(_sid(), F.size("tensor").alias("n"), F.array(*[pixels(c) for c in range(3)]).alias("sums"))


@register("multi_model_images", f"""
WITH {PIXELS_SQL},
m AS (SELECT study_id, flatten(list_transform(range(16), lambda k: list_transform([red, green, blue], lambda ch:
        list_avg(list_transform(range(4), lambda p: ch[((k // 4) * 2 + p // 2) * 8 + (k % 4) * 2 + p % 2 + 1]))))) AS wide FROM px),
sides AS (SELECT study_id, wide AS plain, wide FROM m)
{_vector_sql('study_id', 'sides')}
""")
def q_multi_model_images(spark, sf_dir):
    """The image vectors of both models, one of them projected."""
    configs = R.read_model_config(spark, write_model_config(spark))
    images = I.to_rgb(_images(spark, sf_dir)).withColumn("image", I.image_struct(None)).withColumn("study_id", _sid())
    out = E.embed_config(configs, images=images, precision="double")
    return out.select("study_id", "case", _round_arr(F.col("embs"), 6).alias("embs"))


@register("sink_images", """
SELECT 's' || CAST(vec_id AS VARCHAR) AS study_id, 16 AS height, 16 AS width, 3 AS "nChannels" FROM embeddings
""")
def q_sink_images(spark, sf_dir):
    out = shared_dir(spark, "images_resized")
    W.write_images(I.resize(I.to_rgb(_images(spark, sf_dir)), 16), out)
    return spark.read.parquet(out).select(_sid(), "height", "width", "nChannels")
