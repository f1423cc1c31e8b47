"""Each stage of the pipeline against plain Python: features and trees walked one by one, shingle sets, full alignment,
sorted virtual times, a walk round the ring."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from studybank.llm import common, decontam, mixing, sharding, toxicity
from studybank.session import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, md5 string, place int"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def sf(spark):
    """A folder of documents, labels and benchmark: toxic texts, near copies, test items, nulls, repeated rows, clashing names."""
    common.prepare(spark)
    rng = random.Random(31)
    rude = ["scum", "vermin", "filth", "loser", "idiot"]
    texts, toxic = [], []
    for i in range(160):
        text = words(rng, rng.randint(8, 60)).split()
        if i % 4 == 0:
            for _ in range(max(2, len(text) // 5)):
                text.insert(rng.randrange(len(text)), rng.choice(rude))
            text.insert(0, "YOU")
        texts.append(" ".join(text))
        toxic.append(int(i % 4 == 0))
    items = [words(rng, 25) for _ in range(3)] + ["four words of test", None, ""]
    base = [words(rng, 50).split() for _ in range(4)]
    for b in base:
        for j in range(6):
            own = list(b)
            own[rng.randrange(len(own))] = "edit" + str(j)
            texts.append(" ".join(own))
    w = items[1].split()
    texts += [words(rng, 30) + " " + items[0], " ".join(w[:9] + ["new"] + w[10:]), "so " + items[3] + " it is", None, "", "  ", None, texts[1], texts[1],
              words(rng, 3000)]
    rows = [(i, t, "en", ["a", "b", None][i % 3], 0, "x", 3) for i, t in enumerate(texts)]
    rows += [(1, texts[1], "en", "b", 0, "x", 3), (None, texts[2], None, "c", None, None, None), (None, "only here " + texts[3], "en", "c", 0, "x", 3)]
    path = shared_dir(spark, "sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, t) for i, t in enumerate(toxic)] + [(5, None, None), (None, 1, 1), (3, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input and output of every stage."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.stored(stage(spark, out[-1], sf), "test-stage"))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain_features(text, lexicon):
    """The dense features, token by token."""
    tokens = (text or "").split()
    if not tokens:
        return [0.0] * len(toxicity.FEATURES)
    hits, strong, you, capital, hidden, drawn = [], 0, [], 0, 0, 0
    for at, token in enumerate(tokens):
        word, odd = toxicity._plain(token)
        tier = max([lexicon.get(f, 0) for f in toxicity._forms(word)], default=0)
        hits += [at] if tier else []
        strong += tier == 3
        you += [at] if word in toxicity.SECOND_PERSON else []
        capital += token.isupper() and len(word) > 1
        hidden += odd
        drawn += any(token[i] == token[i + 1] == token[i + 2] for i in range(len(token) - 2))
    near = sum(any(abs(h - y) <= toxicity.NEAR for y in you) for h in hits)
    raw, n = text.encode(), len(tokens)
    letters = [c for c in text if c.isascii() and c.isalpha()]
    return [math.log1p(n), math.log1p(len(hits)), math.log1p(strong), len(hits) / n, strong / n, math.log1p(near),
            sum(c.isupper() for c in letters) / max(1, len(letters)), capital / n,
            sum(33 <= c < 127 and not chr(c).isalnum() for c in raw) / len(raw), raw.count(b"!") / len(raw), hidden / n, drawn / n]


def plain_score(model, text):
    if model.trees is None:
        return model.constant
    x, margin = plain_features(text, model.lexicon), model.trees.base
    for features, cuts, leaf in model.trees.trees:
        node = 0
        for f, c in zip(features, cuts):
            node = 2 * node + (x[f[node]] > c[node])
        margin += leaf[node]
    return float(np.interp(margin, *model.points))


def test_toxicity(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learn(stages[0], labels.filter(toxicity.remainder(F.col("doc_id"), 5) != 0))
    assert model.trees is not None and len(model.lexicon) > 5
    kept = [r for r in rows(stages[0]) if plain_score(model, r[1]) < 0.5]
    assert rows(stages[1]) == kept and 0 < len(kept) < stages[0].count()


def test_trees_take_the_best_split():
    rng = np.random.default_rng(4)
    x, y, w = rng.normal(size=(60, 3)), rng.integers(0, 2, 60).astype(float), rng.uniform(0.5, 2, 60)
    trees = toxicity.Trees(depth=1, rounds=1).fit(x, y, w)
    p = np.average(y, weights=w)
    g, h = w * (p - y), np.full(60, p * (1 - p)) * w

    def gain(mask):
        return sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (mask, ~mask))

    (features, cuts, leaf), = trees.trees
    chosen = gain(x[:, features[0][0]] <= cuts[0][0])
    assert chosen == pytest.approx(max(gain(x[:, f] <= c) for f in range(3) for c in np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])))
    for side, mask in enumerate((x[:, features[0][0]] <= cuts[0][0], x[:, features[0][0]] > cuts[0][0])):
        assert leaf[side] == pytest.approx(-0.2 * g[mask].sum() / (h[mask].sum() + 1))


def test_near_copies(stages):
    docs = rows(stages[1])

    def shingles(t):
        w = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [("?", t or "")])

    sets = [shingles(r[1]) for r in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    best = {}
    for r, d in zip(root, docs):
        key = (d[0] is None, d[0] if d[0] is not None else 0, hashlib.md5((d[1] or "").encode()).hexdigest())
        if r not in best or key < best[r][0]:
            best[r] = (key, d)
    assert rows(stages[2]) == sorted((d for _, d in best.values()), key=str) and len(best) < len(docs)


def test_decontamination(spark, sf, stages):
    items = [i.split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (i := (r.text or "").lower())]

    def best(a, b):
        top, before = 0, [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(max(0, before[j] + (2 if x == y else -1), before[j + 1] - 1, row[j] - 1))
            before, top = row, max(top, *row)
        return top

    def holds(text, item):
        w = (text or "").lower().split()
        if len(item) < decontam.MIN_WORDS:
            return any(w[i:i + len(item)] == item for i in range(len(w) - len(item) + 1))
        return best(item, w) >= decontam.THRESHOLD * 2 * len(item)

    kept = [r for r in rows(stages[2]) if not any(holds(r[1], i) for i in items)]
    assert rows(stages[3]) == kept and len(kept) == stages[2].count() - 3


def test_mixing(stages):
    docs = rows(stages[3])

    def key(r):
        return hashlib.md5(f"7:{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()

    sizes, at = Counter(), {}
    for r in docs:
        n = len((r[1] or "").split())
        sizes[r[3]] += n
        at[r[3], key(r)] = at.get((r[3], key(r)), 0) + n
    goal = mixing.targets(dict(sizes))
    order = {s: i for i, s in enumerate(goal)}
    times, run = [], Counter()
    for (s, k), n in sorted(at.items(), key=lambda x: (order[x[0][0]], x[0][1])):
        run[s] += n
        times += [((e * sizes[s] + run[s]) / goal[s], order[s], k, e, n, s) for e in range(3) if n]
    taken, given = Counter(), 0
    for v, _, k, e, n, s in sorted(times):
        given += n
        if given > sum(sizes.values()):
            break
        taken[s, k] += 1
    expected = [r for r in docs for _ in range(taken[r[3], key(r)])]
    assert rows(stages[4]) == sorted(expected, key=str) and expected


def test_sharding(spark, stages):
    shards = corpus_pipeline.SHARDS
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).cast("long")
    keyed = stages[4].select("doc_id", size.alias("size"), crc.alias("crc"), "text").withColumn("h", F.xxhash64("doc_id", "size", "crc")).collect()
    assert all(r.crc == zlib.crc32((r.text or "").encode()) and r.size == len((r.text or "").encode()) + 16 for r in keyed)
    nodes = sharding.ring(spark, shards)
    room = [len(keyed) // shards + (s < len(keyed) % shards) for s in range(shards)]
    used, expected = [0] * shards, []
    order = sorted(keyed, key=lambda r: (r.h % sharding.SLOTS, r.h, -1 if r.doc_id is None else r.doc_id, r.size, r.crc))
    for r in order:
        i = next((i for i, (place, _) in enumerate(nodes) if place >= r.h % sharding.SLOTS), 0)
        while used[nodes[i][1]] == room[nodes[i][1]]:
            i = (i + 1) % len(nodes)
        s = nodes[i][1]
        expected.append((r.doc_id, r.size, r.crc, s, used[s]))
        used[s] += 1
    assert rows(stages[5].select("doc_id", "size", "text_crc32", "shard", "slot")) == sorted(expected, key=str)


def test_stages_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_growing_by_one_shard_moves_few_rows(spark):
    """From 40 to 41 shards: near a fortieth must move, and the bounds add what displaced rows they hold."""
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    a, b = (sharding.place_documents(docs, n).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (40, 41))
    moved = a.join(b, "doc_id").filter("s40 <> s41").count() / 40_000
    assert moved < 0.25
