"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings that are surely commoner in texts
labelled toxic, in three tiers.  Features of a text are lexicon counts and densities, lexicon words
near a second-person word, capitals, punctuation, obfuscated and drawn-out words.  Trees
and calibration are fitted on separate parts of a bounded sample; every text is scored whole.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studybank.llm.common import stored
from studybank.llm.langid import remainder

#: Labelled documents of each label that are learned from (the least hashes of doc_id).
SAMPLE = 8000
#: Lexicon entries.
LEXICON = 4000
#: Lower bounds of the log odds of the tiers.
TIERS = (1.0, 2.0, 3.0)
NEAR = 3
# FIXED VALUES: second-person words of the languages at hand.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur thou du dich dir dein deine deinen deinem ihr euch euer eure "
    "tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros vosotras os tuyo vuestro".split())
# FIXED VALUES: characters that stand for letters.
STANDS_FOR = str.maketrans("013457@$!", "oieastasi")
_EDGE = "\"'.,;:?()[]{}<>«»„“”‘’¡¿…-–—_*#&%/\\|~^`+="
_INNER = re.compile(r"[^\w]|_")
_LONG = re.compile(r"(.)\1\1")
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True

FEATURES = ("log_words", "hits", "strong", "density", "strong_density", "near_you", "capitals", "caps_words",
            "punctuation", "exclaim", "obfuscated", "drawn_out")


def _plain(token: str) -> tuple[str, bool]:
    """A token as a lexicon word, and whether it seems obfuscated."""
    w = token.lower().strip(_EDGE)
    if w.isalpha():
        return w, False
    w = w.strip("!")
    if not any(map(str.isalpha, w)):
        return "", False
    clear = _INNER.sub("", w.translate(STANDS_FOR))
    return clear, clear != w


def _forms(word: str) -> list[str]:
    """The word and its beginnings of 4 and 5 letters, marked by a star."""
    return [word] + [word[:n] + "*" for n in (4, 5) if len(word) >= n] if word else []


class _Codes(dict):
    """Token -> tier (2 bits), second person, obfuscated, capitals, drawn out; made when first met."""

    def __init__(self, lexicon: dict[str, int]):
        self.words = {f: t for f, t in lexicon.items() if f[-1] != "*"}
        self.four, self.five = ({f[:-1]: t for f, t in lexicon.items() if f[-1] == "*" and len(f) == n} for n in (5, 6))

    def __missing__(self, token: str) -> int:
        word, hidden = (token.lower(), False) if token.isalpha() else _plain(token)
        code = max(self.words.get(word, 0), self.four.get(word[:4], 0), self.five.get(word[:5], 0))
        if word in SECOND_PERSON:
            code |= 4
        code |= hidden << 3
        if token.isupper() and len(word) > 1:
            code |= 16
        if _LONG.search(token):
            code |= 32
        if len(self) > 400_000:
            self.clear()
        self[token] = code
        return code


def features(texts, lexicon: dict[str, int], codes: _Codes | None = None) -> np.ndarray:
    """One row of FEATURES for each text; null counts as empty."""
    codes = _Codes(lexicon) if codes is None else codes
    out = np.zeros((len(texts), len(FEATURES)))
    for r, text in enumerate(texts):
        text = text or ""
        tokens = text.split()
        n = len(tokens)
        if not n:
            continue
        c = np.fromiter(map(codes.__getitem__, tokens), dtype=np.uint8, count=n)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        size = np.bincount(raw, minlength=256)
        tier = c & 3
        hit, you = np.flatnonzero(tier), np.flatnonzero(c & 4)
        near = 0
        if len(hit) and len(you):
            i = np.searchsorted(you, hit)
            gap = np.minimum(np.abs(you[np.minimum(i, len(you) - 1)] - hit), np.abs(you[np.maximum(i - 1, 0)] - hit))
            near = int((gap <= NEAR).sum())
        strong = int((tier == 3).sum())
        letters = max(1, int(size[65:91].sum() + size[97:123].sum()))
        out[r] = (math.log1p(n), math.log1p(len(hit)), math.log1p(strong), len(hit) / n, strong / n,
                  math.log1p(near), size[65:91].sum() / letters, np.count_nonzero(c & 16) / n,
                  size[_PUNCT].sum() / len(raw), size[33] / len(raw), np.count_nonzero(c & 8) / n,
                  np.count_nonzero(c & 32) / n)
    return out


class Trees:
    """Boosted trees of fixed depth for the logistic loss, grown on binned features."""

    def __init__(self, depth: int = 3, rounds: int = 60, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.depth, self.rounds, self.rate, self.bins, self.ridge = depth, rounds, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(col, np.linspace(0, 1, self.bins + 1)[1:-1])) for col in x.T]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
        p = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
        self.base, self.trees = math.log(p / (1 - p)), []
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-margin))
            g, h = weight * (prob - y), weight * prob * (1 - prob)
            node, splits = np.zeros(len(y), dtype=np.int64), []
            for level in range(self.depth):
                width, best = 1 << level, [(0.0, 0, math.inf, self.bins)] * (1 << level)
                for f in range(x.shape[1]):
                    at = node * self.bins + np.minimum(binned[:, f], self.bins - 1)
                    gs = np.bincount(at, g, width * self.bins).reshape(width, -1).cumsum(axis=1)
                    hs = np.bincount(at, h, width * self.bins).reshape(width, -1).cumsum(axis=1)
                    ga, ha = gs[:, -1:], hs[:, -1:]
                    gain = (gs ** 2 / (hs + self.ridge) + (ga - gs) ** 2 / (ha - hs + self.ridge)
                            - ga ** 2 / (ha + self.ridge))
                    for k in range(width):
                        b = int(gain[k, :len(cuts[f])].argmax()) if len(cuts[f]) else 0
                        if len(cuts[f]) and gain[k, b] > best[k][0] + 1e-9:
                            best[k] = (gain[k, b], f, cuts[f][b], b)
                splits.append([(f, c) for _, f, c, _ in best])
                right = np.zeros(len(y), dtype=bool)
                for k, (_, f, _, b) in enumerate(best):
                    own = node == k
                    right[own] = binned[own, f] > b
                node = node * 2 + right
            leaf = -self.rate * np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.ridge)
            self.trees.append(([np.array([f for f, _ in s]) for s in splits], [np.array([c for _, c in s]) for s in splits], leaf))
            margin += leaf[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for fs, cs, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for f, c in zip(fs, cs):
                node = node * 2 + (x[rows, f[node]] > c[node])
            out += leaf[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: (margin, probability) points to interpolate between."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, least and greatest margin
    for m, v, w in zip(margin[order], y[order], weight[order]):
        blocks.append([float(v), float(w), float(m), float(m)])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
    xs = [x for b in blocks for x in b[2:]]
    return np.array(xs), np.array([b[0] for b in blocks for _ in range(2)])


class Model:
    """Lexicon, trees and calibration; without both labels, a constant."""

    def __init__(self, lexicon=None, trees=None, points=None, constant=0.0):
        self.lexicon, self.trees, self.points, self.constant = lexicon or {}, trees, points, constant

    def scores(self, texts, codes=None) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        return np.interp(self.trees.margin(features(texts, self.lexicon, codes)), *self.points)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1).

    At most ``sample`` labelled ids of each label are used, weighted to the labels' true shares.
    85 % of them (by hash) give lexicon and trees, in two parts that lend each other the lexicon while trees
    grow; 15 % give the calibration.  Null labels and ids are left out; an id with both labels counts once
    for each.  Of documents with one id the least text is read, so no more than 2 * ``sample`` rows are.
    Too few labels of one kind give a constant score, their share."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").select(
        "doc_id", "toxic", F.xxhash64("doc_id", F.lit("toxic")).alias("h")).distinct()
    count = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(count) < 2:
        return Model(constant=float(next(iter(count), 0)))
    # at most 2 * sample rows; the hash leaves about half as many again to each sort
    picked = None
    for y in (0, 1):
        near = F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, (1.5 * sample + 100) / count[y]))
        part = known.filter((F.col("toxic") == y) & near).orderBy("h", "doc_id").limit(sample)
        picked = part if picked is None else picked.union(part)
    part = F.pmod("h", F.lit(20))
    texts = stored(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic", "h")
                   .agg(F.min("text").alias("text")).select(
        "toxic", "text", F.when(part < 9, 0).when(part < 17, 1).otherwise(2).alias("part")), "toxic-sample")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[tuple, Counter] = {}
            for t, y, k in zip(b["text"], b["toxic"], b["part"]):
                c = seen.setdefault((y, k), Counter())
                c.update({f for w in {_plain(x)[0] for x in set((t or "").split())} for f in _forms(w)})
                c.update([""])  # documents
            for (y, k), c in seen.items():
                yield pd.DataFrame({"form": list(c), "toxic": y, "part": k, "n": list(c.values())})

    def total(y, k):
        return F.sum(F.when((F.col("toxic") == y) & (F.col("part") == k), F.col("n")).otherwise(0))

    forms = stored(texts.filter("part < 2").mapInPandas(spread, "form string, toxic int, part int, n long")
                   .groupBy("form").agg(total(1, 0).alias("p0"), total(1, 1).alias("p1"),
                                        total(0, 0).alias("q0"), total(0, 1).alias("q1")), "toxic-forms")
    whole = forms.filter("form = ''").first()
    constant = Model(constant=count[1] / (count[0] + count[1]))
    if whole is None or min(whole["p0"], whole["p1"], whole["q0"], whole["q1"]) == 0:
        return constant

    def lexicon(parts: str) -> dict[str, int]:
        p, q = (sum((F.col(c + k) for k in parts), F.lit(0)) for c in "pq")
        n, m = (sum(whole[c + k] for k in parts) for c in "pq")
        odds = F.log((p + 0.5) / (n + 1)) - F.log((q + 0.5) / (m + 1))
        sure = odds - 2.5 * F.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
        rows = (forms.filter("form <> ''").filter(p > 2).withColumn("s", sure).filter(F.col("s") > TIERS[0])
                .orderBy(F.desc("s"), "form").limit(LEXICON).collect())
        return {r["form"]: sum(r["s"] > t for t in TIERS) for r in rows}

    # the features that trees are grown on come from the lexicon of the other part
    both = lexicon("01")
    lexicons = [lexicon("1"), lexicon("0"), both]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = [_Codes(x) for x in lexicons]
        for b in batches:
            yield pd.DataFrame({"part": b["part"], "toxic": b["toxic"], "x": [
                features([t], lexicons[k], codes[k])[0] for t, k in zip(b["text"], b["part"])]})

    # at most 2 * sample rows of a dozen numbers
    got = texts.mapInPandas(measure, "part int, toxic int, x array<double>").toPandas()
    # the order rows come in must not matter
    got = got.assign(key=[tuple(x) for x in got["x"]]).sort_values(["part", "toxic", "key"])
    x, y = np.array(got["x"].tolist()).reshape(-1, len(FEATURES)), got["toxic"].to_numpy(float)
    last = got["part"].to_numpy() == 2
    if any(len(set(y[k])) < 2 for k in (last, ~last)):
        return constant
    weight = np.where(y == 1, count[1] / max(1, (y == 1).sum()), count[0] / max(1, (y == 0).sum()))
    weight = weight / weight.mean()
    trees = Trees().fit(x[~last], y[~last], weight[~last])
    return Model(both, trees, isotonic(trees.margin(x[last]), y[last], weight[last]))


def scorer(model: Model):
    """A column function: text -> calibrated score (null and empty texts too)."""
    packed = pickle.dumps(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = pickle.loads(packed)
        codes = _Codes(m.lexicon)
        for t in texts:
            yield pd.Series(m.scores(list(t), codes))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """``docs`` (doc_id, text and others) with held_out, score and predicted (1 from 0.5 on).

    Only labels of ids that aren't held out are learned from.  Null and empty texts have a score like others;
    repeated rows are scored each, alike; an empty table stays empty.  Columns of the input named like a new one are
    replaced."""
    out = remainder(F.col("doc_id"), folds) == held
    model = learn(docs, labels.filter(~out))
    docs = docs.drop("held_out", "score", "predicted")
    scored = docs.withColumn("held_out", out).withColumn("score", scorer(model)("text"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
