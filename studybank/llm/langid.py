"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, in every slot, one bit per language.  The bitwise and of an
n-gram's slots gives all languages that (seem to) contain it at once.  A text's n-grams
are counted per language, each count is corrected for the filter's false positives, and the
language with the largest share decides.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studybank.llm.common import distinct

#: Training documents of one language; n-grams kept for a language; lengths of n-grams.
SAMPLE, KEPT, SIZES = 1000, 10_000, (3, 4)
#: N-grams up to which a filter is filled with those of one document.
LEAST = 1000
MAX_LANGUAGES = 64
#: Slots of the filter; each n-gram has two.
SLOTS, PROBES = 1 << 18, 2
#: Characters looked at in one go.
SLICE = 1 << 17
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000) if not 0xD800 <= i < 0xE000),
                              dtype=bool, count=0x110000 - 0x800)
        _LETTER = np.concatenate([_LETTER[:0xD800], np.zeros(0x800, bool), _LETTER[0xD800:]])
    return _LETTER


def _codes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of some texts, and where they are parted.

    Each run of other characters is one space, and one space parts a text from the next; text
    i lies between the spaces at i and i + 1 of the second array."""
    low = [(t or "").lower() for t in texts]
    raw = (" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(raw, dtype=np.uint32)
    letter = _letters()[c]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    place = np.cumsum([0] + [len(t) + 1 for t in low])
    # the parting space itself, or the one that it has become part of
    at = np.cumsum(keep, dtype=np.int64)[place] - 1
    out = np.where(letter, c, np.uint32(32))[keep]
    return out, at


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters from every place on (n-1 fewer than codes)."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint32)
    with np.errstate(over="ignore"):
        h = codes[:m] + np.uint32(n << 24)
        for i in range(1, n):
            h *= np.uint32(0x01000193)
            h ^= codes[i:i + m]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        h *= np.uint32(0x297A2D39)
        return h


def _slots(h: np.ndarray, slots: int) -> list[np.ndarray]:
    shift = np.uint32(32 - (int(slots).bit_length() - 1))
    with np.errstate(over="ignore"):
        return [(h * np.uint32(odd)) >> shift for odd in (1, 0x9E3779B1)]


class Filters:
    """Bit-sliced filters of several languages, with each one's false-positive rate."""

    def __init__(self, grams: dict[str, np.ndarray], slots: int = SLOTS):
        self.languages = sorted(grams)
        self.slots = slots
        width = next(w for w in (8, 16, 32, 64) if w >= len(self.languages))
        self.masks = np.zeros(slots, dtype=f"uint{width}")
        self.false = np.zeros(len(self.languages))
        for i, lang in enumerate(self.languages):
            bit = np.zeros(slots, dtype=bool)
            for at in _slots(grams[lang], slots):
                bit[at] = True
            self.masks[bit] |= self.masks.dtype.type(1 << i)
            self.false[i] = bit.mean() ** PROBES

    def containing(self, h: np.ndarray) -> np.ndarray:
        """Bit mask of the languages that contain each n-gram."""
        out = None
        for at in _slots(h, self.slots):
            got = self.masks[at]
            out = got if out is None else out & got
        return out

    def shares(self, texts) -> np.ndarray:
        """Corrected share of each text's n-grams that each language contains."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        first, size = 0, 0
        for d, t in enumerate(texts):
            size += len(t or "")
            if size >= SLICE or d == len(texts) - 1:
                self._count(texts[first:d + 1], hits[first:d + 1], total[first:d + 1])
                first, size = d + 1, 0
        share = (hits / np.maximum(total, 1)[:, None] - self.false) / (1 - self.false)
        return np.clip(share, 0, 1)

    def _count(self, texts, hits: np.ndarray, total: np.ndarray) -> None:
        """Add the n-grams of some texts to their counts, a slice of characters at a time."""
        codes, at = _codes(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        few = self.masks.dtype.itemsize == 1
        for n in SIZES:
            total += np.maximum(np.diff(at) - n + 2, 0)
            for lo in range(0, len(codes) - n + 1, SLICE):
                mask = self.containing(_grams(codes[lo:lo + SLICE + n - 1], n))
                # n-grams that begin in one text and end in another count for none
                cross = (at[1:, None] - np.arange(1, n - 1)).ravel() - lo
                mask[cross[(cross >= 0) & (cross < len(mask))]] = 0
                of = doc[lo:lo + len(mask)]
                if few:
                    joint = np.bincount(of * 256 + mask[:len(of)], minlength=256 * len(texts)).reshape(-1, 256)
                    for i in range(len(self.languages)):
                        hits[:, i] += joint[:, (np.arange(256) >> i) & 1 == 1].sum(axis=1)
                else:
                    for i in range(len(self.languages)):
                        own = (mask[:len(of)] >> mask.dtype.type(i)) & mask.dtype.type(1)
                        hits[:, i] += np.bincount(of, weights=own, minlength=len(texts))


def learn(docs: DataFrame, sample: int = SAMPLE, kept: int = KEPT, least: int = LEAST) -> Filters | None:
    """Filters from the labelled documents ``docs`` (doc_id, text, lang).

    Of every language, at most ``sample`` different documents (the least hashes) are read.  The ``kept`` n-grams that
    most of them have go into the filter, those of one document only where a language has fewer than ``least``
    others, as one with a single document has.  A language whose texts are too short for an n-gram has no filter.
    Null lang or text is no label.  More than MAX_LANGUAGES languages raise an error.  None if there is nothing to
    learn from."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    about = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"))
             .limit(MAX_LANGUAGES + 1).collect()}
    if len(about) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not about:
        return None
    # a hash leaves each language's sort at least half as many rows again as it takes, and not many more
    near = F.lit(False)
    for lang, n in about.items():
        part = int((1 << 30) * min(1.0, (1.7 * sample + 100) / max(1, n)))
        near |= (F.col("lang") == lang) & (F.pmod("key", F.lit(1 << 30)) < part)
    order = Window.partitionBy("lang").orderBy("key")
    picked = (rows.select("lang", "key").filter(near).distinct()
              .withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample)
              .select("lang", "key").limit(MAX_LANGUAGES * sample + 1))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                got = [distinct(np.concatenate([_grams(_codes([t])[0], n) for n in SIZES])) for t in texts]
                h, n = np.unique(np.concatenate(got), return_counts=True)
                yield pd.DataFrame({"lang": lang, "h": h.astype(np.int64), "n": n.astype(np.int64)})

    texts = rows.join(F.broadcast(picked), ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"])
    seen = texts.mapInPandas(grams, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "h")
    # n-grams of one document fill a filter up to ``least`` only
    rows = (seen.withColumn("r", F.row_number().over(best)).filter((F.col("r") <= kept) & ((F.col("n") > 1) | (F.col("r") <= least)))
            .groupBy("lang").agg(F.sort_array(F.collect_list("h")).alias("h")).collect())
    return Filters({r["lang"]: np.array(r["h"], dtype=np.int64).astype(np.uint32) for r in rows}) if rows else None


def predictor(filters: Filters | None):
    """A column function: text -> struct(lang_pred, score).

    ``und`` with score 0 for null texts, texts without a letter and when nothing was learned; ties go to
    the language first by code point.  The score is the best language's part of all corrected shares."""
    packed = pickle.dumps(filters)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = pickle.loads(packed)
        for t in texts:
            some = np.array([x is not None and any(map(str.isalpha, x)) for x in t], dtype=bool)
            pred, score = np.full(len(t), UNKNOWN, dtype=object), np.zeros(len(t))
            if f is not None and some.any():
                share = f.shares(list(t[some]))
                best = share.argmax(axis=1)
                pred[some] = np.array(f.languages, dtype=object)[best]
                whole = share.sum(axis=1)
                score[some] = np.where(whole > 0, share.max(axis=1) / np.where(whole > 0, whole, 1), 1 / len(f.languages))
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    return predict


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang); learned from the rows not held out.

    A null text, and one without a letter, is ``und``; long texts are read whole; repeated rows are learned from once and
    predicted alike.  An empty table gives no rows; other columns are ignored."""
    marked = docs.select("doc_id", "text", "lang", (remainder(F.col("doc_id"), folds) == held).alias("held_out"))
    predict = predictor(learn(marked.filter(~F.col("held_out"))))
    return (marked.withColumn("_p", predict("text"))
            .select("doc_id", "held_out", "_p.lang_pred", "_p.score"))
