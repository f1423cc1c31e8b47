"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content; the cache holds, for one version of a
tokenizer (a digest of its file, its options and its library's version), the count of every content
encoded so far.  A run finds its distinct keys, takes the counts the cache has, encodes each missing
content once, appends those counts to the cache, and joins all documents to it by key.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from importlib.metadata import version as library_version
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studybank.llm.common import byte_size, stored

#: Missing contents whose keys are broadcast (32 bytes each); more are found by a shuffle.
FEW = 200_000
#: A content that more than one row in HOT holds is joined by broadcast (fewer than HOT such contents exist).
HOT = 1000
#: Words whose counts a worker remembers; words encoded at a time.
WORDS, TOGETHER = 500_000, 256

_OPEN: dict[str, object] = {}


@dataclass(frozen=True)
class Tokenizer:
    """A public tokenizer: its library (``tokenizers`` or ``sentencepiece``) and the bytes of its file.

    ``fold_space``: white space only separates tokens, so ASCII white space becomes blanks, runs of up to eight one
    blank, and ends are trimmed.  ``fold_case``: ASCII case makes no difference, so ASCII texts without a special string are
    lower-cased.  Neither may be set for a tokenizer that tells such texts apart."""

    library: str
    model: bytes
    fold_space: bool = False
    fold_case: bool = False

    @property
    def version(self) -> str:
        """Digest of all that decides a count."""
        about = f"{self.library} {library_version(self.library)} {self.fold_space} {self.fold_case} "
        return hashlib.sha256(about.encode() + hashlib.sha256(self.model).digest()).hexdigest()

    @property
    def special(self) -> list[str]:
        """Strings that the library finds in a text before all else."""
        if self.library != "tokenizers":
            return []
        return [t["content"] for t in json.loads(self.model).get("added_tokens", [])]

    def with_content(self, df: DataFrame) -> DataFrame:
        """``df`` (text) with ``content``, the normalised text: equal contents have equal counts (null: empty).

        Each step is a column of its own, so that none is computed again where it is used twice."""
        text = F.coalesce("text", F.lit(""))
        if self.fold_space:
            for c in "\t\n\r\f\x0b":
                text = F.replace(text, F.lit(c), F.lit(" "))
            for run in (4, 2, 2):
                text = F.replace(text, F.lit(" " * run), F.lit(" "))
            text = F.trim(text)
        df = df.withColumn("content", text)
        if not self.fold_case:
            return df
        df = df.withColumn("lower", F.lower("content"))
        plain = F.octet_length("content") == F.length("content")
        for s in self.special:
            plain &= ~F.contains("lower", F.lit(s.lower()))
        return df.withColumn("content", F.when(plain, F.col("lower")).otherwise(F.col("content"))).drop("lower")

    def opened(self):
        """Counts of an Arrow array of contents, as a function; the library's own object is kept in the worker."""
        key = self.version
        if key not in _OPEN:
            texts, words = (_sentencepiece if self.library == "sentencepiece" else _tokenizers)(self.model)
            _OPEN[key] = _by_words(words) if self.fold_space else lambda contents: texts(contents.to_pylist())
        return _OPEN[key]


def _sentencepiece(model: bytes):
    import sentencepiece
    made = sentencepiece.SentencePieceProcessor(model_proto=model)

    def texts(some: list[str]) -> list[int]:
        return [len(made.encode(t, num_threads=1)) for t in some]

    return texts, texts


def _tokenizers(model: bytes):
    import tokenizers
    made = tokenizers.Tokenizer.from_str(model.decode("utf-8"))
    made.no_padding()
    made.no_truncation()

    def texts(some: list[str]) -> list[int]:
        return [len(made.encode_batch_fast([t], add_special_tokens=False)[0].ids) for t in some]

    def words(some: list[str]) -> np.ndarray:
        """Tokens by word: TOGETHER words are encoded as one text, and a token belongs to the word it begins in."""
        counts = [np.zeros(0, dtype=np.int64)]
        for lo in range(0, len(some), TOGETHER):
            part = some[lo:lo + TOGETHER]
            begins = np.cumsum([0] + [len(w) + 1 for w in part[:-1]])
            tokens = made.encode(" ".join(part), add_special_tokens=False).offsets
            at = np.fromiter((first for first, _ in tokens), dtype=np.int64, count=len(tokens))
            counts.append(np.bincount(np.searchsorted(begins, at, side="right") - 1, minlength=len(part)))
        return np.concatenate(counts)

    return texts, words


def _by_words(encode):
    """Counts contents whose blanks only separate tokens as sums over their words; the library encodes a word once
    (again where more than WORDS are known).  A long text is never encoded at once, only some of its words."""
    known: dict[str, int] = {}

    def count(contents: pa.Array) -> list[int]:
        words = pc.split_pattern(contents, " ")
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        new = [w for w in names if w not in known]
        if len(known) + len(new) > WORDS:
            known.clear()
            new = names
        known.update(zip(new, (int(n) for n in encode(new))))
        each = np.array([known[w] for w in names], dtype=np.int64)[coded.indices.to_numpy()]
        total = np.concatenate(([0], np.cumsum(each)))
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        return np.diff(total[ends]).tolist()

    return count


def load(path: str, fold_space: bool = False, fold_case: bool = False) -> Tokenizer:
    """The tokenizer of a vocabulary file that the driver can read: ``.json`` (tokenizers) or ``.model`` (sentencepiece).

    Its bytes go to the executors with the job."""
    library = {".json": "tokenizers", ".model": "sentencepiece"}[Path(path).suffix]
    return Tokenizer(library, Path(path).read_bytes(), fold_space, fold_case)


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """Counts of one tokenizer version: digest, n_tokens.  An append that was repeated leaves equal rows, which become one."""
    fields = "digest binary, n_tokens long"
    try:
        found = spark.read.schema(fields).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], fields)
    return found.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def _missing_contents(keyed: DataFrame, missing: DataFrame, n: int) -> DataFrame:
    """One row (digest, content) for each missing digest.

    Few keys are broadcast, so only texts that are missing are shuffled; otherwise the texts are, one of each content
    from each task."""
    if n <= FEW:
        return (keyed.join(F.broadcast(missing), "digest", "left_semi")
                .groupBy("digest").agg(F.first("content").alias("content")))
    return (keyed.groupBy("digest").agg(F.first("content").alias("content"))
            .join(missing, "digest", "left_semi"))


def _encoded(contents: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer.opened()
        for b in batches:
            n = pa.array(count(b.column("content")), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("digest"), n], ["digest", "n_tokens"])

    return contents.mapInArrow(encode, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: Tokenizer, cache: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (of the text's UTF-8), n_tokens, over_limit (more than ``limit``) of every row of ``docs`` (doc_id, text).

    ``cache`` is a folder that all executors see; a missing one is begun.  Counts of contents it has are not encoded
    again; each other content is encoded once, however many rows hold it, and appended.  A null text counts as
    empty; repeated rows and null doc_ids are rows like others; other columns are ignored.  Texts are counted whole."""
    spark = docs.sparkSession
    path = f"{cache.rstrip('/')}/version={tokenizer.version}"
    texts = tokenizer.with_content(docs.select("doc_id", "text")).withColumn("n_bytes", byte_size(F.col("text")))
    texts = texts.withColumn("digest", F.unhex(F.sha2(F.col("content").cast("binary"), 256)))
    keyed = stored(texts.select("doc_id", "n_bytes", "digest"), "tokens-keyed")

    copies = stored(keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), "tokens-digests")
    missing = stored(copies.join(_entries(spark, path), "digest", "left_anti").select("digest"), "tokens-missing")
    n = missing.count()
    if n:
        contents = _missing_contents(texts.select("digest", "content"), missing, n)
        _encoded(contents, tokenizer).write.mode("append").parquet(path)

    known = _entries(spark, path)
    hot = F.broadcast(copies.filter(F.col("copies") * HOT > keyed.count()).select("digest"))
    of_hot = F.broadcast(known.join(hot, "digest", "left_semi"))
    joined = (keyed.join(hot, "digest", "left_anti").join(known, "digest", "left")
              .unionByName(keyed.join(hot, "digest", "left_semi").join(of_hot, "digest", "left")))
    sure = F.coalesce("n_tokens", F.raise_error(F.lit("the cache has lost a count")).cast("long"))
    return joined.select("doc_id", "n_bytes", sure.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
