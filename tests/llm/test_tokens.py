"""Token counts against the library itself, and the cache."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers

from studybank.llm import common, tokens
from studybank.session import shared_dir

DOCS = "doc_id long, text string"
FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def word_bpe():
    return tokens.load(FILE, fold_space=True, fold_case=True)


def library(texts):
    own = tokenizers.Tokenizer.from_file(FILE)
    return [len(e.ids) for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts(n):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t ", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "​", "don't", "DON'T", "I'LL", "x'S", "ABC", "naïve",
             "É", "É", "H̱", "ẖ", "K", "İ", "ſ", "Σ", "ς", "ﬁ", "日本語", "한글", "١٢", "1234", "½", "...", "?!", "#tag", "a_b", "👍🏽", "👩‍👩‍👧",
             "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|end", "oftext|>", "<", "|", ">", "w" * 80, "", "\x00", "﻿", "the", "The"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_counts_are_the_library_s(spark, word_bpe, monkeypatch):
    common.prepare(spark)
    monkeypatch.setattr(tokens, "FEW", 1500)
    texts = odd_texts(2000) + [None, "", "  \n ", "same", "same ", " SAME", "long " * 50_000 + "<|endoftext|>", "x" * 20_000]
    docs = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 3, DOCS)
    docs = docs.selectExpr("doc_id", "text", "1 AS n_tokens", "2 AS digest", "3 AS content", "4 AS copies", "5 AS n_bytes")
    out = tokens.token_counts(docs, word_bpe, shared_dir(spark, "t"), limit=100)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = library(texts)
    expected = [(i if i % 50 else None, len((t or "").encode()), m, m > 100) for i, (t, m) in enumerate(zip(texts, n))]
    expected += [expected[7]] * 3
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str)


def test_special_strings_that_case_folding_would_make(word_bpe):
    texts = ["<|ENDOFTEXT|>", "<|endoftext|>"]
    assert library(texts) != [library(texts)[1]] * 2


def test_each_content_is_encoded_once_and_the_cache_serves_later_runs(spark, word_bpe):
    common.prepare(spark)
    cache = shared_dir(spark, "t")
    path = f"{cache}/version={word_bpe.version}"
    first = spark.createDataFrame([(i, f"text {i % 5}") for i in range(200)], DOCS)
    expected = sorted(zip(range(200), library([f"text {i % 5}" for i in range(200)])))

    def counts(docs):
        return sorted((r.doc_id, r.n_tokens) for r in tokens.token_counts(docs, word_bpe, cache).collect())

    assert counts(first) == expected
    assert spark.read.parquet(path).count() == 5
    # a cached count is taken, not found again
    planted = spark.read.parquet(path).selectExpr("digest", "n_tokens + 1000 AS n_tokens").collect()
    other = shared_dir(spark, "t")
    spark.createDataFrame(planted, "digest binary, n_tokens long").write.parquet(f"{other}/version={word_bpe.version}")
    cache = other
    path = f"{cache}/version={word_bpe.version}"
    more = first.union(spark.createDataFrame([(900, "  TEXT\n 3 "), (901, "new")], DOCS))
    got = counts(more)
    assert got[:200] == [(i, n + 1000) for i, n in expected]
    assert got[200:] == [(900, library(["text 3"])[0] + 1000), (901, library(["new"])[0])]
    assert spark.read.parquet(path).count() == 6
    # an append that was repeated changes nothing
    spark.read.parquet(path).limit(3).write.mode("append").parquet(path + "x")
    spark.read.parquet(path + "x").write.mode("append").parquet(path)
    assert counts(more) == got


def test_many_missing_contents_are_found_by_a_shuffle(spark, word_bpe, monkeypatch):
    common.prepare(spark)
    monkeypatch.setattr(tokens, "FEW", 0)
    texts = ["hot"] * 300 + [f"text {i}" for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    out = tokens.token_counts(docs, word_bpe, shared_dir(spark, "t"))
    assert sorted((r.doc_id, r.n_tokens) for r in out.collect()) == list(enumerate(library(texts)))


def test_other_tokenizers_and_versions(spark, word_bpe):
    common.prepare(spark)
    texts = odd_texts(200)
    pieces = tokens.load(public_tokenizers.path("piece_bpe_32k.model"))
    import sentencepiece
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    out = tokens.token_counts(docs, pieces, shared_dir(spark, "t")).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {i: len(own.encode(t)) for i, t in enumerate(texts)}
    versions = {pieces.version, word_bpe.version, tokens.load(FILE).version, tokens.load(FILE, fold_space=True).version}
    assert len(versions) == 4
    byte_level = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert byte_level.opened()(pa.array(texts)) == [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_empty_table(spark, word_bpe):
    common.prepare(spark)
    cache = shared_dir(spark, "t")
    assert tokens.token_counts(spark.createDataFrame([], DOCS), word_bpe, cache).count() == 0
