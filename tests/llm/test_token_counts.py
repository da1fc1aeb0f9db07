"""Token counts against the library itself."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marktide.llm.queries import QUERIES
from marktide.llm.token_counts import _OTHER, Counter, token_counts, whole_tokens
from marktide.llm.tokens import default_path

PATH = default_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return Counter(PATH, whole_tokens(PATH))


def test_proven_strings_are_one_token(library, counter):
    whole = sorted(counter.whole)
    assert len(whole) > 30_000 and set(library(whole)) == {1}
    assert "the" in whole and "The" not in whole and "don't" not in whole


def test_each_known_character_counts_as_in_the_library(library, counter):
    known = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and not _OTHER.match(c)]
    for place in ("{}", "a{}b", "1{}2", "!{}?", "'{}s", " {} ", "{}{}"):
        texts = [place.replace("{}", c) for c in known]
        assert list(map(counter.count, texts)) == library(texts)


def test_odd_texts(library, counter):
    draw, every = random.Random(7), [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    texts = ["".join(draw.choices(every if draw.random() < 0.3 else "ab s'tT ré İΣς ό́​\x1c\x85 <|endoftext|>12", k=draw.randint(0, 30))) for _ in range(5000)]
    texts += ["", " ", "a<|endoftext|>b", "<|startoftext|><|endoftext|>", "<|endoftext", "<|ENDOFTEXT|>", "don't DON'T we'll 'S", "x" * 50_000, "word " * 50_000]
    assert list(map(counter.count, texts)) == library(texts)


def test_query_on_whole_table(spark, library):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op11_token_counts"](spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    counts = library([r.text for r in docs])
    assert got == {r.doc_id: (len(r.text.encode()), n, n > 2048) for r, n in zip(docs, counts, strict=True)}
    assert any(x[2] for x in got.values())


def test_null_empty_repeated_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "cats", 9), (3, "cats", 9), (3, "cats", 9)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts(rows, limit=0).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 4, 1, True), (3, 4, 1, True), (3, 4, 1, True)], key=str)
    assert token_counts(rows.limit(0)).collect() == []


def test_other_kinds_of_tokenizer_are_refused():
    with pytest.raises(ValueError, match="pre-tokens"):
        whole_tokens(default_path("byte_bpe_50k.json"))
