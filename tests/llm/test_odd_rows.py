"""Nulls, ties, repeated rows, clashing names and very long texts, through every stage and operator."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marktide.llm import html_extract, license_scan, mixing, packing, quality_rules, simhash, substring_dedup, token_files, toxicity
from marktide.llm.exact_dedup import exact_dedup
from marktide.llm.tokens import default_path

CLASHING = ["keep_doc", "keep_key", "keep_id", "row", "digest", "group_id", "component_id", "stratum", "rate", "copies", "copy", "size", "fp", "low", "kept", "n_words", "score", "start", "shard", "text_sha256"]


def words(draw, n):
    return " ".join(f"w{draw.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with null ids, texts, languages and sources, ties and repeated rows, and columns of clashing names; and their folder."""
    draw = random.Random(1)
    a, b = words(draw, 200), words(draw, 300)
    near = b.replace("w1", "x1", 3)
    rows = [(1, a), (1, a), (2, a), (None, a), (None, a), (None, b), (3, b), (3, near), (4, None), (None, None), (5, ""), (6, "few words"), (7, a.replace(" ", "\n", 5))]
    rows += [(10 + k, words(draw, 120)) for k in range(30)]
    data = [(k, t, None if n % 5 == 0 else "en", None if n % 7 == 0 else f"s{n % 3}", n) for n, (k, t) in enumerate(rows)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(None, 1, 1), (10, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), folder


def test_stages(spark, odd):
    docs, folder = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() > 0, name
        docs = corpus_pipeline.saved(out, "odd")
        if name == "exact dedup":
            assert docs.groupBy("text").count().where("count > 1").isEmpty()
    packed = corpus_pipeline.packed(spark, docs, folder)
    assert packed.count() >= docs.count() > 0
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


def test_near_keeps_the_smallest_of_each_group(spark, odd):
    docs, folder = odd
    left = corpus_pipeline.near(spark, docs.where("text is not null and length(text) > 20"), folder).select("doc_id").collect()
    assert sorted(r.doc_id for r in left) == [1, 3, *range(10, 40)]


def test_operators_with_clashing_names(odd, spark):
    docs, folder = odd
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    n = docs.count()
    for out in (exact_dedup(docs), simhash.simhash_groups(docs), simhash.similar_groups(docs), substring_dedup.substring_dedup(docs), mixing.mix_counts(docs), license_scan.license_scan(docs), token_files.token_round_trip(docs), quality_rules.quality_rules(docs, labels), toxicity.toxicity(docs, labels)):
        assert out.count() == n
    assert packing.pack_documents(docs).select("doc_id", "start").count() >= n
    assert mixing.mix(docs).columns == docs.columns


def test_very_long_texts(spark):
    """One text of two million characters beside short ones, half of it repeated in another."""
    draw = random.Random(2)
    long = " ".join(draw.choice(("alpha", "beta", "gamma,", "GPL", "all rights reserved", "i d i o t", "é")) + str(draw.randrange(10**6)) for _ in range(160_000))
    rows = [(1, long), (2, long[len(long) // 2 :]), (3, "short text"), (4, "x" * 1_000_000), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")}).repartition(2)
    labels = spark.createDataFrame([(1, 1, 1), (3, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.kept for r in exact_dedup(docs).collect()} == dict.fromkeys(range(1, 6), True)
    gone = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert gone[2].source_ids == [1] and gone[2].removed_bytes > 0.99 * gone[2].n_bytes and gone[1].n_spans == 0
    assert quality_rules.quality_rules(docs, labels).where("n_words > 150000").count() == 1
    assert simhash.similar_groups(docs).select("group_id").distinct().count() == 5
    assert toxicity.toxicity(docs, labels).count() == license_scan.license_scan(docs).count() == 5
    pieces = packing.pack_documents(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert all(r.n == r["all"] for r in pieces)
    got = {r.doc_id: r for r in token_files.token_round_trip(docs).collect()}
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(default_path("byte_bpe_50k.json")).encode(long, add_special_tokens=False).ids, 2]
    assert (got[1].n_tokens, got[1].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    page = spark.createDataFrame([(1, "u", f"<article><p>{long}</p></article>")], "page_id long, url string, html string")
    assert html_extract.html_extract(page).first().n_chars == len(" ".join(long.split()))


def test_intermediate_tables_can_be_cleared(spark, tmp_path):
    from marktide.llm import common

    common.clear(spark)
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    simhash.simhash_groups(docs).write.parquet(f"{tmp_path}/out")
    made = [p.removeprefix("file://") for p in common._MADE]
    assert made and all(map(os.path.exists, made))
    assert common.clear(spark) == len(made) and not any(map(os.path.exists, made))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
