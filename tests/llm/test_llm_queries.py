"""The queries with SQL against DuckDB, and the pipeline against its stages done by hand."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from marktide.llm import simhash
from marktide.llm.common import table
from marktide.llm.queries import ORACLE_SQL, QUERIES

from test_llm_operators import components

D = "/root/testdata/sf0.001"


def shingles(text, n=5):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got, want = QUERIES[name](spark, D).toPandas(), con.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_near_copies_of_each_similarity(spark):
    draw = random.Random(21)
    rows, planted = [], {}
    for k in range(400):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.randint(60, 400))]
        rows.append((k, " ".join(words)))
        if k < 240:
            want, copy = (0.8, 0.85, 0.9)[k % 3], list(words)
            while True:
                changed = list(copy)
                changed[draw.randrange(len(copy))] = f"x{draw.randrange(10**6)}"
                a, b = shingles(" ".join(words)), shingles(" ".join(changed))
                if len(a & b) < want * len(a | b):
                    break
                copy = changed
            rows.append((1000 + k, " ".join(copy)))
            planted[1000 + k] = want
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_llm_extra", F.lit(1))
    left = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert set(range(400)) <= left
    for s in (0.8, 0.85, 0.9):
        ids = [k for k, x in planted.items() if x == s]
        assert sum(k not in left for k in ids) >= 0.95 * len(ids), s


def test_large_shards_lose_no_link(spark, monkeypatch):
    draw = random.Random(22)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(120):
        copy = list(base)
        for _ in range(k % 9):
            copy[draw.randrange(300)] = f"x{draw.randrange(40)}"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    group = lambda: {r.doc_id: r.group_id for r in simhash.similar_groups(docs).collect()}
    whole = group()
    monkeypatch.setattr(simhash, "MEMBERS", 10)
    dealt = group()
    assert len(set(whole.values())) == len(set(dealt.values())) < 40
    assert len({(whole[k], dealt[k]) for k in whole}) == len(set(whole.values()))


def test_pipeline(spark):
    docs = table(spark, D, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "simhash near-dedup", "mixing", "packing"]
    kept = docs.join(QUERIES["op1_quality_rules"](spark, D).where("kept").select("doc_id"), "doc_id", "left_semi")
    texts = {}
    for r in kept.collect():
        texts.setdefault(" ".join(r.text.split()), []).append(r.doc_id)
    one_each = {min(v) for v in texts.values()}
    stage = docs
    for name, f in corpus_pipeline.STAGES[:2]:
        stage = f(spark, stage, D)
        assert stage.columns == docs.columns
    assert {r.doc_id for r in stage.collect()} == one_each
    sets = {r.doc_id: shingles(r.text) for r in stage.collect()}
    groups = components([(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])], sets)
    near = {r.doc_id for r in corpus_pipeline.near(spark, stage, D).collect()}
    assert near == set(groups.values())
    final = corpus_pipeline.run(spark, D)
    assert {r.doc_id for r in final.select("doc_id").distinct().collect()} <= near
    assert final.count() > 0
