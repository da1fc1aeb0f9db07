"""Hard negatives against all scores, with copies, ties, hot labels and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marktide.llm.hard_negatives import VantageTree, Windows, hard_negatives
from marktide.llm.queries import ORACLE_SQL, QUERIES


def brute(rows, anchors, k=5, least=80, largest=100, scale=256):
    good = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, own, q in good:
        if not anchors(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i, lab) for i, lab, v in good if i != a)
        for s, i, _ in [x for x in scored if x[2] == own][:k]:
            negatives = [(-t, j) for t, j, lab in scored if lab != own and least * -s <= 100 * -t <= largest * -s][:k]
            out += [(a, i, n, j, -s, t) for n, (t, j) in enumerate(negatives, 1)]
    return sorted(out)


def table(n, seed, labels=4):
    draw = random.Random(seed)
    hot = [draw.uniform(-1, 1) for _ in range(6)]
    rows = []
    for k in range(n):
        v = list(hot) if draw.random() < 0.33 else [draw.choice([-0.5, 0.0, 0.25, draw.gauss(0, 1)]) for _ in range(6)]
        rows.append((k, v, 0 if draw.random() < 0.33 else draw.randrange(labels)))
    return rows


@pytest.mark.parametrize(("shard", "leaf"), [(50_000, 128), (37, 4)])
def test_against_all_scores(spark, shard, leaf, monkeypatch):
    monkeypatch.setattr("marktide.llm.hard_negatives.SMALL", 1)
    rows = table(400, 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hard_negatives(df, F.col("vec_id") % 10 == 0, shard=shard, leaf=leaf)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda a: a % 10 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 1.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 2), (5, [1.0, 1.0], None), (6, [], 1), (7, [1.0], 1), (8, [1.0, 0.5], 1), (9, [0.95, 0.0], 2), (10, [0.9, 0.9], 2), (10, [0.9, 0.9], 2), (11, [-1.0, 0.1], 1), (12, [1e5, 1e5], 3), (13, [1e5, 9e4], 3), (14, [0.75, 0.1], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, row int, shard string")
    got = sorted(map(tuple, hard_negatives(df).collect()))
    assert got == brute(rows, lambda a: True) and len(got) > len(set(got))
    assert hard_negatives(df.limit(0)).collect() == []
    assert hard_negatives(df, F.lit(False)).collect() == []
    assert hard_negatives(df, F.when(F.col("label") == 9, True)).collect() == []


def test_long_vectors_stay_exact():
    rows = np.array([[2**30, 2**30 + k, -7] for k in range(300)], np.int64)
    query = np.array([2**29 + 1, 2**29 + 3, 5], np.int64)
    tree = VantageTree(rows, 8, 2**29 + 3)
    wanted = Windows([-(2**62)], [2**62], 3, np.arange(300), np.ones(300, bool))
    tree.nearest_first(query, tree.distances(query[None])[0].tolist(), wanted)
    assert wanted.windows[0][2] == [(sum(int(a) * int(b) for a, b in zip(rows[k], query, strict=True)), k) for k in (299, 298, 297)]


def test_walk_leaves_out_what_cannot_count():
    draw = np.random.default_rng(3)
    middles = draw.normal(size=(40, 8)) * 2000
    rows = (middles[draw.integers(0, 40, 8000)] + draw.normal(size=(8000, 8)) * 20).astype(np.int64)
    tree, seen = VantageTree(rows, 32), []

    class Counted(Windows):
        def visit(self, numbers, scores):
            seen.append(len(numbers))
            super().visit(numbers, scores)

    for q in rows[:20]:
        scores = rows @ q
        best = np.lexsort((np.arange(8000), -scores))
        high = int(scores[best[100]])
        wanted = Counted([0.9 * high], [high], 5, np.arange(8000), np.ones(8000, bool))
        tree.nearest_first(q, tree.distances(q[None])[0].tolist(), wanted)
        inside = [int(k) for k in best if 0.9 * high <= scores[k] <= high][:5]
        assert [k for _, k in wanted.windows[0][2]] == inside
    assert sum(seen) < 0.25 * 20 * 8000


def test_query_agrees_with_its_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    cur = con.execute(ORACLE_SQL["op12_hard_negatives"])
    names = [c[0] for c in cur.description]
    got = QUERIES["op12_hard_negatives"](spark, d).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
