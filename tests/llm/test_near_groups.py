"""Near duplicates among texts that share a passage, in large shards, against all pairs."""

from __future__ import annotations

import random

import numpy as np
from test_llm_operators import components
from test_llm_queries import shingles, similar

from marktide.llm import simhash


def word(draw):
    return f"w{draw.randrange(10**6)}"


def test_passages_and_copies_lose_no_link(spark, monkeypatch):
    draw = random.Random(31)
    passage = [f"p{k}" for k in range(40)]
    texts = [[word(draw) for _ in range(15)] + passage + [word(draw) for _ in range(15)] for _ in range(150)]
    chain = [word(draw) for _ in range(120)]
    for _ in range(12):  # each like the one before, the ends unlike
        chain = [word(draw) for _ in range(5)] + chain[:-5]
        texts.append(list(chain))
    base = passage + [word(draw) for _ in range(60)]
    for k in range(60):  # like their base, or almost
        copy = list(base)
        for _ in range(k % 6):
            copy[draw.randrange(100)] = word(draw)
        texts.append(copy)
    texts += [t[:-1] + [word(draw)] for t in texts[:20]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = {k: shingles(t) for k, t in rows}
    want = components([(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])], sets)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for members in (400, 8):
        monkeypatch.setattr(simhash, "MEMBERS", members)
        got = {r.doc_id: r.group_id for r in simhash.similar_groups(docs).collect()}
        assert len({(want[k], got[k]) for k in want}) == len(set(want.values())) == len(set(got.values()))


def test_a_shared_passage_makes_no_text_meet_another():
    draw = np.random.default_rng(1)
    passage = np.arange(36, dtype="<u4")
    sets = [np.unique(np.r_[passage, draw.integers(1000, 2**32, 30)]).astype("<u4") for _ in range(500)]
    h, n = np.unique(np.concatenate(sets), return_counts=True)
    often = n >= simhash.OFTEN
    rare = np.concatenate([simhash.prefix(x, h[often], n[often], 0.8) for x in sets])
    assert len(rare) < 500 * 16 and not np.isin(rare, passage).any()


def test_similar_sets_share_a_rare_hash():
    draw = random.Random(9)
    for _ in range(2000):
        a = set(draw.sample(range(200), draw.randint(1, 60)))
        b = (a - set(draw.sample(sorted(a), draw.randint(0, len(a) // 6)))) | set(draw.sample(range(200), draw.randint(0, 3)))
        often = np.array(sorted(draw.sample(range(200), 80)), np.int64)
        counts = np.array([draw.randint(16, 99) for _ in often], np.int64)
        x, y = (simhash.prefix(np.array(sorted(s), "<u4"), often, counts, 0.8) for s in (a, b))
        if b and len(a & b) >= 0.8 * len(a | b):
            assert set(x.tolist()) & set(y.tolist())
