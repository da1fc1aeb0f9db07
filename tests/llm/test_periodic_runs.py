"""Runs against a search of all periods, and the query against the same rules on whole tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from marktide.llm.periodic_runs import Diagonals, collapsed, periodic_runs, repeated, text_runs, word_runs
from marktide.llm.queries import QUERIES


def brute(words, length=6, exponent=4):
    """Every maximal stretch of every period, kept where no smaller period fits it."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        x = 0
        while x + q < n:
            low = x
            while x + q < n and words[x] == words[x + q]:
                x += 1
            size = x - low + q
            if x > low and size >= max(length, exponent * q):
                s = words[low : low + size]
                if not any(s[p:] == s[:-p] for p in range(1, q)):
                    out.append((low, size, q))
            x += x == low
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_and_gate_on_random_sequences():
    draw, found = random.Random(3), 0
    for _ in range(4000):
        kinds = draw.choice([1, 2, 2, 3, 5])
        w = [draw.randrange(kinds) for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3) if w else 0):
            a = draw.randrange(len(w))
            w[a:a] = w[a : a + draw.randint(1, 7)] * draw.randint(2, 7)
            w = w[:90]
        want = brute(w)
        found += len(want)
        assert text_runs([b"%d" % x for x in w]) == want
        assert word_runs(w, 1, 2) == brute(w, 1, 2)
    assert found > 4000


def test_false_hashes_are_caught(monkeypatch):
    monkeypatch.setattr(Diagonals, "_alike", lambda self, i, j, size: True)
    draw = random.Random(5)
    for _ in range(300):
        w = [draw.randrange(2) for _ in range(draw.randint(0, 40))] * draw.choice([1, 1, 4])
        assert word_runs(w) == brute(w)


def test_gate_parts_plain_text():
    assert repeated(np.arange(1000)) == []
    assert repeated(np.r_[np.arange(50), [7] * 6, np.arange(100, 150)]) == [(50, 56)]
    with pytest.raises(ValueError, match="4 periods"):
        text_runs([b"a"] * 9, exponent=2)


def test_long_periodic_texts():
    for w, q in (([b"a"] * 100_000, 1), ([b"a", b"b"] * 50_000, 2), ([b"%d" % k for k in range(5000)] * 20, 5000)):
        assert text_runs(w) == [(0, 100_000, q)]
        assert collapsed(w, [(0, 100_000, q)]) == b" ".join(w[:q])


def planted(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 or not n:
        return w
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = planted(doc_id, text)
    runs = text_runs(w) if len(w) > 900 else brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), s, n, q, 1000 * n // q if runs else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_on_whole_table(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: expected(r.doc_id, r.text) for r in docs}
    assert sum(x[1] for x in got.values()) > 50


def test_null_empty_repeated_and_extra_columns(spark):
    from marktide.llm.periodic_runs import run_digests

    text = "x  y\tx y\nx y x y z"
    rows = [(None, text, 1), (2, None, 1), (3, "", 1), (4, " \n", 1), (7, text, 1), (7, text, 1), (9, "a a a a a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = {(r.doc_id, r.collapsed): r.runs for r in periodic_runs(docs).collect()}
    assert got[None, "x y z"] == [(0, 8, 2)] and got[7, "x y z"] == [(0, 8, 2)]
    assert got[2, ""] == got[3, ""] == got[4, ""] == got[9, "a a a a a"] == []
    digests = run_digests(docs).collect()
    assert len(digests) == 7 and sorted(map(tuple, digests), key=str) == sorted((expected(i, t) if i is not None else (None, *expected(7, t)[1:]) for i, t, _ in rows), key=str)
    assert run_digests(docs.limit(0)).collect() == []
