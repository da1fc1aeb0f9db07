"""The operators against brute force, on small tables with nulls, empty texts, copies and extra columns."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marktide.llm import html_extract, license_scan, mixing, packing, quality_rules, simhash, substring_dedup, token_files, tokens, toxicity
from marktide.llm.exact_dedup import exact_dedup
from marktide.llm.tokens import default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, low long, id string, rate double"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(draw, n):
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 99)) for _ in range(n))


def rows(seed=1):
    draw = random.Random(seed)
    texts = [None, "", " \t\n", "one", "One  two", "one two", "a a a a", "é ñ ü", "GPL all rights reserved"]
    texts += [prose(draw, draw.randint(1, 120)) for _ in range(40)]
    base = prose(draw, 200)
    texts += [base, base, base.replace("  ", " "), base + " extra", base.upper(), "x " * 30_000]
    texts += [f"{prose(draw, 30)} {base[:700]} {prose(draw, 20)}" for _ in range(3)]
    return [(k, t, draw.choice(["en", "de", None]), draw.choice(["s0", "s1", None]), len(t or ""), 7, "z", 0.5) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 5 != 0, k % 7 == 0) for k in range(60)], "doc_id long, q boolean, t boolean").select("doc_id", F.col("q").cast("int").alias("quality"), F.col("t").cast("int").alias("toxic"))


def texts():
    return {r[0]: r[1] or "" for r in rows()}


def test_exact_dedup(docs):
    want = defaultdict(list)
    for k, t in texts().items():
        want[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(k)
    got = {r.doc_id: r for r in exact_dedup(docs).collect()}
    assert len(got) == len(texts())
    for t, ids in want.items():
        for k in ids:
            r = got[k]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), k == min(ids), hashlib.sha256(t.encode()).hexdigest())


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs):
    fp = {k: brute_fingerprint(t) for k, t in texts().items()}
    want = components([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2], fp)
    got = {r.doc_id: r for r in simhash.simhash_groups(docs).collect()}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{x:016x}" for k, x in fp.items()}
    assert {k: r.component_id for k, r in got.items()} == want


def test_simhash_search_finds_all_links(spark):
    draw = random.Random(3)
    fps = {draw.getrandbits(64) for _ in range(300)}
    fps |= {f ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for f in list(fps)[:200]}
    want = components([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2], fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = [((r.u) & (2**64 - 1), (r.v) & (2**64 - 1)) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()]
    assert components(links, fps) == want


def test_large_shards_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 20)
    fps = {(a << 8 | b) for a in range(16) for b in range(16)}
    want = components([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2], fps)
    links = [(r.u, r.v) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert components(links, fps) == want


def test_quality(docs, labels):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    for k, t in texts().items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    kept = quality_rules.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, r in got.items() if r.kept)


@pytest.mark.parametrize(("n", "k"), [(300, 0), (300, 1), (5000, 3), (10, 0)])
def test_binomial_tail(spark, n, k):
    from math import comb

    p = 0.002
    got = spark.range(1).select(quality_rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
    want = 1.0 if k >= n * p else sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert got == pytest.approx(want, rel=1e-9)


def test_chunks_resist_shifts():
    draw = random.Random(5)
    base = prose(draw, 400)
    a, b = substring_dedup.chunks(base), substring_dedup.chunks("inserted words here " + base)
    assert len({x[0] for x in a} - {x[0] for x in b}) <= 2
    for t in (base, "é" * 999, "x" * 5000, " ", "", None):
        found = substring_dedup.chunks(t)
        raw = (t or "").encode()
        assert b"".join(raw[s:e] for _, s, e, _ in found) == raw
        assert sum(x[3] for x in found) == len((t or "").split())
        for _, s, e, _ in found:
            raw[s:e].decode()


def test_substring_dedup(spark, docs):
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    by_text = texts()
    base = next(k for k, t in by_text.items() if len(t.split()) == 200)
    last = max(by_text)
    assert len(got) == len(by_text)
    assert got[base].n_spans == 0
    assert got[base + 1].removed_bytes == len(by_text[base + 1].encode())
    assert base in got[last].source_ids
    assert all(got[k].n_spans == 0 for k in range(base))


def brute_repeats(table):
    """doc_id to the bytes that go and the documents that keep them, from every document's windows."""
    holders = defaultdict(set)
    for k, t in table.items():
        for d, m, _, _ in substring_dedup.windows(t):
            holders[d, m].add(k)
    out = {}
    for k, t in table.items():
        gone, sources = set(), set()
        for d, m, span, _ in substring_dedup.windows(t):
            if min(holders[d, m]) < k:
                gone |= set(range(span >> 32, span & (2**32 - 1)))
                sources.add(min(holders[d, m]))
        out[k] = (len(gone), sorted(sources))
    return out


def test_planted_passages(spark):
    draw = random.Random(11)
    table, planted = {}, []
    for k in range(100):
        passage = prose(draw, 60)
        table[10 * k] = f"{prose(draw, 40)} {passage} {prose(draw, 9)}"
        table[10 * k + 1] = f"{prose(draw, 15)} {passage}"
        table[10 * k + 2] = prose(draw, 80)
        planted.append((10 * k, 10 * k + 1, passage))
    docs = spark.createDataFrame(list(table.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert {k: (r.removed_bytes, r.source_ids) for k, r in got.items()} == brute_repeats(table)
    assert sum(got[b].source_ids == [a] for a, b, _ in planted) >= 97
    assert all(got[k].n_spans == 0 for k in table if k % 10 != 1)
    left = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).collect()}
    assert all(passage in left[a] for a, _, passage in planted)
    assert sum(len(left[b].split()) < 50 for _, b, _ in planted) >= 95


def test_pieces_of_many_documents_stay(spark):
    """A text of one chunk each of forty documents is no passage of any of them."""
    draw = random.Random(12)
    sources = {k: prose(draw, 120) for k in range(40)}
    parts = []
    for t in sources.values():
        raw, found = t.encode(), substring_dedup.chunks(t)
        _, s, e, _ = next(x for x in found[3:] if 3 <= x[3] < 12)
        parts.append(raw[s:e].decode())
    docs = spark.createDataFrame([*sources.items(), (99, "".join(parts))], "doc_id long, text string")
    assert substring_dedup.substring_dedup(docs).where("n_spans > 0").count() == 0


def test_all_sources_of_a_passage_are_named(spark):
    draw = random.Random(13)
    a, b, c = (prose(draw, 70) for _ in range(3))
    rows = [(1, a), (2, b), (3, c), (4, f"{a} {b} {prose(draw, 30)} {c}"), (4, f"{a} {b} {prose(draw, 30)} {c}"), (None, a)]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.source_ids for r in out if r.doc_id == 4] == [[1, 2, 3]] * 2
    assert [r.source_ids for r in out if r.doc_id is None] == [[1]]


def test_mixing(spark, docs):
    out = mixing.mix_counts(docs).collect()
    for r in out:
        u = int(hashlib.sha256(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        term = total = np.exp(-r.rate)
        k = 0
        while u >= total:
            k += 1
            term *= r.rate / k
            total += term
        assert r.copies == k
    mixed = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in out if r.copies})
    assert mixing.mix(docs).columns == docs.columns
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("source"))
    got = {r.source: r.n for r in mixing.mix_counts(many, {"big": 1.0, "small": 1.0}).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    assert abs(got["big"] - 10_000) < 400 and abs(got["small"] - 10_000) < 400


def test_kernel_table_equals_sums():
    draw = random.Random(2)
    units = [bytes(draw.randint(1, 31) for _ in range(draw.randint(1, 12))) for _ in range(40)]
    weights = np.random.default_rng(0).normal(size=toxicity.LETTERS).astype(np.float32)
    line = np.frombuffer(b"\0" + b"".join(u + b"\0" for u in units), np.uint8)
    got, _ = toxicity.unit_sums(line, weights)
    features = [toxicity.subsequences(u) for u in units]
    assert np.allclose(got, [weights[place] @ value for place, value in features], atol=1e-3)
    # a feature is the sum of DECAY ** span over all ways of picking its four letters in order
    for unit, (place, value) in zip(units, features, strict=True):
        c, want = [0, *unit, 0], defaultdict(float)
        for pick in combinations(range(len(c)), 4):
            if pick[3] - pick[0] <= toxicity.SPAN:
                key = 0
                for k in pick:
                    key = key * 32 + c[k]
                want[key] += toxicity.DECAY ** (pick[3] - pick[0])
        scale = toxicity.length_norms(np.array([len(unit)]))[0]
        assert dict(zip(place.tolist(), value.tolist(), strict=True)) == pytest.approx({k: v / scale for k, v in want.items()}, rel=1e-4)


def test_held_out_labels_of_the_test_data(spark):
    """Better than the same data's words with the largest log-odds, which reach 0.947 there."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(marks.select("doc_id").distinct(), "doc_id", "left_semi")
    out = toxicity.toxicity(docs, marks).where("held_out").join(marks, "doc_id").select("score", "predicted", "toxic").toPandas()
    y, rank = out["toxic"] == 1, out["score"].rank()
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc >= 0.96
    hit = (y & (out["predicted"] == 1)).sum()
    assert hit / y.sum() >= 0.88 and hit / (out["predicted"] == 1).sum() >= 0.9


def test_symbols_join_letters_that_stand_alone():
    assert toxicity.symbols("i d i o t").tobytes() == toxicity.symbols("i.d.i-o!t").tobytes() == toxicity.symbols("IDIOT").tobytes()
    assert toxicity.symbols("it is").tobytes() != toxicity.symbols("itis").tobytes()
    assert toxicity.symbols(None).tobytes() == b"\0"


def test_toxicity_learns(spark):
    draw = random.Random(9)
    data, marks = [], []
    for k in range(600):
        toxic = k % 4 == 0
        words = [draw.choice(WORDS) + draw.choice(WORDS) for _ in range(60)]
        if toxic:
            words[draw.randrange(60)] = draw.choice(["blockhead", "numbskull", "nitwit"])
        data.append((k, " ".join(words)))
        marks.append((k, int(toxic)))
    data += [(1000, "you blo-ckhead"), (1001, "you b l o c k h e a d"), (1002, "a blockxhead here"), (1003, None), (1004, "alpha beta")]
    out = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(out[k].held_out for k in held)
    assert np.mean([out[k].predicted == (k % 4 == 0) for k in held]) > 0.95
    assert [out[k].predicted for k in (1000, 1001, 1002)] == [1, 1, 1]
    assert [out[k].predicted for k in (1003, 1004)] == [0, 0]


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    out = packing.pack_documents(docs).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for k, t in texts().items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_conversations_pack_under_all_limits(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    words = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    examples = turns.groupBy(F.col("conv_id").alias("example_id")).agg(F.sum(words).alias("tokens"), F.count("*").alias("segments"), F.sum(F.when(F.col("role") == "assistant", words).otherwise(0)).alias("loss_tokens"))
    want = {r.example_id: (r.tokens, r.segments, r.loss_tokens) for r in examples.collect()}
    limit = (max(x[0] for x in want.values()) + 200, 16, max(x[2] for x in want.values()) + 50)
    out = packing.pack_examples(examples.coalesce(2), *limit).collect()
    assert sorted(r.example_id for r in out) == sorted(want)
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append(want[r.example_id])
    sums = [tuple(map(sum, zip(*x, strict=True))) for x in held.values()]
    assert all(a <= b for s in sums for a, b in zip(s, limit, strict=True))
    assert len(held) < len(want) and len({np.argmax(np.array(s) / limit) for s in sums}) > 1  # more than one limit binds
    with pytest.raises(Exception, match="exceeds a limit"):
        packing.pack_examples(examples, 5, 1, 1).collect()


def test_packing_keeps_all_limits():
    rng = np.random.default_rng(1)
    demand = np.stack([rng.integers(1, 900, 500), rng.integers(1, 5, 500), rng.integers(0, 300, 500)], axis=1)
    limit = np.array([2048, 12, 600])
    place = packing.dot_product_pack(demand, limit)
    for s in range(place.max() + 1):
        assert (demand[place == s].sum(axis=0) <= limit).all() and (place == s).any()


def test_token_files(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    at, want = 0, {}
    for k, t in sorted(texts().items()):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want[k] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_round_trip(docs).collect()} == want


def test_requested_documents_open_few_frames(spark, tmp_path):
    from tokenizers import Tokenizer

    path, folder = default_path("byte_bpe_50k.json"), f"file://{tmp_path}/files"
    draw = random.Random(14)
    data = {2 * k: prose(draw, 300) for k in range(200)}
    docs = spark.createDataFrame([*data.items(), (None, "no id"), (6, "twice")], "doc_id long, text string")
    manifest = token_files.write_token_files(docs, folder, path, frame=4 << 10)
    every = token_files.frames(manifest, folder).count()
    asked = [4, 6, 7, 301, 398, 10_000]
    few = token_files.frames_of(manifest, folder, asked).count()
    assert every > 40 and few <= 6
    got = sorted((r.doc_id, r.ids) for r in token_files.read_documents(manifest, folder, asked).collect())
    encode = lambda t: [*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 2]
    assert got == sorted((k, encode(t)) for k, t in [(4, data[4]), (6, data[6]), (6, "twice"), (398, data[398])])
    assert token_files.read_documents(manifest, folder, []).count() == 0


def test_frames_show_damage():
    out = io.BytesIO()
    writer = token_files.FrameWriter(out, 2, frame=64)
    for k in range(20):
        writer.add(k, np.arange(k + 5))
    writer.close()
    table = token_files.seek_table(out)
    assert len(table) > 3
    found = [x for row in table for x in token_files.read_frame(out, *row)]
    assert [(i, list(x)) for i, x in found] == [(k, list(range(k + 5))) for k in range(20)]
    raw = bytearray(out.getvalue())
    raw[table[1][0] + table[1][1] // 2] ^= 0xFF
    with pytest.raises(ValueError):
        token_files.read_frame(io.BytesIO(bytes(raw)), *table[1])


@pytest.mark.parametrize(("name", "word_level"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_encoder_equals_library(name, word_level):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_path(name))
    odd = ["", " ", "  a  b", "don't we'll", "a\n\n b\tc", "Ünïcödé x１２３ 漢字", "x" * 300, "1234 5,6.7", "<|endoftext|> a", " lead", "trail ", "é" * 50, "a 'm b's"]
    got = tokens.Encoder(default_path(name), word_level).encode(odd)
    assert [list(np.frombuffer(x, "<u4")) for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in odd]


def test_license(spark):
    data = [(1, "Licensed under the Apache License, Version 2.0. All rights reserved."), (2, "GNU General  Public-License v3 or later"), (3, "CC BY 4.0, cc-by"), (4, None), (5, "nothing"), (6, "permission is hereby granted, free of charge, to any person obtaining a copy")]
    out = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert (out[1].base_labels, out[1].n_base, out[1].first_word, out[1].n_words) == ("reserved", 1, 8, 11)
    assert "apache-2.0" in out[1].labels
    assert (out[2].base_labels, out[2].first_word) == ("gpl", 1)
    assert "gpl-3.0-or-later" in out[2].labels
    assert (out[3].n_base, out[3].first_word, out[3].last_word) == (2, 0, 4)
    assert (out[4].n_words, out[4].labels, out[4].score, out[4].first_word) == (0, "", 0.0, None)
    assert out[5].labels == "" and out[6].labels == "mit"
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in out.values())


def brute_licenses(text):
    """n_words, n_base, first_word, last_word, base_labels, labels, score by Python's regular expressions."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    norm = f" {' '.join(words)} "
    places, base = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        places += at
        base |= {label} if at else set()
    hits = [(m.start() + 1, -m.end(), -r.priority, k, r.label) for k, r in enumerate(license_scan.RULES) if r.keyword in norm for m in re.finditer(f" (?:{r.pattern})(?= )", norm)]
    kept = []
    for start, neg_stop, neg_priority, _, label in sorted(hits):
        if not any(s <= start and -neg_stop <= e and p >= -neg_priority for s, e, p, _ in kept):
            kept.append((start, -neg_stop, -neg_priority, label))
    best = max((p for *_, p, _ in kept), default=0)
    score = {3: 1.0, 2: 0.8, 1: 0.5, 0: 0.5 if places else 0.0}[best]
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[-1] for x in kept})), score)


def test_license_equals_brute_force(spark, docs):
    draw = random.Random(15)
    lines = ["licensed under the", "apache license version 2 0", "GNU General Public License", "either version 2 or any later version", "CC BY-SA 4.0", "cc by nc nd 3.0", "creative commons attribution share alike 4 0", "all rights reserved", "SPDX-License-Identifier: GPL-2.0 or later", "lgpl v2.1", "the MIT license", "copyright (c) 2019", "public domain", "for personal use only", "bsd 3 clause", "proprietary and confidential", "ISC licence", "mozilla public license v2.0", "é ü", "what the", "permission", "version 3", "or later"]
    rows = [(k, " ".join(draw.choice(lines) if draw.random() < 0.6 else draw.choice(WORDS) for _ in range(draw.randint(0, 12)))) for k in range(300)]
    own = spark.createDataFrame([*rows, (900, None), (901, " \n")], "doc_id long, text string")
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id") + 1000, "text")
    every = own.union(docs.select(F.col("doc_id") + 2000, "text")).union(table)
    text = {r.doc_id: r.text for r in every.collect()}
    for r in license_scan.license_scan(every).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute_licenses(text[r.doc_id]), text[r.doc_id]


def test_html(spark):
    page = "<html><head><title>t</title><script>if (a<b) x()</script></head><body><nav><a href=1>Home</a></nav><div class='ad'>Buy this now or never</div><article><h1>The &amp; title</h1><p>A first paragraph with <b>some</b>\n words in it.</p><p>And a second one &eacute;.</p></article><div class=comments><p>Nice post, thanks for it!</p></div><footer>Imprint</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 2), (3, "u", "", 3), (4, "u", "<p", 4)], "page_id long, url string, html string, text int")
    out = {r.page_id: r for r in html_extract.html_extract(rows).collect()}
    assert out[1].text == "The & title\nA first paragraph with some words in it.\nAnd a second one é."
    assert out[1].n_chars == len(out[1].text)
    assert [out[k].text for k in (2, 3, 4)] == ["", "", ""]


def test_empty_tables(spark, docs, labels):
    none, no_labels = docs.where("false"), labels.where("false")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (
        exact_dedup(none), simhash.simhash_groups(none), substring_dedup.substring_dedup(none), mixing.mix(none), mixing.mix_counts(none), packing.pack_documents(none),
        license_scan.license_scan(none), token_files.token_round_trip(none), html_extract.html_extract(pages), quality_rules.quality_rules(none, no_labels), toxicity.toxicity(none, no_labels),
    ):
        assert out.count() == 0
    assert toxicity.toxicity(docs, no_labels).select("score").distinct().count() == 1


def test_null_ids_and_repeated_rows(spark, labels):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, None), (1, None), (2, "a b c")], "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s")})
    for out in (exact_dedup(docs), simhash.simhash_groups(docs), substring_dedup.substring_dedup(docs), mixing.mix_counts(docs), packing.pack_documents(docs), license_scan.license_scan(docs), token_files.token_round_trip(docs), quality_rules.quality_rules(docs, labels), toxicity.toxicity(docs, labels)):
        assert out.count() == 5
    assert exact_dedup(docs).where("kept").count() == 2
