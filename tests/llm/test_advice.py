"""Places where the operators once did less than the whole job."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import product
from re import _parser as sre

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marktide.llm import html_extract, license_scan, mixing, quality_rules


def labelled(spark, sizes):
    """Good labelled documents without any junk, and one junk document without a label for each language."""
    clean = " ".join(f"w{k}" for k in range(60))
    rows = [(f"{lang}{k}", clean, lang) for lang, n in sizes.items() for k in range(n)] + [(f"{lang}-junk", clean + " # * $ % & | < > # *", lang) for lang in sizes]
    docs = spark.createDataFrame([(k, text, lang, name) for k, (name, text, lang) in enumerate(rows)], "doc_id long, text string, lang string, name string")
    return docs, docs.where("name not like '%junk'").select("doc_id", F.lit(1).alias("quality"))


def test_rules_reject_with_enough_labels(spark):
    docs, labels = labelled(spark, {"en": 600, "es": 30, "nl": 0})
    out = {r.name for r in quality_rules.quality_filter(docs, labels).collect()}
    # es and nl have no certificate of their own and lose nothing to cutoffs
    assert {x for x in out if x.endswith("junk")} == {"es-junk", "nl-junk"} and len(out) == 632
    few, labels = labelled(spark, {"en": 200, "es": 30})
    assert quality_rules.quality_filter(few, labels).count() == 232


def brute_cutoffs(strata):
    """strata: name to the vectors of features of its good documents. The certified step of each."""
    from math import comb

    out = {}
    for name, rows in strata.items():
        n, level, step = len(rows), quality_rules.LEVEL / len(strata), -1
        tail = lambda k, n=n: sum(comb(n, i) * quality_rules.RISK**i * (1 - quality_rules.RISK) ** (n - i) for i in range(k + 1))
        for j, v in enumerate(quality_rules.VECTORS):
            k = sum(any(x > c for x, c in zip(row, v, strict=True)) for row in rows)
            if k >= n * quality_rules.RISK or tail(k) > level:
                break
            step = j
        out[name] = quality_rules.VECTORS[step] if step >= 0 else None
    return out


def test_cutoffs_equal_brute_force_and_keep_the_risk(spark):
    draw = random.Random(4)
    good = lambda: [draw.expovariate(1 / m) for m in (0.02, 0.02, 0.06, 0.05, 0.05)]
    strata = {"a": [good() for _ in range(3000)], "b": [good() for _ in range(900)], "c": [good() for _ in range(90)]}
    rules = list(quality_rules.CUTOFFS)
    rows = [(s, *x) for s, xs in strata.items() for x in xs]
    frame = spark.createDataFrame(rows, "stratum string, " + ", ".join(f"{r} double" for r in rules))
    got = {r._llm_stratum: r._llm_cutoffs for r in quality_rules.certified_cutoffs(frame).collect()}
    want = brute_cutoffs(strata)
    assert got == want and got["a"] is not None and got["c"] is None
    fresh = [good() for _ in range(20_000)]
    for cut in (c for c in got.values() if c):
        assert sum(any(x > c for x, c in zip(row, cut, strict=True)) for row in fresh) <= quality_rules.RISK * len(fresh)


def test_cutoffs_bind_and_only_where_they_are_certified(spark):
    """On sf0.1 cutoffs reject documents that the base passes, and none in a language that has too few labels."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    judged = quality_rules.quality_rules(docs, labels).join(docs.select("doc_id", "lang"), "doc_id")
    lost = {r.lang: r.n for r in judged.where("NOT base_failed AND NOT kept").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    good = labels.where("quality = 1").select("doc_id").distinct().join(docs.select("doc_id", "lang"), "doc_id")
    have = {r.lang: r.n for r in good.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    certain = {k for k, n in have.items() if (1 - quality_rules.RISK) ** n <= quality_rules.LEVEL / len(have)}
    assert lost and sum(lost.values()) > 50 and set(lost) <= certain


def test_repeats_of_long_texts_are_counted_alike(spark, monkeypatch):
    draw = random.Random(8)
    words = [f"w{draw.randrange(20)}" for _ in range(3000)]
    docs = spark.createDataFrame([(" ".join(words),), ("a b c a b c",), ("a b c d",)], "text string")
    count = lambda: [r.n_repeat_words for r in quality_rules.with_features(docs).collect()]
    packed = count()
    monkeypatch.setattr(quality_rules, "PACKED_WORDS", 3)
    assert count() == packed and packed[0] > 0 and packed[1:] == [6, 0]


def test_no_rate_is_too_high(spark):
    sizes = spark.createDataFrame([("big", 10_000_000.0)] * 20 + [("", 1.0)], "source string, n double").withColumn("source", F.when(F.col("source") == "big", F.concat("source", F.monotonically_increasing_id())).otherwise(F.col("source")))
    high = {r.source_key: r.rate for r in mixing.rates(sizes, size=F.col("n")).collect()}[""]
    assert 100 < high < 300
    one = F.col("id").cast("string")
    for rate in (20.5, high, 5000.0):
        got = spark.range(2000).select(mixing.poisson_copies(one, F.lit(rate)).alias("k")).agg(F.avg("k"), F.var_samp("k")).first()
        assert abs(got[0] - rate) < 5 * (rate / 2000) ** 0.5 and abs(got[1] / rate - 1) < 0.2


def test_a_small_source_mixes(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 0, "big").alias("source"))
    weights = {"big": 1.0, "": 30.0}
    want = {r.doc_id: r.copies for r in mixing.mix_counts(docs, weights).where("copies > 0").collect()}
    assert 1700 < want[0] < 2200
    assert {r.doc_id: r["count"] for r in mixing.mix(docs, weights).groupBy("doc_id").count().collect()} == want


def test_stages_with_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(400))
    other = " ".join(f"v{k}" for k in range(400))
    rows = [(None, "only here"), (None, "only here"), (1, text), (1, text), (1, other), (2, text), (3, other), (None, text), (4, "alone"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    want = sorted([(None, "only here"), (1, text), (1, other), (4, "alone"), (None, None)], key=str)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == want
    near = docs.where("doc_id is null or doc_id > 3").union(docs.where("text is null").withColumn("text", F.lit(" ")))
    assert corpus_pipeline.near(spark, near, "").where("text is null or text = ' '").count() == 1


ARTICLE = "<h1>Rain over the valley</h1><p>The rain began early in the morning and did not stop before night fell.</p><p>People had waited for it since the end of May.</p>"
TEXT = "Rain over the valley\nThe rain began early in the morning and did not stop before night fell.\nPeople had waited for it since the end of May."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title></head><body><div class='content with-sidebar'>{ARTICLE}</div><div class=sidebar><p>Buy now</p></div></body></html>",
        f"<body><div class=no-sidebar><section class='entry has-comments'>{ARTICLE}</section></div></body>",
        f"<body><div class='search-results hidden-xs'>{ARTICLE}</div><div class=ad>Buy this</div></body>",
        f"<body><form action=x><div id=search><input> Find it here</div>{ARTICLE}<aside>See also this</aside></form></body>",
        f"<!DOCTYPE html><html><head><meta charset=utf-8><title>t</title><link rel=x href=y><body>{ARTICLE}</body></html>",
        f"<html><head><title>t</title><div>{ARTICLE}</div></html>",
    ],
)
def test_pages_keep_their_article(page):
    assert html_extract.extract(page) == TEXT


def test_quotes_open_values_only():
    page = "<body><p class=don't>Hello it's me and nobody else in this house.</p><p title='a > b'>Then the <b id=\"x>y\">door</b> opened.</p><p data-x=\"open>No more.</p></body>"
    assert html_extract.extract(page) == "Hello it's me and nobody else in this house.\nThen the door opened.\nNo more."


def test_headers_of_articles_stay():
    page = f"<body><div class=site-header><p>The daily paper</p></div><article><div class='entry-header'><h1>Rain over the valley</h1></div>{ARTICLE.partition('</h1>')[2]}</article></body>"
    assert html_extract.extract(page) == TEXT


def brute_region(scores):
    sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
    return max(sums.values(), default=0.0)


def test_region_has_the_largest_sum():
    draw = random.Random(6)
    for _ in range(300):
        scores = [float(draw.randint(-4, 3)) for _ in range(draw.randint(0, 25))]
        start, stop = html_extract.best_region(scores)
        best = max(0.0, brute_region(scores))
        assert sum(scores[start:stop]) == best and (best > 0) == (stop > start)


#: Pages that the weights are not learned from: a page without any hint, and its content.
HELD_OUT = [
    ("<body><div><a href=1>Start</a> <a href=2>Shop</a> <a href=3>Help</a></div><div><h1>A walk by the sea</h1><p>We left the house before the sun was up and took the path along the cliff.</p><p>There was no wind, and the <a href=b>boats</a> lay still in the bay below us.</p></div><div>All texts by their authors</div></body>", "A walk by the sea We left the house before the sun was up and took the path along the cliff. There was no wind, and the boats lay still in the bay below us."),
    ("<body><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><div><h2>Soup for six</h2><p>Cut the leeks into rings and wash them well in cold water.</p><ul><li>six leeks and four potatoes</li><li>a litre of broth or water</li></ul><p>Let all of it boil for half an hour and serve it hot.</p></div><ul><li><a href=3>More soups</a></li><li><a href=4>More bread</a></li></ul></body>", "Soup for six Cut the leeks into rings and wash them well in cold water. six leeks and four potatoes a litre of broth or water Let all of it boil for half an hour and serve it hot."),
    ("<body><table><tr><td><a href=x>Board</a><td><a href=y>Rules</a></table><div>My radio stopped last week and nobody in town repairs such things any more.<br>So I opened it myself and found a mouse nest behind the speaker.</div><div><a href=z>Back to the board</a></div></body>", "My radio stopped last week and nobody in town repairs such things any more. So I opened it myself and found a mouse nest behind the speaker."),
    ("<body><div><div>Ten percent off today</div><a href=1>Login</a></div><section><h1>The bridge is closed</h1><p>From Monday on the bridge at the station is closed to all traffic for a month.</p><blockquote>It could not wait any longer, said the engineer of the county.</blockquote><p>Buses take the road by the hospital.</p></section><div><a href=2>Yesterday</a> <a href=3>Archive</a></div></body>", "The bridge is closed From Monday on the bridge at the station is closed to all traffic for a month. It could not wait any longer, said the engineer of the county. Buses take the road by the hospital."),
]


def share(got, want):
    both = sum((Counter(got) & Counter(want)).values())
    return both / max(1, len(got)), both / max(1, len(want))


def test_search_finds_content_without_hints():
    found = [share(html_extract.extract(page).split(), text.split()) for page, text in HELD_OUT]
    assert min(r for _, r in found) >= 0.95 and sum(p for p, _ in found) / len(found) >= 0.95


def test_search_decides_on_pages_without_hints(spark, monkeypatch):
    """Pages of the test data with all names and telling elements turned into plain ones."""
    pages = []
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        plain = re.sub(r"<(/?)(nav|header|footer|aside|article|main|form)\b[^>]*>", r"<\1div>", r.html)
        pages.append((re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", plain), html_extract.extract(r.html)))
    got = [html_extract.extract(p) for p, _ in pages]
    scores = [share(g.split(), want.split()) for g, (_, want) in zip(got, pages, strict=True)]
    assert sum(r for _, r in scores) / len(scores) >= 0.99 and sum(p for p, _ in scores) / len(scores) >= 0.9
    monkeypatch.setattr(html_extract, "best_region", lambda scores: (0, len(scores)))
    assert sum(html_extract.extract(p) != g for (p, _), g in zip(pages, got, strict=True)) > len(pages) / 2


def test_pages_with_clashing_columns_repeats_and_long_texts(spark):
    long = "<article>" + "".join(f"<p>Sentence number {k} of a very long text.</p>" for k in range(40_000)) + "</article>"
    rows = [(1, "u", "<p>One two three.</p>", "x"), (1, "u", "<p>One two three.</p>", "x"), (None, None, "<p>No id here.</p>", None), (2, "v", long, "y")]
    out = html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in out if r.page_id != 2) == [(0, "No id here."), (1, "One two three."), (1, "One two three.")]
    assert next(r.text for r in out if r.page_id == 2).count("\n") == 39_999


def test_small_named_parts_go():
    page = f"<body><div class='ad-banner'><p>Buy our new thing today</p></div><div class=main>{ARTICLE}</div><div class=comments><p>Nice post, thank you very much</p></div></body>"
    assert html_extract.extract(page) == TEXT


def written(parsed):
    """All texts that a parsed pattern matches, with one character for each class and one turn more than the least for each repeat."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            one = [chr(arg)]
        elif op == "IN":
            one = [chr(arg[0][1][0] if str(arg[0][0]) == "RANGE" else arg[0][1])]
        elif op == "BRANCH":
            one = [x for branch in arg[1] for x in written(branch)]
        elif op == "SUBPATTERN":
            one = written(arg[3])
        elif op == "MAX_REPEAT":
            low, high, inner = arg
            one = list({"".join(x) for n in {low, min(low + 1, high)} for x in product(written(inner), repeat=n)})
        else:
            raise ValueError(op)
        out = [a + b for a in out for b in one]
    return out


def test_rules_pass_their_own_filters():
    for rule in license_scan.RULES:
        for text in written(sre.parse(rule.pattern)):
            assert rule.keyword in text, (rule, text)
            assert any(g in text for g in license_scan._GATE) or "cc by" in text, (rule, text)


def test_texts_with_one_alternative_are_labelled(spark):
    texts = ["For personal use only.", "for editorial use only", "Released under the Expat license", "the X11 license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in license_scan.license_scan(docs).orderBy("doc_id").collect()] == ["editorial", "editorial", "mit", "mit"]
