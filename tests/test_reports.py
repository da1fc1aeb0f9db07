"""Exam texts, vocabulary, records and spreadsheets, worked by hand."""

from __future__ import annotations

import base64
import datetime as dt
import io
import re
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from marktide.functions import exams
from marktide.operators import records, vocabulary
from marktide.sources import xlsx


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("line", "want"),
    [("A. cat", True), ("b) cat", True), ("C", True), ("iv. Heading", True), ("iv.) Heading", True), ("D Smith", True), ("A boy walked", False), ("I am here", False), ("I Claudius", True), ("Z Smith", False), ("D " + "x" * 90, False), ("plain", False), ("", False), (None, False)],
)
def test_is_option(spark, line, want):
    assert one(spark, exams.is_option(F.lit(line).cast("string"))) == want


def test_answers(spark):
    options = F.array(F.lit("A. red"), F.lit("B. blue"), F.lit("green"))
    place = lambda x: one(spark, exams.answer_place(options, F.lit(x).cast("string")))
    assert [place(x) for x in ("b", "A. RED", "C", "green ", "D", None)] == [1, 0, 2, 2, None, None]
    assert one(spark, exams.answer_places(options, F.array(F.lit("C"), F.lit("Q"), F.lit("A")))) == [2, 0]
    assert [one(spark, exams.bank_word(options, F.lit(x))) for x in ("b", "K", "sky")] == ["blue", "K", "sky"]
    assert one(spark, exams.stated_options(F.lit("True, False or Not  Given"), F.lit(None).cast("array<string>"))) == ["TRUE", "FALSE", "NOT GIVEN"]


def test_audio(spark):
    key = lambda raw: base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")
    assert one(spark, exams.audio_key(F.lit(key("exam-audio/ü|t|k")))) == ("exam-audio/ü", "t|k")
    for bad in (key("other/a|t"), key("exam-audio/a|"), key("exam-audio/a"), "!!", ""):
        assert one(spark, exams.audio_key(F.lit(bad))) is None


@pytest.mark.parametrize(
    ("text", "want"),
    [("[1, 2]", ["1", "2"]), ('{"a": "[9]", "b": [3]}', ["3"]), ('```json\n[{"w": "x"}]\n```', ['{"w":"x"}']), ("see [1] and", ["1"]), ("[1, 2", None), ('{"items": []}', []), ("", None), (None, None)],
)
def test_json_items(spark, text, want):
    assert one(spark, exams.json_items(F.lit(text).cast("string"))) == want


def test_markup(spark):
    masked = one(spark, exams.masked(F.lit("<p class='a1'>Say [12] 3. two ____</p>")))
    assert re.fullmatch(r"<p class='a1'>█{2,8} \[12\] 3\. █{2,8} ____</p>", masked)
    clean = lambda x: one(spark, exams.clean_markup(F.lit(x), "@"))
    assert clean('[Image 3]<p style="color: red; margin:0">x</p>') == '<p style=" margin:0">x</p>'
    assert clean('<b style="background-color:#fff">x</b>') == "<b>x</b>"
    assert clean("<div>↓</div>a\n->\nb") == "<div>@</div>a@\nb"
    assert clean("https://a.b/c.png") == '<img src="https://a.b/c.png" alt="" />'
    assert clean('<img src="https://a.b/c.png">') == '<img src="https://a.b/c.png">'
    assert clean('<font color="red">x</font>') == "<span>x</span>"


@pytest.mark.parametrize(
    ("word", "example", "want"),
    [("run", "I Run, you run", "I ____, you run"), ("walk", "She walked home", "She ____ home"), ("make", "He is making it", "He is ____ it"), ("a.b", "axb a.b", "axb ____"), ("cat", "no match", None), ("", "x", None)],
)
def test_gapped(spark, word, example, want):
    assert one(spark, vocabulary.gapped(F.lit(word), F.lit(example), "____")) == want


def test_game_round(spark):
    rows = [("p", k, f"w{k % 6}" if k > 8 else f"W{k % 6}") for k in range(20)]
    cards = spark.createDataFrame(rows, "pool string, card_id long, word string")
    got = vocabulary.game_round(cards, "pool", ante=1).collect()
    targets, decoys = ([r.word.lower() for r in got if r.role == x] for x in ("target", "decoy"))
    assert len(targets) == 4
    assert len(decoys) == len(set(decoys)) <= 2
    assert not set(targets) & set(decoys)
    assert {r.card_id for r in got} == {r.card_id for r in vocabulary.game_round(cards.repartition(3), "pool", ante=1).collect()}


def test_categories(spark):
    rows = [("give up hope", "word"), ("time flies", "idiom"), ("is in", "phrasal verb"), ("have been", "grammar"), ("not only ... but", "grammar"), ("deal with", "phrasal"), ("blue", "idiom"), ("x", None)]
    items = spark.createDataFrame(rows, "word string, category string")
    empty = spark.createDataFrame([], "phrase string, verb string")
    got = {r.word: r.category for r in vocabulary.categories(items, empty.select("phrase"), empty.select("verb")).collect()}
    assert got == {"give up": "phrasal_verb", "time flies": "collocation", "not only ... but": "grammar", "deal with": "collocation", "blue": "word", "x": "word"}


def test_incidents(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", t(s), k, p) for k, (s, p) in enumerate([(0, True), (2, True), (4, True), (8, True), (14, True), (16, False), (18, True), (40, True), (42, True)])]
    got = records.incidents(spark.createDataFrame(rows, "who string, at timestamp, n int, p boolean"), ["who"], "at", "n", "p").collect()
    assert sorted(r["at"] for r in got) == [t(2), t(14), t(40)]


def test_xlsx(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "a<b", None), (2, "ü\x01", 2.5), (3, None, float("nan"))], "n int, s string, x double").coalesce(1)
    files = xlsx.write_xlsx(df, f"file://{tmp_path}/out", "Title", header=["N", "S", "X"]).collect()
    assert sum(r.n_rows for r in files) == 3
    with zipfile.ZipFile(io.BytesIO((tmp_path / "out" / files[0].path).read_bytes())) as z:
        root = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
        for name in z.namelist():
            ElementTree.fromstring(z.read(name))
    cells = [["".join(c.itertext()) for c in r] for r in root[0]]
    assert cells == [["Title"], ["N", "S", "X"], ["1", "a<b", ""], ["2", "ü", "2.5"], ["3", "", ""]]
