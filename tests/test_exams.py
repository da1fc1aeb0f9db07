"""Transcripts, evidence, grammar, vocabulary and exam documents, against plain Python and values worked by hand."""

from __future__ import annotations

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from marktide.functions.exams import repaired
from marktide.functions.values import item_key, mark_seconds, marked_time
from marktide.operators import alignment, vocabulary
from marktide.sources import docx

SCRIPT = "(0:10 - 0:20)\nThe caller says the answer is error and asks for help.\n\n(1:15 - 1:25)\nThe agent repeats the word error while explaining the follow-up process.\n"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def texts(xs):
    return F.array(*map(F.lit, xs))


def test_anchor_by_order(spark):
    anchor = lambda correct, answers, k: one(spark, alignment.answer_anchor(F.lit(SCRIPT), F.lit(correct), texts(answers), F.lit(k)))
    assert anchor("error", ["error", "other"], 0) == 10
    assert anchor("error", ["error", "error"], 1) == 75
    assert anchor("not present", ["not present"], 0) is None
    assert anchor("the agent / x", ["y"], 7) == 75
    assert one(spark, alignment.hint_anchor(F.lit(SCRIPT), F.lit("follow-up process"))) == 75


def test_citations(spark):
    settle = lambda draft, correct, **more: one(spark, alignment.settled_citations(F.lit(draft), F.lit(SCRIPT), F.lit(correct), **more))
    listed = {"answers": texts(["error", "other"]), "index": F.lit(0)}
    assert settle("The answer is error. Listen again: [1:15]", "error", **listed) == "The answer is error. Listen again: [0:10]"
    assert "[1:15]" not in settle("The answer is error. Listen again: [0:00]", "not present")
    assert settle("See [1:15] and [2:00].", "caller") == "See [0:10] and."
    assert settle("See (1:10 - 1:20).", "not present") == "See [1:15]."
    assert settle("Nothing cited.  ", "caller") == "Nothing cited.\n\nListen again: [0:10]"
    assert one(spark, alignment.settled_citations(F.lit("At [1:15]."), F.lit("no marks"), F.lit("x"))) == "At."


def plain(x):
    return " ".join(re.findall("[a-z0-9]+", x.lower()))


def brute_anchor(script, correct, answers, index):
    marks = list(re.finditer(r"\((\d{1,2}):(\d{2})\s*-\s*\d{1,2}:\d{2}\)", script))
    stops = [m.start() for m in marks[1:]] + [len(script)] * bool(marks)
    blocks = [(int(m[1]) * 60 + int(m[2]), f" {plain(script[m.end():e])} ") for m, e in zip(marks, stops, strict=True)]

    def ways(x, articles):
        out = {plain(p) for p in re.split(r"(?i)\s*(?:/|;|\||\bor\b)\s*", x)}
        out |= {re.sub("^(?:a|an|the) +", "", p) for p in out} if articles else set()
        return sorted((p for p in out if len(p) >= 3 and not p.isdigit()), key=lambda p: (-len(p), p))

    for way in ways(correct, True):
        hits = [s for s, t in blocks if f" {way} " in t]
        if len(hits) == 1:
            return hits[0]
    cursor = -1
    for k, answer in enumerate(answers[: index + 1] if 0 <= index < len(answers) else []):
        places = [b for b, (_, t) in enumerate(blocks) if b > cursor and any(f" {w} " in t for w in ways(answer, False))]
        if places:
            cursor = places[0]
            if k == index:
                return blocks[cursor][0]
    return None


def test_anchors_equal_plain_python(spark):
    draw, words = random.Random(3), "a the mill error wheel or of stone 12 river".split()
    rows = []
    for n in range(300):
        script = "".join(f"({k}:{draw.randint(10, 59)} - {k + 1}:00)\n{' '.join(draw.choices(words, k=6))}\n" for k in range(draw.randint(0, 5)))
        answers = [" / ".join(" ".join(draw.choices(words, k=draw.randint(1, 2))) for _ in range(draw.randint(1, 2))) for _ in range(3)]
        index = draw.randint(-1, 3)
        rows.append((n, script, draw.choice(answers) if index not in range(3) else answers[index], answers, index))
    df = spark.createDataFrame(rows, "n int, script string, correct string, answers array<string>, i int")
    got = {r.n: r.at for r in df.select("n", alignment.answer_anchor(F.col("script"), F.col("correct"), F.col("answers"), F.col("i")).alias("at")).collect()}
    assert got == {n: brute_anchor(*x) for n, *x in rows}
    assert len(set(got.values())) > 20


def test_times(spark):
    assert [one(spark, marked_time(F.lit(x))) for x in (0, 75, 3675, -4)] == ["0:00", "1:15", "1:01:15", "0:00"]
    assert [one(spark, mark_seconds(F.lit(x))) for x in ("1:15", "1:01:15", "x", "")] == [75, 3675, None, None]


def test_keys_without_marks(spark):
    assert one(spark, item_key(F.lit("Nguyễn Thị Ngọc Ánh"))) == "nguyen thi ngoc anh"
    assert one(spark, item_key(F.lit("e\u0301lan"))) == "elan"
    assert one(spark, repaired(F.lit("a " + "→".encode().decode("cp1252", "replace") + " " + "é".encode().decode("cp1252")))) in ("a → Ã©", "a â†’ Ã©")


def test_grammar(spark):
    found = lambda t: {r["key"]: r["sentence"] for r in one(spark, alignment.grammar_items(F.lit(t)))}
    assert found("Not only but also they came. If had gone he would have won.") == {"not_only": "Not only but also they came.", "third_cond": "If had gone he would have won."}
    assert set(found("Never had it been so. It is said to rain; the bigger the box, the heavier the load.")) == {"neg_inversion", "passive_report", "correlative_comp"}
    assert set(found("It was my brother who came.")) == {"cleft_it"} and found("Ébut nothing only") == {}


def test_proof(spark):
    passage = "The mill was built in 1790. It burned down twice. Nobody knows the builder's name, and no record of it is left."
    show = lambda draft, correct="1790": one(spark, alignment.proven(F.lit(draft), F.lit(passage), F.lit(correct), F.lit("when was the mill built")))
    assert show("See [[EVIDENCE: burned  down TWICE]] and [[EVIDENCE: not there]].") == "See “burned  down TWICE” and “not there”.\n\n[[EVIDENCE: burned  down TWICE]]"
    assert show("As it says, the mill was built in 1790. [[EVIDENCE: x]]") == "As it says, the mill was built in 1790. “x”"
    assert show("Nothing.") == "Nothing.\n\n[[EVIDENCE: The mill was built in 1790.]]"


def test_vocabulary_rules(spark):
    """Expected decisions: evidence for idioms, verbs cut to their head, trivial and dropped items."""
    rows = [("carry out the plan", "collocation", None), ("look at", "collocation", None), ("to look at", "collocation", None), ("kick the bucket", "idiom", True), ("kick a bucket", "idiom", None), ("bear fruit", "word", None), ("to carry on", "word", None), ("to carry on", "phrasal_verb", None), ("x", "__drop__", None), ("depend on", "phrasal verb", None)]
    items = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, word string, category string, figurative boolean")
    got = {r.k: (r.word, r.category) for r in vocabulary.categories(items, spark.createDataFrame([("depend on",)], "phrase string"), spark.createDataFrame([("look",)], "verb string")).collect()}
    assert got == {0: ("carry out", "phrasal_verb"), 2: ("to look at", "collocation"), 3: ("kick the bucket", "idiom"), 4: ("kick a bucket", "collocation"), 5: ("bear fruit", "idiom"), 6: ("to carry on", "collocation"), 7: ("carry on", "phrasal_verb"), 9: ("depend on", "collocation")}
    low = items.where("k = 3").withColumn("confidence", F.lit("low"))
    assert vocabulary.categories(low, spark.createDataFrame([], "phrase string"), spark.createDataFrame([], "verb string")).first().category == "collocation"


def test_markers_open_blocks_at_the_start_of_lines(spark):
    blocks = lambda t: [(r["second"], r["text"].strip()) for r in one(spark, alignment.marked_blocks(F.lit(t)))]
    inside = "(0:10 - 0:20) the wheel (0:30 - 0:40) the mill"
    assert blocks(inside) == [(10, "the wheel 0 30 0 40 the mill")]
    assert one(spark, alignment.answer_anchor(F.lit(inside), F.lit("mill"))) == 10
    assert blocks("Part 1 (0:05 - 0:09)\nhello (0:06 - 0:07) you\n  (0:10 - 0:20) more\n\n(1:02:03 - 1:02:09) end") == [(5, "hello 0 06 0 07 you"), (10, "more"), (3723, "end")]
    assert blocks("no marker") == blocks("") == []


def test_leading_prepositions_end_at_a_word_boundary(spark):
    rows = [(1, "to-infinitive + V"), (2, "to + V"), (3, "today + V"), (4, "in/on + noun"), (5, "be + to-infinitive")]
    items = spark.createDataFrame([(k, w, "grammar") for k, w in rows], "k int, word string, category string")
    got = {r.k: r.category for r in vocabulary.categories(items, spark.createDataFrame([], "phrase string"), spark.createDataFrame([], "verb string")).collect()}
    assert got[1] == got[2] == got[4] == "collocation" and got[3] == got[5] == "grammar"


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def document(body, **members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def p(text, run="", paragraph=""):
    return f"<w:p>{paragraph and f'<w:pPr>{paragraph}</w:pPr>'}<w:r>{run and f'<w:rPr>{run}</w:rPr>'}<w:t>{text}</w:t></w:r></w:p>"


EXAM = ["[TITLE] Mills", "[TYPE] Listening", "[TIME] 45 minutes", "[PASSAGE]", "An old mill.", "[QUESTIONS]", "[CHOICE]", "[CONTEXT]", "Questions 1-2 TRUE, FALSE or NOT GIVEN", "[/CONTEXT]", "Do these agree? true, false or not given", "1. It burned.", "*FALSE", "2. It is old.", "*MAYBE",
        "[MATCHING]", "A. river", "B. wheel", "Question 3 It turned.", "*wheel", "*B", "4) It flows.", "*a", "[PASSAGE]", "Second.", "[QUESTIONS]", "[CHOICE_MULTIPLE]", "5. Choose two", "A. one", "B. two", "C. three", "*C", "*A", "[DRAG]", "[CONTEXT]", "[6] is wet and", "so [7] is", "[/CONTEXT]", "A. rain", "B. snow", "6. first", "*B", "[SHORT_ANSWER]", "8. Who?", "and when?", "*Anna / Ann"]


def test_exam_documents(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(document("".join(map(p, EXAM))))
    (tmp_path / "b.docx").write_bytes(b"no archive")
    (tmp_path / "c.docx").write_bytes(document(""))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    read = docx.read_lines(files)
    assert [r.error for r in read.where("error is not null").collect()] == ["not a Word document"]
    assert tuple(docx.exam_heads(read.where("error is null")).first())[1:] == ("Mills", "Listening", 45, "")
    q = docx.read_exams(files).orderBy("number").collect()
    assert [(r.number, r.passage_index, r.kind, r.text, r.place, r.unmatched) for r in q] == [
        (1, 0, "CHOICE", "It burned.", 1, False), (2, 0, "CHOICE", "It is old.", None, True), (3, 0, "MATCHING", "It turned.", None, True), (4, 0, "MATCHING", "It flows.", 0, False),
        (5, 1, "CHOICE_MULTIPLE", "Choose two", None, False), (6, 1, "DRAG_DROP", "first", None, False), (7, 1, "BLANK", "Who? and when?", None, False),
    ]
    assert q[0].options == ["TRUE", "FALSE", "NOT GIVEN"] and q[2].options == q[3].options == ["A. river", "B. wheel"]
    assert q[4].places == [2, 0] and (q[5].answer, q[5].subtype) == ("snow", "SUMMARY_DRAG") and q[6].answer == "Anna / Ann"
    assert q[0].context == "<div>Questions 1-2 TRUE, FALSE or NOT GIVEN</div>" and q[0].instruction.startswith("Do these agree")


def test_document_marks():
    bold, center = "<w:b/>", '<w:jc w:val="center"/>'
    cell = lambda x: f"<w:tc>{p(x)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1 &lt; 2')}{cell('')}</w:tr></w:tbl>"
    got = docx.lines(document(p("Head", "", '<w:pStyle w:val="Heading2"/>') + p("x &amp; y", bold + "<w:i/>") + p("mid", '<w:b w:val="0"/><w:u w:val="single"/>', center) + p("point", "", "<w:numPr/>") + p("  ") + table))
    assert got == [
        ("<h2>Head</h2>", "Head"), ("<em><strong>x &amp; y</strong></em>", "x & y"), ('<div style="text-align:center"><u>mid</u></div>', "mid"), ('<div class="item">point</div>', "point"),
        ("<table><tbody><tr><th><div>a</div></th><th><div>b</div></th></tr><tr><td><div>1 &lt; 2</div></td><td></td></tr></tbody></table>", "[TABLE]"),
    ]


def test_document_limits(monkeypatch):
    good = document(p("x"))
    assert docx.lines(good)
    monkeypatch.setattr(docx, "MAX_BYTES", len(good) - 1)
    with pytest.raises(ValueError, match="file is too large"):
        docx.lines(good)
    monkeypatch.undo()
    monkeypatch.setattr(docx, "MAX_UNZIPPED", 10_000)
    with pytest.raises(ValueError, match="archive is too large"):
        docx.lines(document(p("x" * 20_000)))
    monkeypatch.undo()
    monkeypatch.setattr(docx, "MAX_MEMBERS", 3)
    with pytest.raises(ValueError, match="archive is too large"):
        docx.lines(document(p("x"), a="1", b="2"))
    locked = bytearray(good)
    locked[locked.index(b"PK\x01\x02") + 8] |= 1
    monkeypatch.undo()
    with pytest.raises(ValueError, match="encrypted"):
        docx.lines(bytes(locked))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<x/>")
    with pytest.raises(ValueError, match="not a Word"):
        docx.lines(out.getvalue())
