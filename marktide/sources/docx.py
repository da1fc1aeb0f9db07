"""Tagged exam documents: DOCX files to lines, and lines to questions.

A document holds lines with [TITLE], [TYPE], [TIME] and [AUDIO]; [PASSAGE] begins a section, [QUESTIONS] its questions, and a
block tag ([CHOICE], [BLANK], ...) a group of them. In a block, [CONTEXT] to [/CONTEXT] is shared text, a number begins a
question, options follow a letter or a numeral, and a star marks an answer. Reading a file is Python; what its lines mean is
windows over them, in order, one document a partition of the window.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marktide.functions import exams
from marktide.operators.submission import shared_options

# Limits of an upload, the members that make a Word document, the tags of blocks.
MAX_BYTES, MAX_UNZIPPED, MAX_MEMBERS = 20 << 20, 60 << 20, 2500
NEEDED = ("[Content_Types].xml", "word/document.xml")
BLOCKS = ["BLANK", "CHOICE", "CHOICE_MULTIPLE", "MATCHING", "DRAG_DROP", "DRAG", "SHORT_ANSWER"]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def body(raw: bytes) -> ElementTree.Element:
    """The body of a document; a ValueError for what is no Word document or exceeds a limit."""
    if len(raw) > MAX_BYTES:
        raise ValueError("the file is too large")
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            if len(z.infolist()) > MAX_MEMBERS or sum(i.file_size for i in z.infolist()) > MAX_UNZIPPED:
                raise ValueError("the archive is too large")
            if any(i.flag_bits & 1 for i in z.infolist()):
                raise ValueError("the archive is encrypted")
            if not set(NEEDED) <= set(z.namelist()):
                raise ValueError("not a Word document")
            found = ElementTree.fromstring(z.read(NEEDED[1])).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError("not a Word document") from e
    if found is None:
        raise ValueError("not a Word document")
    return found


def _run_text(run: ElementTree.Element) -> str:
    return "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else x.text or "" for x in run if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr"))


def _on(properties: ElementTree.Element | None, name: str) -> bool:
    x = None if properties is None else properties.find(f"{_W}{name}")
    return x is not None and x.get(f"{_W}val", "1") not in ("0", "false", "none")


def paragraph_html(p: ElementTree.Element) -> str:
    """A paragraph with bold, italic and underlined runs, its heading level, list mark and alignment; empty without text."""
    out = []
    for run in p.iter(f"{_W}r"):
        text = html.escape(_run_text(run), quote=False).replace("\t", "&nbsp;" * 4).replace("  ", "&nbsp;" * 2).replace("\n", "<br/>")
        if text:
            for mark, tag in (("b", "strong"), ("i", "em"), ("u", "u")):
                text = f"<{tag}>{text}</{tag}>" if _on(run.find(f"{_W}rPr"), mark) else text
            out.append(text)
    found, properties = "".join(out), p.find(f"{_W}pPr")
    if not found.replace("&nbsp;", "").strip():
        return ""
    get = lambda name: (properties.find(f"{_W}{name}").get(f"{_W}val", "") if properties is not None and properties.find(f"{_W}{name}") is not None else "")
    style, align = get("pStyle").lower(), {"center": "center", "right": "right", "end": "right", "both": "justify"}.get(get("jc"), "")
    shown = f' style="text-align:{align}"' if align else ""
    if level := re.search(r"heading ?([123])", style):
        return f"<h{level[1]}{shown}>{found}</h{level[1]}>"
    if "list" in style or "bullet" in style or (properties is not None and properties.find(f"{_W}numPr") is not None):
        return f'<div class="item"{shown}>{found}</div>'
    return f"<div{shown}>{found}</div>" if shown else found


def _grid(t: ElementTree.Element) -> list[list[ElementTree.Element | None]]:
    """The cells of a table at each place of its grid: a merged cell stands at all of its places. As many columns as the first row has."""
    rows: list[list[ElementTree.Element | None]] = []
    for row in t.findall(f"{_W}tr"):
        out: list[ElementTree.Element | None] = []
        for c in row.findall(f"{_W}tc"):
            properties = c.find(f"{_W}tcPr")
            get = lambda name, p=properties: None if p is None else p.find(f"{_W}{name}")
            span, merge = get("gridSpan"), get("vMerge")
            goes_on = merge is not None and merge.get(f"{_W}val", "continue") == "continue"
            for _ in range(max(1, int(span.get(f"{_W}val", "1"))) if span is not None else 1):
                k = len(out)
                out.append(rows[-1][k] if goes_on and rows and k < len(rows[-1]) else c)
        rows.append(out)
    width = len(rows[0]) if rows else 0
    return [(r + [None] * width)[:width] for r in rows]


def table_html(t: ElementTree.Element) -> str:
    """A table with its cells' own paragraphs (not those of tables in them); the first row is the head."""
    rows = []
    for k, row in enumerate(_grid(t)):
        tag = "td" if k else "th"
        cells = ("".join(f"<div>{x}</div>" for x in map(paragraph_html, () if c is None else c.findall(f"{_W}p")) if x) for c in row)
        rows.append("<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>")
    return "<table><tbody>" + "".join(rows) + "</tbody></table>" if rows else ""


def lines(raw: bytes) -> list[tuple[str, str]]:
    """(html, text) of the paragraphs and tables of a document that are not empty; a table's text is [TABLE]."""
    out = []
    for x in body(raw):
        if x.tag == f"{_W}p" and (h := paragraph_html(x)):
            out.append((h, re.sub("<[^>]+>", "", h).replace("&nbsp;", " ").strip()))
        elif x.tag == f"{_W}tbl" and (h := table_html(x)):
            out.append((h, "[TABLE]"))
    return [(h, html.unescape(t)) for h, t in out]


def read_lines(files: DataFrame) -> DataFrame:
    """files as spark.read.format("binaryFile") gives them: path, line_no, html, text; a bad file is one line with error."""

    def one(raw: bytes) -> list[dict]:
        try:
            return [{"html": h, "text": t, "error": None} for h, t in lines(raw)]
        except ValueError as e:
            return [{"html": None, "text": None, "error": str(e)}]

    def run(content: pd.Series) -> pd.Series:
        return content.map(one)

    return files.select("path", F.posexplode(F.pandas_udf(run, "array<struct<html:string,text:string,error:string>>")("content")).alias("line_no", "x")).select("path", "line_no", "x.*")


def _tagged(text: Column, name: str) -> Column:
    return F.contains(F.upper(text), F.lit(f"[{name}]"))


def exam_heads(found: DataFrame) -> DataFrame:
    """lines (path, line_no, text): one row per document: title, kind, minutes, audio; what is missing has a default."""
    t = F.col("text")
    value = lambda name: F.min_by(F.trim(F.regexp_replace(t, rf"(?i)\[{name}\]", "")), F.when(_tagged(t, name), F.col("line_no")))
    minutes = F.regexp_replace(value("TIME"), r"\D", "").try_cast("int")
    return found.groupBy("path").agg(F.coalesce(value("TITLE"), F.lit("Untitled")).alias("title"), F.coalesce(value("TYPE"), F.lit("Reading")).alias("kind"), F.coalesce(minutes, F.lit(60)).alias("minutes"), F.coalesce(value("AUDIO"), F.lit("")).alias("audio"))


def _states(found: DataFrame) -> DataFrame:
    """Lines of blocks with passage_index, block (number of its tag's line), kind, in_context, started (questions begun so far)."""
    t = F.col("text")
    w = Window.partitionBy("path").orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    head = _tagged(t, "TITLE") | _tagged(t, "TIME") | _tagged(t, "TYPE") | _tagged(t, "AUDIO")
    rows = found.where("text is not null").where(~head)
    mark = F.when(_tagged(t, "PASSAGE"), "PASSAGE").when(_tagged(t, "QUESTIONS"), "QUESTIONS")
    tag = F.regexp_extract(F.upper(t), r"\[(/?\w+)\]", 1)
    rows = rows.withColumns({"_mark": mark, "_state": F.last(mark, ignorenulls=True).over(upto), "passage_index": F.greatest(F.lit(0), F.sum((mark == "PASSAGE").cast("int")).over(upto) - 1).cast("int")})
    opens = F.col("_mark").isNull() & (F.col("_state") == "QUESTIONS") & tag.isin(BLOCKS)
    rows = rows.withColumns({"_opens": F.coalesce(opens, F.lit(False)), "_tag": tag})
    fence = F.when(F.col("_mark").isNotNull(), F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("kind"))).when(F.col("_opens"), F.struct(F.col("line_no").alias("at"), F.col("_tag").alias("kind")))
    rows = rows.withColumn("_block", F.last(fence, ignorenulls=True).over(upto))
    rows = rows.where(F.col("_mark").isNull() & ~F.col("_opens") & F.col("_block.at").isNotNull()).select("path", "line_no", "html", "text", "passage_index", F.col("_block.at").alias("block"), F.col("_block.kind").alias("kind"))
    b = Window.partitionBy("path", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    edge = F.when(_tagged(t, "CONTEXT"), 1).when(_tagged(t, "/CONTEXT"), 0)
    rows = rows.withColumns({"_edge": edge, "in_context": F.coalesce(F.last(edge, ignorenulls=True).over(b), F.lit(0)) == 1}).where("_edge is null").drop("_edge")
    starts = ~F.col("in_context") & (t.rlike(r"(?i)^(?:Question|Câu)\s+\d+") | t.rlike(r"^\d+[.):]"))
    rows = rows.withColumn("starts", starts)
    return rows.withColumn("started", F.sum(F.col("starts").cast("int")).over(b))


def exam_questions(found: DataFrame) -> DataFrame:
    """lines (path, line_no, html, text) to questions: path, block, number, passage_index, kind, subtype, instruction, context, text, options, answers, place, places, unmatched.

    place is the option that the first answer names, places those of all answers (multiple choice); no answer is made up
    where none matches (unmatched).
    """
    rows, t = _states(found), F.col("text")
    context = rows.where("in_context").groupBy("path", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "html"))), lambda x: F.concat(F.lit("<div>"), x["html"], F.lit("</div>"))), "").alias("context"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("context_text"))
    open_ = rows.where("not in_context")
    early = open_.where("started = 0")
    bank = F.transform(F.filter(F.split("html", r"<br\s*/?>"), lambda x: F.trim(x) != ""), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))
    letters = (F.size(bank) >= 2) & F.forall(bank, lambda x: x.rlike("^[A-Za-z]$"))
    shared = F.when(letters, F.transform(bank, lambda x: F.upper(x))).when(exams.is_option(t), F.array(t))
    plain = shared.isNull() & ~t.rlike(r"(?i)^\s*\[(?:LEFT|RIGHT)_TITLE\]")
    before = early.groupBy("path", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(shared.isNotNull(), F.struct("line_no", shared.alias("o"))))), lambda x: x["o"])).alias("bank"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(plain, F.struct("line_no", "text")))), lambda x: x["text"]), "\n").alias("instruction"))
    late = open_.where("started > 0")
    star, option = t.startswith("*") & ~F.col("starts"), exams.is_option(t) & ~F.col("starts")
    listed = lambda keep, value: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("line_no", value.alias("v"))))), lambda x: x["v"])
    words = F.when(F.col("starts"), F.trim(F.regexp_replace(t, r"(?i)^(?:Question|Câu)?\s*\d+[.:)]?\s*", ""))).otherwise(t)
    each = late.groupBy("path", "block", "started", "kind", "passage_index").agg(
        F.min("line_no").alias("line_no"), listed(star, F.trim(F.regexp_replace(t, r"^\*+\s*", ""))).alias("answers"), listed(option & ~star, t).alias("own"), F.array_join(listed(F.col("starts") | ~(star | option), words), " ").alias("text")
    )
    q = each.join(context, ["path", "block"], "left").join(before, ["path", "block"], "left")
    q = q.withColumn("options", F.concat(F.coalesce("bank", F.array().cast("array<string>")), "own")).withColumn("_b", F.struct("path", "block"))
    q = shared_options(q, "_b", "line_no")
    said = F.concat_ws(" ", "instruction", "text")
    q = q.withColumns({"subtype": exams.question_subtype(said, F.col("kind"), F.coalesce("context_text", F.lit(""))), "options": exams.stated_options(said, F.col("options"))})
    first = F.get("answers", F.lit(0))
    judged = F.lower(said).rlike(r"(?s)\b(?:true\b.*\bfalse|yes\b.*\bno)\b.*\bnot\s+given\b")
    shown = F.when(judged, "CHOICE").when((F.col("kind") == "MATCHING") & F.contains(F.lower(said), F.lit("heading")), "DRAG_DROP_HEADING").when(F.col("kind") == "SHORT_ANSWER", "BLANK").when(F.col("kind") == "DRAG", "DRAG_DROP").otherwise(F.col("kind"))
    q = q.withColumns({"kind": shown, "place": F.when(shown.isin("CHOICE", "MATCHING"), exams.answer_place(F.col("options"), first)), "places": F.when(shown == "CHOICE_MULTIPLE", exams.answer_places(F.col("options"), F.col("answers")))})
    answer = F.when(F.col("kind") == "DRAG_DROP", exams.bank_word(F.col("options"), first)).when(F.col("kind") == "DRAG_DROP_HEADING", F.lower(F.trim(first))).otherwise(first)
    unmatched = first.isNull() | (F.col("kind").isin("CHOICE", "MATCHING") & F.col("place").isNull()) | ((F.col("kind") == "CHOICE_MULTIPLE") & (F.size("places") == 0))
    number = F.row_number().over(Window.partitionBy("path").orderBy("line_no"))
    return q.select("path", "block", number.alias("number"), "passage_index", "kind", "subtype", F.coalesce("instruction", F.lit("")).alias("instruction"), F.coalesce("context", F.lit("")).alias("context"), "text", "options", "answers", F.coalesce(answer, F.lit("")).alias("answer"), "place", "places", unmatched.alias("unmatched"))


def read_exams(files: DataFrame) -> DataFrame:
    """The questions of files as spark.read.format("binaryFile") gives them; read_lines() tells which files are bad."""
    return exam_questions(read_lines(files).where("error is null"))
