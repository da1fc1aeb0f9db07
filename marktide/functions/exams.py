"""Column helpers for exam lines, options and answers, links, loose JSON and markup."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marktide.functions.values import let

_S = r"[ \t\n\f\r]"


def is_option(line: Column) -> Column:
    """Whether a line is an answer option: "A. x", "b) x", a lone letter, "iv. x", or a capital A-K before a short text.

    A sentence that begins with the article A or with I am, I have or I was is none. Null is no option.
    """
    t = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), rf"^{_S}+|{_S}+$", ""))
    marked = t.rlike(rf"^[A-Za-z][.)]{_S}+") | t.rlike("^[A-Za-z]$") | t.rlike(rf"^[ivxlcdmIVXLCDM]+\.\)?{_S}+[^ \t\n\f\r]")
    listed = t.rlike(rf"^[A-K]{_S}+[^ \t\n\f\r]") & (F.length(t) < 80)
    sentence = t.rlike(rf"^A{_S}+[a-z]") | t.rlike(rf"^I{_S}+(?i:am|have|was) ")
    return marked | (listed & ~sentence)


def question_subtype(text: Column, kind: Column, context: Column) -> Column:
    """The form of a question from its instruction and text, the first that holds; DRAG looks at its context lines.

    In a DRAG context, numbers at the start of every marked line are independent rows, others a summary.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    named = (
        F.when((low.contains("map") | low.contains("plan")) & low.contains("label"), "MAP_LABELLING")
        .when(low.contains("flow-chart") | low.contains("flowchart"), "FLOWCHART")
        .when(low.contains("summary"), "SUMMARY").when(low.contains("note"), "NOTES").otherwise("SENTENCE")
    )
    marked = F.filter(F.split(F.coalesce(context, F.lit("")), "\n"), lambda x: x.rlike(r"\[\d+\]"))
    inside = F.exists(marked, lambda x: ~x.rlike(rf"^{_S}*\[\d+\]"))
    return F.when(kind == "DRAG", F.when(inside, "SUMMARY_DRAG").otherwise("COLUMN_DRAG")).otherwise(named)


def stated_options(text: Column, options: Column) -> Column:
    """options, or where there are none the three answers that the instruction names."""
    # The two sets of three answers.
    low, three = F.lower(F.coalesce(text, F.lit(""))), lambda a, b: rf"(?s)\b{a}\b.*\b{b}\b.*\bnot\s+given\b"
    given = lambda a, b: low.rlike(three(a, b)) | low.contains(f"{a}/{b}/not given")
    found = (
        F.when(given("true", "false"), F.array(*map(F.lit, ("TRUE", "FALSE", "NOT GIVEN"))))
        .when(given("yes", "no"), F.array(*map(F.lit, ("YES", "NO", "NOT GIVEN"))))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.when(F.size(F.coalesce(options, F.array().cast("array<string>"))) > 0, options).otherwise(found)


def option_letter(option: Column, place: Column) -> Column:
    """The letter that an option begins with, raised, else that of its place (from 0)."""
    own = F.upper(F.regexp_extract(F.trim(option), r"^([A-Za-z])(?:[.)]\s+|\s+|$)", 1))
    return F.when(own != "", own).otherwise(F.char(place + 65))


def answer_place(options: Column, answer: Column) -> Column:
    """The place (from 0) of the first option whose letter or text is the answer; null if none is.

    Where the answer is not found there is no default: the caller sees that it is unmatched.
    """
    want = F.upper(F.trim(answer))
    hits = F.transform(options, lambda o, i: F.coalesce((option_letter(o, i) == want) | (F.upper(F.trim(o)) == want), F.lit(False)))
    place = F.array_position(hits, F.lit(True))
    return F.when(place > 0, (place - 1).cast("int"))


def answer_places(options: Column, answers: Column) -> Column:
    """answer_place() of each answer in order, unmatched ones left out."""
    return F.array_compact(F.transform(answers, lambda a: answer_place(options, a)))


def bank_word(options: Column, answer: Column) -> Column:
    """The word that a letter names in a word bank; what is no letter of the bank stays as it is."""
    words = F.transform(options, lambda o: F.trim(F.regexp_replace(o, r"^\s*[A-Za-z][.)]\s*", "")))
    letter, raw = F.upper(F.trim(answer)), F.trim(answer)
    return F.when(raw.rlike("^[A-Za-z]$"), F.coalesce(F.get(words, F.ascii(letter) - 65), raw)).otherwise(raw)


def audio_link(url: Column) -> Column:
    """A link to a file's page becomes one to the file itself; others stay."""
    # The two forms of such links, and the form that fetches the file.
    host, fetch = "drive.google.com", "https://drive.google.com/uc?export=download&id="
    by_path = F.regexp_extract(url, rf"{host}/file/d/([^/]+)", 1)
    by_query = F.regexp_extract(url, rf"{host}/open\?id=([^&]+)", 1)
    return F.when(by_path != "", F.concat(F.lit(fetch), by_path)).when(by_query != "", F.concat(F.lit(fetch), by_query)).otherwise(url)


def audio_key(key: Column, prefix: str = "exam-audio/") -> Column:
    """struct(path, token) of a base64url key of "path|token"; null for a key that is none or points elsewhere."""
    plain = F.translate(key, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)).cast("int")))
    text = F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    path, token = F.regexp_extract(text, r"(?s)^([^|]*)\|", 1), F.regexp_extract(text, r"(?s)^[^|]*\|(.+)$", 1)
    return F.when(path.startswith(prefix) & (token != ""), F.struct(path.alias("path"), token.alias("token")))


def json_items(text: Column) -> Column:
    """The items of loosely written JSON, each as JSON text: a list, {"items": [...]}, the first list of an object, or what
    stands between the first [ and the last ]. A fence around it is taken off. Null if there is no list.
    """
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{_S}+|{_S}+$", ""))
    bare = let(t, lambda x: F.trim(F.when(x.startswith("```"), F.regexp_replace(F.btrim(x, F.lit("`")), "^(?i:json)", "")).otherwise(x)))
    as_list = lambda x: F.from_json(F.when(x.startswith("["), x), "array<variant>")
    # malformed objects can give a list of nothing; a list is an answer only if the whole text parses
    parses = lambda x: F.try_parse_json(x).isNotNull()
    is_list = lambda v: F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))

    def picked(fields: Column) -> Column:
        first = F.try_variant_get(F.get(F.filter(F.map_values(fields), is_list), F.lit(0)), "$", "array<variant>")

        def chosen(items: Column) -> Column:
            named = F.when(is_list(items), F.try_variant_get(items, "$", "array<variant>"))
            return let(named, lambda xs: F.when(F.size(xs) > 0, xs).when(items.isNull() | is_list(items), first))

        return let(F.try_element_at(fields, F.lit("items")), chosen)

    def found(raw: Column) -> Column:
        of_object = let(F.from_json(F.when(raw.startswith("{"), raw), "map<string,variant>"), picked)
        between = let(F.regexp_extract(raw, r"(?s)(\[.*\])", 1), lambda x: F.when(parses(x), as_list(x)))
        return F.coalesce(F.when(parses(raw), F.coalesce(as_list(raw), of_object)), between)

    return F.transform(let(F.regexp_replace(bare, rf"^{_S}+", ""), found), lambda v: F.to_json(v))


def masked(html: Column, mark: str = "█") -> Column:
    """Each word outside tags as 2 to 8 marks (by a hash of the word and its place); numbering markers and blanks stay."""
    # Markers of numbering and blanks that stay, and the letters of a word.
    keep = r"<[^>]+>|\[\d+\]|\(\d+\)|\b\d+\b\.|_{2,}|\.{4,}"
    parts = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"(?s)({keep}|[a-zA-Z0-9À-ỹ]+|.)"), F.lit(1))
    size = lambda x, i: (F.pmod(F.xxhash64(x, i), F.lit(7)) + 2).cast("int")
    return F.array_join(F.transform(parts, lambda x, i: F.when(x.rlike("^[a-zA-Z0-9À-ỹ]+$"), F.repeat(F.lit(mark), size(x, i))).otherwise(x)), "")


# Endings of image links, and the ways of writing an arrow (one character each, or a word of characters).
_IMAGE = r"https?://[^\s<\"']+(?:\.jpg|\.jpeg|\.png|\.gif|\.webp)"
_ARROW = r"(?:[↓⬇▼⇩→]|\|\s*v|->|-&gt;|&rarr;|&darr;)"


def clean_markup(html: Column, arrow: str = "<span class='arrow'></span>") -> Column:
    """Placeholders of images go, image links become images, own colours go, arrows on a line of their own become one element."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)\[Image\s*\d+\]", "")
    t = F.regexp_replace(t, rf"(?i)(?<!src=[\"'])(?<![^\s<>\"':])(?:<p>)?(?:Url:\s*)?({_IMAGE})(?:</p>)?", '<img src="$1" alt="" />')
    t = F.regexp_replace(t, r"(?i)\[IMAGE\]\s*(https?://[^\s<\"']+)", '<img src="$1" alt="" />')
    t = F.regexp_replace(t, r"(?i)<font[^>]+color=\"[^\"]*\"[^>]*>(.*?)</font>", "<span>$1</span>")
    t = F.regexp_replace(t, r"(?i)(?<= style=\"[^\"]{0,400})(?<=[\";])\s*(?:color|background(?:-color)?)\s*:[^;\"]*;?", "")
    t = F.regexp_replace(t, r"(?i) style=\"[;\s]*\"", "")
    t = F.regexp_replace(t, rf"(?i)>\s*{_ARROW}\s*<", f">{arrow}<")
    return F.regexp_replace(t, rf"(?i)(?:^|<br\s*/?>|\n)\s*{_ARROW}\s*(?=<br\s*/?>|\n|<|$)", arrow)


def without_citation_tags(text: Column) -> Column:
    """Text without the tags that a writing tool puts around its sources: openings with the white space after them, runs of ] with that before."""
    # The opening tag, and the closing brackets.
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[cite_start\]\s*", "")
    return F.regexp_replace(t, r"\s*\]+", "")


def repaired(text: Column) -> Column:
    """Text in which UTF-8 that was read as Windows-1252 is put right again, where that gives symbols; letters stay as they are.

    A run of such characters is repaired if its bytes are UTF-8 and all it stands for lies at U+2000 or beyond.
    """

    def byte(c: str) -> int | None:
        try:
            return c.encode("cp1252")[0]
        except UnicodeEncodeError:
            return ord(c) if 0x80 <= ord(c) <= 0xFF else None

    def put(m: re.Match) -> str:
        raw = [byte(c) for c in m[0]]
        try:
            out = bytes(raw).decode("utf-8")
        except (TypeError, UnicodeDecodeError):
            return m[0]
        return out if all(ord(c) >= 0x2000 for c in out) else m[0]

    odd = re.compile("[\u0080-\u00ff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u2026\u2030\u2039\u203a\u20ac\u2122]+")

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: odd.sub(put, t), na_action="ignore")

    return F.pandas_udf(run, "string")(text)
