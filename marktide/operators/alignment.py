"""Text alignment: evidence quotes, grammar patterns, transcripts, grounding of phrases.

A null text counts as an empty one: it has no structure, quotation, block or word. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marktide.functions.values import half_up, let, mark_seconds, marked_time, plain_key, sentences, squeeze, strip_tags
from marktide.operators import search

# Letters, digits and the low line are word characters in all scripts; both Java and RE2 read these classes alike.
_W = r"\pL\pN_"
_B, _E = rf"(?:^|[^{_W}])", rf"(?:$|[^{_W}])"
#: From one word to another of the same sentence, with or without words between.
_TO = rf"[^{_W}.?!](?:[^.?!]*[^{_W}.?!])?"
_GAP = r"[ \t\n\f\r]+"
# The words that the structures are made of.
_NEGATIVE = "never|rarely|seldom|hardly|scarcely|no sooner|nowhere|little"
_AUXILIARY = "had|has|have|did|does|was|were|is|are|will|would|can|could"
_BE = "is|are|was|were|has been|have been"
_REPORTED = "said|believed|thought|reported|known|expected|considered|claimed|estimated|alleged|presumed|rumou?red"
_MORE = rf"the{_GAP}[{_W}]+(?:er|more|less|better|worse)"
#: The structures that are looked for, in lower-cased text, between word boundaries.
_CORES = {
    "not_only": f"not only{_TO}but{_TO}also",
    "neg_inversion": rf"(?:{_NEGATIVE}){_GAP}(?:{_AUXILIARY}){_GAP}[{_W}]+",
    "passive_report": f"(?:{_BE}){_GAP}(?:{_REPORTED}){_GAP}to",
    "cleft_it": rf"it{_GAP}(?:is|was)(?:[ \t\n\f\r,'-]|[ \t\n\f\r,'-][{_W} \t\n\f\r,'-]{{0,43}}?[ \t\n\f\r,'-])(?:that|who|which)",
    "correlative_comp": f"{_MORE}{_TO}{_MORE}",
    "third_cond": f"if{_TO}had{_TO}would have",
}
GRAMMAR = tuple((k, f"{_B}({core}){_E}") for k, core in _CORES.items())
#: Structures that an analysis reports at most, and characters of the sentence that shows one.
MOST_STRUCTURES, SHOWN_CHARS = 4, 300


def grammar_items(text: Column) -> Column:
    """The first structures of GRAMMAR that a text holds: array of (key, sentence). Null holds none.

    sentence is the first one with the beginning of the match, or else the match itself.
    """
    full = F.coalesce(text, F.lit(""))
    matches = let(F.lower(full), lambda low: F.array(*[F.struct(F.lit(k).alias("key"), F.when(low.rlike(_CORES[k]), F.regexp_extract(low, p, 1)).otherwise("").alias("match")) for k, p in GRAMMAR]))  # boundaries cost most
    found = F.slice(F.filter(matches, lambda x: x["match"] != ""), 1, MOST_STRUCTURES)

    def item(parts: Column, x: Column) -> Column:
        shown = let(F.substring(x["match"], 1, 25), lambda begin: F.coalesce(F.get(F.filter(parts, lambda s: F.contains(F.lower(s), begin)), F.lit(0)), x["match"]))
        return F.struct(x["key"].alias("key"), F.substring(F.trim(shown), 1, SHOWN_CHARS).alias("sentence"))

    empty = F.array().cast("array<struct<key: string, sentence: string>>")
    return let(found, lambda xs: F.when(F.size(xs) > 0, let(sentences(full), lambda parts: F.transform(xs, lambda x: item(parts, x)))).otherwise(empty))


def best_sentences(sentences: DataFrame, key: str, query: Column, text: str = "sentence", pos: str = "pos") -> DataFrame:
    """The sentence of each key with most words in common with the query (an array), nearest to 150 characters, first."""
    overlap = F.size(F.array_intersect(F.array_distinct(F.split(plain_key(F.col(text)), " ")), query))
    rated = sentences.withColumn("overlap", overlap).withColumn("off", F.abs(F.length(text) - 150))
    w = Window.partitionBy(key).orderBy(F.desc("overlap"), "off", pos)
    return rated.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "off")


def _close_blocks(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, begin, end, texts, out = None, -1, 0.0, 0.0, [], []
        started = False

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string()), strict=True)], names=["key", "block_no", "start_s", "end_s", "block_text"])

        for b in batches:
            for k, s, e, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                fresh = not started or k != key
                if fresh or e - begin > limit:
                    if texts:
                        out.append((key, number, begin, end, " ".join(texts)))
                    key, number, begin, texts, started = k, 0 if fresh else number + 1, s, [], True
                end = e
                texts.append(t)
            yield rows()
        if texts:
            out.append((key, number, begin, end, " ".join(texts)))
        yield rows()

    return run


def transcript_blocks(segments: DataFrame, key: str, order: str, start: str, end: str, text: str, block: float = 8.0) -> DataFrame:
    """Joins segments in order; one that would end over block seconds after its block's start opens the next block.

    Segments without text are left out. A recording is folded in its order by one task, which holds the open block alone.
    """
    rows = segments.select(F.col(key).cast("string").alias("key"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"), F.trim(F.coalesce(text, F.lit(""))).alias("t"), F.col(order).alias("o")).where("t <> ''")
    ordered = rows.repartition("key").sortWithinPartitions("key", "o", "s", "e", "t").select("key", "s", "e", "t")
    found = ordered.mapInArrow(_close_blocks(block), "key string, block_no int, start_s double, end_s double, block_text string")
    return found.select(F.col("key").cast(segments.schema[key].dataType).alias(key), "block_no", "start_s", "end_s", "block_text")


def hinted_block(blocks: DataFrame, hints: DataFrame, key: str) -> DataFrame:
    """hints (key, hint): the start of the block of its recording with most hint words, the first of equals; no row without a hit."""
    words = F.filter(F.regexp_extract_all(plain_key(F.coalesce("hint", F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(HINT_STOP))
    text = F.concat(F.lit(" "), plain_key(F.col("block_text")), F.lit(" "))
    rows = blocks.join(hints.select(key, words.alias("_h")), key)
    votes = let(text, lambda t: F.size(F.filter("_h", lambda w: F.contains(t, F.concat(F.lit(" "), w, F.lit(" "))))))
    return rows.withColumn("_v", votes).where("_v > 0").groupBy(key).agg(F.max_by("start_s", F.struct("_v", -F.col("block_no"))).alias("anchor"))


# How times are written in transcripts and answers, and words of a hint that say nothing.
_TIME = r"\d{1,2}:\d{2}(?::\d{2})?"
_MARK = rf"\(({_TIME})\s*-\s*{_TIME}\)"
_CITE = rf"\[({_TIME})\]"
_RANGE = rf"[\[(]\s*({_TIME})\s*(?:-|–|—|to)\s*{_TIME}\s*[\])]"
HINT_STOP = "about answer choose correct each following from have into most more option question that the their these this what which with would your".split()


def _spaced_key(text: Column) -> Column:
    return F.concat(F.lit(" "), plain_key(F.coalesce(text, F.lit(""))), F.lit(" "))


def marked_blocks(transcript: Column) -> Column:
    """The marked blocks of a transcript in order: array of (second, text), text as its plain key between blanks.

    The first marker opens a block wherever it stands, later ones at the start of a line only: others belong to the text.
    """

    def parted(from_first: Column) -> Column:
        marks = F.regexp_extract_all(from_first, F.lit(rf"\n\s*{_MARK}"), F.lit(1))
        return let(F.split(from_first, rf"\n\s*{_MARK}"), lambda texts: F.transform(marks, lambda m, k: F.struct(mark_seconds(m).alias("second"), _spaced_key(F.get(texts, k + 1)).alias("text"))))

    return let(F.concat(F.lit("\n"), F.regexp_extract(F.coalesce(transcript, F.lit("")), rf"{_MARK}[\s\S]*", 0)), parted)


def _ways(answer: Column, articles: bool) -> Column:
    """Accepted wordings of an answer, longest first: alternatives at / ; | or, as they are and (articles) without their article."""
    parts = F.transform(F.split(F.coalesce(answer, F.lit("")), r"(?i)\s*(?:/|;|\||\bor\b)\s*"), plain_key)
    every = F.array_union(parts, F.transform(parts, lambda p: F.regexp_replace(p, "^(?:a|an|the) +", ""))) if articles else F.array_distinct(parts)
    usable = F.filter(every, lambda p: (F.length(p) >= 3) & ~p.rlike("^[0-9]+$"))
    return F.transform(F.array_sort(F.transform(usable, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), lambda x: x["p"])


def _holds(block: Column, way: Column) -> Column:
    return F.contains(block["text"], F.concat(F.lit(" "), way, F.lit(" ")))


def answer_anchor(transcript: Column, correct: Column, answers: Column | None = None, index: Column | None = None) -> Column:
    """The second at which an answer is spoken: of its only block, else of its first block after those of the answers before it.

    answers: the answers of the part in order, correct being number index (from 0). An answer before it that is not found
    moves nothing. Null if the answer is not proven by a block.
    """
    return let(marked_blocks(transcript), lambda b: _spoken(b, correct, answers, index))


def _spoken(b: Column, correct: Column, answers: Column | None, index: Column | None) -> Column:
    """answer_anchor() in blocks."""
    hits = F.transform(_ways(correct, True), lambda w: F.filter(b, lambda x: _holds(x, w)))
    first = F.get(F.get(F.filter(hits, lambda h: F.size(h) == 1), F.lit(0)), F.lit(0))["second"]
    if answers is None or index is None:
        return first
    start = F.struct(F.lit(-1).alias("cursor"), F.lit(False).alias("here"))

    def step(a: Column, answer: Column) -> Column:
        places = let(_ways(answer, False), lambda ways: F.filter(F.transform(b, lambda x, k: F.when((k > a["cursor"]) & F.exists(ways, lambda w: _holds(x, w)), k)), lambda k: k.isNotNull()))
        return let(F.get(places, F.lit(0)), lambda at: F.struct(F.coalesce(at, a["cursor"]).alias("cursor"), at.isNotNull().alias("here")))

    upto = F.when((index >= 0) & (index < F.size(answers)), F.slice(answers, 1, index + 1)).otherwise(F.array().cast("array<string>"))
    in_order = let(F.aggregate(upto, start, step), lambda last: F.when(last["here"], F.get(b, last["cursor"])["second"]))
    return F.coalesce(first, in_order)


def hint_anchor(transcript: Column, hints: Column, index: Column | None = None, count: Column | None = None) -> Column:
    """The block with most hint words (the first of equals), else the one at the question's relative place; null without blocks."""
    return let(marked_blocks(transcript), lambda b: _hinted(b, hints, index, count))


def _hinted(b: Column, hints: Column, index: Column | None, count: Column | None) -> Column:
    """hint_anchor() in blocks."""
    words = F.filter(F.regexp_extract_all(plain_key(F.coalesce(hints, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(HINT_STOP))
    votes = let(words, lambda ws: F.transform(b, lambda x, k: F.struct((-F.size(F.filter(ws, lambda w: _holds(x, w)))).alias("n"), k.alias("k"), x["second"].alias("s"))))
    voted = let(F.get(F.array_sort(votes), F.lit(0)), lambda best: F.when(best["n"] < 0, best["s"]))
    if index is None:
        return voted
    share = F.least(F.lit(1.0), (index + F.lit(0.5)) / F.when(count > 0, count).otherwise(F.size(b)) if count is not None else (index + F.lit(0.5)) / F.size(b))
    placed = F.when((index >= 0) & (F.size(b) > 0), F.get(b, F.least(F.size(b) - 1, F.floor(share * F.size(b)).cast("int")))["second"])
    return F.coalesce(voted, placed)


def settled_citations(answer: Column, transcript: Column, correct: Column, answers: Column | None = None, index: Column | None = None, hints: Column | None = None, count: Column | None = None, again: str = "Listen again: ") -> Column:
    """An answer text with one proven time: the first cited time becomes the anchor and the others go.

    The anchor is where the answer is spoken, else where most hints are, else the real block nearest to the first cited
    time, if that lies after the first block or the question is the first one. Without an anchor all cited times go;
    without a cited time the anchor is added at the end.
    """
    one_form = F.regexp_replace(F.regexp_replace(F.coalesce(answer, F.lit("")), _RANGE, "[$1]"), rf"\(({_TIME})\)", "[$1]")
    first = F.coalesce(index == 0, F.lit(False)) if index is not None else F.lit(False)

    def proven_time(b: Column, cited: Column) -> Column:
        def guess(seconds: Column) -> Column:
            near = F.get(F.array_sort(F.transform(seconds, lambda s: F.struct(F.abs(s - cited).alias("d"), s.alias("s")))), F.lit(0))["s"]
            return F.when(cited.isNotNull() & ((cited > F.array_min(seconds)) | first), near)

        return F.when(F.size(b) > 0, F.coalesce(_spoken(b, correct, answers, index), _hinted(b, F.lit("") if hints is None else hints, index, count), let(F.transform(b, lambda x: x["second"]), guess)))

    def settled(text: Column, cited: Column, anchor: Column) -> Column:
        mark = F.concat(F.lit("["), marked_time(anchor), F.lit("]"))
        none = F.regexp_replace(text, rf"\s*{_CITE}", "")
        head, rest = (F.regexp_extract(text, rf"(?s)^(.*?){_CITE}(.*)$", k) for k in (1, 3))
        replaced = F.concat(head, mark, F.regexp_replace(rest, rf"\s*{_CITE}", ""))
        added = F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit(f"\n\n{again}"), mark)
        return F.when(anchor.isNull(), none).when(cited.isNotNull(), replaced).otherwise(added)

    def anchored(text: Column, cited: Column) -> Column:
        return let(let(marked_blocks(transcript), lambda b: proven_time(b, cited)), lambda anchor: settled(text, cited, anchor))

    return let(one_form, lambda text: let(mark_seconds(F.regexp_extract(text, _CITE, 1)), lambda cited: anchored(text, cited)))


def transcript_slice(transcript: Column, part: Column, parts: Column, index: Column, questions: Column, limit: int = 23_000, slack: int = 500) -> Column:
    """So many characters of a transcript around the place of a question (index, from 0, or null) of a part.

    The place is that of the question among its part's questions, in the middle without one. A slice that does not begin
    at the start begins at the next marker if that is near.
    """
    t = F.coalesce(transcript, F.lit(""))
    n = F.length(t)
    inside = F.coalesce(F.when((index >= 0) & (questions > 0), (index + F.lit(0.5)) / questions), F.lit(0.5))
    center = half_up((part + inside) / F.greatest(parts, F.lit(1)) * n)
    start = F.greatest(F.lit(0), F.least(n - limit, center - limit // 2)).cast("int")
    marker = F.locate("(", F.substring(t, start + 1, F.lit(slack))) - 1
    begin = F.when((start > 0) & (marker >= 0), start + marker).otherwise(start)
    return F.when(n <= limit, t).otherwise(F.substring(t, begin + 1, F.lit(limit)))


def target_paragraph(passage: Column, label: Column, least: int = 30) -> Column:
    """The paragraph that a letter names (A the first), of those without a heading and of at least so many characters; else an empty text."""
    letter = F.regexp_replace(F.upper(F.trim(F.coalesce(label, F.lit("")))), "[.)]$", "")
    texts = F.transform(F.regexp_extract_all(F.coalesce(passage, F.lit("")), F.lit("(?is)<p(?:[ \t\n\f\r][^>]*)?>(.*?)</p>"), F.lit(1)), lambda x: F.when(x.rlike("(?i)<h[1-6]"), "").otherwise(strip_tags(x, "")))
    long = F.filter(texts, lambda x: F.length(x) >= least)
    return F.coalesce(F.when(letter.rlike("^[A-Z]$"), F.get(long, F.ascii(letter) - 65)), F.lit(""))


# Lengths of a quotation, of a sentence that may stand in the answer itself, of a shown excerpt; words that prove nothing.
QUOTE_CHARS, INLINE_CHARS, EXCERPT_CHARS, MOST_QUOTES = (4, 300), 24, 300, 3
EVIDENCE_STOP = "the and for with that this from which what when where does were was are has have had into than then only answer correct question option student read reading passage".split()
_EVIDENCE = r"(?i)\[\[EVIDENCE:\s*([\s\S]*?)\s*\]\]"


def evidence_key(text: Column) -> Column:
    """Curly quotes straight, white space one space, lower case."""
    return F.lower(squeeze(F.translate(F.coalesce(text, F.lit("")), "’“”", "'\"\"")))


def marked_evidence(draft: Column, passage: Column) -> Column:
    """The first quotations that a draft marks and the passage holds, each once."""
    least, most = QUOTE_CHARS
    found = F.transform(F.regexp_extract_all(F.coalesce(draft, F.lit("")), F.lit(_EVIDENCE), F.lit(1)), lambda q: F.struct(F.trim(q).alias("q"), evidence_key(q).alias("k")))
    good = let(evidence_key(passage), lambda key: F.filter(found, lambda x: F.length(x["k"]).between(least, most) & F.contains(key, x["k"])))

    def each_once(xs: Column) -> Column:
        return let(F.transform(xs, lambda x: x["k"]), lambda keys: F.filter(xs, lambda x, i: F.array_position(keys, x["k"]) == i + 1))

    return F.slice(F.transform(let(good, each_once), lambda x: x["q"]), 1, MOST_QUOTES)


def passage_sentences(passage: Column) -> Column:
    return F.split(F.coalesce(passage, F.lit("")), r"(?<=[.!?])[ \t\n\f\r]+|\n+")


def has_inline_evidence(draft: Column, passage: Column) -> Column:
    """Whether a sentence of the passage stands in the draft itself, outside its markers."""
    plain = evidence_key(F.regexp_replace(F.coalesce(draft, F.lit("")), _EVIDENCE, ""))
    return let(plain, lambda p: F.exists(F.transform(passage_sentences(passage), evidence_key), lambda s: (F.length(s) >= INLINE_CHARS) & F.contains(p, s)))


def _evidence_words(text: Column) -> Column:
    return F.array_except(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z][a-z'-]{2,}"), F.lit(0)), F.array(*map(F.lit, EVIDENCE_STOP)))


def fallback_evidence(passage: Column, correct: Column, query: Column) -> Column:
    """The sentence that holds the answer, has most words of the query and is nearest to 150 characters, cut at a word; null if there is none."""
    parts = F.filter(F.transform(passage_sentences(passage), lambda s: F.regexp_replace(F.regexp_replace(s, r"[ \t\n\f\r]+", " "), "^[ -]+|[ -]+$", "")), lambda s: F.length(evidence_key(s)) >= QUOTE_CHARS[0])

    def first(want: Column, words: Column) -> Column:
        def rated(s: Column, i: Column) -> Column:
            exact = (F.length(want) > 2) & F.contains(evidence_key(s), want)
            return F.struct((-exact.cast("int")).alias("e"), (-F.size(F.array_intersect(_evidence_words(s), words))).alias("o"), F.abs(F.length(s) - 150).alias("d"), i.alias("i"), s.alias("s"))

        return F.array_min(F.transform(parts, rated))["s"]

    def shown(best: Column) -> Column:
        at_word = let(F.substring(best, 1, EXCERPT_CHARS), lambda cut: F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut))
        return F.when(F.length(best) > EXCERPT_CHARS, F.trim(at_word)).otherwise(best)

    return let(let(evidence_key(correct), lambda want: let(_evidence_words(query), lambda words: first(want, words))), shown)


def proven(draft: Column, passage: Column, correct: Column, query: Column) -> Column:
    """A draft with its proof: marked quotations as plain ones in it, and at the end the markers that hold.

    A sentence of the passage in the draft is proof enough; else the marked quotations that the passage holds count, and
    without any the best sentence.
    """
    best = F.array_compact(F.array(fallback_evidence(passage, correct, query)))
    held = let(marked_evidence(draft, passage), lambda marked: F.when(F.size(marked) > 0, marked).otherwise(best))
    found = F.when(has_inline_evidence(draft, passage), F.array().cast("array<string>")).otherwise(held)
    text = F.regexp_replace(F.coalesce(draft, F.lit("")), _EVIDENCE, "“$1”")
    lines = lambda shown: F.array_join(F.transform(shown, lambda q: F.concat(F.lit("[[EVIDENCE: "), q, F.lit("]]"))), "\n")
    return let(found, lambda shown: F.when(F.size(shown) > 0, F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n\n"), lines(shown))).otherwise(text))


def quoted_in(quote: Column, source: Column) -> Column:
    """Whether a quotation of five words or more stands in the source: whole, or its first or last five words."""

    def held(q: Column, s: Column) -> Column:
        some = lambda words, a: F.contains(s, F.array_join(F.slice(words, a, 5), " "))
        return let(F.split(q, " "), lambda words: (F.size(words) >= 5) & (F.contains(s, q) | some(words, 1) | some(words, -5)))

    key = lambda x: plain_key(F.coalesce(x, F.lit("")))
    return let(key(quote), lambda q: let(key(source), lambda s: held(q, s)))


def grounded_items(items: DataFrame, source: str, word: str = "word", category: str = "category", sentence: str = "source_sentence", nearest: bool = True) -> DataFrame:
    """The vocabulary items that their source holds: grammar by its sentence, phrasal verbs with up to four words between, others as they stand.

    Of several places of a word the nearest counts, or each of them (nearest=False). A source without any word proves
    nothing and drops nothing.
    """
    gap = F.when(F.col(category) == "phrasal_verb", 4).otherwise(0)
    stands = let(search.words_of(F.col(word)), lambda w: let(search.words_of(F.col(source)), lambda s: (F.size(s) == 0) | search.stands_in(w, s, gap, nearest)))
    quoted = (plain_key(F.coalesce(source, F.lit(""))) == "") | quoted_in(F.col(sentence), F.col(source))
    return items.where(F.when(F.col(category) == "grammar", quoted).otherwise(stands))
