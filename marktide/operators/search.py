"""Quotes in passages and phrases in sources, over all texts: no pairing of every quote with every text.

Null and empty quotes and phrases are found nowhere; null passages hold nothing. Rows that stand twice give one row each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marktide.functions.values import let, plain_key

#: Different quotes, and their characters in all, that are sent to all tasks as one automaton; beyond, grams are joined.
QUOTES, QUOTE_CHARS = 200_000, 16_000_000
#: Characters of a gram, and grams of which the least is chosen: texts of GRAM + CHOICE - 1 characters or more share one.
GRAM, CHOICE = 8, 9
#: Letters by which words may be alike.
CLASS = 4
#: Words from one word of a phrase to the next, at most.
REACH = 5


def normal(text: Column) -> Column:
    """Lower case, white space one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\f\r]+", " "))


def _scan(told):
    """The numbers of the quotes that each passage holds, by one walk of the automaton over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, quote in enumerate(told.value):
            automaton.add_word(quote, number)
        automaton.make_automaton()
        for b in batches:
            found = [sorted({n for _, n in automaton.iter(p)}) if len(automaton) else [] for p in b.column(1).to_pylist()]
            of = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array([n for x in found for n in x], pa.int64())], names=["passage_id", "number"])

    return run


def grams(text: str, lengths: tuple[int, ...], first: bool = False) -> list[int]:
    """Keys by which a text meets the quotes in it: the least gram of each CHOICE neighbours, by a hash; for quotes that are
    shorter, all stretches of their lengths. first: the one key of a quote itself."""
    code = np.array([ord(c) + 1 for c in text], np.uint64)

    def rolled(size: int) -> np.ndarray:
        h = np.zeros(max(0, len(code) - size + 1), np.uint64)
        for k in range(size):
            h = (h ^ code[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return h

    least = GRAM + CHOICE - 1
    if first and len(code) < least:
        return (rolled(len(code)) ^ np.uint64(len(code))).view(np.int64).tolist()
    h, out = rolled(GRAM), []
    if len(h) >= CHOICE:
        out.append(np.lib.stride_tricks.sliding_window_view(h, CHOICE)[: 1 if first else None].min(axis=1))
    out += [] if first else [rolled(n) ^ np.uint64(n) for n in lengths]
    return np.unique(np.concatenate(out)).view(np.int64).tolist() if out else []


def _keyed(lengths: tuple[int, ...], first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [grams(t, lengths, first) for t in b.column(1).to_pylist()]
            of = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array([k for x in found for k in x], pa.int64())], names=["id", "key"])

    return run


def quotes_in(passages: DataFrame, quotes: DataFrame, most: int = QUOTES) -> DataFrame:
    """passages (passage_id, text), quotes (quote_id, quote): pairs where the passage holds the quote, case and white space
    aside, at any place: within words too.

    Few quotes (checked by number and size) become one automaton that every task walks over its passages; nothing of the
    passages is shuffled. Of many, each is known by one gram that any text holding it has among its own; texts are compared
    in full where these meet.
    """
    p = passages.select("passage_id", normal(F.col("text")).alias("p"))
    q = quotes.select("quote_id", normal(F.col("quote")).alias("q")).where("q <> ''")
    different = q.select("q").distinct()
    size = different.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("q")), F.lit(0)).alias("chars")).first()
    if size["n"] <= most and size["chars"] <= QUOTE_CHARS:
        texts = sorted(r["q"] for r in different.collect())
        spark = passages.sparkSession
        numbers = spark.createDataFrame(list(enumerate(texts)), "number long, q string")
        hits = p.mapInArrow(_scan(spark.sparkContext.broadcast(texts)), f"passage_id {passages.schema['passage_id'].dataType.simpleString()}, number long")
        named = numbers.join(q, "q").select("number", "quote_id")
        return hits.join(named, "number").select("passage_id", "quote_id").distinct()
    short = sorted(r["n"] for r in different.select(F.length("q").alias("n")).where(F.col("n") < GRAM + CHOICE - 1).distinct().collect())  # a few lengths
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    keys = q.select("quote_id", "q").mapInArrow(_keyed((), True), f"id {kind(quotes, 'quote_id')}, key long").select(F.col("id").alias("quote_id"), F.col("key").alias("k"))
    met = p.mapInArrow(_keyed(tuple(short), False), f"id {kind(passages, 'passage_id')}, key long").join(keys, F.col("key") == F.col("k")).select(F.col("id").alias("passage_id"), "quote_id").distinct()
    full = met.join(p, "passage_id").join(q, "quote_id")
    return full.where(F.contains("p", "q")).select("passage_id", "quote_id").distinct()


def alike(a: Column, b: Column) -> Column:
    """Whether two words are equal or begin alike: in all letters but the last two of one of them, four at least."""
    stem = lambda w: F.substring(w, F.lit(1), F.greatest(F.lit(CLASS), F.length(w) - 2))
    return (a == b) | ((F.length(a) >= CLASS) & (F.length(b) >= CLASS) & (F.startswith(b, stem(a)) | F.startswith(a, stem(b))))


def word_class(word: Column) -> Column:
    """Equal for all words that are alike."""
    return F.substring(word, 1, CLASS)


def words_of(text: Column) -> Column:
    """The plain words of a text, none for an empty one."""
    return F.filter(F.split(plain_key(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def stands_in(phrase: Column, source: Column, gap: Column, nearest: bool = True) -> Column:
    """Whether the words of a phrase (an array) stand in a source (an array) in order, each alike and at most gap (0 to 4)
    words after the one before; of several the nearest counts, or each of them (nearest=False). The ends of the phrase's
    beginnings are followed word by word through the source."""

    def following(ends: Column, word: Column) -> Column:
        def places(e: Column) -> list[Column]:
            return [F.when((F.lit(d - 1) <= gap) & alike(word, F.get(source, e + d)), e + d) for d in range(1, 6)]

        found = F.transform(ends, lambda e: F.coalesce(*places(e))) if nearest else F.flatten(F.transform(ends, lambda e: F.array(*places(e))))
        return F.array_distinct(F.array_compact(found))

    first = F.get(phrase, F.lit(0))
    ends = F.filter(F.transform(source, lambda w, i: F.when(alike(first, w), i)), lambda e: e.isNotNull())
    rest = F.slice(phrase, F.lit(2), F.greatest(F.size(phrase) - 1, F.lit(0)))
    return (F.size(phrase) > 0) & (F.size(F.aggregate(rest, ends, following)) > 0)


def _near_keys(classes: Column) -> Column:
    """Rows of an index: each word class of a text and each pair of them up to REACH words apart, by hashes."""
    of = [F.col(f"w.{k}") for k in range(REACH + 1)]
    return F.array(F.xxhash64(of[0], of[0], F.lit(0)), *[F.xxhash64(of[0], of[d], F.lit(d)) for d in range(1, REACH + 1)])


def phrases_in(phrases: DataFrame, sources: DataFrame) -> DataFrame:
    """phrases (phrase_id, phrase, gap), sources (source_id, text): pairs where the phrase stands in the source, see stands_in().

    An index of pairs of word classes and how far they are apart: each phrase is looked up by that pair of its neighbouring
    words that the fewest sources have within its gap (one word by its class), and only sources with it are read word by
    word. A phrase with a pair that no source has stands nowhere. Hashes that meet by chance are told apart by that reading.
    """
    want = phrases.select("phrase_id", "gap", words_of(F.col("phrase")).alias("want")).where(F.size("want") > 0)
    classes = F.transform("want", word_class)
    pairs = F.when(F.size("want") > 1, F.transform(F.slice(classes, 2, 1_000_000), lambda b, k: F.struct(F.get(classes, k).alias("a"), b.alias("b")))).otherwise(F.array(F.struct(F.get(classes, F.lit(0)).alias("a"), F.get(classes, F.lit(0)).alias("b"))))
    apart = F.when(F.size("want") > 1, F.sequence(F.lit(1), F.col("gap").cast("int") + 1)).otherwise(F.array(F.lit(0)))
    each = want.select("phrase_id", "gap", apart.alias("apart"), F.explode(F.array_distinct(pairs)).alias("pair")).select("phrase_id", "gap", "pair", F.explode("apart").alias("d"))
    asked = each.select("phrase_id", "gap", "pair", F.xxhash64("pair.a", "pair.b", "d").alias("key"))
    words = sources.select("source_id", F.transform(words_of(F.col("text")), word_class).alias("c"))
    rows = words.select("source_id", F.explode(F.arrays_zip(*[F.slice("c", d + 1, 1_000_000_000).alias(str(d)) for d in range(REACH + 1)])).alias("w"))
    keyed = rows.select("source_id", F.explode(_near_keys(F.col("w"))).alias("key"))
    index = keyed.join(asked.select("key").distinct(), "key", "left_semi").distinct()
    spread = index.groupBy("key").agg(F.count("*").alias("n"))
    rated = asked.join(spread, "key", "left").groupBy("phrase_id", "gap", "pair").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rarest = rated.groupBy("phrase_id", "gap").agg(F.min_by("pair", F.struct("n", "pair")).alias("pair"))
    chosen = asked.join(rarest, ["phrase_id", "gap", "pair"]).select("phrase_id", "gap", "key")
    met = chosen.join(index, "key").select("phrase_id", "gap", "source_id").distinct()
    full = met.join(sources.select("source_id", "text"), "source_id").join(want, ["phrase_id", "gap"])
    held = let(words_of(F.col("text")), lambda have: stands_in(F.col("want"), have, F.col("gap")))
    return full.where(held).select("phrase_id", "gap", "source_id").distinct()
