"""Queries on vocabulary: every phrase under every label, with SQL that applies the same rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from marktide.operators import submission, vocabulary
from marktide.operators.vocabulary import CONNECTORS, COPULAS, FIXED_PHRASES, IDIOMS, LEADING_PREPOSITIONS, NO_VERB, PARTICLES, PHRASAL, PLAIN_PREPOSITIONS, THIRD, THIRD_AFTER_WORD
from marktide.plans.proofs import _texts
from marktide.plans.texts import _KEY
from marktide.sources.shared import new_path
from marktide.sources.tables import table

_PHRASES = ["depend on", "to depend on", "carry out", "look at", "to look at", "carry out the plan", "go over", "in terms of", "bear fruit", "look forward to", "make peace", "to carry on", "being put off", "kick the bucket", "window", "cut corners on", "not only + V", "walk away from", "is seen", "of the kind"]
_LABELS = ["Idioms", "phrasal-verb", "word", "collocation", "other", "__drop__", "Grammar structure"]
_PREPOSITIONAL, _BASIC = ["depend on", "rely on"], ["look", "go", "make"]
_TYPES = ["idiom", "phrasal verb", "collocation", "not lexical", "single_word", "odd"]


def _pick(xs: list[str], k: int):
    return F.element_at(F.array(*map(F.lit, xs)), (F.floor(F.col("p_partkey") / k) % len(xs) + 1).cast("int"))


def _cards(spark, d):
    n = F.col("p_partkey")
    rows = table(spark, d, "part").select(n, _pick(_PHRASES, 1).alias("word"), _pick(_LABELS, 20).alias("category"), (F.floor(n / 3) % 2 == 0).alias("figurative"), F.when(n % 11 > 0, n % 5 > 0).alias("established"))
    return rows.withColumns({"confidence": _pick(["high", "low", "medium"], 7), "meaning": F.when(n % 13 == 0, "the passive voice of a verb").otherwise("")})


def _lists(spark):
    return spark.createDataFrame([(x,) for x in _PREPOSITIONAL], "phrase string"), spark.createDataFrame([(x,) for x in _BASIC], "verb string")


def vocab_category(spark, d):
    return vocabulary.categories(_cards(spark, d), *_lists(spark)).select("p_partkey", "word", "category")


def _labels(spark, d):
    """A label for each phrase but every fifth one; those at a place, where the word has none, are for half as many rows."""
    n = F.col("p_partkey")
    rows = table(spark, d, "part").where(n < len(_PHRASES)).select(_pick(_PHRASES, 1).alias("word"), (n % 7 != 3).alias("keep"), F.when(n % 3 > 0, n % 11 != 2).alias("established"), F.when(n % 2 == 0, n % 4 == 0).alias("figurative"), _pick(_TYPES, 1).alias("lexical_type"), _pick(["high", "low", "medium"], 1).alias("confidence"), n.alias("n"))
    return rows.where("n % 5 <> 4").drop("n")


def vocab_labels(spark, d):
    out = vocabulary.apply_labels(_cards(spark, d).drop("figurative", "established", "confidence", "meaning"), _labels(spark, d))
    return out.withColumns({"figurative": F.coalesce("figurative", F.lit(False)), "established": F.coalesce("established", F.lit(True)), "confidence": F.coalesce("confidence", F.lit(""))})


def labels_by_place(spark, d):
    """As many labels as cards: a card without a label of its word takes the one at its place."""
    cards = _cards(spark, d).select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Word "), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("odd "), F.col("p_partkey").cast("string"))).alias("word"), "category", F.col("p_partkey").alias("place"))
    n = F.col("p_partkey")
    labels = table(spark, d, "part").select(F.concat(F.lit("word "), n.cast("string")).alias("word"), (n % 7 != 3).alias("keep"), F.lit(True).alias("established"), (n % 4 == 0).alias("figurative"), _pick(_TYPES, 1).alias("lexical_type"), F.lit("high").alias("confidence"), n.alias("place"))
    return vocabulary.apply_labels(cards, labels, place="place").select("p_partkey", "word", "category")


def _names(spark, d):
    items = table(spark, d, "part").select("p_partkey", F.concat(F.upper("p_name"), F.lit(" - "), (F.col("p_partkey") % 7).cast("string")).alias("word"))
    taken = table(spark, d, "part").where("p_size < 10").select(F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 3).cast("string")).alias("word"))
    return items, taken


def vocab_new(spark, d):
    """The first of each name that is not known yet."""
    return submission.new_by_key(*_names(spark, d), "word", ["p_partkey"])


def vocab_written(spark, d):
    """What writing the new names has counted on its way."""
    return submission.written_new(*_names(spark, d), "word", ["p_partkey"], new_path(spark, "new-words"))


def tile_chain(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("who"), F.col("ts").alias("at"), (F.col("event_id") % 50).alias("card_id"), (F.col("event_id") * 7 % 60).alias("tile_id"))
    tiles = spark.range(55).select(F.col("id").alias("tile_id"), ((F.col("id") * 43) % 60).alias("card_id"))
    return vocabulary.tile_answers(e, tiles, ["who"], ["at", "event_id"]).select("event_id", "right", "chain")


QUERIES = {f.__name__: f for f in (vocab_category, vocab_labels, labels_by_place, vocab_new, vocab_written, tile_chain)}


def _at(xs: list[str], k: int) -> str:
    return f"({_texts(xs)})[p_partkey // {k} % {len(xs)} + 1]"


def _in(x: str, xs: list[str]) -> str:
    return f"coalesce({x} IN ({', '.join(chr(39) + y.replace(chr(39), chr(39) * 2) + chr(39) for y in xs)}), false)"


_HEAD = "CASE " + " ".join(f"WHEN word = '{v}' OR starts_with(word, '{v} ') THEN '{v}'" for v in sorted(PHRASAL, key=len, reverse=True)) + " END"
_GIVEN = "CASE category WHEN 'Idioms' THEN 'idiom' WHEN 'phrasal-verb' THEN 'phrasal_verb' WHEN 'other' THEN 'word' WHEN 'Grammar structure' THEN 'grammar' ELSE category END"
_CARDS = f"SELECT p_partkey, {_at(_PHRASES, 1)} AS word, {_at(_LABELS, 20)} AS category, p_partkey // 3 % 2 = 0 AS figurative, coalesce(CASE WHEN p_partkey % 11 > 0 THEN p_partkey % 5 > 0 END, true) AS established, {_at(['high', 'low', 'medium'], 7)} AS confidence, p_partkey % 13 = 0 AS tense FROM part"
_TYPE = "CASE kind WHEN 'idiom' THEN 'idiom' WHEN 'phrasal_verb' THEN 'phrasal_verb' WHEN 'collocation' THEN 'collocation' WHEN 'single_word' THEN 'word' END"
ORACLE_SQL = {
    "vocab_category": f"""
        WITH c AS ({_CARDS}), h AS (SELECT *, {_HEAD} AS head, {_GIVEN} AS given FROM c),
        w AS (SELECT *, coalesce(head, word) AS w FROM h),
        s AS (SELECT *, string_split(w, ' ') AS t, CASE WHEN regexp_matches(w, '^to [^ ]+ [^ ]') THEN substr(w, 4) ELSE w END AS b FROM w),
        x AS (SELECT *, string_split(b, ' ') AS bt, len(t) AS n, {_in("string_split(b, ' ')[1]", _BASIC)} AS basic, {_in("regexp_replace(w, '^to ', '')", _PREPOSITIONAL)} AND NOT {_in('w', PHRASAL)} AS locked, CASE WHEN head IS NOT NULL THEN 'phrasal_verb' ELSE given END AS c0 FROM s),
        a AS (SELECT *, CASE WHEN given = '__drop__' THEN given WHEN locked OR {_in('w', FIXED_PHRASES)} THEN 'collocation' WHEN {_in('w', IDIOMS)} THEN 'idiom' WHEN {_in('w', PHRASAL)} THEN 'phrasal_verb' WHEN {_in('w', CONNECTORS)} THEN 'collocation'
            WHEN n = 1 AND c0 IN ('idiom', 'collocation') THEN 'word' WHEN c0 = 'grammar' AND n <= 4 AND {_in('t[1]', LEADING_PREPOSITIONS)} THEN 'collocation' ELSE c0 END AS c1 FROM x),
        d AS (SELECT *, CASE WHEN c1 = 'word' AND n > 1 THEN CASE WHEN {_in('t[2]', PARTICLES)} AND (n = 2 OR n = 3 AND {_in('t[3]', THIRD_AFTER_WORD)}) THEN 'phrasal_verb' ELSE 'collocation' END ELSE c1 END AS c2 FROM a),
        e AS (SELECT *, CASE WHEN c2 = 'idiom' THEN CASE WHEN {_in('w', IDIOMS)} OR (figurative AND established AND confidence <> 'low') THEN 'idiom' WHEN n = 2 AND NOT {_in('t[1]', NO_VERB)} AND {_in('t[2]', PARTICLES)} THEN 'phrasal_verb' ELSE 'collocation' END ELSE c2 END AS c3 FROM d),
        f AS (SELECT *, CASE WHEN c3 = 'collocation' AND NOT locked THEN CASE WHEN n = 2 AND {_in('t[2]', PLAIN_PREPOSITIONS)} AND basic THEN '__drop__' WHEN {_in('t[2]', PARTICLES)} AND (n = 2 OR n = 3 AND {_in('t[3]', THIRD)}) THEN 'phrasal_verb' ELSE 'collocation' END ELSE c3 END AS c4 FROM e),
        g AS (SELECT *, CASE WHEN c4 = 'phrasal_verb' THEN CASE WHEN {_in('b', PHRASAL)} THEN c4 WHEN {_in('bt[1]', COPULAS)} OR len(bt) < 2 THEN '__drop__' WHEN len(list_filter(bt[2:], lambda y: {_in('y', PARTICLES)})) > 0 THEN c4 WHEN basic AND {_in('bt[2]', PLAIN_PREPOSITIONS)} THEN '__drop__' ELSE 'collocation' END ELSE c4 END AS c5 FROM f)
        SELECT p_partkey, CASE WHEN c4 = 'phrasal_verb' AND b <> w THEN b ELSE w END AS word, c5 AS category FROM g
        WHERE c5 <> '__drop__' AND NOT (c5 = 'grammar' AND NOT contains(word, '+')) AND NOT (c5 IN ('collocation', 'word', 'idiom') AND tense AND {_in("CASE WHEN c4 = 'phrasal_verb' THEN bt[1] ELSE t[1] END", vocabulary.AUXILIARIES)})
    """,
    "vocab_labels": f"""
        WITH c AS ({_CARDS}),
        l AS (SELECT {_at(_PHRASES, 1)} AS w, p_partkey % 7 <> 3 AS keep, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 11 <> 2 END AS est, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 4 = 0 END AS fig, replace({_at(_TYPES, 1)}, ' ', '_') AS kind, {_at(['high', 'low', 'medium'], 1)} AS conf FROM part WHERE p_partkey < {len(_PHRASES)} AND p_partkey % 5 <> 4),
        j AS (SELECT p_partkey, word, category, fig, est, conf, kind, keep, {_TYPE} AS base FROM c LEFT JOIN l ON w = word)
        SELECT p_partkey, word, coalesce(CASE WHEN base = 'idiom' AND NOT coalesce(fig, false) OR base = 'phrasal_verb' AND conf = 'low' THEN 'collocation' END, base, category) AS category, coalesce(fig, false) AS figurative, coalesce(est, true) AS established, coalesce(conf, '') AS confidence
        FROM j WHERE coalesce(keep, true) AND coalesce(est, true) AND coalesce(kind, '') <> 'not_lexical'
    """,
    "labels_by_place": f"""
        WITH j AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Word ' ELSE 'odd ' END || p_partkey AS word, {_at(_LABELS, 20)} AS category, replace({_at(_TYPES, 1)}, ' ', '_') AS kind, {_TYPE.replace('kind', f"replace({_at(_TYPES, 1)}, ' ', '_')")} AS base FROM part WHERE p_partkey % 7 <> 3)
        SELECT p_partkey, word, coalesce(CASE WHEN base = 'idiom' AND p_partkey % 4 <> 0 THEN 'collocation' END, base, category) AS category FROM j WHERE kind <> 'not_lexical'
    """,
    "vocab_new": f"""
        WITH i AS (SELECT p_partkey, upper(p_name) || ' - ' || p_partkey % 7 AS word FROM part), k AS (SELECT *, {_KEY.format('word')} AS k FROM i),
        t AS (SELECT {_KEY.format("p_name || ' ' || p_partkey % 3")} AS k FROM part WHERE p_size < 10)
        SELECT p_partkey, word FROM k WHERE k <> '' AND k NOT IN (SELECT k FROM t) QUALIFY row_number() OVER (PARTITION BY k ORDER BY p_partkey) = 1
    """,
    "tile_chain": """
        WITH r AS (SELECT event_id, user_id, ts, event_id * 7 % 60 < 55 AND (event_id * 7 % 60) * 43 % 60 = event_id % 50 AS ok FROM events),
        l AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lost FROM r)
        SELECT event_id, ok AS "right", (sum(ok::INT) OVER (PARTITION BY user_id, lost ORDER BY ts, event_id))::BIGINT AS chain FROM l
    """,
}
ORACLE_SQL["vocab_written"] = f"SELECT (SELECT count(*) FROM part) AS requested, 0::BIGINT AS blank, count(*) AS returned, (SELECT count(*) FROM part) - count(*) AS dropped FROM ({ORACLE_SQL['vocab_new']})"
