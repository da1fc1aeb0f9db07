"""Vocabulary: categories of phrases, gapped examples and the word game.

A null word counts as an empty one, a null label as a word. Repeated items are decided each; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marktide.functions.values import half_up

# Word lists that decide categories. Longer lists of verbs come as a parameter (see categories()).
PARTICLES = "up out down off on in into onto away back over through along around about apart aside forward forth across by past under together ahead round".split()
PREPOSITIONS = "to at for from of with against upon".split()
PLAIN_PREPOSITIONS = "at to for of from".split()
PHRASAL = ["break down", "bring about", "burn off", "carry out", "come across", "come up with", "cut down on", "find out", "get away with", "give up", "go into", "go through", "look into", "look forward to", "make up for", "point out", "put off", "put up with", "run into", "set off", "set up", "take on", "take over", "turn into", "turn out", "work out", "stumble upon"]
IDIOMS = ["a blessing in disguise", "a double-edged sword", "a drop in the ocean", "a piece of cake", "be in luck", "break new ground", "bear fruit", "in luck", "keep an eye on", "the tip of the iceberg", "turn a blind eye to", "under the weather", "when it comes to", "you are in luck", "you're in luck"]
FIXED_PHRASES = ["come close to doing", "make a note of", "up to date"]
CONNECTORS = ["in response to", "in terms of", "as a result of", "with regard to", "with respect to", "in addition to", "in contrast to", "on the basis of", "in relation to", "in line with", "in accordance with", "by means of", "in favour of", "in favor of", "in the context of", "as opposed to", "due to", "owing to", "prior to", "regardless of", "apart from", "in comparison with", "in comparison to", "with the aim of", "for the purpose of", "on behalf of", "in the absence of", "in the event of", "by virtue of"]
CATEGORIES = ["word", "phrasal_verb", "idiom", "collocation", "grammar"]
ALIASES = {"phrasal verb": "phrasal_verb", "phrasalverb": "phrasal_verb", "phrasal": "phrasal_verb", "idioms": "idiom", "expression": "collocation", "fixed expression": "collocation", "collocations": "collocation", "prepositional phrase": "collocation", "linking phrase": "collocation", "grammar structure": "grammar", "structure": "grammar", "single word": "word", "vocabulary": "word", "vocab": "word"}
DROP = "__drop__"
COPULAS = "being been be is are was were".split()
AUXILIARIES = "have has had is are was were am be been being will would".split()
TENSE_WORDS = (" tense", "passive voice", "passive tense")
LEADING_PREPOSITIONS = "in on at by with for as of to from due owing prior apart regardless".split()
NO_VERB = "the a an in on at by".split()
THIRD_AFTER_WORD, THIRD = "with to for on".split(), "with to for on of from".split()


def spaced(text: Column) -> Column:
    """Lower case, runs of white space one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\f\r]+", " "))


def known_category(label: Column) -> Column:
    """One of CATEGORIES for a label as it was given; what is unknown is a word."""
    low = F.replace(F.trim(F.lower(F.coalesce(label, F.lit("")))), F.lit("-"), F.lit("_"))
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.when(low.isin(*CATEGORIES, DROP), low).otherwise(F.coalesce(F.try_element_at(table, F.replace(low, F.lit("_"), F.lit(" "))), F.lit("word")))


def is_template(pattern: Column) -> Column:
    """Whether a grammar item has slots or names a structure, so that it is more than one conjugated phrase."""
    # Signs of a slot, names of slots, names of structures.
    return (
        pattern.rlike(r"\.\.\.|…|\+|/") | pattern.rlike(r"\b(?:S|V|O|N|sb|sth|adj|inf|to-infinitive|infinitive)\b")
        | pattern.rlike("(?i)inversion|passive|cleft|conditional|comparative|correlative|relative clause|reported speech|subjunctive|gerund")
    )


def _head(word: Column) -> Column:
    """The longest known phrasal verb that a phrase is or begins with."""
    out = F.lit(None).cast("string")
    for verb in sorted(PHRASAL, key=len):
        out = F.when((word == verb) | word.startswith(f"{verb} "), F.lit(verb)).otherwise(out)
    return out


def categories(items: DataFrame, prepositional: DataFrame, basic: DataFrame, word: str = "word", label: str = "category") -> DataFrame:
    """items with word (a phrasal verb cut to the verb itself) and category; items that are dropped are left out.

    prepositional (phrase) lists verbs whose preposition keeps its meaning, basic (verb) everyday verbs; both are joined by
    their text, so they may be long. figurative, established (boolean), confidence and meaning are used if items has them.
    Known phrases decide first; then the shape of the phrase: a particle after a verb makes a phrasal verb, an idiom needs
    evidence that it is figurative, of no low confidence. A leading "to" goes from phrasal verbs alone.
    """
    have = lambda c, other: F.col(c) if c in items.columns else other
    figurative = F.coalesce(have("figurative", F.lit(False)), F.lit(False))
    sure = F.coalesce(have("established", F.lit(True)), F.lit(True)) & (F.lower(F.coalesce(have("confidence", F.lit("")), F.lit(""))) != "low")
    start = spaced(F.col(word))
    rows = items.withColumns({"_head": _head(start), "_given": known_category(F.col(label)), "_figurative": figurative & sure, "_meaning": F.lower(F.coalesce(have("meaning", F.lit("")), F.lit("")))})
    rows = rows.withColumn("_w", F.coalesce("_head", start))
    rows = rows.withColumns({"_t": F.split("_w", " "), "_bare": F.when(F.col("_w").rlike("^to [^ ]+ [^ ]"), F.substring("_w", 4, 1_000_000)).otherwise(F.col("_w"))})
    rows = rows.withColumn("_bt", F.split("_bare", " "))
    lists = prepositional.select(F.col("phrase").alias("_p")).distinct()
    everyday = basic.select(F.col("verb").alias("_b")).distinct()
    rows = rows.join(lists, F.regexp_replace("_w", "^to ", "") == F.col("_p"), "left").join(everyday, F.get("_bt", F.lit(0)) == F.col("_b"), "left")
    w, t, bt = F.col("_w"), F.col("_t"), F.col("_bt")
    n, first, second, third, last = F.size(t), F.get(t, F.lit(0)), F.get(t, F.lit(1)), F.get(t, F.lit(2)), F.element_at(t, -1)
    within = lambda c, words: F.coalesce(c.isin(words), F.lit(False))
    particle, everyday_verb = within(second, PARTICLES), F.col("_b").isNotNull()
    locked = F.col("_p").isNotNull() & ~w.isin(PHRASAL)
    c = F.when(F.col("_head").isNotNull(), "phrasal_verb").otherwise(F.col("_given"))
    known = (
        F.when(locked | w.isin(FIXED_PHRASES), "collocation").when(w.isin(IDIOMS), "idiom").when(w.isin(PHRASAL), "phrasal_verb").when(w.isin(CONNECTORS), "collocation")
        .when((w != "") & (n == 1) & c.isin("idiom", "collocation"), "word").when((c == "grammar") & (n <= 4) & w.rlike(rf"^(?:{'|'.join(LEADING_PREPOSITIONS)})(?![\pL\pN_])"), "collocation").otherwise(c)
    )
    rows = rows.withColumn("_c", F.when(F.col("_given") == DROP, DROP).otherwise(known))
    c = F.col("_c")
    with_particle = particle & ((n == 2) | ((n == 3) & within(third, THIRD_AFTER_WORD)))
    c = F.when((c == "word") & (n > 1), F.when(with_particle, "phrasal_verb").otherwise("collocation")).otherwise(c)
    two = (n == 2) & ~within(first, NO_VERB) & within(last, PARTICLES)
    c = F.when(c == "idiom", F.when(w.isin(IDIOMS) | F.col("_figurative"), "idiom").when(two, "phrasal_verb").otherwise("collocation")).otherwise(c)
    shaped = F.when((n == 2) & within(second, PLAIN_PREPOSITIONS) & everyday_verb, DROP).when(particle & ((n == 2) | ((n == 3) & within(third, THIRD))), "phrasal_verb").otherwise("collocation")
    rows = rows.withColumn("_c", c)
    rows = rows.withColumn("_c", F.when((F.col("_c") == "collocation") & ~locked, shaped).otherwise(F.col("_c")))
    later = F.exists(F.slice(bt, 2, 100), lambda x: x.isin(PARTICLES))
    verb = (
        F.when(F.col("_bare").isin(PHRASAL), "phrasal_verb").when(within(F.get(bt, F.lit(0)), COPULAS) | (F.size(bt) < 2), DROP).when(later, "phrasal_verb")
        .when(everyday_verb & within(F.get(bt, F.lit(1)), PLAIN_PREPOSITIONS), DROP).otherwise("collocation")
    )
    was_verb = F.col("_c") == "phrasal_verb"
    rows = rows.withColumns({"_shown": F.when(F.col("_head").isNotNull(), F.col("_head")).otherwise(F.trim(F.col(word))), "_was": was_verb, "_c": F.when(was_verb, verb).otherwise(F.col("_c"))})
    now = F.get(F.split(F.when(F.col("_was"), F.col("_bare")).otherwise(w), " "), F.lit(0))
    tense = F.exists(F.array(*map(F.lit, TENSE_WORDS)), lambda x: F.contains(F.col("_meaning"), x))
    gone = (F.col("_c").isin("collocation", "word", "idiom") & within(now, AUXILIARIES) & tense) | ((F.col("_c") == "grammar") & ~is_template(F.coalesce(F.col(word), F.lit(""))))
    kept = rows.where((F.col("_c") != DROP) & ~gone)
    shown = F.when(F.col("_was") & (F.col("_bare") != w), F.col("_bare")).otherwise(F.col("_shown"))
    return kept.withColumns({word: shown, label: F.col("_c")}).select(*dict.fromkeys([*items.columns, label]))


# The types that a labeller gives, and their category.
TYPES = {"single_word": "word", "word": "word", "grammar_template": "grammar", "grammar": "grammar", "phrasal_verb": "phrasal_verb", "prepositional_verb": "collocation", "collocation": "collocation", "fixed_phrase": "collocation", "prepositional_phrase": "collocation", "expression": "collocation", "idiom": "idiom"}


def apply_labels(items: DataFrame, labels: DataFrame, word: str = "word", label: str = "category", place: str | None = None) -> DataFrame:
    """items with the category that labels (word, keep, established, figurative, lexical_type, confidence) give their word.

    An idiom needs figurative true and a phrasal verb of low confidence is a collocation. Items that a label does not keep
    are dropped, items without a label stay as they are. Of several labels of a word the largest counts. place: a column of
    both tables, from 0; where both have as many rows, an item without a label of its word takes the one at its place. If
    labels has canonical_form, a phrasal verb takes it where its source_sentence (or example) holds it.
    """
    canonical = F.col("canonical_form") if "canonical_form" in labels.columns else F.lit(None).cast("string")
    parts = F.struct("keep", "established", "figurative", "lexical_type", "confidence", canonical.alias("canonical_form"))
    one = labels.groupBy(spaced(F.col("word")).alias("_w")).agg(F.max(parts).alias("_l"))
    rows = items.join(one, spaced(F.col(word)) == F.col("_w"), "left")
    if place:
        sizes = items.agg(F.count("*").alias("_n")).crossJoin(labels.agg(F.count("*").alias("_m")))  # one row
        at = labels.groupBy(F.col(place).alias("_i")).agg(F.max(parts).alias("_o"))
        rows = rows.join(at, F.col(place) == F.col("_i"), "left").crossJoin(F.broadcast(sizes))
        rows = rows.withColumn("_l", F.coalesce("_l", F.when(F.col("_n") == F.col("_m"), F.col("_o"))))
    kind = F.regexp_replace(F.trim(F.lower(F.coalesce(F.col("_l.lexical_type"), F.lit("")))), "[- ]", "_")
    base = F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), kind)
    low = F.lower(F.trim(F.coalesce(F.col("_l.confidence"), F.lit("medium")))) == "low"
    weak = ((base == "idiom") & ~F.coalesce(F.col("_l.figurative"), F.lit(False))) | ((base == "phrasal_verb") & low)
    gone = ~F.coalesce(F.col("_l.keep"), F.lit(True)) | ~F.coalesce(F.col("_l.established"), F.lit(True)) | kind.isin("not_lexical", "drop")
    found = F.when(weak, "collocation").otherwise(F.coalesce(base, F.col(label)))
    form = spaced(F.col("_l.canonical_form"))
    context = F.coalesce(*[F.col(c) for c in ("source_sentence", "example") if c in items.columns], F.lit(""))
    held = F.contains(F.concat(F.lit(" "), spaced(F.regexp_replace(F.lower(context), "[^a-z0-9' ]", " ")), F.lit(" ")), F.concat(F.lit(" "), form, F.lit(" ")))
    cut = (kind == "phrasal_verb") & F.size(F.split(form, " ")).between(2, 5) & held
    out = rows.where(~gone).withColumns({word: F.when(F.coalesce(cut, F.lit(False)), form).otherwise(F.col(word)), label: found, "figurative": F.col("_l.figurative"), "established": F.col("_l.established"), "confidence": F.col("_l.confidence")})
    return out.select(*dict.fromkeys([*items.columns, "figurative", "established", "confidence"]))


def gapped(word: Column, example: Column, gap: str = "·····") -> Column:
    """The example with the first occurrence of the word, or else of a form of it, replaced by a gap; null if none is found."""
    base = F.trim(word)
    quoted = lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("")), F.lit("\\E"))
    stem = F.regexp_replace(base, "(?i)[ey]$", "")
    forms = [
        F.concat(F.lit(r"\b"), quoted(base), F.lit(r"\b")),
        F.concat(F.lit(r"\b"), quoted(base), F.lit(r"(?:s|es|ed|ing|d|ies|ied|er|est|ly)\b")),
        F.when(F.length(base) > 3, F.concat(F.lit(r"\b"), quoted(stem), F.lit(r"(?:e|es|ed|ing|ies|ied)\b"))),
    ]
    tries = [F.when(example.rlike(f) if isinstance(f, str) else F.rlike(example, F.concat(F.lit("(?i)"), f)), F.regexp_replace(example, F.concat(F.lit("(?is)^(.*?)"), f), F.lit(f"$1{gap}"))) for f in forms]
    return F.when((base != "") & (example != ""), F.coalesce(*tries))


def game_round(cards: DataFrame, pool: str, ante: int, flood: bool = False, seed: int = 0) -> DataFrame:
    """cards (pool, card_id, word): the tiles of a round, each with role target or decoy, in an order drawn by a hash.

    Targets are 4 and one more for every two antes, 6 at most and at least 3; decoys 2 (4 in a flood) and one for every two
    antes, 5 at most. No decoy repeats the word of another tile.
    """
    drawn = F.xxhash64(F.lit(seed), "card_id")
    size = F.count("*").over(Window.partitionBy(pool))
    n_targets = F.greatest(F.lit(3), F.least(F.lit(4 + (ante - 1) // 2), F.lit(6), size - 1))
    rows = cards.select(pool, "card_id", "word", drawn.alias("_o"), F.lower("word").alias("_k"), n_targets.alias("_m"))
    rows = rows.withColumn("_t", F.row_number().over(Window.partitionBy(pool).orderBy("_o", "card_id")) <= F.col("_m"))
    same = Window.partitionBy(pool, "_k")
    rows = rows.withColumns({"_taken": F.bool_or("_t").over(same), "_n": F.row_number().over(same.orderBy("_o", "card_id"))})
    able = rows.where(F.col("_t") | (~F.col("_taken") & (F.col("_n") == 1)))
    place = F.row_number().over(Window.partitionBy(pool, "_t").orderBy("_o", "card_id"))
    chosen = able.withColumn("_p", place).where(F.col("_t") | (F.col("_p") <= min((4 if flood else 2) + ante // 2, 5)))
    return chosen.select(pool, "card_id", "word", F.when(F.col("_t"), "target").otherwise("decoy").alias("role"))


def act_reward(ante: Column, factor: Column, chain: Column, boss: Column, pot: Column) -> Column:
    """What a cleared act pays."""
    base = half_up((ante * 3 + 5) * factor) + chain
    return half_up(base * F.when(boss, 2).otherwise(1) * pot)


def tile_answers(answers: DataFrame, tiles: DataFrame, who: list[str], order: list[str]) -> DataFrame:
    """answers (who, order, card_id, tile_id) against tiles (tile_id, card_id): right if the tile is the card's own; with the chain of right ones."""
    known = tiles.select(F.col("tile_id").alias("_t"), F.col("card_id").alias("_c"))
    rows = answers.join(known, F.col("tile_id") == F.col("_t"), "left").withColumn("right", F.coalesce(F.col("card_id") == F.col("_c"), F.lit(False))).drop("_t", "_c")
    return answer_chains(rows, who, order, "right")


def answer_chains(answers: DataFrame, who: list[str], order: list[str], correct: str) -> DataFrame:
    """answers with chain: right answers in a row up to each, 0 at a wrong one."""
    w = Window.partitionBy(*who).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = answers.withColumn("_lost", F.sum((~F.col(correct)).cast("int")).over(w))
    w2 = Window.partitionBy(*who, "_lost").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("chain", F.sum(F.col(correct).cast("int")).over(w2)).drop("_lost")
