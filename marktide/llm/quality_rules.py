"""Quality rules whose cutoffs carry a guarantee on false rejections.

Every rule is a feature of a text and rejects values above a cutoff. Labelled documents are the holdout: no feature is
fitted to them. The union of all rules is tested along one fixed sequence of cutoff vectors, from the one that rejects
least to the one that rejects most. Within each stratum (language) the hypothesis "these cutoffs reject more than RISK of
the good documents" is given up if the exact binomial probability of so few rejections is at most the level; the first
vector that fails ends the sequence, so neither risk nor level is divided by rules or cutoffs. The level is divided by the
number of strata (Bonferroni). With probability 1 - LEVEL no stratum loses more than RISK of its good documents to the
rules. A stratum with too few labels to certify any cutoffs of its own loses nothing to them: there the base alone decides.

All of it is DataFrame expressions; what is computed is whole texts, in place, without a shuffle of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, saved

RISK, LEVEL = 0.01, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Cutoffs of each rule, from the one that rejects least.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (4.0, 2.0, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05),
    "exclamations_per_word": (2.0, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05),
    "capital_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2),
    "repeat_share": (0.9, 0.7, 0.6, 0.5, 0.4, 0.3),
    "duplicate_lines_per_line": (0.9, 0.7, 0.5, 0.4, 0.3),
}
#: Vectors of cutoffs for the union of all rules, from the one that rejects least. They are fixed ahead, not fitted to labels.
VECTORS = [[c[min(k, len(c) - 1)] for c in CUTOFFS.values()] for k in range(max(map(len, CUTOFFS.values())))]
#: A table of cutoffs with more strata than that is joined by a shuffle instead of a broadcast.
MAX_STRATA = 500
#: Texts of more words have their windows compared by all 64 bits of the hash, which costs more.
PACKED_WORDS = 1 << 16

_WORD = r"[^\x20\x09-\x0D]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; windows are compared by hash, at 47 bits or more.

    Hashes carry their place in their low bits, so one sort of numbers puts equal windows side by side. Longer texts sort
    pairs of hash and place.
    """
    n = F.size(words)
    hashed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def at(low: Column) -> Column:
        return let(F.sort_array(_keyed(hashed, low)), lambda s: _covered(F.sort_array(_equal_neighbours(s, low))))

    packed = let(F.length(F.bin(n.cast("long"))), at)
    pairs = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    return F.when(n < 4, F.lit(0)).when(n <= PACKED_WORDS, packed).otherwise(let(pairs, lambda s: _covered(F.sort_array(_equal_pairs(s))))).cast("long")


def _equal_pairs(s: Column) -> Column:
    """Places of the pairs (h, i) that share their hash with the pair before or after; s is sorted."""
    twin = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
    return F.transform(F.filter(s, twin), lambda x: x["i"])


def _keyed(hashed: Column, low: Column) -> Column:
    step = F.pow(F.lit(2.0), low).cast("long")
    return let(step, lambda m: F.transform(hashed, lambda h, i: (h - F.pmod(h, m)) + i))


def _equal_neighbours(s: Column, low: Column) -> Column:
    """Places of the keys that share their hash with the key before or after; s is sorted."""

    def twin(x: Column, i: Column, m: Column) -> Column:
        own = x - F.pmod(x, m)
        before, after = F.get(s, i - 1), F.get(s, i + 1)
        return F.coalesce(before - F.pmod(before, m) == own, F.lit(False)) | F.coalesce(after - F.pmod(after, m) == own, F.lit(False))

    step = F.pow(F.lit(2.0), low).cast("long")
    return let(step, lambda m: F.transform(F.filter(s, lambda x, i: twin(x, i, m)), lambda x: F.pmod(x, m)))


def _covered(places: Column) -> Column:
    """Words in the union of [p, p + 3) over the ascending places."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"))
    return F.aggregate(places, start, step, lambda a: a["n"])


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _chars(text: Column, other: str) -> Column:
    """Characters of text outside the class of other characters."""
    return F.length(F.regexp_replace(text, f"[{other}]+", "")).cast("long")


def with_features(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the base counts, base_failed and the rules' features added, each name after prefix."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1))
    counts = {
        "w": let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))),
        "word_chars": _chars(text, r"\x20\x09-\x0D"),
        "n_symbols": _chars(text, r"^#*$%&|<>"),
        "n_dup_lines": _dup_lines(text),
        "marks": _chars(text, "^!"),
        "capitals": _chars(text, "^A-Z"),
        "lines": F.size(F.split(text, "\n")),
    }
    p = prefix
    # the generator keeps the costly columns from being evaluated twice; the names can't be those of a table's columns
    rows = docs.select("*", F.inline(F.array(F.struct(*[x.alias(f"_llm_x_{k}") for k, x in counts.items()]))))
    c = {k: F.col(f"_llm_x_{k}") for k in counts if k != "w"} | {k: F.col(f"_llm_x_w.{k}") for k in ("n_words", "n_repeat_words")}
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = {k: c[k] for k in BASE} | {
        "base_failed": (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"]),
        "symbols_per_word": per(c["n_symbols"], c["n_words"]),
        "exclamations_per_word": per(c["marks"], c["n_words"]),
        "capital_share": per(c["capitals"], c["word_chars"]),
        "repeat_share": per(c["n_repeat_words"], c["n_words"]),
        "duplicate_lines_per_line": per(c["n_dup_lines"], c["lines"]),
    }
    return rows.select(*[F.col(f"`{x}`") for x in docs.columns], *[x.alias(p + k) for k, x in out.items()])


def binomial_tail(n: Column, k: Column, risk: float) -> Column:
    """P(X <= k) for X ~ Bin(n, risk) where k < n * risk; 1 elsewhere (the test fails there in any case)."""
    odds = risk / (1 - risk)
    steps = F.when(k < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), k))
    log_term = F.aggregate(steps, F.lit(0.0), lambda a, j: a + F.log((n - k + j) / j)) + k * F.log(F.lit(odds)) + n * F.log(F.lit(1 - risk))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def down(a: Column, j: Column) -> Column:
        i = k - j + 1
        term = a["term"] * i / (n - i + 1) / F.lit(odds)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    return F.when(k >= n * risk, F.lit(1.0)).otherwise(F.exp(log_term) * F.aggregate(steps, start, down, lambda a: a["total"]))


def certified_cutoffs(labelled: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """labelled: stratum and the features of the good documents. _llm_stratum, _llm_cutoffs array<double> in the order of CUTOFFS.

    One row for each stratum; the array is null where nothing is certified.
    """
    over = [F.count_if(F.greatest(*[(F.col(r) > c).cast("int") for r, c in zip(CUTOFFS, v, strict=True)]) == 1) for v in VECTORS]
    counted = labelled.groupBy(F.coalesce("stratum", F.lit("")).alias("stratum_key")).agg(F.count("*").alias("n_good"), F.array(*over).alias("ks"))
    rows = counted.crossJoin(F.broadcast(counted.agg(F.count("*").alias("n_tests"))))  # one row
    enough = F.col("n_good") * F.log(F.lit(1 - risk)) <= F.log(F.lit(level) / F.col("n_tests"))
    passes = F.transform("ks", lambda k: binomial_tail(F.col("n_good"), k, risk) <= F.lit(level) / F.col("n_tests"))
    steps = F.aggregate(passes, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, ok: F.struct((a["n"] + (a["on"] & ok).cast("int")).alias("n"), (a["on"] & ok).alias("on")), lambda a: a["n"])
    vectors = F.array(*[F.array(*map(F.lit, v)) for v in VECTORS])
    return rows.select(F.col("stratum_key").alias("_llm_stratum"), F.when(enough, F.get(vectors, steps - 1)).alias("_llm_cutoffs"))


def _accepted(prefix: str = "") -> Column:
    over = [F.coalesce(F.col(prefix + r) > F.get("_llm_cutoffs", F.lit(i)), F.lit(False)) for i, r in enumerate(CUTOFFS)]
    reject = over[0]
    for x in over[1:]:
        reject = reject | x
    return ~F.col(prefix + "base_failed") & ~reject


def _judged(rows: DataFrame, stratum: Column, good: DataFrame) -> DataFrame:
    """rows with _llm_cutoffs. good: stratum and features of the labelled good documents."""
    cutoffs = saved(certified_cutoffs(good), "cutoffs")
    side = F.broadcast(cutoffs) if cutoffs.count() <= MAX_STRATA else cutoffs
    return rows.join(side, F.coalesce(stratum, F.lit("")) == F.col("_llm_stratum"), "left")


def _good(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("_llm_label")).distinct()


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null texts count as empty (no words, so base_failed). Null strata form one stratum. Repeated rows are judged each;
    labels of unknown documents have no effect. An empty table gives an empty result; other input columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).cast("string").alias("text"))
    features = saved(with_features(rows).drop("text"), "features")
    good = features.join(_good(labels), F.col("doc_id") == F.col("_llm_label"), "left_semi")
    return _judged(features, F.col("stratum"), good).select("doc_id", *BASE, "base_failed", _accepted().alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with their own columns; decisions as in quality_rules().

    The rows are written once with their features and judged as they are read back.
    """
    p = "_llm_"
    rows = saved(with_features(docs, text_col, p), "featured")
    id_, stratum = F.col(f"`{id_col}`").cast("long"), F.col(f"`{stratum_col}`").cast("string")
    good = rows.select(id_.alias("doc_id"), stratum.alias("stratum"), *[F.col(p + r).alias(r) for r in CUTOFFS]).join(_good(labels), F.col("doc_id") == F.col("_llm_label"), "left_semi")
    return _judged(rows, stratum, good).where(_accepted(p)).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle_sql() -> str:
    """The same decisions in DuckDB's SQL."""
    rules = {
        "symbols_per_word": "CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END",
        "exclamations_per_word": "CASE WHEN n_words > 0 THEN marks / n_words ELSE 0 END",
        "capital_share": "CASE WHEN word_chars > 0 THEN capitals / word_chars ELSE 0 END",
        "repeat_share": "CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END",
        "duplicate_lines_per_line": "n_dup_lines / lines",
    }
    over = lambda v: " OR ".join(f"{r} > {c}" for r, c in zip(rules, v, strict=True))
    steps = " UNION ALL ".join(f"SELECT doc_id, stratum, {j} AS step, {over(v)} AS rejected FROM f" for j, v in enumerate(VECTORS))
    return rf"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
        g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
        lined AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS filled FROM w),
        b AS (
            SELECT doc_id, stratum, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(filled) - len(list_distinct(filled)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
                length(regexp_replace(t, '[^!]+', '', 'g')) AS marks, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS capitals, len(string_split(t, chr(10))) AS lines
            FROM lined LEFT JOIN repeated USING (doc_id)),
        f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {", ".join(f"{x} AS {r}" for r, x in rules.items())} FROM b),
        r AS ({steps}),
        k AS (
            SELECT stratum, step, count(*) AS n, count(*) FILTER (rejected) AS k FROM r WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL),
        tests AS (SELECT *, (SELECT count(DISTINCT stratum) FROM k) AS m FROM k),
        p AS (
            SELECT *, n * ln(1 - {RISK!r}) <= ln({LEVEL!r} / m) AS enough,
                CASE WHEN k >= n * {RISK!r} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK!r}) + (n - i) * ln(1 - {RISK!r})))) END <= {LEVEL!r} / m AS ok FROM tests),
        best AS (
            SELECT stratum, max(step) FILTER (passed) AS step
            FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum ORDER BY step) AS passed FROM p WHERE enough) GROUP BY stratum),
        last AS (SELECT f.*, own.step FROM f LEFT JOIN best AS own ON own.stratum = f.stratum)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND NOT coalesce(rejected, false) AS kept
        FROM last LEFT JOIN r USING (doc_id, stratum, step)
    """
