"""Queries on pages, documents, quotes and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marktide.functions.values import clock, item_key, plain_key, sentences, strip_tags
from marktide.operators import alignment, search
from marktide.sources.tables import table


def html_strip(spark, d):
    text = strip_tags(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(text).alias("n_chars"), F.md5(text.cast("binary")).alias("digest"))


def sentence_split(spark, d):
    parts = sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(parts).alias("n_sentences"), F.array_max(F.transform(parts, lambda x: F.length(x))).alias("longest"))


def text_key(spark, d):
    return table(spark, d, "part").select("p_partkey", item_key(F.concat(F.col("p_name"), F.lit(" É-Nguyễn Thị Ngọc Đạt e\u0301 "), F.col("p_type"))).alias("item_key"), plain_key(F.concat(F.col("p_name"), F.lit(" É-"), F.col("p_type"))).alias("word_key"))


def evidence_valid(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), "text")
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return search.quotes_in(docs, quotes)


def evidence_fallback(spark, d):
    """For each item the sentence of the document with its number that shares most words with it."""
    items = table(spark, d, "benchmark").select("item_id", F.array_distinct(F.split(plain_key(F.col("text")), " ")).alias("query"))
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    rows = docs.join(items, F.col("doc_id") == F.col("item_id"))
    return alignment.best_sentences(rows, "item_id", F.col("query")).select("item_id", "pos", "overlap")


def label_join(spark, d):
    """A document's own label, else the label at its place in a list of equal order."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = table(spark, d, "documents").select("doc_id", "lang")
    by_lang = docs.join(labels, "doc_id").groupBy("lang").agg(F.max_by("toxic", F.col("doc_id")).alias("usual"))
    return docs.join(labels, "doc_id", "left").join(by_lang, "lang", "left").select("doc_id", F.coalesce("toxic", "usual").alias("label"), F.col("toxic").isNull().alias("inferred"))


def _segments(spark, d):
    start = F.col("turn") * 3
    return table(spark, d, "conversations").select("conv_id", "turn", start.cast("double").alias("s"), (start + 2 + F.length("text") % 4).cast("double").alias("e"), "text")


def transcript_blocks(spark, d):
    blocks = alignment.transcript_blocks(_segments(spark, d), "conv_id", "turn", "s", "e", "text")
    return blocks.select("conv_id", "block_no", F.concat(F.lit("("), clock(F.col("start_s")), F.lit(" - "), clock(F.col("end_s")), F.lit(")")).alias("mark"), F.length("block_text").alias("n_chars"))


def phrase_ground(spark, d):
    """Whether the words of an item stand in some document, with and without gaps."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"), F.explode(F.array(F.lit(0), F.lit(4))).alias("gap"))
    found = search.phrases_in(items, table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "text"))
    held = found.groupBy("phrase_id").agg(F.bool_or(F.col("gap") == 0).alias("e"), F.bool_or(F.col("gap") == 4).alias("l"))
    rows = table(spark, d, "benchmark").join(held, F.col("item_id") == F.col("phrase_id"), "left")
    return rows.select("item_id", F.coalesce("e", F.lit(False)).alias("exact"), F.coalesce("l", F.lit(False)).alias("loose"))


def nearest_marker(spark, d):
    """The turn of a conversation whose start is nearest to a cited second, the first of equals."""
    cited = (F.col("conv_id") * 7) % 23
    return _segments(spark, d).groupBy("conv_id").agg(F.min_by("s", F.struct(F.abs(F.col("s") - cited), F.col("turn"))).alias("nearest"))


QUERIES = {f.__name__: f for f in (html_strip, sentence_split, text_key, evidence_valid, evidence_fallback, label_join, transcript_blocks, phrase_ground, nearest_marker)}

_S = r"[ \t\n\f\r]+"
_SPLIT = rf"string_split(regexp_replace(text, '([.?!]){_S}', '\1' || chr(1), 'g'), chr(1))"
_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
ALIKE_SQL = "({a} = {b} OR (length({a}) >= 4 AND length({b}) >= 4 AND (starts_with({b}, substr({a}, 1, greatest(4, length({a}) - 2))) OR starts_with({a}, substr({b}, 1, greatest(4, length({b}) - 2))))))"
ORACLE_SQL = {
    "html_strip": rf"SELECT page_id, length(t)::INT AS n_chars, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '{_S}', ' ', 'g')) AS t FROM pages)",
    "sentence_split": f"SELECT doc_id, len({_SPLIT})::INT AS n_sentences, list_max(list_transform({_SPLIT}, lambda x: length(x)))::INT AS longest FROM documents",
    "text_key": "SELECT p_partkey, " + _KEY.format("strip_accents(p_name || ' É-Nguyễn Thị Ngọc Đạt e\u0301 ' || p_type)") + " AS item_key, " + _KEY.format("p_name || ' É-' || p_type") + " AS word_key FROM part",
    "evidence_valid": rf"WITH p AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '{_S}', ' ', 'g')) AS p FROM documents), q AS (SELECT item_id, trim(regexp_replace(lower(coalesce(text, '')), '{_S}', ' ', 'g')) AS q FROM benchmark) SELECT DISTINCT doc_id AS passage_id, item_id AS quote_id FROM p JOIN q ON q <> '' AND contains(p, q)",
    "evidence_fallback": f"""
        WITH s AS (SELECT doc_id, unnest({_SPLIT}) AS sentence, generate_subscripts({_SPLIT}, 1) - 1 AS pos FROM documents),
        r AS (SELECT item_id, pos, sentence, len(list_intersect(list_distinct(string_split({_KEY.format("s.sentence")}, ' ')), list_distinct(string_split({_KEY.format("b.text")}, ' ')))) AS overlap FROM s JOIN benchmark b ON b.item_id = s.doc_id)
        SELECT item_id, pos::INT AS pos, overlap::INT AS overlap FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, abs(length(sentence) - 150), pos) = 1
    """,
    "label_join": "WITH l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1), u AS (SELECT lang, arg_max(toxic, doc_id) AS usual FROM documents JOIN l USING (doc_id) GROUP BY 1) SELECT doc_id, coalesce(toxic, usual) AS label, toxic IS NULL AS inferred FROM documents LEFT JOIN l USING (doc_id) LEFT JOIN u USING (lang)",
    "transcript_blocks": """
        WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn * 3 AS s, turn * 3 + 2 + length(text) % 4 AS e, trim(text) AS x FROM conversations WHERE trim(coalesce(text, '')) <> ''),
        f AS (
            SELECT conv_id, k, 0 AS block_no, s AS b, e, length(x) AS n FROM t WHERE k = 1
            UNION ALL SELECT t.conv_id, t.k, CASE WHEN t.e - f.b > 8 THEN f.block_no + 1 ELSE f.block_no END, CASE WHEN t.e - f.b > 8 THEN t.s ELSE f.b END, t.e, CASE WHEN t.e - f.b > 8 THEN length(t.x) ELSE f.n + 1 + length(t.x) END
            FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1)
        SELECT conv_id, block_no, '(' || (b // 60) || ':' || lpad((b % 60)::VARCHAR, 2, '0') || ' - ' || (max(e) // 60) || ':' || lpad((max(e) % 60)::VARCHAR, 2, '0') || ')' AS mark, max(n)::INT AS n_chars FROM f GROUP BY conv_id, block_no, b
    """,
    "phrase_ground": f"""
        WITH RECURSIVE b AS (SELECT item_id, list_filter(string_split({_KEY.format("coalesce(text, '')")}, ' '), lambda x: x <> '') AS ws FROM benchmark),
        w AS (SELECT item_id, len(ws) AS size, generate_subscripts(ws, 1) AS k, unnest(ws) AS word FROM b),
        d AS (SELECT doc_id, list_filter(string_split({_KEY.format("coalesce(text, '')")}, ' '), lambda x: x <> '') AS ws FROM documents),
        t AS (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM d),
        pairs AS (SELECT DISTINCT w.word AS a, v.word AS b FROM w JOIN (SELECT DISTINCT word FROM t) v ON substr(w.word, 1, 4) = substr(v.word, 1, 4) AND {ALIKE_SQL.format(a="w.word", b="v.word")}),
        m AS (SELECT item_id, doc_id, k, size, pos FROM w JOIN pairs ON a = w.word JOIN t ON t.word = b),
        whole AS (SELECT m.* FROM m JOIN (SELECT item_id, doc_id FROM m GROUP BY item_id, doc_id HAVING count(DISTINCT k) = max(size)) USING (item_id, doc_id)),
        steps AS (SELECT x.item_id, x.doc_id, gap, x.k, x.pos, min(y.pos) AS next FROM whole x CROSS JOIN (VALUES (0), (4)) g(gap) JOIN whole y ON y.item_id = x.item_id AND y.doc_id = x.doc_id AND y.k = x.k + 1 AND y.pos > x.pos AND y.pos <= x.pos + 1 + gap GROUP BY ALL),
        ends AS (SELECT item_id, doc_id, gap, k, pos, size FROM whole CROSS JOIN (VALUES (0), (4)) g(gap) WHERE k = 1
            UNION SELECT e.item_id, e.doc_id, e.gap, e.k + 1, next, size FROM ends e JOIN steps s ON s.item_id = e.item_id AND s.doc_id = e.doc_id AND s.gap = e.gap AND s.k = e.k AND s.pos = e.pos),
        held AS (SELECT item_id, bool_or(gap = 0) AS e, bool_or(gap = 4) AS l FROM ends WHERE k = size GROUP BY 1)
        SELECT item_id, coalesce(e, false) AS exact, coalesce(l, false) AS loose FROM benchmark LEFT JOIN held USING (item_id)
    """,
    "nearest_marker": "SELECT conv_id, arg_min(turn * 3, (abs(turn * 3 - (conv_id * 7) % 23), turn))::DOUBLE AS nearest FROM conversations GROUP BY conv_id",
}
