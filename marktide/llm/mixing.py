"""Mixing sources to target weights by Poisson replication.

A source's target rate is how often each of its documents should stand in the mix: its share of the target times the size
of the mix over its own size. Each document gets a uniform number from a hash of its id and the seed, and the Poisson
distribution with that mean, inverted at it, tells how many copies it has; a rate above DRAW_RATE is split into equal rates
with a number and a draw each, so no rate is too high. Copies are exploded and the mix is shuffled
globally, by ranges of a hash of document and copy.

Sizes are sums with map-side combining, one row per source; the table of rates joins by source as a shuffle-free broadcast
only while it stays under MAX_SOURCES rows, else by an ordinary join. Numbers depend on nothing but id and seed, so a task
that is run again makes the same copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, partitions, saved

SEED = 42
#: The target share of a source follows its size to this power: below 1 it lifts small sources.
TEMPERATURE = 0.7
#: Largest mean of one Poisson draw: exp(-rate) is far from underflow, and the SQL's 200 terms hold all of its mass.
DRAW_RATE = 100.0
#: Copies of a document that one row of the explosion makes.
COPIES = 10_000
MAX_SOURCES = 10_000
_DIGITS = 13  # hex digits of a hash that make a uniform number


def uniform(*parts: Column | str, seed: int = SEED) -> Column:
    """A number in [0, 1) from SHA-256 over the seed and the parts."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, _DIGITS), 16, 10).cast("long") / F.lit(float(16**_DIGITS))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The smallest k with P(X <= k) > u for a Poisson X of mean rate; for rates up to DRAW_RATE."""
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("total"), F.lit(0).alias("k"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] * rate / i
        return F.when(u < a["total"], a).otherwise(F.struct(term.alias("term"), (a["total"] + term).alias("total"), i.alias("k")))

    return F.aggregate(F.sequence(F.lit(1), F.when(rate <= 0, F.lit(1)).otherwise(F.ceil(rate + 12 * F.sqrt(rate) + 12).cast("int"))), start, step, lambda a: a["k"])


def poisson_copies(key: Column, rate: Column, seed: int = SEED) -> Column:
    """Copies of a document: one draw at uniform(key), or the sum of several where the rate is above DRAW_RATE."""
    draws = F.ceil(rate / DRAW_RATE).cast("int")
    one = let(uniform(key, seed=seed), lambda u: poisson_inverse(u, rate).cast("long"))
    part = lambda i: let(uniform(key, i, seed=seed), lambda u: poisson_inverse(u, rate / draws).cast("long"))
    return F.when(rate <= DRAW_RATE, one).otherwise(F.aggregate(F.sequence(F.lit(1), draws), F.lit(0).cast("long"), lambda a, i: a + part(i)))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, size: Column | None = None, budget: float = 1.0, source_col: str = "source") -> DataFrame:
    """source_key, rate: one row per source. weights: target shares by source, else size ** TEMPERATURE. budget: size of the mix over that of docs.

    Sources without a weight have rate 0 where weights are given. size: what is weighed, one per document by default.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_key")).agg(F.sum(F.lit(1.0) if size is None else size).alias("size")).where("size > 0")
    if weights is None:
        shares = sizes.withColumn("weight", F.pow("size", F.lit(TEMPERATURE)))
    else:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        shares = sizes.withColumn("weight", F.coalesce(F.element_at(table, F.col("source_key")), F.lit(0.0)))
    total = shares.agg(F.sum("size").alias("sizes"), F.sum("weight").alias("weights"))
    rate = budget * F.col("weight") / F.col("weights") * F.col("sizes") / F.col("size")
    return shares.crossJoin(F.broadcast(total)).select("source_key", rate.alias("rate"))  # one row on the right


def _counted(docs: DataFrame, table: DataFrame, seed: int, id_col: str, source_col: str) -> DataFrame:
    table = saved(table, "rates")
    side = F.broadcast(table) if table.count() <= MAX_SOURCES else table
    joined = docs.join(side.select(F.col("source_key").alias("_llm_source"), F.col("rate").alias("_llm_rate")), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")) == F.col("_llm_source"), "left")
    copies = poisson_copies(F.col(f"`{id_col}`"), F.coalesce(F.col("_llm_rate"), F.lit(0.0)), seed)
    return joined.withColumn("_llm_copies", copies)


def mix_counts(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, rate, copies. Null sources form one source; see mix() for the rest."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    found = _counted(rows, rates(rows, weights, budget=budget), seed, "doc_id", "source")
    return found.select("doc_id", "source", F.coalesce("_llm_rate", F.lit(0.0)).alias("rate"), F.col("_llm_copies").cast("long").alias("copies"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", copy_col: str | None = None) -> DataFrame:
    """The mix: the columns of docs, each document as often as its count says, in a global random order.

    copy_col: name of a further column, the number of the copy from 1.
    Null sources form one source. A null id hashes as the empty string; repeated rows of one id get equal counts. An
    empty table gives an empty mix. Columns of any other name are carried along.
    """
    found = _counted(docs, rates(docs, weights, budget=budget, source_col=source_col), seed, id_col, source_col)
    one = F.lit(1).cast("long")
    # in two steps, so that no array grows with the rate
    parts = found.where("_llm_copies > 0").withColumn("_llm_first", F.explode(F.sequence(one, F.col("_llm_copies"), F.lit(COPIES).cast("long"))))
    copies = parts.withColumn("_llm_copy", F.explode(F.sequence(F.col("_llm_first"), F.least("_llm_copies", F.col("_llm_first") + (COPIES - 1)))))
    place = copies.withColumn("_llm_place", F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string"), "_llm_copy"))
    ordered = place.repartitionByRange(partitions(docs.sparkSession), "_llm_place").sortWithinPartitions("_llm_place")
    return ordered.select(*[F.col(f"`{c}`") for c in docs.columns], *([F.col("_llm_copy").alias(copy_col)] if copy_col else []))


def oracle_sql() -> str:
    """The rows of mix() with its defaults in DuckDB's SQL: doc_id, source, copy, text; rates up to 100."""
    return f"""
        WITH RECURSIVE s AS (SELECT coalesce(source, '') AS k, count(*)::DOUBLE AS size FROM documents GROUP BY 1),
        r AS (SELECT k, pow(size, {TEMPERATURE}) / (SELECT sum(pow(size, {TEMPERATURE})) FROM s) * (SELECT sum(size) FROM s) / size AS rate FROM s),
        d AS (
            SELECT doc_id, source, text, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, {_DIGITS}))::BIGINT / {16**_DIGITS}::DOUBLE AS u
            FROM documents JOIN r ON k = coalesce(source, '')),
        p AS (
            SELECT k, rate, 0::BIGINT AS n, exp(-rate) AS term, exp(-rate) AS total FROM r
            UNION ALL SELECT k, rate, n + 1, term * rate / (n + 1), total + term * rate / (n + 1) FROM p WHERE n < 200),
        c AS (SELECT k, n, total, coalesce(lag(total) OVER (PARTITION BY k ORDER BY n), 0) AS below FROM p),
        n AS (SELECT doc_id, source, text, (SELECT count(*) FROM c WHERE c.k = coalesce(d.source, '') AND total <= u)::BIGINT AS copies FROM d)
        SELECT doc_id, source, unnest(range(1, copies + 1)) AS copy, text FROM n
    """
