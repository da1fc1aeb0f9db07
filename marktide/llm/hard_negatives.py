"""Hard negatives from embeddings with vantage-point trees.

Scores are integer inner products. With one more component, sqrt(M * M - |x| * |x|) for rows (M: the longest row of a
tree) and 0 for the anchor q, the squared distance is |q|^2 + M^2 - 2 score: the largest score is the nearest row, and a
window of scores is an annulus around the anchor.

Rows are dealt into shards of bounded size, each of which becomes one tree. An anchor goes to the shards (a stated set of
queries against all rows, in blocks), walks each tree nearest first and stops as soon as no window of it can gain; the best
of all shards are then ranked together. First the positives are looked for in the shards of the anchor's own label, then,
within the windows that these set, the negatives in all shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved

#: Rows of a shard, about; rows of a leaf; anchors whose distances to all vantage points of a shard are held at once.
SHARD, LEAF, BLOCK = 50_000, 128, 512
#: Shards are made smaller than SHARD, but not below this, until there is one for each partition.
SMALL = 2_000
#: Labels with shards of their own that are sent to all tasks; beyond, they are joined by a shuffle.
SENT = 100_000


class VantageTree:
    """Vectors in a tree: each inner node parts its rows at the median distance to one of them, the vantage point.

    Every node knows the least and the largest distance of its rows to the vantage point of its parent. Rows at equal
    distances may fall on both sides, so copies do no harm to its depth.
    """

    def __init__(self, rows: np.ndarray, leaf: int = LEAF, largest: int = 0):
        """largest: no component of a query is larger. Scores are exact: in doubles where these can hold them, else in integers of any size."""
        self.points, self.leaves = [], {}
        largest = max(largest, int(rows.max(initial=0)), -int(rows.min(initial=0)))
        self.scored = rows.astype(np.float64) if largest**2 * rows.shape[1] < 2**53 else rows.astype(object)
        flat = rows.astype(np.float64)
        norms = np.einsum("ij,ij->i", flat, flat)
        self.longest = float(norms.max(initial=0))
        self.flat = np.hstack([flat, np.sqrt(np.maximum(self.longest - norms, 0))[:, None]])
        self.parts: dict[int, tuple] = {}  # node to (number of its vantage point, inner child, outer child)
        self.bounds: list[tuple[float, float]] = []  # least and largest distance to the parent's vantage point
        todo = [(np.arange(len(rows)), 0.0, np.inf)]
        waiting = {0: None}
        while todo:
            own, low, high = todo.pop(0)
            node = len(self.bounds)
            self.bounds.append((low, high))
            if (parent := waiting.pop(node)) is not None:
                self.parts[parent] = (*self.parts[parent], node)
            if len(own) <= leaf:
                self.leaves[node] = own
                continue
            far = self.flat[own] - self.flat[own[0]]
            point = own[np.einsum("ij,ij->i", far, far).argmax()]  # a row at the rim parts better than one in the middle
            away = self.flat[own] - self.flat[point]
            away = np.sqrt(np.einsum("ij,ij->i", away, away))
            order = np.argsort(away, kind="stable")
            half = len(own) // 2
            self.parts[node] = (len(self.points),)
            self.points.append(point)
            for side in (order[:half], order[half:]):
                waiting[node + 1 + len(todo)] = node
                todo.append((np.sort(own[side]), away[side[0]], away[side[-1]]))

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """From each query to each vantage point."""
        at, q = self.flat[self.points], queries.astype(np.float64)
        squares = np.einsum("ij,ij->i", q, q)[:, None] + self.longest - 2 * (q @ at[:, :-1].T)
        return np.sqrt(np.maximum(squares, 0))

    def nearest_first(self, query: np.ndarray, away: list[float], wanted) -> None:
        """Visits leaves in order of the highest score that they can hold.

        wanted(low, high) tells whether rows with scores from low to high may still count; wanted.visit(numbers, scores)
        takes those of a leaf. away: the query's distances to the vantage points.
        """
        norm = float(np.dot(query.astype(np.float64), query.astype(np.float64))) + self.longest
        slack = 1e-9 * norm + 1e-6
        scored = query.astype(self.scored.dtype)
        queue = [(-np.inf, 0, 0.0, np.inf)]  # by the highest score; the least and the largest distance
        while queue:
            best, node, low, high = heapq.heappop(queue)
            if not wanted((norm - high * high) / 2 - slack, -best):
                continue
            if node in self.leaves:
                own = self.leaves[node]
                wanted.visit(own, self.scored[own] @ scored)
                continue
            point, *children = self.parts[node]
            for child in children:
                near, far = self.bounds[child]
                least, most = max(low, away[point] - far, near - away[point]), min(high, away[point] + far)
                heapq.heappush(queue, ((least * least - norm) / 2 - slack, child, least, most))


class Windows:
    """The best rows of each window of scores of one anchor, by score, then id."""

    def __init__(self, low: list, high: list, most: int, ids: np.ndarray, fits: np.ndarray):
        self.windows = [(a, b, []) for a, b in zip(low, high, strict=True)]
        self.most, self.ids, self.fits = most, ids, fits

    def __call__(self, low: float, high: float) -> bool:
        return any(low <= b and high >= (best[-1][0] if len(best) == self.most else a) for a, b, best in self.windows)

    def visit(self, numbers: np.ndarray, scores: np.ndarray) -> None:
        keep = self.fits[numbers]
        numbers, scores = numbers[keep], scores[keep]
        if not len(scores):
            return
        top = scores.max()
        for a, b, best in self.windows:
            least = best[-1][0] if len(best) == self.most else a
            if top < least:
                continue
            at = np.flatnonzero((scores >= least) & (scores <= b))
            if len(at):
                ids = self.ids[numbers[at]]
                at = at[np.lexsort((ids, -scores[at]))[: self.most]] if len(at) > self.most else at
                best += [(int(scores[k]), int(self.ids[numbers[k]])) for k in at]
                best.sort(key=lambda x: (-x[0], x[1]))
                del best[self.most :]


_COLUMNS = "shard long, kind int, row long, id long, label string, vec array<long>, low array<long>, high array<long>"
_FOUND = "row long, place int, id long, score long"


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *pa.compute.list_value_length(column).to_pylist()])
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _walk(rows: list[tuple], queries: list[tuple], most: int, same: bool, leaf: int) -> Iterator[tuple]:
    """(row of the anchor, window, id, score) of the best rows of one shard in each window of each anchor."""
    if not rows or not queries:
        return
    width = max(len(x[4]) for x in (*rows, *queries))
    ids, known = np.array([x[2] for x in rows], np.int64), {}
    labels = np.array([known.setdefault(x[3], len(known)) for x in rows], np.int64)
    largest = max(max(int(x[4].max(initial=0)), -int(x[4].min(initial=0))) for x in queries)
    tree = VantageTree(_matrix([x[4] for x in rows], width), leaf, largest)
    for begin in range(0, len(queries), BLOCK):
        block = queries[begin : begin + BLOCK]
        vectors = _matrix([x[4] for x in block], width)
        away = tree.distances(vectors).tolist() if tree.points else [[]] * len(block)
        for (_, row, number, label, _, low, high), q, d in zip(block, vectors, away, strict=True):
            fits = ((labels == known.get(label, -1)) == same) & (ids != number)
            wanted = Windows(low, high, most, ids, fits)
            tree.nearest_first(q, d, wanted)
            for place, (_, _, best) in enumerate(wanted.windows):
                for score, found in best:
                    yield row, place, found, score


def _search(most: int, same: bool, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, ([], [])

        def out() -> pa.RecordBatch:
            found = list(zip(*_walk(*held, most, same, leaf), strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["row", "place", "id", "score"])

        for b in batches:
            cols = [b.column(k).to_pylist() for k in (0, 1, 2, 3, 4)]
            for s, kind, row, number, label, vec, low, high in zip(*cols, _vectors(b.column(5)), b.column(6).to_pylist(), b.column(7).to_pylist(), strict=True):
                if s != shard and shard is not None:
                    yield out()
                    held = ([], [])
                shard = s
                held[kind].append((s, row, number, label, vec, low, high))
        yield out()

    return run


def _best(dealt: DataFrame, queries: DataFrame, most: int, same: bool, leaf: int) -> DataFrame:
    """row (of the anchor), place (of the window), rank (from 1), id, score: dealt rows against queries dealt to the same shards."""
    none = F.array().cast("array<bigint>")
    both = dealt.select("shard", F.lit(0).alias("kind"), "row", "id", "label", "vec", none.alias("low"), none.alias("high"))
    both = both.unionByName(queries.select("shard", F.lit(1).alias("kind"), "row", "id", "label", "vec", "low", "high"))
    found = both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_search(most, same, leaf), _FOUND)
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame, anchor: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 5, least: int = 80, largest: int = 100, scale: float = 256.0, shard: int = SHARD, leaf: int = LEAF,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    The score of two rows is the inner product of their vectors, each component multiplied by scale and rounded down. An
    anchor (rows that fulfil the condition anchor; null: all) has as positives its best rows of the same label with other
    ids. For each, its negatives are the best rows of other labels with a score from least to largest hundredths of the
    positive's. Higher scores come first, equal ones by the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. A shorter vector is as if
    filled up with zeros, an empty one is all zeros. Repeated rows count each by itself, as anchors too. An anchor without a
    positive or without a negative in the window gives no row. Other columns are ignored. Scores must fit in a long.
    """
    spark = rows.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = rows.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.transform(vec, lambda x: F.floor(x * scale).cast("long")).alias("vec"), (F.lit(True) if anchor is None else anchor).alias("anchor"))
    known = saved(known.withColumn("row", F.monotonically_increasing_id()), "vectors")
    anchors, total = known.where("anchor").select("row", "id", "label", "vec"), known.count()
    size = max(1, min(shard, max(SMALL, total // partitions(spark))))

    # positives: shards of one label
    many = saved(known.groupBy("label").agg(F.ceil(F.count("*") / size).cast("long").alias("shards")).where("shards > 1").withColumnRenamed("label", "many"), "labels")
    many = F.broadcast(many) if many.count() <= SENT else many
    split = lambda x: x.join(many, F.col("label") == F.col("many"), "left").withColumn("shards", F.coalesce("shards", F.lit(1).cast("long")))
    own = split(known).withColumn("shard", F.xxhash64("label", F.pmod(F.xxhash64("row"), F.col("shards"))))
    asked = split(anchors).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).withColumn("shard", F.xxhash64("label", "part"))
    edge = F.lit((1 << 62)).cast("long")
    found = _best(own, asked.withColumn("low", F.array(-edge)).withColumn("high", F.array(edge)), positives, True, leaf)
    found = saved(found.select("row", F.struct("rank", "id", "score").alias("positive")), "positives")

    # negatives: all shards, in the windows of the positives
    window = F.sort_array(F.collect_list("positive"))  # at most `positives` of them
    windows = found.groupBy(F.col("row").alias("r")).agg(window.alias("found"))
    ready = anchors.join(windows, F.col("row") == F.col("r"))
    low, high = F.transform("found", lambda x: F.ceil(x["score"].cast("decimal(38,0)") * least / 100).cast("long")), F.transform("found", lambda x: F.floor(x["score"].cast("decimal(38,0)") * largest / 100).cast("long"))
    ready = saved(ready.select("row", "id", "label", "vec", "found", low.alias("low"), high.alias("high")), "anchors")
    shards = max(1, -(-total // size))
    asked = ready.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    best = _best(known.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards).cast("long"))), asked, negatives, False, leaf)
    best = best.select(F.col("row").alias("r"), "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    positive = F.get(F.col("found"), F.col("place"))
    out = best.join(ready.select("row", F.col("id").alias("anchor_id"), "found"), F.col("r") == F.col("row"))
    return out.select("anchor_id", positive["id"].alias("positive_id"), "rank", "negative_id", positive["score"].alias("positive_score"), "negative_score")


def mined(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every hundredth id; the labels of every seventh are moved on by one first."""
    n = F.col("vec_id").cast("long")
    label = F.when(F.pmod(n, F.lit(7)) == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(10))).otherwise(F.col("label").cast("long"))
    return hard_negatives(embeddings.select(n.alias("vec_id"), "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


def oracle_sql() -> str:
    return """
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id AS id, r.label AS label, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
            FROM r AS a JOIN r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
        ), p AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score
            FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        ), n AS (
            SELECT p.*, s.id AS negative_id, s.score AS negative_score,
                   CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own
             AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """
