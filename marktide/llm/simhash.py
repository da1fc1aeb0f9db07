"""SimHash near-duplicates with BK-trees.

simhash_groups() links fingerprints within 2 bits of each other, all of them. similar_groups() links texts by the Jaccard
similarity of their shingles, at which fingerprints differ in many more bits (10 of 64 on average at 0.8).

Fingerprints are made once per document. Links are searched between different fingerprints only, so copies cost
nothing. Two 64-bit values that differ in at most 2 bits agree in at least two of four 16-bit blocks, so each fingerprint
goes to six shards (a pair of blocks and their value); every shard becomes one BK-tree whose children are keyed by their
Hamming distance to the parent, and each member follows only the edges within the radius.

The shard trees travel to their queries by a shuffle, not by a broadcast: together they grow with the corpus. A shard
with more than SHARD members is dealt again by thirds of its remaining bits (two differing bits leave one third equal),
which is exact and ends at 15 free bits.

At the wide radius of similar_groups() fingerprint blocks no longer part a corpus, so there the shards are pairs of minimal
shingle hashes: texts with a similarity of s meet in one of BANDS shards with probability 1 - (1 - s ** ROWS) ** BANDS. The
trees and the radius prune each shard, and what is left is checked exactly on the sets of shingle hashes, unless the two
are already connected. Only texts that share a shard with another send their hashes.

A passage that many texts share makes a large shard of texts that are not similar, and so does a group of many copies. A
shard above MEMBERS texts or WORK hashes is therefore not searched in pairs. First stars: its texts, dealt at random, are
compared with a few of them only, which joins groups of copies. Then prefixes: two texts that are similar share one of the
rarest of their shingles (a fifth of each set, and any order of shingles that is the same for all texts will do), so texts
meet by these, and only where some that are not yet connected meet they are searched. Boilerplate is frequent, so it makes
no text meet another, and a group of copies is connected already; no pair is lost by either. What is left are texts of
which many are almost similar: these alone are searched in pairs of blocks, which costs the square of their number.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import components
from .tokens import in_small_batches

RADIUS = 2
SHARD = 4000
#: Query and node pairs that the search holds at once, about.
PAIRS = 1 << 21
#: Shards of similar_groups(), and the members and shingle hashes that one of them holds at most before it is dealt otherwise.
BANDS, ROWS = 6, 2
MEMBERS, WORK = 1000, 4_000_000
#: Texts that the others of a piece are compared with; shingles in so many texts count as frequent; of these, so many are sent to all tasks.
STARS, OFTEN, SENT = 8, 16, 500_000
#: Texts that meet by a rare shingle and are searched at once; of more, each would be searched again for every shingle that they share.
LIGHT = 32


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of the word shingles, repeats included; 0 if there is no word."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) <= words else map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(g, seed) for g in grams], dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; as a signed number."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), words, seed) for t in b.column(1)], pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (signed 64 bits) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints(words, seed), "doc_id long, fp long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class BKForest:
    """One BK-tree per shard, all in flat arrays. shard must be sorted; the first member of a shard is its root."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        n = len(fp)
        first = np.r_[True, shard[1:] != shard[:-1]] if n else np.zeros(0, bool)
        self.fp = fp.view(np.uint64)
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        self.size = np.bincount(self.root, minlength=n)[self.root]
        at, todo, edges, nodes = self.root.copy(), np.flatnonzero(~first), [], []
        while len(todo):
            code = at[todo] * 65 + _distance(self.fp[todo], self.fp[at[todo]])
            keys, lead, back = np.unique(code, return_index=True, return_inverse=True)
            edges.append(keys)
            nodes.append(todo[lead])
            at[todo] = todo[lead][back]
            todo = np.delete(todo, lead)
        self.edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.node = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        order = np.argsort(self.edge)
        self.edge, self.node = self.edge[order], self.node[order]

    def within(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, member) at a distance of at most radius, member before query."""
        q, at, found = query, self.root[query], []
        while len(q):
            d = _distance(self.fp[q], self.fp[at])
            hit = (d <= radius) & (at < q)
            found.append((q[hit], at[hit]))
            nq, nat = [], []
            for step in range(-radius, radius + 1):
                code = at * 65 + d + step
                ok = (d + step >= 0) & (d + step <= 64)
                k = np.searchsorted(self.edge, code)
                k[k == len(self.edge)] = 0
                ok &= self.edge[k] == code if len(self.edge) else False
                nq.append(q[ok])
                nat.append(self.node[k[ok]] if len(self.edge) else k[ok])
            q, at = np.concatenate(nq), np.concatenate(nat)
        return np.concatenate([a for a, _ in found] or [query[:0]]), np.concatenate([b for _, b in found] or [query[:0]])


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a and b; labels are smallest members."""
    while len(a):
        la, lb = label[a], label[b]
        if not (open_ := la != lb).any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label[:] = label[label]


def shard_links(shard: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shards to links (fp, smallest-placed fp of its component in that shard)."""
    forest = BKForest(shard, fp)
    label, query = np.arange(len(fp)), np.flatnonzero(forest.size > 1)
    cost = np.cumsum(forest.size[query])
    for part in np.split(query, np.searchsorted(cost, np.arange(PAIRS, int(cost[-1]) if len(cost) else 0, PAIRS))):
        _merge(label, *forest.within(part, radius))
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def out(shard, fp):
            u, v = shard_links(shard, fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in batches:
            held = [np.concatenate([h, b.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
            if len(held[0]):
                cut = np.searchsorted(held[0], held[0][-1])  # the last shard may go on in the next batch
                yield out(held[0][:cut], held[1][:cut])
                held = [h[cut:] for h in held]
        yield out(*held)

    return run


def _bits(x: Column, start: int, n: int) -> Column:
    return F.shiftrightunsigned(x, start).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _deal(rows: DataFrame, free: int) -> DataFrame:
    """Rows (shard, rest, fp) with free bits in rest to three rows each, one for each third that may be equal."""
    a, b = -(-free // 3), -(-(free - -(-free // 3)) // 2)
    spans = [(0, a), (a, b), (a + b, free - a - b)]
    out = []
    for k, (s, n) in enumerate(spans):
        (s1, n1), (s2, n2) = (x for j, x in enumerate(spans) if j != k)
        out.append(F.struct(F.xxhash64("shard", F.lit(k), _bits(F.col("rest"), s, n)).alias("shard"), F.shiftleft(_bits(F.col("rest"), s1, n1), n2).bitwiseOR(_bits(F.col("rest"), s2, n2)).alias("rest")))
    return rows.select("fp", F.inline(F.array(*out))).select("shard", "rest", "fp")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Different fingerprints (fp) to links (u, v) that connect all pairs at a distance of at most radius (2)."""
    if radius != RADIUS:
        raise ValueError("the shards are made for a radius of 2")
    block = [_bits(F.col("fp"), 16 * k, 16) for k in range(4)]
    shards = []
    for k, (i, j) in enumerate(combinations(range(4), 2)):
        x, y = (m for m in range(4) if m not in (i, j))
        shards.append(F.struct(F.shiftleft(block[i], 16).bitwiseOR(block[j]).bitwiseOR(F.lit(k << 32).cast("long")).alias("shard"), F.shiftleft(block[x], 16).bitwiseOR(block[y]).alias("rest")))
    rows, free, out = fps.select("fp", F.inline(F.array(*shards))).select("shard", "rest", "fp"), 32, None
    while True:
        last = free <= 16
        sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("shard", "s")
        rows = saved(rows.join(sizes, F.col("shard") == F.col("s")).select("shard", "rest", "fp", "n"), "shards")
        here = rows if last else rows.where(F.col("n") <= SHARD)
        found = here.select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(_search(radius), "u long, v long")
        out = found if out is None else out.union(found)
        if last or rows.where(F.col("n") > SHARD).isEmpty():
            return out
        rows = _deal(rows.where(F.col("n") > SHARD).select("shard", "rest", "fp"), free)
        free -= free // 3


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Null and empty texts have fingerprint zero and are linked like any other; a text of fewer words than a shingle is one
    shingle. Repeated rows are all returned. A null id never is a component's smallest unless all are null. An empty
    table gives an empty result; other input columns are ignored.
    """
    prints = saved(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    fps = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fps")
    root = components(links(fps.select("fp"))).select(F.col("u").alias("node"), F.col("v").alias("root"))
    member = fps.join(root, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    member = saved(member, "members")
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id")).withColumnRenamed("root", "r")
    label = member.join(lowest, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return prints.join(label, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def radius_for(similarity: float) -> int:
    """Bits in which fingerprints of two sets of that Jaccard similarity differ at most, in 998 of 1000 cases."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(64 * share + 3 * math.sqrt(64 * share * (1 - share)))


def _mixers() -> list[tuple[np.uint64, np.uint64]]:
    draw = random.Random(42)
    return [(np.uint64(draw.getrandbits(64)), np.uint64(draw.getrandbits(64) | 1)) for _ in range(BANDS * ROWS)]


def shingle_set(text: str | None, words: int, seed: int) -> np.ndarray:
    """The ascending different XXH64 hashes of a text's word shingles; none for a text without words."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(w)] if len(w) <= words else set(map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g, seed) for g in grams], np.uint64))


_SKETCH = "doc_id long, row string, digest binary, fp long, n long, shards array<long>, hashes binary"


def _sketches(words: int, seed: int):
    mixers = _mixers()

    def sketch(text: str | None) -> tuple:
        h = shingle_set(text, words, seed)
        low = [((h ^ r) * m).min() for r, m in mixers] if len(h) else []
        keys = [xxhash.xxh64_intdigest(np.array([b, *low[b * ROWS : (b + 1) * ROWS]], "<u8").tobytes()) for b in range(BANDS)] if low else []
        return xxhash.xxh3_128_digest(h.tobytes()), majority(h), len(h), [k - (1 << 64) if k >> 63 else k for k in keys], np.unique(h >> np.uint64(32)).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        for b in batches:
            for start, texts in in_small_batches(b.column(2).to_pylist(), 1 << 22):
                cols = list(zip(*map(sketch, texts), strict=True))
                part = b.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "row", "digest", "fp", "n", "shards", "hashes"])

    return run


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return both >= similarity * (len(a) + len(b) - both)


def similar_links(fp: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int, label: list | None = None) -> list[tuple[int, int]]:
    """One shard's members to pairs that connect all whose fingerprints are within the radius and whose sets are similar.

    label: members with equal labels are connected already.
    """
    forest, size = BKForest(np.zeros(len(fp), np.int64), fp), np.array([len(x) for x in sets])
    first: dict = {}
    root = [first.setdefault(x, k) for k, x in enumerate(label)] if label else list(range(len(fp)))
    out, query, known = [], np.arange(len(fp)), np.array(root)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    step = max(1, PAIRS // max(1, len(fp)))
    for k in range(0, len(fp), step):
        q, at = forest.within(query[k : k + step], radius)
        near = (known[q] != known[at]) & (np.minimum(size[q], size[at]) >= similarity * np.maximum(size[q], size[at]))
        for a, b in zip(q[near].tolist(), at[near].tolist(), strict=True):
            if (ra := find(a)) != (rb := find(b)) and _alike(sets[a], sets[b], similarity):
                root[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
    return out


_LINK = pa.schema([("shard", pa.int64()), ("u", pa.binary()), ("v", pa.binary())])


def _grouped(each):
    """Rows (shard, digest, fp, hashes, label), sorted by shard and digest: each(members of one shard) gives links (shard, u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"shard": held[0][0], "u": u, "v": v} for u, v in each(held)] if held else [], schema=_LINK)

        for b in batches:
            for x in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if held and held[0][0] != x[0]:
                    yield out()
                    held.clear()
                if not held or held[-1][1] != x[1]:  # a row that stands twice has its set twice
                    held.append(x)
        yield out()

    return run


def _similar(similarity: float, radius: int):
    """Links of all members of a shard."""

    def each(held: list[tuple]) -> list[tuple]:
        if len(held) < 2 or held[0][4] is not None and len({x[4] for x in held}) < 2:
            return []
        pairs = similar_links(np.array([x[2] for x in held], np.int64), [np.frombuffer(x[3], "<u4") for x in held], similarity, radius, None if held[0][4] is None else [x[4] for x in held])
        return [(held[a][1], held[b][1]) for a, b in pairs]

    return _grouped(each)


def _stars(similarity: float):
    """Links of the members of a piece to the first of its stars that is similar; a star comes out with nothing. Not all links."""

    def each(held: list[tuple]) -> list[tuple]:
        stars: list[tuple] = []
        out = []
        for _, digest, _, hashes, _ in held:
            h = np.frombuffer(hashes, "<u4")
            hub = next((d for d, x in stars if min(len(x), len(h)) >= similarity * max(len(x), len(h)) and _alike(x, h, similarity)), None)
            if hub is None and len(stars) < STARS:
                stars.append((digest, h))
                out.append((digest, None))
            elif hub is not None:
                out.append((digest, hub))
        return out

    return _grouped(each)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle hashes and the texts of a batch that have them."""
    for b in batches:
        h, n = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in b.column(0).to_pylist()] or [np.zeros(0, "<u4")]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])


def prefix(h: np.ndarray, often: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """So many of a set's rarest hashes that a similar set has one of them among its own. often, ascending, with their counts."""
    if not len(h):
        return h
    at = np.minimum(np.searchsorted(often, h), max(0, len(often) - 1))
    count = np.where(often[at] == h, counts[at], 0) if len(often) else np.zeros(len(h), np.int64)
    return h[np.lexsort((h, count))][: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]


def _prefixes(often: np.ndarray, counts: np.ndarray, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [prefix(np.frombuffer(x, "<u4"), often, counts, similarity) for x in b.column(1).to_pylist()]
            of = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(np.concatenate(found or [np.zeros(0, "<u4")]).astype(np.int64))], names=["digest", "hash"])

    return run


def _searched(dealt: DataFrame, sets: DataFrame, search) -> DataFrame:
    """dealt (shard, digest, label) with the sets of their texts through a search: links (shard, u, v)."""
    placed = dealt.select("shard", "digest", "label").join(sets, F.col("digest") == F.col("d")).select("shard", "digest", "fp", "hashes", "label")
    return placed.repartition("shard").sortWithinPartitions("shard", "digest").mapInArrow(search, "shard long, u binary, v binary")


def _parts(members: Column, work: Column) -> Column:
    """Into how many parts a shard is dealt."""
    return F.ceil(F.greatest(members / MEMBERS, work / WORK)).cast("long")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (shard, digest, label, parts), dealt into so many blocks and these into pairs, which together hold all pairs of a shard."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("digest"), F.col("parts")))
    one = dealt.where("parts <= 1").select("shard", "digest", "label")
    others = dealt.where("parts > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("other <> own")
    return one.union(others.select(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")), "digest", "label"))


def _large_links(large: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """large (shard, digest, n): links (u, v) that connect all similar texts that share one of these shards. known: d, fp, hashes."""
    large = saved(large, "similar-large")
    sets = saved(known.join(large.select(F.col("digest").alias("_d")).distinct(), F.col("d") == F.col("_d"), "left_semi"), "similar-sets")
    rows, none, stars, before = large, F.lit(None).cast("binary"), None, math.inf
    while True:
        sizes = rows.groupBy("shard").agg(_parts(F.count("*"), F.sum("n")).alias("pieces")).withColumnRenamed("shard", "s")
        dealt = saved(rows.join(sizes, F.col("shard") == F.col("s")).select("shard", "digest", "n", "pieces"), "similar-pieces")
        piece = F.xxhash64("shard", F.pmod(F.xxhash64("digest"), F.col("pieces")))
        found = saved(_searched(dealt.select(piece.alias("shard"), "digest", none.alias("label")), sets, _stars(similarity)), "similar-stars")
        linked = found.where("v IS NOT NULL").select("u", "v")
        stars = linked if stars is None else stars.union(linked)
        again = dealt.where("pieces > 1").join(found.where("v IS NULL").select(F.col("shard").alias("s"), F.col("u").alias("d")), (piece == F.col("s")) & (F.col("digest") == F.col("d")), "left_semi")
        rows = saved(again.select("shard", "digest", "n"), "similar-again")
        if not (now := rows.count()) or now > before / 2:  # few are stars of others; the prefixes find the rest
            break
        before = now
    root = components(stars).select(F.col("u").alias("d"), F.col("v").alias("root"))
    label = saved(large.select("digest", "n").distinct().join(root, F.col("digest") == F.col("d"), "left").select(F.col("digest").alias("l"), "n", F.coalesce("root", "digest").alias("label")), "similar-labels")
    counted = saved(sets.select("hashes").mapInArrow(_counted, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN), "similar-often")
    least = OFTEN
    while counted.where(F.col("n") >= least).count() > SENT:  # any order of shingles gives right results; the most frequent matter most
        least *= 4
    often = counted.where(F.col("n") >= least).orderBy("hash").toPandas()
    told = large.sparkSession.sparkContext.broadcast((often["hash"].to_numpy(np.int64), often["n"].to_numpy(np.int64)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _prefixes(*told.value, similarity)(batches)

    met = sets.select("d", "hashes").mapInArrow(prefixes, "digest binary, hash long").join(label, F.col("digest") == F.col("l")).select("digest", "hash", "label", "n")
    met = saved(met, "similar-prefixes")
    open_ = met.groupBy(F.col("hash").alias("h")).agg(F.min("label").alias("a"), F.max("label").alias("b"), ((F.count("*") <= LIGHT) & (F.sum("n") <= WORK)).alias("light")).where("a <> b")
    rows = saved(met.join(open_, F.col("hash") == F.col("h")).select(F.col("hash").alias("shard"), "digest", "label", "light"), "similar-met")
    search = _similar(similarity, radius_for(similarity))
    # texts that share many of their rarest shingles meet in many equal groups: each is searched once
    group = F.array_sort(F.collect_set(F.struct("digest", "label"))).alias("group")  # LIGHT at most
    groups = rows.where("light").groupBy("shard").agg(group).select("group").distinct()
    last = _searched(groups.select(F.xxhash64("group").alias("shard"), F.inline("group")), sets, search)
    # texts whose rarest shingles are common to many that are not connected: almost similar ones, searched in pairs of blocks
    common = saved(rows.where("NOT light").select(F.col("digest").alias("c"), "label").distinct(), "similar-common")
    if not common.isEmpty():
        rest = large.join(common, F.col("digest") == F.col("c")).select("shard", "digest", "n", "label")
        parts = rest.groupBy(F.col("shard").alias("s")).agg(_parts(F.count("*"), F.sum("n")).alias("parts"))
        dealt = saved(_in_blocks(rest.join(parts, F.col("shard") == F.col("s")).select("shard", "digest", "label", "parts")), "similar-blocks")
        last = last.union(_searched(dealt, sets, search))
    last = last.select("u", "v")
    return stars.union(last)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, words: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """One row per input row: doc_id, row, group_id (equal for texts that are linked, directly or over others).

    Texts are linked at a Jaccard similarity of their sets of word shingles of at least similarity. row is row_col as text,
    or a number that is made up. Null and empty texts have no shingle and equal each other; a text of fewer words than a
    shingle is one shingle. Repeated rows are all returned; an empty table gives an empty result; other columns are ignored.
    """
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.cast("string").alias("row"), F.col(text_col).cast("string").alias("text"))
    known = saved(rows.mapInArrow(_sketches(words, seed), _SKETCH), "sketches")
    # one row for each different set in each of its shards
    member = saved(known.select("digest", "n", F.explode("shards").alias("shard")).distinct(), "similar-members")
    full = member.groupBy("shard").agg(F.count("*").alias("members"), F.sum("n").alias("work")).where("members > 1").withColumnRenamed("shard", "s")
    member = saved(member.join(full, F.col("shard") == F.col("s")).select("shard", "digest", "n", F.greatest(F.col("members") / MEMBERS, F.col("work") / WORK).alias("fill")), "similar-shards")
    dealt = member.where("fill <= 1").select("shard", "digest", F.lit(None).cast("binary").alias("label"))
    first = known.groupBy("digest").agg(F.min("row").alias("row"))
    wanted = saved(first.join(member.select(F.col("digest").alias("d")).distinct(), F.col("digest") == F.col("d"), "left_semi").select("row"), "similar-rows")
    one = saved(known.join(wanted, "row", "left_semi").select(F.col("digest").alias("d"), "fp", "hashes"), "similar-one")
    found = _searched(dealt, one, _similar(similarity, radius_for(similarity))).select("u", "v")
    large = member.where("fill > 1").select("shard", "digest", "n")
    if not large.isEmpty():
        found = found.union(_large_links(large, one, similarity))
    root = components(found).select("u", F.col("v").alias("root"))
    return known.select("doc_id", "row", "digest").join(root, F.col("digest") == F.col("u"), "left").select("doc_id", "row", F.coalesce("root", "digest").alias("group_id"))
