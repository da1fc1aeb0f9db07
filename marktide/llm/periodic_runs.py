"""Periodic runs of words: maximal stretches whose words repeat with a period, found through Lyndon roots.

Every run holds its Lyndon root, and that root is the longest Lyndon word starting at its place under the order of words
or under the reversed order. The longest Lyndon word at i ends where the next smaller suffix begins, so one stack scanned
from right to left gives all of them. Suffixes are compared by their longest common extension; a candidate (i, q) becomes
the whole stretch on which words q apart are equal, extended to both sides. Both come from prefix hashes by binary search
and are then verified word by word; a stretch once found answers all later questions on its diagonal. No suffix array.

A word in a run of four periods is repeated within that run, and so is each of its three-word windows (three times at
least, whatever the period), so stretches of other windows part a text into pieces that are searched alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import in_small_batches

#: Words and periods that a run has at least. The gate below holds for four periods and six words or more.
LENGTH, EXPONENT = 6, 4
_MODULUS, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687
_NONE = (0, 0)


class Diagonals:
    """Where words q apart are equal: stretches [low, high) with words[x] == words[x + q], extended as far as they go."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        self.raw = np.array(words, "<i8").tobytes()
        self.sums, self.powers = [0], [1]
        for w in words:
            self.sums.append((self.sums[-1] * _BASE + w + 1) % _MODULUS)
            self.powers.append(self.powers[-1] * _BASE % _MODULUS)
        self.known: dict[int, tuple[int, int]] = {}

    def _alike(self, i: int, j: int, size: int) -> bool:
        """Whether the hashes of two stretches are equal."""
        s, p = self.sums, self.powers[size]
        return (s[i + size] - s[i] * p - s[j + size] + s[j] * p) % _MODULUS == 0

    def _same(self, i: int, j: int, size: int) -> bool:
        """Whether two stretches are equal, word by word."""
        return self.raw[8 * i : 8 * (i + size)] == self.raw[8 * j : 8 * (j + size)]

    def _reach(self, most: int, test) -> int:
        """The largest size up to most that passes the test; passing is downward closed."""
        low, step = 0, 1
        while low + step <= most and test(low + step):  # first in growing steps: most answers are small
            low += step
            step *= 2
        high = min(most, low + step - 1)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if test(mid) else (low, mid - 1)
        return low

    def ahead(self, i: int, j: int) -> int:
        """The longest common extension of the suffixes at i < j."""
        size = self._reach(self.n - j, lambda k: self._alike(i, j, k))
        return size if self._same(i, j, size) else self._reach(size, lambda k: self._same(i, j, k))

    def behind(self, i: int, j: int) -> int:
        """Equal words before i < j."""
        size = self._reach(i, lambda k: self._alike(i - k, j - k, k))
        return size if self._same(i - size, j - size, size) else self._reach(size, lambda k: self._same(i - k, j - k, k))

    def stretch(self, i: int, q: int) -> tuple[int, int]:
        """The stretch of the diagonal q that holds i; words[i] == words[i + q]."""
        low, high = self.known.get(q, _NONE)
        if not low <= i < high:
            low, high = self.known[q] = i - self.behind(i, i + q), i + self.ahead(i, i + q)
        return low, high


def word_runs(words: list[int], length: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence, by start, then period."""
    n, found = len(words), set()
    diagonals = Diagonals(words)
    known, stretch = diagonals.known, diagonals.stretch
    for backwards in (False, True):
        known.clear()
        after = [0] * n  # where the next smaller suffix begins; n is the empty one
        for i in range(n - 1, -1, -1):
            j, w = i + 1, words[i]
            while j < n:
                v = words[j]
                if w == v:
                    end = stretch(i, j - i)[1]
                    if end + j - i >= n:
                        break  # the suffix at j is a beginning of that at i, so it is smaller
                    larger = words[end] > words[end + j - i]
                else:
                    larger = w > v
                if larger != backwards:
                    break
                j = after[j]
            after[i] = j
            q = j - i
            if j < n and w == words[j] and exponent * q <= n:
                low, high = stretch(i, q)
                if high - low + q >= max(length, exponent * q):
                    found.add((low, high - low + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [a, b) outside which no run of six words and four periods has a word.

    A three-word window in such a run stands three times in it, so the counts of all windows by a hash, which can only be
    too large, bound the runs from outside.
    """
    if len(ids) < LENGTH:
        return []
    x = ids.astype(np.uint64) + np.uint64(1)
    code = x[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ x[2:] * np.uint64(0x165667B19E3779F9)
    code = (code ^ code >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - max(8, len(ids).bit_length() + 3))
    often = np.bincount(code.astype(np.int64))[code.astype(np.int64)] >= EXPONENT - 1
    edge = np.flatnonzero(np.diff(np.r_[0, often.astype(np.int8), 0]))
    return [(a, b + 2) for a, b in edge.reshape(-1, 2).tolist() if b + 2 - a >= LENGTH]


def text_runs(words: list[bytes], length: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All runs of a text's words, by start, then period."""
    if length < LENGTH or exponent < EXPONENT:
        raise ValueError(f"runs have {LENGTH} words and {EXPONENT} periods at least")
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault(w, len(seen)) for w in words]
    if len(ids) - len(seen) < LENGTH - 2:  # too few repeats for one run
        return []
    return [(a + s, n, q) for a, b in repeated(np.array(ids, np.int64)) for s, n, q in word_runs(ids[a:b], length, exponent)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that some run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, n, q in runs:
        gone[start + q] += 1
        gone[start + n] -= 1
    return b" ".join([w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g])


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _search(length: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in in_small_batches(b.column(1).to_pylist(), 1 << 23):
                cut = [(t or "").encode().split() for t in texts]
                runs = [text_runs(w, length, exponent) for w in cut]
                kept = pa.array([collapsed(w, r) for w, r in zip(cut, runs, strict=True)], pa.binary()).cast(pa.string())
                found = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], _RUNS)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), found, kept], names=["doc_id", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """One row per input row: doc_id, runs (array of start, length, period by start, then period), collapsed (string).

    Words are parted by ASCII white space and numbered from 0. A run is a stretch with a smallest period q, of at least
    max(length, exponent * q) words, that no neighbouring word extends. collapsed has the words that stay when each run
    keeps its first period, joined by one space. Null, empty and blank texts have no runs and collapse to an empty text;
    null ids stay null and repeated rows are all returned; an empty table gives an empty result; other columns are
    ignored. Nothing is shuffled; a text is searched in one task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_search(length, exponent), "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a periodic ending in the texts of every tenth id by its CRC32 (h): of n > 0 words, each word from
    h / 10 % n on is replaced by one of the first 1 + (n - a) / (3 + h / 10 % 8) words of that ending, again and again."""
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.col(text_col).cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def again(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        return F.concat_ws(" ", F.slice(w, F.lit(1), a.cast("int")), F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda k: F.element_at(w, (a + F.pmod(k, p) + 1).cast("int"))))

    chosen = (F.pmod(h, F.lit(10)) == 0) & (F.size(words) > 0)
    return docs.withColumn(text_col, F.when(chosen, F.get(F.transform(F.array(words), again), F.lit(0))).otherwise(F.col(text_col)))


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs of with_periods(docs): their number, the longest and digests of all runs and of the collapsed text."""
    found = periodic_runs(with_periods(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("low"))))
    line = lambda r: F.concat(*[x for c in ("start", "length", "period") for x in (r[c].cast("string"), F.lit("\n" if c == "period" else ","))])
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("longest.before"), F.col("longest.length"), -F.col("longest.low")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
