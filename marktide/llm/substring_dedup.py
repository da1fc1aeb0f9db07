"""Substring duplicates by content-defined chunking.

A gear hash rolls over the bytes of a text (its 16 bits hold the last 16 bytes). A chunk ends after white space where the
top bits of the hash are low, so cuts depend on the bytes just before them alone: an insertion moves the cuts around it
and no others. From each chunk on, as few chunks as hold MIN_WORDS words are a window, known by 96 bits summed
from its chunks' digests; one more ends with the text. A window that stands in a document with a smaller id is a repeat, of consecutive chunks there as here;
overlapping repeats are one passage, and all documents but the one with the smallest id lose it.

Windows are counted with map-side combining (smallest and largest document of each digest), so a passage that a third of
all documents share costs one row a task; the join that marks repeats has one row per digest on its right side, so
adaptive execution can split a frequent digest. No text is shuffled.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import in_small_batches

WINDOW = 16
#: Chunks end at one of so many word ends, and within long words at one of 256 bytes.
WORDS_PER_CHUNK = 5
#: A window holds so many words. Of a passage of 50 words, chunks cut at its ends leave that many whole in
#: 97 of 100 cases, of one of 60 words in 995 of 1000.
MIN_WORDS = 20


def _gear(seed: int = 42) -> np.ndarray:
    draw = random.Random(seed)
    return np.array([draw.getrandbits(16) for _ in range(256)], np.uint16)


_GEAR = _gear()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Chunks(NamedTuple):
    """The chunks of some texts, in order: which text, digest (two unsigned 64-bit numbers a row), first byte, end, words."""

    text: np.ndarray
    digest: np.ndarray
    first: np.ndarray
    end: np.ndarray
    words: np.ndarray


def chunk_table(texts: list[str | None]) -> Chunks:
    """Cuts texts into chunks, all in one pass: WINDOW bytes that count as nothing stand before each."""
    raws = [(t or "").encode("utf-8", "replace") for t in texts]
    size = np.array([len(r) for r in raws], np.int64)
    begin = np.cumsum(np.r_[0, size[:-1]]) + WINDOW * np.arange(1, len(raws) + 1) if len(raws) else size
    joined = b"\0" * WINDOW + (b"\0" * WINDOW).join(raws)
    b = np.frombuffer(joined, np.uint8)
    own = np.ones(len(b), bool)
    for k in range(1, WINDOW + 1):
        own[begin - k] = False
    g = np.where(own, _GEAR[b], np.uint16(0))
    h = g.copy()
    for k in range(1, WINDOW):
        h[k:] += g[:-k] << np.uint16(k)
    space = _SPACE[b] | ~own
    word_end = space & own
    word_end[:-1] &= ~space[1:]  # the next byte starts a word
    whole = np.ones(len(b), bool)
    whole[:-1] = (b[1:] & 0xC0) != 0x80  # the next byte starts a character
    hit = own & ((word_end & (h < (1 << 16) // WORDS_PER_CHUNK)) | (~space & whole & (h < 256)))
    some = size > 0
    hit[begin[some] + size[some] - 1] = True
    end = np.flatnonzero(hit) + 1
    text = np.searchsorted(begin, end - 1, side="right") - 1
    start = np.r_[0, end[:-1]][: len(end)]
    new = np.r_[True, text[1:] != text[:-1]] if len(end) else np.zeros(0, bool)
    start[new] = begin[text[new]]
    first = ~space
    first[1:] &= space[:-1]
    count = np.cumsum(first)
    words = np.diff(np.r_[0, count[end - 1]])
    digest = xxhash.xxh3_128_digest
    found = b"".join([digest(joined[s:e].rstrip()) for s, e in zip(start.tolist(), end.tolist(), strict=True)])
    return Chunks(text, np.frombuffer(found, "<u8").reshape(-1, 2), start - begin[text], end - begin[text], words)


def chunks(text: str | None) -> list[tuple[int, int, int, int]]:
    """(digest, first byte, end, words) of each chunk."""
    c = chunk_table([text])
    return list(zip(c.digest[:, 0].tolist(), c.first.tolist(), c.end.tolist(), c.words.tolist(), strict=True))


#: Odd multipliers: a window's digest is the sum of its chunks' digests times their powers, modulo 2^64.
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def window_table(texts: list[str | None], min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """Of each window: which text, 64 bits of its digest, 32 more, its bytes and its words; spans as start << 32 | end."""
    text, digest, first, end, words = chunk_table(texts)
    n = len(text)
    upto = np.cumsum(words, dtype=np.int64)
    before = upto - words
    stop_of = np.searchsorted(text, np.arange(len(texts)), side="right") - 1  # the last chunk of each text
    last = np.searchsorted(upto, before + min_words)  # the first chunk by which min_words words have begun
    begin = np.flatnonzero(last <= stop_of[text]) if n else np.zeros(0, np.int64)
    stop = last[begin]
    # one more for each text that ends with it, so that its last words are in a window too
    final = np.r_[text[begin][1:] != text[begin][:-1], True] if len(begin) else np.zeros(0, bool)
    tail = stop_of[text[begin[final]]]
    short = tail > stop[final]
    extra = np.searchsorted(before, upto[tail[short]] - min_words, side="right") - 1
    begin, stop = np.r_[begin, extra], np.r_[stop, tail[short]]
    total, power, on, k = np.zeros((len(begin), 2), np.uint64), np.ones(2, np.uint64), np.arange(len(begin)), 0
    while len(on):
        total[on] += digest[begin[on] + k] * power
        power = power * _STEP
        k += 1
        on = on[begin[on] + k <= stop[on]]
    ahead = before[np.searchsorted(text, text[begin])] if n else stop  # words of the texts before
    more = (total[:, 1] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return text[begin], total[:, 0].copy().view(np.int64), more, first[begin] << 32 | end[stop], (before[begin] - ahead) << 32 | (upto[stop] - ahead)


def windows(text: str | None, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int]]:
    """(64 bits of the digest, 32 more, bytes, words) of each window of one text."""
    return list(zip(*(x.tolist() for x in window_table([text], min_words)[1:]), strict=True))


_WINDOW = "doc_id long, row_key long, digest long, more int, bytes long, words long"


def _window_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _WINDOW.split(", ")]
        for b in batches:
            for start, texts in in_small_batches(b.column(2).to_pylist()):
                text, *cols = window_table(texts, min_words)
                at = pa.array(text + start)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *map(pa.array, cols)], names=names)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """row_key, doc_id, first, end (bytes), words, source_ids: passages that documents with a smaller id hold too.

    row_key is xxhash64 of id and text; rows with equal ids count as one document. Null ids count as the largest. Of the
    documents that hold a window of the passage the smallest is named.
    """
    pieces = _keyed(docs, id_col, text_col).mapInArrow(_window_rows(min_words), _WINDOW).withColumn("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    shared = pieces.groupBy(F.col("digest").alias("d"), F.col("more").alias("m")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    hits = pieces.join(shared, (F.col("digest") == F.col("d")) & (F.col("more") == F.col("m"))).where("doc_id > low").select("row_key", "doc_id", "bytes", "words", "low").distinct()
    start, stop = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)))
    spans = hits.select("row_key", "doc_id", "low", start("bytes").alias("first"), stop("bytes").alias("end"), start("words").alias("w0"), stop("words").alias("w1"))
    by_doc = Window.partitionBy("row_key").orderBy("first", "end")
    fresh = F.coalesce(F.col("first") > F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = spans.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("row_key", "run").agg(F.min("doc_id").alias("doc_id"), F.min("first").alias("first"), F.max("end").alias("end"), (F.max("w1") - F.min("w0")).alias("words"), F.sort_array(F.collect_set("low")).alias("source_ids")).drop("run")


def _listed() -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "end"))), lambda x: F.concat_ws("-", x["first"].cast("string"), x["end"].cast("string"))), ",").alias("spans")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_spans, removed_bytes, removed_words, spans, source_ids.

    spans lists the removed passages as "first-end" in bytes of the UTF-8 text, comma-joined; source_ids the documents
    that keep them. Null and empty texts have no chunks and lose nothing. Repeated rows (same id) are one document and
    lose what a smaller id holds, each. An empty table gives an empty result; other input columns are ignored.
    """
    each = repeated_spans(docs, id_col, text_col, min_words).groupBy("row_key").agg(
        F.count("*").alias("n_spans"),
        F.sum(F.col("end") - F.col("first")).cast("long").alias("removed_bytes"),
        F.sum("words").alias("removed_words"),
        _listed(),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_ids")))).alias("source_ids"),
    )
    rows = _keyed(docs, id_col, text_col).select("doc_id", F.col("row_key").alias("k"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(each, F.col("k") == F.col("row_key"), "left").select("doc_id", "n_bytes", zero("n_spans"), zero("removed_bytes"), zero("removed_words"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("source_ids", F.array().cast("array<bigint>")).alias("source_ids"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            raw, at, kept = (text or "").encode("utf-8", "replace"), 0, []
            for span in spans.split(",") if spans else ():
                s, e = map(int, span.split("-"))
                kept.append(raw[at:s])
                at = e
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8"))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text of every row, repeated passages cut out; null texts come back empty."""
    spans = repeated_spans(docs, id_col, text_col, min_words).groupBy(F.col("row_key").alias("k")).agg(_listed())
    return _keyed(docs, id_col, text_col).join(spans, F.col("row_key") == F.col("k"), "left").select("doc_id", "text", F.coalesce("spans", F.lit("")).alias("spans")).mapInArrow(_cut_out, "doc_id long, text string")
