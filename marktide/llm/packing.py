"""Sequence packing as vector bin packing.

Examples have a demand in three dimensions (tokens, segments, loss-bearing tokens) and a sequence has a limit in each.
The dot-product heuristic fills one sequence at a time: among the examples that still fit it takes the one whose demand
has the largest weighted inner product with what is left of the sequence.

Each task packs the examples that it reads, in blocks of at most BLOCK, so nothing is shuffled and a lost task is simply
run again; a block leaves at most a few sequences that are not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_path, encoder, in_small_batches

BLOCK = 20_000
#: Sequence ids are the task's number times this, and on from there.
TASK_STEP = 1 << 32


def dot_product_pack(demand: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """demand (n, d) of positive rows, limit (d,): the number of the sequence of each row, from 0.

    Rows with equal demand are interchangeable and form one class, so a step looks at classes rather than rows. A row
    that exceeds a limit by itself is an error: cut it first.
    """
    n = len(demand)
    if not n:
        return np.zeros(0, np.int64)
    if (demand > limit).any():
        raise ValueError("an example exceeds a limit by itself")
    kinds, of = np.unique(demand, axis=0, return_inverse=True)
    of = of.reshape(-1)
    order = np.argsort(of, kind="stable")
    begin = np.searchsorted(of[order], np.arange(len(kinds) + 1))
    left = np.diff(begin)
    share = kinds / limit
    weight = (share * left[:, None]).sum(axis=0) / n  # a scarce dimension counts more
    value, columns, more = share * weight / limit, [np.ascontiguousarray(k) for k in kinds.T], left > 0
    out, sequence, done = np.empty(n, np.int64), 0, 0
    while done < n:
        room, fits = limit.astype(np.int64), more.copy()
        while True:
            score = value @ room
            score[~fits] = -1
            best = int(score.argmax())
            if score[best] < 0:
                break
            left[best] -= 1
            more[best] = left[best] > 0
            out[order[begin[best] + left[best]]] = sequence
            room = room - kinds[best]
            done += 1
            fits &= more
            for k, column in enumerate(columns):
                fits &= column <= room[k]
        sequence += 1
    return out


def _pack(tokenizer: str, end_id: int, limit: tuple[int, int, int]):
    size = limit[0]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, following = encoder(tokenizer, True), TaskContext.get().partitionId() * TASK_STEP
        end, held = np.uint32(end_id).tobytes(), []

        def out(pieces: list[tuple], place: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True)) if pieces else [()] * 5
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(place, pa.int64()), pa.array(offset, pa.int64())], names=names)

        def packed() -> pa.RecordBatch:
            nonlocal following, held
            n = np.array([p[2] for p in held], np.int64).reshape(-1)
            place = dot_product_pack(np.stack([n, np.ones_like(n), n], axis=1), np.array(limit))
            order, offset = np.argsort(place, kind="stable"), np.zeros(len(n), np.int64)
            ends = np.cumsum(n[order])
            first = np.r_[True, place[order][1:] != place[order][:-1]] if len(n) else np.zeros(0, bool)
            begin = ends - n[order]
            offset[order] = begin - np.maximum.accumulate(np.where(first, begin, 0)) if len(n) else 0
            b = out(held, place + following, offset)
            following += int(place.max()) + 1 if len(n) else 0
            held = []
            return b

        for b in batches:
            ids, full = b.column(0).to_pylist(), []
            for first, texts in in_small_batches(b.column(1).to_pylist()):
                for k, raw in enumerate(tokens.encode(texts), first):
                    raw += end
                    total = len(raw) // 4
                    for s in range(0, total, size):
                        piece = raw[4 * s : 4 * (s + size)]
                        (full if len(piece) == 4 * size else held).append((ids[k], s, len(piece) // 4, zlib.crc32(piece), total))
                if len(held) >= BLOCK:
                    yield packed()
            yield out(full, np.arange(len(full)) + following, np.zeros(len(full), np.int64))
            following += len(full)
        yield packed()

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = 2048, max_segments: int = 512, max_loss: int | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every token of a document bears loss. Documents longer than a sequence are cut at multiples of max_tokens; whole
    sequences stand alone and the rest is packed. A null or empty text is its end id alone. Repeated rows are packed
    each. An empty table gives an empty result; other input columns are ignored.
    """
    limit = (max_tokens, max_segments, max_loss or max_tokens)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(_pack(tokenizer or default_path("word_bpe_49k.json"), end_id, limit), schema)


def _pack_examples(limit: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = TaskContext.get().partitionId() * TASK_STEP
        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                part = b.slice(s, BLOCK)
                demand = np.stack([part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3)], axis=1)
                place = dot_product_pack(np.maximum(demand, 0), np.array(limit))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(place + following, pa.int64())], names=["example_id", "sequence_id"])
                following += int(place.max()) + 1 if len(place) else 0

    return run


def pack_examples(examples: DataFrame, max_tokens: int, max_segments: int, max_loss: int) -> DataFrame:
    """Instruction examples (example_id, tokens, segments, loss_tokens) to (example_id, sequence_id) under all three limits.

    Null demands count as 0; an example that exceeds a limit by itself is an error.
    """
    zero = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("tokens", "segments", "loss_tokens")]
    return examples.select(F.col("example_id").cast("long"), *zero).mapInArrow(_pack_examples((max_tokens, max_segments, max_loss)), "example_id long, sequence_id long")
