"""Token-id files: independent zstandard frames with a trailing seek table and a checksum per frame.

A file is a run of zstandard frames followed by a skippable frame that holds the public seekable format's seek table
(compressed size, decompressed size and the low 32 bits of the XXH64 of the decompressed bytes of every frame). Each
frame holds whole documents and can be read alone:

    "MTF1", id width in bytes (u32), documents (u32), then per document: has an id (u8), id (i64), ids (u64), then all ids

Before the seek table stands one more skippable frame, the document index: per frame its smallest and largest id (i64, u8:
whether it holds documents without an id), documents (u32) and ids (u64). All numbers are little-endian. Readers fetch both
tables from the end of the file and decompress only the frames that they need.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved, workspace
from .tokens import default_path, encoder, in_small_batches

_SKIPPABLE, _SEEKABLE, _INDEX = 0x184D2A5E, 0x8F92EAB1, 0x184D2A5D
_ENTRY = struct.Struct("<qqBIQ")
#: Bytes of ids after which a frame closes.
FRAME = 1 << 20


class FrameWriter:
    """Writes documents to an open binary file; close() adds the seek table."""

    def __init__(self, out, width: int, frame: int = FRAME, level: int = 3):
        self.out, self.type, self.frame, self.zstd = out, np.dtype(f"<u{width}"), frame, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table, self.index, self.docs, self.size = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids.astype(self.type, copy=False)))
        self.size += self.docs[-1][1].nbytes
        if self.size >= self.frame:
            self.flush()

    def flush(self) -> None:
        if self.docs:
            ids = np.array([i or 0 for i, _ in self.docs], "<i8")
            raw = b"".join([b"MTF1", struct.pack("<II", self.type.itemsize, len(self.docs)), np.array([i is not None for i, _ in self.docs], "u1").tobytes(), ids.tobytes(), np.array([len(x) for _, x in self.docs], "<u8").tobytes(), *(x.tobytes() for _, x in self.docs)])
            packed = self.zstd.compress(raw)
            self.out.write(packed)
            self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            known = [i for i, _ in self.docs if i is not None]
            self.index.append((min(known, default=1), max(known, default=0), len(known) < len(self.docs), len(self.docs), sum(len(x) for _, x in self.docs)))
            self.docs, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(_ENTRY.pack(*x) for x in self.index)
        self.out.write(struct.pack("<II", _INDEX, len(body)) + body)
        body = b"".join(struct.pack("<III", *x) for x in self.table)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(body) + 9) + body + struct.pack("<IBI", len(self.table), 0x80, _SEEKABLE))


def seek_table(file) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, size, checksum) of each frame of an open file, from its last bytes alone."""
    end = file.seek(0, 2)
    file.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != _SEEKABLE or flags != 0x80:
        raise ValueError("no seek table with checksums at the end of the file")
    file.seek(end - 9 - 12 * n)
    out, at = [], 0
    for packed, size, check in struct.iter_unpack("<III", file.read(12 * n)):
        out.append((at, packed, size, check))
        at += packed
    return out


def frame_index(file, table: list[tuple[int, int, int, int]]) -> list[tuple[int, int, bool, int, int]]:
    """(smallest id, largest id, whether some have none, documents, ids) of each frame of an open file."""
    file.seek(table[-1][0] + table[-1][1] if table else 0)
    magic, size = struct.unpack("<II", file.read(8))
    if magic != _INDEX or size != len(table) * _ENTRY.size:
        raise ValueError("no document index before the seek table")
    return [(a, b, bool(none), docs, ids) for a, b, none, docs, ids in _ENTRY.iter_unpack(file.read(size))]


def read_frame(file, offset: int, packed: int, size: int, check: int) -> list[tuple[int | None, np.ndarray]]:
    """The documents of one frame; a ValueError if its bytes do not match the checksum."""
    file.seek(offset)
    try:
        raw = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=size)
    except zstandard.ZstdError as e:
        raise ValueError(f"frame at {offset}: {e}") from e
    if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check or raw[:4] != b"MTF1":
        raise ValueError(f"frame at {offset}: checksum does not match")
    width, n = struct.unpack_from("<II", raw, 4)
    has, ids, lens = np.frombuffer(raw, "u1", n, 12), np.frombuffer(raw, "<i8", n, 12 + n), np.frombuffer(raw, "<u8", n, 12 + 9 * n)
    flat = np.frombuffer(raw, f"<u{width}", int(lens.sum()), 12 + 17 * n)
    return [(int(i) if h else None, x) for h, i, x in zip(has, ids, np.split(flat, np.cumsum(lens)[:-1].astype(np.int64)), strict=True)]


def _open(path: str):
    fs, place = pafs.FileSystem.from_uri(path)
    return fs, place


def _write(folder: str, tokenizer: str, end_id: int, frame: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, tokens = task.partitionId(), encoder(tokenizer, False)
        width = 2 if max(tokens.tokenizer.get_vocab_size(), end_id) < 1 << 16 else 4
        fs, place = _open(folder)
        # each attempt has a file of its own, and the manifest names that of the one that counts: nothing is ever replaced
        name = f"part-{number:06d}-{task.taskAttemptId()}.zst"
        n_docs = n_ids = 0
        with fs.open_output_stream(f"{place}/{name}", compression=None) as out:
            writer = FrameWriter(out, width, frame)
            for b in batches:
                ids = b.column(0).to_pylist()
                for start, texts in in_small_batches(b.column(1).to_pylist()):
                    for k, raw in enumerate(tokens.encode(texts), start):
                        x = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id))
                        writer.add(ids[k], x)
                        n_docs, n_ids = n_docs + 1, n_ids + len(x)
            writer.close()
        yield pa.RecordBatch.from_pydict({"file_no": [number], "path": [name], "n_docs": [n_docs], "n_tokens": [n_ids]}, schema=pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, frame: int = FRAME, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts, each with end_id, in ascending id order; returns the manifest (file_no, path, n_docs, n_tokens).

    Files are in order of file_no. Null texts are empty; null ids come first; rows with equal ids are in order of a hash
    of their text. An empty table gives files without a frame.
    """
    fs, place = _open(folder)
    fs.create_dir(place, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    return saved(ordered.mapInArrow(_write(folder, tokenizer, end_id, frame), "file_no long, path string, n_docs long, n_tokens long"), "manifest")


_FRAME_ROW = "file_no long, path string, frame_no long, place long, packed long, size long, checksum long, first_id long, last_id long, no_id long, n_docs long, n_tokens long"


def _tables(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FRAME_ROW.split(", ")]
        for b in batches:
            rows = []
            for r in b.to_pylist():
                fs, place = _open(folder)
                with fs.open_input_file(f"{place}/{r['path']}") as f:
                    table = seek_table(f)
                    rows += [(r["file_no"], r["path"], k, *x, *y) for k, (x, y) in enumerate(zip(table, frame_index(f, table), strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) if k != 1 else x[k] for x in rows], pa.string() if k == 1 else pa.int64()) for k in range(len(names))], names=names)

    return run


def frames(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per frame, from the tables at the end of each file: where it lies and which ids it holds."""
    return manifest.select("file_no", "path").repartition("file_no").mapInArrow(_tables(folder), _FRAME_ROW)


def _opened(folder: str, names: list[str], types: list[pa.DataType], of):
    """Reads each frame and makes rows of its documents: of(row of the frame, documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, place = _open(folder)
                with fs.open_input_file(f"{place}/{r['path']}") as f:
                    docs = read_frame(f, r["place"], r["packed"], r["size"], r["checksum"])
                cols = list(zip(*of(r, docs), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Frames are read one by one through each file's seek table and spread over the cluster.
    """

    def digest(r: dict, docs: list) -> Iterator[tuple]:
        at = r["start"]
        for i, x in docs:
            yield i, at, len(x), zlib.crc32(x.astype("<u4").tobytes())
            at += len(x)

    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    files = manifest.select(F.col("file_no").alias("f"), before(Window.orderBy("file_no")).alias("base"))  # one row per file
    found = frames(manifest, folder).withColumn("ahead", before(Window.partitionBy("file_no").orderBy("frame_no")))
    found = found.join(files, F.col("file_no") == F.col("f")).select("path", "place", "packed", "size", "checksum", (F.col("base") + F.col("ahead")).alias("start"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return found.repartition(partitions(manifest.sparkSession)).mapInArrow(_opened(folder, names, [pa.int64()] * 4, digest), ", ".join(f"{n} long" for n in names))


def frames_of(manifest: DataFrame, folder: str, doc_ids: list[int]) -> DataFrame:
    """The frames that may hold one of the ids: their range of ids has it. The list is the request, so its size is known."""
    wanted = F.array(*[F.lit(int(i)).cast("long") for i in doc_ids]).cast("array<bigint>")
    return frames(manifest, folder).where(F.exists(wanted, lambda i: (i >= F.col("first_id")) & (i <= F.col("last_id"))))


def read_documents(manifest: DataFrame, folder: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of the documents asked for; only frames_of() them are read. Unknown ids give no row, repeated rows all."""
    wanted = {int(i) for i in doc_ids}
    pick = lambda _, docs: [(i, x.tolist()) for i, x in docs if i in wanted]
    return frames_of(manifest, folder, sorted(wanted)).mapInArrow(_opened(folder, ["doc_id", "ids"], [pa.int64(), pa.list_(pa.int64())], pick), "doc_id long, ids array<long>")


def token_round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the files of docs and reads them back."""
    folder = folder or workspace(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer or default_path("byte_bpe_50k.json"), end_id), folder)
