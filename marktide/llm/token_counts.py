"""Token counts of whole texts with a shortcut for vocabulary strings that are one token by themselves.

A byte-pair tokenizer of this kind cuts the normalised text into pre-tokens by a pattern and merges inside each pre-token
alone, whatever stands beside it. So if a vocabulary string is a pre-token by itself and its merges end in one token, each
of its occurrences counts one. whole_tokens() proves that once, before the job, for every string of the vocabulary; the
job looks pre-tokens up in the proven set and runs merges only for the rest. The set is as large as the vocabulary at most.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import byte_letters, default_path, in_small_batches

#: Pieces that a worker remembers at most; then it starts anew. Longer ones are cut and merged each time.
MEMO, LONG = 1_000_000, 64
#: Characters outside these ranges go to the library with the piece of text between spaces that holds them, so that no
#: difference between two versions of Unicode's tables counts. A test holds each of these characters to the library.
_KNOWN = "\\x00-\\x1B\\x20-\\u024F\\u0386-\\u03FF\\u0400-\\u0481\\u2010-\\u2027\\u2030-\\u205E\\u20AC\\u3041-\\u3096\\u30A1-\\u30FA\\u4E00-\\u9FA5"
_OTHER = re.compile(f"[^{_KNOWN}]")
#: White space for Python's split() alone; a text with one of these is cut at ASCII white space.
_SEPARATORS, _SPACES = re.compile("[\x1C-\x1F]"), re.compile("[ \t\n\r\x0B\x0C]+")
#: The letters that byte-level vocabularies write for bytes.
_LETTERS, _PRINTED = byte_letters(), re.compile("[!-~]*")


class Vocabulary:
    """A tokenizers file whose normaliser and pattern are those of word-level byte-pair encoding."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        if spec["model"]["type"] != "BPE" or steps[0].get("behavior") != "Removed" or not steps[0].get("invert") or spec["model"].get("dropout") or spec["model"].get("ignore_merges"):
            raise ValueError(f"{path}: pre-tokens must be the matches of a pattern, merged without dropout")
        self.tokenizer = Tokenizer.from_file(path)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.strings = spec["model"]["vocab"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def merged(self, word: str) -> int:
        """Tokens of one pre-token, by the library's merges alone."""
        return len(self.tokenizer.model.tokenize(word if _PRINTED.fullmatch(word) else word.encode().decode("latin-1").translate(_LETTERS)))

    def encoded(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece, by the whole library."""
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings, as text, that alone are one pre-token and that the merges join to one token.

    A string proves itself: it must be whole UTF-8, unchanged by the normaliser, one match of the pattern from end to end,
    and encode to its own id. Strings that the merges never reach, or that only occur inside words, drop out.
    """
    known, letters = Vocabulary(path), {c: b for b, c in _LETTERS.items()}
    texts, ids = [], []
    for string, number in known.strings.items():
        if not string.endswith(known.suffix) or not all(c in letters for c in string.removesuffix(known.suffix)):
            continue
        try:
            text = bytes(letters[c] for c in string.removesuffix(known.suffix)).decode()
        except UnicodeDecodeError:
            continue
        if text and known.tokenizer.normalizer.normalize_str(text) == text and len(known.tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1:
            texts.append(text)
            ids.append(number)
    found = known.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(t for t, i, e in zip(texts, ids, found, strict=True) if e.ids == [i] and known.pattern.fullmatch(t))


class Counter:
    """Counts tokens; whole is the proven set of this tokenizer.

    Neither the normaliser nor the pattern joins anything across white space, so a text is looked up piece by piece. The
    table starts with the proven strings; a new piece is cut into pre-tokens once, those in the set count one, and the
    merges run for the others.
    """

    def __init__(self, path: str, whole: frozenset[str]):
        self.vocabulary, self.whole, self.table = Vocabulary(path), whole, dict.fromkeys(whole, 1)

    def _learn(self, pieces: list[str]) -> dict[str, int]:
        counts, other = {}, []
        for p in pieces:
            low = p.lower() if p.isascii() else self.vocabulary.tokenizer.normalizer.normalize_str(p)
            if not p.isascii() and (_OTHER.search(low) or _OTHER.search(p)) or _SEPARATORS.search(p):
                other.append(p)
            else:
                counts[p] = sum([1 if w in self.whole else self.vocabulary.merged(w) for w in self.vocabulary.pattern.findall(low)])
        counts.update(zip(other, self.vocabulary.encoded(other), strict=True))
        return counts

    def _plain(self, text: str) -> int:
        """Of text without special strings."""
        pieces = _SPACES.split(text) if _SEPARATORS.search(text) else text.split()
        found = list(map(self.table.get, pieces))
        if None not in found:
            return sum(found)
        new = self._learn(list({p for p, n in zip(pieces, found, strict=True) if n is None}))
        if len(self.table) + len(new) > MEMO:
            self.table = dict.fromkeys(self.whole, 1)
        self.table.update((p, n) for p, n in new.items() if len(p) <= LONG)
        return sum(new[p] if n is None else n for p, n in zip(pieces, found, strict=True))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        special = self.vocabulary.special
        if special is None or not special.search(text):
            return self._plain(text)
        parts = special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


@lru_cache(maxsize=4)
def _counter(path: str, whole: frozenset[str]) -> Counter:
    """One for each worker process, so that the memo outlives a task."""
    return Counter(path, whole)


def _counts(path: str, whole):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path, whole.value).count
        for b in batches:
            done: list[int] = []
            for _, texts in in_small_batches(b.column(2).to_pylist()):
                done += map(count, texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(done, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    The counts are those of encoding the whole text without begin and end; special strings inside a text count as the
    library takes them. Null and empty texts have no token and are never over the limit; null ids stay null and repeated
    rows are all returned. An empty table gives an empty result; other columns are ignored. Nothing is shuffled.
    """
    path = tokenizer or default_path("word_bpe_49k.json")
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(_counts(path, whole), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.coalesce(F.col("n_tokens") > limit, F.lit(False)))
