"""Token ids of whole texts by the tokenizers library, with a memo of the pieces between spaces.

The public tokenizers used here never join anything across a space that follows a character other than white space
(byte-level) or across any space (word-level), so a text's ids are those of its pieces, one after another. Natural text
repeats its pieces; looking them up costs a tenth of encoding them again. New words of plain Latin letters go to the
library's model directly, all other pieces through the whole tokenizer. The ids are those of encode() on the whole text.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

#: A space that can't be cut at: the character before it is white space too.
_DOUBLE = re.compile(r" (?<=\s )")
_SINGLE = re.compile(r"(?<!\s) ")
#: Latin letters, then ASCII marks: these two never join, so the model is asked directly for each.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-/:-@\[-`{-~]*)")
#: Pieces that a memo holds at most; then it starts anew.
MEMO = 1_000_000
#: Longer pieces are encoded each time.
LONG = 64


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write for bytes (a public, fixed convention), by Latin-1 code point."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """path: a tokenizers JSON file; word_level: white space only parts words there (else each space belongs to its word)."""

    def __init__(self, path: str, word_level: bool):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.word_level = Tokenizer.from_file(path), word_level
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.memo: dict[str, bytes] = {}  # of pieces after a space
        self.lead: dict[str, bytes] = {}  # of pieces at the start of a text, where that differs
        self.marks: dict[str, bytes] = {}
        self.line = self._ids(["\n"])[0]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _word(self, word: str, space: str) -> bytes:
        word = word.lower() if self.word_level else space + word
        if not word.isascii() or space:
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _plain(self, piece: str, space: str) -> bytes | None:
        """The ids of a piece that is a plain word and marks, else None."""
        if not (m := _PLAIN.fullmatch(piece)):
            return None
        word, marks = m.groups()
        memo = self.memo if space or self.word_level else self.lead
        if (ids := memo.get(word)) is None:
            ids = memo[word] = self._word(word, space)
        if marks:
            if (last := self.marks.get(marks)) is None:
                last = self.marks[marks] = self._word(marks, "")
            ids += last
        return ids

    def _learn(self, new: list[str], memo: dict[str, bytes], space: str) -> None:
        other = []
        for p in new:
            if "\n" in p:
                lines = p.split("\n")
                ids = [self._plain(x, "" if k else space) for k, x in enumerate(lines)]
                ids = None if None in ids else self.line.join(ids)
            else:
                ids = self._plain(p, space)
            if ids is None:
                other.append(p)
            else:
                memo[p] = ids
        memo.update(zip(other, self._ids([space + p for p in other]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The little-endian unsigned 32-bit ids of each text; null is empty."""
        if self.word_level:
            lead, space, cut = self.memo, "", [(t or "").replace("\n", " ").split(" ") for t in texts]
        else:
            lead, space, cut = self.lead, " ", [_SINGLE.split(t) if _DOUBLE.search(t) else t.split(" ") for t in (x or "" for x in texts)]
        if len(self.memo) + len(self.lead) + len(self.marks) > MEMO:
            for known in (self.memo, self.lead, self.marks):
                known.clear()
        memo = self.memo
        self._learn(list({p[0] for p in cut}.difference(lead)), lead, "")
        out, get = [], memo.get
        for pieces in cut:
            found = list(map(get, pieces[1:]))
            if None in found:
                new = list({p for p, v in zip(pieces[1:], found, strict=True) if v is None})
                self._learn(new, memo, space)
                found = list(map(get, pieces[1:]))
                for p in new:
                    if len(p) > LONG:
                        del memo[p]
            out.append(b"".join([lead[pieces[0]], *found]))
        for p in [p for p in {p[0] for p in cut} if len(p) > LONG]:
            del lead[p]
        return out


@lru_cache(maxsize=4)
def encoder(path: str, word_level: bool) -> Encoder:
    """One encoder for each worker process, so that the memo outlives a task."""
    return Encoder(path, word_level)


def in_small_batches(texts, limit: int = 1 << 20):
    """Consecutive slices (start, texts) of about limit characters, so that memory does not follow the batch size."""
    start, size, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t or "")
        if size >= limit:
            yield start, held
            start, size, held = i + 1, 0, []
    if held:
        yield start, held
