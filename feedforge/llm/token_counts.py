"""Token counts: texts of any length counted exactly, in pieces whose boundaries are proven stable.

In byte-pair encoding two neighbouring symbols only merge if their concatenation is a piece. A
cut between characters a and b is therefore stable, whatever stands around it, if no piece of the
vocabulary holds a directly followed by b. Two uses are made of that:

* A huge text is encoded in overlapping chunks with token offsets. Consecutive chunks are spliced
  at a boundary that both have in their overlap and that is stable; without one the overlap is
  doubled, up to the whole chunk, and then the chunk is.
* In other texts, the cut before a space is stable (checked against the vocabulary when the model
  is loaded), so that each word is counted once and then remembered.

The vocabulary's path is a parameter. Null texts count as empty and have 0 tokens; repeated rows
get equal counts. Extra columns pass through; a column named like an output is replaced by it.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bytekit, common

LIMIT = 4096
#: Code points from which a text is encoded in chunks, of a chunk, and of an overlap at first.
HUGE, CHUNK, OVERLAP = 1 << 16, 1 << 14, 256
#: Words a worker remembers.
MEMO = 400_000
SPACE = "▁"

_cut = re.compile(rf"(?<=[^ {SPACE}]) ")


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        #: Code points of each token; of a byte token 1 if it begins a character, else 0.
        self.width, self.inner = np.ones(n, np.int64), np.zeros(n, bool)
        self.joined: set[str] = set()
        for i, piece in enumerate(pieces):
            if self.model.is_byte(i):
                self.inner[i] = 0x80 <= int(piece[1:-1], 16) < 0xC0
                self.width[i] = 0 if self.inner[i] else 1
            elif not (self.model.is_control(i) or self.model.is_unknown(i)):
                self.width[i] = len(piece)
                self.joined.update(piece[k : k + 2] for k in range(len(piece) - 1))
        self.by_words = not any(pair[1] == SPACE and pair[0] != SPACE for pair in self.joined)
        self.memo: dict[str, int] = {}

    def stable(self, before: str, after: str) -> bool:
        return before + after not in self.joined

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(text) >= HUGE:
            return self.count_huge(text)
        if not self.by_words:
            return len(self.model.encode(text))
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            words = _cut.split(text)
            if words[-1] == "":  # one space at the end
                return 1 + self._sum(words[:-1])
            return self._sum(words)
        return self._sum(text.split(" "))

    def _sum(self, words: list[str]) -> int:
        memo = self.memo
        try:
            return sum([memo[w] for w in words])
        except KeyError:
            new = list({w for w in words if w not in memo})
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = list(set(words))
            memo.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))
            return sum([memo[w] for w in words])

    def _tokens(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Token starts of text[start:end] as places in the whole text, and which are inside a character.

        The encoder puts a space before the chunk; a token that begins there starts at start - 1.
        """
        ids = np.array(self.model.encode(text[start:end]), np.int64)
        width = self.width[ids]
        return start - 1 + np.cumsum(width) - width, self.inner[ids]

    def count_huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of the text by overlapping chunks; equal to encoding it whole."""
        n, total, begun, at, size = len(text), 0, -1, 0, chunk
        starts, inner = self._tokens(text, at, min(n, at + size))
        while at + size < n:
            width, found = min(overlap, size), None
            while found is None and width < size:
                low = at + size - width
                ahead, ahead_inner = self._tokens(text, low, min(n, low + chunk))
                places = np.intersect1d(starts[~inner & (starts > max(low, begun))], ahead[~ahead_inner])
                found = next((int(p) for p in places[::-1] if self.stable(_shown(text[p - 1]), _shown(text[p]))), None)
                width *= 2
            if found is None:  # no stable boundary in the overlaps: the chunk itself grows
                size *= 2
                starts, inner = self._tokens(text, at, min(n, at + size))
                continue
            total += int(np.count_nonzero(_between(starts, inner, begun, found)))
            begun, at, size, starts, inner = found, low, chunk, ahead, ahead_inner
        return total + int(np.count_nonzero(_between(starts, inner, begun, n + 1)))


def _shown(character: str) -> str:
    return SPACE if character == " " else character


def _between(starts: np.ndarray, inner: np.ndarray, low: int, high: int) -> np.ndarray:
    """Tokens of the characters from low to before high. A token inside a character starts after that character."""
    place = starts - inner
    return (place >= low) & (place < high)


@cache
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    names = docs.columns

    def counted(batches):
        counter = piece_counter(path)
        for part, texts in bytekit.batches_of_texts(batches):
            n = np.array([counter.count(b.decode()) for b in texts.blobs], np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts.end - texts.start), pa.array(n), pa.array(n > limit)], names=[*names, "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(counted, common.widened(docs.schema, "n_bytes long, n_tokens long, over_limit boolean"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")
