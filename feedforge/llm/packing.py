"""Packing: documents as token ids in sequences of fixed capacity, by best-fit decreasing.

A document of CAPACITY ids or more is first cut into full windows; these are sequences of their
own. What is left of each document is shorter than a window. These pieces are dealt evenly over
shards of about SHARD pieces, and each shard packs its pieces longest first: a segment tree over
remaining capacities finds the tightest open window that still takes the piece. A shard leaves
about one window partly filled, whatever the whole corpus holds, so shards cost next to no padding
and grow in number, not in size.

The vocabulary's splitter cuts a text into parts that are encoded apart from each other, so each
part is encoded once and remembered; a text's ids are its parts' ids.

Null texts count as empty: their only id is the end id. Repeated rows and equal ids are packed as
separate documents. Empty tables give no rows. Extra columns don't reach the result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import bytekit, common
from .common import staged

CAPACITY, END_ID, SHARD = 4096, 2, 4096
#: Pieces that a worker remembers.
MEMO = 600_000

# Fixed value: the splitter of the vocabulary's file.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordEncoder:
    """Ids of texts by the parts that the vocabulary's splitter makes, each encoded once and remembered.

    In lower case, runs of letters and of ASCII punctuation are parts where nothing else meets
    them, so most texts are split by setting punctuation runs apart. Pieces with digits, and all
    words of texts with apostrophes or with other characters that are neither letters nor numbers,
    are split by the splitter's own pattern. Parts are encoded together by a model without
    normaliser and splitter, since that work is done; each part gives exactly one token that ends a
    word, by which the ids of a batch are told apart. Texts that may hold a special token, and
    batches that don't come out even, go one by one through the whole model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.model, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.model.get_vocab_size()
        self.ends = np.array([(self.model.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: set[str]) -> None:
        """Remember the ids of new pieces: parts, or words that the splitter may cut further."""
        split = {x: _PARTS.findall(x) for x in pieces if not (x.isalpha() or _PUNCTUATION.fullmatch(x))}
        parts = list((pieces - split.keys()).union(*split.values()))
        got: dict[str, bytes] = {}
        for at in range(0, len(parts), 4000):
            some = parts[at : at + 4000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                raw, edge = ids.tobytes(), [0, *(4 * cuts).tolist()]
                got.update(zip(some, [raw[a:b] for a, b in zip(edge, edge[1:], strict=False)], strict=True))
            else:
                got.update((x, self._whole(x)) for x in some)
        for x, own in split.items():
            if own != [x]:
                got[x] = b"".join([got[y] if y in got else self._whole(y) for y in own])
        if len(self.known) + len(got) > MEMO:
            self.known.clear()
        self.known.update(got)

    def ids(self, blobs: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        out: list = []
        missed: list[tuple[int, list[str], list[int]]] = []
        for i, blob in enumerate(blobs):
            text = blob.decode()
            if "<|" in text:
                out.append([self._whole(text)])
                continue
            if not text.isascii():  # a capital sigma is lowered without regard to its place
                text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
            text = text.lower()
            if "'" not in text and not _OTHER.search(text):
                text = _PUNCTUATION.sub(r" \g<0> ", text)
            pieces = _SPACE.split(text) if _ODD_SPACE.search(text) else text.split()
            found = list(map(self.known.get, pieces))
            if None in found:
                missed.append((i, pieces, [k for k, v in enumerate(found) if v is None]))
            out.append(found)
        if missed:
            self._learn({pieces[k] for _, pieces, at in missed for k in at})
            for i, pieces, at in missed:
                for k in at:
                    out[i][k] = self.known[pieces[k]]
        return [b"".join(x) for x in out]


_PUNCTUATION = re.compile(r"[!-&(-/:-@\[-`{-~]+")
#: Characters that are neither ASCII nor letters or numbers; ASCII control characters.
_OTHER = re.compile(r"[^\w\x20-\x7e\t\n\r\x0b\x0c]")
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: What str.split() cuts at beyond ASCII white space.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree that finds the tightest fit."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.used = bytearray(2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, window: int, left: int) -> None:
        self.stacks[left].append(window)
        node, used = self.leaves + left, self.used
        while node and not used[node]:
            used[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(window, what it has left) of the least capacity of at least `need`; None if there is none."""
        node, used = self.leaves + need, self.used
        if not used[node]:
            while node > 1 and not (node % 2 == 0 and used[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if used[2 * node] else 2 * node + 1
        left = node - self.leaves
        window = self.stacks[left].pop()
        if not self.stacks[left]:
            while node and used[node]:
                used[node] = 0
                node >>= 1
                if node and (used[2 * node] or used[2 * node + 1]):
                    break
        return window, left


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """(window, offset) of each length, given longest first."""
    opened, windows, offsets, n = OpenWindows(capacity), [], [], 0
    for need in lengths:
        found = opened.take(need)
        window, left = (n, capacity) if found is None else found
        n += found is None
        windows.append(window)
        offsets.append(capacity - left)
        if left > need:
            opened.add(window, left - need)
    return windows, offsets


def pieces(docs: DataFrame, path: str, shards: int, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Full windows with their sequence, and the remaining pieces with the shard that packs them."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encoder, task, dealt, full = word_encoder(path), TaskContext.get().partitionId(), 0, 0
        for part, texts in bytekit.batches_of_texts(batches):
            rows = []
            for doc_id, found in zip(part.column(0).to_pylist(), encoder.ids(texts.blobs), strict=True):
                ids = memoryview(found + end)
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    size = min(capacity, n - start)
                    check = zlib.crc32(ids[4 * start : 4 * (start + size)])
                    if size == capacity:
                        rows.append((doc_id, start, size, check, n, None, (1 << 62) + (task << 32) + full, 0))
                        full += 1
                    else:
                        rows.append((doc_id, start, size, check, n, (task * 7919 + dealt) % shards, None, None))
                        dealt += 1
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_COLUMNS)

    return docs.select("doc_id", "text").mapInArrow(cut, ", ".join(f"{c} long" for c in _COLUMNS))


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "shard", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, shard_pieces: int = SHARD) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    shards = max(1, -(-docs.count() // shard_pieces))
    cut = staged(pieces(docs, path, shards, capacity, end_id), "pieces")

    out = [c for c in _COLUMNS if c != "shard"]

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        windows, offsets = best_fit(group["length"].to_pylist(), capacity)
        sequence = np.array(windows, np.int64) + (group["shard"][0].as_py() << 32)
        return group.set_column(group.schema.get_field_index("sequence_id"), "sequence_id", pa.array(sequence)).set_column(group.schema.get_field_index("offset"), "offset", pa.array(offsets, pa.int64())).select(out)

    rest = cut.where("shard is not null").groupBy("shard").applyInArrow(packed, ", ".join(f"{c} long" for c in out))
    return cut.where("shard is null").select(*out).unionByName(rest)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
