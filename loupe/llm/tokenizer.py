"""Encoding with a public byte-level BPE vocabulary (problem 7).

Two tiers.  A text is cut into pre-tokens by the vocabulary's pattern.

1. A minimal perfect hash over the vocabulary resolves a pre-token that is itself
   a token: one table lookup and one comparison, whatever the vocabulary's size.
2. Other pre-tokens are merged from bytes: the bytes form a linked list, the
   ranks of neighbouring pairs lie in a heap, and the lowest rank (leftmost of
   equals) is merged until no pair is in the vocabulary.  That is O(n log n) for
   a pre-token of n bytes, so that a text without any boundary is no problem.

Within a batch each different pre-token is resolved once.

The vocabulary is read by every Python worker from its file, whose path is a
parameter and must exist on all machines; nothing of it is kept here.
"""

from __future__ import annotations

import base64
import heapq
import os
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from loupe.session import ship_code

VOCABULARY_DIR = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: How the byte-level vocabularies' texts are cut; fixed by the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens resolved before, by worker; the oldest half goes when it is full.
REMEMBERED = 200_000


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace.

    Keys are thrown into about n / 3 buckets; bucket by bucket, the largest first,
    a seed is searched under which all its keys fall on free places of a table of
    exactly n places.  A lookup hashes twice and compares once, since strings
    outside the set fall on some place too.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        groups: dict[int, list[int]] = {}
        for k, key in enumerate(keys):
            groups.setdefault(xxhash.xxh3_64_intdigest(key) % self.buckets, []).append(k)
        self.seeds = [0] * self.buckets
        place_key: list[bytes | None] = [None] * n
        self.values = [0] * n
        free = 0
        for bucket, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(members) == 1:
                # single keys take the free places in order: a negative seed names the place
                while place_key[free] is not None:
                    free += 1
                self.seeds[bucket] = -free - 1
                place_key[free], self.values[free] = keys[members[0]], values[members[0]]
                continue
            seed = 1
            while True:
                places = [xxhash.xxh3_64_intdigest(keys[k], seed) % n for k in members]
                if len(set(places)) == len(places) and all(place_key[p] is None for p in places):
                    break
                seed += 1
            self.seeds[bucket] = seed
            for k, p in zip(members, places):
                place_key[p], self.values[p] = keys[k], values[k]
        self.keys = place_key

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        if not self.n:
            return -1
        seed = self.seeds[xxhash.xxh3_64_intdigest(key) % self.buckets]
        place = -seed - 1 if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % self.n
        return self.values[place] if self.keys[place] == key else -1


class ByteBPE:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            parts = [line.split() for line in lines if line.strip()]
        keys, values = [base64.b64decode(p[0]) for p in parts], [int(p[1]) for p in parts]
        self.whole = PerfectHash(keys, values)
        self.bytes_of = dict(zip(values, keys))
        self.single = [self.whole.get(bytes([b])) for b in range(256)]
        if min(self.single) < 0:
            raise ValueError(f"{path}: not every byte is a token")
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def _merge(self, data: bytes) -> tuple[int, ...]:
        """Tokens of a pre-token that is none itself."""
        n = len(data)
        get = self.whole.get
        end = list(range(1, n + 1))  # end of the piece that starts here; 0: no piece starts here
        before = list(range(-1, n - 1))  # start of the piece to the left
        heap = []
        for i in range(n - 1):
            if (rank := get(data[i : i + 2])) >= 0:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            # outdated: a piece of the pair has been merged since
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (rank := get(data[i : end[stop]])) >= 0:
                    heapq.heappush(heap, (rank, i, end[stop]))
            if (left := before[i]) >= 0:
                if (rank := get(data[left:stop])) >= 0:
                    heapq.heappush(heap, (rank, left, stop))
        out, i = [], 0
        while i < n:
            out.append(get(data[i : end[i]]))
            i = end[i]
        return tuple(out)

    def pieces(self, text: str) -> list[str]:
        return self.cut(text)

    def ids_of(self, piece: str) -> tuple[int, ...]:
        """Token ids of one pre-token."""
        found = self.known.get(piece)
        if found is None:
            data = piece.encode("utf-8", "replace")
            whole = self.whole.get(data)
            found = (whole,) if whole >= 0 else self._merge(data)
            if len(self.known) >= REMEMBERED:
                for old in list(self.known)[: REMEMBERED // 2]:
                    del self.known[old]
            self.known[sys.intern(piece) if len(piece) < 20 else piece] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known, ids_of = self.known, self.ids_of
        for piece in self.cut(text) if text else ():
            out += known.get(piece) or ids_of(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")

    def count(self, text: str) -> int:
        return sum(map(len, map(self.ids_of, self.cut(text))))


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBPE:
    """The vocabulary of a file, built once per process."""
    return ByteBPE(path)


def vocabulary(name: str = BYTE_BPE, folder: str | None = None) -> str:
    return os.path.join(folder or VOCABULARY_DIR, name)


def encode_column(rows: DataFrame, text: str = "text", *, keep: list[str], path: str, out: str = "ids") -> DataFrame:
    """The columns ``keep`` of ``rows`` and ``out``, the token ids of ``text``.

    The list is empty for an empty or null text.  Texts of any length are encoded
    whole; no special tokens are added, and their strings in a text are ordinary
    text.  One output row per input row, repeated rows and null keys included;
    only the columns named are read.  No shuffle: rows stay where they are.
    """
    ship_code(rows.sparkSession)
    slim = rows.select(*(F.col(c) for c in keep), F.col(text).cast("string").alias("__text"))
    schema = StructType([*slim.drop("__text").schema.fields, StructField(out, ArrayType(IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lists = [np.asarray(bpe.encode(t), dtype=np.int32) for t in texts]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*keep, out])

    return slim.mapInArrow(encode, schema)


def decode_column(rows: DataFrame, ids: str = "ids", *, keep: list[str], path: str | None = None, out: str = "text") -> DataFrame:
    """The columns ``keep`` of ``rows`` and ``out``, the text that the token ids stand for; empty for an empty or null list."""
    ship_code(rows.sparkSession)
    path = path or vocabulary()
    slim = rows.select(*(F.col(c) for c in keep), F.col(ids).alias("__ids"))
    schema = StructType([*slim.drop("__ids").schema.fields, StructField(out, StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, out])

    return slim.mapInArrow(decode, schema)


def encode_documents(documents: DataFrame, *, path: str | None = None) -> DataFrame:
    """(``doc_id``, ``ids``) of every document's ``text`` by the 50k byte-level BPE."""
    return encode_column(documents, "text", keep=["doc_id"], path=path or vocabulary())
