"""Token ids of whole texts by a public byte-level BPE vocabulary (problem 7).

A text is cut into words by the vocabulary's pattern, and each word's bytes are merged by rank.  A
short word is one contiguous array: part boundaries with, beside each, the rank of the pair it
starts.  The smallest rank is found by a scan of the array, its inner boundary deleted and the two
neighbouring ranks refreshed, until no pair has a rank.  Scans are quadratic in a word's length, so
words over ``SHORT`` bytes (unbroken runs of letters or signs) take a heap over the same ranks.
Words repeat much, so every worker keeps the ids of words it has met, up to a bounded number.
"""

from __future__ import annotations

import base64
import heapq
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies lie.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the word pattern of the 50k byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 128
CACHED_WORDS = 200_000
NO_RANK = 1 << 30

class BytePairEncoder:
    """Encodes by a vocabulary of byte strings and ranks; a token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.words = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    @classmethod
    def from_bytes(cls, raw: bytes) -> BytePairEncoder:
        return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)})

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings that look like special tokens are ordinary text."""
        out: list[int] = []
        known = self.known
        for word in self.words(text):
            ids = known.get(word)
            if ids is None:
                ids = self.encode_word(word.encode("utf-8", "surrogatepass"))
                if len(word) <= SHORT:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    known[word] = ids
            out += ids
        return out

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        ends = self._merge_short(word) if len(word) <= SHORT else self._merge_long(word)
        return [self.ranks[word[a:b]] for a, b in zip(ends, ends[1:])]

    def _merge_short(self, word: bytes) -> list[int]:
        """Boundaries of a word's tokens, from a contiguous array of ranks."""
        rank = self.ranks.get
        bounds = list(range(len(word) + 1))
        near = [rank(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
        while near:
            least = min(near)
            if least == NO_RANK:
                break
            i = near.index(least)
            del bounds[i + 1], near[i]
            if i < len(near):
                near[i] = rank(word[bounds[i] : bounds[i + 2]], NO_RANK)
            if i:
                near[i - 1] = rank(word[bounds[i - 1] : bounds[i + 1]], NO_RANK)
        return bounds

    def _merge_long(self, word: bytes) -> list[int]:
        """The same boundaries by a heap of pairs over a linked list of parts."""
        n = len(word)
        rank = self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\x01" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or after[j] != end:
                continue
            alive[j] = 0
            after[i] = end
            if end < n:
                before[end] = i
                if (r := rank(word[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if before[i] >= 0 and (r := rank(word[before[i] : end])) is not None:
                heapq.heappush(heap, (r, before[i], end))
        out, i = [0], 0
        while i < n:
            i = after[i]
            out.append(i)
        return out


def encoder_of(shipped) -> BytePairEncoder:
    """This worker process's encoder of a broadcast vocabulary file.  It is kept on ``sys``, because the
    functions of a task, their globals with them, are unpickled anew for every task."""
    key = hash(shipped.value)
    kept = getattr(sys, "_pixelloom_encoder", None)
    if kept is None or kept[0] != key:
        kept = sys._pixelloom_encoder = (key, BytePairEncoder.from_bytes(shipped.value))
    return kept[1]


def _spread(df: DataFrame) -> DataFrame:
    """At least as many partitions as cores: encoding costs far more than moving a text."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def _ship(spark: SparkSession, vocabulary: str):
    # A vocabulary file is some hundred kB, whatever the corpus.
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_texts(documents: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(ident, ids array<int>) for every row, over the whole text; an empty list for an empty and for
    a NULL text.  A NULL ident and repeated rows stay as they are."""
    shipped = _ship(documents.sparkSession, vocabulary)
    d = documents.select(F.col(ident).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(shipped).encode
        for batch in batches:
            for part in _pieces(batch):
                ids, ends = array("i"), [0]
                for t in part.column(1).to_pylist():
                    if t:
                        ids.extend(encode(t))
                    ends.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "ids"])

    return _spread(d).mapInArrow(run, "id bigint, ids array<int>").withColumnRenamed("id", ident)


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Columns ``keep`` with n_tokens bigint, the number of ids of :func:`encode_texts`."""
    shipped = _ship(documents.sparkSession, vocabulary)
    d = documents.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = d.drop("_text").withColumn("n_tokens", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(shipped).encode
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    return _spread(d).mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch, rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Small batches, so that very long texts don't add up to one huge list of ids."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
