"""Byte-level BPE over a public rank file, with a rank queue on a hierarchical bitmap.

Every match of the split pattern is encoded by itself. Pairs wait in buckets, one for each merge rank, which hold
positions of a linked list; a two-level bitmap marks the buckets in use, and finding its first set bit gives the next
rank. An entry whose pair has changed meanwhile is stale and skipped. A text of n bytes in one match takes time in
proportion to n log n.

Null and empty texts have no tokens. Special tokens are ordinary text. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import math
from functools import lru_cache
from heapq import heappop, heappush

import regex
from pyspark.sql import DataFrame

from evenhand.llm.common import field, text_map

#: Matches whose ids are remembered in each worker (twice as many at most), and the longest of them: bounds on memory.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 32
#: Bytes of a match up to which a bucket is one integer with a bit for each position.
SHORT = 64


class RankQueue:
    """Least rank first, leftmost position first among equals."""

    def __init__(self, size: int) -> None:
        self.width = math.isqrt(max(1, size)) + 1
        self.top = 0
        self.words = [0] * self.width
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word, bit = divmod(rank, self.width)
        self.words[word] |= 1 << bit
        self.top |= 1 << word

    def pop(self) -> tuple[int, int]:
        top = self.top
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        rank = word * self.width + low.bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.words[word] = bits = bits ^ low
            if not bits:
                self.top = top & (top - 1)
        return rank, position


class Encoder:
    """Encodes and decodes by the ranks in a file of base64 byte strings and their ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.pattern = path, pattern
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * self.size
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.decimal = [str(i) for i in range(self.size)]
        self.split = regex.compile(pattern)
        self.queue = RankQueue(self.size)
        self.word_of = [r // self.queue.width for r in range(self.size)]
        self.bit_of = [1 << r % self.queue.width for r in range(self.size)]
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one match."""
        ranks, queue = self.ranks, self.queue
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        if n <= SHORT:
            return self.merge_short(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n  # rank of the pair that begins here now
        get, push, pop = ranks.get, queue.push, queue.pop
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                push(rank, i)
        while queue.top:
            rank, i = pop()
            if pair[i] != rank:
                continue
            j = after[i]
            k = after[j]
            after[i] = k
            pair[j] = -1
            if k < n:
                before[k] = i
                rank = get(piece[i : after[k]])
                if rank is None:
                    pair[i] = -1
                else:
                    pair[i] = rank
                    push(rank, i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                rank = get(piece[h:k])
                if rank is None:
                    pair[h] = -1
                elif pair[h] != rank:
                    pair[h] = rank
                    push(rank, h)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(ids)

    def merge_short(self, piece: bytes) -> tuple[int, ...]:
        """The same for a short match: buckets are integers, whose first set bit is the leftmost position."""
        get, words, width, word_of, bit_of = self.ranks.get, self.queue.words, self.queue.width, self.word_of, self.bit_of
        n, top, buckets = len(piece), 0, {}
        after, before, pair = list(range(1, n + 2)), list(range(-1, n)), [-1] * (n + 1)
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                if rank in buckets:
                    buckets[rank] |= 1 << i
                else:
                    buckets[rank] = 1 << i
                    words[word_of[rank]] |= bit_of[rank]
                    top |= 1 << word_of[rank]
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = word * width + low.bit_length() - 1
            bucket = buckets[rank]
            first = bucket & -bucket
            if bucket == first:
                del buckets[rank]
                words[word] = bits ^ low
                if bits == low:
                    top &= top - 1
            else:
                buckets[rank] = bucket ^ first
            i = first.bit_length() - 1
            if pair[i] != rank:
                continue
            j = after[i]
            k = after[j]
            after[i] = k
            before[k] = i
            pair[j] = pair[i] = -1
            h = before[i]
            for a, b in ((i, after[k]), (h, k)) if k < n else ((h, k),):
                if a < 0:
                    continue
                rank = get(piece[a:b])
                if rank is None:
                    pair[a] = -1
                elif pair[a] != rank:
                    pair[a] = rank
                    if rank in buckets:
                        buckets[rank] |= 1 << a
                    else:
                        buckets[rank] = 1 << a
                        words[word_of[rank]] |= bit_of[rank]
                        top |= 1 << word_of[rank]
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        known, ids = self.known, []
        add = ids.extend
        for match in self.split.findall(text or ""):
            got = known.get(match)
            if got is None:
                got = self.older.get(match)
                if got is None:
                    got = self.merge(match.encode("utf-8", "replace"))
                if len(match) <= REMEMBERED_LENGTH:
                    if len(known) >= REMEMBERED:  # what was used since the last change of generations stays known
                        self.older, self.known = known, {}
                        known = self.known
                    known[match] = got
            add(got)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process and rank file."""
    return Encoder(path, pattern)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``ids``, the token ids of the whole text."""
    path, pattern = path or default_path(), pattern or default_pattern()
    return text_map(docs, text_col, list(keep), [field("ids", "array<int>")], lambda texts: [list(map(encoder(path, pattern).encode, texts))])


def decode_documents(encoded: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``decoded``, the bytes that the ids stand for (none for null)."""
    path, pattern = path or default_path(), pattern or default_pattern()
    return text_map(encoded, ids_col, list(keep), [field("decoded", "binary")], lambda rows: [[encoder(path, pattern).decode(r or []) for r in rows]])


def round_trip(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, pattern: str | None = None) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each whole text: encoded, then decoded again from the ids.

    The ids are digested where they are made, so that they need not leave the worker.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(texts: list) -> list[list]:
        own = encoder(path, pattern)
        counts, encoded, decoded = [], [], []
        for text in texts:
            ids = own.encode(text)
            counts.append(len(ids))
            encoded.append(hashlib.sha256(" ".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return [counts, encoded, decoded]

    return text_map(docs, text_col, list(keep), [field("n_tokens", "bigint"), field("ids_sha256", "string"), field("decoded_sha256", "string")], run)
