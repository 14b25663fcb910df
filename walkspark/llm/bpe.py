"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of parts. Adjacent pairs that join to a vocabulary entry wait in
buckets, one per merge rank, that hold list positions. A two-level bitmap marks the ranks whose
bucket isn't empty, so find-first-set names the next rank in constant time, whatever the length of
the pre-token; entries whose pair has changed since are stale and skipped when they come up.
Texts are encoded where they lie: no shuffle, one Arrow batch in memory at a time.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from walkspark.llm.common import PIECE_ROWS, lean

BITS = 8
SHIFT = 32
#: Words whose ids each Python worker remembers (up to twice as many between clearings), and the longest that it remembers.
REMEMBERED, LONGEST = 400_000, 64
#: Words that it still remembers when its task has ended, so that idle workers are small.
KEPT = 100_000
#: Unicode white space (fixed values).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word with the blank before it, or a run of white space as the pattern cuts it: no match crosses these,
#: so that whole words can be remembered.
CHUNKS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.words = [0] * ((max(ranks.values()) >> BITS) + 1)  # lower level of the bitmap; all zero between calls
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: The rank that two parts join to, under (left << SHIFT) | right; a part goes by its own rank.
        self.joins = {(ranks[t[:i]] << SHIFT) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.bytes = np.array([ranks.get(bytes([c]), -1) for c in range(256)], np.int64)
        self.first = np.array([self.joins.get((int(a) << SHIFT) | int(b), -1) for a in self.bytes for b in self.bytes], np.int64)  # of two bytes

    def merges(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens of any length; all stand in one list, and no pair crosses an end.

        Queue operations stand in line: calls would double the time.
        """
        get, words, mask = self.joins.get, self.words, (1 << BITS) - 1
        raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        n = len(raw)
        parts = self.bytes[raw].tolist()
        starts = np.cumsum([0, *map(len, pieces)])
        wait = np.full(n, -1, np.int64)  # the rank at which the pair that starts here waits
        wait[:-1] = self.first[raw[:-1] * 256 + raw[1:]]
        wait[starts[1:] - 1] = -1
        ends = bytearray(n + 1)  # 1 where a pre-token starts
        for at in starts.tolist():
            ends[at] = 1
        order = np.argsort(wait, kind="stable")[np.count_nonzero(wait < 0) :]
        cuts = np.r_[np.flatnonzero(np.diff(wait[order], prepend=-1)), len(order)].tolist()
        top, buckets, places = 0, {}, order.tolist()
        waits = wait.tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rank = waits[places[lo]]
            buckets[rank] = places[lo:hi]
            words[rank >> BITS] |= 1 << (rank & mask)
            top |= 1 << (rank >> BITS)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while top:
            word = (top & -top).bit_length() - 1  # find first set, on both levels
            bits = words[word]
            low = bits & -bits
            rank = (word << BITS) + low.bit_length() - 1
            bucket = buckets.pop(rank)
            words[word] = bits ^ low
            if bits == low:
                top &= top - 1
            bucket.sort()
            left = rank << SHIFT
            for spent, i in enumerate(bucket, 1):
                if waits[i] != rank:  # stale: the pair has changed since
                    continue
                j = after[i]
                parts[i] = rank
                waits[j] = -1
                after[i] = k = after[j]
                first = rank
                if ends[k]:
                    waits[i] = -1
                    if k < n:
                        before[k] = i
                else:
                    before[k] = i
                    r = get(left | parts[k])
                    if r is None:
                        waits[i] = -1
                    else:
                        waits[i] = r
                        if (more := buckets.get(r)) is not None:
                            more.append(i)
                        else:
                            buckets[r] = [i]
                            words[r >> BITS] |= 1 << (r & mask)
                            top |= 1 << (r >> BITS)
                        if r < first:
                            first = r
                if not ends[i]:
                    h = before[i]
                    r = get((parts[h] << SHIFT) | rank)
                    if r is None:
                        waits[h] = -1
                    else:
                        waits[h] = r
                        if (more := buckets.get(r)) is not None:
                            more.append(h)
                        else:
                            buckets[r] = [h]
                            words[r >> BITS] |= 1 << (r & mask)
                            top |= 1 << (r >> BITS)
                        if r < first:
                            first = r
                if first < rank and spent < len(bucket):  # a lower rank has come up: it goes first, the rest of the bucket waits
                    buckets[rank] = buckets.get(rank, []) + bucket[spent:]
                    words[word] |= low
                    top |= 1 << word
                    break
        out, i = [], 0
        for end in starts[1:].tolist():
            ids = []
            while i < end:
                ids.append(parts[i])
                i = after[i]
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        chunks = [CHUNKS(t) if t else [] for t in texts]
        known, older = self.known, self.older
        new = set().union(*chunks).difference(known)
        for chunk in new & older.keys():
            known[chunk] = older[chunk]
        new = [c for c in new if c not in known]
        pieces = [self.pieces(c) for c in new]
        tokens = {p: self.ranks.get(p.encode()) for c in pieces for p in c}
        ids, rest = {}, []
        for p, rank in tokens.items():
            if rank is not None:
                ids[p] = rank.to_bytes(4, "little")
            elif found := known.get(p) or older.get(p):
                ids[p] = found
            else:
                rest.append(p)
        for lo in range(0, len(rest), 4096):
            some = rest[lo : lo + 4096]
            for p, merged in zip(some, self.merges([p.encode() for p in some])):
                ids[p] = struct.pack(f"<{len(merged)}I", *merged)
        for chunk, parts in zip(new, pieces):
            known[chunk] = b"".join([ids[p] for p in parts])
        out = [b"".join([known[c] for c in text]) for text in chunks]
        for chunk in new:
            if len(chunk) > LONGEST:
                del known[chunk]
        if len(known) > REMEMBERED:
            self.known, self.older = {}, known
        return out


    def settle(self) -> None:
        """Forget all but KEPT words: those that were met first since the last clearing, as frequent words are."""
        known = {**self.known, **self.older} if len(self.known) < KEPT else self.known
        self.known, self.older = dict(islice(known.items(), KEPT)), {}


@lru_cache(2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


@lru_cache(2)
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all tokens' bytes, where each id's start, how many they are)."""
    tokens = {rank: token for token, rank in read_ranks(path).items()}
    every = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    lengths = np.array([len(x) for x in every])
    return np.frombuffer(b"".join(every), np.uint8), np.cumsum(lengths) - lengths, lengths


def decoded(ids: list[bytes], path: str) -> list[bytes]:
    """The bytes of each row of ids, looked up together."""
    every, starts, lengths = _vocabulary(path)
    tokens = np.frombuffer(b"".join(ids), "<u4")
    sizes = lengths[tokens]
    ends = np.cumsum(sizes)
    whole = every[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[tokens] - (ends - sizes), sizes)].tobytes()
    cuts = np.r_[0, ends][np.cumsum([0, *[len(x) // 4 for x in ids]])].tolist()
    return [whole[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:])]


def _with_columns(df: DataFrame, drop: list[str], made: str) -> str:
    kept = [f for f in df.schema.fields if f.name not in drop]
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [made])


def _add(batch: pa.RecordBatch, drop: list[str], made: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in drop}
    return pa.RecordBatch.from_pydict(kept | made)


def encode(df: DataFrame, text: str = "text", ranks_path: str | None = None, pattern: str | None = None, decoding: bool = False) -> DataFrame:
    """df without its text, with `ids` (binary: little-endian unsigned 32-bit token ids) and `n_tokens`.

    decoding: with `decoded` too, as decode() adds it, by the same worker. Null counts as empty: no ids. Special tokens
    aren't recognised. Any length of text; equal rows get equal ids; columns of df named as those that are made are replaced.
    The rank file must be at ranks_path on every worker.
    """
    import public_tokenizers

    path, pat, made = ranks_path or default_ranks_path(), pattern or public_tokenizers.PATTERN, ["ids", "n_tokens", *["decoded"] * decoding]
    gone = [*made, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pat)
        try:
            for part in batches:
                ids = encoder.encode(part.column(text).to_pylist())
                new = {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
                yield _add(part, gone, new | ({"decoded": pa.array(decoded(ids, path), pa.binary())} if decoding else {}))
        finally:
            encoder.settle()

    df = df.drop(*made)
    return df.mapInArrow(lean(run, PIECE_ROWS), _with_columns(df, gone, "ids binary, n_tokens long" + ", decoded binary" * decoding))


def decode(df: DataFrame, ids: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """df with `decoded` (binary): the bytes of `ids`, which stays; null ids decode to nothing.

    An id outside the vocabulary raises IndexError: it can't come from encode()."""
    path = ranks_path or default_ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = decoded([x or b"" for x in part.column(ids).to_pylist()], path)
            yield _add(part, ["decoded"], {"decoded": pa.array(texts, pa.binary())})

    df = df.drop("decoded")
    return df.mapInArrow(lean(run, PIECE_ROWS), _with_columns(df, ["decoded"], "decoded binary"))
