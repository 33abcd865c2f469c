"""Byte-level BPE by merge replay over the distinct words of a chunk of the corpus.

An inverted index holds, for each rank, the places in all words where that merge applies; ranks are
replayed in order, and a merge touches only its two neighbours. A merge may create a pair of a rank at or below the one at hand; the word's other
places then wait in the index, so every word is merged in the order of the tiktoken library: lowest rank first, leftmost of those.

Each task replays the words that it has not met before, chunk by chunk, and remembers their ids up to a bound: no shuffle, no table of words.

Defined results: a null or empty text has no ids, and both hashes are of empty input; null ids and repeated rows pass through; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.shipping import ship

CHUNK_CHARS = 1 << 20
REMEMBERED = 200_000
REPLAYED = 1000  # words in one index: few enough to stay in the processor's caches
SPACE = r"\t-\r \x85\xa0  -     　"
ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@lru_cache
def _ranges(kind: str, end: int) -> str:
    """A regex class body of all code points below end whose general category starts with kind."""
    out, start = [], None
    for c in range(end + 1):
        inside = c < end and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


#: The pattern that splitter() spells out; another one must be refused.
SPELT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache
def splitter(astral: bool) -> re.Pattern:
    """The tokenizer's pattern with its classes spelt out; texts of the basic plane use smaller, faster classes."""
    end = sys.maxunicode + 1 if astral else 0x10000
    letter, number = _ranges("L", end), _ranges("N", end)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def pieces(text: str) -> list[str]:
    return splitter(bool(ASTRAL.search(text))).findall(text)


class Codec:
    """Ranks are ids: a merge of rank r makes token r."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.text_of = {r: str(r) for r in self.bytes_of}
        get = self.ranks.get
        #: (left id, right id) as one number -> rank of the merge
        self.merges = {
            x << 20 | y: r for b, r in self.ranks.items() for i in range(1, len(b)) if (x := get(b[:i])) is not None and (y := get(b[i:])) is not None
        }
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.byte_pair = np.array([self.merges.get(int(x) << 20 | int(y), -1) for x in self.byte_id for y in self.byte_id], np.int64)

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word."""
        out: list = [None] * len(words)
        rest = []
        for w, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[w] = (whole,)
            elif word:
                rest.append(w)
            else:
                out[w] = ()
        if not rest:
            return out
        # Places of all words in a row: the token at a place, its neighbours, and the rank of the pair that starts there.
        data = np.frombuffer(b"".join([words[w] for w in rest]), np.uint8).astype(np.int64)
        sizes = np.array([len(words[w]) for w in rest])
        ends = np.cumsum(sizes)
        token = self.byte_id[data].tolist()
        follow, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        follow[ends - 1] = -1
        before[ends - sizes] = -1
        pair = np.append(self.byte_pair[data[:-1] * 256 + data[1:]], -1)
        pair[ends - 1] = -1
        places = np.argsort(pair, kind="stable")
        places = places[np.searchsorted(pair[places], 0) :]
        found, first = np.unique(pair[places], return_index=True)
        index = {r: p.tolist() for r, p in zip(found.tolist(), np.split(places, first[1:]), strict=True)} if len(found) else {}
        word_of = np.repeat(np.arange(len(rest)), sizes).tolist()
        follow, before, pair = follow.tolist(), before.tolist(), pair.tolist()
        merge, queue = self.merges.get, list(index)
        heapq.heapify(queue)

        def note(r: int, p: int) -> None:
            if r in index:
                index[r].append(p)
            else:
                index[r] = [p]
                heapq.heappush(queue, r)

        while queue:
            r = heapq.heappop(queue)
            waiting = -1
            for p in sorted(index.pop(r)):
                if pair[p] != r:
                    continue
                if word_of[p] == waiting:
                    note(r, p)
                    continue
                q = follow[p]
                n = follow[p] = follow[q]
                token[p], pair[q] = r, -1
                low = -1
                if n >= 0:
                    before[n] = p
                    low = merge(r << 20 | token[n], -1)
                    if low >= 0:
                        note(low, p)
                        if low <= r:
                            waiting = word_of[p]
                pair[p] = low
                b = before[p]
                if b >= 0:
                    low = pair[b] = merge(token[b] << 20 | r, -1)
                    if low >= 0:
                        note(low, b)
                        if low <= r:
                            waiting = word_of[p]
        for w, p in zip(rest, (ends - sizes).tolist(), strict=True):
            ids = []
            while p >= 0:
                ids.append(token[p])
                p = follow[p]
            out[w] = tuple(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Encoder:
    """A codec with the ids of remembered words, for one task."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        split = [pieces(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set(chain.from_iterable(split)).difference(self.known))
        for i in range(0, len(new), REPLAYED):
            part = new[i : i + REPLAYED]
            self.known.update(zip(part, self.codec.replay([w.encode("utf-8", "replace") for w in part]), strict=True))
        get = self.known.__getitem__
        for s in split:
            yield list(chain.from_iterable(map(get, s)))


@lru_cache(maxsize=1)
def worker_codec(path: str) -> Codec:
    """One for each Python worker, of the vocabulary's size; remembered words go with their task, so that they take no memory from later stages."""
    return Codec(path)


def _chunks(texts: list[str | None]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for t in texts:
        chunk.append(t or "")
        size += len(chunk[-1])
        if size >= CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, pattern: str = SPELT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if wanted. vocabulary: a rank file that all executors can open; pattern: the one that goes with it."""
    if pattern != SPELT:
        raise ValueError("the vocabulary goes with another pattern")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(vocabulary)
        encoder = Encoder(codec)
        for b in batches:
            key, at = b.column(0), 0
            for chunk in _chunks(b.column(1).to_pylist()):
                n, id_sums, sums, tokens = [], [], [], []
                for found in encoder.encode(chunk):
                    n.append(len(found))
                    id_sums.append(hashlib.sha256(",".join(map(codec.text_of.__getitem__, found)).encode()).hexdigest())
                    sums.append(hashlib.sha256(codec.decode(found)).hexdigest())
                    if ids:
                        tokens.append(found)
                columns = [key.slice(at, len(chunk)), pa.array(n, pa.int64()), pa.array(id_sums, pa.string()), pa.array(sums, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns, names = [*columns, pa.array(tokens, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(chunk)

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
