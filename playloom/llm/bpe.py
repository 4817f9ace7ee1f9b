"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is split by the tokenizer's pattern. A pre-token that is not in the
vocabulary is merged pair by pair, lowest rank first, leftmost first on ties.
The bytes form a linked list; each rank has a bucket with the positions where a
pair of that rank began, and a two-level bitmap of wide words tells by
find-first-set which non-empty bucket comes next. Positions whose pair has
changed meanwhile are stale and skipped. Finding the next merge costs the same
for a pre-token of five bytes as for one of a million. Many pre-tokens share
one list and one queue, so a bucket is found once for all of them; a merge that
makes a pair of lower rank puts the rest of its bucket back.

Pre-tokens of at most ``SHORT`` bytes, nearly all, have a queue whose buckets
hold blocks of ``2**BLOCK`` ranks. Pre-tokens do not touch each other, so of the
lowest block each takes its lowest and leftmost pair, all of them in one step on
arrays, and the rest of the block goes back (the blocks of 50,000 ranks fill one
word of the bitmap). Longer ones have a bucket a rank.

Scale: a scan without a shuffle, on Arrow batches; each worker loads the
vocabulary once (fixed size) and remembers the ids of blank-separated segments,
up to ``SEGMENTS_BYTES``. Decoding goes by the ids alone. Whole texts are
encoded, however long.

Defined results: null text counts as empty and has no tokens; repeated rows
agree; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from playloom.llm import words

#: Room of a worker's memory of segments.
SEGMENTS_BYTES = 120_000_000
#: Pre-tokens of so many bytes (at most 255) are merged together on arrays, about so many bytes of them at once, by buckets of 2**BLOCK ranks.
SHORT, TOGETHER_BYTES, BLOCK = 120, 1 << 16, 8
#: In place of a rank: no token has these bytes.
NONE = (1 << 24) - 1
PRODUCTION_VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def production_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PRODUCTION_VOCABULARY)


def production_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class RankQueue:
    """Buckets of positions by merge rank or block of ranks; find-first-set over a hierarchy of two bitmap levels.

    A word has 256 bits, so the vocabularies in use take some two hundred words
    and one word above them.
    """

    MASKS = [1 << k for k in range(256)]

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 8) + 1)
        self.high = 0
        self.buckets: dict[int, list] = {}

    def open(self, rank: int, positions: list) -> None:
        """A new bucket for a rank that has none; further positions are appended to it."""
        self.buckets[rank] = positions
        word = rank >> 8
        self.low[word] |= self.MASKS[rank & 255]
        self.high |= 1 << word

    def pop(self) -> tuple[int, list]:
        """(rank, positions) of the lowest rank. The queue must not be empty."""
        word = (self.high & -self.high).bit_length() - 1
        low = self.low[word]
        rest = low & (low - 1)
        rank = (word << 8) + (low ^ rest).bit_length() - 1
        self.low[word] = rest
        if not rest:
            self.high &= self.high - 1
        return rank, self.buckets.pop(rank)


#: Unicode white space, as the pattern's \\s means it.
_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run of non-blanks with the one space before it is a whole number of pre-tokens of the production pattern.
_SEGMENTS = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


class Memo(dict):
    """Values by key in two generations of half the ``room`` in bytes: what only the older one holds is forgotten with it."""

    def __init__(self, room: int):
        self.room, self.left, self.older = room // 2, room // 2, {}

    def tell(self, values: dict) -> None:
        self.left -= sum(map(len, values)) + sum(map(len, values.values())) + 210 * len(values)
        self.update(values)

    def rest(self) -> None:
        """Between batches: start a new generation if this one is full."""
        if self.left < 0:
            self.older = self.copy()
            self.clear()
            self.left = self.room

    def all(self, keys: list[list], tell) -> list[list]:
        """The values of lists of keys; ``tell`` gets the set of those that have none yet and must tell them."""
        missing = set(filterfalse(self.__contains__, set().union(*keys)))  # set methods would walk through the whole memory
        if missing:
            older = self.older
            kept = {k: older[k] for k in missing if k in older}
            self.tell(kept)
            missing.difference_update(kept)
            if missing:
                tell(missing)
        get = self.__getitem__
        return [list(map(get, own)) for own in keys]


class Codec:
    """Ranks of one vocabulary; ids are kept as decimal text, as the digests want them."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.bytes_of = {str(rank): token for token, rank in self.ranks.items()}
        self.rank_of_two = [self.ranks.get(bytes((a, b))) for a in range(256) for b in range(256)]
        self.decimal = {rank: str(rank) for rank in self.ranks.values()}
        self.find = regex.compile(pattern).findall
        size = max(self.ranks.values(), default=0) + 1
        assert size + 256 < NONE, "ranks must fit into 24 bits"
        self.queue, self.blocks = RankQueue(size), RankQueue((size >> BLOCK) + 1)
        self._number_pairs(size)
        self.segments = Memo(SEGMENTS_BYTES)
        self.split = _SEGMENTS.findall if pattern == production_pattern() else self.find

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token. All of them lie in one linked list, without pairs across their borders, and share the queue."""
        text, get, queue = b"".join(pieces), self.ranks.get, self.queue
        n, buckets = len(text), queue.buckets
        first = bytearray(n + 1)  # 1 where a pre-token starts
        first[n] = 1
        at = 0
        for piece in pieces:
            first[at] = 1
            at += len(piece)
        after = list(range(1, n + 2))  # where the part that starts here ends
        before = list(range(-1, n))  # where the part to the left starts
        two = self.rank_of_two
        pair = [None if border else two[a << 8 | b] for a, b, border in zip(text, text[1:] + b"\0", first[1:])]  # rank of the pair that starts here now
        begun: dict[int | None, list[int]] = defaultdict(list)
        for k, rank in enumerate(pair):
            begun[rank].append(k)
        begun.pop(None, None)
        for rank, positions in begun.items():
            queue.open(rank, positions)
        while queue.high:
            now, positions = queue.pop()
            positions.sort()
            for done, k in enumerate(positions, 1):
                if pair[k] != now:
                    continue  # stale
                gone = after[k]
                end = after[k] = after[gone]
                pair[gone] = None
                lowest = now
                rank = None
                if not first[end]:
                    before[end] = k
                    rank = get(text[k : after[end]])
                    if rank is not None:
                        if rank in buckets:
                            buckets[rank].append(k)
                        else:
                            queue.open(rank, [k])
                        lowest = min(lowest, rank)
                pair[k] = rank
                if not first[k]:
                    left = before[k]
                    rank = pair[left] = get(text[left:end])
                    if rank is not None:
                        if rank in buckets:
                            buckets[rank].append(left)
                        else:
                            queue.open(rank, [left])
                        lowest = min(lowest, rank)
                if lowest < now:  # that pair comes first
                    if done < len(positions):
                        queue.open(now, positions[done:])
                    break
        out, at = [], 0
        for piece in pieces:
            ids, k, at = [], at, at + len(piece)
            while k < at:
                end = after[k]
                ids.append(self.ranks[text[k:end]])
                k = end
            out.append(ids)
        return out

    def _number_pairs(self, size: int) -> None:
        """Tables for arrays: the token of each byte, the rank of each two bytes, and sorted pairs of tokens (left * base + right) that make a token."""
        ranks, self.base = self.ranks, size + 256
        one = {bytes((k,)): size + k for k in range(256)} | ranks  # a byte that is no token has a number of its own
        self.token_of_byte = np.array([one[bytes((k,))] for k in range(256)])
        self.two = np.array([NONE if rank is None else rank for rank in self.rank_of_two])
        made = {}
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                left, right = one.get(whole[:cut]), one.get(whole[cut:])
                if left is not None and right is not None:
                    made[left * self.base + right] = rank
        self.pairs = np.array(sorted(made), np.int64)
        self.made = np.array([made[pair] for pair in self.pairs.tolist()] + [NONE])
        self.pairs = np.append(self.pairs, np.iinfo(np.int64).max)

    def _put(self, keys: np.ndarray) -> None:
        """Keys (pre-token, rank, offset in it) into the buckets of their blocks of ranks."""
        block = (keys >> (8 + BLOCK)) & (NONE >> BLOCK)
        order = np.argsort(block, kind="stable")
        keys, block = keys[order], block[order]
        cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
        begins = [0, *cuts.tolist()]
        buckets = self.blocks.buckets
        for begin, end, own in zip(begins, [*begins[1:], len(keys)], block[begins].tolist()):
            if own in buckets:
                buckets[own].append(keys[begin:end])
            else:
                self.blocks.open(own, [keys[begin:end]])

    def merge_short(self, pieces: list[bytes]) -> list[list[int]]:
        """As ``merge``, for pre-tokens of at most SHORT bytes: each step merges one pair in every pre-token that has one in the lowest block."""
        text = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        n, queue = len(text), self.blocks
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.cumsum(sizes) - sizes
        first = np.zeros(n + 1, bool)  # where a pre-token starts
        first[start] = first[n] = True
        token = np.append(self.token_of_byte[text], 0)  # of the part that starts here
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        pair = np.full(n, NONE)  # rank of the pair that starts here now
        pair[:-1] = self.two[text[:-1] << 8 | text[1:]]
        pair[first[1:]] = NONE
        whole = np.ones(n, bool)  # a part starts here
        own = (np.repeat(np.arange(len(pieces)), sizes) << 32) + np.arange(n) - np.repeat(start, sizes)  # key without its rank
        begun = np.flatnonzero(pair != NONE)
        if len(begun):
            self._put(own[begun] + (pair[begun] << 8))
        while queue.high:
            block, found = queue.pop()
            keys = np.concatenate(found)
            keys.sort()
            piece = keys >> 32
            k = start[piece] + (keys & 255)
            live = pair[k] == (keys >> 8) & NONE
            keys, piece, k = keys[live], piece[live], k[live]
            if not len(k):
                continue
            lowest = np.ones(len(k), bool)
            lowest[1:] = piece[1:] != piece[:-1]
            if not lowest.all():
                queue.open(block, [keys[~lowest]])
                k = k[lowest]
            gone = after[k]
            end = after[gone]
            after[k] = end
            token[k] = pair[k]
            pair[k] = pair[gone] = NONE
            whole[gone] = False
            inner = ~first[end]
            right_of, right = k[inner], end[inner]
            before[right] = right_of
            inner = k[~first[k]]
            left = np.concatenate((right_of, before[inner]))
            ask = token[left] * self.base + token[np.concatenate((right, inner))]
            at = np.searchsorted(self.pairs, ask)
            known = self.pairs[at] == ask
            rank = pair[left] = np.where(known, self.made[at], NONE)
            if known.any():
                self._put(own[left[known]] + (rank[known] << 8))
        ids = token[:n][whole].tolist()
        ends = np.cumsum(whole)[start + sizes - 1].tolist()
        return [ids[begin:end] for begin, end in zip([0, *ends], ends)]

    def pieces(self, pieces: list[str]) -> list[str]:
        """Ids of each pre-token, decimal and joined by commas."""
        coded = [piece.encode() for piece in pieces]
        out = [self.decimal.get(rank) for rank in map(self.ranks.get, coded)]
        decimal = self.decimal.__getitem__
        short, size = [[]], 0
        for k, known in enumerate(out):
            if known is None:
                if len(coded[k]) > SHORT:
                    (ids,) = self.merge([coded[k]])
                    out[k] = ",".join(map(decimal, ids))
                else:
                    short[-1].append(k)
                    size += len(coded[k])
                    if size >= TOGETHER_BYTES:
                        short.append([])
                        size = 0
        for part in filter(None, short):
            for k, ids in zip(part, self.merge_short([coded[k] for k in part])):
                out[k] = ",".join(map(decimal, ids))
        return out

    def _learn_segments(self, segments: set[str]) -> None:
        alone = [s for s in segments if s[s[:1] == " " :].isalpha()]  # one pre-token each
        split = list(segments.difference(alone))
        found = list(map(self.find, split))
        parts = list(set(alone).union(*found))
        ids = dict(zip(parts, self.pieces(parts)))
        get = ids.__getitem__
        new = {s: ids[s] for s in alone}
        new |= {s: ",".join(map(get, own)) for s, own in zip(split, found)}
        self.segments.tell(new)

    def encode(self, texts: list[str]) -> list[list[str]]:
        """Each text's ids, decimal and joined by commas within each segment."""
        self.segments.rest()
        return self.segments.all([self.split(text) for text in texts], self._learn_segments)

    def decode(self, ids: str) -> bytes:
        """The bytes of ids, which are decimal and joined by commas."""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


_codecs: dict[tuple[str, str], Codec] = {}
words.remembers("bpe", _codecs.clear)


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts are encoded together."""
    for begin in range(0, batch.num_rows, rows):
        yield batch.slice(begin, rows)


def _texts(part: pa.RecordBatch) -> list[str]:
    return [text or "" for text in part.column(1).to_pylist()]


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per document: doc_id and ids (array<int>), for training data."""
    path, pattern = path or production_path(), pattern or production_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in _parts(batch):
                ids = [[int(x) for x in ",".join(segments).split(",") if x] for segments in own.encode(_texts(part))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
        words.release("bpe")

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def annotate(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the bytes the ids decode to)."""
    path, pattern = path or production_path(), pattern or production_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in _parts(batch):
                encoded = own.encode(_texts(part))
                ids = [",".join(segments) for segments in encoded]
                counts = [x.count(",") + 1 if x else 0 for x in ids]
                of_ids = [hashlib.sha256(x.encode()).hexdigest() for x in ids]
                of_bytes = [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        words.release("bpe")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
