"""Best-fit packing of tokenised documents into sequences, by a grouping genetic algorithm on islands.

A document is its token ids and an end id. Longer ones than a sequence are cut
so that all pieces but the first fill a sequence. The other pieces are packed:
an individual is a packing, its genes are whole bins. A crossover injects
well-filled bins of one parent into the other, drops the bins that hold one of
their documents a second time, and puts the displaced documents back largest
first, each where it leaves the least room. Fewer bins are fitter, then the
larger sum of squared fills.

Scale: pieces are dealt into shards of about ``SHARD`` by a hash, so no key is hot
and a task holds one shard. Each shard lives on ``ISLANDS`` islands, which are
tasks with seeds of their own; after each epoch an island's elite migrates to
the next island of its shard, through a written table. Bins that are filled
well are final; what is in the others is dealt anew, bins as wholes, in
up to ``ROUNDS`` rounds, and no round can need more bins than the one before. A
sequence is named by the smallest item in it, so that no numbering runs through
one task. Seeds depend on round, epoch, shard and island only.

Tokens: the ids are those of ``tokenizers``. For a byte-level file whose merges
are in the order of their ids they come from ``tiktoken`` with the same merges as
ranks (equal in tests on every code point and on random texts); all other files, and
texts that hold a special token, go to ``tokenizers`` itself. Long texts go through
in parts that end before a space where a new token begins.

Defined results: null text counts as empty, its one token is the end id; a null
doc_id and repeated rows are packed like all others; empty tables give no
pieces; of the columns only doc_id and text are read.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playloom.llm import words
from playloom.llm.bpe import _BLANK, production_pattern
from playloom.shared import Tables

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END_ID = 2048, 0
PRODUCTION_TOKENIZER = "byte_bpe_50k.json"
#: Letters of a text that are tokenised together.
PART = 1 << 20
#: Items of a shard, islands of a shard, rounds over what is not filled well.
SHARD, ISLANDS, ROUNDS = 8_192, 3, 3
#: Epochs between migrations, and what each island does in one of them.
EPOCHS, POPULATION, GENERATIONS = 2, 5, 12
#: A bin with less room than this is final.
WELL = 16


def production_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PRODUCTION_TOKENIZER)


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes."""

    #: Where a text can be cut: before one space between other letters a new token begins.
    CUT = re.compile(f"[^{_BLANK}](?= [^{_BLANK}])")

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = _same_ranks(path)

    def _parts(self, text: str) -> Iterator[str]:
        begin = 0
        while len(text) - begin > PART:
            cut = self.CUT.search(text, begin + PART)
            if cut is None:
                break
            yield text[begin : cut.end()]
            begin = cut.end()
        yield text[begin:] if begin else text

    def encode(self, text: str) -> bytes:
        # What the tokenizer does with a special token in a text is its own affair.
        if self.fast is None or any(token in text for token in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(self.fast.encode_to_numpy(part, disallowed_special=()).astype("<u4").tobytes() for part in self._parts(text))


def _same_ranks(path: str) -> tiktoken.Encoding | None:
    """The merges of a byte-level tokenizer file as ranks, which give the same ids about three times as fast.

    None where the file is of another kind: other splits, or merges in another order than the ids.
    """
    with open(path, encoding="utf-8") as lines:
        file = json.load(lines)
    model, split = file["model"], file["pre_tokenizer"]
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if file["normalizer"] is not None or model["type"] != "BPE" or any((split or {}).get(k) != v for k, v in plain.items()):
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves in the file
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in merges]
    if ids != sorted(ids) or ids and ids[0] < 256:
        return None
    special = {token["content"] for token in file["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=production_pattern(), mergeable_ranks=ranks, special_tokens={})


_encoders: dict[str, Encoder] = {}
words.remembers("packing", _encoders.clear)


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than a sequence where there are several."""
    if tokens <= capacity:
        return [(0, tokens)]
    first = tokens % capacity
    return ([(0, first)] if first else []) + [(start, capacity) for start in range(first, tokens, capacity)]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves where asked for."""
    path = path or production_path()
    end = END_ID.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                rows, source = [], []
                for row, text in enumerate(batch.column(1)):
                    ids = own.encode(text.as_py() or "") + end
                    for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + length)]
                        source.append(row)
                        rows.append((piece, start, length, zlib.crc32(part), memoryview(part).cast("I").tolist() if with_ids else None))
                columns = [pa.array([r[k] for r in rows], types[k]) for k in range(len(names) - 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *columns], names=names)
        words.release("packing")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{', ids array<int>' if with_ids else ''}")


class Packing:
    """Bins as lists of items, and the room left in each."""

    def __init__(self, bins: list[list[int]], room: list[int]):
        self.bins, self.room = bins, room

    def fitness(self, capacity: int) -> tuple[int, int]:
        return -len(self.bins), sum((capacity - r) ** 2 for r in self.room)

    def best_fit(self, items: list[int], lengths: list[int], capacity: int) -> Packing:
        """Puts items, in their order, each into the bin where it leaves the least room; bins of others are not changed."""
        bins, room = self.bins, self.room
        with_room: dict[int, list[int]] = {}
        for b, r in enumerate(room):
            if r:
                with_room.setdefault(r, []).append(b)
        levels = sum(1 << r for r in with_room)
        for item in items:
            length = lengths[item]
            enough = levels >> length
            if enough:
                r = length + (enough & -enough).bit_length() - 1
                b = with_room[r].pop()
                if not with_room[r]:
                    levels ^= 1 << r
                bins[b] = [*bins[b], item]
                r -= length
            else:
                b, r = len(bins), capacity - length
                bins.append([item])
                room.append(0)
            room[b] = r
            if r:
                with_room.setdefault(r, []).append(b)
                levels |= 1 << r
        return self


def crossed(one: Packing, other: Packing, lengths: list[int], capacity: int, rng: random.Random) -> Packing:
    """``one`` with well-filled bins of ``other``: doubled documents go with their bins, displaced ones find the best fit."""
    share = rng.uniform(0.1, 0.6)
    limit = sorted(other.room)[int(share * (len(other.room) - 1))]
    chosen = [b for b, r in enumerate(other.room) if r <= limit and rng.random() < 0.8]
    taken = bytearray(len(lengths))
    for b in chosen:
        for item in other.bins[b]:
            taken[item] = 1
    bins, room = [other.bins[b] for b in chosen], [other.room[b] for b in chosen]
    displaced = []
    for own, r in zip(one.bins, one.room):
        # A few badly filled bins are dissolved as well, so that their documents can move.
        if any(taken[item] for item in own) or r > capacity // 8 and rng.random() < 0.3:
            displaced.extend(item for item in own if not taken[item])
        else:
            bins.append(own)
            room.append(r)
    displaced.sort(key=lengths.__getitem__, reverse=True)
    return Packing(bins, room).best_fit(displaced, lengths, capacity)


def evolved(lengths: list[int], elites: list[list[list[int]]], capacity: int, seed: str) -> Packing:
    """The fittest packing of an island after some generations from the elites (lists of bins) and greedy packings."""
    rng = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    people = [Packing(list(bins), [capacity - sum(lengths[i] for i in own) for own in bins]) for bins in elites]
    people.append(Packing([], []).best_fit(sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True), lengths, capacity))
    while len(people) < POPULATION:
        noise = rng.uniform(0.02, 0.3)
        keys = [n * (1 + noise * rng.random()) for n in lengths]
        people.append(Packing([], []).best_fit(sorted(range(len(lengths)), key=keys.__getitem__, reverse=True), lengths, capacity))
    people = sorted(((p.fitness(capacity), k, p) for k, p in enumerate(people)), reverse=True)
    for generation in range(GENERATIONS):
        if len(people[0][2].bins) == least:
            break
        first, second = sorted(rng.sample(range(len(people)), 2))
        if rng.random() < 0.5:
            first, second = second, first
        child = crossed(people[first][2], people[second][2], lengths, capacity, rng)
        people[-1] = max(people[-1], (child.fitness(capacity), -generation - 1, child))
        people.sort(reverse=True)
    return people[0][2]


_ISLAND = "shard long, island int, item long, length long, bin long, offset long, bins long, squares long"


def _epoch(rows: DataFrame, capacity: int, name: str) -> DataFrame:
    """Evolves each (shard, island) from its elites, one for each ``role``; gives the fittest packing with its fitness."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard, island = key[0].as_py(), key[1].as_py()
        # Every elite holds every item once.
        items = sorted(set(group.column("item").to_pylist()))
        place = {item: k for k, item in enumerate(items)}
        lengths, by_role = [0] * len(items), {}
        for role, item, length, own in zip(*(group.column(c).to_pylist() for c in ("role", "item", "length", "bin"))):
            lengths[place[item]] = length
            by_role.setdefault(role, {}).setdefault(own, []).append(place[item])
        elites = [list(by_role[role].values()) for role in sorted(by_role)]
        best = evolved(lengths, elites, capacity, f"{name} {shard} {island}")
        bins, squares = best.fitness(capacity)
        columns: list[list] = [[], [], [], []]
        for own in best.bins:
            at = 0
            own = sorted(own)
            for k in own:
                for column, value in zip(columns, (items[k], lengths[k], items[own[0]], at)):
                    column.append(value)
                at += lengths[k]
        n = len(items)
        whole = [pa.array([shard] * n, pa.int64()), pa.array([island] * n, pa.int32()), *[pa.array(c, pa.int64()) for c in columns], pa.array([-bins] * n, pa.int64()), pa.array([squares] * n, pa.int64())]
        return pa.table(whole, names=[c.split()[0] for c in _ISLAND.split(", ")])

    return rows.groupBy("shard", "island").applyInArrow(run, _ISLAND)


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """item, sequence_id, offset of items (item long, length long), of 1 to ``capacity`` tokens each; items are distinct."""
    tables = Tables(items.sparkSession, "packing")
    full = items.filter(F.col("length") == capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.filter(F.col("length") < capacity).select("item", "length", F.col("item").alias("bin"))
    done, before = [full], None
    for number in range(rounds):
        n = rest.count()
        if n == 0:
            break
        shards = -(-n // shard)
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("bin", F.lit(number)), F.lit(shards)))
        rows = dealt.select("shard", F.explode(F.array(*[F.lit(k) for k in range(islands)])).alias("island"), F.lit(0).alias("role"), "item", "length", "bin")
        for epoch in range(EPOCHS):
            elite = tables.write(_epoch(rows, capacity, f"{number} {epoch}"), "elites")
            own = elite.select("shard", "island", F.lit(0).alias("role"), "item", "length", "bin")
            rows = own.unionByName(own.withColumn("island", ((F.col("island") + 1) % islands)).withColumn("role", F.lit(1)))
        fittest = F.max(F.struct(-F.col("bins"), F.col("squares"), -F.col("island"))).alias("best")
        best = elite.groupBy("shard").agg(fittest).select("shard", (-F.col("best.col3")).alias("island"))
        chosen = tables.write(elite.join(best, ["shard", "island"], "left_semi").select("item", "length", "bin", "offset"), "packed")
        filled = tables.write(chosen.groupBy("bin").agg((capacity - F.sum("length")).alias("room")), "bins")
        bins = filled.count()
        if number == rounds - 1 or shards == 1 or before is not None and bins >= before:
            done.append(chosen.select("item", F.col("bin").alias("sequence_id"), "offset"))
            break
        poor = filled.filter(F.col("room") >= WELL)
        before = poor.count()
        done.append(chosen.join(poor, "bin", "left_anti").select("item", F.col("bin").alias("sequence_id"), "offset"))
        rest = tables.write(chosen.join(poor, "bin", "left_semi").select("item", "length", "bin"), "rest")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _items(docs: DataFrame, tables: Tables, **how) -> DataFrame:
    """Pieces with numbers of their own, fixed by being written."""
    return tables.write(pieces(docs, **how).withColumn("item", F.monotonically_increasing_id()), "pieces")


def annotate(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    items = _items(docs, Tables(docs.sparkSession, "packing"), path=path, capacity=capacity)
    return items.join(pack(items.select("item", "length"), capacity, shard), "item").drop("item")


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row per sequence: sequence_id and its ids, at most ``capacity``, for training."""
    items = _items(docs, Tables(docs.sparkSession, "packing"), path=path, capacity=capacity, with_ids=True)
    placed = items.select("item", "ids").join(pack(items.select("item", "length"), capacity, shard), "item")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
