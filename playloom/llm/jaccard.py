"""N-gram Jaccard join: documents whose sets of word shingles are alike, and their connected components.

Exact for 100 * intersection >= 75 * union. Equal sets form one class and are
compared once. Shingles are ordered with the frequent ones last; two classes can
only link if they share one of the first n - ceil(0.75 n) + 1 shingles of each,
so those postings, with set size and position, make the index lists.

Skipping in the index: a list holds for each class its size and position. A
posting whose size and position leave no room for a link with any other posting
of its list is dropped where the list is made, and blocks of postings are
skipped whole by the ranges of their sizes and rests. Lists of the same classes
are one list.

Skipping by answers: each list has a leader (its smallest class), which is
compared with the other members. These computed answers give the rest: with the
overlaps o(u), o(m) to the leader, the overlap of u and m is at most
min(o(u), o(m)) + min(n(u) - o(u), n(m) - o(m)). A second bound comes from a bit
signature of each set: bits of u that m lacks are so many shingles at least that
m lacks. Members connected with their leader are settled; open ones are tested against the settled ones as far as
this bound and the connections made so far leave it open. The open members make
a new list with a new leader; after ``rounds`` leaders what is left of a list is
tested within.

Scale: the postings are the one large exchange. They travel packed, in buckets
of about ``BUCKET_POSTINGS``; those of a shingle that only one class has are
dropped there. Postings of frequent shingles are dealt by class, so a long list
is never gathered. Sets travel once for each leader they meet, cut into parts
of about ``PART`` shingles; no task holds more than two parts.

Shingles are 64-bit hashes of the words' bytes; a class is a 64-bit digest of
its sorted set.

Defined results: null, empty and blank texts have no shingles and link with
nothing; rows with null doc_id are returned with their n_shingles and a null
component; repeated rows fall into one class; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playloom.llm.bloom import passing
from playloom.llm.columns import fresh
from playloom.llm.words import chunks, hashed_words, mix64, release
from playloom.shared import Tables, materialize

WORDS = 5
#: A shingle that so many sets of one Arrow batch have is counted as frequent.
FREQUENT = 4
#: Frequent shingles that are told apart, at most; they are broadcast (9 bytes each).
MAX_FREQUENT = 1 << 18
#: Leaders that a list has, one after the other.
ROUNDS = 2
BUCKET_POSTINGS = 400_000
#: Shingles of the sets that meet in one task, about.
PART = 1 << 20
#: Postings of a block that is skipped whole.
BLOCK = 128
#: Bits of a signature, at most.
MAX_SIGNATURE = 1 << 16
#: Pairs of a list that are told apart, at most, for each of its rows; where more are open, sets meet side by side.
FEW = 2
#: Lists up to this length are searched for postings without a partner.
SHORT = 48

_FACTORS = mix64(np.arange(1000, 1000 + WORDS, dtype=np.uint64)) | np.uint64(1)


def sets_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk."""
    words, first = hashed_words(data, offsets)
    full = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS if len(full) else 0):
        full += words[k : len(words) - WORDS + 1 + k] * _FACTORS[k]
    full = mix64(full)
    for begin, end in zip(first[:-1].tolist(), first[1:].tolist()):
        if end - begin >= WORDS:
            yield np.unique(full[begin : end - WORDS + 1])
        elif end > begin:
            short = np.add.reduce(words[begin:end] * _FACTORS[: end - begin]) + np.uint64(end - begin)
            yield mix64(np.array([short], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [s for _, data, offsets in chunks(texts) for s in sets_of(data, offsets)]


def _class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(tokens.tobytes()).digest()[:8], "little", signed=True)


def _prefix(n):
    return n - -(-3 * n // 4) + 1


def _need(a, b):
    """Smallest overlap of a link between sets of these sizes: 7 * overlap >= 3 * (a + b)."""
    return -(-3 * (a + b) // 7)


def _room(n_a, rest_a, n_b, rest_b):
    """Size and position leave room for a link (at the first shared shingle nothing was shared before)."""
    return (4 * np.minimum(n_a, n_b) >= 3 * np.maximum(n_a, n_b)) & (np.minimum(rest_a, rest_b) >= _need(n_a, n_b))


def signature(s: np.ndarray) -> bytes:
    """Bits of a set's hashes, two to four for each shingle (fewer for very large sets)."""
    bits = min(MAX_SIGNATURE, 1 << max(6, int(2 * len(s) - 1).bit_length()))
    flags = np.zeros(bits, np.uint8)
    flags[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _folded(signatures: list[bytes]) -> np.ndarray:
    """Signatures as rows of equal length, that of the shortest: a longer one's parts are laid over each other."""
    words = min(map(len, signatures), default=8) // 8
    return np.stack([np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, words), axis=0) for b in signatures])


def _may_share(n_a, bits_a: np.ndarray, n_b, bits_b: np.ndarray):
    """Whether signatures leave room for a link; the last axis holds the words."""
    lacks_a, lacks_b = (np.bitwise_count(x & ~y).sum(-1, dtype=np.int64) for x, y in ((bits_a, bits_b), (bits_b, bits_a)))
    return np.minimum(n_a - lacks_a, n_b - lacks_b) >= _need(n_a, n_b)


def scanned(docs: DataFrame) -> DataFrame:
    """One scan gives two kinds of rows: doc_id, n_shingles, class and signature of every document; token and n of what is
    frequent in an Arrow batch."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what other operators left in this worker
        seen: set[int] = set()
        names = ["doc_id", "n_shingles", "class", "bits", "token", "n"]
        for batch in batches:
            sizes, keys, bits, new = [], [], [], []
            slots = np.zeros(1 << 20, np.uint32)
            for _, data, offsets in chunks(batch.column(1)):
                for s in sets_of(data, offsets):
                    key = _class_of(s)
                    sizes.append(len(s))
                    keys.append(key)
                    bits.append(signature(s) if len(s) else None)
                    if len(s) and key not in seen:
                        seen.add(key)
                        new.append(s)
                        np.add.at(slots, (s >> np.uint64(44)).astype(np.int64), 1)
            ids, none = batch.column(0), pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(bits, pa.binary()), none, none], names=names)
            # A slot counts all shingles that fall into it, so no frequent one is missed.
            often = [s[slots[(s >> np.uint64(44)).astype(np.int64)] >= FREQUENT] for s in new]
            token, n = np.unique(np.concatenate(often) if often else np.empty(0, np.uint64), return_counts=True)
            token, n = token[n >= FREQUENT], n[n >= FREQUENT]
            none = pa.nulls(len(token), pa.int64())
            new, often = [], []
            yield pa.RecordBatch.from_arrays([pa.nulls(len(token), ids.type), none, none, pa.nulls(len(token), pa.binary()), pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=names)
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, n_shingles long, class long, bits binary, token long, n long")


def frequent_shingles(counts: DataFrame, most: int = MAX_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, with the log2 of their counts; at most ``most`` of them."""
    levels = counts.groupBy("token").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("level"))
    floor, total = 64, 0
    for level, n in sorted(((r["level"], r["count"]) for r in levels.groupBy("level").count().collect()), reverse=True):
        if total + n > most:
            break
        floor, total = level, total + n
    rows = levels.filter(F.col("level") >= floor).toArrow()
    token, level = rows.column("token").to_numpy().view(np.uint64), rows.column("level").to_numpy()
    order = np.argsort(token)
    return token[order], level[order].astype(np.uint8)


def _known(sorted_tokens: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``s`` is in the sorted array, and whether it is there."""
    if not len(sorted_tokens):
        return np.zeros(len(s), np.int64), np.zeros(len(s), bool)
    at = np.minimum(np.searchsorted(sorted_tokens, s), len(sorted_tokens) - 1)
    return at, sorted_tokens[at] == s


def packed_postings(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """(bucket, payload): tokens, classes and places (size << 32 + position) of the first shingles of each set, frequent ones
    last. A token has one bucket; a frequent one has a bucket for each class."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, levels = shared.value
        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                heads, keys, sizes, hot = [], [], [], []
                for s in sets_of(data, offsets):
                    key = _class_of(s)
                    if not len(s) or key in seen:
                        continue
                    seen.add(key)
                    at, known = _known(often, s)
                    order = np.argsort(np.where(known, levels[at], 0) if len(often) else known, kind="stable")[: _prefix(len(s))]
                    heads.append(s[order])
                    hot.append(known[order])
                    keys.append(key)
                    sizes.append(len(s))
                if not heads:
                    continue
                length = np.array([len(h) for h in heads])
                token, key = np.concatenate(heads), np.repeat(np.array(keys, np.int64), length)
                place = (np.repeat(np.array(sizes, np.int64), length) << 32) + np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
                bucket = mix64(np.where(np.concatenate(hot), token ^ mix64(key.view(np.uint64)), token)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                columns = [x[order] for x in (token.view(np.int64), key, place)]
                payload = [b"".join(x[b:e].tobytes() for x in columns) for b, e in zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[begin].astype(np.int64)), pa.array(payload, pa.binary())], names=["bucket", "payload"])
        release()

    return docs.select("text").mapInArrow(run, "bucket long, payload binary")


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted run of equal rows begins."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _with_partner(begin: np.ndarray, length: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which postings have room for a link with another of their list; those of long lists count as having it."""
    owner = np.repeat(np.arange(len(begin)), length)
    good = np.repeat(length > SHORT, length)
    size, rest = place >> 32, (place >> 32) - (place & 0xFFFFFFFF)
    for step in range(1, min(SHORT, int(length.max(initial=1)))):
        low = np.flatnonzero((owner[step:] == owner[:-step]) & (length[owner[step:]] <= SHORT))
        high = low + step
        room = _room(size[low], rest[low], size[high], rest[high])
        good[low[room]] = True
        good[high[room]] = True
    return good


def lists_of_bucket(frequent: np.ndarray, payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, class, place) of a bucket's postings: each class once in a list, lists of two classes or more."""
    parts = [np.frombuffer(p, np.int64).reshape(3, -1) for p in payloads]
    token, key, place = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((key, token))
    token, key, place = token[order], key[order], place[order]
    at = _firsts(token, key)
    token, key, place = token[at], key[at], place[at]
    hot = _known(frequent, token.view(np.uint64))[1]
    begin = _firsts(token)
    length = np.diff(np.r_[begin, len(token)])
    keep = np.repeat(length > 1, length) & ~hot
    out = [(token[hot], key[hot], place[hot])]
    token, key, place = token[keep], key[keep], place[keep]
    if len(token):
        begin = _firsts(token)
        keep = _with_partner(begin, np.diff(np.r_[begin, len(token)]), place)
        token, key, place = token[keep], key[keep], place[keep]
    if len(token):
        # Lists of the same classes get the same name; of a class's places the first counts, which leaves the most room.
        begin = _firsts(token)
        mixed = np.add.reduceat(mix64(key.view(np.uint64)), begin)
        name = np.repeat(mix64(mixed).view(np.int64), np.diff(np.r_[begin, len(token)]))
        order = np.lexsort((place, key, name))
        name, key, place = name[order], key[order], place[order]
        at = _firsts(name, key)
        out.append((name[at], key[at], place[at]))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def index_lists(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """(list, class, place) of all lists in which classes may meet."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent[0])

    def run(table: pa.Table) -> pa.Table:
        columns = lists_of_bucket(shared.value, [v.as_buffer() for v in table.column("payload")])
        return pa.table([pa.array(c) for c in columns], names=["list", "class", "place"])

    found = packed_postings(docs, frequent, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, "list long, class long, place long")
    return found.groupBy("list", "class").agg(F.min("place").alias("place"))


def _size(place: str) -> Column:
    return F.shiftright(F.col(place), 32)


def _rest(place: str) -> Column:
    """How many shingles a set has from this posting on."""
    return _size(place) - F.col(place).bitwiseAND(0xFFFFFFFF)


def _has_room(p: str, q: str) -> Column:
    a, b = _size(p), _size(q)
    return (4 * F.least(a, b) >= 3 * F.greatest(a, b)) & (7 * F.least(_rest(p), _rest(q)) >= 3 * (a + b))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each key of a sorted stream, together; a key is its first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        begin = _firsts(*columns).tolist()
        for b, e in zip(begin, [*begin[1:], batch.num_rows]):
            key = tuple(int(c[b]) for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(b, e - b))
    if held:
        yield pa.Table.from_batches(held)


class Crowd:
    """Sets side by side, to be met by others one at a time."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        token = np.concatenate(sets)
        order = np.argsort(token, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.token, begin = np.unique(token[order], return_index=True)
        self.begin = np.append(begin, len(token))

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        """Overlap of ``s`` with each set."""
        at, known = _known(self.token, s)
        at = at[known]
        low, n = self.begin[at], self.begin[at + 1] - self.begin[at]
        places = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.bincount(self.owner[places], minlength=len(self.sizes))


def _text_sets(table: pa.Table, classes: str = "class") -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """Classes, sets and row numbers of a table's rows; rows whose text is of another class (a doc_id that comes again) drop out."""
    keys, sets, at = [], [], []
    for row, (key, s) in enumerate(zip(table.column(classes).to_pylist(), shingle_sets(table.column("text")))):
        if key == _class_of(s):
            keys.append(key)
            sets.append(s)
            at.append(row)
    return keys, sets, np.array(at, np.int64)


def met(rows: DataFrame, texts: DataFrame | None, run: Callable[[pa.Table], pa.Table], schema: str, part: int = PART, within: bool = False) -> DataFrame:
    """Rows (leader, class, side, size, ...): each part of side 0 meets each part of side 1 of its leader in ``run``. With
    ``within`` the rows of side 0 belong to side 1 too; where both of a row's parts meet, it comes once, with ``both`` set."""
    is_0, is_1 = F.col("side") == 0, (F.col("side") == 1) | F.lit(within)
    cuts = [F.ceil((F.coalesce(F.sum(F.when(side, F.col("size"))), F.lit(0)) + 1) / part).alias(f"cuts_{k}") for k, side in enumerate((is_0, is_1))]
    cut = rows.join(rows.groupBy("leader").agg(*cuts), "leader")
    mine = [F.pmod(F.xxhash64("class"), F.col(f"cuts_{k}")) for k in (0, 1)]

    def cell(first: Column, second: Column) -> Column:
        return F.struct(first.cast("long").alias("part_0"), second.cast("long").alias("part_1"))

    def places(k: int) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.col(f"cuts_{k}") - 1)

    none = F.array().cast("array<struct<part_0:bigint,part_1:bigint>>")
    as_0 = F.when(is_0, F.transform(places(1), lambda j: cell(mine[0], j))).otherwise(none)
    as_1 = F.when(is_1, F.transform(places(0), lambda i: cell(i, mine[1]))).otherwise(none)
    own_0, own_1 = is_0 & (F.col("cell.part_0") == mine[0]), is_1 & (F.col("cell.part_1") == mine[1])
    names = [c for c in rows.columns if c not in ("leader", "side")]
    cells = cut.withColumn("cell", F.explode(F.array_union(as_0, as_1)))
    cells = cells.select("leader", "cell.part_0", "cell.part_1", F.when(own_0, 0).otherwise(1).alias("side"), (own_0 & own_1).alias("both"), *names)
    if texts is not None:
        cells = cells.join(passing(texts, rows.select("class").distinct(), "class"), "class").select(*cells.columns, "text")
    keys = ("leader", "part_0", "part_1")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, len(keys)):
            sides = set(table.column("side").unique().to_pylist())
            if sides == {0, 1} or table.num_rows > 1 and pc.any(table.column("both")).as_py():
                yield from run(table).to_batches(max_chunksize=65_536)
        release()

    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


def answers_of(table: pa.Table) -> pa.Table:
    """Overlap of the leader (side 0) with each other class (side 1)."""
    keys, sets, at = _text_sets(table)
    side = table.column("side").to_numpy()[at]
    leader = [k for k in range(len(at)) if side[k] == 0]
    out: list[tuple] = []
    if leader:
        crowd = Crowd([sets[leader[0]]])
        out = [(keys[leader[0]], keys[k], int(crowd.sizes[0]), len(sets[k]), int(crowd.overlaps(sets[k])[0])) for k in range(len(at)) if side[k] == 1]
    return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], names=["leader", "class", "n_leader", "n_class", "overlap"])


def _still_open(o: dict[str, np.ndarray], m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], int]:
    """Which open rows and which others have a partner on the other side that may still link, by size, position, root and the
    leader's answers and signatures; the pairs, while they are few for the rows, and their number. Both sides come sorted by size, so
    blocks are skipped by their ranges first."""
    keep_o, keep_m = np.zeros(len(o["size"]), bool), np.zeros(len(m["size"]), bool)
    pairs, total = [], 0
    for a in range(0, len(keep_o), BLOCK):
        x = {k: v[a : a + BLOCK] for k, v in o.items()}
        for b in range(0, len(keep_m), BLOCK):
            y = {k: v[b : b + BLOCK] for k, v in m.items()}
            if 4 * min(x["size"][-1], y["size"][-1]) < 3 * max(x["size"][0], y["size"][0]) or min(x["rest"].max(), y["rest"].max()) < _need(x["size"][0], y["size"][0]):
                continue
            u, v = {k: c[:, None] for k, c in x.items() if k != "bits"}, {k: c[None, :] for k, c in y.items() if k != "bits"}
            may = _room(u["size"], u["rest"], v["size"], v["rest"]) & (u["root"] != v["root"])
            bound = np.minimum(u["most"], v["most"]) + np.minimum(u["size"] - u["least"], v["size"] - v["least"])
            may &= bound >= _need(u["size"], v["size"])
            long_o, long_m = (np.array([len(bits) for bits in side.get("bits", ())]) for side in (x, y))
            for n_o in np.unique(long_o[may.any(1)]) if len(long_o) else ():  # signatures of one length each, so that none is folded more than its pair asks for
                for n_m in np.unique(long_m[may.any(0)]):
                    at_o, at_m = np.flatnonzero(long_o == n_o), np.flatnonzero(long_m == n_m)
                    cell = np.ix_(at_o, at_m)
                    if may[cell].any():
                        folded = _folded([*x["bits"][at_o], *y["bits"][at_m]])
                        left, right = folded[: len(at_o), None], folded[None, len(at_o) :]
                        may[cell] &= _may_share(x["size"][at_o][:, None], left, y["size"][at_m][None, :], right)
            keep_o[a : a + BLOCK] |= may.any(1)
            keep_m[b : b + BLOCK] |= may.any(0)
            total += int(may.sum())
            if total <= FEW * (len(keep_o) + len(keep_m)):
                at = np.nonzero(may)
                pairs.append((at[0] + a, at[1] + b))
    return keep_o, keep_m, pairs, total


def open_cells(table: pa.Table) -> pa.Table:
    """What is to be tested in a list. Few pairs are given as they are: (smaller, larger, 2). Else the rows that have a partner:
    (leader, class, side), with the list's leader from ``of``."""
    side = table.column("side").to_numpy()
    size, place, key = (table.column(c).to_numpy() for c in ("size", "place", "class"))
    overlap = table.column("overlap").fill_null(-1).to_numpy()
    columns = {"root": table.column("root").to_numpy(), "size": size, "rest": size - (place & 0xFFFFFFFF), "most": np.where(overlap < 0, size, overlap), "least": np.maximum(overlap, 0)}
    if "bits" in table.column_names:
        columns["bits"] = np.array([b.as_buffer() for b in table.column("bits")] + [None], object)[:-1]
    order = np.argsort(size, kind="stable")
    rows = [order[side[order] == 0], order[(side[order] == 1) | table.column("both").to_numpy()[order]]]
    keep_o, keep_m, pairs, total = _still_open(*[{k: v[at] for k, v in columns.items()} for at in rows])
    kept = [rows[0][keep_o], rows[1][keep_m]]
    if total <= FEW * (len(kept[0]) + len(kept[1])):
        u, v = (np.concatenate([key[rows[k][p[k]]] for p in pairs] or [np.empty(0, np.int64)]) for k in (0, 1))
        first, second = np.minimum(u, v), np.maximum(u, v)
        return pa.table({"leader": pa.array(first), "class": pa.array(second), "side": pa.array(np.full(len(first), 2, np.int32))})
    at = np.concatenate(kept)
    role = np.repeat(np.arange(2, dtype=np.int32), [len(k) for k in kept])
    return pa.table({"leader": table.column("of").take(at), "class": pa.array(key[at]), "side": pa.array(role)})


def links_between(table: pa.Table) -> pa.Table:
    """Links (a, b) of open rows (side 0) and others (side 1), as many as connect what their links connect."""
    keys, sets, at = _text_sets(table)
    side, roots = table.column("side").to_numpy()[at], table.column("root").to_numpy()[at].tolist()
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    out: list[tuple[int, int]] = []
    first = [k for k in range(len(at)) if side[k] == 0]
    if first:
        crowd = Crowd([sets[k] for k in first])
        for k in np.flatnonzero(side == 1).tolist():
            own = root(roots[k])
            if all(root(roots[f]) == own for f in first):
                continue
            overlap = crowd.overlaps(sets[k])
            for f in np.flatnonzero(7 * overlap >= 3 * (crowd.sizes + len(sets[k]))).tolist():
                a, b = root(roots[first[f]]), root(roots[k])
                if a != b:
                    up[max(a, b)] = min(a, b)
                    out.append((keys[first[f]], keys[k]))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def may_link(near: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs (leader, class, size, leader_size) that their signatures do not rule out."""
    both = near.join(bits, "class").join(bits.select(F.col("class").alias("leader"), F.col("bits").alias("leader_bits")), "leader")
    names = ["leader", "class", "size", "leader_size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            pairs = [_folded([a.as_buffer(), b.as_buffer()]) for a, b in zip(batch.column(4), batch.column(5))]
            keep = [bool(_may_share(n_a[k], x[0], n_b[k], x[1])) for k, x in enumerate(pairs)]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return both.select(*names, "bits", "leader_bits").mapInArrow(run, "leader long, class long, size long, leader_size long")


def _rooted(rows: DataFrame, stars: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the root of a class; a class without links is its own."""
    named = stars.select(F.col("node").alias(column), F.col("root").alias(name))
    return rows.join(named, column, "left").withColumn(name, F.coalesce(name, column))


def links(docs: DataFrame, classes: DataFrame, counts: DataFrame, tables: Tables, rounds: int = ROUNDS, part: int = PART) -> DataFrame:
    """(node, root) of the classes that links connect; ``classes`` has first_id, class, n_shingles and bits of each."""
    spark = docs.sparkSession
    postings = classes.agg(F.sum(F.col("n_shingles") - F.ceil(F.col("n_shingles") * 3 / 4) + 1)).first()[0] or 0
    lists = tables.write(index_lists(docs, frequent_shingles(counts), max(1, -(-postings // BUCKET_POSTINGS))), "lists")
    wanted = tables.write(lists.select("class").distinct().join(classes, "class").select("class", "first_id", "bits", F.col("n_shingles").alias("size")), "wanted")
    sizes, bits = wanted.select("class", "size"), wanted.select("class", "bits")
    texts = tables.write(passing(docs.select(F.col("doc_id").alias("first_id"), "text"), wanted, "first_id").join(wanted.select("class", "first_id"), "first_id").select("class", "text"), "texts")
    stars = spark.createDataFrame([], "node long, root long")
    known = spark.createDataFrame([], "leader long, class long, overlap long")
    for turn in range(rounds):
        last = turn == rounds - 1
        heads = lists.groupBy("list").agg(F.min(F.struct("class", "place")).alias("head"), F.count(F.lit(1)).alias("length")).filter("length > 1")
        heads = tables.write(heads.select("list", F.col("head.class").alias("leader"), F.col("head.place").alias("leader_place"), "length"), "heads")
        rows = lists.join(heads, "list").filter("class <> leader")
        near = rows.filter(_has_room("place", "leader_place")).groupBy("leader", "class").agg(F.max(_size("place")).alias("size"), F.max(_size("leader_place")).alias("leader_size"))
        near = _rooted(_rooted(near, stars, "class", "root"), stars, "leader", "leader_root").filter("root <> leader_root").drop("root", "leader_root")
        near = tables.write(may_link(near.join(known, ["leader", "class"], "left_anti"), bits), "near")
        told = compared(near, texts, tables, part)
        known = known.unionByName(told.select("leader", "class", "overlap"))
        stars = joined(stars, linked(told), tables)
        # Open members of lists of three or more, against the settled ones; in the last round against all.
        rows = _rooted(_rooted(rows.filter("length > 2"), stars, "class", "root"), stars, "leader", "leader_root")
        rows = tables.write(rows.withColumn("open", F.col("root") != F.col("leader_root")), "rows")
        unsettled = tables.write(rows.filter("open").select("list").distinct(), "unsettled")
        if unsettled.isEmpty():
            break
        block = rows.join(unsettled, "list", "left_semi").select("list", "leader", "class", "place", "root", "open")
        block = tables.write(block.join(known, ["leader", "class"], "left").withColumn("size", _size("place")), "block")
        # Which members of a list have a partner there is told list by list; then each set meets those of its leader once.
        asked = block.select(F.col("list").alias("leader"), F.col("leader").alias("of"), "class", F.when(F.col("open"), 0).otherwise(1).alias("side"), "size", "place", "root", "overlap")
        if last:  # the open ones also meet each other; signatures bound what the leader's answers do not
            asked = asked.join(bits, "class").select(*asked.columns, "bits")
        asked = tables.write(met(asked, None, open_cells, "leader long, class long, side int", part, last).distinct(), "asked")
        pairs = asked.filter("side = 2").select("leader", "class").join(known, ["leader", "class"], "left_anti")
        pairs = pairs.join(sizes, "class").join(sizes.select(F.col("class").alias("leader"), F.col("size").alias("leader_size")), "leader")
        pairs = pairs if last else may_link(pairs, bits)
        pairs = tables.write(pairs, "pairs")
        told = compared(pairs, texts, tables, part)
        known = known.unionByName(told.select("leader", "class", "overlap"))
        cells = asked.filter("side < 2").join(block.select("leader", "class", "size", "root").distinct(), ["leader", "class"])
        cells = tables.write(cells, "cells")
        found = tables.write(met(cells, texts, links_between, "a long, b long", part), "links")
        passed = (heads, near, unsettled, block, asked, pairs, cells)
        stars = joined(stars, linked(told).unionByName(found), tables)
        tables.drop(*passed, found)
        lists = rows.filter("open").select("list", "class", "place")
    return stars


def compared(near: DataFrame, texts: DataFrame, tables: Tables, part: int = PART) -> DataFrame:
    """Sizes and overlap of each pair (leader, class), from rows with ``leader_size`` and ``size``."""
    heads = near.select("leader", F.col("leader").alias("class"), F.lit(0).alias("side"), F.col("leader_size").alias("size")).distinct()
    both = heads.unionByName(near.select("leader", "class", F.lit(1).alias("side"), "size"))
    return tables.write(met(both, texts, answers_of, "leader long, class long, n_leader long, n_class long, overlap long", part).distinct(), "told")


def linked(told: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    return told.filter("7 * overlap >= 3 * (n_leader + n_class)").select(F.col("leader").alias("a"), F.col("class").alias("b"))


def joined(stars: DataFrame, linked: DataFrame, tables: Tables) -> DataFrame:
    """The star edges (node, root) after further links."""
    if linked.isEmpty():
        return stars
    return components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(linked), tables)


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, root): each node's smallest reachable node, by alternating large and small stars; nodes without an edge are absent."""
    edges = tables.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    while True:
        # Done when every node has one smaller neighbour and no node is both a centre and a ray.
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
        ends = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.count(F.lit(1)).alias("n"))
        if ends.filter("up > 1 or (up = 1 and n > 1)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        before = edges
        large = tables.write(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = tables.write(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "stars")
        tables.drop(before, large)


def annotate(docs: DataFrame, rounds: int = ROUNDS, part: int = PART) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    tables = Tables(docs.sparkSession, "jaccard")
    scan = tables.write(scanned(docs), "scan")
    sets = scan.filter("class is not null").select("doc_id", "n_shingles", "class")
    named = scan.filter("n_shingles > 0 and doc_id is not null").groupBy("class").agg(F.min(F.struct("doc_id", "n_shingles", "bits")).alias("one"))
    classes = tables.write(named.select("class", F.col("one.doc_id").alias("first_id"), "one.n_shingles", "one.bits"), "classes")
    counts = scan.filter("token is not null").select("token", "n")
    roots = links(docs.filter("doc_id is not null"), classes, counts, tables, rounds, part)
    rooted = tables.write(_rooted(classes.select("class", "first_id"), roots, "class", "root"), "rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = tables.write(rooted.join(least, "root").select("class", "component_id"), "named")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    out = tables.write(sets.join(named, "class", "left").select("doc_id", "n_shingles", own.alias("component_id")), "components")
    tables.keep_last()
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component with all its columns: the one with the smallest doc_id, then the smallest SHA-256 of its text.

    Of rows that repeat both, the first by the JSON of its other columns stays. Rows of one doc_id
    with different texts are different documents. Rows without doc_id belong to no component and are kept.
    Texts are shuffled only by the join with the kept documents, and only where those are too many to broadcast.
    """
    key, number = fresh(docs, "jaccard_keep", "jaccard_rows")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    name = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), digest.alias("digest")))
    named = docs.withColumn(key, name)
    found = annotate(named.select(F.col(key).alias("doc_id"), "text")).filter(F.col("doc_id") == F.col("component_id"))
    kept = materialize(found.groupBy(F.col("doc_id").alias(key)).agg(F.count(F.lit(1)).alias(number)), "jaccard-kept")
    once, often = (kept.filter(F.col(number) == 1), kept.filter(F.col(number) > 1))
    out = named.join(once, key, "left_semi").select(docs.columns).unionByName(docs.filter("doc_id is null"))
    if often.isEmpty():
        return out
    others = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")], F.lit(1).alias(number)))
    first = F.row_number().over(Window.partitionBy(key).orderBy(others)).alias(number)
    again = named.join(often, key, "left_semi").select("*", first).filter(F.col(number) == 1)
    return out.unionByName(again.select(docs.columns))
