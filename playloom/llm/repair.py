"""Repair of conversations: the cheapest edits that make the roles follow a grammar.

Roles must read, by their initials, ``(s?(ua)+)?``. Rows may be kept, deleted,
given the role that is due (user or assistant), and rows without text may be put
in anywhere. Within a hash-partitioned batch of conversations a DuckDB recursive
query advances one row for all of them at a time and keeps, for each state of the
grammar, the least cost and the ASCII-least audit of that cost. Equal costs in one
state after the same rows never make one audit the begin of another, so keeping
one per state is enough.

Scale: faults that look at the whole conversation (repeated rows) are found by an
aggregate with partial results, joined back. The rows of a conversation then
pass, without their texts, through one task in order and as a stream; a
conversation longer than ``SEGMENT`` rows takes part in several recursions, each of
which gives costs and audits from every state to every state. The digest of the
repaired text is a chain of hashes by definition, so that a conversation's texts
pass through one task too, again as a sorted stream; what is held of a
conversation is one letter for each row.

Defined results: a null role or text counts as one space, a null turn as one space
in the hash that chooses the damage and as the first in the order; a null conv_id
is a conversation of its own; rows of one turn come by role, then by the SHA-256
of their text; repeated rows are duplicates; conversations that lose all rows have
zeros, an empty audit and the digest of nothing; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playloom.shared import Tables

#: Costs of the edits (fixed values); a truncated row that stays costs ``TRUNCATED`` more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the grammar: nothing yet, after system, after user, after assistant; and what an initial leads to.
STATES, NEXT, FINAL = range(4), {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}, (0, 3)
#: The role that is due in each state when a row is rewritten or put in.
DUE = {0: "user", 1: "user", 2: "assistant", 3: "user"}
#: Rows of a conversation that one recursion takes, and the room of a batch in squared lengths (audits grow with each row).
SEGMENT, BATCH = 512, 4_000_000
SPACES = " \t\n\x0b\x0c\r"
STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
RESULT = f"{STATS}, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows with their damage, which a hash of conv_id and turn chooses."""
    one = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    kind = F.crc32(name) % 20
    role, text = F.coalesce("role", one), F.coalesce("text", one)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    cut = F.regexp_replace("text", "[.!?]", "")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, cut).otherwise(F.col("text")).alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _key() -> Column:
    """A conversation's name; differs from all others where conv_id is null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def moves() -> list[tuple[int, str, int, int, str]]:
    """(state, code, next state, cost, letters): rows put in before a row, then the edit of the row.

    A row's code is the initial of its role (x for others), in upper case if it is truncated; D if it must go.
    """
    out = []
    for state in STATES:
        now, cost, letters = state, 0, ""
        for _ in range(3):  # a third row put in would only lead back
            out.extend((state, code, now, cost + DELETE, letters + "D") for code in "DsuaxSUAX")
            for code in "suaxSUAX":
                more = cost + (TRUNCATED if code.isupper() else 0)
                if (now, code.lower()) in NEXT:
                    out.append((state, code, NEXT[now, code.lower()], more + KEEP, letters + "K"))
                out.append((state, code, NEXT[now, DUE[now][0]], more + REROLE, letters + "R"))
            now, cost, letters = NEXT[now, DUE[now][0]], cost + INSERT, letters + "I"
    return out


RECURSION = """
    with recursive step as (
        select conv, codes, origin, origin as state, 0 as place, struct_pack(cost := 0::bigint, audit := '') as best from starts
        union all
        select conv, any_value(codes), origin, m.next, place + 1, min(struct_pack(cost := best.cost + m.cost, audit := best.audit || m.letters))
        from step join moves m on m.state = step.state and m.code = substr(codes, place + 1, 1)
        where place < length(codes)
        group by conv, origin, m.next, place
    )
    select conv, origin, state, best.cost, best.audit from step where place = length(codes)"""


def advanced(database: duckdb.DuckDBPyConnection, codes: list[tuple[str, tuple[int, ...]]]) -> list[dict[tuple[int, int], tuple[int, str]]]:
    """For each (codes, states to start from): least cost and audit by first and last state."""
    rows = [(k, text, state) for k, (text, states) in enumerate(codes) for state in states]
    columns = zip(*rows) if rows else ([], [], [])
    starts = pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64()))], names=["conv", "codes", "origin"])
    database.register("starts", starts)
    out: list[dict] = [{} for _ in codes]
    for conv, first, state, cost, audit in database.execute(RECURSION).fetchall():
        out[conv][first, state] = cost, audit
    database.unregister("starts")
    return out


def audits(conversations: list[str], segment: int = SEGMENT) -> list[tuple[int, str]]:
    """Least cost and its ASCII-least audit for the codes of each conversation."""
    database = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*moves()), kinds)], names=["state", "code", "next", "cost", "letters"])
    database.register("moves_in", table)
    database.execute("create table moves as select * from moves_in")
    # What all states have in common stays apart, so that only the rest is copied from segment to segment.
    common: list[list[str]] = [[] for _ in conversations]
    best: list[dict[int, tuple[int, str]]] = [{0: (0, "")} for _ in conversations]
    at = 0
    while left := [k for k, codes in enumerate(conversations) if len(codes) > at]:
        parts = advanced(database, [(conversations[k][at : at + segment], tuple(best[k])) for k in left])
        for k, part in zip(left, parts):
            now: dict[int, tuple[int, str]] = {}
            for (first, state), (cost, audit) in part.items():
                found = best[k][first][0] + cost, best[k][first][1] + audit
                if state not in now or found < now[state]:
                    now[state] = found
            shared = _shared([audit for _, audit in now.values()])
            common[k].append(next(iter(now.values()))[1][:shared])
            best[k] = {state: (cost, audit[shared:]) for state, (cost, audit) in now.items()}
        at += segment
    database.close()
    out = []
    for begin, states in zip(common, best):
        ends = []
        for state, (cost, audit) in states.items():
            while state not in FINAL:
                state, cost, audit = NEXT[state, DUE[state][0]], cost + INSERT, audit + "I"
            ends.append((cost, audit))
        cost, audit = min(ends)
        out.append((cost, "".join(begin) + audit))
    return out


def _shared(texts: list[str]) -> int:
    least, most = min(texts), max(texts)
    return next((k for k, (a, b) in enumerate(zip(least, most)) if a != b), min(len(least), len(most)))


def _faults(rows: DataFrame) -> DataFrame:
    """Rows without texts: key, turn, role, digest, copies, blank, cut, and whether the same role and text came in an earlier turn."""
    end = F.rtrim("text", F.lit(SPACES))
    slim = rows.select(
        _key().alias("key"), "turn", "role", F.sha2("text", 256).alias("digest"), "copies", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = slim.groupBy("key", "role", "digest").agg(F.min(place).alias("first"))
    return slim.join(first, ["key", "role", "digest"]).withColumn("again", F.col("first") < place).drop("first")


def _code(blank: bool, again: bool, cut: bool, role: str) -> str:
    if blank or again:
        return "D"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if cut else initial


class Conversation:
    """Counts of one conversation, whose rows come in order."""

    def __init__(self, key: str):
        self.key, self.codes = key, []
        self.turns, self.low, self.high = 0, None, None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.before: tuple[str, str] | None = None

    def take(self, turn: int | None, role: str, digest: str, copies: int, blank: bool, cut: bool, again: bool) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        for _ in range(copies):
            repeated = again or self.before == (turn, role, digest)
            fault = "blank" if blank else "duplicate" if repeated else "truncated" if cut else None
            if fault is not None:
                self.faults[fault] += 1
            if self.before is not None and self.before[1][:1] + role[:1] not in ("su", "ua", "au"):
                self.faults["illegal"] += 1
            self.codes.append(_code(blank, repeated, cut, role))
            self.before = turn, role, digest

    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.turns else 0


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Conversations by hash, each in the order of its rows."""
    return rows.repartition("key").sortWithinPartitions("key", *first, F.col("turn").asc_nulls_first(), "role", "digest")


def _audited(faults: DataFrame, segment: int) -> DataFrame:
    """Counts, cost and audit of each conversation that has rows."""
    names = ["turn", "role", "digest", "copies", "blank", "cut", "again"]
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([("key", pa.string()), *((c.split()[0], kinds[c.split()[1]]) for c in STATS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(done: list[Conversation]) -> pa.RecordBatch:
            found = audits(["".join(c.codes) for c in done], segment)
            return _batch([(c.key, c.gaps(), *c.faults.values(), cost, audit) for c, (cost, audit) in zip(done, found)], schema)

        done: list[Conversation] = []
        now: Conversation | None = None
        room = BATCH
        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ["key", *names])):
                if now is None or now.key != key:
                    if now is not None:
                        done.append(now)
                        room -= min(len(now.codes), segment) ** 2 + 64
                        if room < 0:
                            yield finished(done)
                            done, room = [], BATCH
                    now = Conversation(key)
                now.take(*row)
        if now is not None:
            yield finished([*done, now])

    return _in_order(faults.select("key", *names)).mapInArrow(run, f"key string, {STATS}")


class Repaired:
    """The repaired rows of one conversation, letter by letter."""

    def __init__(self, audit: str):
        self.letters, self.state, self.digest, self.lines = iter(audit), 0, hashlib.sha256(), 0

    def _put(self, role: str, text: str) -> None:
        self.state = NEXT[self.state, role[:1]]
        self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def take(self, role: str, text: str) -> None:
        for letter in self.letters:
            if letter == "I":
                self._put(DUE[self.state], "")
                continue
            if letter != "D":
                self._put(role if letter == "K" else DUE[self.state], text)
            return

    def end(self) -> str:
        for _ in self.letters:  # only rows put in are left
            self._put(DUE[self.state], "")
        return self.digest.hexdigest()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], field.type) for k, field in enumerate(schema)], schema=schema)


def repair(rows: DataFrame, conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id and the result for each conversation; ``rows`` are conv_id, turn, role, text, copies in need of repair."""
    tables = Tables(rows.sparkSession, "repair")
    known = conversations.groupBy(_key().alias("key")).agg(F.first("conv_id").alias("conv_id"))
    found = tables.write(known.join(_audited(_faults(rows), segment), "key", "left"), "audits")
    names = [c.split()[0] for c in STATS.split(", ")]
    heads = found.select("key", F.lit(0).alias("part"), "conv_id", *names)
    texts = rows.select(_key().alias("key"), F.lit(1).alias("part"), "turn", "role", F.sha2("text", 256).alias("digest"), "text", "copies")
    both = _in_order(heads.unionByName(texts, allowMissingColumns=True), "part")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, repaired, schema = None, None, None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("conv_id"), *[batch.schema.field(n) for n in names], pa.field("repaired_sha256", pa.string())])
            done = []
            for part, role, text, copies, conv_id, *stats in zip(*(batch.column(c).to_pylist() for c in ("part", "role", "text", "copies", "conv_id", *names))):
                if part == 0:
                    if head is not None:
                        done.append((*head, repaired.end()))
                    audit = stats[-1] or ""
                    head, repaired = (conv_id, *(v or 0 for v in stats[:-1]), audit), Repaired(audit)
                else:
                    for _ in range(copies):
                        repaired.take(role, text)
            if done:
                yield _batch(done, schema)
        if head is not None:
            yield _batch([(*head, repaired.end())], schema)

    return both.select("part", "role", "text", "copies", "conv_id", *names).mapInArrow(run, f"conv_id {kind}, {RESULT}")


def annotate(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation: its faults after damage, the cheapest repair and the digest of the repaired text."""
    return repair(damaged(conversations), conversations, segment)
