"""Small column helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space as the contracts list it: blank, tab to carriage return.
SPACE = "[ \\t-\\r]"
WORD = "[^ \\t-\\r]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_text(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


#: Matches whose places are added up one after the other; Spark copies what is gathered at each step, so longer blocks would cost their square.
BLOCK = 64


#: Code points before a match that are given with it.
CONTEXT = 24


def span_list(text: Column, pattern: str, keep) -> Column:
    """Spans of all leftmost non-overlapping matches that pass ``keep(match)``: array of ``SPAN_LIST``, with up to ``CONTEXT``
    code points before the match (since the one before it) and the next one after it.

    Code points, end exclusive. The pieces between the matches come from
    ``split``, the matches from ``regexp_extract_all``; their lengths add up to
    the positions, in blocks of ``BLOCK`` matches, each with its start, so the time
    is linear; the text is never cut at a position. Rejected matches still use up
    their text. The pattern must not match the empty string.
    """
    pieces = F.split(text, pattern, -1)  # one more than there are matches
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def length(pair: Column) -> Column:
        return F.char_length(pair["p"]) + F.coalesce(F.char_length(pair["m"]), F.lit(0))

    def placed(block: Column, start: Column) -> Column:
        def step(acc, pair):
            return F.struct((acc["at"] + length(pair)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        def span(pair, at):
            begin = at + F.char_length(pair["p"])
            end = begin + F.char_length(pair["m"])
            return F.struct(begin.alias("start"), end.alias("end"), pair["m"].alias("match"), F.right(pair["p"], F.lit(CONTEXT)).alias("before"), pair["q"].alias("after"))

        # Numbers alone are gathered; the matches are joined to them afterwards.
        places = F.aggregate(block, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])
        return F.zip_with(block, places, span)

    def in_blocks(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda k: F.slice(pairs, k * BLOCK + 1, BLOCK))
        return whole(F.transform(blocks, lambda b: F.struct(b.alias("pairs"), F.aggregate(b, F.lit(0), lambda n, pair: n + length(pair)).alias("n"))))

    def whole(blocks: Column) -> Column:
        def step(acc, b):
            return F.struct((acc["at"] + b["n"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, lambda b, at: placed(b["pairs"], at)))

    def paired(x: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            following = F.concat(F.coalesce(F.get(x["pieces"], i + 1), F.lit("")), F.coalesce(F.get(x["found"], i + 1), F.lit("")))
            return F.struct(p.alias("p"), F.get(x["found"], i).alias("m"), F.left(following, F.lit(1)).alias("q"))

        return F.transform(x["pieces"], one)

    # Bound to names by ``transform`` of one element, so that pieces, matches and pairs are made once.
    pairs = F.transform(F.array(F.struct(pieces.alias("pieces"), found.alias("found"))), paired)
    spans = F.element_at(F.transform(pairs, in_blocks), 1)
    return F.filter(spans, lambda s: s["match"].isNotNull() & F.coalesce(keep(s["match"]), F.lit(False)))


SPAN_LIST = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of the structs in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
