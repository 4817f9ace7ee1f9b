"""Spelling variants: words one edit apart, found by merging light subtrees of an errata trie.

Words that occur often enough form a trie. At each branching node the child with
the most words is heavy; the words of the other, light children are merged into
the node's subtree three times: with the letter at the node skipped, replaced by
the heavy child's letter, and with that letter put before it. Where a merged word
coincides with a terminal, the two words are one edit apart; two light words that
agree after the replaced letter are so too. Each pair is found once, at the node
where the two words part. A word lies in at most log2(words) light subtrees.

Scale: the count of words is one aggregate with partial counts. The trie is cut
at nodes of more than ``GROUP`` words: their children, however deep, become
groups, and a group is built by one task. Which nodes are cut is found by a few
rounds of counts over the words that are still in too large groups; a round goes
straight to the next branching. A pair that parts inside a group is found there
without a shuffle; at cut nodes no child is heavy, and the skipped and replaced
words of all children meet by a shuffle on the errata word, whose groups have one
terminal or at most one word for each letter of the alphabet. Chains of forms are
followed by doubling; n grows at least fivefold along them, so five rounds do for
any long n.

Defined results: null texts have no words; a null doc_id counts as empty in the
hash; repeated rows count again; empty tables give no words; of the columns only
doc_id and text are read; very long runs are words like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playloom.llm.columns import whole_text
from playloom.shared import Tables

#: What a word is made of, and how long and frequent it is at least.
RUN, MIN_LENGTH, MIN_COUNT = "[A-Za-z\\u00C0-\\u00FF]+", 6, 5
#: One in so many pairs of document and run loses a letter.
DAMAGE = 199
#: A form has at least so many times the occurrences of its variant.
TIMES = 5
#: Words of one task's trie at most; larger subtrees are cut at their root.
GROUP = 20_000
#: The tables of cut nodes are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 10_000
#: Stands for any letter; no letter of a word.
ANY = "*"
NEAR = "word string, near long, best_n long, best string"


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the runs after damage that are long and frequent enough."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = F.regexp_extract_all(F.translate(whole_text(), upper, upper.lower()), F.lit(RUN), F.lit(0))
    long_runs = F.filter(runs, lambda run: F.octet_length(run) >= MIN_LENGTH)
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    rows = docs.select(name.alias("name"), F.explode(long_runs).alias("run")).filter(F.char_length("run") >= MIN_LENGTH)
    rows = rows.select("run", F.crc32(F.concat("name", "run")).alias("h"))
    cut = F.expr("concat(left(run, int(h % char_length(run))), substring(run, int(h % char_length(run)) + 2))")
    words = rows.select(F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_COUNT)


def shared_length(a: str, b: str) -> int:
    """Letters that two words share at their begin."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(k for k in range(n) if a[k] != b[k])


def branchings(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    """(depth, borders of the children) of each branching node of the trie of sorted distinct words, lower ones first."""
    open_: list[tuple[int, list[int]]] = []
    for i in range(1, len(words) + 1):
        depth = shared_length(words[i - 1], words[i]) if i < len(words) else -1
        begin = i - 1
        while open_ and open_[-1][0] > depth:
            own, borders = open_.pop()
            yield own, [*borders, i]
            begin = borders[0]
        if open_ and open_[-1][0] == depth:
            open_[-1][1].append(i)
        elif depth >= 0:
            open_.append((depth, [begin, i]))


def merged(words: list[str], counts: list[int]) -> tuple[list[int], list[tuple[int, str] | None]]:
    """For each of the sorted distinct words: its near words among them, and (-n, word) of the best one."""
    place = {word: k for k, word in enumerate(words)}
    near = [0] * len(words)
    best: list[tuple[int, str] | None] = [None] * len(words)

    def gain(k: int, number: int, other: tuple[int, str]) -> None:
        near[k] += number
        if best[k] is None or other < best[k]:
            best[k] = other

    def meet(k: int, errata: str) -> None:
        other = place.get(errata)
        if other is not None:
            gain(k, 1, (-counts[other], errata))
            gain(other, 1, (-counts[k], words[k]))

    for depth, borders in branchings(words):
        children = list(zip(borders, borders[1:]))
        if len(words[borders[0]]) == depth:  # a word ends here: a light child without a letter
            ended, children = borders[0], children[1:]
        else:
            ended = None
        heavy = max(children, key=lambda c: c[1] - c[0])
        letter = words[heavy[0]][depth]
        if ended is not None:
            meet(ended, words[ended] + letter)
        rest: dict[str, list[int]] = {}
        for child in children:
            if child == heavy:
                continue
            for k in range(*child):
                word = words[k]
                head, tail = word[:depth], word[depth + 1 :]
                if tail[:1] != word[depth]:  # else the two part further down
                    meet(k, head + tail)
                meet(k, head + letter + tail)
                meet(k, head + letter + word[depth:])
                if len(children) > 2:
                    rest.setdefault(tail, []).append(k)
        for alike in rest.values():
            if len(alike) > 1:
                ranked = sorted((-counts[k], words[k]) for k in alike)
                for k in alike:
                    gain(k, len(alike) - 1, ranked[ranked[0][1] == words[k]])
    return near, best


def _grouped(words: DataFrame, tables: Tables, group: int) -> DataFrame:
    """Words with the name of their group and the depths of the cut nodes above it."""

    parting = F.udf(lambda first, last: shared_length(first, last), "int")
    done: list[DataFrame] = []
    # Not a literal, on which the join with the cut nodes would lose its key.
    rest = words.select("word", "n", F.expr("left(word, 0)").alias("group"), F.array().cast("array<int>").alias("cuts"))
    while True:
        sizes = rest.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.min("word").alias("first"), F.max("word").alias("last"))
        large = tables.write(sizes.filter(F.col("size") > group).select("group", parting("first", "last").alias("depth")), "cut")
        number = large.count()
        if number == 0:
            done.append(rest)
            break
        if number <= BROADCAST_ROWS:
            large = F.broadcast(large)
        divided = tables.write(rest.join(large, "group", "left"), "groups")
        done.append(divided.filter("depth is null").drop("depth"))
        deeper = F.expr("left(word, depth + 1)").alias("group"), F.expr("array_append(cuts, depth)").alias("cuts")
        rest = divided.filter("depth is not null").select("word", "n", *deeper)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _inside(grouped: DataFrame) -> DataFrame:
    """Near words within each group."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("word")
        words, counts = group.column("word").to_pylist(), group.column("n").to_pylist()
        near, best = merged(words, counts)
        some = [k for k in range(len(words)) if near[k]]
        columns = [words[k] for k in some], [near[k] for k in some], [-best[k][0] for k in some], [best[k][1] for k in some]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "best_n", "best"])

    return grouped.select("group", "word", "n").groupBy("group").applyInArrow(build, NEAR)


def _across(grouped: DataFrame, words: DataFrame) -> DataFrame:
    """Near words that part at a cut node: skipped words that are words, and words alike but for one letter."""
    at = grouped.select("word", "n", F.explode("cuts").alias("depth")).filter(F.col("depth") < F.char_length("word"))
    head, tail = F.expr("left(word, depth)"), F.expr("substring(word, depth + 2)")
    skipped = at.filter(F.expr("substring(word, depth + 1, 1) <> substring(word, depth + 2, 1)")).select(F.concat(head, tail).alias("errata"), "word", "n")
    met = skipped.join(words.select(F.col("word").alias("errata"), F.col("n").alias("m")), "errata")
    # One row of each pair becomes one for each of its words.
    both = F.array(
        F.struct(F.col("word"), F.col("m").alias("best_n"), F.col("errata").alias("best")),
        F.struct(F.col("errata").alias("word"), F.col("n").alias("best_n"), F.col("word").alias("best")),
    )
    pairs = met.select(F.inline(both)).select("word", F.lit(1).cast("long").alias("near"), "best_n", "best")
    # At most one word for each letter.
    one = F.struct((-F.col("n")).alias("n"), F.col("word").alias("word"))
    alike = at.groupBy(F.concat(head, F.lit(ANY), tail).alias("errata")).agg(F.array_sort(F.collect_list(one)).alias("ranked")).filter(F.size("ranked") > 1)
    each = alike.select("ranked", F.posexplode("ranked").alias("rank", "own"))
    other = F.get("ranked", F.when(F.col("rank") == 0, 1).otherwise(0))
    singles = each.select(F.col("own.word").alias("word"), (F.size("ranked") - 1).cast("long").alias("near"), (-other["n"]).alias("best_n"), other["word"].alias("best"))
    return pairs.unionByName(singles)


def _roots(forms: DataFrame, tables: Tables) -> DataFrame:
    """(word, root): forms followed to the last, by doubling."""
    reached = tables.write(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = tables.write(reached.join(onward, "root", "left"), "roots")
        if moved.filter("next is not null").isEmpty():
            return reached
        tables.drop(reached)
        reached = moved.select("word", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame, group: int = GROUP, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words with their numbers (word, n)."""
    tables = Tables(words.sparkSession, "spelling")
    words = tables.write(words.select("word", "n"), "words")
    grouped = _grouped(words, tables, group)
    found = _inside(grouped).unionByName(_across(grouped, words))
    rank: Column = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    known = found.groupBy("word").agg(F.sum("near").alias("n_near"), rank.alias("best"))
    accepted = -F.col("best.n") >= times * F.col("n")
    rows = words.join(known, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(accepted, F.col("best.word")).alias("form"), F.when(accepted, -F.col("best.n")).alias("form_n"),
    )
    rows = tables.write(rows, "rows")
    roots = _roots(rows.filter("form is not null"), tables)
    out = tables.write(rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    tables.keep_last()
    return out


def annotate(docs: DataFrame) -> DataFrame:
    """One row per frequent word of the documents, with its near words, form and root."""
    return variants(word_counts(docs))
