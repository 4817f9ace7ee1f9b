"""Secret scans behind a trigram inverted index, with DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query: an OR of ANDs of
trigrams that every match must hold. The index has a posting list for each
trigram of any query and each split of up to 32,768 rows: a bitmap of the rows
that hold it. ANDs intersect bitmaps, ORs join them; the rows left are a rule's
candidates, which alone are read again and verified by the regex. A rule without
a mandatory trigram (a run of hex digits) scans every row.

Scale: the first scan writes what each row holds (a few numbers); splits lie
within its partitions, so posting lists are made before the shuffle and are at
most 4 KB each. Texts of candidates alone are shuffled, picked by a Bloom filter
of bounded size. The number of trigrams depends on the rules alone.

Defined results: null text counts as empty and holds nothing; spans are code
points of the whole text, end exclusive, overlapping kinds all count; repeated
rows agree; rows with null doc_id are scanned like others; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as regex_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playloom.llm.bloom import is_set, passing
from playloom.llm.columns import joined_spans, span_list, whole_text
from playloom.shared import materialize

#: Most trigrams of one conjunction that are looked up; fewer still hold for every match.
GRAMS = 4
#: Most ways through a rule that are told apart; what would make more counts as a gap.
WAYS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    any_case: bool = False
    #: Shortest kept match, or group 2 of it.
    least: int = 1
    group: int = 0

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern

    def keep(self, match: Column) -> Column:
        part = F.regexp_extract(match, self.java, self.group) if self.group else match
        return F.char_length(part) >= self.least


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
#: What the method finds beside them.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
)


def literal_runs(parsed) -> list[list[str]]:
    """Ways through a parsed regex, each a list of literal runs with gaps between them."""
    ways = [[""]]

    def gap() -> None:
        for way in ways:
            if way[-1]:
                way.append("")

    def follow(branches: list[list[str]]) -> list[list[str]]:
        return [way[:-1] + [way[-1] + b[0]] + b[1:] for way in ways for b in branches]

    for op, arg in parsed:
        branches: list[list[str]] | None = None
        if op is ops.LITERAL:
            branches = [[chr(arg)]]
        elif op is ops.IN and len(arg) <= 6 and all(o is ops.LITERAL for o, _ in arg):
            branches = [[chr(a)] for _, a in arg]
        elif op is ops.SUBPATTERN:
            branches = literal_runs(arg[-1])
        elif op is ops.BRANCH:
            branches = [w for p in arg[1] for w in literal_runs(p)]
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            least, most, body = arg
            inner = literal_runs(body)
            if most == 1:
                branches = inner + ([[""]] if not least else [])
            elif least:
                branches = [[*w, ""] for w in inner]
        if branches is None or len(ways) * len(branches) > WAYS:
            gap()
        else:
            ways = follow(branches)
    return ways


def trigram_query(pattern: str, any_case: bool = False) -> list[frozenset[str]] | None:
    """OR of ANDs; None if some way through the regex has no trigram, so that the rule scans fully."""
    query = set()
    for way in literal_runs(regex_parser.parse(pattern)):
        grams = [run[k : k + 3] for run in way for k in range(len(run) - 2)]
        grams = list(dict.fromkeys(g.lower() if any_case else g for g in grams))
        if not grams:
            return None
        step = max(1, (len(grams) - 1) // (GRAMS - 1)) if len(grams) > GRAMS else 1
        query.add(frozenset(grams[::step][:GRAMS]))
    return sorted((q for q in query if not any(other < q for other in query)), key=sorted)


PLACES = "array<struct<start:int,end:int>>"
#: Rows of a split, the length of a posting list's bitmap.
SPLIT_BITS = 15


class TrigramIndex:
    """The trigrams that some rule asks for, numbered, and the rules' queries over those numbers."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern, r.any_case) for r in rules]
        self.grams = sorted({(r.any_case, g) for r, query in zip(rules, self.queries) for conj in query or () for g in conj})

    def held(self, text: Column) -> Column:
        """Numbers of the trigrams that a text holds."""
        low = F.lower(text)
        found = [F.when(F.contains(low if any_case else text, F.lit(gram)), F.lit(k)) for k, (any_case, gram) in enumerate(self.grams)]
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<int>")

    def terms(self) -> list[tuple[int, int, int, int]]:
        """(gram, rule, AND of the rule, number of grams of the AND)."""
        number = {gram: k for k, gram in enumerate(self.grams)}
        return [
            (number[rule.any_case, g], k, c, len(conj))
            for k, (rule, query) in enumerate(zip(self.rules, self.queries)) for c, conj in enumerate(query or ()) for g in sorted(conj)
        ]

    def postings(self, rows: DataFrame) -> DataFrame:
        """Posting lists (split, gram, bits) of rows (split, bit, grams)."""
        return rows.select("split", "bit", F.explode("grams").alias("gram")).groupBy("split", "gram").agg(F.bitmap_construct_agg("bit").alias("bits"))

    def candidates(self, postings: DataFrame) -> DataFrame:
        """For each split a bitmap ``rule_k`` of the candidates of each rule with a query; null where it has none."""
        terms = postings.sparkSession.createDataFrame(self.terms(), "gram int, rule int, conj int, n int")
        # One row for each trigram of the rules, so it is broadcast.
        ands = postings.join(F.broadcast(terms), "gram").groupBy("split", "rule", "conj", "n").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("met"))
        ors = ands.filter("met = n").groupBy("split", "rule").agg(F.bitmap_or_agg("bits").alias("bits"))
        return ors.groupBy("split").agg(*[F.max(F.when(F.col("rule") == k, F.col("bits"))).alias(f"rule_{k}") for k in range(len(self.rules))])


def spans_of(rule: Rule) -> Column:
    """All spans of a rule in ``text``."""
    # A shortest match that the regex alone can ask for: a full scan then rejects most rows in one search.
    again = F.col("text").rlike(rule.java[:-1] + f"{{{rule.least},}}") if rule.java.startswith("[") and rule.java.endswith("]+") else F.lit(True)
    spans = F.transform(span_list(F.col("text"), rule.java, rule.keep), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(again, spans).otherwise(F.array().cast(PLACES))


def found(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id and, for each rule, the array of its spans under the rule's kind."""
    index = TrigramIndex(rules)
    asked = [k for k, query in enumerate(index.queries) if query is not None]
    full = [r for r, query in zip(rules, index.queries) if query is None]
    none = F.array().cast(PLACES)
    texts = docs.select("doc_id", whole_text().alias("text")).withColumn("key", F.xxhash64("text"))
    scan = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", index.held(F.col("text")).alias("grams"), *[spans_of(r).alias(r.kind) for r in full])
    scan = materialize(scan.withColumn("split", F.shiftright("row", SPLIT_BITS)).withColumn("bit", F.col("row").bitwiseAND((1 << SPLIT_BITS) - 1).cast("int")), "secret-rows")
    lists = materialize(index.candidates(index.postings(scan)), "secret-candidates")
    flags = [F.coalesce(is_set(F.col(f"rule_{k}"), F.col("bit")), F.lit(False)).alias(f"is_{k}") for k in asked]
    some = F.lit(False)
    for k in asked:
        some = some | F.col(f"is_{k}")
    marked = scan.drop("grams").join(lists, "split", "left").select("doc_id", "key", *[r.kind for r in full], *flags).withColumn("candidate", some)
    marked = materialize(marked, "secret-marked")
    chosen = marked.filter("candidate").select("doc_id", "key", *[f"is_{k}" for k in asked]).dropDuplicates(["doc_id", "key"])
    wanted = chosen.withColumnRenamed("doc_id", "chosen_id").withColumnRenamed("key", "chosen_key")
    read = passing(texts, chosen, "key").join(wanted, F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("key") == F.col("chosen_key")))
    verified = read.select("chosen_id", "chosen_key", *[F.when(F.col(f"is_{k}"), spans_of(rules[k])).otherwise(none).alias(rules[k].kind) for k in asked])
    verified = materialize(verified.dropDuplicates(["chosen_id", "chosen_key"]), "secret-verified")
    kinds = [r.kind for r in rules]
    with_spans = marked.filter("candidate").join(verified, F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("key") == F.col("chosen_key")))
    without = marked.filter("not candidate").select("doc_id", *[F.col(r.kind) if r in full else none.alias(r.kind) for r in rules])
    return with_spans.select("doc_id", *kinds).unionByName(without)


def annotate(docs: DataFrame, more: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def ordered(rules) -> Column:
        def named(order: int, rule: Rule) -> Column:
            return F.transform(rule.kind, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))

        return joined_spans(F.array_sort(F.concat(*[named(k, r) for k, r in enumerate(rules)])))

    rows = found(docs, BASE_RULES + more)
    counts = [F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return rows.select("doc_id", *counts, F.sha2(ordered(BASE_RULES), 256).alias("base_sha256"), ordered(BASE_RULES + more).alias("spans"))
