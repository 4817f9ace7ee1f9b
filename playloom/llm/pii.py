"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans come from the base patterns and from looser ones. Five labelers
vote on each candidate (yes, no or abstain): a regex labeler (strict form), a
gazetteer labeler (known domains, calling codes, card issuers, countries with
their lengths, forenames), a context labeler (words before the span), and two on
the borders and the shape. Spark counts the vote patterns;
expectation-maximisation on those counts estimates each labeler's reliability
and a soft label for each pattern. The final span classifier never sees votes:
it is logistic in features of the span (length, shape) and of its surroundings
(the word before it, hashed, and the next character), each by kind, trained on
the soft labels. Base spans stay; a looser candidate is added if the classifier
accepts it.

Scale: one pass over the texts without a shuffle writes the candidates; counts
of vote patterns, at most 3**5 for each kind, and the ``MAX_PATTERNS`` most
frequent pairs of votes and features come to the driver, where EM and training
are plain arithmetic. The classifier is a column expression over a fixed table
of weights.

Defined results: null text counts as empty and holds nothing; spans are code
points of the whole text, end exclusive; without candidates nothing is trained;
repeated rows agree; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playloom.llm.columns import SPAN_LIST, joined_spans, span_list, whole_text
from playloom.shared import materialize


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 2).otherwise(1),
    )
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def _byte(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.char_length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


def _count(match: Column, low: int, high: int) -> Column:
    return F.char_length(_digits(match)).between(low, high)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Whether a match counts at all.
    keep: object
    #: A cheap test that every text with a match passes.
    hint: object
    base: bool = True


# Possessive repeats match what the plain ones do, without deep recursion or quadratic retries.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), lambda t: F.contains(t, F.lit("@"))),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: F.forall(F.split(m, r"\."), _byte), lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]")),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", lambda m: F.when(_count(m, 13, 19), _luhn(_digits(m))), lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: _count(m, 9, 15), lambda t: t.rlike(r"\+[0-9]")),
    Kind("local_phone", r"(?<![0-9+] ?|[0-9] [(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", lambda m: F.lit(True), lambda t: t.rlike(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"), False),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: F.lit(True), lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), False),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda m: F.lit(True), lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), False),
    Kind("person", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Madame|Monsieur|Señor|Señora)\.? [A-Z][a-z]{2,15} [A-Z][a-z]{2,20}", lambda m: F.lit(True), lambda t: t.rlike(r"M[rs]|Dr|Herr|Frau|M[ao]|Señ"), False),
)
BASE = tuple(k for k in KINDS if k.base)

#: Gazetteers (fixed values): frequent top-level domains, calling codes, IBAN lengths by country, frequent forenames.
TOP_DOMAINS = tuple(
    "com org net edu gov mil int info biz io co me tv app dev ai eu de fr es it uk ie nl be lu ch at pl cz sk hu ro bg gr pt dk se no fi is ee lv lt hr si rs ua ru"
    " tr il sa ae in pk bd lk cn jp kr tw hk sg my th vn id ph au nz za ng ke eg ma us ca mx br ar cl pe uy".split()
)
CALLING_CODES = tuple(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
#: All others have three digits and begin so.
CALLING_STEMS = tuple("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC",
}
IBAN_FORMS = tuple(f"{country}{n}" for n, countries in IBAN_LENGTHS.items() for country in countries.split())
FORENAMES = tuple(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa"
    " Anthony Margaret Mark Sandra Paul Ashley Steven Emily Andrew Donna Joshua Michelle George Carol Kevin Amanda Brian Melissa Edward Laura Peter Anna Hans Maria Klaus Ursula"
    " Wolfgang Petra Andreas Sabine Stefan Claudia Thorsten Julia Jan Katharina Pierre Marie Jean Nathalie Michel Isabelle Philippe Sylvie Jacques Camille Luc Claire Carlos Carmen"
    " Jose José Ana Antonio Manuel Lucia Lucía Javier Pilar Miguel Elena Luis Rosa Juan Isabel Pedro Teresa Diego Sofia Sofía Marco Giulia Luca Chiara".split()
)
YES_WORDS = r"(?i)\b(?:tel|phone|call|fax|mobile|mail|e-mail|contact|card|visa|host|address|iban|account|ssn|name|write|reach)\b"
NO_WORDS = r"(?i)\b(?:version|order|invoice|isbn|sku|part|section|release|build|id|no)\b"

LABELERS = ("form", "gazetteer", "context", "borders", "shape")


#: Slots of the hashed features, and how many pairs of votes and features train the classifier at most.
SHAPES, WORDS, MAX_PATTERNS = 32, 128, 20_000
#: Features of a candidate with their numbers of values.
FEATURES = {"length": 8, "shape_slot": SHAPES, "word": WORDS, "next": 3}


def _slot(value: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(slots)).cast("int")


def _features(match: Column, before: Column, after: Column) -> list[Column]:
    """In the order of FEATURES: log length; digits, capitals and small letters in runs; the last word before; what follows."""
    length = F.least(F.floor(F.log2(F.char_length(match))), F.lit(7)).cast("int")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(match, "[0-9]++", "9"), "[A-Z]++", "A"), "[a-z]++", "a")
    word = F.lower(F.regexp_extract(before, "([A-Za-z]++)[^A-Za-z]*$", 1))
    following = F.when(after.rlike("^[A-Za-z0-9]"), 2).when(after.rlike("^[^ \\t-\\r]"), 1).otherwise(0)
    return [length, _slot(F.substring(shape, 1, 64), SHAPES), _slot(word, WORDS), following.cast("int")]


def _mod_97(match: Column) -> Column:
    """The check sum of an IBAN: letters as 10 to 35, the first four characters last."""
    plain = F.upper(F.regexp_replace(match, " ", ""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _isin(value: Column, values: tuple[str, ...]) -> Column:
    return value.isin(*values)


def _votes(kind: Kind, match: Column, before: Column, after: Column) -> list[Column]:
    """One vote of each labeler, in the order of LABELERS."""
    digits = _digits(match)
    strict = {
        "email": match.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9][A-Za-z0-9-]*+\.)++[A-Za-z]{2,}$"),
        "ip": ~match.rlike(r"(?:^|\.)0[0-9]"),
        "card": match.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})$"),
        "phone": match.rlike(r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$"),
        "local_phone": ~match.rlike(r"^\(?[01]"),
        "national_id": ~match.rlike(r"^(?:000|666|9)|-00-|-0000$"),
        "iban": F.char_length(F.regexp_replace(match, " ", "")).between(15, 34),
        "person": match.rlike(r"^\S+ \S+ \S+$"),
    }[kind.name]
    listed = {
        "email": _isin(F.lower(F.regexp_extract(match, r"\.([A-Za-z0-9-]+)$", 1)), TOP_DOMAINS),
        "ip": ~match.rlike(r"^(?:0|127|255)\."),
        "card": match.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
        "phone": _isin(F.regexp_extract(match, r"^\+(1|7|[2-9][0-9])", 1), CALLING_CODES + CALLING_STEMS),
        "local_phone": ~digits.rlike(r"^(?:000|555|123)"),
        "national_id": F.lit(False),
        "iban": _isin(F.concat(F.substring(match, 1, 2), F.char_length(F.regexp_replace(match, " ", "")).cast("string")), IBAN_FORMS),
        "person": _isin(F.regexp_extract(match, r"^\S+ (\S+)", 1), FORENAMES),
    }[kind.name]
    return [
        _vote(strict, ~strict),
        _vote(listed, F.lit(kind.name not in ("national_id", "person")) & ~listed),
        _vote(before.rlike(YES_WORDS), before.rlike(NO_WORDS)),
        _vote(~before.rlike(r"[A-Za-z0-9]$") & ~after.rlike(r"^[A-Za-z0-9]"), F.lit(True)),
        _vote(_mod_97(match) == 1 if kind.name == "iban" else ~match.rlike(r"([0-9])\1{5}") & ~digits.rlike(r"^1?2345"), F.lit(True)),
    ]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and, for each kind, its candidate spans with the labelers' votes."""
    rows, text = docs.select("doc_id", whole_text().alias("text")), F.col("text")

    def judged(kind: Kind) -> Column:
        def one(s: Column) -> Column:
            named = zip([*LABELERS, *FEATURES], _votes(kind, s["match"], s["before"], s["after"]) + _features(s["match"], s["before"], s["after"]))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), *[v.cast("int").alias(n) for n, v in named])

        return F.transform(span_list(text, kind.pattern, kind.keep), one)

    none = "array<struct<start:int,end:int," + ",".join(f"{n}:int" for n in [*LABELERS, *FEATURES]) + ">>"
    return rows.select("doc_id", *[F.when(k.hint(text), judged(k)).otherwise(F.array().cast(none)).alias(k.name) for k in KINDS])


def pattern_counts(found: DataFrame) -> DataFrame:
    """kind, votes, features and how many candidates have them: written once for both reads of it."""
    spans = None
    for k in KINDS:
        one = found.select(F.explode(k.name).alias("s")).select(F.lit(k.name).alias("kind"), *[F.col(f"s.{n}").alias(n) for n in [*LABELERS, *FEATURES]])
        spans = one if spans is None else spans.unionByName(one)
    return materialize(spans.groupBy("kind", *LABELERS, *FEATURES).agg(F.count(F.lit(1)).alias("n")), "pii-patterns")


def vote_counts(patterns: DataFrame) -> list[tuple[str, tuple[int, ...], int]]:
    """(kind, votes, count) of all vote patterns: at most 3**5 rows a kind."""
    rows = patterns.groupBy("kind", *LABELERS).agg(F.sum("n").alias("n")).collect()
    return sorted((r["kind"], tuple(r[n] for n in LABELERS), r["n"]) for r in rows)


def frequent_patterns(patterns: DataFrame, most: int = MAX_PATTERNS) -> list[tuple[str, tuple[int, ...], tuple[int, ...], int]]:
    """(kind, votes, features, count) of the ``most`` most frequent."""
    names = ["kind", *LABELERS, *FEATURES]
    rows = patterns.orderBy(F.col("n").desc(), *names).limit(most).collect()
    return [(r["kind"], tuple(r[n] for n in LABELERS), tuple(r[n] for n in FEATURES), r["n"]) for r in rows]


def reliabilities(counts, rounds: int = 40) -> tuple[list[dict], list[float]]:
    """EM on vote patterns: P(vote | class) of each labeler, and a soft label for each pattern."""
    soft = [min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for _, v, _ in counts]
    chance: list[dict] = []
    for _ in range(rounds):
        chance = []
        for j in range(len(LABELERS)):
            table = {(c, v): 1.0 for c in (0, 1) for v in (-1, 0, 1)}
            for (_, votes, n), p in zip(counts, soft):
                table[1, votes[j]] += n * p
                table[0, votes[j]] += n * (1 - p)
            sums = {c: sum(table[c, v] for v in (-1, 0, 1)) for c in (0, 1)}
            chance.append({k: x / sums[k[0]] for k, x in table.items()})
        prior = {}
        for (kind, _, n), p in zip(counts, soft):
            yes, every = prior.get(kind, (1.0, 2.0))
            prior[kind] = (yes + n * p, every + n)
        soft = []
        for kind, votes, _ in counts:
            yes = prior[kind][0] / prior[kind][1]
            logit = math.log(yes / (1 - yes)) + sum(math.log(chance[j][1, v] / chance[j][0, v]) for j, v in enumerate(votes))
            soft.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))))
    return chance, soft


def _places(features) -> list[int]:
    """Which weights of a kind a candidate has: its bias and one for each feature."""
    out, begin = [0], 1
    for value, values in zip(features, FEATURES.values()):
        out.append(begin + value)
        begin += values
    return out


N_WEIGHTS = 1 + sum(FEATURES.values())


def train(counts, patterns, rounds: int = 200, rate: float = 0.5) -> np.ndarray:
    """Weights (kind, place) of the logistic span classifier on the soft labels of EM."""
    weights = np.zeros((len(KINDS), N_WEIGHTS))
    if not counts:
        return weights
    soft = {(kind, votes): p for (kind, votes, _), p in zip(counts, reliabilities(counts)[1])}
    order = {k.name: i for i, k in enumerate(KINDS)}
    kind = np.array([order[k] for k, _, _, _ in patterns])
    place = np.array([_places(f) for _, _, f, _ in patterns])
    label = np.array([soft[k, v] for k, v, _, _ in patterns])
    weight = np.log1p(np.array([n for _, _, _, n in patterns], float))
    total = np.bincount(kind, weight, len(KINDS))[kind]  # each kind counts alike
    squares = np.full_like(weights, 1e-8)
    for _ in range(rounds):
        z = weights[kind[:, None], place].sum(1)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * weight / total
        slope = 1e-4 * weights
        np.add.at(slope, (kind[:, None], place), error[:, None])
        squares += slope**2
        weights -= rate * slope / np.sqrt(squares)
    return weights


def accepted(kind: Kind, weights: np.ndarray, span: Column) -> Column:
    own = weights[KINDS.index(kind)].tolist()
    logit, begin = F.lit(own[0]), 1
    for name, values in FEATURES.items():
        logit = logit + F.element_at(F.array(*[F.lit(w) for w in own[begin : begin + values]]), span[name] + 1)
        begin += values
    return logit >= 0


def annotate(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (of all kinds)."""
    found = materialize(candidates(docs), "pii-candidates")
    patterns = pattern_counts(found)
    weights = train(vote_counts(patterns), frequent_patterns(patterns))

    def listed(kinds) -> Column:
        def named(kind: Kind) -> Column:
            spans = F.col(kind.name) if kind.base else F.filter(kind.name, lambda s: accepted(kind, weights, s))
            return F.transform(spans, lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

        return joined_spans(F.concat(*[named(k) for k in kinds]))  # each kind's spans already come by start

    counts = [F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE]
    out = found.select("doc_id", *counts, F.sha2(listed(BASE), 256).alias("base_sha256"), listed(KINDS).alias("spans"))
    return out.withColumn("n_spans", F.regexp_count("spans", F.lit("[^,]+")).cast("long"))
