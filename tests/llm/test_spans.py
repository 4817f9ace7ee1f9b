import hashlib
import random
import re

from pyspark.sql import functions as F

from playloom.llm import pii, secrets


def secret_spans(t):
    out = []
    rules = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    for k, (name, pattern, good) in enumerate(rules):
        out += [(m.start(), k, m.end(), name) for m in pattern.finditer(t or "") if good(m)]
    return [f"{n}:{a}:{b}" for a, _, b, n in sorted(out)]


def luhn(digits):
    x = [int(c) for c in reversed(digits)]
    return (sum(x[::2]) + sum(2 * v - 9 * (v > 4) for v in x[1::2])) % 10 == 0


def personal_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [f"{n}:{m.start()}:{m.end()}" for n, p, good in rules for m in re.finditer(p, t or "") if good(m)]


def check(rows, texts, spans, kinds):
    assert len(rows) == len(texts)
    for r in rows:
        base = spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), r["doc_id"]
        assert set(base) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in kinds] == [sum(b.startswith(k + ":") for b in base) for k in kinds]


def test_secrets_equal_brute_force(docs, texts):
    check(secrets.annotate(docs).collect(), texts, secret_spans, ("assign", "access", "hex"))


def test_personal_data_equals_brute_force(docs, texts):
    check(pii.annotate(docs).collect(), texts, personal_spans, ("email", "ip", "card", "phone"))


def test_looser_candidates_are_added_by_the_classifier(spark):
    text = "Call (212) 444-1234. Mr. John Smith, IBAN DE89 3704 0044 0532 0130 00"
    good = ["mail me: joe@site.org or call +1 (212) 555-7713, card 4111111111111111"] * 20
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*good, text])], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.annotate(rows).collect()}
    assert "local_phone:5:19" in spans[20] and "person:21:35" in spans[20]


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") is None
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [frozenset({"AKI", "KIA"})]
    assert secrets.trigram_query("abcd?e") == [frozenset({"abc", "bcd", "cde"}), frozenset({"abc", "bce"})]
    for rule in secrets.BASE_RULES[:2]:
        assert secrets.trigram_query(rule.pattern, rule.any_case)


def test_posting_lists_give_every_document_with_a_match(spark, texts):
    """Each rule's candidates are the rows that hold all trigrams of one of its ANDs, so they hold every match."""
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    index = secrets.TrigramIndex(rules)
    rows = [(0, i, t or "") for i, t in texts.items()] + [(1, i, f"gh{'p'}_{'a1' * 20} xoxb-{'1' * 12}") for i in range(3)]
    docs = spark.createDataFrame(rows, "split long, bit int, text string")
    lists = index.postings(docs.select("split", "bit", index.held(F.col("text")).alias("grams")))
    low = {(c, g): lambda t, c=c, g=g: g in (t.lower() if c else t) for c, g in index.grams}
    found = {r["split"]: r for r in index.candidates(lists).collect()}
    for k, rule in enumerate(rules):
        if index.queries[k] is None:
            continue
        for split in (0, 1):
            bits = found[split][f"rule_{k}"] or b""
            got = {8 * byte + j for byte, b in enumerate(bits) for j in range(8) if b >> j & 1}
            want = {i for s, i, t in rows if s == split and any(all(low[rule.any_case, g](t) for g in conj) for conj in index.queries[k])}
            assert got == want
            assert {i for s, i, t in rows if s == split and re.search(rule.pattern, t, re.I if rule.any_case else 0)} <= got


#: Each about 40,000 letters of one shape that a pattern may retry, recurse or gather on.
LONG = [
    piece * (40_000 // len(piece))
    for piece in (".c", "1.", "1 ", "x", "4", "eyJ", "0123456789abcdef", "AKIA", "password ", "(212) 444-1234 ", "DE89 3704 ", "Mr. John Smith ", "123-45-6789 ", "@", "+1 ", "a.b@c.de ")
]
LONG[0], LONG[2], LONG[3], LONG[6] = f"a@b{LONG[0]}", f"+1{LONG[2]}", f"token={LONG[3]}", f"{'a' * 24}g{LONG[6]}"


def test_very_long_texts_of_every_kind(spark):
    rows = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").repartition(len(LONG)).cache()
    texts = dict(enumerate(LONG))
    check(secrets.annotate(rows).collect(), texts, secret_spans, ("assign", "access", "hex"))
    check(pii.annotate(rows).collect(), texts, personal_spans, ("email", "ip", "card", "phone"))
    rows.unpersist()


def test_long_tokens_are_found_whole(spark):
    text = f"xoxb-{'1a' * 300} and ghp_{'Z9' * 40} end"
    spans = secrets.annotate(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    assert "chat_token:0:605" in spans and "forge_token:610:694" in spans


def test_recall_and_precision_of_the_added_kinds(spark):
    """Planted among base personal data: of each added kind nine of ten are found, of look-alikes one of ten at most."""
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def iban(code, n):
        body = digits(n - 4)
        check = 98 - int(body + "".join(str(ord(c) - 55) for c in code) + "00") % 97
        return f"{code}{check:02}{body}"

    plain = lambda: " ".join(rng.choice("the of river and a house was built near old stone mill".split()) for _ in range(8))
    good = {
        "local_phone": lambda: f"please call ({rng.randint(202, 980)}) {rng.randint(200, 999)}-{digits(4)} today",
        "national_id": lambda: f"his ssn {rng.randint(101, 649)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)} is on file",
        "iban": lambda: f"pay to account {iban(*rng.choice((('DE', 22), ('FR', 27), ('NL', 18), ('ES', 24))))} soon",
        "person": lambda: f"write to Mr. {rng.choice(pii.FORENAMES[:40])} Walker about it",
    }
    bad = {
        "local_phone": lambda: f"part 0{digits(2)}-000-{digits(4)} order",
        "national_id": lambda: f"order 000-{rng.randint(10, 99)}-{digits(4)} part",
        "iban": lambda: f"part {rng.choice('QXZ')}X{digits(2)} {digits(4)} {digits(4)} {digits(4)} build",
    }
    base = [f"mail me: joe{k}@site.org or call +1 (212) 555-77{k % 90 + 10}, host 10.1.2.{k % 200}, card 4111111111111111" for k in range(100)]
    rows = [("base", b) for b in base] + [(k, f"{plain()} {make()} {plain()}") for k, make in good.items() for _ in range(60)]
    rows += [(f"not {k}", f"{plain()} {make()} {plain()}") for k, make in bad.items() for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.annotate(docs).collect()}
    share = lambda name, kind: sum(f"{kind}:" in spans[i] for i, (k, _) in enumerate(rows) if k == name) / 60
    assert {k: share(k, k) >= 0.9 for k in good} == dict.fromkeys(good, True)
    assert {k: share(f"not {k}", k) <= 0.1 for k in bad} == dict.fromkeys(bad, True)


def test_empty_and_repeated(no_docs, repeated):
    assert secrets.annotate(no_docs).count() == 0 and pii.annotate(no_docs).count() == 0
    assert secrets.annotate(repeated).count() == repeated.count() == pii.annotate(repeated).count()
