"""Operators 11 to 13 against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from playloom.llm import packing, repair, spelling

CONVERSATIONS = "conv_id long, turn long, role string, text string, KEY string, part string, codes string"


# Operator 11


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_variants(counts, times=5):
    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out)


def brute_words(texts):
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    letters = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | {chr(c) for c in range(0xC0, 0x100)}
    found = Counter()
    for doc_id, text in texts:
        for run in "".join(c if c in letters else " " for c in (text or "").translate(upper)).split():
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("abé", max_size=5), st.integers(5, 200), min_size=1, max_size=40))
def test_merged_subtrees_find_each_pair_once(counts):
    words = sorted(counts)
    near, best = spelling.merged(words, [counts[w] for w in words])
    for w, number, one in zip(words, near, best):
        others = [v for v in words if v != w and one_edit(w, v)]
        assert number == len(others)
        assert one == min(((-counts[v], v) for v in others), default=None)


@pytest.fixture(scope="module")
def letters():
    """Words over few letters, so that most have near words; chains of forms; a family of words with one long begin."""
    rng = random.Random(3)
    counts = {"".join(rng.choice("abÿ") for _ in range(rng.randint(6, 8))): 5 + int(rng.paretovariate(0.6)) % 5000 for _ in range(400)}
    counts |= {"common" * 5 + "".join(rng.choice("xyz") for _ in range(4)): rng.randint(5, 60) for _ in range(60)}
    counts |= {"chainaaa": 5, "chainaab": 30, "chainabb": 200, "chainbbb": 1500, "chainbb": 8000, "x" * 4000: 6, "x" * 4001: 40, "x" * 3999 + "y": 300}
    return counts


@pytest.mark.parametrize("group", [5, 60, 20_000])
def test_variants(spark, letters, group):
    words = spark.createDataFrame([(w, n) for w, n in letters.items()], "word string, n long")
    got = sorted(tuple(r) for r in spelling.variants(words, group).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == brute_variants(letters)


def test_words_of_documents(spark, docs, texts, no_docs, repeated):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdÉß×") for _ in range(rng.randint(5, 9))) for _ in range(80)]
    more = [(k, " ".join(rng.choice(pool) + rng.choice(["", ".", "'s", "7"]) for _ in range(60))) for k in range(900, 1000)] + [(None, "alones alones alones alones alones")]
    table = docs.unionByName(spark.createDataFrame([(i, t, "en", None, "x", "y", "z") for i, t in more], docs.schema))
    wanted = brute_words([*texts.items(), *more])
    assert {r["word"]: r["n"] for r in spelling.word_counts(table).collect()} == wanted
    assert sorted(tuple(r) for r in spelling.annotate(table).select("word", "form", "root", "n", "n_near", "form_n").collect()) == brute_variants(wanted)
    twice = brute_words([(i, t) for i, t in texts.items() if i < 60] * 2 + [(None, "alone")])
    assert {r["word"]: r["n"] for r in spelling.word_counts(repeated).collect()} == twice
    assert spelling.annotate(no_docs).collect() == []


# Operator 12


def cheapest(rows):
    """(cost, audit, repaired rows) by best-first search; rows are (role, text, must go, truncated)."""
    due = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    allowed = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, out = heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, out
        if (at, last) in seen:
            continue
        seen.add((at, last))
        heappush(heap, (cost + 3, audit + "I", at, due[last][0], (*out, f"{due[last]}:")))
        if at < len(rows):
            role, text, must_go, truncated = rows[at]
            heappush(heap, (cost + 4, audit + "D", at + 1, last, out))
            if not must_go:
                if (last, role[:1]) in allowed:
                    heappush(heap, (cost + 3 * truncated, audit + "K", at + 1, role[:1], (*out, f"{role}:{text}")))
                heappush(heap, (cost + 3 + 3 * truncated, audit + "R", at + 1, due[last][0], (*out, f"{due[last]}:{text}")))
    raise AssertionError


def brute_repair(table):
    by = defaultdict(list)
    for conv, turn, role, text in table:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        row = (turn is not None, turn or 0), "user" if kind == 4 else role, hashlib.sha256(text.encode()).hexdigest(), turn, text
        by[conv].extend([row] * {0: 0, 3: 2}.get(kind, 1))
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: r[:3])
        seen, judged, counts = set(), [], Counter()
        for _, role, _, turn, text in rows:
            blank, cut = not text.strip(" \t\n\x0b\x0c\r"), text.strip(" \t\n\x0b\x0c\r")[-1:] not in (".", "!", "?")
            again = (role, text) in seen
            seen.add((role, text))
            counts["blank" if blank else "duplicate" if again else "truncated" if cut else "none"] += 1
            judged.append((role, text, blank or again, cut and not blank and not again))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        turns = {r[3] for r in rows if r[3] is not None}
        cost, audit, repaired = cheapest(judged)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("DsuaxSUAX", max_size=9), min_size=1, max_size=5), st.integers(1, 4))
def test_audits_of_segments(conversations, segment):
    wanted = [cheapest([(c.lower(), "", c == "D", c.isupper()) for c in codes])[:2] for codes in conversations]
    assert repair.audits(conversations, segment) == wanted


def conversation_rows():
    rng = random.Random(11)
    says = ["Yes.", "No?", "well ", "", " \t", "a.b", "Done! \n", "größer.", None]
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(0, 9)):
            rows.append((conv, rng.choice([turn] * 12 + [turn + 1, None]), rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"]), rng.choice(says)))
    rows += [(None, turn, "user", "Same.") for turn in range(5)] + [(500, 3, "user", "Again.")] * 40 + [(501, None, None, None)]
    rows += [(502, turn, ("user", "assistant")[turn % 2 if turn % 50 else 0], f"Row {turn}.") for turn in range(1500)]
    return rows


@pytest.mark.parametrize("segment", [4, 512])
def test_repair(spark, segment):
    rows = conversation_rows()
    table = spark.createDataFrame([(*r, "k", "p", "c") for r in rows], CONVERSATIONS).repartition(5)
    got = {r[0]: tuple(r[1:]) for r in repair.annotate(table, segment).collect()}
    assert set(got) == {r[0] for r in rows}
    assert got == brute_repair(rows)


def test_conversations_without_rows(spark):
    assert repair.annotate(spark.createDataFrame([], CONVERSATIONS)).collect() == []
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(dropped, 0, "user", "x.", "k", "p", "c")], CONVERSATIONS)
    assert [tuple(r) for r in repair.annotate(table).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# Operator 13


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_tokenizer(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)
    own, rng = packing.Encoder(packing.production_path()), random.Random(2)
    assert own.fast is not None
    letters = "ab é漢\n\t '!?1ś‍  　\u0085ΩЖ'réll"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(3000)]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a{c}b{c}{c}1 {c}!  {c}\t" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    texts += ["", "x  <|endoftext|> y", "don't  stop"]
    for text, wanted in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert memoryview(own.encode(text)).cast("I").tolist() == wanted.ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=120), st.integers(0, 5))
def test_islands_only_improve(lengths, seed):
    single = [[k] for k in range(len(lengths))]
    greedy = packing.Packing([], []).best_fit(sorted(range(len(lengths)), key=lambda k: -lengths[k]), lengths, 100)
    best = packing.evolved(lengths, [single], 100, str(seed))
    assert sorted(k for own in best.bins for k in own) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in own) + room == 100 and room >= 0 for own, room in zip(best.bins, best.room))
    assert len(best.bins) <= len(greedy.bins)
    assert len(packing.evolved(lengths, [best.bins], 100, str(seed + 1)).bins) <= len(best.bins)


def test_evolution_beats_greedy_packing():
    """Triples that fill a bin exactly, where the greedy packing wastes room."""
    greedy = evolved = 0
    for seed in range(12):
        rng, lengths = random.Random(seed), []
        for _ in range(40):
            first = rng.randint(380, 490)
            second = rng.randint(250, 1000 - first - 250)
            lengths += [first, second, 1000 - first - second]
        rng.shuffle(lengths)
        greedy += len(packing.Packing([], []).best_fit(sorted(range(120), key=lambda k: -lengths[k]), lengths, 1000).bins)
        evolved += len(packing.evolved(lengths, [], 1000, str(seed)).bins)
    assert 12 * 40 <= evolved < greedy


def check_packing(rows, ids_of, capacity):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, found in by_doc.items():
        wanted = Counter()
        for ids in ids_of[doc_id]:
            cut = [len(ids)] if len(ids) <= capacity else [n for n in (len(ids) % capacity, *[capacity] * (len(ids) // capacity)) if n]
            starts = [sum(cut[:k]) for k in range(len(cut))]
            wanted.update((k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(zip(starts, cut)))
        assert Counter(found) == wanted
    return len(by_sequence)


@pytest.mark.parametrize(("capacity", "shard"), [(2048, 8192), (64, 30)])
def test_packing(spark, docs, texts, tokenizer, capacity, shard):
    ids_of = {i: [tokenizer.encode(t or "", add_special_tokens=False).ids + [0]] for i, t in texts.items()}
    rows = packing.annotate(docs, capacity=capacity, shard=shard).collect()
    assert set(rows[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    sequences = check_packing(rows, ids_of, capacity)
    least = -(-sum(r["length"] for r in rows) // capacity)
    assert least <= sequences <= least * 1.02 + 1


def test_packing_of_repeats_and_nothing(spark, repeated, texts, no_docs, tokenizer):
    ids_of = defaultdict(list)
    for r in repeated.select("doc_id", "text").collect():
        ids_of[r["doc_id"]].append(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0])
    check_packing(packing.annotate(repeated).collect(), ids_of, 2048)
    assert packing.annotate(no_docs).collect() == []


def test_sequences_hold_the_ids(spark, docs, texts, tokenizer):
    found = packing.sequences(docs, capacity=512, shard=50).collect()
    assert all(len(r["ids"]) <= 512 for r in found)
    counted = Counter(k for r in found for k in r["ids"])
    assert counted == Counter(k for t in texts.values() for k in tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
