import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from playloom.llm import jaccard
from playloom.llm.words import chunks, hashed_words


def brute(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in held[x]:
                common[j] += j < i
        for j, n in common.items():
            if n and 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in texts}


def found(rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_components_equal_brute_force(docs, texts):
    assert found(jaccard.annotate(docs).collect()) == brute(texts)


def test_many_open_members_and_few_rounds(spark):
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(900)]
    bases = [[rng.choice(pool) for _ in range(rng.randint(12, 60))] for _ in range(5)]
    shared = [rng.choice(pool) for _ in range(25)]
    texts = {}
    for i in range(220):
        near = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = rng.choice(pool)
        texts[i] = " ".join((shared if i % 3 else []) + near)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want = brute(texts)
    for rounds, part in ((1, 400), (2, 1 << 20)):  # parts of a few sets, and all sets of a leader together
        assert found(jaccard.annotate(rows, rounds, part).collect()) == want


def test_a_list_of_thousands_of_open_members(spark):
    """All share 16 of 20 shingles, which is no link but puts them into one list; a few have a near copy."""
    common = " ".join(f"w{k}" for k in range(20))
    texts = {i: f"{common} a{i} b{i} c{i} d{i}" for i in range(5000)}
    want = {i: (20, i) for i in texts}
    for i in range(0, 5000, 400):
        texts[5000 + i] = f"{common} a{i} b{i} c{i} e{i}"
        want[5000 + i] = (20, i)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert found(jaccard.annotate(rows, part=30_000).collect()) == want


def test_a_very_long_text_and_a_very_long_word(spark):
    rng = random.Random(5)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(500_000))
    texts = {1: long, 2: long + " one more", 3: "x" * 3_000_000, 4: None}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = found(jaccard.annotate(rows).collect())
    assert {i: c for i, (_, c) in out.items()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert out[2][0] == out[1][0] + 2 and out[3][0] == 1 and out[4][0] == 0


def test_postings_without_a_partner_are_dropped():
    """Two lists of the same classes are one; a list of one class, or of classes of too different sizes, is none."""
    def place(n, at):
        return (n << 32) + at

    postings = [(5, 1, place(20, 2)), (5, 2, place(20, 0)), (6, 1, place(20, 0)), (6, 2, place(20, 1)), (7, 1, place(20, 3)), (8, 1, place(20, 4)), (8, 3, place(90, 4))]
    payload = np.array(postings, np.int64).T.copy().tobytes()
    name, key, at = jaccard.lists_of_bucket(np.empty(0, np.uint64), [payload, payload])
    assert len(set(name.tolist())) == 1
    assert sorted(zip(key.tolist(), at.tolist())) == [(1, place(20, 0)), (2, place(20, 0))]


def test_keep_one_leaves_one_of_each_component(docs, texts, repeated):
    """Also of rows that come again; the row without doc_id stays."""
    kept = jaccard.keep_one(docs.unionByName(repeated))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(None) == 1
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in brute(texts).values()})


def test_keep_one_tells_texts_of_one_doc_id_apart(spark, docs):
    one, two = "alpha beta gamma delta epsilon zeta", "eta theta iota kappa lambda mu"
    rows = [(5, one, "en", "b"), (5, two, "en", "a"), (6, two, "en", "a"), (5, one, "de", "a"), (7, None, "en", "a"), (7, "", "en", "b")]
    table = spark.createDataFrame([(i, t, lang, source, "x", "y", "z") for i, t, lang, source in rows], docs.schema)
    for parts in (1, 4):
        kept = sorted((r["doc_id"], r["text"] or "", r["lang"]) for r in jaccard.keep_one(table.repartition(parts)).collect())
        assert kept == [(5, one, "de"), (5, two, "en"), (7, "", "en")]


def test_empty_table(no_docs):
    assert jaccard.annotate(no_docs).count() == 0


def test_word_hashes_depend_on_the_word_alone():
    ((_, data, offsets),) = chunks(pa.array(["Ab cd\tAB é", None, "cd ab", ""]))
    words, first = hashed_words(data, offsets)
    assert first.tolist() == [0, 4, 4, 6, 6]
    assert words[0] == words[2] == words[5] and words[1] == words[4]
    assert len(np.unique(words)) == 3


def test_a_long_text_in_pieces_has_the_same_hashes(monkeypatch):
    from playloom.llm import words

    text = " ".join(["alpha", "be" * 40, "\t\n", "c"] * 50) + " " * 90
    ((_, data, offsets),) = chunks(pa.array([text]))
    whole = hashed_words(data, offsets)
    monkeypatch.setattr(words, "CHUNK_BYTES", 32)
    pieces = hashed_words(data, offsets)
    assert whole[0].tolist() == pieces[0].tolist() and whole[1].tolist() == pieces[1].tolist()
