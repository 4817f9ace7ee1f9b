import hashlib
import re
from collections import defaultdict

import pytest

from playloom.llm import bloom, exact_dedup, mixing

SPACE = "[\x20\x09-\x0d]"


def brute_groups(texts):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[hashlib.sha256(re.sub(SPACE, "", t or "").encode()).hexdigest()].append(i)
    out = {}
    for sha, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        out |= {i: (keep, len(ids), i == keep, sha) for i in ids}
    return out


def test_repeated_rows_and_null_ids(repeated, texts):
    rows = exact_dedup.annotate(repeated).collect()
    groups = brute_groups({i: t for i, t in texts.items() if i < 60})
    assert len(rows) == repeated.count()
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["keep_id"], r["group_size"]) == (groups[r["doc_id"]][0], 2 * groups[r["doc_id"]][1])


@pytest.mark.parametrize("blocks", [1, 4096])
def test_annotate_equals_brute_force(docs, texts, blocks):
    rows = exact_dedup.annotate(docs, max_blocks=blocks).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows} == brute_groups(texts)
    assert len(rows) == len(texts)


def test_dedup_keeps_one_row_of_each_text_with_all_columns(docs, repeated, texts):
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, x in brute_groups(texts).items() if x[2]}
    once = exact_dedup.dedup(repeated).collect()
    assert len(once) == len({x[3] for i, x in brute_groups(texts).items() if i < 60}) + 1


def test_a_full_filter_only_sends_more_rows_the_exact_way(docs):
    keys = exact_dedup.digests(docs)
    marked = bloom.marked(keys, "text_sha256", exact_dedup.repeated_filter(keys, "text_sha256", 8), 8, "again")
    groups = defaultdict(list)
    for r in marked.collect():
        groups[r["text_sha256"]].append(r["again"])
    assert all(all(flags) for flags in groups.values() if len(flags) > 1)
    assert not all(flags[0] for flags in groups.values() if len(flags) == 1)


def test_empty_tables(no_docs):
    assert exact_dedup.annotate(no_docs).count() == 0
    assert exact_dedup.dedup(no_docs).count() == 0
    assert mixing.annotate(no_docs).count() == 0
    assert mixing.mix(no_docs).columns == no_docs.columns


def water(sums):
    order = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    goal, fixed = {}, set()
    while True:
        rest = sum(sums.values()) - sum(3 * sums[s] for s in fixed)
        share = rest / max(1, sum(weight[s] for s in sums if s not in fixed))
        goal = {s: 3 * sums[s] if s in fixed else share * weight[s] for s in sums}
        above = {s for s in sums if s not in fixed and goal[s] > 3 * sums[s]}
        if not above:
            return goal
        fixed |= above


def test_targets_and_taken_words(docs, texts):
    rows = mixing.annotate(docs).collect()
    size = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in texts.items()}
    source = {i: ("b", "a", None)[i % 3] for i in texts}
    sums = {s: sum(size[i] for i in texts if source[i] == s) for s in ("a", "b", None)}
    goal = water(sums)
    taken = defaultdict(int)
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sums[s])
        assert r["target"] == pytest.approx(goal[s])
        assert r["taken"] in [k * r["size"] for k in range(4)]
        taken[s] += r["taken"]
    largest = {s: max(size[i] for i in texts if source[i] == s) for s in sums}
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in sums)
    assert sorted(rows) == sorted(mixing.annotate(docs.repartition(5)).collect())


def test_even_documents_meet_the_target_closely(spark):
    rows = [(i, "w " * (5 + i % 7), "en", f"s{i % 4}", "", "", "") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, size string, class string")
    out = mixing.allot(docs.select("doc_id", "source", mixing.n_words().alias("size"))).selectExpr("source", "target", "copies * size as t").groupBy("source", "target").sum("t").collect()
    assert all(abs(r[2] / r[1] - 1) < 0.002 for r in out)


def test_mix_repeats_documents_as_taken(docs):
    taken = {r["doc_id"]: r["taken"] for r in mixing.annotate(docs).filter("size > 0").collect()}
    counts = {r["doc_id"]: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
    sizes = {r["doc_id"]: r["size"] for r in mixing.annotate(docs).collect()}
    assert all(counts.get(i, 0) * sizes[i] == t for i, t in taken.items())


def test_inclusion_frequencies_follow_the_probabilities(spark):
    """60 sources of the same 240 sizes: how often a size is taken beyond its whole copies comes near its p."""
    sizes = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64] * 20
    rows = [(s * 1000 + k, f"s{s:03}", n) for s in range(60) for k, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.allot(docs, weights=(4, 7)).groupBy("source", "size").sum("copies").collect()
    total = sum(sizes)
    for parity, ratio in ((0, 8 / 11), (1, 14 / 11)):
        whole, rest = int(ratio), (ratio - int(ratio)) * total
        scale = next(c for c in (x / 10_000 for x in range(1, 20_000)) if sum(min(1, c * n**0.5) * n for n in sizes) >= rest)
        for n in set(sizes):
            mean = sum(r["sum(copies)"] for r in out if r["size"] == n and int(r["source"][1:]) % 2 == parity) / 600
            assert mean - whole == pytest.approx(min(1, scale * n**0.5), abs=0.06), (parity, n)


def test_ties_and_null_ids_in_the_mix(spark):
    """Equal rows: as many copies in each run; words near the target."""
    rows = [(None if k % 2 else 7, "a" if k % 5 else "b", 3) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    runs = [sorted((r["source"], r["copies"]) for r in mixing.allot(docs.repartition(n)).collect()) for n in (1, 3)]
    assert runs[0] == runs[1] and len(runs[0]) == 200
    taken = {source: sum(3 * c for s, c in runs[0] if s == source) for source in "ab"}
    assert taken == {"a": 240, "b": 360}  # of 600 words b would get 400, but three times its 120 is the limit
