import base64
import fnmatch
import hashlib
import random
import re
import time

import numpy as np
import tiktoken
from pyspark.sql import functions as F

from playloom.llm import bpe, topk, url_filter


def brute_topk(vectors, asks, k):
    ints = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in filter(asks, ints):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)}
    return out


def test_topk_equals_brute_force(spark):
    rng = random.Random(3)
    vectors = {i: [rng.uniform(-1, 1) for _ in range(8)] for i in range(600)}
    vectors |= {i: [0.5] * 8 for i in range(600, 700)}  # a very common vector
    vectors |= {700: None, 701: [], 710: [0.1] * 7 + [None], 720: [float("nan")] * 8, 730: [1.0, float("inf")] * 4, 740: [1.0, 2.0], 750: [3.0, 4.0]}
    rows = spark.createDataFrame([(i, v, "x") for i, v in vectors.items()], "vec_id long, embedding array<float>, score string")
    for size in (64, 8192):
        got = topk.search(rows, F.col("vec_id") % 10 == 0, k=5, block_rows=size, group_rows=40)
        assert {tuple(r) for r in got.collect()} == brute_topk(vectors, lambda i: i % 10 == 0, 5)
    assert topk.search(rows.filter("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_large_components_stay_exact():
    ids, v = np.arange(4), np.array([[1 << 40, 1], [1 << 40, 2], [-(1 << 40), 3], [5, 5]], np.int64)
    q, i, s = topk.search_block(ids[:1], v[:1] // (1 << 20), ids, v, 3)
    assert i == [1, 3, 2] and s[0] == (1 << 60)
    v[:, 0] = [-(1 << 63), -(1 << 63), (1 << 63) - 1, 0]
    q, i, s = topk.search_block(ids[:1], v[:1], ids, v, 3)
    assert i == [1, 3, 2] and s == [(1 << 63) - 1, v[0, 1] * 5, -(1 << 63)]


def test_approximation_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (200, 6))
    assert (topk.ApproximationFile(x).upper_bounds(x.astype(float)) >= x @ x.T).all()


def test_globs_match_as_fnmatch_does():
    rng = random.Random(5)
    globs = ["".join(rng.choice("ab?*c") for _ in range(rng.randint(1, 40))).replace("**", "*") for _ in range(60)]
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    hit = url_filter.GlobAutomaton(globs).match([w.encode() for w in words])
    assert (hit == [[fnmatch.fnmatchcase(w, g) for g in globs] for w in words]).all()
    slash = url_filter.GlobAutomaton(["*.b/**", "a?b", "**/x", "\\*a"]).match([b"a.b/c/d", b"a/q.b/c", b"a/b", b"q/w/x", b"*a", b"ba"])
    assert slash.tolist() == [[True, False, False, False], [False] * 4, [False] * 4, [False, False, True, False], [False, False, False, True], [False] * 4]


def judged(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("", "") if m is None else (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2])
    best = None
    for rule, verdict in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    block = host.startswith("ads.") or any(x in host + path for x in ("/ads/", "/adserver/", "/banners/"))
    return (host, path, best[0] if best else None, best[1] if best else "block" if block else "allow")


def test_urls_equal_brute_force(spark):
    urls = [None, "", "no scheme/en/", "http://example.com", "http://EXAMPLE.com/en/1", "https://www.example.com/en/x?u=http://a.net/es/", "x://a.b.net/es/", "x://net/fr/q", "x://anet/fr/"]
    urls += ["http://ads.example.org/", "http://evil.org/x.example.com/en/", "http://é.org/ads/1#f", "http://m.www.example.com/en/\n", "http://user@Example.COM:80/en/", "http://example.com/EN/", "http://a.net/" + "p" * 50_000] * 2
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}
    assert url_filter.judge(pages.filter("false")).count() == 0


def encoding():
    with open(bpe.production_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=bpe.production_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(docs, texts, no_docs):
    own = encoding()
    rows = bpe.annotate(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = own.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.annotate(no_docs).count() == 0 == bpe.encoded(no_docs).count()
    got = {r["doc_id"]: r["ids"] for r in bpe.encoded(docs.filter("doc_id < 20")).collect()}
    assert got == {i: own.encode_ordinary(t or "") for i, t in texts.items() if i < 20}


def test_bpe_on_odd_text_and_long_pieces():
    own, codec, rng = encoding(), bpe.codec(bpe.production_path(), bpe.production_pattern()), random.Random(2)
    odd = ["".join(rng.choice("ab '\n\t\xa0s.,1é \x1c　t're") for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    odd += ["".join(rng.choice(letters) for _ in range(3000)) for letters in ("ab", "a", "the ant", "!?.-")]
    assert [[int(x) for x in ",".join(s).split(",") if x] for s in codec.encode(odd)] == [own.encode_ordinary(t) for t in odd]
    small = bpe.Memo(2000)
    for k in range(200):
        (value,), = small.all([[str(k % 7)]], lambda keys: small.tell({x: x * 2 for x in keys}))
        small.rest()
        assert value == str(k % 7) * 2


def plain_bpe(ranks, piece):
    """Ids by rescanning all pairs for the lowest rank, leftmost, again and again."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while True:
        rank, k = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=(None, 0))
        if rank is None:
            return [ranks[part] for part in parts]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_bpe_merges_on_arrays_as_one_by_one(tmp_path):
    """Vocabularies of any order, where merges make pairs of lower rank too; lengths on both sides of SHORT."""
    rng = random.Random(8)
    for trial in range(6):
        tokens = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))).encode() for _ in range(700)})
        rng.shuffle(tokens)
        ranks = {token: rank for rank, token in enumerate([bytes((k,)) for k in range(256)] + tokens)}
        path = tmp_path / f"{trial}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(token) + b" %d\n" % rank for token, rank in ranks.items()))
        codec = bpe.Codec(str(path), bpe.production_pattern())
        short = ["".join(rng.choice("abc"[: rng.randint(1, 3)] + "dé"[: rng.randint(0, 2)]) for _ in range(rng.randint(1, bpe.SHORT // 2))).encode() for _ in range(400)]
        short += [b"a" * bpe.SHORT, b"ab" * (bpe.SHORT // 2)]
        assert codec.merge_short(short) == codec.merge(short) == [plain_bpe(ranks, piece) for piece in short]
        assert codec.merge_short([b"a"]) == [[ranks[b"a"]]]
        words = [letter * n for letter in ("a", "ab", "abc", "é") for n in (bpe.SHORT // 2, bpe.SHORT, bpe.SHORT + 1, 2 * bpe.SHORT)]
        got = [[int(x) for x in ids.split(",")] for ids in codec.pieces(words)]
        assert got == [[ranks[w.encode()]] if w.encode() in ranks else plain_bpe(ranks, w.encode()) for w in words]


def test_bpe_learns_new_words_together():
    """Texts of words never seen before take less time than merging those words one pair at a time."""
    codec, rng = bpe.Codec(bpe.production_path(), bpe.production_pattern()), random.Random(9)
    own, tries = encoding(), []
    for _ in range(3):
        new = [[" " + "".join(rng.choice(("th", "in", "er", "tion", "é", "q", "ou")) for _ in range(9)) for _ in range(500)] for _ in range(40)]
        texts, pieces = ["".join(x) for x in new], [word.encode() for x in new for word in x]
        begun = time.thread_time()
        ids = codec.encode(texts)
        between = time.thread_time()
        for begin in range(0, len(pieces), 2000):
            codec.merge(pieces[begin : begin + 2000])
        tries.append((between - begun) / (time.thread_time() - between))
        assert [[int(x) for x in ",".join(s).split(",")] for s in ids] == [own.encode_ordinary(t) for t in texts]
    assert min(tries) < 0.8, tries


def test_topk_of_one_id_with_several_vectors(spark):
    """The best score of each query and id counts, once."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.25, 0.0]), (3, [0.125, 0.0]), (0, [0.0, 1.0]), (4, [0.0, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(vectors, F.col("vec_id") == 0, k=3, block_rows=3).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 65536), (2, 4, 32768), (3, 2, 16384)]
