"""Exact dedup, centroid clustering and lexical search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_data import ODD, documents, frame, with_clashes
from pyspark.sql import functions as F

from tidemark.llm import centroid_clustering as CC
from tidemark.llm import exact_dedup as ED
from tidemark.llm import lexical_search as LS

DOCS = "doc_id long, text string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- exact dedup -----------------------------------------------------------------
def brute_groups(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(FOLD)].append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        last = max(known, default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, last, len(ids), digest) for i in ids]
    return sorted(out, key=repr)


def exact_rows():
    long = "p" * 300  # shared prefix and length, other tails
    texts = ODD + ["ABC", "abc", "aBc", "ÄB", "äb", "Äb", long + "x1", long + "x2", long + "X1", "q" * 302, None, ""]
    return list(enumerate(texts)) + [(3, "ABC"), (None, "abc"), (None, "alone"), (900, "alone too"), (900, "twice"), (900, "twice")]


def test_exact_groups_by_brute_force(spark):
    rows = exact_rows()
    got = ED.digests(with_clashes(frame(spark, rows, DOCS))).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute_groups(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = exact_rows()
    monkeypatch.setattr(ED, "LEAST_BITS", 64)
    monkeypatch.setattr(ED, "MOST_BITS", 64)
    got = ED.digests(frame(spark, rows, DOCS)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute_groups(rows)


def test_exact_reads_survivors_only(spark):
    """Texts alone in their length, or in their prefix, are never hashed whole."""
    rows = [(1, "a"), (2, "bb"), (3, "cc"), (4, "ccc" * 200), (5, "ccc" * 199 + "ddd"), (6, "CC")]
    found = {r.id: r.digest for r in ED.classes(frame(spark, rows, DOCS)).collect()}
    assert found[1] is None and found[2] is None
    assert all(found[i] for i in (3, 4, 5, 6))


def test_exact_deduplicate_keeps_columns(spark):
    docs = with_clashes(frame(spark, exact_rows(), DOCS))
    out = ED.deduplicate(docs)
    assert out.columns == docs.columns
    texts = [(r.text or "").translate(FOLD) for r in out.select("text").collect()]
    assert sorted(texts) == sorted({(t or "").translate(FOLD) for _, t in exact_rows()})
    empty = frame(spark, [], DOCS)
    assert ED.deduplicate(empty).count() == 0 and ED.digests(empty).count() == 0


def test_exact_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Hot")).otherwise(
        F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = ED.digests(docs)
    assert got.where("kept").count() == 2001
    assert got.where("group_size = 1000 and keep_id = 2997").count() == 1000


# -- centroid clustering ------------------------------------------------------------
def brute_nearest(x, c):
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("seed,k,d,spread", [(0, 8, 64, 300), (1, 1, 5, 4), (2, 40, 3, 2), (3, 100, 16, 1 << 26), (4, 7, 1, 3)])
def test_nearest_centroid_by_brute_force(seed, k, d, spread):
    rng = np.random.default_rng(seed)
    c = rng.integers(-spread, spread + 1, (k, d))
    x = np.concatenate([rng.integers(-spread, spread + 1, (500, d)), c, np.repeat(c[:1], 3, axis=0)])
    c[-1] = c[0]  # a repeated centroid: the smaller number wins
    who, distance = CC.nearest(x, c)
    expected, least = brute_nearest(x, c)
    assert np.array_equal(who, expected) and np.array_equal(distance, least)


def test_search_passes_centroids_over(monkeypatch):
    """Few exact distances where means lie apart."""
    rng = np.random.default_rng(5)
    c = np.arange(50)[:, None] * 1000 + rng.integers(-5, 5, (50, 16))
    x = c[rng.integers(0, 50, 400)] + rng.integers(-50, 50, (400, 16))
    pairs = []
    exact = np.einsum
    monkeypatch.setattr(CC.np, "einsum", lambda s, a, b: pairs.append(len(a)) or exact(s, a, b))
    who, _ = CC.nearest(x, c)
    assert np.array_equal(who, brute_nearest(x, c)[0]) and sum(pairs) < 3 * len(x)


def brute_kmeans(rows, k, rounds, d):
    kept = []
    for vec_id, v in rows:
        if v is None or len(v) != d or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, [math.floor(1024 * x) for x in v]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), i) for i, m in enumerate(c))

    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in kept:
            held[nearest(v)[1]].append(v)
        for i, vs in held.items():
            c[i] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(vec_id, *nearest(v)[::-1]) for vec_id, v in kept]
    by = Counter()
    for _, i, dist in found:
        by[i] += dist
    return sorted(((i, n, dist, by[n], sum(by.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest())
                   for i, n, dist in found), key=repr)


def vectors():
    rng = random.Random(7)
    rows = [(i, [rng.gauss(i % 4, 0.3) for _ in range(6)]) for i in range(120)]
    rows += [(1, rows[1][1]), (5, rows[9][1]), (None, rows[3][1]), (500, None), (501, []), (502, [0.0] * 5), (503, [0.0] * 6),
             (504, [None] + [0.0] * 5), (505, [float("nan")] * 6), (506, [float("inf")] * 6), (507, [-0.0001] * 6)]
    return rows


def result(df):
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


VECS = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("k,rounds", [(8, 10), (3, 2), (1, 1), (8, 0)])
def test_clusters_by_brute_force(spark, k, rounds):
    df = with_clashes(frame(spark, vectors(), VECS))
    assert result(CC.cluster(df, k=k, rounds=rounds, dimensions=6)) == brute_kmeans(vectors(), k, rounds, 6)


def test_clusters_of_few_vectors(spark):
    rows = [(None, [1.0, 2.0]), (None, [3.0, 4.0]), (2, [3.0, 4.0])]
    assert result(CC.cluster(frame(spark, rows, VECS), dimensions=2)) == brute_kmeans(rows, 8, 10, 2)
    for none in ([], [(1, None)], [(1, [1e300, 0.0])]):
        out = CC.cluster(frame(spark, none, VECS), dimensions=2)
        assert out.count() == 0 and out.columns[:3] == ["vec_id", "cluster", "distance"]


# -- lexical search -------------------------------------------------------------------
def brute_terms(text):
    return re.findall(LS.TERM, (text or "").translate(FOLD))


def brute_search(docs, items, k=50):
    found = [(doc, Counter(brute_terms(text))) for doc, text in docs]
    found = [(doc, c) for doc, c in found if c]
    n_docs, total = len(found), sum(sum(c.values()) for _, c in found)
    frequency = Counter(t for _, c in found for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(brute_terms(text))
    out = []
    for item, asked in wanted.items():
        scores = []
        for doc, c in found:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[t] + 1)))
                    * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def ranked(df):
    return sorted((tuple(r[n] for n in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=repr)


def corpus(n=600):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(200)] + ["Übung", "übung", "日本", "don't", "x_y", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([3, 30, 200])))) for i in range(n)]
    docs += [(n + i, t) for i, t in enumerate(ODD)] + [(3, docs[3][1]), (None, docs[4][1]), (None, docs[5][1]), (n + 50, docs[7][1])]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(12)]
    items += [(1, "w1 w2 w3"), (None, "w5 W7"), (None, "w150"), (100, None), (101, ""), (102, "nowhere"), (103, "a 日本 ö"), (104, "w0 " * 500)]
    return docs, items


ITEMS = "item_id long, text string"


@pytest.mark.parametrize("k", [50, 3])
def test_search_by_brute_force(spark, k):
    docs, items = corpus()
    df = with_clashes(frame(spark, docs, DOCS)).repartition(3)
    assert ranked(LS.rank(df, with_clashes(frame(spark, items, ITEMS)), k=k)) == brute_search(docs, items, k)


def test_search_in_small_batches(spark):
    docs, items = corpus(150)
    out = LS.rank(frame(spark, docs, DOCS), frame(spark, items, ITEMS), k=7, batch_bytes=100)
    assert ranked(out) == brute_search(docs, items, 7)


def test_search_without_rows(spark):
    docs, items = corpus(20)
    none = frame(spark, [], DOCS), frame(spark, [], ITEMS)
    assert LS.rank(frame(spark, docs, DOCS), none[1]).count() == 0
    assert LS.rank(none[0], frame(spark, items, ITEMS)).count() == 0
    assert LS.rank(frame(spark, [(1, None), (2, "")], DOCS), frame(spark, items, ITEMS)).count() == 0


@pytest.mark.parametrize("share,window", [(0, 16), (1, 16), (1 / 16, 128), (0.3, 7)])
def test_hybrid_in_one_chunk(monkeypatch, share, window):
    """All lists long, all short, and between: chunk by chunk the same as brute force, and windows are skipped."""
    monkeypatch.setattr(LS, "LONG_SHARE", share)
    monkeypatch.setattr(LS, "WINDOW", window)
    docs, items = corpus()
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    found = [LS.terms(t or "") for _, t in docs]
    assert [[t.decode() for t in f] for f in found] == [brute_terms(t) for _, t in docs]
    n_docs, total = sum(map(bool, found)), sum(map(len, found))
    asked = sorted({t for _, text in items for t in LS.terms(text or "")})
    index = {t: i for i, t in enumerate(asked)}
    frequency = np.array([sum(t in set(f) for f in found) for t in asked])
    weights = LS.term_weights(n_docs, frequency)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= {index[t] for t in LS.terms(text or "")}
    got = []
    for item, lists in wanted.items():
        best = LS.Best(5)
        for start in range(0, len(docs), 250):
            part = docs[start:start + 250]
            postings = LS.Postings([t or "" for _, t in part], index, weights, n_docs, total)
            LS.search_chunk(postings, sorted(lists), best, np.array([i for i, _ in part]), np.zeros(len(part), dtype=bool))
        got += [(item, i + 1, d, s) for i, (d, s) in enumerate(zip(best.docs.tolist(), best.scores.tolist()))]
    assert sorted(got, key=repr) == brute_search(docs, items, 5)


def test_search_by_own_copy(spark):
    docs = documents(spark)
    some = docs.where("length(text) > 200").orderBy("doc_id").limit(3).select(F.col("doc_id").alias("item_id"), "text")
    first = LS.rank(docs, some, k=1).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(first) == 3
    for r in first:
        assert set(brute_terms(text[r.doc_id])) & set(brute_terms(text[r.item_id]))
