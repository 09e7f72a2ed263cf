"""Operators that compare rows: 4, 5, 7, 9, 10, and the pipeline."""

import hashlib
import itertools
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from llm_data import ODD, documents, frame, with_clashes  # noqa: E402

from tidemark.llm import bpe, near_dedup, nearest, packing, suffix_dedup, topk_search, vector_blocks  # noqa: E402

# ---- 4: packing


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_covers_every_rank_once(histogram):
    slots = packing.plan(histogram, 64)
    ranks, room = defaultdict(list), defaultdict(list)
    for length, rank, n, sequence, offset, per in slots:
        for r in range(n):
            ranks[length].append(rank + r)
            room[sequence + r // per].append((offset + r % per * length, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for filled in room.values():
        at = 0
        for offset, length in sorted(filled):
            assert offset == at
            at += length
        assert at <= 64
    # as many sequences as best fit, item by item, longest first
    left = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [(r, i) for i, r in enumerate(left) if r >= length]
            if fits:
                left[min(fits)[1]] -= length
            else:
                left.append(64 - length)
    assert len(room) == len(left)


def check_packing(rows, capacity, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.vocabulary_path())
    streams = Counter()
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        n = len(ids)
        first = (n - 1) % capacity + 1
        for k, (a, b) in enumerate(itertools.pairwise([0, *range(first, n + 1, capacity)])):
            streams[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == streams
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r["length"] for r in rows) // capacity)


def test_packing_documents(spark):
    docs = documents(spark)
    used, least = check_packing(packing.pack(docs).collect(), 2048, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert used <= least + 2


def test_packing_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "x"), (4, "a"), (4, "a")]
    df = with_clashes(frame(spark, rows, "doc_id long, text string"))
    check_packing(packing.pack(df, capacity=64).collect(), 64, rows)
    assert packing.pack(df.limit(0)).count() == 0


# ---- 5 and 10: vectors


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, dim))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def best_by_brute_force(rows, score):
    out = {}
    for i, v in rows.items():
        if i % 50 == 0:
            found = sorted(((-score(v, w), j) for j, w in rows.items() if j != i and len(w) == len(v)))[:5]
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return {i: v for i, v in out.items() if v}


def usable(rows, zero):
    return {i: [float(np.float32(x)) for x in v] for i, v in rows if i is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))}


ODD_VECTORS = [(100_000, None), (100_050, [None] * 8), (100_100, [float("nan")] * 8), (100_150, [0.0] * 8), (None, [1.0] * 8),
               (100_200, [float("inf")] + [0.0] * 7), (100_250, []), (100_300, [1.0, 2.0]), (100_301, [3.0, 1.0]),
               (-50, [0.1] * 8), (100_350, [0.1] * 8), (100_351, [0.1] * 8), (100_352, [0.1] * 8)]


@pytest.mark.parametrize("block", [64, 8192])
def test_topk_exact(spark, monkeypatch, block):
    monkeypatch.setattr(vector_blocks, "BLOCK_ROWS", block)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(700, 8, 1))] + ODD_VECTORS + [(7, [9.0] * 8)]
    df = with_clashes(frame(spark, rows[:-1] + [rows[50], rows[51]], "vec_id long, embedding array<float>"))
    got = defaultdict(list)
    for r in topk_search.search(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in usable(rows[:-1], True).items()}
    assert dict(got) == best_by_brute_force(whole, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))


def test_topk_stops_early_and_stays_exact():
    rng = np.random.default_rng(3)
    x = np.floor(rng.standard_normal((4000, 4)) ** 3 * 50)
    q = np.floor(rng.standard_normal((30, 4)) ** 3 * 50)
    ids = np.arange(4000)
    for i, at, scores in topk_search.top_inner_products(np.arange(9000, 9030), q / 256, ids, x / 256, 5):
        exact = x @ q[i]
        want = np.lexsort([ids, -exact])[:5]
        assert at.tolist() == want.tolist() and scores.tolist() == exact[want].astype(int).tolist()


@pytest.mark.parametrize("n,d,k,seed", [(700, 6, 5, 0), (60, 3, 5, 1), (21, 4, 5, 2), (3, 2, 5, 3), (500, 1, 1, 4), (400, 8, 3, 5)])
def test_topk_reads_lists_in_step(n, d, k, seed):
    """Partial sums over the stretches, rows dropped between them: the same as brute force, ties and own rows included."""
    rng = np.random.default_rng(seed)
    x = np.floor(rng.standard_normal((n, d)) ** 3 * 4)
    q = np.concatenate([x[:20], np.floor(rng.standard_normal((10, d)) * 9), np.zeros((1, d))])
    ids, q_ids = np.arange(n) * 3, np.concatenate([np.arange(len(x[:20])) * 3, np.arange(10 + 1) + 10_000])
    for i, at, scores in topk_search.top_inner_products(q_ids, q / 256, ids, x / 256, k):
        exact = x @ q[i]
        want = [r for r in np.lexsort([ids, -exact]) if ids[r] != q_ids[i]][:k]
        assert at.tolist() == want and scores.tolist() == exact[want].astype(int).tolist()


def test_topk_share_of_lists_read():
    """Where few rows stand out, queries stop before the lists end."""
    rng = np.random.default_rng(8)
    x = np.floor(rng.standard_normal((3000, 3)) ** 5 * 10)
    order = np.argsort(x, axis=0, kind="stable")
    lists = np.take_along_axis(x, order, axis=0)
    place = np.argsort(order, axis=0).astype(np.int32)
    q = np.abs(rng.standard_normal((40, 3)))
    read = [share for _, _, _, share in topk_search.read_lists(q, x, lists, place, np.full(40, -1), 5)]
    assert len(read) == 40 and np.mean(np.array(read) < 1) > 0.5


def test_topk_beyond_double_precision():
    x = np.array([[2.0 ** 40, 1.0], [2.0 ** 40, 2.0], [1.0, 1.0]])
    (_, at, scores), = topk_search.top_inner_products(np.array([9]), x[:1], np.arange(3), x, 2)
    assert at.tolist() == [1, 0] and scores.tolist() == [(1 << 63) - 1] * 2


def test_nearest_recall_and_scores(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(3000, 16, 2))]
    df = frame(spark, rows, "vec_id long, embedding array<float>")
    want = best_by_brute_force(usable(rows, False), _cosine)
    hits = total = 0
    for r in nearest.search(df).collect():
        total += 1
        hits += r["vec_id"] in {j for _, j, _ in want[r["query_id"]]}
        v = dict(rows)
        assert r["score"] == pytest.approx(_cosine(v[r["query_id"]], v[r["vec_id"]]), abs=1e-12)
    assert total == 5 * len(want) and hits >= 0.9 * total


def _cosine(a, b):
    a, b = np.array(a, dtype=np.float64), np.array(b, dtype=np.float64)
    return float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))


def test_nearest_odd_rows(spark):
    rows = ODD_VECTORS + [(i, [0.5] * 8) for i in range(400, 460)] + [(5, [1e-300] * 8), (6, [1e300] * 8)]
    df = with_clashes(frame(spark, rows + rows[:1] + rows[-3:-2], "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for r in nearest.search(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    equal = frame(spark, [(i, [0.5] * 8) for i in range(-60, 300)], "vec_id long, embedding array<double>")
    for r in nearest.search(equal).collect():  # all tie: smallest ids
        assert r["vec_id"] == [i for i in range(-60, -50) if i != r["query_id"]][r["rank"] - 1]
        assert r["score"] == pytest.approx(1)
    assert len(got[400]) == 5 and all(abs(r["score"] - 1) < 1e-12 for r in nearest.search(df).where("query_id = 400").collect())
    assert got[100_300] == [100_301] and 100_150 not in got and 100_000 not in got
    assert nearest.search(df.limit(0)).count() == 0 and topk_search.search(df.limit(0)).count() == 0


# ---- 9: repeated substrings


def removed_by_brute_force(rows):
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        for p in range(len(b) - 99):
            first.setdefault(b[p:p + 100], (d, p))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[b[p:p + 100]] != (d, p):
                gone[p:p + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substrings_by_brute_force(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdef é") for _ in range(3000))
    rows = [(0, base), (1, base[500:900] + "x" + base[100:300]), (2, None), (3, ""), (4, "a" * 1000), (5, "ab" * 600),
            (6, base[:99]), (7, base[5:105]), (8, "z" + base[5:104] + "y"), (9, base), (10, "a" * 150 + base[7:200] + "b" * 300),
            (11, base[1000:1130] * 2), (None, base[40:200]), (12, "same row " * 30), (12, "same row " * 30)]
    rows += [(20 + i, "".join(rng.choice("xyz ") for _ in range(rng.randrange(300))) + base[i * 31:i * 31 + 90 + i]
              + "".join(rng.choice("xyz ") for _ in range(50))) for i in range(40)]
    df = with_clashes(frame(spark, rows, "doc_id long, text string"))
    got = sorted((tuple(r) for r in suffix_dedup.digests(df).collect()), key=str)
    assert got == removed_by_brute_force(rows)
    cut = suffix_dedup.dedup(df)
    assert cut.columns == df.columns and cut.count() == len(rows)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[9] == texts[6] == "" and texts[2] is None and texts[12] == "same row "
    assert suffix_dedup.digests(df.limit(0)).count() == 0


def test_substrings_in_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = sorted((tuple(r) for r in suffix_dedup.digests(docs).collect()), key=str)
    assert got == removed_by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_long_texts_are_cut_into_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    text = rng.integers(97, 101, 5000, dtype=np.uint8)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    covered = np.zeros(5000, dtype=int)
    for _, low, _, start, run, anchor, _ in suffix_dedup.anchors(text, np.array([0, 5000])):
        for s, n, a in zip((start + low).tolist(), run.tolist(), (anchor + low).tolist(), strict=True):
            covered[s:s + n] += 1
            assert s + n - 1 <= a <= s + suffix_dedup.SPAN - 1
    assert (covered[:4901] == 1).all() and not covered[4901:].any()


# ---- 7: near duplicates


def classes_by_brute_force(rows, idf):
    """All pairs of texts; components of those that are similar enough."""
    texts = {}
    for d, t in rows:
        if t is not None:
            texts[t] = min(texts.get(t, (d is not None, d or 0)), (d is not None, d or 0))
    vec = []
    names = sorted(texts, key=lambda t: (texts[t], hashlib.md5(t.encode()).hexdigest()))
    for t in names:
        (_, _, _, ids, times), = near_dedup.shingles(pa.array([t]))
        vec.append((ids, near_dedup.weights(ids, times, idf)))
    parent = list(range(len(names)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(names)), 2):
        a, b = vec[i], vec[j]
        if min(len(a[0]), len(b[0])) * 2 > max(len(a[0]), len(b[0])) and near_dedup.weighted_jaccard(*a, *b) >= 0.8:
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    at = {t: i for i, t in enumerate(names)}
    return {t: (texts[names[root(at[t])]][1] if texts[names[root(at[t])]][0] else None) for t in names}


@pytest.mark.parametrize("pivots, block", [(near_dedup.PIVOTS, near_dedup.BLOCK), (1, 5)])
def test_near_duplicates_by_brute_force(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randrange(60, 160))] for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(ODD)]
    for k in range(180):
        copy = list(base[min(5, k // 6)])  # the last base has a large group
        for _ in range(rng.randrange(0, 8)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((100 + k, " ".join(copy)))
    rows += [(500 + i, " ".join(rng.choice(words) for _ in range(80))) for i in range(40)]
    rows += [(None, rows[30][1]), rows[40], rows[40], (900, rows[45][1].upper() + "."), (901, "one two"), (902, "one, two!")]
    df = with_clashes(frame(spark, rows, "doc_id long, text string")).repartition(3)
    idf = near_dedup.idf_table(near_dedup.keyed(df, "doc_id", "text"))
    want = classes_by_brute_force(rows, idf)
    text_of = defaultdict(list)
    for d, t in rows:
        text_of[d].append(t)
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by_digest = {hashlib.md5(t.encode()).hexdigest(): t for t in want}
    for r in got:
        for t in text_of[r["doc_id"]]:
            if t is None:
                assert r["class_key"] is None or len(text_of[r["doc_id"]]) > 1
            elif len(set(text_of[r["doc_id"]])) == 1:
                assert r["class_id"] == want[t], (r, want[t])
                assert want[by_digest[r["class_key"]]] == r["class_id"]
    kept = near_dedup.keep_representatives(df)
    assert kept.columns == df.columns
    assert kept.count() == len({r["class_key"] for r in got if r["class_key"]}) + sum(t is None for _, t in rows)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab1 é,\nÀ", max_size=40), max_size=8), st.integers(20, 200))
def test_shingles_by_definition(texts, piece):
    """Equal shingles of any two texts are equal tuples of words, wherever they stand."""
    import re

    def by_words(text):
        words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())
        return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()

    texts = [*texts, "a b " * 30, " ".join(texts)]
    name, seen = {}, {}
    old, near_dedup.PIECE = near_dedup.PIECE, piece
    try:
        got = [Counter() for _ in texts]
        for i, _, row, ids, times in near_dedup.shingles(pa.array(texts)):
            for r, s, n in zip(row.tolist(), ids.tolist(), times.tolist(), strict=True):
                got[i + r][s] = n
    finally:
        near_dedup.PIECE = old
    for g, text in zip(got, texts, strict=True):
        want = by_words(text)
        assert sorted(g.values()) == sorted(want.values())
        if len(want) == 1:
            (s, _), (w, _) = g.most_common(1)[0], want.most_common(1)[0]
            assert name.setdefault(s, w) == w and seen.setdefault(w, s) == s
    for (g, a), (h, b) in itertools.combinations(zip(got, texts, strict=True), 2):
        assert len(g.keys() & h.keys()) == len(by_words(a).keys() & by_words(b).keys())


def test_near_copies_beyond_ascii(spark):
    def words(text):
        ((_, _, _, ids, _),) = near_dedup.shingles(pa.array([text]))
        return len(ids) + 4

    assert words("“one” – two…three\u00a0four’s don’t five，six。") == 9
    assert words("naïve Ärzte हिन्दी straße e\u0301te ٣٤") == 6
    assert words("汉字 と仮名、ไทย") == 8
    rng = random.Random(8)
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9000)) + ("，" if i % 9 == 8 else "") for i in range(300))
    plain = " ".join(rng.choice(["house", "größe", "année", "river", "stone", "light", "mañana"]) + str(i) for i in range(80))
    rows = [(1, chinese), (2, chinese[:150] + "改" + chinese[151:]), (3, plain),
            (4, plain.replace(" ", "\u00a0", 30).replace(" ", " – ", 20)), (5, "全く別の文章です。ここには似た所がない。")]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_outlines_bound_the_overlap():
    rng = np.random.default_rng(1)
    for n in (20, 3000):
        a, b = (np.unique(rng.integers(0, 2 * n, n).astype(np.uint64)) for _ in range(2))
        ua, ub = rng.integers(1, 100_000 if n == 20 else 40, len(a)), rng.integers(1, 40, len(b))
        row = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
        o = near_dedup.outlines(2, row, np.concatenate([a, b]), np.concatenate([ua, ub]))
        _, i, j = np.intersect1d(a, b, return_indices=True)
        assert near_dedup.overlap_bound(o[0], o[1:])[0] >= np.minimum(ua[i], ub[j]).sum()


def test_samples_estimate_similarity():
    rng = np.random.default_rng(0)
    sampler = near_dedup.Sampler(np.full(near_dedup.BUCKETS, near_dedup.IDF_STEPS))
    agree = []
    for _ in range(40):
        ids = np.sort(rng.choice(1 << 40, 300, replace=False).astype(np.uint64))
        a, b = ids[:260], ids[40:]
        times_a, times_b = rng.integers(1, 4, 260), rng.integers(1, 4, 260)
        times_b[:220] = times_a[40:]
        rows = np.concatenate([np.zeros(260, np.int64), np.ones(260, np.int64)])
        s = sampler.sign(2, rows, np.concatenate([a, b]), np.concatenate([times_a, times_b]))
        agree.append((s[:, 0] == s[:, 1]).mean() - near_dedup.weighted_jaccard(a, times_a, b, times_b))
    assert abs(np.mean(agree)) < 0.03


# ---- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    rng = random.Random(9)
    words = ["the", "and", "of", "that", "with", "from", "this", "which", "there", "about", "house", "water", "light"]
    passage = " ".join(rng.choice(words) + str(i) for i in range(60))
    prose = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(prose)]
    rows += [(100, prose[3], "en", "s", 1), (101, None, None, None, None), (102, "12 34 56", None, "s", 8), (103, "", "en", "s", 0)]
    rows += [(110, prose[1][::-1] + passage + " cc dd mail me@x.org", "en", "s", 1), (111, prose[2][::-1] + passage + " ww vv", "en", "s", 1)]
    docs = with_clashes(frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long"))
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.cut_to_table(stage(spark, docs, ""), f"test-{name}")
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(seen["language_id"]) == {r[0] for r in rows} - {101, 102, 103}
    assert set(seen["near_dedup"]) == set(seen["language_id"]) - {100}
    assert passage in seen["suffix_dedup"][110] and passage not in seen["suffix_dedup"][111]
    assert "<EMAIL>" in seen["pii"][110] and "me@x.org" not in seen["pii"][110]
    packed = cp.STAGES[-1][1](spark, docs, "").collect()
    check_packing(packed, 2048, list(seen["pii"].items()))
    sizes = {r["doc_id"]: r["n_chars"] for r in docs.collect()}
    assert sizes[111] == len(seen["pii"][111]) and sizes[110] == len(seen["pii"][110])


def test_registered_queries_have_the_right_columns(spark):
    from tidemark.llm.queries import QUERIES

    want = {
        "op2_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op3_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op4_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op5_topk_search": ["query_id", "rank", "vec_id", "score"],
        "op6_main_text": ["page_id", "url", "text", "n_chars"],
        "op8_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op9_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op10_nearest": ["query_id", "rank", "vec_id", "score"],
    }
    for name, columns in want.items():
        assert QUERIES[name](spark, "/root/testdata/sf0.001").columns == columns
