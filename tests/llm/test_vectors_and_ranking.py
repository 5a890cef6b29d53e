"""Near-duplicate vectors, ranked search and hard negatives against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentloom.llm import embedding_dedup, hard_negatives, lexical

VECTORS = "vec_id long, embedding array<double>, label int, n_links string, x string, node string, rank string, id string, cell string, rows string"


def _table(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefg") for r in rows], VECTORS)


def _usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def _links(rows):
    """vec_id, n_links, component_id by all pairs."""
    width = max([len(v) for _, v, _ in rows if v] or [1])
    points = []
    for _, v, _ in rows:
        if not _usable(v) or not any(v):
            points.append(None)
            continue
        p = np.array(v + [0.0] * (width - len(v)))
        p = np.ldexp(p, -int(np.frexp(np.abs(p).max())[1]))
        points.append(p / np.sqrt(p @ p))
    near = {i: [j for j, q in enumerate(points) if j != i and p is not None and q is not None and p @ q >= 0.9] for i, p in enumerate(points)}
    out = []
    for i, (key, *_) in enumerate(rows):
        seen, open_ = {i}, [i]
        while open_:
            for j in near[open_.pop()]:
                if j not in seen:
                    seen.add(j)
                    open_.append(j)
        names = [rows[j][0] for j in seen if rows[j][0] is not None]
        first = min(names, default=None)
        out.append((key, len(near[i]), first, key is not None and key == first))
    return Counter(out)


def _clustered(seed, n, width, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, width))
    return [(i, (centres[r.integers(12)] + spread * r.normal(size=width)).tolist(), int(r.integers(4))) for i in range(n)]


AWKWARD = [
    (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 2), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 2), (7, [1.0, 2.0], 1), (7, [1.0, 2.0], 1),
    (8, [1.0, 2.0, 0.0], None), (9, [1e200, 2e200], 3), (10, [1e-200, 2e-200], 3), (11, [-1.0, -2.0], 1), (None, [1.0, 2.1], 1), (None, [5.0, -9.0], 1), (12, [9.0], 2), (13, [1.0, 2.0], 2),
]


@pytest.mark.parametrize(("width", "spread", "tile"), [(64, 0.2, 64), (64, 0.45, 64), (5, 0.1, 64), (200, 0.3, 128)])
def test_vector_links_against_all_pairs(spark, width, spread, tile):
    rows = _clustered(width, 700, width, spread)
    rows += [(1000 + i, rows[3][1], 0) for i in range(150)]  # copies
    got = embedding_dedup.near_duplicate_vectors(_table(spark, rows), tile=tile)
    assert Counter(map(tuple, got.collect())) == _links(rows)


def test_vector_links_on_awkward_rows(spark):
    got = embedding_dedup.near_duplicate_vectors(_table(spark, AWKWARD))
    assert Counter(map(tuple, got.collect())) == _links(AWKWARD)
    assert embedding_dedup.near_duplicate_vectors(_table(spark, [])).count() == 0
    assert [tuple(r) for r in embedding_dedup.near_duplicate_vectors(_table(spark, AWKWARD[:3])).orderBy("vec_id").collect()] == [(k, 0, k, True) for k in (1, 2, 3)]


def test_codes_bound_every_link_and_skip_most_pairs():
    r = np.random.default_rng(8)
    for width in (3, 64, 700):
        base = embedding_dedup.unit(r.normal(size=(400, width)))
        near = embedding_dedup.unit(base + r.normal(size=base.shape) * r.uniform(0, 0.6, (400, 1)) / math.sqrt(width))
        turned = embedding_dedup.rotated(near)
        assert np.allclose(turned @ turned.T, near @ near.T)
        codes, factors = embedding_dedup.encode(embedding_dedup.rotated(base))
        size = turned.shape[1]
        signs = (np.unpackbits(codes, axis=1, count=size) * 2.0 - 1) / math.sqrt(size)
        allowed = turned @ signs.T >= embedding_dedup.least_products(factors, size, 0.9, embedding_dedup.CONFIDENCE)[None, :]
        linked = near @ base.T >= 0.9
        assert allowed[linked].all() and linked.sum() >= 100
        if width > 3:
            assert allowed.mean() < 0.02


def test_estimates_are_unbiased():
    r = np.random.default_rng(9)
    base = embedding_dedup.unit(r.normal(size=(3000, 64)))
    other = embedding_dedup.unit(base + 0.05 * r.normal(size=base.shape))
    codes, factors = embedding_dedup.encode(embedding_dedup.rotated(base))
    signs = (np.unpackbits(codes, axis=1, count=64) * 2.0 - 1) / 8
    estimate = (embedding_dedup.rotated(other) * signs).sum(1) / factors
    assert abs((estimate - (base * other).sum(1)).mean()) < 0.005


def _terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def _ranks(docs, items, top):
    each = [(i, Counter(_terms(t))) for i, t in docs]
    each = [(i, c, sum(c.values())) for i, c in each if c]
    n_docs, length = len(each), sum(n for *_, n in each)
    having = Counter(t for _, c, _ in each for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in each:
            m = 75 + 25 * n * n_docs // length
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * having[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in Counter(_terms(text)).items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return Counter(out)


def _corpus(seed, n):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "ÉTÉ", "日本", "Straße", "A1", "a1", "x_y", "don't", " z"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    weights /= weights.sum()
    return [(i, " ".join(r.choice(vocabulary, r.choice([3, 3, 8, 30, 200]), p=weights))) for i in range(n)]


@pytest.mark.parametrize(("block", "first", "at_once"), [(8, 1, 4), (8192, 6, 2000)])
def test_ranks_against_brute_force(spark, block, first, at_once):
    docs = _corpus(1, 300) + [(500 + i, "w1 w2 É") for i in range(60)] + [(7, None), (8, ""), (9, "--"), (None, "w1 w2 É"), (None, "w1 w2 É"), (600, "w5 " * 20000), (601, "w1 w2 É"), (601, "w1 w2 É")]
    items = _corpus(2, 9) + [(20, None), (21, ""), (22, "nothing has it"), (3, "w1 W1 w2"), (None, "W3 日本 été")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("a")).withColumn("item_id", F.lit("b")).withColumn("m", F.lit("c"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("a")).withColumn("rank", F.lit("b")).withColumn("item", F.lit("c"))
    got = lexical.rank_documents(frame, asked, top=5, block=block, first=first, at_once=at_once)
    assert Counter(map(tuple, got.collect())) == _ranks(docs, items, 5)


def test_ranks_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank_documents(none, items).count() == 0
    assert lexical.rank_documents(none.union(spark.createDataFrame([(1, None)], "doc_id long, text string")), items).count() == 0
    assert lexical.rank_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_bounds_leave_blocks_out():
    block = lexical.Block(100, np.arange(4), np.array([1, 1, 2]), np.array([5, 1, 2]), np.array([0, 3, 3]))
    items = lexical.Items([0, 1], [[(1, 10), (2, 1)], [(9, 3)]])
    top = lexical.impacts(np.array([5, 2]), 100)
    assert items.bounds(block.heads).tolist() == [10 * top[0] + top[1], 0]
    ids, scores = block.best(items.wanted[0], 5, 0)
    assert ids.tolist() == [0, 3] and scores[0] == 10 * top[0]


def _negatives(rows, anchors, positives=5, negatives=3):
    width = max([len(v) for k, v, m in rows if v] or [1])
    whole = []
    for k, v, m in rows:
        if k is not None and m is not None and _usable(v):
            whole.append((k, m, [math.floor(256 * x) if abs(256 * x) < 2**53 else int(256 * x) for x in v] + [0] * (width - len(v))))
    out = []
    for a, (key, mark, x) in enumerate(whole):
        if not anchors(key):
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), k, m == mark) for b, (k, m, y) in enumerate(whole) if b != a]
        scored.sort()
        for s, p, _ in [c for c in scored if c[2]][:positives]:
            fit = [c for c in scored if not c[2] and 50 * -s <= 100 * -c[0] <= 95 * -s][:negatives]
            out += [(key, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit)]
    return Counter(out)


@pytest.mark.parametrize(("rows", "segment"), [
    (_clustered(3, 500, 16, 0.8), 50),
    (_clustered(4, 400, 3, 0.8), 10_000),
    ([(i, [float(i % 5 - 2), float(i % 3), 0.0], i % 3) for i in range(300)], 40),
    ([(i, [float((i % 7) * 2**20), float(i % 3 * 2**18)], i % 2) for i in range(60)], 20),
])
def test_negatives_against_brute_force(spark, rows, segment):
    rows = rows + [(10, rows[0][1], 1), (10, rows[0][1], 2), *[(2000 + i, rows[0][1], 2) for i in range(40)]]
    got = hard_negatives.mine_negatives(_table(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"), segment=segment)
    assert Counter(map(tuple, got.collect())) == _negatives(rows, lambda k: k % 10 == 0)


def test_negatives_on_awkward_rows(spark):
    rows = [r for r in AWKWARD if r[0] not in (9, 10)]
    got = hard_negatives.mine_negatives(_table(spark, rows), F.col("vec_id") % 1 == 0, F.col("label"))
    assert Counter(map(tuple, got.collect())) == _negatives(rows, lambda k: True)
    assert hard_negatives.mine_negatives(_table(spark, []), F.col("vec_id") == 0, F.col("label")).count() == 0
    named = hard_negatives.mine_negatives(_table(spark, rows), F.col("vec_id") % 1 == 0, F.col("label").cast("string"))
    assert Counter(map(tuple, named.collect())) == _negatives(rows, lambda k: True)
    with pytest.raises(Exception, match="does not fit"):
        hard_negatives.mine_negatives(_table(spark, [(1, [1e200], 1), (2, [1e200], 1), (3, [1.0], 2)]), F.col("vec_id") == 1, F.col("label")).collect()


def test_threshold_ends_the_search_early():
    r = np.random.default_rng(6)
    rows = np.floor(256 * r.normal(size=(4000, 3)))
    order = np.argsort(rows.T, axis=1, kind="stable").astype(np.int32)
    part = hard_negatives.Segment(np.arange(4000), np.arange(4000), np.zeros(4000, np.int64), rows, order)
    best = hard_negatives.Best(-(1 << 60), 1 << 60, 5)
    scored = hard_negatives.search(part, rows[0], np.ones(4000, bool), [best], depth=16)
    want = np.sort((rows @ rows[0]).astype(np.int64))[::-1][:5]
    assert best.scores.tolist() == want.tolist()
    assert scored < 2000


def test_windows_are_exact_for_large_scores():
    for s in (10, 11, -7, (1 << 62) + 3):
        low, high = hard_negatives.window(s)
        assert 50 * s <= 100 * low < 50 * s + 100 and 95 * s - 100 < 100 * high <= 95 * s

