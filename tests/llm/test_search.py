"""Exact and approximate search against brute force."""

import math

import numpy as np
import pytest

from lamina.llm.ann import additive_search
from lamina.llm.blocks import best
from lamina.llm.topk import accumulate, exact_topk, postings_of

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2.0) for i, v in rows], SCHEMA)


def rows(seed, n=400, d=6):
    rng = np.random.default_rng(seed)
    out = [(i, rng.normal(size=d).astype(np.float32).tolist()) for i in range(n)]
    out[50] = (50, out[3][1])
    out += [(n, out[3][1]), (n + 1, [0.0] * d), (n + 2, None), (n + 3, [1.0] * (d - 1) + [None]), (n + 4, [math.nan] * d), (n + 5, [math.inf] + [0.0] * (d - 1)), (None, [1.0] * d), (n + 6, []), (n + 7, [0.5, 0.25])]
    return out


def usable(data):
    return {i: np.array([*v, *[0.0] * (6 - len(v))], dtype=np.float64) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}


def test_exact_against_brute_force(spark):
    data = rows(1)
    q = {i: np.floor(256 * v).astype(int) for i, v in usable(data).items()}
    want = set()
    for i in q:
        if i % 50 == 0:
            order = sorted((-int(q[i] @ v), j) for j, v in q.items() if j != i)[:5]
            want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(order)}
    got = exact_topk(table(spark, data).repartition(7))
    assert got.dtypes[:4] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert {tuple(r) for r in got.collect()} == want


def test_exact_edges(spark):
    assert exact_topk(table(spark, [])).count() == 0
    few = exact_topk(table(spark, [(0, [1.0]), (1, [1.0]), (1, [1.0])])).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in few] == [(0, 1, 65536)]
    ties = exact_topk(table(spark, [(i, [1.0, 0.0]) for i in range(9000)]).repartition(3)).where("query_id = 50").orderBy("rank").collect()
    assert [r.vec_id for r in ties] == [0, 1, 2, 3, 4]


def test_accumulation_scatters_sparse_terms():
    m = np.array([[0, 2, 0], [3, 0, 0], [1, 1, 0]])
    assert accumulate(np.array([2, 0, 5]), postings_of(m), 3).tolist() == [0, 6, 2]
    assert best(np.array([1, 5, 5, 3]), np.array([4, 9, 2, 1]), 2).tolist() == [2, 1]


def test_ann_recall_and_scores(spark):
    data = rows(2, n=3000)
    v = {i: x for i, x in usable(data).items() if x.any()}
    ids = np.array(sorted(v))
    m = np.stack([v[i] for i in ids])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    got: dict = {}
    for r in additive_search(table(spark, data).repartition(4)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for i in [i for i in v if i % 50 == 0]:
        s = unit @ unit[np.searchsorted(ids, i)]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:5]
        found = sorted(got[i])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        for _, j, score in found:
            assert abs(score - s[np.searchsorted(ids, j)]) < 1e-9
        hits += len({j for _, j, _ in found} & {int(ids[j]) for j in order})
        total += 5
    assert set(got) == {i for i in v if i % 50 == 0} and hits / total >= 0.95


def test_ann_recall_in_many_dimensions(spark):
    """Vectors as spread as they come, over several blocks: no structure helps the codes."""
    m = np.random.default_rng(6).normal(size=(9000, 64)).astype(np.float32).astype(np.float64)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = 0
    got = additive_search(table(spark, [(i, v) for i, v in enumerate(m.tolist())]).repartition(3)).collect()
    for r in got:
        s = unit @ unit[r.query_id]
        s[r.query_id] = -9
        hits += s[r.vec_id] >= np.partition(s, -5)[-5] - 1e-9
    assert len(got) == 180 * 5 and hits / len(got) >= 0.95


@pytest.mark.parametrize("data", [[], [(0, [0.0, 0.0])], [(0, [1.0, 2.0])]])
def test_ann_small(spark, data):
    assert additive_search(table(spark, data)).count() == 0


def test_ann_copies_and_scales(spark):
    got = additive_search(table(spark, [(i, [1.0, 2.0]) for i in range(300)] + [(1000, [1e30, 2e30])])).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5] and abs(got[0].score - 1) < 1e-12


def test_large_components_are_not_clamped(spark):
    rows = [(0, [2.0**22, -1.0]), (1, [2.0**23, 0.5]), (2, [2.0**21, 3.0]), (3, [2.0**24, 1.0]), (4, [-(2.0**24), 0.0])]
    got = exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 0").orderBy("rank").collect()
    q = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = sorted(((sum(a * b for a, b in zip(q[0], q[i], strict=True)), i) for i in (1, 2, 3, 4)), key=lambda x: (-x[0], x[1]))
    assert [(r.score, r.vec_id) for r in got] == want
    with pytest.raises(Exception, match="long|Overflow|too large"):
        exact_topk(spark.createDataFrame([(0, [2.0**50]), (1, [2.0**50])], "vec_id long, embedding array<double>")).collect()


def test_an_id_in_many_rows_counts_once(spark):
    rng = np.random.default_rng(8)
    data = [(i, rng.normal(size=4).tolist()) for i in range(1, 9)] + [(0, [1.0, 0.0, 0.0, 0.0]), (0, [0.5, 0.0, 0.0, 0.0])]
    data += [(100, [9.0 + j / 100, 0.0, 0.0, 0.0]) for j in range(100)] + [(101, [8.0, 0.1 * (j % 7), 0.0, 0.0]) for j in range(70)]
    v = {}
    for i, x in data:
        v.setdefault(i, []).append(np.array(x))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = exact_topk(df.repartition(3)).where("query_id = 0").orderBy("rank").collect()
    q = [math.floor(256 * x) for x in min(map(list, v[0]))]
    want = sorted((-max(int(np.floor(256 * x).astype(int) @ q) for x in xs), i) for i, xs in v.items() if i)[:5]
    assert [(-r.score, r.vec_id) for r in got] == want and [r["rank"] for r in got] == [1, 2, 3, 4, 5]
    near = additive_search(df.repartition(3)).where("query_id = 0").orderBy("rank").collect()
    q = np.array(min(map(list, v[0])))
    cos = sorted((-max(float(x @ q / np.linalg.norm(x) / np.linalg.norm(q)) for x in xs), i) for i, xs in v.items() if i)[:5]
    assert [r.vec_id for r in near] == [i for _, i in cos] and all(abs(r.score + s) < 1e-12 for r, (s, _) in zip(near, cos, strict=True))


def test_wide_and_large(spark):
    """Components of 1e9 in 512 dimensions: sums leave a double's whole numbers, not a long's."""
    rng = np.random.default_rng(9)
    data = [(i, np.round(rng.normal(size=512) * (1e6 if i % 3 else 1e3), 2).tolist()) for i in range(60)]
    got: dict = {}
    for r in exact_topk(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = {i: [math.floor(256 * x) for x in x_] for i, x_ in data}
    for a in (0, 50):
        want = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=True)), b) for b in q if b != a)[:5]
        assert sorted(got[a]) == [(n + 1, b, -s) for n, (s, b) in enumerate(want)]
    one = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1.0, 1e9]), (2, [2.0, -1e9])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in exact_topk(one).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(1, 2 * 65536 * 10**9), (2, 65536 * 10**9)]


def test_repeated_vectors_keep_recall(spark):
    """Ids in many rows among vectors without structure: recall against brute force."""
    rng = np.random.default_rng(10)
    m = rng.normal(size=(4000, 24))
    ids = np.concatenate([np.arange(3000), np.repeat(rng.integers(0, 3000, 10), 100)])
    got: dict = {}
    for r in additive_search(spark.createDataFrame([(int(i), v) for i, v in zip(ids, m.tolist(), strict=True)], "vec_id long, embedding array<double>").repartition(3)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = total = 0
    for qid in got:
        own = min(m[ids == qid].tolist())
        s = unit @ (np.array(own) / np.linalg.norm(own))
        best_of: dict = {}
        for i, x in zip(ids.tolist(), s.tolist(), strict=True):
            if i != qid:
                best_of[i] = max(best_of.get(i, -9), x)
        top = {i for i, _ in sorted(best_of.items(), key=lambda x: (-x[1], x[0]))[:5]}
        hits, total = hits + len(top & got[qid]), total + 5
    assert len(got) == 60 and hits / total >= 0.95


def test_exact_in_many_batches_and_blocks(spark, monkeypatch):
    """Queries beyond what is sent at once, over blocks that grow, of common and rare terms: the same as brute force."""
    from lamina.llm import blocks

    monkeypatch.setattr(blocks, "SENT_NUMBERS", 500)
    monkeypatch.setattr(blocks, "CANDIDATE_ROWS", 160)
    monkeypatch.setattr(blocks, "FIRST_ROWS", 10)
    rng = np.random.default_rng(11)
    m = rng.normal(size=(3000, 12)) * (rng.random((3000, 12)) < np.where(np.arange(12) % 2, 0.1, 0.9))
    m[1000:1400] = m[7]  # many ties
    q = np.floor(256 * m).astype(int)
    got = {tuple(r) for r in exact_topk(spark.createDataFrame(list(enumerate(m.tolist())), "vec_id long, embedding array<double>").repartition(2)).collect()}
    want = set()
    for a in range(0, 3000, 50):
        s = q @ q[a]
        order = [int(j) for j in np.lexsort((np.arange(3000), -s)) if j != a][:5]
        want |= {(a, n + 1, j, int(s[j])) for n, j in enumerate(order)}
    assert got == want


def test_the_sample_reaches_the_driver_once(spark, monkeypatch):
    """What tasks send to the driver for the fit is bounded by the sample, not by the tasks."""
    from lamina.llm import ann

    monkeypatch.setattr(ann, "SAMPLE_ROWS", 256)
    m = np.random.default_rng(12).normal(size=(12_000, 64))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<double>").repartition(24)
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "1500k")
    try:
        assert additive_search(df).where("rank = 1").count() == 240
    finally:
        conf.set("spark.driver.maxResultSize", "1g")
