import pytest
from pyspark.sql import functions as F

from lamina.errors import StoreUnavailable, ValidationError
from lamina.operators import forest, retrieval, slicing


def hits(spark, text_by_doc, picks, stale=()):
    """picks: (doc, size, offset) in order."""
    docs = spark.createDataFrame(list(text_by_doc.items()), "document_id string, text string")
    rows = {(r.document_id, r.size, r.codepoint_offset): r.asDict() for r in slicing.slice_documents(docs).collect()}
    out = []
    for i, p in enumerate(picks):
        r = rows[p]
        out.append((1, i, *p, r["codepoint_length"], r["own_marker"], [] if p in stale else r["descendant_markers"]))
    return spark.createDataFrame(out, "query_id int, seq int, document_id string, size int, codepoint_offset int, codepoint_length int, own_marker string, descendant_markers array<string>")


D = {"d": "".join(chr(0x100 + i) for i in range(1024)), "e": "".join(chr(0x4000 + i) for i in range(1024)), "x": "x" * 256}
SPINE = [("d", s, 0) for s in (64, 128, 256, 512, 1024)]


def pairs(df):
    return sorted((r.document_id, r.size, r.codepoint_offset, r.parent_size, r.parent_offset) for r in df.collect())


def test_full_spine(spark):
    f, odd = forest.build_forest(hits(spark, D, SPINE))
    assert forest.edges(f).count() == 4 and forest.edges(f, closure=True).count() == 10 and odd.count() == 0
    m = forest.metrics(f, odd).first()
    assert (m.max_depth, m.participation_rate, m.edge_count) == (5, 1.0, 4)


def test_gap_and_roots(spark):
    f, _ = forest.build_forest(hits(spark, D, [("d", 64, 0), ("d", 256, 0)]))
    assert pairs(forest.edges(f)) == [("d", 64, 0, 256, 0)]
    assert [r.size for r in forest.roots(f).collect()] == [256] and [r.size for r in forest.leaves(f).collect()] == [64]


def test_repeated_text_and_other_documents(spark):
    f, _ = forest.build_forest(hits(spark, D, [("x", 64, 0), ("x", 64, 128), ("x", 128, 0)]))
    assert pairs(forest.edges(f)) == [("x", 64, 0, 128, 0)]
    f, _ = forest.build_forest(hits(spark, D, [("d", 64, 0), ("e", 128, 0)]))
    assert forest.edges(f).count() == 0


def test_stale_parents(spark):
    f, odd = forest.build_forest(hits(spark, D, [("d", 64, 0), ("d", 128, 0)], stale=[("d", 128, 0)]))
    assert forest.edges(f).count() == 0 and pairs(odd) == [("d", 64, 0, 128, 0)]
    f, odd = forest.build_forest(hits(spark, D, [("d", 64, 0), ("d", 128, 0), ("d", 256, 0)], stale=[("d", 128, 0)]))
    assert ("d", 64, 0, 256, 0) in pairs(forest.edges(f)) and pairs(odd) == [("d", 64, 0, 128, 0)]


def test_participation(spark):
    f, odd = forest.build_forest(hits(spark, D, [("d", 128, 0), ("d", 64, 0), ("d", 256, 256)]))
    m = forest.metrics(f, odd).first()
    assert abs(m.participation_rate - 2 / 3) < 1e-12 and m.max_depth == 2


def test_duplicates_and_alignment(spark):
    h = hits(spark, D, [("d", 64, 0), ("d", 64, 0), ("d", 128, 0)])
    assert sorted(r.seq for r in forest.one_of_each(h, "seq").collect()) == [0, 2]
    assert sorted(r.seq for r in forest.one_of_each(h, "seq", last=True).collect()) == [1, 2]
    with pytest.raises(ValidationError):
        forest.build_forest(h.withColumn("codepoint_offset", F.lit(7)))
    f, odd = forest.build_forest(h)
    m = forest.metrics(f, odd).first()
    assert (m.hit_count, m.edge_count, m.max_depth) == (2, 1, 2)
    # The first hit of a coordinate is what the forest sees: a stale one that came later changes nothing.
    late = h.withColumn("descendant_markers", F.when((F.col("size") == 128) & (F.col("seq") > 5), F.array().cast("array<string>")).otherwise(F.col("descendant_markers")))
    stale = h.where("size = 128").withColumn("seq", F.lit(9)).withColumn("descendant_markers", F.array().cast("array<string>"))
    assert pairs(forest.edges(forest.build_forest(late.unionByName(stale))[0])) == [("d", 64, 0, 128, 0)]
    asked = spark.createDataFrame([(1, "d", 64, 0), (1, "d", 128, 0), (1, "d", 64, 64)], "query_id int, document_id string, size int, codepoint_offset int")
    assert sorted((r.size, r.parent_size) for r in forest.minimal_parent(f, asked).collect()) == [(64, 128), (128, None)]


def scored(spark, rows):
    return spark.createDataFrame([(1, "d", s, o, f"{s}-{o:05d}", x) for s, o, x in rows], "query_id int, document_id string, size int, codepoint_offset int, point_id string, score double")


def order(df):
    return [(r.size, r.codepoint_offset) for r in df.orderBy("fused_rank").collect()]


def test_interleave(spark):
    rows = [(64, 0, 0.5), (64, 64, 0.4), (128, 0, 0.99), (128, 128, 0.98), (256, 0, 0.1), (256, 256, 0.05)]
    assert order(retrieval.tier_interleave(scored(spark, rows))) == [(64, 0), (128, 0), (256, 0), (64, 64), (128, 128), (256, 256)]
    ragged = [(64, 0, 0.9), (64, 64, 0.8), (64, 128, 0.7), (128, 0, 0.5)]
    assert order(retrieval.tier_interleave(scored(spark, ragged))) == [(64, 0), (128, 0), (64, 64), (64, 128)]
    assert order(retrieval.raw_score_pool(scored(spark, rows)))[0] == (128, 0)
    assert order(retrieval.tier_interleave(scored(spark, [(64, 0, None), (64, 64, -0.5)])))[0] == (64, 64)


def test_sizes_budget_fanout(spark):
    from lamina.grid import DEFAULT_GRID

    assert retrieval.resolve_sizes(DEFAULT_GRID, [512, 64, 7]) == ((64, 512), ["size 7 is not in the grid"])
    assert retrieval.resolve_sizes(DEFAULT_GRID, [7])[0] == DEFAULT_GRID.sizes
    assert retrieval.cap_budget(None, 5) == (None, []) and retrieval.cap_budget(9, 5)[0] == 5 and retrieval.cap_budget(4, 5) == (4, [])
    h = scored(spark, [(64, 0, 0.5)])
    rows = {r["size"]: (r["status"], r["hits"], r["error"]) for r in retrieval.fan_out(h.select("query_id"), (64, 128), h, {128: "gone"}).collect()}
    assert rows == {64: ("ok", 1, None), 128: ("error", 0, "gone")}
    with pytest.raises(StoreUnavailable):
        retrieval.fan_out(h.select("query_id"), (64,), h, {64: "gone"})


def test_sizes_that_fail_or_take_too_long(spark):
    points = spark.createDataFrame([(s, "d", i, f"{s}-{i}", [float(i), 1.0]) for s in (8, 16) for i in range(9)], "size int, document_id string, codepoint_offset int, point_id string, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, vector array<double>")
    bad = points.withColumn("vector", F.when(F.col("size") == 16, F.raise_error(F.lit("bad block"))).otherwise(F.col("vector")))
    found, errors = retrieval.search_sizes(q, bad, (8, 16), 3)
    assert found.count() == 3 and set(errors) == {16}
    with pytest.raises(StoreUnavailable):
        retrieval.search_sizes(q, bad, (16,), 3)
    found, errors = retrieval.search_sizes(q, points, (8, 16), 3, timeout=60)
    assert found.count() == 6 and not errors
    slow = F.udf(lambda v: __import__("time").sleep(20) or v, "array<double>")
    late = points.where("size = 8").unionByName(points.where("size = 16").limit(1).withColumn("vector", slow("vector")))
    found, errors = retrieval.search_sizes(q, late, (8, 16), 3, timeout=12)
    assert found.count() == 3 and "no answer" in errors[16]


def test_search_against_loop(spark):
    import random

    rng = random.Random(3)
    vs = [(f"p{i:03d}", 64 if i % 3 else 128, [rng.uniform(-1, 1) for _ in range(5)] if i % 7 else [0.0] * 5) for i in range(60)] + [("p999", 64, [1.0] * 5), ("p998", 64, [1.0] * 5)]
    pts = spark.createDataFrame(vs, "point_id string, size int, vector array<double>").repartition(5)
    qs = spark.createDataFrame([(1, [1.0] * 5), (2, [0.0] * 5)], "query_id int, vector array<double>")

    def cos(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    got = {(r.query_id, r["size"], r["rank"]): r.point_id for r in retrieval.search(qs, pts, 4).collect()}
    for q, v in ((1, [1.0] * 5), (2, [0.0] * 5)):
        for s in (64, 128):
            want = sorted(((-round(cos(v, p[2]), 12), p[0]) for p in vs if p[1] == s))[:4]
            assert [got[q, s, i] for i in range(4)] == [w[1] for w in want]


def test_search_goes_on_beyond_a_block_of_queries(spark, monkeypatch):
    points = spark.createDataFrame([(8, i, [float(i), 1.0]) for i in range(12)], "size int, point_id int, vector array<double>")
    queries = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)], "query_id int, vector array<double>")
    want = sorted(map(tuple, retrieval.search(queries, points, 3).collect()))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 3)
    monkeypatch.setattr(retrieval, "POINT_ROWS", 5)
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 2)
    got = retrieval.search(queries, points, 3)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 21
