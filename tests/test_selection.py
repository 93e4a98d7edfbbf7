"""Selection against hand-made cases, a brute-force bound and the closed form."""

import random

import pytest
from pyspark.sql import functions as F

from lamina.errors import ValidationError
from lamina.functions.counters import chars
from lamina.grid import DEFAULT_GRID
from lamina.operators import selection, slicing
from lamina.operators.tradeup import replay

DISTINCT = "".join(chr(0x100 + i) for i in range(1024))


class World:
    """Documents sliced once; hits by coordinates and score."""

    def __init__(self, spark, **docs):
        self.spark = spark
        d = spark.createDataFrame(list(docs.items()), "document_id string, text string")
        self.rows = {(r.document_id, r["size"], r.codepoint_offset): r for r in slicing.slice_documents(d, counter=chars).collect()}
        self.schema = slicing.slice_documents(d, counter=chars).schema

    def frame(self, keys, tokens=None, stale=()):
        tokens = tokens or {}
        out = []
        for k in keys:
            r = self.rows[k].asDict()
            if k in tokens:
                r["token_count"] = tokens[k]
            if k in stale:
                r["descendant_markers"] = []
            out.append(tuple(r[f.name] for f in self.schema))
        return self.spark.createDataFrame(out, self.schema)

    def hits(self, scored, tokens=None, stale=()):
        by = {}
        for k, s in scored:
            by.setdefault(k[1], []).append((-s, k))
        ranks = {k: i for v in by.values() for i, (_, k) in enumerate(sorted(v))}
        extra = self.spark.createDataFrame([(1, *k, s, ranks[k]) for k, s in scored], "query_id int, document_id string, size int, codepoint_offset int, score double, rank int")
        return self.frame([k for k, _ in scored], tokens, stale).join(extra, slicing.KEY)

    def fit(self, scored, budget, source=None, tokens=None, stale=(), **options):
        src = None if source is None else self.frame(self.rows if source == "all" else source, tokens, stale)
        sel, trace = selection.budget_fit(self.hits(scored, tokens, stale), budget=budget, slices=src, **options)
        t = trace.first()
        assert set(selection.replay_ids(trace).first().ids) == {r.point_id for r in sel.collect()}
        return sel.orderBy("position").collect(), t


def keys(sel):
    return [(r.document_id, r["size"], r.codepoint_offset) for r in sel]


@pytest.fixture(scope="module")
def d(spark):
    return World(spark, d=DISTINCT)


@pytest.fixture(scope="module")
def boiler(spark):
    return World(spark, hb="x" * 1024, faq="y" * 256)


def test_worked_example(boiler):
    h = [(("hb", 64, 0), 0.95), (("hb", 64, 64), 0.90), (("hb", 128, 0), 0.80), (("hb", 256, 0), 0.70), (("faq", 64, 0), 0.85)]
    tokens = {("hb", 64, 0): 50, ("hb", 64, 64): 50, ("hb", 128, 0): 120, ("hb", 256, 0): 700, ("faq", 64, 0): 60, ("faq", 128, 0): 110, ("faq", 256, 0): 200}
    sel, t = boiler.fit(h, 800, [("hb", 128, 0), ("hb", 256, 0), ("faq", 128, 0), ("faq", 256, 0)], tokens)
    assert len(t.dedup) == 2 and len(t.selected_ids) == 3
    trades = [(x.round, x.from_ref["size"], x.to_ref["size"], x.to_provenance, len(x.subsumed_ids), x.delta_tokens, x.budget_left) for x in t.trade_ups]
    assert trades == [(1, 64, 128, "retrieved", 1, 20, 620), (1, 64, 128, "fetched", 0, 50, 570), (2, 128, 256, "fetched", 0, 90, 480)]
    assert [(x.round, x.reason, x.target["size"], x.delta_tokens) for x in t.rejections] == [(2, "over_budget", 256, 580), (3, "saturated", 256, None)]
    assert keys(sel) == [("hb", 128, 0), ("faq", 256, 0)]
    assert [(r.action, r.provenance, r.levels, r.effective_rank) for r in sel] == [("traded_up", "retrieved", 1, 0), ("traded_up", "traded_up", 2, 4)]
    assert (t.tokens_used, t.utilization, t.budget_exhausted) == (320, 0.4, True)
    assert len(sel[0].replaced_ids) == 2 and [e["size"] for e in sel[0].evidence] == [64, 64, 128, 256]


A, B, P = ("d", 64, 0), ("d", 64, 64), ("d", 128, 0)


def test_no_budget_keeps_leaves(d):
    sel, t = d.fit([(A, 0.9), (P, 0.8)], None)
    assert keys(sel) == [A] and [e["size"] for e in sel[0].evidence] == [64, 128]
    assert t.utilization is None and not t.budget_exhausted


def test_trade_to_retrieved_and_fetched_parent(d):
    sel, t = d.fit([(A, 0.9), (B, 0.8), (P, 0.7)], 1000)
    assert keys(sel) == [P] and sel[0].provenance == "retrieved" and len(t.trade_ups) == 1
    sel, t = d.fit([(A, 0.9), (B, 0.8)], 150, [P])
    assert keys(sel) == [P] and sel[0].provenance == "traded_up" and t.trade_ups[0].to_provenance == "fetched"


@pytest.mark.parametrize("expansion", ["retrieved_only", "off"])
def test_expansion_modes(d, expansion):
    sel, t = d.fit([(A, 0.9), (B, 0.8)], 1000, "all", expansion=expansion)
    assert keys(sel) == [A, B] and not t.trade_ups
    assert sel[0].contiguous_with_next and not sel[1].contiguous_with_next


def test_size_limit(d):
    sel, _ = d.fit([(("d", s, 0), 0.5) for s in (64, 128, 256, 512, 1024)], 5000, max_slice_size=256)
    assert keys(sel) == [("d", 256, 0)]


def test_budget_edges(d):
    sel, t = d.fit([(P, 0.9)], 10)
    assert not sel and t.budget_exhausted and t.smallest_unaffordable_tokens == 128
    sel, t = d.fit([(A, 0.9), (("d", 64, 512), 0.8)], 100, expansion="off")
    assert len(sel) == 1 and len(t.skipped_unaffordable) == 1
    sel, t = d.fit([(A, 0.9), (P, 0.8)], 100)
    assert keys(sel) == [A] and t.rejections[0].reason == "over_budget"
    assert d.fit([(A, 0.9)], 0)[1].utilization is None


def test_stale_and_missing_parents(d):
    sel, t = d.fit([(A, 0.9)], 100_000, [P], stale=[P])
    assert keys(sel) == [A] and t.rejections[0].reason == "stale_parent"
    sel, t = d.fit([(A, 0.9)], 100_000, [B])
    assert keys(sel) == [A] and t.rejections[0].reason == "fetch_miss"


def test_short_document_stops_where_nothing_is_added(spark):
    sel, _ = World(spark, s="".join(chr(0x400 + i) for i in range(100))).fit([(("s", 64, 0), 0.9)], 10_000, "all")
    assert keys(sel) == [("s", 128, 0)] and sel[0].levels == 1


def test_overhead(d):
    sel, t = d.fit([(("d", 128, o), 0.9 - o / 10_000) for o in (0, 256, 512)], 520, expansion="off", overhead=40)
    assert len(sel) == 3 and t.tokens_used == 504


def test_repeated_text_is_not_absorbed_by_marker(spark):
    w = World(spark, d="x" * 1024)
    picks = [(("d", 64, o), 0.9 - i / 100) for i, o in enumerate((64, 256, 384, 448, 640, 768, 832, 896))]
    sel, _ = w.fit([*picks, (("d", 128, 0), 0.1)], 8 * 64 + 64, [("d", 128, 0)])
    assert len(sel) == 8 and {r.codepoint_offset + r.codepoint_length for r in sel} == {128, 320, 448, 512, 704, 832, 896, 960}


def test_repeated_hits_are_one_slice(d):
    once, _ = d.fit([(A, 0.9), (("d", 64, 512), 0.8)], 200, expansion="off")
    h = d.hits([(A, 0.9), (("d", 64, 512), 0.8)])
    again = h.where("codepoint_offset = 0").withColumn("score", F.lit(0.1))
    sel, trace = selection.budget_fit(h.unionByName(again), budget=200, expansion="off")
    got = sel.orderBy("position").collect()
    t = trace.first()
    assert sorted(keys(got)) == sorted(keys(once)) and t.tokens_used == 128 and len(t.selected_ids) == 2 and t.candidate_count == 3 and t.hit_count == 2
    # The last hit of a coordinate is what speaks for it.
    assert [e["raw_score"] for r in got if r.codepoint_offset == 0 for e in r.evidence] == [0.1]
    assert len(selection.replay_ids(trace).first().ids) == 2
    with pytest.raises(ValidationError):
        selection.budget_fit(h.withColumn("codepoint_offset", F.col("codepoint_offset") + 1), budget=200)


def test_a_strategy_of_ones_own(d):
    def nothing(request):
        return request.fused.limit(0), request.queries

    selection.register_strategy("nothing", nothing)
    h = d.hits([(A, 0.9)])
    for s in ("nothing", nothing):
        chosen, queries = selection.budget_fit(h, budget=5, strategy=s)
        assert chosen.count() == 0 and queries.first().budget == 5
    selection.STRATEGIES.pop("nothing")


def test_a_contradictory_trace_is_refused(spark):
    shape = "query_id int, selected_ids array<string>, trade_ups array<struct<from_id:string,to_id:string,subsumed_ids:array<string>>>"
    good = spark.createDataFrame([(1, ["a", "b", "c"], [("a", "p", ["b"]), ("p", "q", [])]), (2, [], []), (3, None, None)], shape)
    assert {r.query_id: r.ids for r in selection.replay_ids(good).collect()} == {1: ["c", "q"], 2: [], 3: []}
    for bad in ((["a", "a"], []), (["a"], [("b", "c", [])]), (["a", "b"], [("a", "b", [])])):
        with pytest.raises(Exception, match="held twice"):
            selection.replay_ids(spark.createDataFrame([(1, *bad)], shape)).collect()


def test_options_are_checked(d):
    with pytest.raises(ValidationError):
        d.fit([(A, 0.9)], 10, expansion="sideways")
    with pytest.raises(ValidationError):
        d.fit([(A, 0.9)], 10, strategy="other")
    with pytest.raises(ValidationError):
        replay(["a", "a"], [])
    with pytest.raises(ValidationError):
        replay(["a"], [{"from_id": "b", "to_id": "c", "subsumed_ids": []}])


@pytest.mark.parametrize("seed", range(3))
def test_random_hits(spark, seed):
    """Many queries at once: budgets hold, replays agree, and ample budgets end where the closed form says."""
    rng = random.Random(seed)
    text = "".join(chr(0x3400 + i) for i in range(rng.randint(800, 2048)))
    w = World(spark, d=text, e=text[::-1][:700])
    every = sorted(w.rows)
    rows, budgets = [], {}
    for q in range(8):
        picks = rng.sample(every, rng.randint(1, 6))
        budgets[q] = rng.randint(1, 4000)
        order = {}
        for k in picks:
            order.setdefault(k[1], []).append((rng.random(), k))
        for s, v in order.items():
            rows += [(q, *k, x, i) for i, (x, k) in enumerate(sorted(v, reverse=True))]
    marks = spark.createDataFrame(rows, "query_id int, document_id string, size int, codepoint_offset int, score double, rank int")
    hits = w.frame(every).join(marks, slicing.KEY)
    source = w.frame(every)
    options = spark.createDataFrame(list(budgets.items()), "query_id int, budget int")
    sel, trace = selection.select(hits, options, source)
    shuffled, _ = selection.select(hits.repartition(7, "score"), options.repartition(3), source.repartition(5))
    cols = ["query_id", "position", *slicing.KEY, "action", "levels", "replaced_ids", "cost"]
    assert sorted(sel.select(*cols).collect()) == sorted(shuffled.select(*cols).collect())
    for t in trace.collect():
        assert t.tokens_used <= budgets[t.query_id]
    ids = {r.query_id: r.ids for r in selection.replay_ids(trace).collect()}
    got: dict = {}
    for r in sel.collect():
        got.setdefault(r.query_id, []).append(r.point_id)
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in ids.items() if v}
    ample, _ = selection.select(hits, options.withColumn("budget", F.lit(10_000_000)), source)
    from lamina.operators import forest

    leaf = forest.leaves(forest.build_forest(hits, DEFAULT_GRID)[0]).join(hits.select("query_id", *slicing.KEY, "document_codepoint_length"), ["query_id", *slicing.KEY])
    want = {tuple(r) for r in selection.unbounded_closed_form(leaf).collect()}
    assert {tuple(r) for r in ample.select("query_id", *slicing.KEY).collect()} == want
