import pytest
from pyspark.sql import functions as F

from lamina import errors
from lamina.functions.embedders import FakeEmbedder
from lamina.operators import evaluation
from lamina.plans.engine import Engine, build_embedder, build_store, render_context, response
from lamina.settings import Limits, Settings, Tools, load
from lamina.sources import catalog
from lamina.streaming.ingest import ingest_stream

LONG = "".join(chr(0x100 + i) for i in range(1024))


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}", FakeEmbedder(8), Settings(limits=Limits(max_document_codepoints=5000, max_batch_documents=3), tools=Tools(enable_document_tools=True)))
    e.create_corpus("docs")
    return e


def test_corpora(engine):
    c = engine.create_corpus("other", sizes=(3, 6))
    assert c.embedder_fingerprint == "fake:deterministic-8" and c.dimension == 8
    with pytest.raises(errors.CorpusExists):
        engine.create_corpus("other")
    assert engine.list_corpora() == ["docs", "other"]
    engine.drop_corpus("other")
    for call in (engine.drop_corpus, engine.inspect):
        with pytest.raises(errors.CorpusNotFound):
            call("other")
    with pytest.raises(errors.InvalidGrid):
        engine.create_corpus("bad", sizes=(5, 7))
    with pytest.raises(errors.UnknownTokenizer):
        engine.create_corpus("bad", token_counter="nope")
    with pytest.raises(errors.ValidationError):
        engine.create_corpus("")
    assert engine.check()["ok"] and engine.catalog.ping()
    assert catalog.available_stores() == ["parquet"] and catalog.load_store("parquet") is catalog.Catalog


def test_replace_leaves_no_orphans(engine):
    engine.put("docs", "a", LONG, [("k", "v"), ("k", "w")])
    before = engine.catalog.list_point_ids("docs", "a")
    assert {s: len(v) for s, v in before.items()} == {64: 16, 128: 8, 256: 4, 512: 2, 1024: 1}
    r = engine.put("docs", "a", LONG[:100])
    after = engine.catalog.list_point_ids("docs", "a")
    assert {s: len(v) for s, v in after.items()} == {64: 2, 128: 1, 256: 1, 512: 1, 1024: 1}
    assert all(after[s] <= before[s] for s in after)
    assert r["codepoint_length"] == 100 and r["slice_count"] == 6
    assert engine.put("docs", "empty", "")["content_marker"] == "" and engine.inspect("docs")["degraded"] == []


def test_pages_and_deletes(engine):
    for i in "pqr":
        engine.put("docs", i, i * 70)
    seen, cursor = [], None
    while True:
        page, cursor = engine.list_page("docs", 2, cursor)
        seen += [x["document_id"] for x in page]
        if cursor is None:
            break
    assert seen == sorted(seen) and {"p", "q", "r"} <= set(seen)
    engine.delete("docs", "q")
    with pytest.raises(errors.DocumentNotFound):
        engine.delete("docs", "q")
    assert not any(engine.catalog.list_point_ids("docs", "q").values())
    gone = next(iter(engine.catalog.list_point_ids("docs", "p")[64]))
    engine.catalog.delete_points("docs", "p", [gone, "unknown"])
    assert gone not in engine.catalog.list_point_ids("docs", "p")[64]
    documents, points = engine.catalog.corpus_stats("docs")
    assert documents == engine.catalog.documents("docs").count() and sum(points.values()) == engine.catalog.slices("docs").count()


def test_batches_and_limits(engine):
    status = engine.put_batch("docs", [("ok", "fine"), ("", "no id"), ("s", "a\ud800")])
    assert [x["code"] for x in status] == [None, "SLICING_ERROR", "SLICING_ERROR"] and engine.get("docs", "ok")
    with pytest.raises(errors.BatchTooLarge):
        engine.put_batch("docs", [("x", "y")] * 4)
    with pytest.raises(errors.DocumentTooLarge):
        engine.put("docs", "big", "x" * 5001)
    for bad in (0, 1001):
        with pytest.raises(errors.ValidationError):
            engine.list_page("docs", bad)


def test_points_are_checked_before_any_write(engine, spark):
    config = engine.catalog.get_corpus_meta("docs")
    d = spark.createDataFrame([("z", "zz")], "document_id string, text string")
    pts = engine.points(config, d)
    n = engine.catalog.slices("docs").count()
    with pytest.raises(errors.EmbedderMismatch):
        engine.catalog.upsert_slices("docs", pts, "other grid")
    with pytest.raises(errors.EmbedderMismatch):
        engine.catalog.upsert_slices("docs", pts.withColumn("vector", F.array(F.lit(1.0))), config.grid.fingerprint())
    with pytest.raises(errors.ValidationError):
        engine.catalog.upsert_slices("docs", pts.withColumn("vector", F.lit(None).cast("array<double>")), config.grid.fingerprint())
    assert engine.catalog.slices("docs").count() == n
    for _ in range(2):
        engine.catalog.upsert_slices("docs", pts, config.grid.fingerprint())
    assert engine.catalog.slices("docs").count() == n + 5


def test_layers_are_merged_and_swept(engine, spark, monkeypatch):
    e = Engine(spark, f"{engine.catalog.root}-layers", FakeEmbedder(4))
    e.create_corpus("c", sizes=(2, 4))
    e.ingest("c", spark.createDataFrame([(f"d{i}", "abcdefgh"[: 1 + i]) for i in range(6)], "document_id string, text string"))
    want = {f"d{i}": "abcdefgh"[: 1 + i] for i in range(6)}

    def texts():
        out = {}
        for r in e.catalog.slices("c").where("size = 2").orderBy("document_id", "codepoint_offset").collect():
            out[r.document_id] = out.get(r.document_id, "") + r.text
        return out

    monkeypatch.setattr(catalog, "MOST_LAYERS", 3)
    for i, t in enumerate(("xy", "z", "pq")):
        e.put("c", f"d{i}", t)
        want[f"d{i}"] = t
        assert texts() == want and e.catalog.documents("c").count() == 6
        assert len(e.catalog._corpus("c")[2]["layers"]) <= 3
    e.delete("c", "d0")
    want.pop("d0")
    gone = next(iter(e.catalog.list_point_ids("c", "d5")[4]))
    e.catalog.delete_points("c", "d5", [gone])
    assert texts() == want and e.inspect("c")["degraded"] == []
    before = e.catalog.slices("c").count()
    e.catalog.compact("c")
    assert texts() == want and e.catalog.slices("c").count() == before and len(e.catalog._corpus("c")[2]["layers"]) == 1
    assert e.catalog.vacuum(3600) == [] and texts() == want
    assert len(e.catalog.vacuum(-1)) > 5 and texts() == want and len(e.catalog._versions()) == 1
    assert e.get("c", "d3")["codepoint_length"] == 4


def test_a_corpus_that_is_damaged_is_said_to_be(engine, spark):
    e = Engine(spark, f"{engine.catalog.root}-broken", FakeEmbedder(4))
    e.create_corpus("c", sizes=(2, 4))
    e.put("c", "a", "abcd")
    version, manifest = e.catalog._manifest()
    manifest["corpora"]["c"]["config"]["metric"] = "dot"
    manifest["corpora"]["c"]["layers"][0]["grid"] = "other"
    e.catalog._flip(version, manifest)
    reasons = e.inspect("c")["degraded"]
    assert any("metric dot" in r for r in reasons) and any("another grid" in r for r in reasons)
    wide = Engine(spark, e.catalog.root, FakeEmbedder(5))
    for call in (lambda: wide.put("c", "b", "x"), lambda: wide.query("c", spark.createDataFrame([(1, "q")], "query_id int, query string"))):
        with pytest.raises(errors.EmbedderMismatch):
            call()
    catalog.remove(spark, manifest["corpora"]["c"]["layers"][0]["slices"]["rows"])
    assert any("missing" in r for r in e.inspect("c")["degraded"])


def test_a_vector_is_made_once(engine, spark, tmp_path):
    """The embedder sees each text once an ingest, and a refused ingest leaves nothing behind."""

    class Counting(FakeEmbedder):
        def column(self, text):
            at = str(tmp_path / "seen")

            @F.udf("array<double>")
            def one(t):
                with open(at, "a") as f:
                    f.write("x")
                return FakeEmbedder(3).embed([t])[0]

            return one(text)

    e = Engine(spark, f"{engine.catalog.root}-once", Counting(3))
    e.create_corpus("c", sizes=(2, 4))
    e.ingest("c", spark.createDataFrame([("a", "abcd"), ("b", "efgh")], "document_id string, text string"))
    assert (tmp_path / "seen").read_text() == "x" * 6
    n = len(e.catalog._listed("data", b"c".hex()))
    for bad, error in ((("", "x"), errors.SlicingError), (("n" * 513, "x"), errors.ValidationError), (("c", None), errors.SlicingError)):
        with pytest.raises(error):
            e.ingest("c", spark.createDataFrame([bad], "document_id string, text string"))
    with pytest.raises(errors.ValidationError):
        e.ingest("c", spark.createDataFrame([("c", "x"), ("c", "y")], "document_id string, text string"))
    assert len(e.catalog._listed("data", b"c".hex())) == n and e.put_batch("c", [("n" * 513, "x")])[0]["code"] == "VALIDATION_ERROR"


def test_tools_and_reports(engine, spark, tmp_path):
    engine.add_document_tool("docs", "tool", LONG)
    answer = engine.query_tool("docs", LONG[:64])
    assert answer["budget"]["limit"] == 4000 and answer["trace"] is None and answer["text"].startswith("[") and answer["corpus"] == "docs"
    own = [r for r in answer["results"] if r["retrieval"]["retrieved"]]
    assert all(r["coords"]["codepoint_end"] == r["coords"]["codepoint_offset"] + r["coords"]["codepoint_length"] for r in answer["results"]) and all(r["retrieval"]["score"] is not None for r in own)
    assert engine.list_corpora_tool() == {"corpora": ["docs"]}
    assert engine.delete_document_tool("docs", "tool") == {"deleted": "tool"}
    closed = Engine(spark, engine.catalog.root, FakeEmbedder(8))
    with pytest.raises(errors.ValidationError):
        closed.add_document_tool("docs", "x", "y")
    (tmp_path / "q.txt").write_text("one query\nanother\n")
    report = engine.evaluation_report("budget", "docs", str(tmp_path / "q.txt"), budget=500, out=f"file://{tmp_path}/out")
    assert report["queries"] == 2 and report["budget"] == 500 and (tmp_path / "out" / "summary.json").exists()
    with pytest.raises(errors.ValidationError):
        engine.evaluation_report("other", "docs", str(tmp_path / "q.txt"))
    assert "greedy_upward" in engine.info()["strategies"]


def test_nothing_fits(engine, spark):
    engine.put("docs", "find", LONG)
    q = spark.createDataFrame([(1, LONG[:64])], "query_id int, query string")
    r = engine.query("docs", q, budget=0)
    t = r.trace.first()
    assert t.budget_exhausted and t.results == 0 and len(t.warnings) == 1 and r.selection.count() == 0


def test_settings_from_all_sources(spark, tmp_path):
    f = tmp_path / "s.toml"
    f.write_text('[store]\nroot = "there"\nsearch_timeout_s = 2\n[limits]\nmax_token_budget = 10\n[tools]\nenable_document_tools = true\n[unknown]\nx = 1\n')
    env = {"LAMINA_LIMITS__MAX_TOKEN_BUDGET": "20", "LAMINA_DEFAULTS__GRID_SIZES": "[3, 6]", "LAMINA_LIMITS__MAX_BATCH_DOCUMENTS": "7"}
    s = load(f, env, limits={"max_batch_documents": 9})
    assert (s.store.root, s.store.search_timeout_s, s.limits.max_token_budget, s.limits.max_batch_documents) == ("there", 2.0, 20, 9)
    assert s.defaults.grid_sizes == (3, 6) and s.tools.enable_document_tools and s.embedder.provider == "fake"
    with pytest.raises(errors.ValidationError):
        load(None, {"LAMINA_LIMITS__MAX_TOKEN_BUDGET": "many"})
    e = build_embedder(load(None, {"LAMINA_EMBEDDER__PROVIDER": "openai", "LAMINA_EMBEDDER__MODEL": "m", "LAMINA_EMBEDDER__BASE_URL": "http://h", "LAMINA_EMBEDDER__API_KEY": "k"}))
    assert (e.fingerprint(), e.base_url, e.api_key, e.max_concurrency) == ("openai:m", "http://h", "k", 4)
    with pytest.raises(errors.ValidationError):
        build_embedder(load(None, {"LAMINA_EMBEDDER__PROVIDER": "nope"}))
    assert isinstance(build_store(spark, load(None, {"LAMINA_STORE__ROOT": f"file://{tmp_path}/x"})), catalog.Catalog)
    with pytest.raises(errors.ValidationError):
        build_store(spark, load(None, {"LAMINA_STORE__KIND": "other"}))


def test_a_reader_sees_whole_manifests_only(engine):
    from lamina.sources.shared import write_text

    write_text(engine.spark, engine.catalog._at("_manifest", "_half.json"), "{")
    assert engine.list_corpora() and engine.catalog.ping()


def test_a_late_writer_fails(engine):
    version, manifest = engine.catalog._manifest()
    engine.put("docs", "w", "first")
    with pytest.raises(errors.StoreUnavailable):
        engine.catalog._flip(version, manifest)


def test_queries(engine, spark):
    engine.put("docs", "find", LONG)
    q = spark.createDataFrame([(1, LONG[:64]), (2, LONG[256:512])], "query_id int, query string")
    r = engine.query("docs", q, budget=600)
    rows = r.selection.collect()
    assert {x.query_id for x in rows} == {1, 2}
    first = [x for x in rows if x.query_id == 1 and any(e["raw_score"] and e["raw_score"] > 0.999999 for e in x.evidence)]
    assert first and all(x.text is not None for x in rows)
    assert all(t.tokens_used <= 600 for t in r.trace.collect()) and not r.partial
    assert render_context(r.selection).where("query_id = 1").first().context.startswith("[")
    assert '"rank_in_size"' in response(r).first().response
    assert {x["status"] for x in r.fanout.collect()} == {"ok"}
    warned = engine.query("docs", q, budget=99_999_999, sizes=[64, 5], k=1)
    assert len(warned.warnings) == 2 and {e["size"] for x in warned.selection.collect() for e in x.evidence} == {64}
    for bad in ({"k": 0}, {"budget": -1}, {"strategy": "x"}, {"fusion": "x"}, {"expansion": "x"}):
        with pytest.raises(errors.ValidationError):
            engine.query("docs", q, **bad)
    with pytest.raises(errors.ValidationError):
        engine.query("docs", spark.createDataFrame([(1, "")], "query_id int, query string"))
    s = evaluation.aggregate(evaluation.evaluate(r.trace)).first()
    assert s.queries == 2 and s.partial_queries == 0 and 0 < s.mean_utilization <= 1


def test_evaluate_and_regress(engine, spark, tmp_path):
    engine.put("docs", "find", LONG)
    p = tmp_path / "queries.jsonl"
    p.write_text(f'{{"query": "{LONG[:64]}"}}\n\n{LONG[300:420].strip()}\n')
    rows, summary = engine.evaluate("docs", str(p), budget=600)
    assert [r.query_id for r in rows.orderBy("query_id").collect()] == [0, 1]
    one = summary.first()
    assert one.queries == 2 and one.budget == 600 and 0 < one.mean_utilization <= 1
    base = tmp_path / "summary.json"
    base.write_text(evaluation.outputs(rows, summary)[1])
    assert engine.regress("docs", str(p), str(base), budget=600).count() == 0
    off = {r.metric: r.current for r in engine.regress("docs", str(p), str(base)).collect()}
    assert "budget" in off and off["mean_utilization"] is None


def test_fetch_and_search(engine, spark):
    ids = sorted(engine.catalog.list_point_ids("docs", "find")[64])[:3]
    asked = [ids[2], "nope", ids[0]]
    assert [r.point_id for r in engine.catalog.fetch_by_ids("docs", 64, asked).collect()] == [ids[2], ids[0]]
    v = engine.embedder.embed([LONG[:256]])[0]
    hit = engine.catalog.search_size("docs", 256, spark.createDataFrame([(1, v)], "query_id int, vector array<double>"), 1).first()
    assert (hit.document_id, hit.codepoint_offset) == ("find", 0) and len(hit.descendant_markers) == 6


def test_stream(engine, spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("live", "old", 1), ("live", "new text", 2)], "document_id string, text string, seq long").write.json(str(src))
    stream = spark.readStream.schema("document_id string, text string, seq long").json(str(src))
    ingest_stream(engine, "docs", stream, str(tmp_path / "cp")).awaitTermination(120)
    assert engine.get("docs", "live")["codepoint_length"] == 8


def test_evaluation_files(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"query": "a b"}\n\n{"text": "c"}\nplain line\n{"query": "", "text": "b"}\n{"other": 1}\n\t {"query": "tab"} \u3000\n\u00a0padded\t\n \t \n')
    assert sorted(r.query for r in evaluation.load_queries(spark, str(p)).collect()) == ["a b", "b", "c", "padded", "plain line", "tab"]
    p.write_text("{no json\n")
    with pytest.raises(Exception, match="not a JSON object"):
        evaluation.load_queries(spark, str(p)).collect()
    rows = spark.createDataFrame([(1, 2, 3, 1, 0.5, 2, 0, 0, 10, None, None, False), (2, 1, 1, 0, 1.0, 1, 1, 0, 5, 10, 0.5, True)], "query_id int, results int, forest_hits long, forest_edges long, participation_rate double, max_depth int, trade_ups int, rejections int, tokens_used long, budget int, utilization double, partial boolean")
    s = evaluation.aggregate(rows)
    r = s.first()
    assert (r.mean_participation, r.min_participation, r.mean_utilization, r.partial_queries) == (0.75, 0.5, 0.5, 1)
    assert [tuple(x) for x in r.depth_distribution] == [(1, 1), (2, 1)]
    text, js = evaluation.outputs(rows, s)
    evaluation.write_outputs(rows, s, f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "per_query.csv").read_text() == text and (tmp_path / "out" / "summary.json").read_text() == js
    assert text.splitlines()[1] == "1,2,3,1,0.5,2,0,0,10,,,False" and '"queries": 2' in js
    none = evaluation.aggregate(rows.limit(0)).first()
    assert none.queries == 0 and none.mean_depth == 0.0 and none.mean_utilization is None
    pairs = lambda *x: spark.createDataFrame(list(x), "metric string, value string")
    off = evaluation.compare_baseline(pairs(("a", "1.005"), ("b", "2"), ("c", "x")), pairs(("a", "1.0"), ("b", "1"), ("c", "y"), ("gone", "1")))
    assert [r.metric for r in off.collect()] == ["b", "c", "gone"]
    assert evaluation.as_metrics(s).count() == len(s.columns)


def test_slices_that_can_be_made_anew_are_not_stored(spark, tmp_path):
    """The store of a hashing embedder holds the texts, not their slices, and gives the slices that would have been stored."""
    import os
    import random

    letters = random.Random(3)
    d = spark.createDataFrame([(f"d{i}", "".join(letters.choices("abcdefghijklmnop", k=4000))) for i in range(30)], "document_id string, text string").coalesce(1)
    e = Engine(spark, f"file://{tmp_path}/s", FakeEmbedder(32))
    config = e.create_corpus("c")
    e.ingest("c", d)
    size = sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(tmp_path) for f in names)
    assert size < 2 * 30 * 4000
    gone = sorted(e.catalog.list_point_ids("c", "d7")[128])[:2]
    e.catalog.delete_points("c", "d7", gone)
    flat = lambda rows: sorted(tuple(map(str, r)) for r in rows.collect())
    points = e.points(config, d)
    want = flat(points.where(~F.col("point_id").isin(gone)).select(*e.catalog.slices("c").columns))
    assert flat(e.catalog.slices("c")) == want
    e.catalog.compact("c")
    assert flat(e.catalog.slices("c")) == want and len(e.catalog._corpus("c")[2]["layers"]) == 1
    assert sum(e.catalog.corpus_stats("c")[1].values()) == len(want) == e.catalog._corpus("c")[2]["layers"][0]["count"]["slices"]
