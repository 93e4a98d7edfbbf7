"""The registered queries over the shared tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import counters
from ..functions.embedders import FakeEmbedder, OllamaEmbedder, OpenAICompatibleEmbedder
from ..functions.exprs import fake_vector, fake_vector_batches, pack_markers, unpack_markers
from ..grid import DEFAULT_GRID
from ..operators import evaluation, forest, retrieval, selection, slicing
from ..sources import catalog
from ..sources.shared import folder, materialise
from .engine import Engine, render_context, response

GRID, DIM, K, BUDGET = DEFAULT_GRID, 32, 10, 3_000
KEY = slicing.KEY
Q = ["query_id", *KEY]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").cast("string").alias("document_id"), "text")


def slices(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return slicing.slice_documents(documents(spark, sf_dir), GRID, **options)


_written: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries use, written into the shared folder by the first of them in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        _written[key] = materialise(make(), name)
    return _written[key]


def query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark texts, as one batch."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select(F.col("item_id").alias("query_id"), fake_vector(F.col("text"), DIM).alias("vector"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of all slices of all documents for all benchmark texts, which the queries from topk_per_size on start from."""
    points = slices(spark, sf_dir, with_descendants=False, with_bytes=False).select(*KEY, "point_id", fake_vector_batches(F.col("text"), DIM).alias("vector"))
    return once(spark, sf_dir, "found", lambda: retrieval.search(query_batch(spark, sf_dir), points, K, keep=("document_id", "codepoint_offset")))


def near_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slices that were found, and those that enclose them."""
    keys = found(spark, sf_dir)
    places = keys.select(*KEY).unionByName(retrieval.closure_keys(keys, GRID).select(*KEY))
    return once(spark, sf_dir, "near", lambda: slicing.slices_at(documents(spark, sf_dir), places, GRID, counter=counters.chars))


def hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(hits with all slice columns, the slices they can be traded up to)."""
    own = near_slices(spark, sf_dir)
    return once(spark, sf_dir, "hits", lambda: retrieval.attach(found(spark, sf_dir), own)), own


def slice_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slices(spark, sf_dir, with_descendants=False, with_ids=False)
    return s.select(*KEY, "codepoint_length", "byte_offset", "byte_length", "document_codepoint_length")


def slice_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices(spark, sf_dir, with_descendants=False, with_bytes=False).select(*KEY, "own_marker", "point_id")


def slice_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slices(spark, sf_dir, counter=counters.chars, with_descendants=False, with_bytes=False, with_ids=False)
    return s.select(*KEY, "token_count")


def descendant_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("descendant_markers")
    return slices(spark, sf_dir, with_ids=False).select(*KEY, F.size(d).alias("n_descendants"), F.sha2(F.array_join(d, ","), 256).alias("digest"))


def marker_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slices(spark, sf_dir, with_ids=False).withColumn("packed", pack_markers(F.col("descendant_markers")))
    return s.select(*KEY, F.md5("packed").alias("packed_digest"), F.md5(F.array_join(unpack_markers(F.col("packed")), ",")).alias("unpacked_digest"))


def spine_prefix_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.spine_gate(slices(spark, sf_dir, with_ids=False), GRID)


def reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slices(spark, sf_dir, with_descendants=False, with_bytes=False, with_ids=False)
    return slicing.rebuild(s).select("document_id", "size", F.md5("text").alias("digest"), F.octet_length("text").alias("bytes"))


def grid_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.ancestors(slices(spark, sf_dir, with_descendants=False, with_bytes=False, with_ids=False), GRID)


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.stats(slices(spark, sf_dir, with_descendants=False, with_bytes=False, with_ids=False), GRID)


def fake_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = documents(spark, sf_dir).select("document_id", F.posexplode(fake_vector(F.col("text"), DIM)).alias("i", "x"))
    return v.select("document_id", "i", F.round("x", 9).alias("x"))


def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine top-k on the shared vectors; the batch is every 20th vector."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.lit(0).alias("size"))
    q = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "vector")
    out = retrieval.search(q, e, K, tie="vec_id", exclude_same="vec_id")
    return out.select("query_id", "rank", "vec_id", F.round("score", 9).alias("score"))


def topk_per_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("query_id", "size", "rank", "point_id", F.round("score", 9).alias("score"))


def fanout_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fan_out(query_batch(spark, sf_dir), GRID.sizes, found(spark, sf_dir)).select("query_id", "size", "status", "hits")


def tier_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.tier_interleave(found(spark, sf_dir)).select(*Q, "fused_rank")


def raw_score_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.raw_score_pool(found(spark, sf_dir)).select(*Q, "fused_rank")


def prefetch_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, own = hits(spark, sf_dir)
    return retrieval.fetch(retrieval.closure_keys(h, GRID), own).select(*Q, "own_marker")


def forest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _ = forest.build_forest(hits(spark, sf_dir)[0], GRID)
    return forest.edges(f).select(*Q, "parent_size", "parent_offset")


def forest_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _ = forest.build_forest(hits(spark, sf_dir)[0], GRID)
    return forest.edges(f, closure=True, grid=GRID)


def forest_roots_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _ = forest.build_forest(hits(spark, sf_dir)[0], GRID)
    return forest.roots(f).withColumn("kind", F.lit("root")).unionByName(forest.leaves(f).withColumn("kind", F.lit("leaf")))


def forest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, odd = forest.build_forest(hits(spark, sf_dir)[0], GRID)
    m = forest.metrics(f, odd, GRID)
    return m.select("query_id", "hit_count", "edge_count", "anomaly_count", F.round("participation_rate", 9).alias("participation_rate"), "max_depth")


def stale(h: DataFrame) -> DataFrame:
    """Hits where every third place of a size has lost its descendants, as after a replaced document."""
    lost = (F.col("codepoint_offset") / F.col("size")).cast("int") % 3 == 0
    return h.withColumn("descendant_markers", F.when(lost, F.array().cast("array<string>")).otherwise(F.col("descendant_markers")))


def forest_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.build_forest(stale(hits(spark, sf_dir)[0]), GRID)[1]


def stale_forest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, odd = forest.build_forest(stale(hits(spark, sf_dir)[0]), GRID)
    m = forest.metrics(f, odd, GRID)
    return m.select("query_id", "hit_count", "edge_count", "anomaly_count", F.round("participation_rate", 9).alias("participation_rate"), "max_depth")


def stale_forest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _ = forest.build_forest(stale(hits(spark, sf_dir)[0]), GRID)
    return forest.edges(f).select(*Q, "parent_size", "parent_offset")


def _classes(h: DataFrame) -> DataFrame:
    fused = retrieval.tier_interleave(h)
    f, _ = forest.build_forest(fused, GRID)
    return selection.dedup_classes(fused, materialise(f, "forest"), GRID)


def dedup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(hits(spark, sf_dir)[0]).select(*Q, "eff_rank", F.size("evidence").alias("n_evidence"))


def first_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, _ = hits(spark, sf_dir)
    c = _classes(h).join(h.select(*Q, F.col("token_count").cast("long").alias("cost")), Q)
    q = h.select("query_id").distinct().withColumn("budget", F.lit(BUDGET))
    return selection.pack(c, q).select(*Q, "packed", "budget_left")


def dedupe_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, own = hits(spark, sf_dir)
    chosen, _ = selection.budget_fit(h, budget=None, slices=own, strategy="dedupe_only", grid=GRID)
    return chosen.select("query_id", "position", "document_id", "size", "codepoint_offset", "effective_rank", "contiguous_with_next")


def trade_up_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, own = hits(spark, sf_dir)
    chosen, _ = selection.budget_fit(h, budget=100_000_000, slices=own, grid=GRID)
    return chosen.select(*Q)


def _traded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(selection, trace) of all queries under BUDGET."""
    h, own = hits(spark, sf_dir)
    return selection.budget_fit(h, budget=BUDGET, slices=own, grid=GRID)


def trade_up_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, _ = _traded(spark, sf_dir)
    return chosen.select("query_id", "position", *KEY, "action", "levels", "cost", F.size("replaced_ids").alias("n_replaced"), F.size("evidence").alias("n_evidence"))


def trade_up_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trade and each refusal of the trade-up."""
    _, trace = _traded(spark, sf_dir)
    trades = trace.select("query_id", F.explode("trade_ups").alias("t")).select(
        "query_id", "t.round", "t.to_ref.*", F.col("t.to_provenance").alias("outcome"), F.size("t.subsumed_ids").alias("n_subsumed"), "t.delta_tokens", "t.budget_left"
    )
    refusals = trace.select("query_id", F.explode("rejections").alias("r")).select("query_id", "r.round", "r.target.*", F.col("r.reason").alias("outcome"), "r.delta_tokens")
    return trades.unionByName(refusals, allowMissingColumns=True)


def trace_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, trace = _traded(spark, sf_dir)
    return selection.replay_ids(trace).where(F.size("ids") > 0).select("query_id", F.array_join("ids", ",").alias("ids"))


def selection_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's sums: what was used, kept and passed over."""
    _, trace = _traded(spark, sf_dir)
    skipped = F.coalesce(F.size("skipped_unaffordable"), F.lit(0))
    return trace.select(
        "query_id", "tokens_used", "results", skipped.alias("skipped"), F.col("smallest_unaffordable_tokens").alias("smallest_unaffordable"),
        F.round("utilization", 9).alias("utilization"), "budget_exhausted",
    )


def orphan_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that go when each document is cut to its first two thirds: known by place, whatever their text."""
    old = documents(spark, sf_dir)
    new = old.withColumn("text", F.substring("text", F.lit(1), (F.length("text") * 2 / 3).cast("int")))
    before = slicing.slice_documents(old, GRID, with_descendants=False, with_bytes=False).select("size", "point_id")
    after = slicing.slice_documents(new, GRID, with_descendants=False, with_bytes=False).select("size", "point_id")
    return before.join(after, ["size", "point_id"], "left_anti")


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation's row of each query under BUDGET."""
    rows = evaluation.evaluate(_traded(spark, sf_dir)[1]).drop("partial")
    return rows.withColumns({c: F.round(c, 9) for c in ("participation_rate", "utilization")})


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation of the answers under BUDGET."""
    s = evaluation.aggregate(evaluation.evaluate(_traded(spark, sf_dir)[1]))
    numbers = [F.round(c, 9).alias(c) for c in s.columns if c.startswith(("mean_", "min_"))]
    return s.select("queries", *numbers, F.to_json("depth_distribution").alias("depths"))


def grid_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid by itself: what is above and below each size, the fingerprint, and the slice above one at a place of each document."""
    sizes = spark.createDataFrame([(s, GRID.fingerprint(), s in GRID, s == GRID.smallest, s == GRID.largest) for s in GRID.sizes], "size int, fingerprint string, known boolean, smallest boolean, largest boolean")
    up, down = GRID.above_column(F.col("size")), GRID.below_column(F.col("size"))
    place = (F.length("text") - 1 - (F.length("text") - 1) % F.col("size")).cast("int")
    above = F.get(GRID.ancestors_column(F.col("size"), place), F.lit(0))
    return documents(spark, sf_dir).where("length(text) > 0").crossJoin(F.broadcast(sizes)).select(
        "document_id", "size", "fingerprint", "known", "smallest", "largest", F.array_join(up, ",").alias("above"), F.array_join(down, ",").alias("below"),
        place.alias("codepoint_offset"), above["size"].alias("parent_size"), above["codepoint_offset"].alias("parent_offset"),
    )


def slice_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of one size, each document's slice at one place, and slices cut by place only."""
    s = slices(spark, sf_dir)
    digest = F.sha2(F.array_join("descendant_markers", ","), 256).alias("digest")
    own = s.select(*KEY, "byte_offset", "own_marker", "point_id", digest)
    some = documents(spark, sf_dir).select("document_id", F.explode(F.array(F.lit(64), F.lit(512))).alias("size")).withColumn("codepoint_offset", F.lit(512))
    cut = slicing.slices_at(documents(spark, sf_dir), some, GRID).select(*KEY, "byte_offset", "own_marker", "point_id", digest)
    parts = (("size", slicing.of_size(own, 256)), ("place", slicing.slice_at(own, 128, 128)), ("cut", cut))
    out = None
    for kind, part in parts:
        part = part.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def doubled(h: DataFrame) -> DataFrame:
    """Hits as two merged hit lists give them: each twice."""
    return h.unionByName(h)


def doubled_dedup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(doubled(hits(spark, sf_dir)[0])).select(*Q, "eff_rank", F.size("evidence").alias("n_evidence"))


def doubled_trade_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated hits are one slice: packed once, charged once, and replayed once."""
    h, own = hits(spark, sf_dir)
    chosen, trace = selection.budget_fit(doubled(h), budget=100_000_000, slices=own, grid=GRID)
    ids = selection.replay_ids(trace).select("query_id", F.explode("ids").alias("point_id"))
    return chosen.join(ids, ["query_id", "point_id"]).select(*Q)


def recounted_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored counts are not trusted: every slice is counted anew, at two tokens a code point and one for each join."""
    counters.register("pairs", lambda: lambda text: F.length(text) * 2)
    h, own = hits(spark, sf_dir)
    chosen, _ = selection.budget_fit(h, budget=BUDGET, slices=own, grid=GRID, counter=counters.get("pairs"), expansion="off", overhead=1, trust_stored_counts=False)
    return chosen.select(*Q, "cost")


def longest_first(request: selection.Request) -> tuple[DataFrame, DataFrame]:
    """A strategy of a caller's own: the longest hit of each document, larger sizes first."""
    place = W.partitionBy("query_id", "document_id").orderBy(F.desc("codepoint_length"), F.desc("size"), "codepoint_offset")
    one = request.fused.withColumn("place", F.row_number().over(place)).where("place = 1")
    return one, request.queries


def own_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, own = hits(spark, sf_dir)
    chosen, _ = selection.budget_fit(h, budget=BUDGET, slices=own, grid=GRID, strategy=longest_first)
    return chosen.select(*Q, "codepoint_length")


def _answer(url: str, body: dict, headers: dict, timeout: float) -> tuple[int, dict]:
    """A server that gives the fake embedder's vectors: an old one that knows one text at a time, and one that answers out of order."""
    fake = FakeEmbedder(DIM)
    if url.startswith("http://old"):
        return (404, {}) if url.endswith("/api/embed") else (200, {"embedding": fake.embed([body["prompt"]])[0]})
    return 200, {"data": [{"index": i, "embedding": v} for i, v in enumerate(fake.embed(body["input"]))][::-1]}


def http_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the HTTP embedders, asked in batches from the tasks."""
    d = documents(spark, sf_dir)
    makers = {"openai": OpenAICompatibleEmbedder("http://new", "m", post=_answer, batch_size=7), "ollama": OllamaEmbedder("http://old", "m", post=_answer, batch_size=5)}
    out = None
    for name, e in makers.items():
        part = d.select(F.lit(e.fingerprint()).alias("fingerprint"), "document_id", F.posexplode(e.column(F.col("text"))).alias("i", "x")).where("i % 8 = 3")
        part = part.select("fingerprint", "document_id", "i", F.round("x", 9).alias("x"))
        out = part if out is None else out.unionByName(part)
    return out


def query_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries read from a file whose lines take all forms: objects with query, with an empty query and text, with neither, plain lines, blanks."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.regexp_replace("text", r"\s+", " ").alias("text"))
    form = F.col("item_id") % 5
    line = (
        F.when(form == 0, F.to_json(F.struct(F.col("text").alias("query"), F.lit("other").alias("text"))))
        .when(form == 1, F.to_json(F.struct(F.lit("").alias("query"), "text")))
        .when(form == 2, F.concat(F.lit("\t "), "text", F.lit(" \t")))
        .when(form == 3, F.to_json(F.struct(F.col("text").alias("other"))))
        .otherwise(F.lit("  "))
    )
    at = f"{folder(spark)}/queries-{uuid.uuid4().hex}"
    b.select(line.alias("value")).write.text(at)
    return evaluation.load_queries(spark, at).groupBy("query").agg(F.count("*").alias("n"))


def fanout_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A size whose storage cannot be read does not keep the others from answering."""
    points = slices(spark, sf_dir, with_descendants=False, with_bytes=False).select(*KEY, "point_id", fake_vector(F.col("text"), DIM).alias("vector"))
    broken = points.withColumn("vector", F.when(F.col("size") == 256, F.raise_error(F.lit("bad block"))).otherwise(F.col("vector")))
    q = query_batch(spark, sf_dir).where("query_id % 10 = 0")
    found_, errors = retrieval.search_sizes(q, broken, GRID.sizes, K)
    return retrieval.fan_out(q, GRID.sizes, found_, errors).select("query_id", "size", "status", "hits", F.col("error").isNull().alias("clean"))


def store(spark: SparkSession, sf_dir: str) -> Engine:
    """A store in the shared folder with a history: all documents ingested, every seventh replaced by its first half, two deleted, one
    with other metadata, one without its smallest slices; then all layers but the base merged."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        e = Engine(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}", FakeEmbedder(DIM))
        e.create_corpus("default")
        d = spark.read.parquet(f"{sf_dir}/documents.parquet")
        pair = lambda k: F.struct(F.lit(k).alias("key"), F.col(k).alias("value"))
        own = d.select(F.col("doc_id").cast("string").alias("document_id"), "text", F.array(pair("lang"), pair("source")).alias("metadata"))
        e.ingest("default", own)
        seventh = F.col("document_id").cast("long") % 7 == 0
        e.ingest("default", own.where(seventh).withColumn("text", F.substring("text", F.lit(1), F.ceil(F.length("text") / 2).cast("int"))))
        e.delete("default", "11")
        e.delete("default", "12")
        e.catalog.put_document_meta("default", e.catalog.documents("default").where("document_id = '5'").withColumn("metadata", F.slice("metadata", 1, 1)))
        e.catalog.delete_points("default", "6", [*e.catalog.list_point_ids("default", "6")[64], "unknown"])
        _stores[key] = e
    return _stores[key]


_stores: dict[tuple[str, str], Engine] = {}


def store_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records, page after page as a client reads them."""
    e = store(spark, sf_dir)
    shape = "page int, document_id string, codepoint_length int, byte_length int, slice_count long, content_marker string, metadata string"
    make = batches_of(spark, shape)
    parts, cursor, page = [], None, 0
    while page == 0 or cursor is not None:
        some, cursor = e.list_page("default", 1000, cursor)
        parts.append(make([(page, r["document_id"], r["codepoint_length"], r["byte_length"], r["slice_count"], r["content_marker"], ";".join(f"{m['key']}={m['value']}" for m in r["metadata"])) for r in some]))
        page += 1
    return spark.createDataFrame(pa.Table.from_batches(parts), shape)


def batches_of(spark: SparkSession, shape: str) -> Callable[[list[tuple]], pa.RecordBatch]:
    """Rows as an Arrow batch, which takes a small part of their room on the driver."""
    arrow = to_arrow_schema(spark.createDataFrame([], shape).schema)
    return lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(arrow), arrow, strict=True)], schema=arrow)


def store_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir).catalog.slices("default")
    return s.select("corpus", *KEY, "codepoint_length", "byte_offset", "byte_length", "token_count", "own_marker", "point_id", F.size("descendant_markers").alias("n_descendants"), F.round(F.get("vector", F.lit(0)), 9).alias("x"))


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = store(spark, sf_dir).inspect("default")
    rows = [(s, n, one["documents"], one["total"], len(one["degraded"])) for s, n in one["points"].items()]
    return spark.createDataFrame(rows, "size int, points long, documents long, total long, degraded int")


def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One size of the store searched, with the slices' own columns."""
    hits_ = store(spark, sf_dir).catalog.search_size("default", 256, query_batch(spark, sf_dir), K)
    return hits_.select("query_id", "rank", "size", "document_id", "codepoint_offset", "point_id", "own_marker", F.round("score", 9).alias("score"))


def store_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices by id, in the order asked for, and slices by place; ids and places that are not there are left out."""
    c = store(spark, sf_dir).catalog
    ids = [i for d in ("20", "11", "14", "6") for i in sorted(c.list_point_ids("default", d)[128])][::-1]
    by_id = c.fetch_by_ids("default", 128, ["unknown", *ids]).select(*KEY, "own_marker").withColumn("kind", F.lit("id"))
    places = documents(spark, sf_dir).select("document_id", F.lit(512).alias("size"), F.lit(512).alias("codepoint_offset"))
    by_place = c.get_slices("default", places.unionByName(places.withColumn("size", F.lit(7)))).select(*KEY, "own_marker").withColumn("kind", F.lit("place"))
    return by_id.unionByName(by_place)


def engine_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's whole answers over the store, taken apart again from their JSON."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    result = store(spark, sf_dir).query("default", b, budget=BUDGET)
    item = (
        "position:int,id:string,coords:struct<document_id:string,size:int,codepoint_offset:int,codepoint_end:int,own_marker:string>,text:string,token_count:int,"
        "effective_rank:int,retrieval:struct<retrieved:boolean,rank_in_size:int>,selection:struct<action:string,levels:int>"
    )
    shape = f"budget struct<`limit`:int,used:long,counter:string>, partial boolean, results array<struct<{item}>>, trace struct<hit_count:long>, warnings array<string>"
    one = response(result).select("query_id", F.from_json("response", shape).alias("r"))
    return one.select("query_id", "r.budget.*", "r.partial", F.size("r.warnings").alias("n_warnings"), F.col("r.trace.hit_count").alias("hit_count"), F.explode("r.results").alias("x")).select(
        "query_id", "limit", "used", "counter", "partial", "n_warnings", "hit_count", "x.position", "x.id", "x.coords.*", F.md5("x.text").alias("digest"), "x.token_count", "x.effective_rank", "x.retrieval.*", "x.selection.*",
    )


def engine_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered context of each query."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    result = store(spark, sf_dir).query("default", b, budget=BUDGET, include_trace=False)
    return render_context(result.selection).select("query_id", F.md5("context").alias("digest"), F.length("context").alias("length"))


def trade_up_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that mixes options by query: expansion, a largest size, a budget and its cap."""
    h, own = hits(spark, sf_dir)
    q = h.select("query_id").distinct()
    kind = F.col("query_id") % 4
    options = q.select(
        "query_id", F.when(kind == 0, F.lit("off")).when(kind == 1, F.lit("retrieved_only")).otherwise(F.lit("fill")).alias("expansion"),
        F.when(kind == 2, F.lit(256)).cast("int").alias("max_slice_size"), F.lit(100_000_000).alias("budget"),
    )
    chosen, _ = selection.select(h, options, own, grid=GRID)
    return chosen.select(*Q)


def baseline_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean length of each source's texts against that of its English texts: which drift by more than a hundredth."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = d.groupBy(F.col("source").alias("metric")).agg(F.avg("n_chars").cast("long").cast("string").alias("value"))
    then = d.where(F.col("lang") == "en").groupBy(F.col("source").alias("metric")).agg(F.avg("n_chars").cast("long").cast("string").alias("value"))
    return evaluation.compare_baseline(now, then, 0.01)


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    slice_geometry, slice_markers, slice_token_counts, descendant_markers, marker_codec_roundtrip, spine_prefix_gate, reconstruction, grid_ancestors,
    corpus_stats, fake_embedding, embedding_topk, topk_per_size, fanout_status, tier_interleave, raw_score_pool, prefetch_closure, forest_edges,
    forest_closure, forest_roots_leaves, forest_metrics, forest_anomalies, stale_forest_edges, stale_forest_metrics, dedup_classes, first_fit_pack, dedupe_selection,
    trade_up_unbounded, trade_up_budgeted, trade_up_trace, trace_replay, selection_accounts, orphan_tombstones, eval_rows, eval_summary, baseline_drift,
    grid_ladder, slice_lookups, doubled_dedup_classes, doubled_trade_up, recounted_pack, own_strategy, trade_up_options, http_embedding, query_file, fanout_partial,
    store_documents, store_slices, store_stats, store_search, store_fetch, engine_answers, engine_context,
)
