"""The engine: corpora, documents and queries as method calls, batch first."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BatchTooLarge, DocumentTooLarge, EmbedderMismatch, EngineError, SlicingError, ValidationError
from ..functions import counters
from ..functions.embedders import Embedder, FakeEmbedder, Registry, made_anew
from ..functions.exprs import marker
from ..grid import Grid
from ..operators import evaluation, retrieval, selection
from ..operators.slicing import KEY, check_text, slice_documents
from ..settings import Settings
from ..sources.catalog import Catalog, CorpusConfig, load_store
from ..sources.shared import few, materialise

#: Signs of a corpus' name and of a document's id at most.
NAME, DOCUMENT_ID = 128, 512


@dataclass
class QueryResult:
    """A batch's answers. selection: a row a chosen slice; trace: a row a query (None if not asked for); fanout: a row a query and size."""

    selection: DataFrame
    trace: DataFrame | None
    fanout: DataFrame
    partial: bool
    corpus: str
    strategy: str
    counter: str
    budgets: DataFrame  # query_id, budget, tokens_used, warnings
    warnings: list[str] = field(default_factory=list)


def between(name: str, value: int, low: int, high: int | None = None) -> None:
    if value < low or (high is not None and value > high):
        raise ValidationError(f"{name} is at least {low}" + (f" and at most {high}" if high is not None else ""))


def build_embedder(settings: Settings, registry: Registry | None = None) -> Embedder:
    """The embedder that the settings name; the fake one takes none of them."""
    e = settings.embedder
    if e.provider == "fake":
        return FakeEmbedder()
    options: dict = {"model": e.model, "batch_size": e.batch_size, "max_concurrency": e.max_concurrency}
    options |= {"base_url": e.base_url} if e.base_url is not None else {}
    options |= {"api_key": e.api_key} if e.api_key is not None and e.provider != "ollama" else {}
    return (registry or Registry()).create(e.provider, **options)


def build_store(spark: SparkSession, settings: Settings) -> Catalog:
    return load_store(settings.store.kind)(spark, settings.store.root)


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, embedder: Embedder | None = None, settings: Settings | None = None) -> None:
        """Without a root or an embedder those of the settings are used."""
        self.spark, self.settings = spark, settings or Settings()
        self.registry = Registry()
        self.embedder = embedder or build_embedder(self.settings, self.registry)
        self.catalog = Catalog(spark, root) if root else build_store(spark, self.settings)
        self.catalog.bootstrap()

    def check(self) -> dict:
        health, store = self.embedder.health(), self.catalog.ping()
        return {"store": store, "embedder": health, "ok": store and health["ok"]}

    def info(self) -> dict:
        """What this engine offers."""
        return {
            "embedder": self.embedder.fingerprint(), "embedders": self.registry.providers(), "counters": counters.registered(),
            "strategies": sorted(selection.STRATEGIES), "fusions": sorted(retrieval.FUSIONS), "defaults": self.settings.defaults, "limits": self.settings.limits,
        }

    # Corpora.

    def create_corpus(self, name: str, sizes: tuple[int, ...] | None = None, token_counter: str | None = None, embedder: Embedder | None = None) -> CorpusConfig:
        """Defaults are applied once and frozen: grid, then counter (it must load), then embedder and dimension."""
        between("the length of a corpus name", len(name), 1, NAME)
        grid = Grid(tuple(sizes or self.settings.defaults.grid_sizes))
        counter = token_counter or self.settings.defaults.tokenizer
        counters.proven(self.spark, counter)
        own = embedder or self.embedder
        if own.provider not in (self.embedder.provider, "fake"):
            raise ValidationError("a corpus uses this engine's embedder, or the fake one")
        config = CorpusConfig(name, grid.sizes, own.fingerprint(), own.dimension(), counter)
        self.catalog.create_corpus(config)
        return config

    def list_corpora(self) -> list[str]:
        return self.catalog.list_corpora()

    def inspect(self, name: str) -> dict:
        """Config, counts and why the corpus is degraded; without counts if files are missing."""
        config, degraded = self.catalog.get_corpus_meta(name), self.catalog.verify_corpus(name)
        documents, points = (None, {}) if any("missing" in r for r in degraded) else self.catalog.corpus_stats(name)
        return {"config": config, "documents": documents, "points": points, "total": sum(points.values()), "degraded": degraded}

    def drop_corpus(self, name: str) -> None:
        self.catalog.get_corpus_meta(name)
        self.catalog.drop_corpus(name)

    # Documents.

    def points(self, config: CorpusConfig, documents: DataFrame) -> DataFrame:
        slices = slice_documents(documents, config.grid, corpus=config.name, counter=counters.get(config.token_counter_id))
        return slices.withColumn("vector", self.embedder.column(F.col("text")))

    def ingest(self, name: str, documents: DataFrame) -> None:
        """Create or replace all of (document_id, text[, metadata]) in one flip. All is checked before anything is sliced: ids are
        distinct and have 1 to DOCUMENT_ID signs, texts are there, valid UTF-8 and not too long."""
        config = self.catalog.get_corpus_meta(name)
        self.check_embedder(config)
        if "metadata" not in documents.columns:
            documents = documents.withColumn("metadata", F.array().cast("array<struct<key:string,value:string>>"))
        signs = F.coalesce(F.length("document_id"), F.lit(0))
        r = documents.agg(
            F.max(F.length("text")).alias("longest"), F.count("*").alias("n"), F.count_distinct("document_id").alias("ids"), F.count_if(signs == 0).alias("nameless"),
            F.max(signs).alias("signs"), F.count_if(F.col("text").isNull()).alias("missing"), F.count_if(~F.is_valid_utf8("text")).alias("broken"),
        ).first()
        for bad, what in (("nameless", "a document id is a non-empty string"), ("missing", "a text is a string"), ("broken", "a text is valid UTF-8")):
            if r[bad]:
                raise SlicingError(f"{what}; {r[bad]} documents break this")
        between("the length of a document id", r["signs"] or 1, 1, DOCUMENT_ID)
        most = self.settings.limits.max_document_codepoints
        if (r["longest"] or 0) > most:
            raise DocumentTooLarge(f"{r['longest']} code points; at most {most}")
        if r["n"] != r["ids"]:
            raise ValidationError("an id stands twice")
        n = F.length("text")
        count = sum(((n + s - 1) / F.lit(s)).cast("long") for s in config.sizes)
        records = documents.select(
            "document_id", n.alias("codepoint_length"), F.octet_length("text").alias("byte_length"), count.alias("slice_count"),
            F.when(n > 0, marker(F.col("text"))).otherwise("").alias("content_marker"), "metadata",
        )
        if (own := made_anew(config.embedder_fingerprint)) is not None and type(own) is type(self.embedder):
            self.catalog.replace_texts(name, records, documents, config.grid.fingerprint())
        else:
            self.catalog.replace_documents(name, records, self.points(config, documents), config.grid.fingerprint())

    def check_embedder(self, config: CorpusConfig) -> None:
        if self.embedder.fingerprint() != config.embedder_fingerprint:
            raise EmbedderMismatch(f"the corpus holds vectors of {config.embedder_fingerprint}, this engine embeds with {self.embedder.fingerprint()}")

    def put(self, name: str, document_id: str, text: str, metadata: list[tuple[str, str]] = ()) -> dict:
        check_text(document_id, text)
        between("the length of a document id", len(document_id), 1, DOCUMENT_ID)
        self.ingest(name, self._frame([(document_id, text, list(metadata))]))
        return self.catalog.get_document_meta(name, document_id)

    def _frame(self, rows: list) -> DataFrame:
        return self.spark.createDataFrame(rows, "document_id string, text string, metadata array<struct<key:string,value:string>>")

    def put_batch(self, name: str, items: list[tuple[str, str]]) -> list[dict]:
        """A status for each item; items with coded errors do not keep the others from being stored."""
        if len(items) > self.settings.limits.max_batch_documents:
            raise BatchTooLarge(f"at most {self.settings.limits.max_batch_documents} documents")
        self.catalog.get_corpus_meta(name)
        status: dict[int, dict] = {}
        good: dict[str, tuple[int, str]] = {}
        for i, (d, t) in enumerate(items):
            try:
                check_text(d, t)
                between("the length of a document id", len(d), 1, DOCUMENT_ID)
                if len(t) > self.settings.limits.max_document_codepoints:
                    raise DocumentTooLarge(d)
                good[d] = (i, t)  # of an id that comes twice the last stands
                status[i] = {"document_id": d, "ok": True, "code": None}
            except EngineError as e:
                status[i] = {"document_id": d, "ok": False, "code": e.code}
        if good:
            self.ingest(name, self._frame([(d, t, []) for d, (_, t) in good.items()]))
        return [status[i] for i in range(len(items))]

    def get(self, name: str, document_id: str) -> dict:
        self.catalog.get_corpus_meta(name)
        return self.catalog.get_document_meta(name, document_id)

    def delete(self, name: str, document_id: str) -> None:
        self.catalog.get_corpus_meta(name)
        self.catalog.delete_document(name, document_id)

    def list_page(self, name: str, limit: int = 100, cursor: str | None = None) -> tuple[list[dict], str | None]:
        between("a page's length", limit, 1, 1000)
        self.catalog.get_corpus_meta(name)
        return self.catalog.list_documents(name, limit, cursor)

    # Queries.

    def query(
        self, name: str, queries: DataFrame, *, budget: int | None = None, k: int | None = None, strategy: str | selection.Strategy | None = None, expansion: str = "fill",
        sizes: list[int] | None = None, token_counter: str | None = None, max_slice_size: int | None = None, overhead: int = 0,
        fusion: str | Callable[[DataFrame], DataFrame] = "tier_interleave", include_text: bool = True, include_trace: bool = True,
    ) -> QueryResult:
        """Answers for a batch of (query_id, query), whose option columns go before the arguments.

        A size that cannot be searched is named in fanout and makes the answer partial; if larger slices cannot be fetched, only
        hits are traded up to.
        """
        config = self.catalog.get_corpus_meta(name)
        self.check_embedder(config)
        k = self.settings.defaults.top_k_per_size if k is None else k
        strategy = strategy or self.settings.defaults.strategy
        most = self.settings.limits.max_token_budget
        between("k", k, 1)
        selection.strategy_of(strategy)
        if not callable(fusion) and fusion not in retrieval.FUSIONS:
            raise ValidationError(f"fusion is one of {sorted(retrieval.FUSIONS)}")
        if budget is not None:
            between("a budget", budget, 0)
        if queries.where(F.coalesce(F.length("query"), F.lit(0)) < 1).limit(1).count():
            raise ValidationError("a query has at least one character")
        budget, warned = retrieval.cap_budget(budget, most)
        asked, more = retrieval.resolve_sizes(config.grid, sizes)
        counter = token_counter or config.token_counter_id
        options = selection.with_options(queries.drop("query"), budget, expansion, max_slice_size, overhead, counter == config.token_counter_id)
        options = options.withColumn("budget", F.when(F.col("budget").isNotNull(), F.least("budget", F.lit(most))))
        vectors = queries.select("query_id", self.embedder.column(F.col("query")).alias("vector"))
        found, errors = retrieval.search_sizes(vectors, self.catalog.slices(name, lean=True), asked, k, timeout=self.settings.store.search_timeout_s)
        fanout = retrieval.fan_out(queries, asked, found, errors)
        # What was found and all that encloses it, read from the store once.
        keys = found.select(*KEY).unionByName(retrieval.closure_keys(found, config.grid).select(*KEY)).distinct()
        healthy = self.catalog.slices(name, tuple(s for s in config.sizes if s not in errors), keys.select("document_id").distinct(), vectors=False)
        near = materialise(healthy.drop("vector").join(F.broadcast(keys) if few(found, retrieval.BROADCAST_ROWS) else keys, KEY), "near")
        chosen, trace = selection.select(
            retrieval.attach(found, near), options, near, grid=config.grid, counter=counters.get(counter), corpus=name, strategy=strategy,
            fusion=fusion if callable(fusion) else retrieval.FUSIONS[fusion],
        )
        trace = trace.withColumn("partial", F.lit(bool(errors)))
        facts = ["own_marker", "token_count", *(["text"] if include_text else [])]
        return QueryResult(
            chosen.join(near.select(*KEY, "point_id", *facts), [*KEY, "point_id"], "left"), trace if include_trace else None, fanout, bool(errors), name,
            strategy if isinstance(strategy, str) else strategy.__name__, counter, trace.select("query_id", "budget", "tokens_used", "warnings"), warned + more,
        )

    # Evaluation.

    def evaluate(self, name: str, queries: DataFrame | str, *, budget: int | None = None, k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(a row a query, their aggregate) of (query_id, query), or of the lines of a file of queries, numbered in order."""
        if isinstance(queries, str):
            queries = materialise(evaluation.load_queries(self.spark, queries).coalesce(1).withColumn("query_id", F.monotonically_increasing_id()), "queries")
        rows = materialise(evaluation.evaluate(self.query(name, queries, budget=budget, k=k).trace), "evaluation")
        return rows, evaluation.aggregate(rows).withColumn("budget", F.lit(budget).cast("int"))

    def regress(self, name: str, queries: DataFrame | str, baseline: DataFrame | str, *, budget: int | None = None, k: int | None = None, tolerance: float = 0.01) -> DataFrame:
        """The metrics that drifted from a baseline: (metric, value), or the path of a summary's JSON."""
        known = evaluation.load_baseline(self.spark, baseline) if isinstance(baseline, str) else baseline
        _, summary = self.evaluate(name, queries, budget=budget, k=k)
        return evaluation.compare_baseline(evaluation.as_metrics(summary), known, tolerance)


    def evaluation_report(self, kind: str, name: str, queries: DataFrame | str, *, budget: int | None = None, k: int | None = None, out: str | None = None) -> dict:
        """The `forest` or `budget` part of an evaluation's aggregate; with out, the outputs are written there too."""
        if kind not in evaluation.REPORTS:
            raise ValidationError(f"a report is one of {sorted(evaluation.REPORTS)}")
        rows, summary = self.evaluate(name, queries, budget=budget, k=k)
        if out:
            evaluation.write_outputs(rows, summary, out)
        one = summary.first().asDict(recursive=True)
        return {k: one[k] for k in evaluation.REPORTS[kind]}

    # Tools: what an assistant calls, one query at a time.

    def query_tool(self, corpus: str, query: str, token_budget: int | None = None) -> dict:
        """One query's answer as a dict, with its `text` rendered; without a budget the settings' own holds."""
        budget = self.settings.tools.default_token_budget if token_budget is None else token_budget
        batch = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        result = self.query(corpus, batch, budget=budget, include_trace=False)
        answer = json.loads(response(result).first()["response"])
        context = render_context(result.selection).first()
        return answer | {"text": context["context"] if context else "No matching passages."}

    def list_corpora_tool(self) -> dict:
        return {"corpora": self.list_corpora()}

    def add_document_tool(self, corpus: str, document_id: str, text: str) -> dict:
        self._document_tools()
        return self.put(corpus, document_id, text)

    def delete_document_tool(self, corpus: str, document_id: str) -> dict:
        self._document_tools()
        self.delete(corpus, document_id)
        return {"deleted": document_id}

    def _document_tools(self) -> None:
        if not self.settings.tools.enable_document_tools:
            raise ValidationError("tools that change documents are switched off")


def render_context(selection_with_text: DataFrame) -> DataFrame:
    """query_id, context: the chosen slices in order, each under `[document @ start..end, size n]`."""
    head = F.concat(
        F.lit("["), F.col("document_id"), F.lit(" @ "), F.col("codepoint_offset").cast("string"), F.lit(".."),
        (F.col("codepoint_offset") + F.col("codepoint_length")).cast("string"), F.lit(", size "), F.col("size").cast("string"), F.lit("]\n"),
    )
    item = F.struct("position", F.concat(head, F.col("text")).alias("t"))
    return selection_with_text.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n\n").alias("context"))


def response(result: QueryResult) -> DataFrame:
    """query_id, response: each query's whole answer as JSON. A result's retrieval score and rank are null unless the slice itself was found."""
    own = F.filter("evidence", lambda e: (e["size"] == F.col("size")) & (e["codepoint_offset"] == F.col("codepoint_offset")))
    found = F.get(own, F.lit(0))
    text = [F.col("text")] if "text" in result.selection.columns else [F.lit(None).cast("string").alias("text")]
    coords = F.struct("document_id", "size", "codepoint_offset", "codepoint_length", (F.col("codepoint_offset") + F.col("codepoint_length")).alias("codepoint_end"), "own_marker")
    item = F.struct(
        "position", F.col("point_id").alias("id"), coords.alias("coords"), *text, "token_count", "provenance", "effective_rank", "contiguous_with_next",
        F.struct(found.isNotNull().alias("retrieved"), found["rank_in_size"].alias("rank_in_size"), found["raw_score"].alias("score")).alias("retrieval"),
        F.struct("action", F.col("replaced_ids").alias("replaced"), "levels").alias("selection"), "evidence",
    )
    results = result.selection.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("results"))
    fanout = result.fanout.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("size", (F.col("status") == "ok").alias("ok"), "hits", "error"))).alias("fanout"))
    out = result.budgets.join(results, "query_id", "left").join(fanout, "query_id", "left")
    if result.trace is not None:
        names = [c for c in result.trace.columns if c not in ("query_id", "results", "partial")]
        out = out.join(result.trace.select("query_id", F.struct(*names).alias("trace")), "query_id", "left")
    warnings = F.concat(F.array(*map(F.lit, result.warnings)).cast("array<string>"), "warnings")
    whole = F.struct(
        F.lit(result.corpus).alias("corpus"), F.lit(result.strategy).alias("strategy"),
        F.struct(F.col("budget").alias("limit"), F.col("tokens_used").alias("used"), F.lit(result.counter).alias("counter")).alias("budget"),
        F.lit(result.partial).alias("partial"), "fanout", F.coalesce("results", F.array()).alias("results"),
        *(["trace"] if result.trace is not None else [F.lit(None).cast("string").alias("trace")]), warnings.alias("warnings"),
    )
    return out.select("query_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("response"))
