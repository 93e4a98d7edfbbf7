"""Selection: keep the smallest matching slices, pack them under a budget, trade them up, order the result.

Queries carry their options as columns (budget, expansion, max_slice_size, overhead), so one batch may
mix them. All but the trade-up is declarative.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.counters import chars
from ..grid import DEFAULT_GRID, Grid
from ..sources.shared import materialise
from . import forest as forests
from .retrieval import closure_keys, fetch, tier_interleave
from .slicing import KEY
from .tradeup import Evidence, Shelved, TradeUp, climber

Q = ["query_id", *KEY]
EXPANSIONS = ("fill", "retrieved_only", "off")
#: What a query is told whose budget is spent before anything was chosen.
NOTHING_FITS = "the budget is too small for any slice; nothing was chosen"


@dataclass(frozen=True)
class Request:
    """What a strategy is given: a batch of fused hits (written), their queries with all options, the slices to fetch from, and the
    forest of the hits with its anomalies."""

    fused: DataFrame
    queries: DataFrame
    slices: DataFrame | None
    forest: DataFrame
    anomalies: DataFrame
    grid: Grid
    counter: Callable[[Column], Column]
    corpus: str


#: A strategy makes (selection, trace) of a request.
Strategy = Callable[[Request], tuple[DataFrame, DataFrame]]
STRATEGIES: dict[str, Strategy] = {}


def register_strategy(name: str, strategy: Strategy) -> None:
    """Make a strategy known by name; one registered later wins."""
    STRATEGIES[name] = strategy


def strategy_of(strategy: str | Strategy) -> Strategy:
    if callable(strategy):
        return strategy
    if strategy not in STRATEGIES:
        raise ValidationError(f"strategy is one of {sorted(STRATEGIES)}")
    return STRATEGIES[strategy]


def with_options(queries: DataFrame, budget: int | None = None, expansion: str = "fill", max_slice_size: int | None = None, overhead: int = 0, trust_stored_counts: bool = True) -> DataFrame:
    """Queries with all option columns; those that are there already stay."""
    if expansion not in EXPANSIONS:
        raise ValidationError(f"expansion is one of {EXPANSIONS}")
    if budget is not None and budget < 0:
        raise ValidationError("a budget is not negative")
    defaults = {
        "budget": F.lit(budget).cast("int"), "expansion": F.lit(expansion), "max_slice_size": F.lit(max_slice_size).cast("int"),
        "overhead": F.lit(overhead).cast("int"), "trust_stored_counts": F.lit(trust_stored_counts),
    }
    return queries.withColumns({k: v for k, v in defaults.items() if k not in queries.columns})


def tokens(counter: Callable[[Column], Column], trust: Column) -> Column:
    """The stored count where it is trusted and there, else counted anew."""
    return F.coalesce(F.when(trust, F.col("token_count")), counter(F.col("text")))


def dedup_classes(hits: DataFrame, forest: DataFrame, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """One class a leaf: its key, eff_rank, evidence (the leaf and the hits above it), dropped (their keys).

    hits have fused_rank, score, rank; of a coordinate that was hit several times the last hit counts, in order of fused_rank.
    """
    hits = forests.one_of_each(hits, "fused_rank", last=True)
    chain = forests.chains(forest, grid)
    leaf = forests.leaves(forest)
    own = leaf.select(*Q, F.col("size").alias("e_size"), F.col("codepoint_offset").alias("e_offset"), F.lit(0).alias("depth"))
    above = chain.join(leaf, Q, "left_semi").select(*Q, F.col("ancestor_size").alias("e_size"), F.col("ancestor_offset").alias("e_offset"), "depth")
    facts = hits.select(
        "query_id", "document_id", F.col("size").alias("e_size"), F.col("codepoint_offset").alias("e_offset"), "point_id", "score", "rank", "fused_rank",
    )
    joined = own.unionByName(above).join(facts, ["query_id", "document_id", "e_size", "e_offset"])
    item = F.struct(
        F.col("e_size").alias("size"), F.col("e_offset").alias("codepoint_offset"), F.col("point_id").alias("id"),
        F.col("score").alias("raw_score"), F.col("rank").cast("int").alias("rank_in_size"), F.col("fused_rank").cast("int").alias("fused_rank"), "depth",
    )
    return joined.groupBy(*Q).agg(F.min("fused_rank").cast("int").alias("eff_rank"), F.array_sort(F.collect_list(item)).alias("evidence"))


def dedup_trace(classes: DataFrame) -> DataFrame:
    """query_id, dedup: the classes that have something above their leaf, in order of document, size, offset."""
    entry = F.struct(
        *KEY, F.transform(F.filter("evidence", lambda e: e["depth"] > 0), lambda e: F.struct(e["size"].alias("size"), e["codepoint_offset"].alias("codepoint_offset"), e["id"].alias("id"))).alias("dropped")
    )
    return classes.where(F.size("evidence") > 1).groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("dedup"))


def pack(classes: DataFrame, queries: DataFrame) -> DataFrame:
    """Classes with packed and budget_left (before them): first fit in order of eff_rank, document, leaf offset.

    classes have cost; what does not fit is passed over and later ones are still tried. A null budget packs
    all. A fold over each query's ordered classes; a query has sizes * k of them at most.
    """
    item = F.struct("eff_rank", "document_id", "codepoint_offset", "size", "cost")
    state = F.struct(F.col("budget").cast("long").alias("left"), F.array().cast("array<struct<size:int,codepoint_offset:int,document_id:string,packed:boolean,budget_left:long>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["left"].isNull() | (x["cost"] <= acc["left"])
        row = F.struct(
            x["size"].cast("int").alias("size"), x["codepoint_offset"].cast("int").alias("codepoint_offset"), x["document_id"].alias("document_id"),
            fits.alias("packed"), acc["left"].alias("budget_left"),
        )
        return F.struct(F.when(fits, acc["left"] - x["cost"]).otherwise(acc["left"]).cast("long").alias("left"), F.concat(acc["out"], F.array(row)).alias("out"))

    ordered = classes.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items")).join(queries.select("query_id", "budget"), "query_id")
    folded = ordered.select("query_id", F.explode(F.aggregate("items", state, step)["out"]).alias("p")).select("query_id", "p.*")
    return classes.join(folded, Q)


REF = "struct<document_id:string,size:int,codepoint_offset:int>"
TRACE = (
    f"trade_ups array<struct<round:int,from_ref:{REF},from_id:string,to_ref:{REF},to_id:string,to_provenance:string,subsumed_ids:array<string>,delta_tokens:long,budget_left:long>>, "
    f"rejections array<struct<round:int,target:{REF},reason:string,delta_tokens:long>>"
)
ITEM = "struct<size:int,codepoint_offset:int,id:string,raw_score:double,rank_in_size:int,fused_rank:int>"
RESULT = (
    "document_id string, size int, codepoint_offset int, codepoint_length int, point_id string, cost long, provenance string, "
    f"effective_rank int, action string, levels int, replaced_ids array<string>, evidence array<{ITEM}>"
)


def _ref(r: tuple[str, int, int]) -> dict:
    return {"document_id": r[0], "size": int(r[1]), "codepoint_offset": int(r[2])}


def run_trade_up(packed: DataFrame, closure: DataFrame, queries: DataFrame, grid: Grid = DEFAULT_GRID, corpus: str = "default") -> DataFrame:
    """query_id, results (array of RESULT), trade_ups, rejections: the kernel over each query's packed classes.

    packed: classes with their leaf's slice facts. closure: query_id, key, slice facts, found ("retrieved" or
    "fetched"), evidence facts for retrieved ones. Grouped by query, whose rows are bounded by its hits.
    """
    options = ["budget", "expansion", "max_slice_size"]
    left = packed.join(queries.select("query_id", *options), "query_id")
    q_type = queries.schema["query_id"].dataType.simpleString()
    sizes = grid.sizes

    def kernel(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"query_id": [], "results": [], "trade_ups": [], "rejections": []}, dtype=object)
        first = own.iloc[0]

        def shelved(r, hit: Evidence | None) -> Shelved:
            ref = (r.document_id, int(r.size_), int(r.codepoint_offset))
            return Shelved(ref, r.point_id, ref[2] + int(r.codepoint_length), int(r.document_codepoint_length), r.own_marker, frozenset(r.descendant_markers), int(r.cost), hit)

        def speaks(r) -> Evidence:
            return Evidence(
                (r.document_id, int(r.size_), int(r.codepoint_offset)), r.point_id, None if pd.isna(r.score) else float(r.score),
                None if pd.isna(r.rank) else int(r.rank), int(r.fused_rank),
            )

        only_hits = first.expansion == "retrieved_only"
        # Where a slice was both retrieved and fetched the retrieved one stands.
        by_found = others.rename(columns={"size": "size_"}).sort_values("found", kind="stable")
        pieces = (shelved(r, speaks(r) if r.found == "retrieved" else None) for r in by_found.itertuples())
        shelf = {p.ref: p for p in pieces if p.hit or not only_hits}
        climbers = []
        for no, r in enumerate(own.rename(columns={"size": "size_"}).sort_values(["eff_rank", "document_id", "codepoint_offset"]).itertuples()):
            evidence = (Evidence((r.document_id, int(e["size"]), int(e["codepoint_offset"])), e["id"], e["raw_score"], e["rank_in_size"], int(e["fused_rank"])) for e in r.evidence)
            climbers.append(climber(no, shelved(r, None), int(r.eff_rank), evidence, Grid(sizes)))
        trades: list = []
        refusals: list = []
        if not pd.isna(first.budget) and first.expansion != "off":
            most = None if pd.isna(first.max_slice_size) else int(first.max_slice_size)
            done = TradeUp(climbers, shelf, int(first.budget) - sum(c.holds.cost for c in climbers), most).run()
            trades = [t | {"from_ref": _ref(t["from_ref"]), "to_ref": _ref(t["to_ref"])} for t in done.trades]
            refusals = [r | {"target": _ref(r["target"])} for r in done.refusals]
        results = [
            {
                **_ref(c.holds.ref), "codepoint_length": c.holds.stop - c.holds.ref[2], "point_id": c.holds.id, "cost": c.holds.cost,
                "provenance": "retrieved" if c.from_hit else "traded_up", "effective_rank": c.rank, "action": "traded_up" if c.trades else "kept", "levels": c.trades,
                "replaced_ids": sorted(c.shed - {c.holds.id}),
                "evidence": [
                    {"size": e.ref[1], "codepoint_offset": e.ref[2], "id": e.id, "raw_score": e.score, "rank_in_size": e.rank_in_size, "fused_rank": e.fused_rank}
                    for e in sorted(c.evidence.values(), key=lambda e: e.ref[1:])
                ],
            }
            for c in climbers
            if c.taken_by is None
        ]
        return pd.DataFrame({"query_id": [first.query_id], "results": [results], "trade_ups": [trades], "rejections": [refusals]})

    # Both sides may come from the same plan: one side's columns get identities of their own.
    closure = closure.select(*(F.col(c).alias(c) for c in closure.columns))
    schema = f"query_id {q_type}, results array<struct<{', '.join(_typed(RESULT))}>>, {TRACE}"
    # Small rows, long work: queries stay dealt over all partitions, whatever their bytes.
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, closure = left.repartition(parts, "query_id"), closure.repartition(parts, "query_id")
    return left.groupBy("query_id").cogroup(closure.groupBy("query_id")).applyInPandas(kernel, schema)


def _typed(columns: str) -> list[str]:
    """`name type` pairs as `name:type`, for a struct."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(columns + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = columns[at:i].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            at = i + 1
    return out


def finalize(results: DataFrame) -> DataFrame:
    """Adds position and contiguous_with_next: documents by their best rank, inside them by offset."""
    best = F.min("effective_rank").over(W.partitionBy("query_id", "document_id"))
    order = W.partitionBy("query_id").orderBy("_best", "document_id", "codepoint_offset")
    r = results.withColumn("_best", best)
    follows = (F.lead("document_id").over(order) == F.col("document_id")) & (F.lead("codepoint_offset").over(order) == F.col("codepoint_offset") + F.col("codepoint_length"))
    return r.withColumns({"position": F.row_number().over(order) - 1, "contiguous_with_next": F.coalesce(follows, F.lit(False))}).drop("_best")


def select(
    hits: DataFrame, queries: DataFrame, slices: DataFrame | None = None, *, grid: Grid = DEFAULT_GRID, counter: Callable[[Column], Column] = chars,
    corpus: str = "default", strategy: str | Strategy = "greedy_upward", fusion: Callable[[DataFrame], DataFrame] = tier_interleave,
) -> tuple[DataFrame, DataFrame]:
    """(selection, trace) for a batch of queries.

    hits: query_id, slice columns, score, rank. queries: query_id and options. slices: where larger slices
    are fetched from; None means among the hits only. strategy: a registered name, or a function of a Request. A coordinate that
    was hit several times is one slice (the forest sees its first hit, the selection its last); a hit off the grid is an error.
    """
    chosen = strategy_of(strategy)
    fused = fusion(hits)
    if "token_count" not in fused.columns:
        fused = fused.withColumn("token_count", F.lit(None).cast("int"))
    fused = materialise(fused, "fused")
    forest, anomalies = forests.build_forest(fused, grid)
    return chosen(Request(fused, with_options(queries), slices, materialise(forest, "forest"), anomalies, grid, counter, corpus))


def greedy_upward(request: Request) -> tuple[DataFrame, DataFrame]:
    """Keep the leaves, pack them first-fit, trade them up while the budget allows; without a budget keep the leaves only."""
    fused, queries, slices, forest, grid = request.fused, request.queries, request.slices, request.forest, request.grid
    opts = queries.select("query_id", "overhead", "trust_stored_counts", F.col("max_slice_size").alias("_max"), F.col("expansion").alias("_expansion"))
    facts = ["point_id", "codepoint_length", "document_codepoint_length", "own_marker", "descendant_markers"]

    def costed(df: DataFrame) -> DataFrame:
        return df.join(opts, "query_id").withColumn("cost", (tokens(request.counter, F.col("trust_stored_counts")) + F.col("overhead")).cast("long"))

    own = costed(forests.one_of_each(fused, "fused_rank", last=True))
    classes = dedup_classes(fused, forest, grid).join(own.select(*Q, *facts, "cost"), Q)
    tried = materialise(pack(classes, queries), "packed")
    retrieved = own.select(*Q, *facts, "cost", "score", "rank", "fused_rank", F.lit("retrieved").alias("found"))
    closure = retrieved
    if slices is not None:
        wanted = closure_keys(fused, grid)
        got = costed(fetch(wanted, slices if "token_count" in slices.columns else slices.withColumn("token_count", F.lit(None).cast("int"))))
        closure = retrieved.unionByName(got.select(*Q, *facts, "cost", F.lit("fetched").alias("found")), allowMissingColumns=True)
    traded = materialise(run_trade_up(tried.where("packed"), closure, queries, grid, request.corpus), "traded")
    flat = traded.select("query_id", F.explode("results").alias("r")).select("query_id", "r.*")
    return finalize(flat), _trace(queries, fused, forest, request.anomalies, classes, tried, traded, grid)


def dedupe_only(request: Request) -> tuple[DataFrame, DataFrame]:
    """Keep the leaves, whatever the budget."""
    return greedy_upward(replace(request, queries=request.queries.withColumn("budget", F.lit(None).cast("int")), slices=None))


register_strategy("greedy_upward", greedy_upward)
register_strategy("dedupe_only", dedupe_only)


def _trace(queries, fused, forest, anomalies, classes, tried, traded, grid) -> DataFrame:
    """One row a query: counts of fusion and forest, dedup, initial pack, trades, refusals, final sums."""
    base = queries.select("query_id", "budget").join(
        fused.groupBy("query_id").agg(F.array_sort(F.collect_set("size")).alias("sizes"), F.count("*").alias("candidate_count")), "query_id", "left"
    )
    entry = F.struct("eff_rank", "document_id", "codepoint_offset", "size", "point_id", "cost", "budget_left", "packed")
    packs = tried.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("tried"))
    initial = packs.select(
        "query_id",
        F.transform(F.filter("tried", lambda x: x["packed"]), lambda x: x["point_id"]).alias("selected_ids"),
        F.transform(
            F.filter("tried", lambda x: ~x["packed"]),
            lambda x: F.struct(x["document_id"].alias("document_id"), x["size"].alias("size"), x["codepoint_offset"].alias("codepoint_offset"), x["point_id"].alias("id"), x["cost"].alias("tokens"), x["budget_left"].alias("budget_left")),
        ).alias("skipped_unaffordable"),
        F.array_min(F.transform(F.filter("tried", lambda x: ~x["packed"]), lambda x: x["cost"])).alias("smallest_unaffordable_tokens"),
    )
    used = F.coalesce(F.aggregate("results", F.lit(0).cast("long"), lambda a, r: a + r["cost"]), F.lit(0))
    out = (
        base.join(forests.metrics(forest, anomalies, grid), "query_id", "left")
        .join(dedup_trace(classes), "query_id", "left")
        .join(initial, "query_id", "left")
        .join(traded, "query_id", "left")
        .withColumn("tokens_used", used)
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("candidate_count", "hit_count", "edge_count", "anomaly_count", "max_depth")}
    exhausted = F.col("budget").isNotNull() & (
        (F.coalesce(F.size("skipped_unaffordable"), F.lit(0)) > 0) | F.coalesce(F.exists("rejections", lambda r: r["reason"] == "over_budget"), F.lit(False))
    )
    return (
        out.withColumns(zero)
        .withColumn("participation_rate", F.coalesce("participation_rate", F.lit(0.0)))
        .withColumn("utilization", F.when(F.col("budget") > 0, F.col("tokens_used") / F.col("budget")))
        .withColumn("budget_exhausted", exhausted)
        .withColumn("results", F.coalesce(F.size("results"), F.lit(0)))
        .withColumn("warnings", F.when(exhausted & (F.col("results") == 0), F.array(F.lit(NOTHING_FITS))).otherwise(F.array().cast("array<string>")))
    )


def budget_fit(hits: DataFrame, *, budget: int | None, slices: DataFrame | None = None, counter: Callable[[Column], Column] = chars, strategy: str | Strategy = "greedy_upward", grid: Grid = DEFAULT_GRID, corpus: str = "default", **options: object) -> tuple[DataFrame, DataFrame]:
    """Fuse, build the forest and select in one call, for hits that are there already."""
    queries = with_options(hits.select("query_id").distinct(), budget=budget, **options)
    return select(hits, queries, slices, grid=grid, counter=counter, corpus=corpus, strategy=strategy)


def unbounded_closed_form(leaf_slices: DataFrame, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """Where trade-up ends with ample budget and consistent data, without the loop: each leaf at the smallest
    size whose span is that of the largest size. leaf_slices: query_id, key, document_codepoint_length."""
    n = F.col("document_codepoint_length")
    start = lambda s: F.col("codepoint_offset") - F.col("codepoint_offset") % s
    end = lambda s: F.least(start(s) + s, n)
    top = F.lit(grid.largest)
    fits = F.filter(grid.array(), lambda s: (s >= F.col("size")) & (start(s) == start(top)) & (end(s) == end(top)))
    return leaf_slices.withColumn("_s", F.array_min(fits)).select(
        "query_id", "document_id", F.col("_s").alias("size"), start(F.col("_s")).alias("codepoint_offset")
    ).distinct()


def replay_ids(trace: DataFrame) -> DataFrame:
    """query_id, ids: the final ids that each trace leads to, sorted; a trace that contradicts itself is an error.

    Each trace's comings and goings are folded in order, without leaving the row.
    """
    event = lambda i, held: F.struct(i.alias("id"), F.lit(held).alias("held"))
    gone = lambda t: F.concat(F.array(t["from_id"]), t["subsumed_ids"])
    none = F.array().cast("array<struct<id:string,held:boolean>>")
    packed = F.coalesce(F.transform("selected_ids", lambda i: event(i, True)), none)
    traded = F.coalesce(F.flatten(F.transform("trade_ups", lambda t: F.concat(F.transform(gone(t), lambda i: event(i, False)), F.array(event(t["to_id"], True))))), none)

    def step(live: Column, e: Column) -> Column:
        wrong = F.raise_error(F.concat(e["id"], F.lit(" is held twice, or goes without being held"))).cast("array<string>")
        after = F.when(e["held"], F.concat(live, F.array(e["id"]))).otherwise(F.array_remove(live, e["id"]))
        return F.when(F.array_contains(live, e["id"]) == e["held"], wrong).otherwise(after)

    ids = F.aggregate(F.concat(packed, traded), F.array().cast("array<string>"), step)
    return trace.select("query_id", F.array_sort(ids).alias("ids"))
