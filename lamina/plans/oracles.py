"""DuckDB SQL for the registered queries, written apart from the plans: joins where those use arrays, positions where
those use markers, recursion where those unroll."""

from __future__ import annotations

from .queries import BUDGET, DIM, K

SIZES = "[64, 128, 256, 512, 1024]"
NAMESPACE = "fabb402a1e0f55a883cd2d0a124a3fca"

DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, text, length(text) AS n FROM documents WHERE length(text) > 0)"
GRID = f"grid AS (SELECT unnest({SIZES})::INTEGER AS size)"


def point_id(document: str = "document_id", size: str = "size", offset: str = "codepoint_offset") -> str:
    name = f"'default|' || replace(replace({document}, '\\', '\\\\'), '|', '\\|') || '|' || {size} || '|' || {offset}"
    h = f"sha1(unhex('{NAMESPACE}') || encode({name}))"
    return (
        f"list_transform([{h}], lambda h: substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || "
        "substr('89ab', (('0x' || substr(h,17,1))::INTEGER % 4) + 1, 1) || substr(h,18,3) || '-' || substr(h,21,12))[1]"
    )


def slices(docs: str = "docs", name: str = "slices") -> str:
    return f"""{name} AS (SELECT document_id, size, o::INTEGER AS codepoint_offset, least(size, n - o)::INTEGER AS codepoint_length,
  n::INTEGER AS document_codepoint_length, substr(text, o + 1, size) AS text
  FROM (SELECT d.*, g.size, unnest(range(0, n, g.size)) AS o FROM {docs} d, grid g))"""


def vector(text: str) -> str:
    blocks = " || ".join(f"sha256(unhex(sha256({text})) || '\\x00\\x00\\x00\\x{i:02X}'::BLOB)" for i in range((DIM + 7) // 8))
    return (
        f"list_transform([{blocks}], lambda b: list_transform(range({DIM}), "
        "lambda i: ('0x' || substr(b, (i * 8 + 1)::INTEGER, 8))::BIGINT::DOUBLE / 2147483648::DOUBLE - 1::DOUBLE))[1]"
    )


def fold(expr: str) -> str:
    return f"list_reduce({expr}, lambda s, x: s + x)"


def norm(v: str) -> str:
    return f"sqrt({fold(f'list_transform({v}, lambda x: x * x)')})"


def dot(a: str, b: str, n: int) -> str:
    return fold(f"list_transform(range(1, {n + 1}), lambda i: {a}[i] * {b}[i])")


UNIT = "list_transform(v, lambda x: x / m)"
FOUND = f"""raw AS MATERIALIZED (SELECT document_id, size, codepoint_offset, {vector("text")} AS v FROM slices),
points AS MATERIALIZED (SELECT *, {norm("v")} AS m FROM (SELECT document_id, size, codepoint_offset, {UNIT} AS v FROM (SELECT *, {norm("v")} AS m FROM raw))),
qraw AS MATERIALIZED (SELECT item_id AS query_id, {vector("text")} AS v FROM benchmark),
qs AS MATERIALIZED (SELECT *, {norm("v")} AS m FROM (SELECT query_id, {UNIT} AS v FROM (SELECT *, {norm("v")} AS m FROM qraw))),
scored AS (SELECT q.query_id, p.document_id, p.size, p.codepoint_offset, {dot("p.v", "q.v", DIM)} / (p.m * q.m) AS score FROM points p, qs q),
near AS MATERIALIZED (SELECT * FROM scored QUALIFY rank() OVER (PARTITION BY query_id, size ORDER BY score DESC) <= {K}),
found AS MATERIALIZED (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id, size ORDER BY score DESC, point_id) - 1)::INTEGER AS rank
  FROM (SELECT *, {point_id()} AS point_id FROM near)) WHERE rank < {K})"""
HITS = "hits AS MATERIALIZED (SELECT f.*, s.text, s.codepoint_length, s.document_codepoint_length FROM found f JOIN slices s USING (document_id, size, codepoint_offset))"


def links(rule: str = "true") -> str:
    """Enclosing hits by position, vouched if the parent's own text has the child's at its place, under a further rule."""
    return f"""links AS MATERIALIZED (SELECT c.query_id, c.document_id, c.size, c.codepoint_offset, p.size AS parent_size, p.codepoint_offset AS parent_offset,
  substr(p.text, c.codepoint_offset - p.codepoint_offset + 1, c.codepoint_length) = c.text AND ({rule}) AS vouched
  FROM hits c JOIN hits p ON c.query_id = p.query_id AND c.document_id = p.document_id AND p.size > c.size
    AND p.codepoint_offset <= c.codepoint_offset AND c.codepoint_offset + c.codepoint_length <= p.codepoint_offset + p.codepoint_length),
parents AS MATERIALIZED (SELECT query_id, document_id, size, codepoint_offset, min(parent_size) AS parent_size, arg_min(parent_offset, parent_size) AS parent_offset
  FROM links WHERE vouched GROUP BY ALL)"""


STALE = "(p.codepoint_offset // p.size) % 3 <> 0"
KEY = "query_id, document_id, size, codepoint_offset"
CHAIN = f"""chain AS (SELECT {KEY}, parent_size AS a_size, parent_offset AS a_offset, 1 AS depth FROM parents
  UNION ALL SELECT c.query_id, c.document_id, c.size, c.codepoint_offset, p.parent_size, p.parent_offset, c.depth + 1
  FROM chain c JOIN parents p ON p.query_id = c.query_id AND p.document_id = c.document_id AND p.size = c.a_size AND p.codepoint_offset = c.a_offset)"""
LEAVES = f"""leaves AS MATERIALIZED (SELECT h.* FROM hits h WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.query_id = h.query_id AND p.document_id = h.document_id
  AND p.parent_size = h.size AND p.parent_offset = h.codepoint_offset))"""
FUSED = """tiers AS (SELECT *, row_number() OVER (PARTITION BY query_id, size ORDER BY score DESC, point_id) AS tier FROM found),
fused AS MATERIALIZED (SELECT query_id, document_id, size, codepoint_offset, (row_number() OVER (PARTITION BY query_id ORDER BY tier, size, document_id, codepoint_offset) - 1)::INTEGER AS fused_rank FROM tiers)"""
CLASSES = f"""evidence AS (SELECT {KEY}, size AS e_size, codepoint_offset AS e_offset FROM leaves
  UNION ALL SELECT c.query_id, c.document_id, c.size, c.codepoint_offset, c.a_size, c.a_offset FROM chain c JOIN leaves USING ({KEY})),
classes AS MATERIALIZED (SELECT e.query_id, e.document_id, e.size, e.codepoint_offset, min(f.fused_rank)::INTEGER AS eff_rank, count(*)::INTEGER AS n_evidence
  FROM evidence e JOIN fused f ON f.query_id = e.query_id AND f.document_id = e.document_id AND f.size = e.e_size AND f.codepoint_offset = e.e_offset GROUP BY ALL)"""
ANOMALIES = f"""odd AS (SELECT l.query_id, l.document_id, l.size, l.codepoint_offset, l.parent_size, l.parent_offset FROM links l LEFT JOIN parents p USING ({KEY})
  WHERE NOT l.vouched AND (p.parent_size IS NULL OR l.parent_size < p.parent_size))"""
METRICS = """took AS (SELECT h.query_id, (p.parent_size IS NOT NULL OR c.n IS NOT NULL)::INTEGER AS part, p.parent_size FROM hits h
  LEFT JOIN parents p USING (query_id, document_id, size, codepoint_offset)
  LEFT JOIN (SELECT query_id, document_id, parent_size AS size, parent_offset AS codepoint_offset, count(*) AS n FROM parents GROUP BY ALL) c USING (query_id, document_id, size, codepoint_offset)),
metrics AS (SELECT query_id, count(*) AS hit_count, count(parent_size) AS edge_count, (SELECT count(*) FROM odd WHERE odd.query_id = took.query_id) AS anomaly_count, avg(part) AS participation_rate,
  coalesce((SELECT max(depth) + 1 FROM chain c WHERE c.query_id = took.query_id), 1)::INTEGER AS max_depth FROM took GROUP BY query_id)"""


def first_fit(budget: int, cost: str = "codepoint_length") -> str:
    """fit: one row a class and query, in the order of packing, with the budget before and after it."""
    return f"""ordered AS (SELECT query_id, list({{'d': document_id, 's': size, 'o': codepoint_offset, 'c': ({cost})::BIGINT}} ORDER BY eff_rank, document_id, codepoint_offset) AS items FROM classes JOIN hits USING ({KEY}) GROUP BY query_id),
fit AS (SELECT query_id, items, 1 AS i, {budget}::BIGINT AS before, CASE WHEN items[1].c <= {budget} THEN {budget} - items[1].c ELSE {budget} END AS after FROM ordered
  UNION ALL SELECT query_id, items, i + 1, after, CASE WHEN items[i + 1].c <= after THEN after - items[i + 1].c ELSE after END FROM fit WHERE i < len(items)),
packs AS MATERIALIZED (SELECT query_id, items[i].d AS document_id, items[i].s AS size, items[i].o AS codepoint_offset, items[i].c AS cost, items[i].c <= before AS packed, before AS budget_left FROM fit)"""


#: A slice's place as one number, within a document.
def code(size: str, offset: str) -> str:
    return f"(({size})::BIGINT * 4294967296 + {offset})"


def trade_up(budget: int) -> str:
    """done: each query's state when nobody asks any more, walked one turn a step. h: the holders, with the place they hold (s, o, to z), the
    document's length n, rank, and whether they are alive, done or parked; log: the turns that were not passed over. Spans, costs and
    containment are arithmetic on places here; no marker and no fetched slice is looked at."""
    put = lambda change: f"list_transform(h, lambda y: CASE WHEN y.no = no THEN {change} ELSE y END)"
    row = lambda **new: "{" + ", ".join(f"'{k}': {new.get(k, 'y.' + k)}" for k in ("no", "d", "s", "o", "z", "n", "leaf", "rank", "levels", "alive", "done", "parked", "ev", "shed")) + "}"
    grown = row(
        s="t::INTEGER", o="po::INTEGER", z="pz::INTEGER", levels="y.levels + 1", parked="NULL::BIGINT",
        rank="least(y.rank, coalesce(list_min(list_transform(eaten, lambda e: e.rank)), y.rank), coalesce(own, y.rank))",
        ev=f"list_distinct(list_concat(y.ev, flatten(list_transform(eaten, lambda e: e.ev)), CASE WHEN own IS NULL THEN []::BIGINT[] ELSE [{code('t', 'po')}] END))",
        shed=f"list_distinct(list_concat(y.shed, [{code('y.s', 'y.o')}], list_transform(eaten, lambda e: {code('e.s', 'e.o')}), flatten(list_transform(eaten, lambda e: e.shed))))",
    )
    eaten = row(alive="false")
    return f"""spoken AS (SELECT {KEY}, list({code("e_size", "e_offset")}) AS ev FROM evidence GROUP BY ALL),
held AS (SELECT query_id, list({{'no': 0::BIGINT, 'd': document_id, 's': size, 'o': codepoint_offset, 'z': codepoint_offset + codepoint_length, 'n': document_codepoint_length, 'leaf': codepoint_offset,
    'rank': eff_rank, 'levels': 0, 'alive': true, 'done': false, 'parked': NULL::BIGINT, 'ev': ev, 'shed': []::BIGINT[]}} ORDER BY eff_rank, document_id, codepoint_offset) AS h, {budget}::BIGINT - sum(codepoint_length)::BIGINT AS spare
  FROM packs JOIN classes USING ({KEY}) JOIN hits USING ({KEY}) JOIN spoken USING ({KEY}) WHERE packed GROUP BY query_id),
facts AS (SELECT query_id, list({{'d': document_id, 'c': {code("size", "codepoint_offset")}, 'f': fused_rank}}) AS hs FROM fused GROUP BY query_id),
go AS (SELECT query_id, hs, list_transform(h, lambda y, i: {row(no="i")}) AS h, spare, []::BIGINT[] AS queue, true AS asked, 0 AS round,
    []::STRUCT(round INTEGER, d VARCHAR, fs INTEGER, fo INTEGER, ts INTEGER, tof INTEGER, act VARCHAR, n_eaten INTEGER, delta BIGINT, spare BIGINT, retrieved BOOLEAN)[] AS log FROM held JOIN facts USING (query_id)
  UNION ALL SELECT query_id, hs,
    CASE act WHEN 'saturated' THEN {put(row(done="true", parked="NULL::BIGINT"))} WHEN 'over_budget' THEN {put(row(parked="spare"))}
      WHEN 'trade' THEN list_transform(h, lambda y: CASE WHEN y.no = no THEN {grown} WHEN list_contains(list_transform(eaten, lambda e: e.no), y.no) THEN {eaten} ELSE y END) ELSE h END,
    CASE WHEN act = 'trade' THEN spare - delta ELSE spare END,
    CASE WHEN turn_over THEN list_transform(list_sort(list_transform(list_filter(h, lambda y: y.alive AND NOT y.done), lambda y: {{'r': y.rank, 'd': y.d, 'l': y.leaf, 'no': y.no}})), lambda w: w.no) ELSE queue[2:] END,
    CASE WHEN turn_over THEN false ELSE asked OR act <> 'pass' END, CASE WHEN turn_over THEN round + 1 ELSE round END,
    CASE WHEN act IN ('saturated', 'over_budget', 'trade') THEN list_append(log, {{'round': round, 'd': x.d, 'fs': x.s, 'fo': x.o, 'ts': coalesce(t, x.s)::INTEGER, 'tof': coalesce(po, x.o)::INTEGER, 'act': act,
      'n_eaten': len(eaten)::INTEGER, 'delta': CASE WHEN act <> 'saturated' THEN delta END, 'spare': CASE WHEN act = 'trade' THEN spare - delta END, 'retrieved': CASE WHEN act = 'trade' THEN own IS NOT NULL END}}) ELSE log END
  FROM (SELECT *, CASE WHEN turn_over THEN 'round' WHEN NOT tries THEN 'pass' WHEN t IS NULL THEN 'saturated' WHEN delta > spare THEN 'over_budget' ELSE 'trade' END AS act
  FROM (SELECT *, ((pz - po) - (x.z - x.o) - coalesce(list_sum(list_transform(eaten, lambda e: e.z - e.o)), 0))::BIGINT AS delta, list_filter(hs, lambda f: f.d = x.d AND f.c = {code("t", "po")})[1].f AS own
  FROM (SELECT *, list_filter(h, lambda y: y.alive AND y.no <> no AND y.d = x.d AND ((y.s = t AND y.o = po) OR (y.s < t AND y.o >= po AND y.z <= pz))) AS eaten
  FROM (SELECT *, x.o - x.o % t AS po, least(x.o - x.o % t + t, x.n) AS pz
  FROM (SELECT *, x.alive AND (x.parked IS NULL OR spare > x.parked) AS tries, list_filter({SIZES}, lambda g: g > x.s AND NOT (x.o % g = 0 AND least(x.o + g, x.n) <= x.z))[1] AS t
  FROM (SELECT *, len(queue) = 0 AS turn_over, queue[1] AS no, h[queue[1]] AS x FROM go WHERE len(queue) > 0 OR asked)))))) AS turn),
done AS MATERIALIZED (SELECT * FROM go WHERE len(queue) = 0 AND NOT asked),
chosen AS MATERIALIZED (SELECT query_id, y.d AS document_id, y.s AS size, y.o AS codepoint_offset, y.z - y.o AS codepoint_length, y.rank AS effective_rank, y.levels AS levels, y.ev AS ev, y.shed AS shed,
    (row_number() OVER (PARTITION BY query_id ORDER BY best, y.d, y.o) - 1)::INTEGER AS position
  FROM (SELECT *, min(y.rank) OVER (PARTITION BY query_id, y.d) AS best FROM (SELECT query_id, unnest(h) AS y FROM done) WHERE y.alive))"""


def sql(*ctes: str, then: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + then


BASE = (DOCS, GRID, slices())
SEARCH = (*BASE, FOUND)
FOREST = (*SEARCH, HITS, links())
SELECTION = (*FOREST, CHAIN, LEAVES, FUSED, CLASSES)
FITTED = (*SELECTION, first_fit(BUDGET))
TRADED = (*FITTED, trade_up(BUDGET))
TRADE_COLUMNS = f"""query_id, position, document_id, size, codepoint_offset, CASE WHEN levels > 0 THEN 'traded_up' ELSE 'kept' END AS action, levels, codepoint_length::BIGINT AS cost,
  len(list_filter(shed, lambda c: c <> {code("size", "codepoint_offset")}))::INTEGER AS n_replaced, len(ev)::INTEGER AS n_evidence"""
LADDER = "(h.codepoint_offset - h.codepoint_offset % g.size)"

UNBOUNDED = sql(*FOREST, LEAVES, f"""
rungs AS (SELECT h.query_id, h.document_id, h.size AS leaf, h.codepoint_offset AS leaf_offset, g.size, {LADDER} AS o, least({LADDER} + g.size, h.document_codepoint_length) AS z FROM leaves h JOIN grid g ON g.size >= h.size),
tops AS (SELECT * FROM rungs WHERE size = 1024)""", then="""
SELECT DISTINCT query_id, document_id, size, codepoint_offset FROM (
  SELECT r.query_id, r.document_id, r.leaf, r.leaf_offset, min(r.size)::INTEGER AS size, any_value(r.o)::INTEGER AS codepoint_offset
  FROM rungs r JOIN tops t ON t.query_id = r.query_id AND t.document_id = r.document_id AND t.leaf = r.leaf AND t.leaf_offset = r.leaf_offset AND t.o = r.o AND t.z = r.z GROUP BY ALL)""")
#: Fused ranks of hits that come twice: a coordinate's is that of its last hit.
DOUBLED = FUSED.replace("FROM found)", "FROM (SELECT * FROM found UNION ALL SELECT * FROM found))").replace(
    "fused AS MATERIALIZED (SELECT", "each AS (SELECT") + """,
fused AS MATERIALIZED (SELECT query_id, document_id, size, codepoint_offset, max(fused_rank) AS fused_rank FROM each GROUP BY ALL)"""
#: Documents and slices of the store after its history.
STORED = """docs AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, t AS text, length(t) AS n, 'lang=' || lang || CASE WHEN doc_id = 5 THEN '' ELSE ';source=' || source END AS metadata
  FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN substr(text, 1, ceil(length(text) / 2)::INTEGER) ELSE text END AS t FROM documents WHERE doc_id NOT IN (11, 12)))"""
KEPT = (STORED, GRID, slices(name="cut"), "slices AS (SELECT * FROM cut WHERE NOT (document_id = '6' AND size = 64))")
STORE_TRADED = (*KEPT, FOUND, HITS, links(), CHAIN, LEAVES, FUSED, CLASSES, first_fit(BUDGET), trade_up(BUDGET))

ORACLES: dict[str, str] = {
    "slice_geometry": sql(*BASE, then="""SELECT s.document_id, size, codepoint_offset, codepoint_length, strlen(substr(d.text, 1, codepoint_offset))::INTEGER AS byte_offset,
  strlen(s.text)::INTEGER AS byte_length, document_codepoint_length FROM slices s JOIN docs d USING (document_id)"""),
    "slice_markers": sql(*BASE, then=f"SELECT document_id, size, codepoint_offset, sha256(text) AS own_marker, {point_id()} AS point_id FROM slices"),
    "slice_token_counts": sql(*BASE, then="SELECT document_id, size, codepoint_offset, length(text)::INTEGER AS token_count FROM slices"),
    "descendant_markers": sql(*BASE, "m AS MATERIALIZED (SELECT document_id, size, codepoint_offset, codepoint_length, sha256(text) AS marker FROM slices)", then="""
SELECT p.document_id, p.size, p.codepoint_offset, count(c.marker)::INTEGER AS n_descendants,
  sha256(coalesce(string_agg(c.marker, ',' ORDER BY c.size, c.codepoint_offset), '')) AS digest
FROM m p LEFT JOIN m c ON c.document_id = p.document_id AND c.size < p.size AND c.codepoint_offset - c.codepoint_offset % p.size = p.codepoint_offset GROUP BY ALL"""),
    "marker_codec_roundtrip": sql(*BASE, "m AS MATERIALIZED (SELECT document_id, size, codepoint_offset, sha256(text) AS marker FROM slices)", """
l AS (SELECT p.document_id, p.size, p.codepoint_offset, coalesce(string_agg(c.marker, ',' ORDER BY c.size, c.codepoint_offset), '') AS joined
FROM m p LEFT JOIN m c ON c.document_id = p.document_id AND c.size < p.size AND c.codepoint_offset - c.codepoint_offset % p.size = p.codepoint_offset GROUP BY ALL)""", then="""
SELECT document_id, size, codepoint_offset, md5(base64(unhex(replace(joined, ',', '')))) AS packed_digest, md5(joined) AS unpacked_digest FROM l"""),
    "spine_prefix_gate": sql(*BASE, "s AS (SELECT * FROM slices WHERE codepoint_offset = 0)", then="""
SELECT a.size, count(*) AS documents, count(*) FILTER (WHERE NOT starts_with(b.text, a.text)) AS violations FROM s a JOIN s b ON a.document_id = b.document_id AND b.size = a.size * 2 GROUP BY a.size"""),
    "reconstruction": sql(DOCS, GRID, then="SELECT document_id, size, md5(text) AS digest, strlen(text)::INTEGER AS bytes FROM docs, grid"),
    "grid_ancestors": sql(*BASE, then="""SELECT s.document_id, s.size, s.codepoint_offset, g.size AS ancestor_size, ((s.codepoint_offset // g.size) * g.size)::INTEGER AS ancestor_offset
FROM slices s JOIN grid g ON g.size > s.size"""),
    "corpus_stats": sql(DOCS, GRID, then="SELECT g.size, coalesce(sum((n + g.size - 1) // g.size), 0)::BIGINT AS points FROM grid g, docs GROUP BY g.size"),
    "fake_embedding": sql(DOCS, f"r AS (SELECT document_id, {vector('text')} AS v FROM docs), u AS (SELECT document_id, {UNIT} AS v FROM (SELECT *, {norm('v')} AS m FROM r))", then=f"""
SELECT document_id, i::INTEGER AS i, round(v[i + 1], 9) AS x FROM u, (SELECT unnest(range({DIM})) AS i)"""),
    "embedding_topk": f"""
WITH e AS MATERIALIZED (SELECT vec_id, v, {norm("v")} AS m FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CASE WHEN e.m = 0 OR q.m = 0 THEN 0 ELSE {dot("e.v", "q.v", 64)} / (e.m * q.m) END AS score FROM e, e q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, (r - 1)::INTEGER AS rank, vec_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= {K}""",
    "topk_per_size": sql(*SEARCH, then="SELECT query_id, size, rank, point_id, round(score, 9) AS score FROM found"),
    "fanout_status": sql(*SEARCH, then="SELECT query_id, size, 'ok' AS status, count(*) AS hits FROM found GROUP BY ALL"),
    "tier_interleave": sql(*SEARCH, FUSED, then=f"SELECT {KEY}, fused_rank FROM fused"),
    "raw_score_pool": sql(*SEARCH, then=f"SELECT {KEY}, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, size, document_id, codepoint_offset) - 1)::INTEGER AS fused_rank FROM found"),
    "prefetch_closure": sql(*SEARCH, f"""up AS (SELECT DISTINCT h.query_id, h.document_id, g.size, {LADDER}::INTEGER AS codepoint_offset FROM found h JOIN grid g ON g.size > h.size)""", then=f"""
SELECT u.*, sha256(s.text) AS own_marker FROM up u JOIN slices s USING (document_id, size, codepoint_offset) ANTI JOIN found f USING ({KEY})"""),
    "forest_edges": sql(*FOREST, then="SELECT * FROM parents"),
    "forest_closure": sql(*FOREST, CHAIN, then=f"SELECT {KEY}, a_size AS parent_size, a_offset AS parent_offset FROM chain"),
    "forest_roots_leaves": sql(*FOREST, LEAVES, then=f"""SELECT {KEY}, 'leaf' AS kind FROM leaves UNION ALL
SELECT {KEY}, 'root' AS kind FROM hits ANTI JOIN parents USING ({KEY})"""),
    "forest_metrics": sql(*FOREST, CHAIN, ANOMALIES, METRICS, then="SELECT query_id, hit_count, edge_count, anomaly_count, round(participation_rate, 9) AS participation_rate, max_depth FROM metrics"),
    "forest_anomalies": sql(*SEARCH, HITS, links(STALE), ANOMALIES, then="SELECT * FROM odd"),
    "stale_forest_metrics": sql(*SEARCH, HITS, links(STALE), CHAIN, ANOMALIES, METRICS, then="SELECT query_id, hit_count, edge_count, anomaly_count, round(participation_rate, 9) AS participation_rate, max_depth FROM metrics"),
    "stale_forest_edges": sql(*SEARCH, HITS, links(STALE), then="SELECT * FROM parents"),
    "dedup_classes": sql(*SELECTION, then=f"SELECT {KEY}, eff_rank, n_evidence FROM classes"),
    "first_fit_pack": sql(*FITTED, then="SELECT query_id, document_id, size, codepoint_offset, packed, budget_left FROM packs"),
    "trade_up_budgeted": sql(*TRADED, then=f"SELECT {TRADE_COLUMNS} FROM chosen"),
    "trade_up_trace": sql(*TRADED, then=f"""
SELECT query_id, e.round AS round, e.d AS document_id, e.ts AS size, e.tof AS codepoint_offset, CASE WHEN e.act = 'trade' THEN CASE WHEN e.retrieved THEN 'retrieved' ELSE 'fetched' END ELSE e.act END AS outcome,
  CASE WHEN e.act = 'trade' THEN e.n_eaten END AS n_subsumed, e.delta AS delta_tokens, e.spare AS budget_left FROM (SELECT query_id, unnest(log) AS e FROM done)"""),
    "trace_replay": sql(*TRADED, f"ids AS (SELECT query_id, {point_id()} AS id FROM chosen)", then="SELECT query_id, string_agg(id, ',' ORDER BY id) AS ids FROM ids GROUP BY query_id"),
    "selection_accounts": sql(*TRADED, then=f"""
SELECT q.query_id, coalesce(c.used, 0)::BIGINT AS tokens_used, coalesce(c.n, 0)::INTEGER AS results, coalesce(p.skipped, 0)::INTEGER AS skipped, p.smallest AS smallest_unaffordable,
  round(coalesce(c.used, 0) / {BUDGET}, 9) AS utilization, coalesce(p.skipped, 0) > 0 OR coalesce(len(list_filter(d.log, lambda e: e.act = 'over_budget')), 0) > 0 AS budget_exhausted
FROM (SELECT DISTINCT query_id FROM hits) q LEFT JOIN (SELECT query_id, sum(codepoint_length) AS used, count(*) AS n FROM chosen GROUP BY query_id) c USING (query_id)
LEFT JOIN (SELECT query_id, count(*) FILTER (WHERE NOT packed) AS skipped, min(cost) FILTER (WHERE NOT packed) AS smallest FROM packs GROUP BY query_id) p USING (query_id) LEFT JOIN done d USING (query_id)"""),
    "dedupe_selection": sql(*SELECTION, f"""
o AS (SELECT c.*, h.codepoint_length, min(eff_rank) OVER (PARTITION BY c.query_id, c.document_id) AS best FROM classes c JOIN hits h USING ({KEY}))""", then="""
SELECT query_id, (row_number() OVER w - 1)::INTEGER AS position, document_id, size, codepoint_offset, eff_rank AS effective_rank,
  coalesce(lead(document_id) OVER w = document_id AND lead(codepoint_offset) OVER w = codepoint_offset + codepoint_length, false) AS contiguous_with_next
FROM o WINDOW w AS (PARTITION BY query_id ORDER BY best, document_id, codepoint_offset)"""),
    "trade_up_unbounded": UNBOUNDED,
    "doubled_trade_up": UNBOUNDED,
    "orphan_tombstones": sql(DOCS, GRID, slices(), "cut AS (SELECT document_id, (n * 2 / 3)::DOUBLE AS m FROM docs)", then=f"""
SELECT size, {point_id()} AS point_id FROM slices JOIN cut USING (document_id) WHERE codepoint_offset >= floor(m)"""),
    "eval_rows": sql(*TRADED, ANOMALIES, METRICS, then=f"""
SELECT m.query_id, coalesce(c.n, 0)::INTEGER AS results, hit_count AS forest_hits, edge_count AS forest_edges, round(participation_rate, 9) AS participation_rate, max_depth,
  coalesce(len(list_filter(d.log, lambda e: e.act = 'trade')), 0)::INTEGER AS trade_ups, coalesce(len(list_filter(d.log, lambda e: e.act <> 'trade')), 0)::INTEGER AS rejections,
  coalesce(c.used, 0)::BIGINT AS tokens_used, {BUDGET} AS budget, round(coalesce(c.used, 0) / {BUDGET}, 9) AS utilization
FROM metrics m LEFT JOIN done d USING (query_id) LEFT JOIN (SELECT query_id, sum(codepoint_length) AS used, count(*) AS n FROM chosen GROUP BY query_id) c USING (query_id)"""),
    "eval_summary": sql(*TRADED, ANOMALIES, METRICS, f"""
r AS (SELECT m.*, coalesce(c.n, 0) AS results, coalesce(c.used, 0) / {BUDGET} AS used, coalesce(len(list_filter(d.log, lambda e: e.act = 'trade')), 0) AS trade_ups FROM metrics m LEFT JOIN done d USING (query_id)
  LEFT JOIN (SELECT query_id, sum(codepoint_length) AS used, count(*) AS n FROM chosen GROUP BY query_id) c USING (query_id)),
dd AS (SELECT max_depth, count(*) AS queries FROM r GROUP BY max_depth)""", then="""
SELECT count(*) AS queries, round(avg(participation_rate), 9) AS mean_participation, round(min(participation_rate), 9) AS min_participation, round(avg(max_depth), 9) AS mean_depth,
  round(avg(edge_count), 9) AS mean_edges, round(avg(results), 9) AS mean_results, round(avg(trade_ups), 9) AS mean_trade_ups, round(avg(used), 9) AS mean_utilization,
  (SELECT '[' || string_agg('{"max_depth":' || max_depth || ',"queries":' || queries || '}', ',' ORDER BY max_depth) || ']' FROM dd) AS depths FROM r"""),
    "grid_ladder": sql(DOCS, GRID, f"places AS (SELECT document_id, size, ((n - 1) // size * size)::INTEGER AS codepoint_offset FROM docs, grid)", then=f"""
SELECT document_id, size, sha256('sizes=' || array_to_string({SIZES}, ',')) AS fingerprint, true AS known, size = 64 AS smallest, size = 1024 AS largest,
  array_to_string(list_filter({SIZES}, lambda s: s > size), ',') AS above, array_to_string(list_filter({SIZES}, lambda s: s < size), ',') AS below, codepoint_offset,
  CASE WHEN size < 1024 THEN (size * 2)::INTEGER END AS parent_size, CASE WHEN size < 1024 THEN (codepoint_offset // (size * 2) * (size * 2))::INTEGER END AS parent_offset FROM places"""),
    "slice_lookups": sql(*BASE, f"""
picked AS (SELECT *, 'size' AS kind FROM slices WHERE size = 256 UNION ALL SELECT *, 'place' FROM slices WHERE size = 128 AND codepoint_offset = 128
  UNION ALL SELECT *, 'cut' FROM slices WHERE size IN (64, 512) AND codepoint_offset = 512)""", then=f"""
SELECT s.document_id, s.size, s.codepoint_offset, strlen(substr(d.text, 1, s.codepoint_offset))::INTEGER AS byte_offset, sha256(s.text) AS own_marker, s.kind, {point_id("s.document_id", "s.size", "s.codepoint_offset")} AS point_id,
  sha256(coalesce((SELECT string_agg(sha256(c.text), ',' ORDER BY c.size, c.codepoint_offset) FROM slices c WHERE c.document_id = s.document_id AND c.size < s.size
    AND c.codepoint_offset >= s.codepoint_offset AND c.codepoint_offset < s.codepoint_offset + s.size), '')) AS digest FROM picked s JOIN docs d ON d.document_id = s.document_id"""),
    "doubled_dedup_classes": sql(*FOREST, CHAIN, LEAVES, DOUBLED, CLASSES, then=f"SELECT {KEY}, eff_rank, n_evidence FROM classes"),
    "recounted_pack": sql(*SELECTION, first_fit(BUDGET, "2 * codepoint_length + 1"), then=f"SELECT {KEY}, cost FROM packs WHERE packed"),
    "own_strategy": sql(*SEARCH, HITS, then=f"""
SELECT {KEY}, codepoint_length FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY codepoint_length DESC, size DESC, codepoint_offset) = 1"""),
    "http_embedding": sql(DOCS, f"r AS (SELECT document_id, {vector('text')} AS v FROM docs), u AS (SELECT document_id, {UNIT} AS v FROM (SELECT *, {norm('v')} AS m FROM r))", then=f"""
SELECT f AS fingerprint, document_id, i::INTEGER AS i, round(v[i + 1], 9) AS x FROM u, (SELECT unnest(range(3, {DIM}, 8)) AS i), (SELECT unnest(['openai:m', 'ollama:m']) AS f)"""),
    "query_file": r"""
WITH b AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM benchmark WHERE item_id % 5 IN (0, 1, 2))
SELECT text AS query, count(*) AS n FROM b WHERE text <> '' GROUP BY text""",
    "fanout_partial": sql(*SEARCH, then="""
SELECT query_id, g.size, CASE WHEN g.size = 256 THEN 'error' ELSE 'ok' END AS status, count(f.size) AS hits, g.size <> 256 AS clean
FROM (SELECT item_id AS query_id FROM benchmark WHERE item_id % 10 = 0) CROSS JOIN grid g LEFT JOIN (SELECT * FROM found WHERE size <> 256) f USING (query_id, size) GROUP BY ALL"""),
    "store_documents": sql(STORED, then=f"""
SELECT ((row_number() OVER (ORDER BY document_id) - 1) // 1000)::INTEGER AS page, document_id, n::INTEGER AS codepoint_length, strlen(text)::INTEGER AS byte_length,
  list_sum(list_transform({SIZES}, lambda s: (n + s - 1) // s))::BIGINT AS slice_count, CASE WHEN n > 0 THEN sha256(text) ELSE '' END AS content_marker, metadata FROM docs"""),
    "store_slices": sql(*KEPT, f"v AS (SELECT *, {vector('text')} AS v FROM slices), u AS (SELECT *, {norm('v')} AS m FROM v)", then=f"""
SELECT 'default' AS corpus, u.document_id, size, codepoint_offset, codepoint_length, strlen(substr(d.text, 1, codepoint_offset))::INTEGER AS byte_offset, strlen(u.text)::INTEGER AS byte_length,
  length(u.text)::INTEGER AS token_count, sha256(u.text) AS own_marker, {point_id("u.document_id")} AS point_id,
  list_sum(list_transform({SIZES}, lambda s: CASE WHEN s < size THEN (codepoint_length + s - 1) // s ELSE 0 END))::INTEGER AS n_descendants, round(v[1] / m, 9) AS x FROM u JOIN docs d ON d.document_id = u.document_id"""),
    "store_stats": sql(*KEPT, then="""
SELECT g.size, count(s.size) AS points, (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM slices) AS total, 0 AS degraded FROM grid g LEFT JOIN slices s USING (size) GROUP BY g.size"""),
    "store_search": sql(*KEPT, FOUND, then="""
SELECT query_id, rank, size, document_id, codepoint_offset, point_id, sha256(s.text) AS own_marker, round(score, 9) AS score FROM found JOIN slices s USING (document_id, size, codepoint_offset) WHERE size = 256"""),
    "store_fetch": sql(*KEPT, then="""
SELECT document_id, size, codepoint_offset, sha256(text) AS own_marker, 'id' AS kind FROM slices WHERE size = 128 AND document_id IN ('20', '11', '14', '6')
UNION ALL SELECT document_id, size, codepoint_offset, sha256(text), 'place' FROM slices WHERE size = 512 AND codepoint_offset = 512"""),
    "engine_answers": sql(*STORE_TRADED, then=f"""
SELECT c.query_id, {BUDGET} AS "limit", sum(c.codepoint_length) OVER (PARTITION BY c.query_id)::BIGINT AS used, 'chars' AS counter, false AS partial, 0 AS n_warnings,
  (SELECT count(*) FROM hits h WHERE h.query_id = c.query_id) AS hit_count, position, {point_id("c.document_id", "c.size", "c.codepoint_offset")} AS id, c.document_id, c.size, c.codepoint_offset,
  c.codepoint_offset + c.codepoint_length AS codepoint_end, sha256(s.text) AS own_marker, md5(s.text) AS digest, c.codepoint_length AS token_count, effective_rank,
  f.rank IS NOT NULL AS retrieved, f.rank AS rank_in_size, CASE WHEN levels > 0 THEN 'traded_up' ELSE 'kept' END AS action, levels
FROM chosen c JOIN slices s USING (document_id, size, codepoint_offset) LEFT JOIN found f USING (query_id, document_id, size, codepoint_offset)"""),
    "engine_context": sql(*STORE_TRADED, f"""
parts AS (SELECT query_id, position, '[' || document_id || ' @ ' || codepoint_offset || '..' || (codepoint_offset + c.codepoint_length) || ', size ' || size || ']' || chr(10) || s.text AS part
  FROM chosen c JOIN slices s USING (document_id, size, codepoint_offset)), joined AS (SELECT query_id, string_agg(part, chr(10) || chr(10) ORDER BY position) AS context FROM parts GROUP BY query_id)""",
    then="SELECT query_id, md5(context) AS digest, length(context)::INTEGER AS length FROM joined"),
    "trade_up_options": sql(*FOREST, LEAVES, f"""
spans AS (SELECT h.query_id, h.document_id, h.size AS leaf, h.codepoint_offset AS leaf_offset, g.size, {LADDER}::INTEGER AS o, least({LADDER} + g.size, h.document_codepoint_length)::INTEGER AS z
  FROM leaves h JOIN grid g ON g.size >= h.size WHERE h.query_id % 4 = 3 OR (h.query_id % 4 = 2 AND (g.size <= 256 OR g.size = h.size)) OR (h.query_id % 4 = 0 AND g.size = h.size)),
tops AS (SELECT query_id, document_id, leaf, leaf_offset, max(size) AS top FROM spans GROUP BY ALL),
ends AS (SELECT s.query_id, s.document_id, s.leaf, s.leaf_offset, s.o, s.z FROM spans s JOIN tops t USING (query_id, document_id, leaf, leaf_offset) WHERE s.size = t.top),
filled AS (SELECT DISTINCT query_id, document_id, size, o AS codepoint_offset FROM (SELECT s.query_id, s.document_id, s.leaf, s.leaf_offset, min(s.size)::INTEGER AS size, any_value(s.o) AS o FROM spans s JOIN ends e
  ON e.query_id = s.query_id AND e.document_id = s.document_id AND e.leaf = s.leaf AND e.leaf_offset = s.leaf_offset AND e.o = s.o AND e.z = s.z GROUP BY s.query_id, s.document_id, s.leaf, s.leaf_offset)),
ups AS (SELECT l.*, h.document_codepoint_length AS n FROM leaves l JOIN hits h USING ({KEY}) WHERE l.query_id % 4 = 1),
climb AS (SELECT query_id, document_id, size AS leaf, codepoint_offset AS leaf_offset, size, codepoint_offset AS o, codepoint_offset + codepoint_length AS z FROM hits SEMI JOIN ups USING ({KEY})
  UNION ALL SELECT * FROM (SELECT c.query_id, c.document_id, c.leaf, c.leaf_offset, h.size, h.codepoint_offset, h.codepoint_offset + h.codepoint_length FROM climb c JOIN hits h
    ON h.query_id = c.query_id AND h.document_id = c.document_id AND h.size > c.size AND h.codepoint_offset <= c.o AND h.codepoint_offset + h.codepoint_length >= c.z
      AND (h.codepoint_offset < c.o OR h.codepoint_offset + h.codepoint_length > c.z)
    QUALIFY row_number() OVER (PARTITION BY c.query_id, c.document_id, c.leaf, c.leaf_offset ORDER BY h.size) = 1)),
hit_tops AS (SELECT DISTINCT query_id, document_id, arg_max(size, size) AS size, arg_max(o, size)::INTEGER AS codepoint_offset FROM climb GROUP BY query_id, document_id, leaf, leaf_offset)""",
    then="SELECT * FROM filled UNION ALL SELECT query_id, document_id, size, codepoint_offset FROM hit_tops"),
    "baseline_drift": """
WITH a AS (SELECT source AS metric, floor(avg(n_chars))::BIGINT AS v FROM documents GROUP BY source), b AS (SELECT source AS metric, floor(avg(n_chars))::BIGINT AS v FROM documents WHERE lang = 'en' GROUP BY source)
SELECT b.metric, b.v::VARCHAR AS baseline, a.v::VARCHAR AS current FROM b LEFT JOIN a USING (metric) WHERE abs(a.v - b.v) / CASE WHEN b.v = 0 THEN 1.0 ELSE abs(b.v) END > 0.01""",
}
