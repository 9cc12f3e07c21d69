"""The same results as plain SQL over the driver's tables, built from shared common table expressions."""

from __future__ import annotations

TILES, HIDDEN, LABELS, WIDTH, ROUNDS = 3, 16, 10, 64, 8

#: The canonical graph: n, base bag, edges e, vertices v, in-degrees, scales, features x in long form.
GRAPH = f"""
n AS (SELECT count(*) AS n FROM embeddings),
base AS (SELECT o_custkey % n AS src, l_partkey % n AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey, n WHERE l_quantity >= 47),
e AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM base UNION ALL SELECT dst, src FROM base) WHERE src <> dst),
v AS (SELECT vec_id AS vid, vec_id % {TILES} AS tid, label FROM embeddings),
ind AS (SELECT v.vid, count(e.dst) AS in_degree FROM v LEFT JOIN e ON e.dst = v.vid GROUP BY v.vid),
sc AS (SELECT vid, pow(in_degree + 1, -0.5) AS s FROM ind),
x AS (SELECT vec_id AS vid, unnest(range({WIDTH})) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
brd AS (SELECT v.vid, coalesce(bool_or(src % {TILES} <> dst % {TILES}), false) AS is_border FROM v LEFT JOIN e ON e.src = v.vid GROUP BY v.vid),
ri AS (SELECT vid, tid, row_number() OVER (PARTITION BY tid ORDER BY vid) - 1 AS idx, count(*) OVER (PARTITION BY tid) AS m FROM v),
sp AS (SELECT vid, tid, CASE WHEN idx < floor(m * 0.2::DOUBLE) THEN 'train' WHEN idx < 2 * floor(m * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split, idx < floor(m * 0.2::DOUBLE) AS on_train, floor(m * 0.2::DOUBLE) AS train_n FROM ri)
"""


def weights(name: str, rows: int, cols: int) -> str:
    return f"{name} AS (SELECT i, j, sqrt(6.0::DOUBLE / {rows + cols}) * (2 * ((i * 31 + j * 17 + 7) % 101)::DOUBLE / 100 - 1) AS w FROM range({rows}) a(i), range({cols}) b(j))"


def propagated(src: str, out: str, pre: bool = True, post: bool = True) -> str:
    a = "i.x * sc.s" if pre else "i.x"
    b = "sum(a.x) * sc.s" if post else "sum(a.x)"
    return f"""{out}_m AS (SELECT i.vid, i.k, {a} AS x FROM {src} i JOIN sc ON sc.vid = i.vid),
{out} AS (SELECT a.vid, a.k, {b} AS x FROM (SELECT vid, k, x FROM {out}_m UNION ALL SELECT e.dst, m.k, m.x FROM e JOIN {out}_m m ON m.vid = e.src) a JOIN sc ON sc.vid = a.vid GROUP BY a.vid, a.k, sc.s)"""


def product(src: str, w: str, out: str, back: bool = False) -> str:
    i, j = ("j", "i") if back else ("i", "j")
    return f"{out} AS (SELECT a.vid, b.{j} AS k, sum(a.x * b.w) AS x FROM {src} a JOIN {w} b ON b.{i} = a.k GROUP BY a.vid, b.{j})"


def rectified(src: str, out: str) -> str:
    return f"{out} AS (SELECT vid, k, greatest(x, 0) AS x FROM {src})"


def soft(src: str, out: str) -> str:
    return f"{out}_t AS (SELECT vid, max(x) AS t FROM {src} GROUP BY vid), {out}_e AS (SELECT a.vid, a.k, exp(a.x - t) AS x FROM {src} a JOIN {out}_t USING (vid)), {out} AS (SELECT vid, k, x / sum(x) OVER (PARTITION BY vid) AS x FROM {out}_e)"


W = ",\n".join([weights("w0", WIDTH, HIDDEN), weights("w1", HIDDEN, LABELS)])
FORWARD = ",\n".join([product("x", "w0", "m0"), propagated("m0", "z0"), rectified("z0", "h1"), product("h1", "w1", "m1"), propagated("m1", "z1"), soft("z1", "p")])
ERROR = "er AS (SELECT p.vid, p.k, CASE WHEN sp.on_train THEN p.x - (p.k = v.label)::INT ELSE 0 END AS x FROM p JOIN v ON v.vid = p.vid JOIN sp ON sp.vid = p.vid)"


def outer(a: str, b: str, out: str) -> str:
    return f"{out} AS (SELECT sp.tid, a.k AS i, b.k AS j, sum(a.x * b.x) / max(sp.train_n) AS w FROM {a} a JOIN {b} b ON b.vid = a.vid JOIN sp ON sp.vid = a.vid GROUP BY sp.tid, a.k, b.k)"


GRAD1 = ",\n".join([ERROR, propagated("er", "v1"), outer("h1", "v1", "d1")])


def grad0(mode: str) -> str:
    return ",\n".join([product("v1" if mode == "full" else "er", "w1", "g1", back=True), "gz AS (SELECT g1.vid, g1.k, CASE WHEN z0.x > 0 THEN g1.x ELSE 0 END AS x FROM g1 JOIN z0 ON z0.vid = g1.vid AND z0.k = g1.k)", propagated("gz", "v0"), outer("x", "v0", "d0")])


def gated(src: str, z: str, out: str) -> str:
    return f"{out} AS (SELECT a.vid, a.k, CASE WHEN z.x > 0 THEN a.x ELSE 0 END AS x FROM {src} a JOIN {z} z ON z.vid = a.vid AND z.k = a.k)"


def per_edge(src: str, out: str, forward: bool = True) -> str:
    own = "i.x * sc.s" if forward else "i.x"
    return f"{out} AS (SELECT vid, k, sum(x) AS x FROM (SELECT i.vid, i.k, {own} AS x FROM {src} i JOIN sc ON sc.vid = i.vid UNION ALL SELECT e.dst, i.k, i.x * s0.s * s1.s FROM e JOIN {src} i ON i.vid = e.src JOIN sc s0 ON s0.vid = e.src JOIN sc s1 ON s1.vid = e.dst) GROUP BY vid, k)"


#: The kernels that propagate before they multiply: sums a0 and a1, products y0 and y1.
ORIGINAL = ",\n".join(["i0 AS (SELECT vid, k, x * s AS x FROM x JOIN sc USING (vid))", per_edge("i0", "a0"), product("a0", "w0", "y0"), rectified("y0", "g1_"), per_edge("g1_", "a1"), product("a1", "w1", "y1")])
DELAYED = ",\n".join([propagated("x", "a0"), product("a0", "w0", "y0"), rectified("y0", "g1_"), propagated("g1_", "a1"), product("a1", "w1", "y1")])
SUMS1 = ",\n".join([soft("y1", "p"), ERROR, outer("a1", "er", "d1")])


def sums0(hop: str) -> str:
    return ",\n".join([product("er", "w1", "down", back=True), hop, gated("hop", "y0", "gz"), outer("a0", "gz", "d0")])


def sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def r6(c: str, name: str | None = None) -> str:
    return f"round({c}, 6) + 0.0::DOUBLE AS {name or c}"


def long(src: str, keys: str = "vid") -> str:
    return f"SELECT {keys}, k, {r6('x', 'value')} FROM {src}"


# Rounds of the vertex programs, written out.
def _pagerank() -> str:
    parts = ["od AS (SELECT v.vid, count(e.src) AS o FROM v LEFT JOIN e ON e.src = v.vid GROUP BY v.vid)", "r0 AS (SELECT vid, 1.0::DOUBLE / n AS r FROM v, n)"]
    for i in range(5):
        parts.append(f"r{i + 1} AS (SELECT v.vid, 0.15::DOUBLE / max(n) + 0.85::DOUBLE * coalesce(sum(r.r / od.o), 0) AS r FROM v CROSS JOIN n LEFT JOIN e ON e.dst = v.vid LEFT JOIN r{i} r ON r.vid = e.src LEFT JOIN od ON od.vid = e.src GROUP BY v.vid)")
    return sql(GRAPH, *parts, "SELECT vid, round(r * 1000, 6) AS rank FROM r5")


def _paths(weight: str) -> list[str]:
    parts = [f"we AS (SELECT src, dst, {weight} AS w FROM e)", "d0_ AS (SELECT vid, CASE WHEN vid = (SELECT min(src) FROM e) THEN 0::BIGINT END AS dist, NULL::BIGINT AS parent FROM v)"]
    for i in range(ROUNDS):
        parts.append(f"b{i} AS MATERIALIZED (SELECT dst AS vid, min(dist + w) AS dist FROM we JOIN d{i}_ d ON d.vid = we.src WHERE dist IS NOT NULL GROUP BY dst)")
        parts.append(f"q{i} AS MATERIALIZED (SELECT we.dst AS vid, b.dist, min(we.src) AS parent FROM we JOIN d{i}_ d ON d.vid = we.src JOIN b{i} b ON b.vid = we.dst AND d.dist + we.w = b.dist GROUP BY we.dst, b.dist)")
        parts.append(f"d{i + 1}_ AS MATERIALIZED (SELECT d.vid, CASE WHEN q.dist IS NOT NULL AND (d.dist IS NULL OR q.dist < d.dist) THEN q.dist ELSE d.dist END AS dist, CASE WHEN q.dist IS NOT NULL AND (d.dist IS NULL OR q.dist < d.dist) THEN q.parent ELSE d.parent END AS parent FROM d{i}_ d LEFT JOIN q{i} q ON q.vid = d.vid)")
    return parts


def _components() -> str:
    return "WITH RECURSIVE " + GRAPH.strip() + """,
reach AS (SELECT vid AS vid, vid AS root FROM v UNION SELECT e.dst, r.root FROM reach r JOIN e ON e.src = r.vid WHERE r.root < e.dst)
SELECT vid, min(root) AS component FROM reach GROUP BY vid"""


RUNS = "runs AS (SELECT event_id, user_id % 4 AS party, event_type AS tag, value AS seconds, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS iter FROM events)"
EPOCHS = "ep AS (SELECT party, iter // 6 AS epoch, sum(seconds) AS seconds FROM runs GROUP BY ALL)"
ENC = "enc AS (SELECT vid, k, x, trunc(x * 65536)::BIGINT AS code FROM x)"
RING = "18446744073709551616::HUGEINT"
FIRST = f"(({{}}::HUGEINT * 6364136223846793005 + {{}}::HUGEINT * 1442695040888963407 + {{}}) % {RING})"
SHARES = f"sh AS (SELECT vid, k, x, {FIRST.format('vid', 'k', '0')} AS s0, (((code::HUGEINT - {FIRST.format('vid', 'k', '0')}) % {RING}) + {RING}) % {RING} AS s1 FROM enc)"


def _signed(a: str) -> str:
    return f"CASE WHEN {a} >= 9223372036854775808::HUGEINT THEN {a} - {RING} ELSE {a} END"


def _halved(src: str, out: str) -> str:
    """A round of messages 2 * (h / 2) and the mean with the own vector."""
    return f"{out} AS (SELECT a.vid, a.k, (a.x + coalesce(b.x, 0)) / (in_degree + 1) AS x FROM {src} a JOIN ind USING (vid) LEFT JOIN (SELECT dst AS vid, k, sum(i.x) AS x FROM e JOIN {src} i ON i.vid = e.src GROUP BY dst, k) b USING (vid, k))"


TRAFFIC = "tr AS (SELECT 'veth' || (user_id % 16) AS iface, printf('%.2f', sum(event_id * 1000)::DOUBLE / 1048576)::DOUBLE AS download_mb, printf('%.2f', sum(user_id * 1000)::DOUBLE / 1048576)::DOUBLE AS upload_mb FROM events GROUP BY user_id % 16)"


ORACLE_SQL: dict[str, str] = {
    "degree_in": sql(GRAPH, "SELECT vid, in_degree FROM ind"),
    "degree_out": sql(GRAPH, "SELECT v.vid, count(e.src) AS out_degree FROM v LEFT JOIN e ON e.src = v.vid GROUP BY v.vid"),
    "bag_degrees": sql(GRAPH, "SELECT vid, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS vid, 1 AS o, 0 AS i FROM base UNION ALL SELECT dst, 0, 1 FROM base) GROUP BY vid"),
    "edges_undirected": sql(GRAPH, "SELECT src, dst, count(*) AS copies FROM (SELECT src, dst FROM base UNION ALL SELECT dst, src FROM base) GROUP BY src, dst"),
    "mapped_degrees": sql(GRAPH, "o AS (SELECT src, count(*) AS src_out FROM e GROUP BY src)", "SELECT e.src, e.dst, o.src_out, ind.in_degree AS dst_in FROM e JOIN o ON o.src = e.src JOIN ind ON ind.vid = e.dst"),
    "accuracy_log": "SELECT (user_id % 4)::INT AS part, count(*) AS runs, round(avg((event_id % 100)::DOUBLE + (user_id % 10)::DOUBLE / 10), 6) AS test_acc, round(avg((event_id % 100)::DOUBLE + (user_id % 10)::DOUBLE / 10), 6) AS border_acc FROM events WHERE event_id % 5 <> 0 GROUP BY 1",
    "tile_lookup": sql(GRAPH, f"SELECT src, dst, src % {TILES} AS src_tid, dst % {TILES} AS dst_tid FROM e"),
    "border_vertices": sql(GRAPH, "SELECT vid, is_border FROM brd"),
    "mirror_vertices": sql(GRAPH, f"SELECT DISTINCT src % {TILES} AS tid, dst AS vid, dst % {TILES} AS owner FROM e WHERE src % {TILES} <> dst % {TILES}"),
    "tile_stats": sql(GRAPH, f"""a AS (SELECT tid, count(*) AS vertices, count_if(is_border) AS border, max(in_degree) AS longest_in_list FROM v JOIN brd USING (vid) JOIN ind USING (vid) GROUP BY tid),
b AS (SELECT src % {TILES} AS tid, count(*) AS edges, count_if(src % {TILES} <> dst % {TILES}) AS remote_edges, count(DISTINCT CASE WHEN src % {TILES} <> dst % {TILES} THEN dst END) AS mirrors FROM e GROUP BY 1)""", "SELECT tid, vertices, border::BIGINT AS border, longest_in_list, coalesce(edges, 0) AS edges, coalesce(remote_edges, 0)::BIGINT AS remote_edges, coalesce(mirrors, 0) AS mirrors FROM a LEFT JOIN b USING (tid)"),
    "inter_edge_ratio": sql(GRAPH, f"SELECT t AS tiles, {r6('avg((src % t <> dst % t)::INT)', 'ratio')} FROM e, range(2, 6) r(t) GROUP BY t"),
    "reordered_index": sql(GRAPH, "SELECT vid, tid, idx FROM ri"),
    "split_assign": sql(GRAPH, "SELECT vid, tid, split FROM sp"),
    "block_partition": sql(GRAPH, "SELECT vid, ntile(5) OVER (ORDER BY vid) - 1 AS part FROM v"),
    "round_robin_partition": sql(GRAPH, "SELECT vid, p AS parties, vid % p AS tid FROM v, range(2, 6) r(p)"),
    "prefix_subset_edges": sql(GRAPH, "b AS (SELECT vid, ntile(5) OVER (ORDER BY vid) - 1 AS part FROM v)", "SELECT src, dst FROM e WHERE src IN (SELECT vid FROM b WHERE part <= 1) AND dst IN (SELECT vid FROM b WHERE part <= 1)"),
    "is_undirected": sql(GRAPH, "SELECT count(*) = 0 AS undirected FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.src = a.dst AND b.dst = a.src)"),
    "edge_sort_rank": sql(GRAPH, "SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS place FROM e"),
    "in_adjacency": sql(GRAPH, "SELECT dst AS vid, string_agg(src::VARCHAR, ',' ORDER BY src) AS sources FROM e GROUP BY dst"),
    "implicit_vertices": sql(GRAPH, "SELECT DISTINCT vid, 0::BIGINT AS tid FROM (SELECT src AS vid FROM base UNION ALL SELECT dst FROM base)"),
    "tile_merge": sql(GRAPH, "SELECT vid, (vid % 6) // 2 AS tid FROM v"),
    "norm_factor": sql(GRAPH, f"SELECT vid, {r6('CASE WHEN in_degree = 0 THEN 0 ELSE pow(in_degree + 1, -0.5) END', 'plus_one')}, {r6('CASE WHEN in_degree = 0 THEN 0 ELSE pow(in_degree, -0.5) END', 'legacy')} FROM ind"),
    "integer_functions": sql(GRAPH, "SELECT vid, CASE WHEN in_degree = 0 THEN 0 ELSE length(bin(in_degree)) - 1 END::BIGINT AS log2, CASE WHEN in_degree <= 1 THEN 1 ELSE pow(2, length(bin(in_degree - 1))) END::BIGINT AS next_pow2, in_degree > 0 AND (in_degree & (in_degree - 1)) = 0 AS is_pow2, (vid + 1) % 5 AS next_party, (vid + 4) % 5 AS previous_party, greatest(in_degree, 20) AS at_least, least(in_degree, 20) AS at_most FROM ind"),
    "tokenize": "SELECT p_partkey, unnest(range(len(t)))::INT AS place, unnest(t) AS token FROM (SELECT p_partkey, list_filter(string_split_regex(p_name, '[ #,-]+'), lambda y: y <> '') AS t FROM part)",
    "feature_prescale": sql(GRAPH, f"SELECT vid, k, {r6('x * s', 'value')} FROM x JOIN sc USING (vid)"),
    "scatter_src_map": sql(GRAPH, "t AS (SELECT vid, sum(x) AS x FROM x GROUP BY vid)", f"SELECT src, dst, src % {TILES} <> dst % {TILES} AS inter, {r6('x', 'value')} FROM e JOIN t ON t.vid = e.src"),
    "premerge_by_tile": sql(GRAPH, f"SELECT src % {TILES} AS tid, dst AS vid, k, {r6('sum(x)', 'value')} FROM e JOIN x ON x.vid = e.src GROUP BY 1, 2, 3"),
    "gather_masked": sql(GRAPH, f"u AS (SELECT dst AS vid, k, sum(x) AS x FROM e JOIN x ON x.vid = e.src WHERE src % {TILES} = 1 GROUP BY 1, 2)", f"SELECT x.vid, x.k, {r6('x.x + coalesce(u.x, 0)', 'value')} FROM x LEFT JOIN u ON u.vid = x.vid AND u.k = x.k"),
    "gcn_propagate": sql(GRAPH, propagated("x", "z"), long("z")),
    "propagate_original": sql(GRAPH, "i AS (SELECT vid, k, x * s AS x, s FROM x JOIN sc USING (vid))", f"SELECT vid, k, {r6('sum(x)', 'value')} FROM (SELECT vid, k, x * s AS x FROM i UNION ALL SELECT e.dst, i.k, i.x * i.s * sc.s FROM e JOIN i ON i.vid = e.src JOIN sc ON sc.vid = e.dst) GROUP BY vid, k"),
    "degree_bump": sql(GRAPH, f"SELECT vid, in_degree + CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.dst = ind.vid AND e.src % {TILES} = e.dst % {TILES}) THEN 0 ELSE 1 END AS in_degree FROM ind"),
    "matmul": sql(GRAPH, W, product("x", "w0", "m"), long("m")),
    "matmul_dense": sql(GRAPH, W, product("x", "w0", "m"), long("m")),
    "matmul_then_propagate": sql(GRAPH, W, product("x", "w0", "m"), propagated("m", "z"), long("z")),
    "propagate_then_matmul": sql(GRAPH, W, propagated("x", "z"), product("z", "w0", "m"), long("m")),
    "gram_matrix": sql(GRAPH, f"SELECT a.k AS i, b.k AS j, {r6('sum(a.x * b.x)', 'w')} FROM x a JOIN x b ON b.vid = a.vid GROUP BY 1, 2"),
    "relu": sql(GRAPH, f"SELECT vid, k, {r6('greatest(x, 0)', 'value')} FROM x"),
    "softmax": sql(GRAPH, soft("x", "p"), long("p")),
    "transpose": sql(W, f"SELECT j AS i, i AS j, {r6('w')} FROM w0"),
    "onehot": sql(GRAPH, f"SELECT vid, k, (k = label)::INT::DOUBLE AS value FROM v, range({LABELS}) r(k)"),
    "feature_row_sum": sql(GRAPH, f"SELECT vid, {r6('sum(x)', 'total')} FROM x GROUP BY vid"),
    "vector_scale_two": sql(GRAPH, f"SELECT x.vid, k, {r6('x * s * label', 'value')} FROM x JOIN sc USING (vid) JOIN v USING (vid)"),
    "glorot_weights": sql(W, f"SELECT i, j, {r6('w')} FROM w0"),
    "gcn_forward": sql(GRAPH, W, FORWARD, long("z1")),
    "gcn_forward_delayed": sql(GRAPH, W, FORWARD, long("z1")),
    "gcn_forward_original": sql(GRAPH, W, ORIGINAL, long("y1")),
    "gcn_inference": sql(GRAPH, W, FORWARD, long("p")),
    "p_minus_y_masked": sql(GRAPH, W, FORWARD, ERROR, long("er")),
    "cross_entropy": sql(GRAPH, W, FORWARD, f"SELECT v.tid, {r6('avg(-ln(CASE WHEN p.x = 0 THEN 0.001 ELSE p.x END))', 'loss')} FROM p JOIN v ON v.vid = p.vid AND v.label = p.k GROUP BY v.tid"),
    "accuracy_by_split": sql(GRAPH, W, FORWARD, "a AS (SELECT vid, arg_min(k, -x * 1000000000 + k * 0) AS best FROM p GROUP BY vid)", "h AS (SELECT v.tid, sp.split, brd.is_border AS b, (a.best = v.label)::INT * 100.0 AS hit FROM v JOIN a USING (vid) JOIN sp USING (vid) JOIN brd USING (vid))",
        "m AS (SELECT tid, 'full' AS metric, avg(hit)::DOUBLE AS value FROM h GROUP BY tid UNION ALL SELECT tid, 'train', avg(hit) FILTER (WHERE split = 'train') FROM h GROUP BY tid UNION ALL SELECT tid, 'border_train', avg(hit) FILTER (WHERE split = 'train' AND b) FROM h GROUP BY tid UNION ALL SELECT tid, 'test', avg(hit) FILTER (WHERE split = 'test') FROM h GROUP BY tid UNION ALL SELECT tid, 'border_test', avg(hit) FILTER (WHERE split = 'test' AND b) FROM h GROUP BY tid UNION ALL SELECT tid, 'vertices', count(*) FROM h GROUP BY tid UNION ALL SELECT tid, 'border', count_if(b) FROM h GROUP BY tid)", f"SELECT tid, metric, {r6('value')} FROM m"),
    "grad_w1": sql(GRAPH, W, FORWARD, GRAD1, f"SELECT tid, i, j, {r6('w')} FROM d1"),
    "grad_w0_full": sql(GRAPH, W, FORWARD, GRAD1, grad0("full"), f"SELECT tid, i, j, {r6('w')} FROM d0"),
    "grad_w0_optimized": sql(GRAPH, W, FORWARD, GRAD1, grad0("optimized"), f"SELECT tid, i, j, {r6('w')} FROM d0"),
    "grad_w1_original": sql(GRAPH, W, ORIGINAL, SUMS1, f"SELECT tid, i, j, {r6('w')} FROM d1"),
    "grad_w0_original": sql(GRAPH, W, ORIGINAL, SUMS1, sums0(per_edge("down", "hop", forward=False)), f"SELECT tid, i, j, {r6('w')} FROM d0"),
    "grad_w1_delayed": sql(GRAPH, W, DELAYED, SUMS1, f"SELECT tid, i, j, {r6('w')} FROM d1"),
    "grad_w0_delayed": sql(GRAPH, W, DELAYED, SUMS1, sums0(propagated("down", "hop")), f"SELECT tid, i, j, {r6('w')} FROM d0"),
    "sgd_step": sql(GRAPH, W, FORWARD, GRAD1, f"SELECT tid, i, j, {r6('w1.w - 0.5::DOUBLE * d1.w', 'w')} FROM d1 JOIN w1 USING (i, j)"),
    "weight_average": sql(GRAPH, W, FORWARD, GRAD1, f"SELECT i, j, {r6('avg(w1.w - 0.5::DOUBLE * d1.w)', 'w')} FROM d1 JOIN w1 USING (i, j) GROUP BY i, j"),
    "fixed_point_encode": sql(GRAPH, ENC, "SELECT vid, k, code FROM enc"),
    "share_split": sql(GRAPH, ENC, SHARES, "SELECT vid, k, s0::VARCHAR AS share0, s1::VARCHAR AS share1 FROM sh"),
    "share_reconstruct": sql(GRAPH, ENC, SHARES, f"t AS (SELECT vid, k, (s0 + s1) % {RING} AS t FROM sh)", f"SELECT vid, k, {r6('(' + _signed('t') + ')::DOUBLE / 65536', 'value')} FROM t"),
    "share_linear_sum": sql(GRAPH, ENC, SHARES, f"t AS (SELECT dst AS vid, k, sum(s0) % {RING} AS a, sum(s1) % {RING} AS b FROM e JOIN sh ON sh.vid = e.src GROUP BY 1, 2)", f"u AS (SELECT vid, k, a, (a + b) % {RING} AS t FROM t)", f"SELECT vid, k, a::VARCHAR AS share0, {r6('(' + _signed('t') + ')::DOUBLE / 65536', 'value')} FROM u"),
    "ring_scale": sql(GRAPH, ENC, SHARES, f"SELECT vid, k, ((s0 * 1000) % {RING})::VARCHAR AS scaled FROM sh"),
    "share_weights": sql(W, f"c AS (SELECT i, j, trunc(w * 65536)::BIGINT AS code, {FIRST.format('i', 'j', '1')} AS s0 FROM w0)", f"SELECT i, j, s0::VARCHAR AS share0, ((((code::HUGEINT - s0) % {RING}) + {RING}) % {RING})::VARCHAR AS share1 FROM c"),
    "pagerank": _pagerank(),
    "sssp_parent": sql(GRAPH, *_paths("1 + (src * 7 + dst * 7) % 5"), f"SELECT vid, coalesce(dist, -1) AS dist, coalesce(parent, -1) AS parent FROM d{ROUNDS}_"),
    "bfs_levels": sql(GRAPH, *_paths("1"), f"SELECT vid, coalesce(dist, -1) AS level FROM d{ROUNDS}_"),
    "connected_components": _components(),
    "pair_add": sql(GRAPH, f"SELECT dst AS vid, {r6('sum(x)', 'total')}, count(*) AS count FROM e JOIN x ON x.vid = e.src AND x.k = 0 GROUP BY dst"),
    "safe_div": sql(GRAPH, f"SELECT vid, {r6('CASE WHEN in_degree = 0 THEN 0 ELSE x / in_degree END', 'value')} FROM x JOIN ind USING (vid) WHERE k = 0"),
    "task_algebra": sql(GRAPH, "f AS (SELECT vec_id AS vid, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, in_degree AS n FROM embeddings JOIN ind ON vid = vec_id)", f"SELECT vid, n + vid AS pair_count, CASE WHEN b < a THEN -1 ELSE vid END AS least_parent, n AS moved_parent, {r6('a + b', 'add')}, {r6('a + b', 'pair_value')}, {r6('least(a, b)', 'least')}, {r6('a + n', 'moved')}, {r6('CASE WHEN n = 0 THEN 0 ELSE a / n END', 'quotient')}, {r6('b', 'swapped')}, {r6('CASE WHEN n % 2 = 0 THEN b ELSE a END', 'masked')} FROM f"),
    "segmented_prefix_sum": sql(GRAPH, f"SELECT src, dst, {r6('sum(x) OVER (PARTITION BY dst ORDER BY src)', 'total')} FROM e JOIN x ON x.vid = e.src AND x.k = 0"),
    "barrier_and": sql(GRAPH, "SELECT tid, bool_and(in_degree > 0) AS agreed FROM v JOIN ind USING (vid) GROUP BY tid"),
    "degree_order": sql(GRAPH, "t AS (SELECT tid, row_number() OVER (PARTITION BY tid ORDER BY in_degree DESC, vid) AS place, vid, in_degree FROM ind JOIN v USING (vid))", "SELECT * FROM t WHERE place <= 10"),
    "comm_model": "WITH d AS (SELECT *, 8 * (d + 2 * h) AS m, 8 * (3 * h + 2 * c) AS o FROM (VALUES ('cora', 2708::DOUBLE, 10556::DOUBLE, 1433, 7, 16), ('citeseer', 3312, 10016, 3703, 6, 16), ('pubmed', 19717, 128146, 500, 3, 16)) t(dataset, n, e, d, c, h)), g AS (SELECT dataset, 'adjacency_matrix' AS model, 2 * m * (n * n + n) AS b FROM d UNION ALL SELECT dataset, 'adjacency_list', m * n * e FROM d UNION ALL SELECT dataset, 'graphsc', 10 * m * (n + e) FROM d UNION ALL SELECT dataset, 'original', m * (n + 5 * e) FROM d UNION ALL SELECT dataset, 'optimized', o * (n + 5 * e) FROM d) SELECT dataset, model, round(b / 1073741824, 6) AS gb FROM g",
    "epoch_duration": sql(RUNS, EPOCHS, f"SELECT party, epoch, {r6('seconds')} FROM ep"),
    "party_mean": sql(RUNS, EPOCHS, f"SELECT epoch, {r6('avg(seconds)', 'seconds')} FROM ep GROUP BY epoch"),
    "stage_breakdown": sql(RUNS, "t AS (SELECT tag, sum(seconds) / 90 AS seconds FROM runs GROUP BY tag)", f"SELECT tag, {r6('seconds')}, {r6('seconds / sum(seconds) OVER ()', 'share')} FROM t"),
    "online_preprocess_split": sql(RUNS, "t AS (SELECT party, coalesce(sum(seconds) FILTER (WHERE event_id % 2 = 0), 0) AS a, coalesce(sum(seconds) FILTER (WHERE event_id % 2 <> 0), 0) AS b FROM runs GROUP BY party)", f"SELECT party, {r6('(a - b) / 90', 'preprocess')}, {r6('b / 90', 'online')} FROM t"),
    "speedup_growth": sql(RUNS, "t AS (SELECT party + 2 AS parties, sum(seconds) AS slow, coalesce(sum(seconds) FILTER (WHERE event_id % 3 = 0), 0) AS fast FROM runs GROUP BY party)", f"SELECT parties, {r6('slow / fast', 'speedup')}, {r6('fast / first_value(fast) OVER (ORDER BY parties)', 'growth')} FROM t"),
    "log_parse": sql(RUNS, f"SELECT party, iter * 2 AS seq, tag, {r6('floor(seconds * 1000)::BIGINT / 1000', 'seconds')} FROM runs"),
    "traffic_text": "SELECT event_id, printf('%.2fMB', event_id::DOUBLE * 12345 / 1048576) AS label FROM events",
    "epoch_schedule": "SELECT * FROM (VALUES ('optimized', 0::BIGINT, 'forward', true, 16::BIGINT), ('optimized', 1, 'forward', true, 10), ('optimized', 2, 'error', false, 0), ('optimized', 3, 'backward', true, 10), ('optimized', 4, 'gate', false, 0), ('optimized', 5, 'backward', true, 16), ('original', 0, 'forward', true, 64), ('original', 1, 'forward', true, 16), ('original', 2, 'error', false, 0), ('original', 3, 'backward', true, 16)) t(kernel, iter, step, messages, width)",
    "engine_programs": sql(GRAPH, "outd AS (SELECT v.vid, count(e.src) AS out_degree FROM v LEFT JOIN e ON e.src = v.vid GROUP BY v.vid)", "u AS (SELECT 'in' AS program, vid, in_degree AS value FROM ind UNION ALL SELECT 'out', vid, out_degree FROM outd UNION ALL SELECT 'border', vid, is_border::BIGINT FROM brd)", f"SELECT * FROM u WHERE vid % {TILES} <> 1"),
    "prepared_resume": sql(GRAPH, "outd AS (SELECT v.vid, count(e.src) AS out_degree FROM v LEFT JOIN e ON e.src = v.vid GROUP BY v.vid)", f"mir AS (SELECT dst AS vid, count(DISTINCT src % {TILES}) AS mirrors FROM e WHERE src % {TILES} <> dst % {TILES} GROUP BY dst)", "SELECT vid, in_degree, out_degree, is_border, coalesce(mirrors, 0) AS mirrors FROM ind JOIN outd USING (vid) JOIN brd USING (vid) LEFT JOIN mir USING (vid)"),
    "edges_dealt": sql(GRAPH, "SELECT src % 4 AS part, count(*) AS edges, count(DISTINCT src) AS sources FROM e GROUP BY 1"),
    "degree_bump_propagate": sql(GRAPH.replace("sc AS (SELECT vid, pow(in_degree + 1, -0.5) AS s FROM ind)", f"sc AS (SELECT vid, pow(in_degree + 1 + CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.dst = ind.vid AND e.src % {TILES} = e.dst % {TILES}) THEN 0 ELSE 1 END, -0.5) AS s FROM ind)"), propagated("x", "z"), long("z")),
    "vector_program": sql(GRAPH, _halved("x", "h1"), _halved("h1", "h2"), long("h2")),
    "pair_reveal": sql("f AS (SELECT vec_id AS vid, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)", f"SELECT vid, {r6('trunc(a * 65536) / 65536', 'first')}, {r6('trunc(b * 65536) / 65536', 'second')} FROM f"),
    "accuracy_per_epoch": sql("t AS (SELECT event_id % 20 AS epoch, count(*) AS lines, avg((user_id % 100)::DOUBLE + 0.5) AS test_acc FROM events GROUP BY 1)", f"SELECT epoch, lines, {r6('test_acc')}, {r6('max(test_acc) OVER (ORDER BY epoch)', 'best')} FROM t"),
    "log_first_matches": sql(RUNS, "t AS (SELECT party, row_number() OVER (PARTITION BY party ORDER BY iter) AS place, iter AS seq, '::' || tag || ' took' AS value FROM runs WHERE regexp_matches(tag, '^[a-z_]*c'))", "SELECT * FROM t WHERE place <= 5"),
    "traffic_table": sql(TRAFFIC, "SELECT * FROM tr"),
    "traffic_by_party": sql(TRAFFIC, f"SELECT {r6('sum(download_mb + upload_mb) / 16 / 3 / 1024', 'gb')} FROM tr"),
}
