"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

import math

from ..functions import special

SEED = 42
TWO13 = "4503599627370496.0::DOUBLE"
W = repr(1.0 / (0.4 * 0.4))


def uniform(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5({key} || '-{seed}'), 1, 13))::BIGINT / {TWO13})"


def seeded(key: str) -> str:
    return f"md5({key} || '-{SEED}')"


def query(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


PRICE = "price AS (SELECT l_partkey, avg(l_extendedprice / l_quantity) AS v FROM lineitem GROUP BY l_partkey)"
MOMENTS = "mom AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM price)"
PARTS = "pp AS (SELECT p_partkey::BIGINT AS point_id, p_size / 50.0::DOUBLE AS x1, (p_retailprice - 900.0::DOUBLE) / 100.0::DOUBLE AS x2, round((v - m) / s, 9) AS obs FROM part JOIN price ON p_partkey = l_partkey CROSS JOIN mom)"
PART_POINTS = [PRICE, MOMENTS, PARTS]
EVENTS = "ep AS (SELECT event_id::BIGINT AS point_id, (epoch_us(ts) - 1704067200000000) / 2592000000000.0::DOUBLE AS x1, user_id / (SELECT max(user_id) + 1 FROM events) AS x2, ln(1.0::DOUBLE + value) AS obs FROM events)"
SMOOTH = f"""sm AS (SELECT point_id, x1, x2, sin(6.0::DOUBLE * x1) + cos(4.0::DOUBLE * x2) + 0.1::DOUBLE * (u - 0.5::DOUBLE) AS obs
  FROM (SELECT p_partkey::BIGINT AS point_id, {uniform("p_partkey::BIGINT", 1)} AS x1, {uniform("p_partkey::BIGINT", 2)} AS x2, {uniform("p_partkey::BIGINT", 3)} AS u FROM part))"""
#: Training and test points: the id's last digit.
PART_SPLIT = ["tr AS (SELECT * FROM pp WHERE point_id % 10 <> 0)", "te AS (SELECT * FROM pp WHERE point_id % 10 = 0)"]
SMOOTH_SPLIT = ["tr AS (SELECT * FROM sm WHERE point_id % 10 <> 0)", "te AS (SELECT * FROM sm WHERE point_id % 10 = 0)"]


def distance(a: str, b: str, p: str = "x", q: str = "x", weight: str | None = None) -> str:
    w = f" * {weight}::DOUBLE" if weight else ""
    return " + ".join(f"({a}.{p}{i} - {b}.{q}{i}) * ({a}.{p}{i} - {b}.{q}{i}){w}" for i in (1, 2))


def blocked(points: str, k: int = 40, p: str = "") -> list[str]:
    """Sampled centers, assigned points, blocks with centroid and order, and points with their block's order."""
    return [
        f"{p}cen AS (SELECT row_number() OVER (ORDER BY key, point_id) - 1 AS cid, x1 AS c1, x2 AS c2 FROM (SELECT {seeded('point_id')} AS key, * FROM {points} ORDER BY key, point_id LIMIT {k}))",
        f"{p}na AS (SELECT point_id, x1, x2, obs, cid, d2 FROM (SELECT a.*, c.cid, {distance('a', 'c', q='c')} AS d2, row_number() OVER (PARTITION BY point_id ORDER BY {distance('a', 'c', q='c')}, c.cid) AS r FROM {points} a CROSS JOIN {p}cen c) WHERE r = 1)",
        f"{p}bo AS (SELECT *, row_number() OVER (ORDER BY {seeded('cid')}, cid) - 1 AS ord FROM (SELECT cid, round(avg(x1), 9) AS c1, round(avg(x2), 9) AS c2, count(*) AS n FROM {p}na GROUP BY cid))",
        f"{p}no AS (SELECT a.*, b.ord FROM {p}na a JOIN {p}bo b USING (cid))",
    ]


def classic(points: str, p: str = "") -> list[str]:
    return [f"{p}cb AS (SELECT point_id AS cid, x1 AS c1, x2 AS c2, x1, x2, obs, point_id, row_number() OVER (ORDER BY {seeded('point_id')}, point_id) - 1 AS ord FROM {points})"]


def nearest(blocks: str, points: str, m: int, name: str = "nn", earlier: bool = True) -> str:
    on = "p.ord < b.ord" if earlier else "true"
    d2 = distance("b", "p", p="c")
    return f"""{name} AS (SELECT * FROM (
  SELECT b.cid AS dest, p.point_id, {d2} AS d2, p.ord AS p_ord, p.obs, p.x1, p.x2, row_number() OVER (PARTITION BY b.cid ORDER BY {d2}, p.ord, p.point_id) AS rank
  FROM {blocks} b JOIN {points} p ON {on}) WHERE rank <= {m})"""


def covariance(name: str, d2: str) -> str:
    if name == "powexp":
        return f"exp(-pow(sqrt({d2}), 1.5::DOUBLE))"
    if name == "exponential":
        return f"exp(-sqrt({d2}))"
    order, terms = {"matern12": (0.5, ()), "matern32": (1.5, (1.0,)), "matern52": (2.5, (1.0, 1.0 / 3.0)), "matern72": (3.5, (1.0, 2.0 / 5.0, 1.0 / 15.0))}[name]
    s = f"({math.sqrt(2.0 * order)!r}::DOUBLE * sqrt({d2}))"
    poly = " + ".join(["1.0::DOUBLE", *(" * ".join([s] * k) + f" * {c!r}::DOUBLE" for k, c in enumerate(terms, 1))])
    return f"(({poly}) * exp(-{s}))"


K0 = "1.01::DOUBLE"


def one_neighbour(points: str, near: str, name: str = "co") -> list[str]:
    """Conditional mean and variance given at most one neighbour (Matérn-3/2, variance 1, nugget 0.01, ranges 0.4)."""
    c = covariance("matern32", distance("a", "n", weight=W))
    return [
        f"{name}0 AS (SELECT a.point_id, a.obs, n.obs AS n_obs, CASE WHEN n.obs IS NULL THEN 0.0::DOUBLE ELSE {c} END AS c FROM {points} a LEFT JOIN {near} n ON n.dest = a.point_id AND n.rank = 1)",
        f"{name} AS (SELECT point_id, obs, coalesce(c / {K0} * n_obs, 0.0::DOUBLE) AS mean, {K0} - c * c / {K0} AS var FROM {name}0)",
    ]


LOGLIK = "count(*) AS n, sum(ln(var)) AS logdet, sum((obs - mean) * (obs - mean) / var) AS quad"


def loglik(conditional: str, digits: int = 4) -> str:
    return f"SELECT n, round(logdet, {digits}) AS logdet, round(quad, {digits}) AS quad, round(-0.5::DOUBLE * (logdet + quad), {digits}) AS loglik FROM (SELECT {LOGLIK} FROM {conditional})"


def two_neighbours() -> list[str]:
    root = repr(math.sqrt(1.0 + 0.01)) + "::DOUBLE"
    c1, c2 = covariance("matern32", distance("a", "n", weight=W)), covariance("matern32", distance("a", "q", weight=W))
    c12 = covariance("matern32", distance("n", "q", weight=W))
    return [
        f"""t0 AS (SELECT a.point_id, a.obs, coalesce({c1}, 0.0) AS c1, coalesce({c2}, 0.0) AS c2, coalesce({c12}, 0.0) / {root} AS l21, coalesce(n.obs, 0.0) AS y1, coalesce(q.obs, 0.0) AS y2
  FROM pp a LEFT JOIN nn n ON n.dest = a.point_id AND n.rank = 1 LEFT JOIN nn q ON q.dest = a.point_id AND q.rank = 2)""",
        f"t1 AS (SELECT *, sqrt({K0} - l21 * l21) AS l22, c1 / {root} AS w1, y1 / {root} AS z1 FROM t0)",
        "t2 AS (SELECT *, (c2 - l21 * w1) / l22 AS w2, (y2 - l21 * z1) / l22 AS z2 FROM t1)",
        f"co AS (SELECT point_id, obs, w1 * z1 + w2 * z2 AS mean, {K0} - w1 * w1 - w2 * w2 AS var FROM t2)",
    ]


def horner(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def quantile(u: str) -> str:
    q, r = f"({u} - 0.5::DOUBLE)", f"(({u} - 0.5::DOUBLE) * ({u} - 0.5::DOUBLE))"

    def tail(x: str) -> str:
        return f"{horner(special.QUANTILE_C, x)} / ({horner(special.QUANTILE_D, x)} * {x} + 1.0::DOUBLE)"

    low, high = f"sqrt(-2.0::DOUBLE * ln({u}))", f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u}))"
    return f"CASE WHEN {u} < {special.QUANTILE_TAIL}::DOUBLE THEN {tail(low)} WHEN {u} > 1.0::DOUBLE - {special.QUANTILE_TAIL}::DOUBLE THEN -({tail(high)}) ELSE {horner(special.QUANTILE_A, r)} * {q} / ({horner(special.QUANTILE_B, r)} * {r} + 1.0::DOUBLE) END"


def extremes() -> list[str]:
    eps = "1e-12::DOUBLE"
    return [
        SMOOTH,
        "e1 AS (SELECT *, sqrt((x1 - 0.5::DOUBLE) * (x1 - 0.5::DOUBLE) + (x2 - 0.5::DOUBLE) * (x2 - 0.5::DOUBLE)) AS h FROM sm)",
        "e2 AS (SELECT *, 1.0::DOUBLE + exp(-(h / 0.6::DOUBLE) * (h / 0.6::DOUBLE)) AS delta, 1.5::DOUBLE * exp(-pow(h / 0.5::DOUBLE, 1.2::DOUBLE)) AS a FROM e1)",
        "e3 AS (SELECT *, 1.0::DOUBLE + pow(a, 0.3::DOUBLE) AS b FROM e2)",
        "e4 AS (SELECT *, (obs - a) / b AS z FROM e3)",
        "e5 AS (SELECT *, pow(abs(z - 0.1::DOUBLE) / 0.9::DOUBLE, delta) AS x, 1.0::DOUBLE / delta AS k FROM e4)",
        # P(k, x) as the series sum of x^(k + n) exp(-x) / Gamma(k + n + 1)
        "e6 AS (SELECT *, CASE WHEN x > 0 THEN list_sum(list_transform(range(0, 300), lambda n: exp((n + k) * ln(x) - x - lgamma(k + n + 1)))) ELSE 0.0 END AS p, ln(delta / 1.8::DOUBLE) - lgamma(k) - x AS log_f FROM e5)",
        "e7 AS (SELECT *, 0.5::DOUBLE + 0.5::DOUBLE * sign(z - 0.1::DOUBLE) * p AS u FROM e6)",
        f"e8 AS (SELECT *, greatest(least(u, 1.0::DOUBLE - {eps}), {eps}) AS v FROM e7)",
        f"sc AS (SELECT *, {quantile('v')} AS y FROM e8)",
    ]


PREDICTED = [SMOOTH, *SMOOTH_SPLIT, *classic("tr", "tr_"), *classic("te", "te_"), nearest("te_cb", "tr_cb", 1, earlier=False), *one_neighbour("te", "nn")]
METRICS = """SELECT count(*) AS n, round(avg((mean - obs) * (mean - obs)), 6) AS mspe,
  round(sqrt(avg(CASE WHEN abs(obs) > 1e-5 THEN pow(100.0::DOUBLE * (mean - obs) / obs, 2) ELSE 0.0 END)), 6) AS rmspe,
  round(avg(CASE WHEN obs BETWEEN mean - 1.96::DOUBLE * sqrt(greatest(var, 0.0)) AND mean + 1.96::DOUBLE * sqrt(greatest(var, 0.0)) THEN 1.0 ELSE 0.0 END), 6) AS coverage
FROM co"""


def order_candidates(blocks: str, name: str, threshold: float, first: int = 42) -> str:
    return f"{name} AS (SELECT DISTINCT a.cid AS src, b.cid AS dest FROM {blocks} a JOIN {blocks} b ON a.ord < b.ord AND (a.ord < {first} OR sqrt({distance('a', 'b', 'c', 'c')}) < {threshold / 2!r}::DOUBLE))"


def _borehole() -> str:
    ranges = ((0.05, 0.15), (100.0, 50000.0), (63070.0, 115600.0), (990.0, 1110.0), (63.1, 116.0), (700.0, 820.0), (1120.0, 1680.0), (1500.0, 15000.0))
    units = ", ".join(f"{uniform('o_orderkey::BIGINT', k)} AS x{k}" for k in range(1, 9))
    raw = ", ".join(f"{low!r}::DOUBLE + x{k} * {high - low!r}::DOUBLE AS {n}" for k, ((low, high), n) in enumerate(zip(ranges, ("rw", "r", "tu", "hu", "tl", "hl", "len", "kw"), strict=True), 1))
    y = "2.0::DOUBLE * 3.141592653589793::DOUBLE * tu * (hu - hl) / (ln(r / rw) * (1.0::DOUBLE + 2.0::DOUBLE * len * tu / (ln(r / rw) * rw * rw * kw) + tu / tl))"
    xs = ", ".join(f"round(x{k}, 7) AS x{k}" for k in range(1, 9))
    return f"""WITH a AS (SELECT o_orderkey::BIGINT AS point_id, {units} FROM orders),
b AS (SELECT *, {raw} FROM a), c AS (SELECT *, {y} AS y FROM b WHERE point_id % 10 <> 0),
m AS (SELECT avg(y) AS m1, avg(y * y) AS m2 FROM c)
SELECT point_id, {xs}, round((y - m1) / sqrt(m2 - m1 * m1), 7) AS obs FROM c CROSS JOIN m"""


def _embedding_distance(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def all_sql() -> dict[str, str]:
    blocks40 = [*PART_POINTS, *blocked("pp")]
    blocks80 = [*PART_POINTS, *blocked("pp", 80)]
    split = [*PART_POINTS, *PART_SPLIT, *blocked("tr", 40, "tr_"), *blocked("te", 10, "te_")]
    classic1 = [*PART_POINTS, *classic("pp"), nearest("cb", "cb", 1)]
    near8 = "SELECT dest, rank, point_id, round(d2, 8) AS d2 FROM nn"
    corner = " + ".join(f"(x{i} - 0.5::DOUBLE) * (x{i} - 0.5::DOUBLE) * {W}::DOUBLE" for i in (1, 2))
    found = {
        "scan_points": "SELECT p_partkey::BIGINT AS point_id, p_size / 50.0::DOUBLE AS x1, p_retailprice AS x2, p_size::DOUBLE AS obs FROM part",
        "part_points": query(PART_POINTS, "SELECT point_id, round(x1, 8) AS x1, round(x2, 8) AS x2, obs FROM pp"),
        "event_points": query([EVENTS], "SELECT point_id, round(x1, 8) AS x1, round(x2, 8) AS x2, round(obs, 8) AS obs FROM ep"),
        "lineitem_points": """SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS point_id,
  round(l_quantity / 50.0::DOUBLE, 8) AS x1, round(l_discount / 0.1::DOUBLE, 8) AS x2, round(l_tax / 0.08::DOUBLE, 8) AS x3,
  round((l_shipdate::DATE - DATE '1995-01-01') / 2500.0::DOUBLE, 8) AS x4, round(l_extendedprice / l_quantity, 8) AS obs FROM lineitem""",
        "smooth_points": query([SMOOTH], "SELECT point_id, round(x1, 8) AS x1, round(x2, 8) AS x2, round(obs, 8) AS obs FROM sm"),
        "synthetic_points": f"SELECT id AS point_id, {', '.join(f'{uniform("id", SEED * 100 + k)} AS x{k}' for k in (1, 2, 3))}, {uniform('id', SEED * 100)} AS obs FROM range(1000) t(id)",
        "disc_split": f"""WITH a AS (SELECT o_orderkey::BIGINT AS point_id, (2.0::DOUBLE * {uniform("o_orderkey::BIGINT", 1)} - 1.0::DOUBLE) * 0.1::DOUBLE AS x1, (2.0::DOUBLE * {uniform("o_orderkey::BIGINT", 2)} - 1.0::DOUBLE) * 0.1::DOUBLE AS x2 FROM orders)
SELECT point_id, round(x1, 10) AS x1, round(x2, 10) AS x2, x1 * x1 + x2 * x2 <= {0.1 * 0.1 / 3.0!r}::DOUBLE AS inner FROM a WHERE x1 * x1 + x2 * x2 <= {0.1 * 0.1!r}::DOUBLE""",
        "borehole": _borehole(),
        "limit_rows": query(PART_POINTS, "SELECT point_id FROM pp ORDER BY point_id LIMIT 100"),
        "scale_coords": query(PART_POINTS, "SELECT point_id, round(x1 / 0.5::DOUBLE, 8) AS x1, round(x2 / 2.0::DOUBLE, 8) AS x2, obs FROM pp"),
        "unscale_coords": query(PART_POINTS, "SELECT point_id, round(x1 / 0.5::DOUBLE * 0.5::DOUBLE, 8) AS x1, round(x2 / 2.0::DOUBLE * 2.0::DOUBLE, 8) AS x2, obs FROM pp"),
        "minmax_zscore": "SELECT p_partkey::BIGINT AS point_id, round((p_size::DOUBLE - 1.0::DOUBLE) / 49.0::DOUBLE, 7) AS x1, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 7) AS obs FROM part",
        "cast_float": query([EVENTS], "SELECT point_id, x2::FLOAT::DOUBLE AS x2 FROM ep"),
        "linear_partition": query([EVENTS], "SELECT point_id, least(greatest(floor(x2 * 0.5::DOUBLE * 16), 0), 15)::BIGINT AS part FROM ep"),
        "displacements": query([EVENTS, "c AS (SELECT least(greatest(floor(x2 * 0.5::DOUBLE * 16), 0), 15)::BIGINT AS part, count(*) AS n FROM ep GROUP BY 1)"], "SELECT part, n, (sum(n) OVER (ORDER BY part) - n)::BIGINT AS start FROM c"),
        "sample_centers": query(blocks40, "SELECT cid, round(c1, 8) AS c1, round(c2, 8) AS c2 FROM cen"),
        "nearest_center": query(blocks40, "SELECT point_id, cid, round(d2, 8) AS d2 FROM na"),
        "nearest_center_embeddings": f"""WITH e AS (SELECT vec_id::BIGINT AS point_id, embedding::DOUBLE[] AS c FROM embeddings),
k AS (SELECT row_number() OVER (ORDER BY key, point_id) - 1 AS cid, c FROM (SELECT {seeded("point_id")} AS key, * FROM e ORDER BY key, point_id LIMIT 16)),
d AS (SELECT e.point_id, k.cid, {_embedding_distance("e.c", "k.c")} AS d2 FROM e CROSS JOIN k)
SELECT point_id, cid, round(d2, 8) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, cid) AS r FROM d) WHERE r = 1""",
        "block_sizes": query([*blocks40, "s AS (SELECT cid, count(*) AS n FROM na GROUP BY cid)"], "SELECT min(n) AS min_size, max(n) AS max_size, avg(n) AS mean_size, count(*) AS blocks FROM s"),
        "centroids": query(blocks40, "SELECT cid, round(avg(x1), 8) AS c1, round(avg(x2), 8) AS c2, count(*) AS n FROM na GROUP BY cid"),
        "block_order": query(blocks40, "SELECT cid, ord FROM bo"),
        "classic_blocks": query([*PART_POINTS, *classic("pp")], "SELECT cid, ord FROM cb"),
        "block_rows": query(blocks40, "SELECT cid, any_value(ord) AS ord, count(*) AS n, sum(point_id)::BIGINT AS id_sum, min(point_id) AS first_id FROM no GROUP BY cid"),
        "lloyd_step": query(blocks40, "SELECT c.cid, round(coalesce(avg(a.x1), any_value(c.c1)), 8) AS c1, round(coalesce(avg(a.x2), any_value(c.c2)), 8) AS c2, count(a.cid) AS n FROM cen c LEFT JOIN na a USING (cid) GROUP BY c.cid"),
        "weighted_draw": query(blocks40, f"SELECT point_id, round(d2, 8) AS d2 FROM na WHERE d2 > 0 ORDER BY -ln(greatest({uniform('point_id', SEED)}, 1e-300)) / d2, point_id LIMIT 1"),
        "pair_distance": f"""WITH e AS (SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS c FROM embeddings)
SELECT p.id AS a, q.id AS b, round(sqrt({_embedding_distance("p.c", "q.c")}), 8) AS dist FROM e p JOIN e q ON q.id = p.id + 1""",
        "dist_threshold": "SELECT round(1.2::DOUBLE * (5 * 2.0::DOUBLE / 0.5::DOUBLE / 2.0::DOUBLE) / count(*), 8) AS threshold FROM part",
        "candidate_range_join": query(split, f"SELECT DISTINCT a.cid AS src, b.cid AS dest FROM tr_bo a JOIN te_bo b ON sqrt({distance('a', 'b', 'c', 'c')}) < 0.25::DOUBLE"),
        "candidate_order_join": query([*blocks80, order_candidates("bo", "ca", 0.5)], "SELECT src, dest FROM ca"),
        "candidate_totals": query([*blocks80, order_candidates("bo", "ca", 0.5)], "SELECT dest, count(*) AS n FROM ca JOIN na ON na.cid = src GROUP BY dest"),
        "union_dedup": query([*blocks80, order_candidates("bo", "ca", 0.2), order_candidates("bo", "cb", 0.6)], "SELECT src, dest FROM ca UNION SELECT src, dest FROM cb"),
        "nn_earlier_topm": query([*blocks40, nearest("bo", "no", 5)], near8),
        "nn_fill": query(
            [
                *blocks40,
                nearest("bo", "no", 60),
                order_candidates("bo", "ca", 0.5),
                "ch AS (SELECT * FROM nn WHERE d2 < 0.01)",
                "hv AS (SELECT dest, count(*) AS have FROM ch GROUP BY dest HAVING count(*) < 60)",
                f"""po AS (SELECT ca.dest, p.point_id, {distance("b", "p", p="c")} AS d2, p.ord AS p_ord, hv.have, row_number() OVER (PARTITION BY ca.dest ORDER BY p.ord, p.point_id) AS k
  FROM ca JOIN hv ON hv.dest = ca.dest JOIN no p ON p.cid = ca.src JOIN bo b ON b.cid = ca.dest
  WHERE b.ord > 0 AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.dest = ca.dest AND ch.x1 = p.x1 AND ch.x2 = p.x2))""",
                "al AS (SELECT dest, point_id, d2, p_ord FROM ch UNION ALL SELECT dest, point_id, d2, p_ord FROM po WHERE k <= 60 - have)",
                "rk AS (SELECT dest, point_id, d2, row_number() OVER (PARTITION BY dest ORDER BY d2, p_ord, point_id) AS rank FROM al)",
            ],
            "SELECT dest, rank, point_id, round(d2, 8) AS d2 FROM rk WHERE rank <= 60",
        ),
        "nn_test_topm": query([*split, nearest("te_bo", "tr_no", 5, earlier=False)], near8),
        "cov_long": query(blocks40, f"SELECT a.cid, a.point_id AS i, b.point_id AS j, round({covariance('matern32', distance('a', 'b', weight=W))} + CASE WHEN a.point_id = b.point_id THEN 0.01::DOUBLE ELSE 0.0 END, 9) AS val FROM na a JOIN na b ON a.cid = b.cid AND a.point_id <= b.point_id"),
        "gflops": query(
            [*blocks40, nearest("bo", "no", 5), "hv AS (SELECT dest, count(*) AS m FROM nn GROUP BY dest)", "sz AS (SELECT n::DOUBLE AS n, coalesce(m, 0)::DOUBLE AS m FROM bo LEFT JOIN hv ON cid = dest)"],
            "SELECT round(sum(17.0 * (n*n + m*m + n*m) + (m*m*m/3.0::DOUBLE + m*m/2.0::DOUBLE + m/6.0::DOUBLE) + (n*n*n/3.0::DOUBLE + n*n/2.0::DOUBLE + n/6.0::DOUBLE) + m*m*n + m*m + n*n + 2.0*n*n*m + 2.0*n*m + 2.0*n*n + 2.0*n + 8.0*n) / 1e9, 9) AS gflops FROM sz",
        ),
        "gp_loglik_m1": query([*classic1, *one_neighbour("pp", "nn")], loglik("co")),
        "gp_loglik_m2": query([*PART_POINTS, *classic("pp"), nearest("cb", "cb", 2), *two_neighbours()], loglik("co")),
        "sum_terms": query([*classic1, *one_neighbour("pp", "nn")], "SELECT floor(point_id / 100)::BIGINT AS grp, round(sum((obs - mean) * (obs - mean) / var), 6) AS quad, round(sum(ln(var)), 6) AS logdet FROM co GROUP BY 1"),
        "sce_terms": query(extremes(), "SELECT point_id, round(delta, 8) AS delta, round(a, 8) AS a, round(b, 8) AS b, round(z, 8) AS z FROM e4"),
        "dl_pdf": query(extremes(), "SELECT point_id, round(exp(log_f), 8) AS f FROM e6"),
        "dl_cdf": query(extremes(), "SELECT point_id, round(u, 8) AS u FROM e7"),
        "latent": query(extremes(), "SELECT point_id, round(y, 6) AS y FROM sc"),
        "sce_loglik_m1": query(
            [*extremes(), "lp AS (SELECT point_id, x1, x2, round(y, 9) AS obs FROM sc)", *classic("lp"), nearest("cb", "cb", 1), *one_neighbour("lp", "nn"), f"gl AS (SELECT {LOGLIK} FROM co)", "jc AS (SELECT sum(log_f) AS f, sum(ln(b)) AS b, sum(0.5::DOUBLE * y * y) AS y2 FROM sc)"],
            "SELECT n, round(-0.5::DOUBLE * (logdet + quad), 3) AS loglik_latent, round(-0.5::DOUBLE * (logdet + quad) + f + y2 - b, 3) AS loglik FROM gl CROSS JOIN jc",
        ),
        "predict_m1": query(PREDICTED, "SELECT point_id, round(mean, 8) AS mean, round(var, 8) AS var FROM co"),
        "pred_metrics": query(PREDICTED, METRICS),
        "mc_interval": query(
            [*PREDICTED, f"dr AS (SELECT point_id, mean, var, greatest(least({uniform("point_id || ':' || k", SEED)}, 1.0::DOUBLE - 1e-15), 1e-15) AS u FROM co CROSS JOIN range(1, 51) t(k))", f"dd AS (SELECT point_id, mean + sqrt(greatest(var, 0.0)) * ({quantile('u')}) AS d FROM dr)"],
            "SELECT point_id, round(avg(d), 6) AS mean, round(greatest(avg(d * d) - avg(d) * avg(d), 0.0), 6) AS var FROM dd GROUP BY point_id",
        ),
        "trial_stats": "SELECT event_type AS kind, count(*) AS n_trials, round(avg(value), 6) AS mean_v, round(stddev_pop(value), 6) AS std_v, round(min(value), 6) AS min_v, round(max(value), 6) AS max_v, round(median(value), 6) AS median_v FROM events WHERE event_id % 97 <> 0 AND value IS NOT NULL AND NOT isnan(value) GROUP BY event_type",
    }
    found["block_loglik_m1"], found["block_loglik_m2"], found["block_metrics_m1"] = found["gp_loglik_m1"], found["gp_loglik_m2"], found["pred_metrics"]
    found["sce_block_loglik_m1"] = f"SELECT n, loglik FROM ({found['sce_loglik_m1']})"
    # log det and quadratic form of [[k, c], [c, k]], or of k alone where a part has no partner
    pair = covariance("matern32", distance("a", "b", weight=W))
    found["block_loglik_pairs"] = query(
        [
            *PART_POINTS,
            f"pr AS (SELECT a.obs AS y1, b.obs AS y2, coalesce({pair}, 0.0) AS c FROM pp a LEFT JOIN pp b ON b.point_id = a.point_id + 1 WHERE a.point_id % 2 = 0 UNION ALL SELECT a.obs, NULL, 0.0 FROM pp a WHERE a.point_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM pp b WHERE b.point_id = a.point_id - 1))",
            f"tm AS (SELECT CASE WHEN y2 IS NULL THEN 1 ELSE 2 END AS n, CASE WHEN y2 IS NULL THEN ln({K0}) ELSE ln({K0} * {K0} - c * c) END AS logdet, CASE WHEN y2 IS NULL THEN y1 * y1 / {K0} ELSE ({K0} * (y1 * y1 + y2 * y2) - 2.0::DOUBLE * c * y1 * y2) / ({K0} * {K0} - c * c) END AS quad FROM pr)",
            "ts AS (SELECT sum(n)::BIGINT AS n, sum(logdet) AS logdet, sum(quad) AS quad FROM tm)",
        ],
        "SELECT n, round(logdet, 4) AS logdet, round(quad, 4) AS quad, round(-0.5::DOUBLE * (logdet + quad), 4) AS loglik FROM ts",
    )
    for name in ("matern12", "matern32", "matern52", "matern72", "powexp", "exponential"):
        found[f"kernel_{name}"] = query(PART_POINTS, f"SELECT point_id, round({covariance(name, corner)}, 10) AS cov FROM pp")
    return found
