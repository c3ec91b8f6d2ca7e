"""Named queries over the driver's tables, and the same results in SQL.

Doubles are rounded to ``DIGITS`` places; sums over money columns are exact decimals before they become
doubles, so their order cannot show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fusewright.functions.storage import materialize
from fusewright.functions.validation import group_report, pair_report
from fusewright.operators import components as comp
from fusewright.operators.encoding import LabelEncoder
from fusewright.operators.group_stats import group_stats, grouping_flag, infer_n_groups, padded_stats
from fusewright.operators.location import location
from fusewright.operators.pairs import canonicalize, chain
from fusewright.operators.prox import graph_problems, objective, solve_scalar, solve_scalar_small, weighted_median
from fusewright.operators.structure import FusionGraph, build_graph
from fusewright.operators.weights import adaptive_weights, distance_weights, uniform_weights
from fusewright.sources import tables as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6
LAMBDA = 1e8
PATH = (0.0, 1e3, 1e7, 1e8, 1e9)


def r6(c: Column | str) -> Column:
    return F.round(c, DIGITS)


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def stats_of(obs: DataFrame, n: int | None = None) -> DataFrame:
    return group_stats(obs, n, validate=False).select("group_id", "size", r6("sum").alias("sum"), r6("mean").alias("mean"))


def stats_sql(source: str, n: str) -> str:
    return f"""WITH obs AS ({source}), a AS (SELECT group_id, count(*) AS size, CAST(sum(y) AS DOUBLE) AS sum FROM obs GROUP BY group_id)
SELECT CAST(g AS BIGINT) AS group_id, coalesce(size, 0) AS size, round(coalesce(sum, 0), 6) AS sum, round(coalesce(sum / size, 0), 6) AS mean
FROM range({n}) t(g) LEFT JOIN a ON a.group_id = g"""


PRICES = "SELECT l_suppkey AS group_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS y FROM lineitem"
VALUES = "SELECT user_id AS group_id, CAST(value AS DECIMAL(18,2)) AS y FROM events"
BALANCES = "SELECT s_nationkey AS group_id, CAST(s_acctbal AS DECIMAL(18,2)) AS y FROM supplier"
N_SUPPLIERS, N_USERS = "(SELECT max(l_suppkey) + 1 FROM lineitem)", "(SELECT max(user_id) + 1 FROM events)"


@query("group_stats_supplier", stats_sql(PRICES, N_SUPPLIERS))
def _(spark, d):
    return stats_of(src.supplier_prices(spark, d))


@query("group_stats_padded", stats_sql(BALANCES, "30"))
def _(spark, d):
    return stats_of(src.nation_balances(spark, d), 30)


@query("group_stats_missing_ids", stats_sql("SELECT o_custkey AS group_id, CAST(o_totalprice AS DECIMAL(18,2)) AS y FROM orders", "(SELECT max(o_custkey) + 1 FROM orders)"))
def _(spark, d):
    return stats_of(src.table(spark, d, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_totalprice").cast(src.MONEY).alias("y")))


@query(
    "group_identity_flag",
    """SELECT 'supplier' AS source, NOT (bool_and(s_suppkey = s_suppkey) AND count(*) = max(s_suppkey) + 1) AND count(*) > 0 AS is_grouped_data FROM supplier
UNION ALL SELECT 'nation', NOT (bool_and(s_nationkey = s_suppkey) AND count(*) = max(s_nationkey) + 1) AND count(*) > 0 FROM supplier""",
)
def _(spark, d):
    supplier = src.table(spark, d, "supplier")
    flag = lambda key, name: grouping_flag(supplier.select(F.col("s_suppkey").alias("obs_idx"), F.col(key).alias("group_id"))).select(F.lit(name).alias("source"), "is_grouped_data")
    return flag("s_suppkey", "supplier").unionByName(flag("s_nationkey", "nation"))


def theta_of(obs: DataFrame, method: str, n: int | None = None, **options) -> DataFrame:
    return location(obs, method, n, validate=n is None, **options).select("group_id", r6("theta").alias("theta"))


def theta_sql(with_: str, n: str, recursive: bool = False) -> str:
    """``with_`` ends in a table t(group_id, theta)."""
    return f"""WITH {"RECURSIVE " if recursive else ""}{with_}
SELECT CAST(g AS BIGINT) AS group_id, round(theta, 6) AS theta FROM range({n}) r(g) LEFT JOIN t ON t.group_id = g"""


MEAN_T = "t AS (SELECT group_id, CAST(sum(y) AS DOUBLE) / count(*) AS theta FROM obs GROUP BY group_id)"


def trimmed_sql(source: str, n: str, trim: float) -> str:
    return theta_sql(
        f"""obs AS ({source}), k AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY y) AS rn, count(*) OVER (PARTITION BY group_id) AS n FROM obs
), c AS (SELECT *, CAST(floor(CAST({trim} AS DOUBLE) * n) AS BIGINT) AS cut FROM k), t AS (
  SELECT group_id, CAST(sum(y) AS DOUBLE) / count(*) AS theta FROM c
  WHERE CASE WHEN n <= 2 THEN true WHEN 2 * cut >= n THEN rn BETWEEN (n + 1) // 2 AND (n + 2) // 2 ELSE rn > cut AND rn <= n - cut END GROUP BY group_id)""",
        n,
    )


def huber_sql(source: str, n: str, delta: float = 1.345, tol: float = 1e-6, turns: int = 100) -> str:
    return theta_sql(
        f"""obs AS ({source}), v AS (SELECT group_id, CAST(y AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS k FROM obs GROUP BY ALL),
l AS (SELECT group_id, list({{'y': y, 'k': k}} ORDER BY y) AS vals FROM v GROUP BY group_id),
b AS (SELECT group_id, count(*) AS n, median(CAST(y AS DOUBLE)) AS mid, CAST(sum(y) AS DOUBLE) / count(*) AS mean FROM obs GROUP BY group_id),
it AS (
  SELECT group_id, 0 AS i, mid AS t, false AS done FROM b WHERE n > 2
  UNION ALL
  SELECT group_id, i + 1, CASE WHEN abs(new - t) < {tol} THEN t ELSE new END, abs(new - t) < {tol} FROM (
    SELECT it.group_id, i, t, list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(vals, lambda v: CASE WHEN abs(v.y - t) <= {delta} THEN v.k ELSE v.k * (CAST({delta} AS DOUBLE) / abs(v.y - t)) END * v.y)), lambda a, x: a + x)
      / list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(vals, lambda v: CASE WHEN abs(v.y - t) <= {delta} THEN v.k ELSE v.k * (CAST({delta} AS DOUBLE) / abs(v.y - t)) END)), lambda a, x: a + x) AS new
    FROM it JOIN l ON l.group_id = it.group_id WHERE NOT done AND i < {turns})
), t AS (
  SELECT group_id, arg_max(t, i) AS theta FROM it GROUP BY group_id UNION ALL SELECT group_id, mean FROM b WHERE n <= 2)""",
        n,
        True,
    )


def lts_sql(source: str, n: str, trim: float, patience: int = 5) -> str:
    return theta_sql(
        f"""obs AS ({source}), s AS (
  SELECT group_id, row_number() OVER o AS rn, count(*) OVER (PARTITION BY group_id) AS n, CAST(sum(y) OVER o AS DOUBLE) AS s1, CAST(sum(y * y) OVER o AS DOUBLE) AS s2
  FROM obs WINDOW o AS (PARTITION BY group_id ORDER BY y ROWS UNBOUNDED PRECEDING)
), h AS (SELECT *, greatest(1, least(CAST(ceil((CAST(1 AS DOUBLE) - CAST({trim} AS DOUBLE)) * n) AS BIGINT), n)) AS h FROM s), w AS (
  SELECT e.group_id, e.rn - e.h AS k, (e.s2 - coalesce(b.s2, 0)) - (e.s1 - coalesce(b.s1, 0)) * (e.s1 - coalesce(b.s1, 0)) / e.h AS sse, (e.s1 - coalesce(b.s1, 0)) / e.h AS mean
  FROM h e LEFT JOIN h b ON b.group_id = e.group_id AND b.rn = e.rn - e.h WHERE e.rn >= e.h
), f AS (
  SELECT group_id, CAST(0 AS BIGINT) AS k, sse AS best, mean, 0 AS stale FROM w WHERE k = 0
  UNION ALL
  SELECT f.group_id, w.k, CASE WHEN w.sse < f.best - 1e-12 THEN w.sse ELSE f.best END, CASE WHEN w.sse < f.best - 1e-12 THEN w.mean ELSE f.mean END, CASE WHEN w.sse < f.best - 1e-12 THEN 0 ELSE f.stale + 1 END
  FROM f JOIN w ON w.group_id = f.group_id AND w.k = f.k + 1 WHERE f.stale < {patience}
), t AS (
  SELECT o.group_id, CASE WHEN count(*) <= 2 THEN CAST(sum(y) AS DOUBLE) / count(*) ELSE any_value(m.mean) END AS theta
  FROM obs o JOIN (SELECT group_id, arg_max(mean, k) AS mean FROM f GROUP BY group_id) m ON m.group_id = o.group_id GROUP BY o.group_id)""",
        n,
        True,
    )


COUPLES = "SELECT c_custkey // 2 AS group_id, CAST(c_acctbal AS DECIMAL(18,2)) AS y FROM customer"
N_COUPLES = "(SELECT max(c_custkey) // 2 + 1 FROM customer)"


@query("loc_mean", theta_sql(f"obs AS ({PRICES}), {MEAN_T}", N_SUPPLIERS))
def _(spark, d):
    return theta_of(src.supplier_prices(spark, d), "mean")


@query("loc_median", theta_sql(f"obs AS ({PRICES}), t AS (SELECT group_id, median(CAST(y AS DOUBLE)) AS theta FROM obs GROUP BY group_id)", N_SUPPLIERS))
def _(spark, d):
    return theta_of(src.supplier_prices(spark, d), "median")


@query("loc_trimmed_10", trimmed_sql(VALUES, N_USERS, 0.1))
def _(spark, d):
    return theta_of(src.user_values(spark, d), "trimmed_mean", trim=0.1)


@query("loc_trimmed_50", trimmed_sql(VALUES, N_USERS, 0.5))
def _(spark, d):
    return theta_of(src.user_values(spark, d), "trimmed_mean", trim=0.5)


@query("loc_huber", huber_sql(VALUES, N_USERS))
def _(spark, d):
    return theta_of(src.user_values(spark, d), "huber")


@query("loc_lts", lts_sql(VALUES, N_USERS, 0.1))
def _(spark, d):
    return theta_of(src.user_values(spark, d), "lts", trim=0.1)


@query("loc_lts_patience", lts_sql(VALUES, N_USERS, 0.3, 1))
def _(spark, d):
    return theta_of(src.user_values(spark, d), "lts", trim=0.3, lts_patience=1)


@query("loc_small_groups", theta_sql(f"obs AS ({COUPLES}), {MEAN_T}", N_COUPLES).replace("round(theta, 6) AS theta", "round(theta, 6) AS trimmed, round(theta, 6) AS huber, round(theta, 6) AS lts"))
def _(spark, d):
    obs = src.table(spark, d, "customer").select(F.expr("c_custkey div 2").alias("group_id"), F.col("c_acctbal").cast(src.MONEY).alias("y"))
    n = obs.agg(F.max("group_id")).head()[0] + 1
    of = lambda m, name: theta_of(obs, m, n).withColumnRenamed("theta", name)
    return of("trimmed_mean", "trimmed").join(of("huber", "huber"), "group_id").join(of("lts", "lts"), "group_id")


@query("loc_empty_groups", theta_sql(f"obs AS ({BALANCES}), {MEAN_T}", "30"))
def _(spark, d):
    return theta_of(src.nation_balances(spark, d), "mean", 30)


PAIRS = f"SELECT event_id AS pair_idx, user_id AS u, event_id % 50 % {N_USERS} AS v, CAST(value + 1 AS DECIMAL(18,2)) AS weight FROM events"
CANON = f"WITH p AS ({PAIRS}), c AS (SELECT pair_idx, least(u, v) AS u, greatest(u, v) AS v, weight FROM p WHERE u <> v)"


@query("pairs_canonical", f"{CANON} SELECT u, v, count(*) AS duplicates, CAST((SELECT max(v) + 1 FROM c) AS BIGINT) AS n_params FROM c GROUP BY u, v")
def _(spark, d):
    pairs = src.event_pairs(spark, d).withColumn("weight", F.lit(1))
    canonical = canonicalize(pairs, "sum")
    n = canonical.agg((F.max("v") + 1).alias("n_params"))
    return canonical.select("u", "v", F.col("weight").cast("long").alias("duplicates")).crossJoin(F.broadcast(n))  # one row


for _how, _sql in (("first", "arg_min(weight, pair_idx)"), ("sum", "sum(weight)"), ("mean", "CAST(sum(weight) AS DOUBLE) / count(*)"), ("max", "max(weight)"), ("min", "min(weight)")):

    @query(f"pairs_dup_{_how}", f"{CANON} SELECT u, v, round(CAST({_sql} AS DOUBLE), 6) AS weight FROM c GROUP BY u, v")
    def _(spark, d, how=_how):
        return canonicalize(src.event_pairs(spark, d), how).select("u", "v", r6("weight").alias("weight"))


@query(
    "pairs_validation_report",
    f"""WITH p AS ({PAIRS.replace("user_id AS u", "user_id - 2 AS u").replace("value + 1", "value - 10")})
SELECT count(*) AS n_pairs, count(*) FILTER (u IS NULL OR v IS NULL) AS n_null, count(*) FILTER (u < 0 OR v < 0) AS n_negative, CAST(0 AS BIGINT) AS n_weight_not_finite,
  count(*) FILTER (weight <= 0) AS n_weight_not_positive, count(*) FILTER (u = v) AS n_loops, count(*) FILTER (greatest(u, v) >= 10) AS n_out_of_bounds FROM p""",
)
def _(spark, d):
    pairs = src.event_pairs(spark, d).withColumns({"u": F.col("u") - 2, "weight": (F.col("weight") - 11).cast("double")})
    return pair_report(pairs, 10)


_KEYS = (("lineitem", "l_suppkey"), ("supplier", "s_nationkey"), ("orders", "o_custkey"), ("events", "user_id"))


@query("groups_validation_report", " UNION ALL ".join(f"SELECT '{k}' AS source, count(*) AS n_rows, count(*) FILTER ({k} IS NULL) AS n_invalid, count(*) FILTER ({k} < 0) AS n_negative, count(DISTINCT {k}) AS n_unique, CAST(min({k}) AS BIGINT) AS min_id, CAST(max({k}) AS BIGINT) AS max_id FROM {t}" for t, k in _KEYS))
def _(spark, d):
    rows = [group_report(src.table(spark, d, t), k).select(F.lit(k).alias("source"), "*") for t, k in _KEYS]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("encode_sorted", "SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT p_type AS label FROM part)")
def _(spark, d):
    return LabelEncoder().fit(src.table(spark, d, "part"), "p_type").dictionary


@query("encode_first_seen", "SELECT label, row_number() OVER (ORDER BY f) - 1 AS code FROM (SELECT event_type AS label, min(event_id) AS f FROM events GROUP BY event_type)")
def _(spark, d):
    return LabelEncoder(sort=False).fit(src.table(spark, d, "events"), "event_type", "event_id").dictionary


PART_CODES = "c AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT p_brand AS label FROM part))"


@query("encode_transform", f"WITH {PART_CODES} SELECT p_partkey, p_brand, code FROM part JOIN c ON p_brand = label")
def _(spark, d):
    part = src.table(spark, d, "part").select("p_partkey", "p_brand")
    return LabelEncoder().fit_transform(part, "p_brand")


@query("encode_inverse", f"WITH {PART_CODES} SELECT p_partkey, code, label AS decoded FROM part JOIN c ON code = p_partkey % (SELECT count(*) FROM c)")
def _(spark, d):
    part = src.table(spark, d, "part")
    encoder = LabelEncoder().fit(part, "p_brand")
    coded = part.select("p_partkey", F.pmod("p_partkey", F.lit(encoder.n_groups)).alias("code"))
    return encoder.inverse_transform(coded)


NATIONS = "p AS (SELECT a.n_name AS u_label, b.n_name AS v_label FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey), c AS (SELECT n_name AS label, row_number() OVER (ORDER BY n_name) - 1 AS code FROM nation)"


def _nation_names(spark, d):
    nation = src.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    a, b = (nation.select(F.col("n_nationkey").alias(f"{c}_key"), F.col("n_name").alias(f"{c}_label"), "n_regionkey") for c in ("u", "v"))
    return nation, a.join(b, "n_regionkey").filter("u_key < v_key").select("u_label", "v_label")


@query("encode_pairs", f"WITH {NATIONS} SELECT u_label, v_label, x.code AS u, y.code AS v FROM p JOIN c x ON u_label = x.label JOIN c y ON v_label = y.label")
def _(spark, d):
    nation, names = _nation_names(spark, d)
    return LabelEncoder().fit(nation, "n_name").transform_pairs(names)


@query("encode_pairs_inverse", f"WITH {NATIONS} SELECT x.code AS u, y.code AS v, u_label AS u_decoded, v_label AS v_decoded FROM p JOIN c x ON u_label = x.label JOIN c y ON v_label = y.label")
def _(spark, d):
    nation, names = _nation_names(spark, d)
    encoder = LabelEncoder().fit(nation, "n_name")
    return encoder.inverse_transform_pairs(encoder.transform_pairs(names).select("u", "v"))


@query("encode_unknown_labels", "SELECT DISTINCT s_name AS label FROM supplier WHERE s_name NOT IN (SELECT s_name FROM supplier WHERE s_suppkey % 3 = 0)")
def _(spark, d):
    supplier = src.table(spark, d, "supplier")
    return LabelEncoder().fit(supplier.filter("s_suppkey % 3 = 0"), "s_name").unknown_labels(supplier, "s_name")


def supplier_chain(spark, d, method: str = "mean") -> tuple[DataFrame, DataFrame]:
    """The suppliers' estimates, and the chain of neighbouring suppliers."""
    obs = src.supplier_prices(spark, d)
    n = obs.agg(F.max("group_id")).head()[0] + 1
    return location(obs, method, n, validate=False), chain(spark, n)


SUPPLIERS = f"obs AS ({PRICES}), {MEAN_T}, p AS (SELECT CAST(k AS BIGINT) AS u, CAST(k + 1 AS BIGINT) AS v FROM range({N_SUPPLIERS} - 1) r(k)), e AS (SELECT u, v, abs(a.theta - b.theta) AS d FROM p LEFT JOIN t a ON a.group_id = u LEFT JOIN t b ON b.group_id = v)"
#: Relative rounding of weights, whose sizes differ.
WEIGHT = "round({} * 1e6, 6)"


def weighted(df: DataFrame) -> DataFrame:
    return df.select("u", "v", F.round(F.col("weight") * 1e6, 6).alias("weight"))


def adaptive_sql(power: str, cap: str = "1e10") -> str:
    return f"WITH {SUPPLIERS} SELECT u, v, {WEIGHT.format(f'least(CASE WHEN d IS NULL THEN 1 WHEN {power} > 0 THEN 1 / {power} ELSE {cap} END, {cap})')} AS weight FROM e"


for _name, _gamma, _power in (("g1", 1.0, "d"), ("g2", 2.0, "(d * d)"), ("g05", 0.5, "sqrt(d)"), ("g15", 1.5, "pow(d, 1.5)")):

    @query(f"weights_adaptive_{_name}", adaptive_sql(_power))
    def _(spark, d, gamma=_gamma):
        theta, pairs = supplier_chain(spark, d)
        return weighted(adaptive_weights(pairs, theta, gamma))


@query("weights_adaptive_capped", adaptive_sql("d", "1e-3"))
def _(spark, d):
    theta, pairs = supplier_chain(spark, d)
    return weighted(adaptive_weights(pairs, theta, 1.0, 1e-3))


PADDED = f"obs AS ({BALANCES}), {MEAN_T}, p AS (SELECT CAST(k AS BIGINT) AS u, CAST(k + 1 AS BIGINT) AS v FROM range(29) r(k)), e AS (SELECT u, v, abs(a.theta - b.theta) AS d FROM p LEFT JOIN t a ON a.group_id = u LEFT JOIN t b ON b.group_id = v)"


@query("weights_adaptive_empty", f"WITH {PADDED} SELECT u, v, {WEIGHT.format('least(CASE WHEN d IS NULL THEN 1 WHEN d > 0 THEN 1 / d ELSE 1e10 END, 1e10)')} AS weight FROM e")
def _(spark, d):
    theta = location(src.nation_balances(spark, d), "mean", 30, validate=False)
    return weighted(adaptive_weights(chain(spark, 30), theta))


NATION_PAIRS = "SELECT CAST(a.n_nationkey AS BIGINT) AS u, CAST(b.n_nationkey AS BIGINT) AS v, CAST(a.n_nationkey + b.n_nationkey + 1 AS DOUBLE) AS weight FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"
N_NODES = 30  # five nodes beyond the nations are isolated


@query("weights_uniform", f"SELECT u, v, CAST(2.5 AS DOUBLE) AS weight FROM ({NATION_PAIRS})")
def _(spark, d):
    return uniform_weights(src.nation_pairs(spark, d), 2.5).select("u", "v", "weight")


@query("weights_distance", f"WITH obs AS ({BALANCES}), {MEAN_T}, p AS ({NATION_PAIRS}) SELECT u, v, round(coalesce(abs(a.theta - b.theta), 0), 6) AS weight FROM p LEFT JOIN t a ON a.group_id = u LEFT JOIN t b ON b.group_id = v")
def _(spark, d):
    theta = location(src.nation_balances(spark, d), "mean", N_NODES, validate=False)
    return distance_weights(src.nation_pairs(spark, d), theta).select("u", "v", r6("weight").alias("weight"))


def nation_graph(spark, d) -> FusionGraph:
    return FusionGraph(src.nation_pairs(spark, d), N_NODES, validate=False)


NATION_ADJ = f"p AS ({NATION_PAIRS}), adj AS (SELECT u AS node, v AS nbr, weight FROM p UNION ALL SELECT v, u, weight FROM p)"
NODES = f"(SELECT CAST(g AS BIGINT) AS node FROM range({N_NODES}) r(g))"


@query("graph_adjacency", f"WITH {NATION_ADJ} SELECT node, nbr, weight FROM adj")
def _(spark, d):
    return nation_graph(spark, d).adjacency


@query("graph_neighbors", f"WITH {NATION_ADJ} SELECT nbr, weight FROM adj WHERE node = 7")
def _(spark, d):
    return nation_graph(spark, d).neighbor_data(7)


@query("graph_degrees", f"WITH {NATION_ADJ} SELECT n.node, count(adj.node) AS degree FROM {NODES} n LEFT JOIN adj ON adj.node = n.node GROUP BY n.node")
def _(spark, d):
    return nation_graph(spark, d).degrees()


_LISTED = "coalesce(string_agg(nbr || ':' || CAST(weight AS BIGINT), ',' ORDER BY nbr), '')"


@query("graph_adjacency_list", f"WITH {NATION_ADJ} SELECT n.node, {_LISTED} AS nbrs FROM {NODES} n LEFT JOIN adj ON adj.node = n.node GROUP BY n.node")
def _(spark, d):
    text = F.array_join(F.transform("nbrs", lambda e: F.concat(e["nbr"].cast("string"), F.lit(":"), e["weight"].cast("long").cast("string"))), ",")
    return nation_graph(spark, d).adjacency_list().select("node", text.alias("nbrs"))


@query("graph_adjacency_map", f"WITH {NATION_ADJ} SELECT n.node, {_LISTED} AS nbrs FROM {NODES} n LEFT JOIN adj ON adj.node = n.node GROUP BY n.node")
def _(spark, d):
    entries = F.array_sort(F.map_entries("nbrs"))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("long").cast("string"))), ",")
    return nation_graph(spark, d).adjacency_map().select("node", text.alias("nbrs"))


def chain_graph(spark, d) -> tuple[DataFrame, FusionGraph]:
    theta, pairs = supplier_chain(spark, d)
    return theta, FusionGraph(adaptive_weights(pairs, theta), theta.count(), validate=False)


INC = f"WITH {SUPPLIERS}, w AS (SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS pair_idx, CASE WHEN d > 0 THEN 1 / d ELSE 1e10 END AS weight FROM e)"


@query("graph_incidence", f"{INC} SELECT u AS node, pair_idx, round(weight * 1e6, 6) AS value FROM w UNION ALL SELECT v, pair_idx, round(-weight * 1e6, 6) FROM w")
def _(spark, d):
    return chain_graph(spark, d)[1].incidence().select("node", "pair_idx", F.round(F.col("value") * 1e6, 6).alias("value"))


@query("graph_incidence_unweighted", f"{INC} SELECT u AS node, pair_idx, CAST(1 AS DOUBLE) AS value FROM w UNION ALL SELECT v, pair_idx, CAST(-1 AS DOUBLE) FROM w")
def _(spark, d):
    return chain_graph(spark, d)[1].incidence(weighted=False)


@query("graph_pair_differences", f"{INC} SELECT pair_idx, round(a.theta + (-1) * b.theta, 6) AS difference FROM w JOIN t a ON a.group_id = u JOIN t b ON b.group_id = v")
def _(spark, d):
    theta, graph = chain_graph(spark, d)
    return graph.pair_differences(theta, weighted=False).select("pair_idx", r6("difference").alias("difference"))


CUSTOMERS = "SELECT c_nationkey AS group_id, CAST(c_acctbal AS DECIMAL(18,2)) AS y FROM customer"


def _customers(spark, d):
    return src.table(spark, d, "customer").select(F.col("c_nationkey").alias("group_id"), F.col("c_acctbal").cast(src.MONEY).alias("y"))


def built_sql(theta: str) -> str:
    return f"WITH obs AS ({CUSTOMERS}), {theta}, p AS ({NATION_PAIRS}) SELECT u, v, {WEIGHT.format('CASE WHEN abs(a.theta - b.theta) > 0 THEN 1 / abs(a.theta - b.theta) WHEN a.theta IS NULL OR b.theta IS NULL THEN 1 ELSE 1e10 END')} AS weight FROM p LEFT JOIN t a ON a.group_id = u LEFT JOIN t b ON b.group_id = v"


@query("build_graph_adaptive", built_sql(MEAN_T))
def _(spark, d):
    return weighted(build_graph(_customers(spark, d), src.nation_pairs(spark, d), n_groups=25, validate=False).pairs)


@query("build_graph_median", built_sql("t AS (SELECT group_id, median(CAST(y AS DOUBLE)) AS theta FROM obs GROUP BY group_id)"))
def _(spark, d):
    return weighted(build_graph(_customers(spark, d), src.nation_pairs(spark, d), n_groups=25, method="median", validate=False).pairs)


@query("build_graph_uniform", f"SELECT u, v, {WEIGHT.format('CAST(1 AS DOUBLE)')} AS weight FROM ({NATION_PAIRS})")
def _(spark, d):
    return weighted(build_graph(_customers(spark, d), src.nation_pairs(spark, d), n_groups=25, adaptive=False, validate=False).pairs)


PROX = """, nb AS (
  SELECT problem_id, z, sum(w) OVER (PARTITION BY problem_id ORDER BY z, nbr ROWS UNBOUNDED PRECEDING) AS cw, sum(w) OVER (PARTITION BY problem_id) AS total FROM nbrs
), cand AS (
  SELECT p.problem_id, z AS c FROM problems p JOIN nb ON nb.problem_id = p.problem_id WHERE n > 0
  UNION ALL SELECT p.problem_id, (s - lam * (2 * cw - total)) / n FROM problems p JOIN nb ON nb.problem_id = p.problem_id WHERE n > 0
  UNION ALL SELECT p.problem_id, (s - lam * (2 * CAST(0 AS DOUBLE) - coalesce(w, 0))) / n FROM problems p LEFT JOIN (SELECT DISTINCT problem_id, total AS w FROM nb) q ON q.problem_id = p.problem_id WHERE n > 0
), solved AS (SELECT problem_id, median(c) AS x FROM cand GROUP BY problem_id)"""
CHAIN_ADJ = ", adj AS (SELECT u AS node, v AS nbr, CASE WHEN d > 0 THEN 1 / d ELSE 1e10 END AS w FROM e UNION ALL SELECT v, u, CASE WHEN d > 0 THEN 1 / d ELSE 1e10 END FROM e)"
SUMS = ", st AS (SELECT group_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS s FROM obs GROUP BY group_id)"


def prox_sql(base: str, lam: str, select: str) -> str:
    return f"WITH {base}{SUMS}, problems AS (SELECT group_id AS problem_id, n, s, {lam} AS lam FROM st), nbrs AS (SELECT node AS problem_id, nbr, theta AS z, w FROM adj JOIN t ON t.group_id = nbr){PROX} {select}"


def chain_stats(spark, d) -> tuple[DataFrame, DataFrame, FusionGraph]:
    """The suppliers' statistics from one scan of the line items, written since all else is built on them, their means, and the graph of the chain."""
    obs = src.supplier_prices(spark, d)
    sums = materialize(obs.groupBy("group_id").agg(F.count("*").alias("size"), F.sum("y").alias("sum")), "stats")
    top = infer_n_groups(sums)
    stats = padded_stats(sums.withColumn("sum", F.col("sum").cast("double")), top)
    theta = stats.select("group_id", F.when(F.col("size") > 0, F.col("mean")).alias("theta"))
    return stats, theta, FusionGraph(adaptive_weights(chain(spark, top), theta), top, validate=False, canonical=True)


def chain_problems(spark, d, lam: float) -> tuple[DataFrame, DataFrame]:
    stats, theta, graph = chain_stats(spark, d)
    return graph_problems(stats, graph.adjacency, theta, lam)


#: Neighbours on a chain.
BOTH_SIDES = 2


def solved(problems: DataFrame, nbrs: DataFrame, **options: int) -> DataFrame:
    return solve_scalar(problems, nbrs, validate=False, **options).select("problem_id", r6("x").alias("x"))


@query("flagship_fused_suppliers", prox_sql(SUPPLIERS + CHAIN_ADJ, "1e8", "SELECT group_id AS supplier, CAST(n AS BIGINT) AS items, round(s / n, 6) AS mean, round(x, 6) AS fused FROM solved JOIN st ON group_id = problem_id"))
def flagship(spark, d):
    """Suppliers' mean prices, one sweep of the scalar problem along the chain of suppliers."""
    stats, theta, graph = chain_stats(spark, d)
    problems, nbrs = graph_problems(stats, graph.adjacency, theta, LAMBDA)
    fused = solve_scalar_small(problems, nbrs)
    return stats.join(fused, F.col("group_id") == F.col("problem_id")).select(F.col("group_id").alias("supplier"), F.col("size").alias("items"), r6("mean").alias("mean"), r6("x").alias("fused"))


@query("prox_chain", prox_sql(SUPPLIERS + CHAIN_ADJ, "1e7", "SELECT problem_id, round(x, 6) AS x FROM solved"))
def _(spark, d):
    return solved(*chain_problems(spark, d, 1e7), largest=BOTH_SIDES)


@query("prox_objective", prox_sql(SUPPLIERS + CHAIN_ADJ, "1e7", "SELECT p.problem_id, round((n * x * x / 2 - s * x + lam * (SELECT sum(w * abs(x - z)) FROM nbrs b WHERE b.problem_id = p.problem_id)) / 1e6, 4) AS millions FROM problems p JOIN solved q ON q.problem_id = p.problem_id"))
def _(spark, d):
    problems, nbrs = chain_problems(spark, d, 1e7)
    return objective(solve_scalar(problems, nbrs, validate=False, largest=BOTH_SIDES), problems, nbrs).select("problem_id", F.round(F.col("objective") / 1e6, 4).alias("millions"))


NATION_BASE = f"obs AS ({CUSTOMERS}), {MEAN_T}, p AS ({NATION_PAIRS}), adj AS (SELECT u AS node, v AS nbr, CAST(1 AS DOUBLE) AS w FROM p UNION ALL SELECT v, u, CAST(1 AS DOUBLE) FROM p)"


@query("prox_clique", prox_sql(NATION_BASE, "CAST(5000 AS DOUBLE)", "SELECT problem_id, round(x, 6) AS x FROM solved"))
def _(spark, d):
    obs = _customers(spark, d)
    graph = build_graph(obs, src.nation_pairs(spark, d), n_groups=25, adaptive=False, validate=False)
    problems, nbrs = graph_problems(group_stats(obs, 25, validate=False), graph.adjacency, location(obs, "mean", 25, validate=False), 5000.0)
    return solved(problems.filter("n > 0"), nbrs).withColumn("problem_id", F.col("problem_id").cast("int"))


_PATH_SQL = " UNION ALL ".join(f"SELECT {k} AS k, CAST({lam} AS DOUBLE) AS l" for k, lam in enumerate(PATH))


@query(
    "prox_lambda_path",
    f"WITH {SUPPLIERS}{CHAIN_ADJ}{SUMS}, path AS ({_PATH_SQL}), problems AS (SELECT group_id * {len(PATH)} + k AS problem_id, n, s, l AS lam FROM st, path), nbrs AS (SELECT node * {len(PATH)} + k AS problem_id, nbr, theta AS z, w FROM adj JOIN t ON t.group_id = nbr, path){PROX} SELECT problem_id // {len(PATH)} AS supplier, lam, round(x, 6) AS x FROM solved JOIN problems USING (problem_id)",
)
def _(spark, d):
    problems, nbrs = chain_problems(spark, d, 0.0)
    path = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(lam).alias("l")) for k, lam in enumerate(PATH)]))
    many = problems.withColumn("e", path).select((F.col("problem_id") * len(PATH) + F.col("e.k")).alias("problem_id"), "n", "s", F.col("e.l").alias("lam"))
    near = nbrs.withColumn("e", path).select((F.col("problem_id") * len(PATH) + F.col("e.k")).alias("problem_id"), "nbr", "z", "w")
    return solve_scalar(many, near, validate=False, largest=BOTH_SIDES).join(many, "problem_id").select(F.expr(f"problem_id div {len(PATH)}").alias("supplier"), "lam", r6("x").alias("x"))


@query("prox_isolated", stats_sql(CUSTOMERS, "25").replace("SELECT CAST(g AS BIGINT) AS group_id, coalesce(size, 0) AS size, round(coalesce(sum, 0), 6) AS sum, round(coalesce(sum / size, 0), 6) AS mean", "SELECT CAST(g AS BIGINT) AS problem_id, round(coalesce(sum / size, 0), 6) AS x"))
def _(spark, d):
    stats = group_stats(_customers(spark, d), 25, validate=False)
    problems = stats.select(F.col("group_id").alias("problem_id"), F.col("size").cast("double").alias("n"), F.col("sum").alias("s"), F.lit(1.0).alias("lam"))
    return solved(problems, spark.createDataFrame([], "problem_id long, nbr long, z double, w double"))


@query(
    "prox_empty_group_wmedian",
    f"""WITH obs AS ({BALANCES}), {MEAN_T}, adj AS (SELECT CAST(k AS BIGINT) AS node, CAST(g AS BIGINT) AS nbr, CAST(g % 3 + 1 AS DOUBLE) AS w FROM range(25, 30) a(k), range(25) b(g) WHERE g % 5 = k - 25),
nb AS (SELECT node, theta AS z, sum(w) OVER (PARTITION BY node ORDER BY theta, nbr ROWS UNBOUNDED PRECEDING) AS cw, sum(w) OVER (PARTITION BY node) AS total FROM adj JOIN t ON t.group_id = nbr)
SELECT n.node AS problem_id, round(coalesce(min(z) FILTER (cw >= total / 2), 0), 6) AS x FROM (SELECT CAST(k AS BIGINT) AS node FROM range(25, 30) r(k)) n LEFT JOIN nb ON nb.node = n.node GROUP BY n.node""",
)
def _(spark, d):
    theta = location(src.nation_balances(spark, d), "mean", 30, validate=False).filter("theta IS NOT NULL")
    nbrs = theta.select((F.col("group_id") % 5 + 25).alias("problem_id"), F.col("group_id").alias("nbr"), F.col("theta").alias("z"), (F.col("group_id") % 3 + 1).cast("double").alias("w"))
    problems = spark.range(25, 30).select(F.col("id").alias("problem_id"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(1.0).alias("lam"))
    return solved(problems, nbrs)


@query("weighted_median", f"WITH o AS (SELECT user_id AS key, CAST(value AS DOUBLE) AS z, CAST(event_id % 4 AS DOUBLE) AS w FROM events), r AS (SELECT key, z, sum(w) OVER (PARTITION BY key ORDER BY z, w ROWS UNBOUNDED PRECEDING) AS cw, sum(w) OVER (PARTITION BY key) AS total FROM o) SELECT key, round(min(z) FILTER (cw >= total / 2), 6) AS x FROM r GROUP BY key")
def _(spark, d):
    values = src.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("value").alias("z"), (F.col("event_id") % 4).cast("double").alias("w"))
    return weighted_median(values).select("key", r6("x").alias("x"))


@query(
    "prox_benchmark_problems",
    """WITH ids AS (SELECT CAST(i AS BIGINT) AS problem_id, [5, 20, 50, 100, 200, 500][i % 6 + 1] AS r FROM range(120) t(i)),
nbrs AS (SELECT problem_id, nbr, ((problem_id + 1) * 7919 + (nbr + 1) * 104729) % 10007 / CAST(10007 AS DOUBLE) * 20 - 10 AS z, ((problem_id + 1) * 6151 + (nbr + 1) * 3571) % 10007 / CAST(10007 AS DOUBLE) * 1.5 + 0.5 AS w
  FROM (SELECT problem_id, unnest(range(r)) AS nbr FROM ids)),
m AS (SELECT problem_id, (problem_id + 1) * 4409 % 10007 / CAST(10007 AS DOUBLE) * 90 + 10 AS n, (problem_id + 1) * 2503 % 10007 / CAST(10007 AS DOUBLE) AS m, (problem_id + 1) * 9001 % 10007 / CAST(10007 AS DOUBLE) * 4.9 + 0.1 AS lam FROM ids),
problems AS (SELECT problem_id, n, (m * 100 - 50) * n AS s, lam FROM m)"""
    + PROX
    + " SELECT problem_id, round(x, 6) AS x FROM solved",
)
def _(spark, d):
    return solved(*src.benchmark_problems(spark), largest=max(src.SIZES))


def _labels(spark, d) -> DataFrame:
    return comp.connected_components(spark.range(N_NODES).withColumnRenamed("id", "node"), src.nation_pairs(spark, d).select("u", "v"))


REACH = f"""WITH RECURSIVE {NATION_ADJ}, reach(node, seen) AS (SELECT node, node FROM {NODES} UNION SELECT r.node, a.nbr FROM reach r JOIN adj a ON a.node = r.seen),
labels AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""


@query("components", f"{REACH} SELECT node, component FROM labels")
def _(spark, d):
    return _labels(spark, d)


@query("component_members", f"{REACH} SELECT component, string_agg(node, ',' ORDER BY node) AS members FROM labels GROUP BY component")
def _(spark, d):
    return comp.component_members(_labels(spark, d)).select("component", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query("component_sizes", f"{REACH} SELECT component, count(*) AS size FROM labels GROUP BY component")
def _(spark, d):
    return comp.component_sizes(_labels(spark, d))


@query("component_largest", f"{REACH} SELECT component, count(*) AS size FROM labels GROUP BY component ORDER BY size DESC, component LIMIT 1")
def _(spark, d):
    return comp.largest_component(_labels(spark, d))


@query("component_multi", f"{REACH} SELECT component, count(*) AS size FROM labels GROUP BY component HAVING count(*) > 1")
def _(spark, d):
    return comp.multi_element_components(_labels(spark, d))


@query("component_connected", f"{REACH} SELECT CAST(q AS BIGINT) AS x, CAST(q * 7 % {N_NODES} AS BIGINT) AS y, a.component = b.component AS connected FROM range({N_NODES}) t(q) JOIN labels a ON a.node = q JOIN labels b ON b.node = q * 7 % {N_NODES}")
def _(spark, d):
    asked = spark.range(N_NODES).select(F.col("id").alias("x"), (F.col("id") * 7 % N_NODES).alias("y"))
    return comp.connected(_labels(spark, d), asked)


CLOSE = f"WITH {SUPPLIERS}, mid AS (SELECT median(d) AS m FROM e), cut AS (SELECT u AS node FROM e, mid WHERE d > m)"


@query("components_supplier_chain", f"{CLOSE} SELECT group_id AS node, coalesce((SELECT max(node) + 1 FROM cut WHERE node < group_id), 0) AS component FROM t")
def _(spark, d):
    theta, pairs = supplier_chain(spark, d)
    far = distance_weights(pairs, theta)
    middle = far.agg(F.median("weight").alias("m"))
    edges = far.crossJoin(F.broadcast(middle)).filter("weight <= m").select("u", "v")  # one row
    return comp.connected_components(theta.select(F.col("group_id").alias("node")), edges)
