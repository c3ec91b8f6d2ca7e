"""Queries that show what the engine refuses, what its small accessors say, and how partitions grow, and the same in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.functions import validation as val
from fusewright.functions.schemas import pairs_from_array, pairs_from_column, pairs_from_lists
from fusewright.operators.components import DisjointSets, component_member_chunks, component_stars, connected_components, merges
from fusewright.operators.encoding import LabelEncoder
from fusewright.operators.group_stats import group_stats
from fusewright.operators.location import huber_report, location
from fusewright.operators.pairs import check_fusion_pairs, check_groups_and_pairs, guarded_pairs
from fusewright.operators.prox import check_problems, compare_solvers
from fusewright.operators.structure import FusionGraph
from fusewright.plans import catalog as cat
from fusewright.plans.catalog import query, r6
from fusewright.sources import tables as src

Call = Callable[[], object]


def refused(call: Call) -> int:
    """The rows that an error counts, 1 for an error without a count, 0 without an error."""
    try:
        call()
    except (ValueError, IndexError) as e:
        counted = re.search(r"\((\d+) rows", str(e))
        return int(counted[1]) if counted else 1
    return 0


def report(spark, cases: dict[str, Call]) -> DataFrame:
    return spark.createDataFrame([(name, refused(call)) for name, call in cases.items()], "check string, refused long")


def _sql(cases: dict[str, str]) -> str:
    return " UNION ALL ".join(f'SELECT \'{name}\' AS "check", CAST(({count}) AS BIGINT) AS refused' for name, count in cases.items())


@query(
    "refused_pairs",
    f"WITH p AS ({cat.PAIRS}) "
    + _sql({
        "sound": "0", "negative": "SELECT count(*) FILTER (u - 2 < 0 OR v < 0) FROM p", "null": "SELECT count(*) FILTER (pair_idx % 89 = 0) FROM p",
        "not finite": "SELECT count(*) FILTER (pair_idx % 97 = 0) FROM p", "not positive": "SELECT count(*) FILTER (weight - 11 <= 0) FROM p",
        "out of bounds": "SELECT count(*) FILTER (greatest(u, v) >= 10) FROM p", "no such strategy": "1", "no parameters": "1", "unknown groups": "SELECT count(*) FILTER (greatest(u, v) >= 10) FROM p",
    }),
)
def _(spark, d):
    pairs = src.event_pairs(spark, d).withColumn("weight", F.col("weight").cast("double"))
    few = spark.range(10).select(F.col("id").alias("obs_idx"), F.col("id").alias("group_id"))
    return report(spark, {
        "sound": lambda: check_fusion_pairs(pairs),
        "negative": lambda: check_fusion_pairs(pairs.withColumn("u", F.col("u") - 2)),
        "null": lambda: check_fusion_pairs(pairs.withColumn("u", F.when(F.col("pair_idx") % 89 != 0, F.col("u")))),
        "not finite": lambda: check_fusion_pairs(pairs.withColumn("weight", F.when(F.col("pair_idx") % 97 == 0, float("nan")).otherwise(F.col("weight")))),
        "not positive": lambda: check_fusion_pairs(pairs.withColumn("weight", F.col("weight") - 11)),
        "out of bounds": lambda: check_fusion_pairs(pairs, 10),
        "no such strategy": lambda: check_fusion_pairs(pairs, how="last"),
        "no parameters": lambda: check_fusion_pairs(pairs, 0),
        "unknown groups": lambda: check_groups_and_pairs(few, pairs),
    })


@query(
    "refused_groups",
    "WITH e AS (SELECT * FROM events) "
    + _sql({
        "sound": "0", "fractional": "SELECT count(*) FILTER (event_id % 83 = 0) FROM e", "negative": "SELECT count(*) FILTER (user_id - 3 < 0) FROM e", "gaps": "1", "too many": "1", "not from zero": "1",
        "out of range": "SELECT count(*) FILTER (user_id >= 5) FROM e", "null value": "SELECT count(*) FILTER (event_id % 71 = 0) FROM e", "infinite value": "SELECT count(*) FILTER (event_id % 61 = 0) FROM e", "no such method": "1", "trim": "1",
    }),
)
def _(spark, d):
    obs = src.user_values(spark, d).withColumn("y", F.col("y").cast("double"))
    hit = lambda k: F.col("obs_idx") % k == 0
    return report(spark, {
        "sound": lambda: location(obs, "mean"),
        "fractional": lambda: val.check_groups(obs.withColumn("group_id", F.when(hit(83), F.col("group_id") + 0.5).otherwise(F.col("group_id")))),
        "negative": lambda: val.check_groups(obs.withColumn("group_id", F.col("group_id") - 3)),
        "gaps": lambda: val.check_groups(obs.withColumn("group_id", F.col("group_id") * 2)),
        "too many": lambda: val.check_groups(obs, 3),
        "not from zero": lambda: val.check_groups(obs.withColumn("group_id", F.col("group_id") + 1), 1_000_000),
        "out of range": lambda: group_stats(obs, 5),
        "null value": lambda: location(obs.withColumn("y", F.when(~hit(71), F.col("y"))), "mean"),
        "infinite value": lambda: location(obs.withColumn("y", F.when(hit(61), float("inf")).otherwise(F.col("y"))), "median"),
        "no such method": lambda: location(obs, "mode"),
        "trim": lambda: location(obs, "trimmed_mean", trim=0.7),
    })


@query(
    "refused_problems_and_labels",
    _sql({
        "sound problems": "0", "negative size": "SELECT count(*) FILTER (user_id < 4) FROM (SELECT DISTINCT user_id FROM events)", "negative lambda": "SELECT count(DISTINCT user_id) FROM events",
        "infinite sum": "1", "negative weight": "SELECT count(*) FILTER (event_id % 5 = 0) FROM events", "unknown problem": "1",
        "null labels": "1", "NaN labels": "1", "unknown labels": "1", "unknown codes": "1", "unknown pair labels": "1", "not fitted": "1",
        "node": "1", "gamma": "1", "weight cap": "1", "uniform weight": "1", "sizes of arrays": "1",
    }),
)
def _(spark, d):
    events = src.table(spark, d, "events")
    problems = events.select(F.col("user_id").alias("problem_id")).distinct().withColumns({"n": F.lit(1.0), "s": F.lit(2.0), "lam": F.lit(1.0)})
    nbrs = events.select(F.col("user_id").alias("problem_id"), F.col("event_id").alias("nbr"), F.col("value").cast("double").alias("z"), F.lit(1.0).alias("w"))
    part = src.table(spark, d, "part").select(F.col("p_brand").alias("label"))
    known = LabelEncoder().fit(part)
    graph = cat.nation_graph(spark, d)
    pairs = src.nation_pairs(spark, d)
    theta = location(src.nation_balances(spark, d), "mean", 30, validate=False)
    odd = spark.createDataFrame([("nowhere", "elsewhere", 10**9)], "label string, other string, code long")
    return report(spark, {
        "sound problems": lambda: check_problems(problems, nbrs),
        "negative size": lambda: check_problems(problems.withColumn("n", F.when(F.col("problem_id") < 4, -1.0).otherwise(1.0)), nbrs),
        "negative lambda": lambda: check_problems(problems.withColumn("lam", F.lit(-1.0)), nbrs),
        "infinite sum": lambda: check_problems(problems.limit(1).withColumn("s", F.lit(float("inf"))), nbrs),
        "negative weight": lambda: check_problems(problems, nbrs.withColumn("w", F.when(F.col("nbr") % 5 == 0, -1.0).otherwise(1.0))),
        "unknown problem": lambda: check_problems(problems, nbrs.withColumn("problem_id", F.col("problem_id") + 10**6)),
        "null labels": lambda: LabelEncoder().fit(part.unionByName(spark.createDataFrame([(None,)], "label string"))),
        "NaN labels": lambda: LabelEncoder().fit(spark.createDataFrame([(1.0,), (float("nan"),)], "label double")),
        "unknown labels": lambda: known.transform(odd),
        "unknown codes": lambda: known.inverse_transform(odd),
        "unknown pair labels": lambda: known.transform_pairs(odd, "label", "other"),
        "not fitted": lambda: LabelEncoder().n_groups,
        "node": lambda: graph.degree(cat.N_NODES),
        "gamma": lambda: cat.adaptive_weights(pairs, theta, 0.0),
        "weight cap": lambda: cat.adaptive_weights(pairs, theta, 1.0, float("inf")),
        "uniform weight": lambda: cat.uniform_weights(pairs, -1.0),
        "sizes of arrays": lambda: pairs_from_array(spark, [(0, 1), (1, 2)], [1.0]),
    })


@query(
    "bounds_report",
    """WITH e AS (SELECT CAST(value AS DOUBLE) AS x FROM events)
SELECT CAST(0 AS BIGINT) AS not_finite, count(*) FILTER (x < 50) AS below, count(*) FILTER (x <= 50) AS not_above, count(*) FILTER (x > 90) AS above, count(*) FILTER (x >= 90) AS not_below, count(*) FILTER (x <= 0) AS not_positive FROM e""",
)
def _(spark, d):
    e = src.table(spark, d, "events").select(F.col("value").cast("double").alias("x"))
    low, high = val.violations("x", lower=50, upper=90, positive=True), val.violations("x", lower=50, upper=90, inclusive=False)
    counts = {"not_finite": low["x must be finite"], "below": low["x must be >= 50"], "not_above": high["x must be > 50"], "above": low["x must be <= 90"], "not_below": high["x must be < 90"], "not_positive": low["x must be positive"]}
    return e.agg(*[c.alias(k) for k, c in counts.items()])


@query("pairs_checked", f"{cat.CANON} SELECT u, v, round(CAST(sum(weight) AS DOUBLE), 6) AS weight, CAST((SELECT max(v) + 1 FROM c) AS BIGINT) AS n_params FROM c GROUP BY u, v")
def _(spark, d):
    pairs, n = check_fusion_pairs(src.event_pairs(spark, d), how="sum")
    return pairs.select("u", "v", r6("weight").alias("weight"), F.lit(n).cast("long").alias("n_params"))


@query("groups_and_pairs_checked", f"{cat.CANON} SELECT CAST({cat.N_USERS} AS BIGINT) AS n_groups, count(*) AS n_pairs, round(CAST(sum(weight) AS DOUBLE), 4) AS weight FROM (SELECT u, v, max(weight) AS weight FROM c GROUP BY u, v)")
def _(spark, d):
    n, pairs = check_groups_and_pairs(src.user_values(spark, d), src.event_pairs(spark, d), how="max")
    return pairs.agg(F.lit(n).cast("long").alias("n_groups"), F.count("*").alias("n_pairs"), F.round(F.sum(F.col("weight").cast("decimal(18,2)")).cast("double"), 4).alias("weight"))


@query("pairs_layouts", "SELECT layout, CAST(k AS BIGINT) AS pair_idx, CAST(k AS BIGINT) AS u, CAST(k + 2 AS BIGINT) AS v, CAST(1 AS DOUBLE) AS weight FROM range(4) r(k), (VALUES ('rows'), ('columns')) t(layout)")
def _(spark, d):
    u = list(range(4))
    layouts = {"rows": [(k, k + 2) for k in u], "columns": [u, [k + 2 for k in u]]}
    tables = [pairs_from_array(spark, p).withColumn("layout", F.lit(name)) for name, p in layouts.items()]
    return tables[0].unionByName(tables[1])


@query("loc_single_group", "SELECT CAST(0 AS BIGINT) AS group_id, round(CAST(sum(y) AS DOUBLE) / count(*), 6) AS mean, round(median(CAST(y AS DOUBLE)), 6) AS median FROM (SELECT CAST(c_acctbal AS DECIMAL(18,2)) AS y FROM customer)")
def _(spark, d):
    obs = src.table(spark, d, "customer").select(F.lit(0).alias("group_id"), F.col("c_acctbal").cast(src.MONEY).alias("y"))
    of = lambda m: location(obs, m, validate=False).select("group_id", r6("theta").alias(m))
    return of("mean").join(of("median"), "group_id")


@query(
    "loc_huber_converged",
    cat.huber_sql(cat.VALUES, cat.N_USERS, 20.0, 1e-3, 6)
    .replace("SELECT group_id, arg_max(t, i) AS theta FROM it GROUP BY group_id UNION ALL SELECT group_id, mean FROM b WHERE n <= 2", "SELECT group_id, bool_or(done) AS theta FROM it GROUP BY group_id UNION ALL SELECT group_id, true FROM b WHERE n <= 2")
    .replace("round(theta, 6) AS theta", "theta AS converged").replace("LEFT JOIN t", "JOIN t"),
)
def _(spark, d):
    return huber_report(src.user_values(spark, d), 20.0, 6, 1e-3).select("group_id", "converged")


@query(
    "encoder_attributes",
    """WITH c AS (SELECT DISTINCT p_brand AS label FROM part), n AS (SELECT count(*) AS n, min(label) AS first, max(label) AS last, (SELECT label FROM c ORDER BY label LIMIT 1 OFFSET 1) AS second FROM c)
SELECT false AS fitted_before, true AS fitted, n AS n_groups, first AS first_class, last AS last_class, 'LabelEncoder(sort=True, n_groups=' || n || ', classes=[' || CASE WHEN n <= 5 THEN (SELECT string_agg(label, ', ' ORDER BY label) FROM c) ELSE first || ', ' || second || ', ..., ' || last END || '])' AS shown FROM n""",
)
def _(spark, d):
    encoder = LabelEncoder()
    before = encoder.is_fitted
    encoder.fit(src.table(spark, d, "part"), "p_brand")
    row = (before, encoder.is_fitted, encoder.n_groups, encoder.classes[0], encoder.classes[-1], repr(encoder))
    return spark.createDataFrame([row], "fitted_before boolean, fitted boolean, n_groups long, first_class string, last_class string, shown string")


@query(
    "graph_summary",
    f"""WITH {cat.NATION_ADJ}, n AS (SELECT count(*) AS n FROM p)
SELECT CAST({cat.N_NODES} AS BIGINT) AS nodes, n AS pairs, (SELECT count(*) FROM adj WHERE node = 7) AS degree_7, CAST(0 AS BIGINT) AS degree_last, 'FusionGraph(n_params={cat.N_NODES}, n_pairs=' || n || ', mean_degree=' || printf('%.2f', 2 * n / CAST({cat.N_NODES} AS DOUBLE)) || ')' AS shown FROM n""",
)
def _(spark, d):
    graph = cat.nation_graph(spark, d)
    row = (len(graph), graph.n_pairs, graph.degree(7), graph.degree(cat.N_NODES - 1), repr(graph))
    return spark.createDataFrame([row], "nodes long, pairs long, degree_7 long, degree_last long, shown string")


_STEP = "WITH RECURSIVE p AS ({pairs}), adj AS (SELECT u AS node, v AS nbr FROM p UNION ALL SELECT v, u FROM p), reach(node, seen) AS (SELECT node, node FROM {nodes} UNION SELECT r.node, a.nbr FROM reach r JOIN adj a ON a.node = r.seen) SELECT {step} AS step, node, min(seen) AS component FROM reach GROUP BY node"
_HALF, _NONE = f"SELECT * FROM ({cat.NATION_PAIRS}) WHERE (u + v) % 2 = 0", f"SELECT * FROM ({cat.NATION_PAIRS}) WHERE false"


@query("disjoint_sets_steps", " UNION ALL ".join(f"({_STEP.format(pairs=pairs, nodes=cat.NODES, step=step)})" for step, pairs in enumerate((_NONE, _HALF, cat.NATION_PAIRS, _NONE))))
def _(spark, d):
    pairs, sets = src.nation_pairs(spark, d).select("u", "v"), DisjointSets(spark, cat.N_NODES)
    steps = [sets.labels]
    steps.append(sets.union(pairs.filter("(u + v) % 2 = 0")).labels)
    steps.append(sets.union(pairs).labels)
    sets.reset()
    steps.append(sets.labels)
    out = [s.select(F.lit(k).alias("step"), "node", "component") for k, s in enumerate(steps)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("disjoint_sets_pairs", "SELECT CAST(k AS BIGINT) AS k, merged, CAST(n AS BIGINT) AS n_components, CAST(found AS BIGINT) AS found FROM (VALUES (0, true, 29, 0), (1, false, 29, 0), (2, true, 28, 2), (3, true, 27, 0), (4, false, 27, 0), (5, true, 26, 0), (6, false, 30, 3)) t(k, merged, n, found)")
def _(spark, d):
    sets, rows = DisjointSets(spark, cat.N_NODES), []
    for k, (x, y) in enumerate([(0, 1), (1, 0), (2, 3), (3, 1), (0, 2), (29, 3)]):
        rows.append((k, sets.union_pair(x, y), sets.n_components, sets.find(y if k < 5 else 29)))
    sets.reset()
    rows.append((6, sets.connected(3, 0), len(sets) if sets.n_components == cat.N_NODES else -1, sets.find(3)))
    return spark.createDataFrame(rows, "k long, merged boolean, n_components long, found long")


_MERGES = f"""WITH RECURSIVE p AS ({cat.PAIRS}), e AS (SELECT least(u, v) AS u, greatest(u, v) AS v, min(pair_idx) AS k FROM p WHERE u <> v{{first}} GROUP BY ALL), s AS (
  SELECT CAST(-1 AS BIGINT) AS k, {{start}} AS sets
  UNION ALL
  SELECT k, list_transform(sets, lambda x: CASE WHEN x = greatest(a, b) THEN least(a, b) ELSE x END) FROM (
    SELECT min(e.k) AS k, any_value(sets) AS sets, arg_min(sets[u + 1], e.k) AS a, arg_min(sets[v + 1], e.k) AS b FROM s JOIN e ON e.k > s.k AND sets[u + 1] <> sets[v + 1] HAVING count(*) > 0)
) SELECT p.pair_idx, CAST(p.u AS BIGINT) AS u, CAST(p.v AS BIGINT) AS v, p.pair_idx IN (SELECT k FROM s) AS merged FROM p"""
#: Blocks so small that the given tables take many of them, and then the rounds between blocks.
SMALL_BLOCKS = 40


@query("union_merges", _MERGES.format(first="", start=f"range({cat.N_USERS})"))
def _(spark, d):
    pairs = src.event_pairs(spark, d).select("pair_idx", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    return merges(pairs, SMALL_BLOCKS)


@query("union_merges_into_sets", _MERGES.format(first="", start=f"list_transform(range({cat.N_USERS}), lambda x: x // 3 * 3)"))
def _(spark, d):
    """The same into sets of three that an earlier batch of unions made."""
    pairs = src.event_pairs(spark, d).select("pair_idx", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    sets = DisjointSets(spark, pairs.agg(F.max(F.greatest("u", "v"))).head()[0] + 1)
    threes = spark.range(sets.n).select((F.col("id") - F.col("id") % 3).alias("u"), F.col("id").alias("v"))
    return sets.union(threes).union_ordered(pairs)


@query(
    "components_star_rounds",
    f"""WITH RECURSIVE p AS (SELECT DISTINCT u, v FROM ({cat.PAIRS}) WHERE u <> v AND (u + v) % 7 < 2), adj AS (SELECT u AS a, v AS b FROM p UNION SELECT v, u FROM p),
reach(a, b) AS (SELECT a, a FROM adj UNION SELECT r.a, adj.b FROM reach r JOIN adj ON adj.a = r.b)
SELECT CAST(a AS BIGINT) AS node, CAST(min(b) AS BIGINT) AS component FROM reach GROUP BY a HAVING min(b) < a""",
)
def _(spark, d):
    edges = src.event_pairs(spark, d).filter("(u + v) % 7 < 2").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    return component_stars(edges, 7).select(F.col("u").alias("node"), F.col("v").alias("component"))


#: A third of all events in one group, and bounds so low that it and others are spread over tasks.
_HOT = cat.VALUES.replace("user_id AS group_id", "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS group_id")
SPREAD_FROM = 40


def _hot_values(spark, d) -> DataFrame:
    return src.user_values(spark, d).withColumn("group_id", F.when(F.col("obs_idx") % 3 == 0, 0).otherwise(F.col("group_id")))


@query("loc_median_hot", cat.theta_sql(f"obs AS ({_HOT}), t AS (SELECT group_id, median(CAST(y AS DOUBLE)) AS theta FROM obs GROUP BY group_id)", cat.N_USERS))
def _(spark, d):
    return cat.theta_of(_hot_values(spark, d), "median", hot=SPREAD_FROM)


@query("loc_trimmed_hot", cat.trimmed_sql(_HOT, cat.N_USERS, 0.2))
def _(spark, d):
    return cat.theta_of(_hot_values(spark, d), "trimmed_mean", trim=0.2, hot=SPREAD_FROM)


@query("loc_lts_hot", cat.lts_sql(_HOT, cat.N_USERS, 0.3, 50))
def _(spark, d):
    return cat.theta_of(_hot_values(spark, d), "lts", trim=0.3, lts_patience=50, hot=SPREAD_FROM)


_HUBS = """nbrs AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id + 1 END AS problem_id, event_id AS nbr, CAST(value AS DOUBLE) AS z, CAST(event_id % 4 AS DOUBLE) AS w FROM events),
problems AS (SELECT problem_id, CAST(3 + problem_id % 5 AS DOUBLE) AS n, CAST(100 * (problem_id % 7) AS DOUBLE) AS s, CAST(problem_id % 3 AS DOUBLE) / 4 AS lam FROM (SELECT DISTINCT problem_id FROM nbrs))"""


@query("prox_hubs", f"WITH {_HUBS}{cat.PROX} SELECT CAST(problem_id AS BIGINT) AS problem_id, round(x, 6) AS x FROM solved")
def _(spark, d):
    """A problem that a third of all events are neighbours of, and others over the bound, narrowed by rounds of counting."""
    events = src.table(spark, d, "events")
    nbrs = events.select(F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id") + 1).cast("long").alias("problem_id"), F.col("event_id").alias("nbr"), F.col("value").cast("double").alias("z"), (F.col("event_id") % 4).cast("double").alias("w"))
    k = F.col("problem_id")
    problems = nbrs.select("problem_id").distinct().select("problem_id", (3 + k % 5).cast("double").alias("n"), (100 * (k % 7)).cast("double").alias("s"), ((k % 3) / 4).alias("lam"))
    return cat.solved(problems, nbrs, leaf=SPREAD_FROM)


@query("pairs_layouts_events", f"SELECT layout, pair_idx, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, CAST(weight AS DOUBLE) AS weight FROM ({cat.PAIRS}), (VALUES ('(n, 2)'), ('(2, n)')) t(layout)")
def _(spark, d):
    """All events as pairs in an array column, and as lists of ends by day of the pair's number."""
    pairs = src.event_pairs(spark, d)
    rows = pairs_from_column(pairs.withColumn("pair", F.array("u", F.col("v").cast("long"))), weight="weight").withColumn("layout", F.lit("(n, 2)"))
    lists = pairs.groupBy(F.floor(F.col("pair_idx") / 500).alias("part")).agg(F.collect_list(F.struct("u", "v", "pair_idx", "weight")).alias("x"))  # 500 pairs a row
    columns = pairs_from_lists(lists.select(*[F.col(f"x.{c}").alias(c) for c in ("u", "v", "pair_idx", "weight")]), weight="weight").withColumn("layout", F.lit("(2, n)"))
    return rows.unionByName(columns)


@query("prox_benchmark_suppliers", cat.ORACLE_SQL["prox_benchmark_problems"].replace("FROM range(120) t(i)", "FROM (SELECT s_suppkey AS i FROM supplier)"))
def _(spark, d):
    """The generator's problems, one for each supplier."""
    ids = src.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"))
    return cat.solved(*src.benchmark_problems(spark, ids=ids), largest=max(src.SIZES))


_SETS = f"""WITH RECURSIVE p AS (SELECT DISTINCT u, v FROM ({cat.PAIRS}) WHERE u <> v AND u % 11 <> 0 AND (u * 7 + v) % 13 = 0), adj AS (SELECT u AS a, v AS b FROM p UNION SELECT v, u FROM p),
reach(a, b) AS (SELECT k, k FROM range({cat.N_USERS}) r(k) UNION SELECT r.a, adj.b FROM reach r JOIN adj ON adj.a = r.b), labels AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)"""


@query("disjoint_sets_events", f"{_SETS} SELECT count(*) AS n, count(*) FILTER (node = component) AS n_components, 'DisjointSets(n=' || count(*) || ', n_components=' || count(*) FILTER (node = component) || ')' AS shown FROM labels")
def _(spark, d):
    """Users joined by some events: how many elements and sets there are, and how the partition shows itself."""
    pairs = src.event_pairs(spark, d).select("u", F.col("v").cast("long").alias("v"))
    n = src.table(spark, d, "events").agg(F.max("user_id")).head()[0] + 1
    sets = DisjointSets(spark, n).union(pairs.filter("u % 11 <> 0 AND (u * 7 + v) % 13 = 0"))
    return spark.createDataFrame([(len(sets), sets.n_components, repr(sets))], "n long, n_components long, shown string")


def message(call: Call) -> str:
    """Kind and text of the error, or ``passed``."""
    try:
        call()
    except (ValueError, IndexError) as e:
        return f"{type(e).__name__}: {e}"
    return "passed"


def _says(cases: dict[str, str]) -> str:
    return " UNION ALL ".join(f'SELECT \'{name}\' AS "check", {text} AS says' for name, text in cases.items())


_COUNTED = "(SELECT '{} (' || count(*) || ' rows{})' FROM e WHERE {})"


@query(
    "refused_values",
    "WITH e AS (SELECT * FROM events) "
    + _says({
        "sound": "'passed'", "sound, NaN allowed": "'passed'", "null": _COUNTED.format("ValueError: y is null", "", "event_id % 71 = 0"), "NaN": _COUNTED.format("ValueError: y must be finite", "", "event_id % 61 = 0"),
        "negative": _COUNTED.format("ValueError: y must be non-negative", "", "CAST(value AS DOUBLE) < 40"), "zero": _COUNTED.format("ValueError: y must be positive", "", "event_id % 31 = 0"),
        "fractional groups": _COUNTED.format("ValueError: group_id must hold whole numbers", " do not", "event_id % 83 = 0"), "negative groups": _COUNTED.format("ValueError: group_id must be non-negative", " are not", "user_id < 3"),
        "gaps": "(SELECT 'ValueError: group_id must be contiguous from 0: ' || count(DISTINCT user_id) || ' ids from ' || 2 * min(user_id) || ' to ' || 2 * max(user_id) FROM e)",
        "too many": "(SELECT 'ValueError: there are ' || count(DISTINCT user_id) || ' groups, more than n_groups=3' FROM e)", "not from zero": "(SELECT 'ValueError: group_id must start at 0, it starts at ' || min(user_id) + 1 FROM e)",
        "beyond": "(SELECT 'ValueError: the largest id ' || max(user_id) * 2 || ' is not below n_groups=' || max(user_id) * 2 FROM e)", "node": "(SELECT 'IndexError: node ' || max(user_id) + 1 || ' is out of range [0, ' || max(user_id) + 1 || ')' FROM e)",
    }),
)
def _(spark, d):
    """What the checks of arrays and groups say of whole columns."""
    obs = src.user_values(spark, d).withColumn("y", F.col("y").cast("double"))
    hit = lambda k: F.col("obs_idx") % k == 0
    array = lambda y, **options: val.check_array(obs.withColumn("y", y), "y", **options)
    groups = lambda g, n=None: val.check_groups(obs.withColumn("group_id", g), n)
    g, y = F.col("group_id"), F.col("y")
    n = obs.agg(F.max("group_id")).head()[0] + 1
    cases = {
        "sound": lambda: array(y), "sound, NaN allowed": lambda: array(F.when(hit(61), float("nan")).otherwise(y), allow_nan=True), "null": lambda: array(F.when(~hit(71), y)), "NaN": lambda: array(F.when(hit(61), float("nan")).otherwise(y)),
        "negative": lambda: array(y - 40, non_negative=True), "zero": lambda: array(F.when(hit(31), 0.0).otherwise(F.abs(y) + 1), positive=True),
        "fractional groups": lambda: groups(F.when(hit(83), g + 0.5).otherwise(g)), "negative groups": lambda: groups(g - 3), "gaps": lambda: groups(g * 2), "too many": lambda: groups(g, 3), "not from zero": lambda: groups(g + 1, 10**6),
        "beyond": lambda: groups(g * 2, 2 * n - 2), "node": lambda: val.check_index(n, n),
    }
    return spark.createDataFrame([(name, message(call)) for name, call in cases.items()], "check string, says string")


#: The graph of event pairs that spares some users, so that there are isolated nodes; blocks and chunks so small that hubs take several.
_EVENT_GRAPH = f"""WITH p AS ({cat.PAIRS}), c AS (SELECT least(u, v) AS u, greatest(u, v) AS v, max(weight) AS weight FROM p WHERE u <> v AND u % 11 <> 0 AND v % 11 <> 0 GROUP BY ALL),
adj AS (SELECT u AS node, v AS nbr, CAST(weight AS DOUBLE) AS weight FROM c UNION ALL SELECT v, u, CAST(weight AS DOUBLE) FROM c)"""
BLOCK, CHUNK = 100, 16


def event_graph(spark, d) -> FusionGraph:
    pairs = src.event_pairs(spark, d).filter("u % 11 <> 0 AND v % 11 <> 0")
    n = src.table(spark, d, "events").agg(F.max("user_id")).head()[0] + 1
    return FusionGraph(pairs, n, "max", validate=False)


@query("graph_csr_pointers", f"{_EVENT_GRAPH} SELECT n.node, CAST(sum(k) OVER (ORDER BY n.node) - k AS BIGINT) AS start, CAST(sum(k) OVER (ORDER BY n.node) AS BIGINT) AS stop FROM (SELECT CAST(g AS BIGINT) AS node, count(adj.node) AS k FROM range({cat.N_USERS}) r(g) LEFT JOIN adj ON adj.node = g GROUP BY g) n")
def _(spark, d):
    return event_graph(spark, d).compressed_rows(BLOCK).pointers.select("node", "start", "stop")


@query("graph_csr_rows", f"{_EVENT_GRAPH} SELECT CAST(node AS BIGINT) AS node, CAST(nbr AS BIGINT) AS nbr, weight FROM adj")
def _(spark, d):
    return event_graph(spark, d).compressed_rows(BLOCK).rows()


_CHUNKED = "SELECT CAST({0} AS BIGINT) AS {0}, CAST((k - 1) // {1} AS BIGINT) AS chunk, string_agg({2}, ',' ORDER BY {2}) AS {3} FROM (SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY {2}) AS k FROM {4}) GROUP BY ALL"


@query("graph_adjacency_chunks", f"{_EVENT_GRAPH} {_CHUNKED.format('node', CHUNK, 'nbr', 'nbrs', 'adj')}")
def _(spark, d):
    text = F.array_join(F.transform("nbrs", lambda e: e["nbr"].cast("string")), ",")
    return event_graph(spark, d).adjacency_chunks(CHUNK).select("node", "chunk", text.alias("nbrs"))


@query("component_member_chunks", f"{_SETS} {_CHUNKED.format('component', CHUNK, 'node', 'members', 'labels')}")
def _(spark, d):
    n = src.table(spark, d, "events").agg(F.max("user_id")).head()[0] + 1
    edges = src.event_pairs(spark, d).filter("u % 11 <> 0 AND (u * 7 + v) % 13 = 0").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    labels = connected_components(spark.range(n).withColumnRenamed("id", "node"), edges)
    return component_member_chunks(labels, CHUNK).select("component", "chunk", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


_PARTS = "SELECT l_suppkey AS group_id, l_extendedprice * l_discount AS y FROM lineitem"


@query("group_stats_doubles", f"WITH a AS (SELECT group_id, count(*) AS size, fsum(y) AS s FROM ({_PARTS}) GROUP BY group_id) SELECT CAST(g AS BIGINT) AS group_id, coalesce(size, 0) AS size, round(coalesce(s, 0), 4) AS sum, round(coalesce(s / size, 0), 4) AS mean FROM range({cat.N_SUPPLIERS}) t(g) LEFT JOIN a ON group_id = g")
def _(spark, d):
    """Sums of doubles that do not depend on how the rows are dealt."""
    obs = src.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("group_id"), (F.col("l_extendedprice") * F.col("l_discount")).alias("y"))
    stats = group_stats(obs, validate=False, reproducible=True)
    return stats.select("group_id", "size", F.round("sum", 4).alias("sum"), F.round("mean", 4).alias("mean"))


@query("pairs_guarded", f"{cat.CANON} SELECT u, v, round(CAST(sum(weight) AS DOUBLE), 6) AS weight FROM c GROUP BY u, v")
def _(spark, d):
    """Validated by the job that merges them."""
    pairs = src.event_pairs(spark, d)
    return guarded_pairs(pairs, src.table(spark, d, "events").agg(F.max("user_id")).head()[0] + 1, "sum").select("u", "v", r6("weight").alias("weight"))


_BEST = cat.ORACLE_SQL["prox_benchmark_suppliers"]


@query(
    "prox_success_rate",
    _BEST[: _BEST.index(", solved AS (")]
    + """, tried AS (SELECT c.problem_id, c.c, any_value(p.n) * c.c * c.c / 2 - any_value(p.s) * c.c + any_value(p.lam) * sum(b.w * abs(c.c - b.z)) AS v
  FROM cand c JOIN problems p ON p.problem_id = c.problem_id JOIN nbrs b ON b.problem_id = c.problem_id GROUP BY c.problem_id, c.c),
best AS (SELECT problem_id, min(v) AS v FROM tried GROUP BY problem_id)
SELECT r, count(*) AS problems, count(*) AS solved, round(sum(v), 4) AS objective FROM best JOIN (SELECT problem_id, count(*) AS r FROM nbrs GROUP BY problem_id) USING (problem_id) GROUP BY r""",
)
def _(spark, d):
    """The closed form against bisection on the suppliers' problems, by number of neighbours; the SQL tries every candidate."""
    ids = src.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"))
    return compare_solvers(*src.benchmark_problems(spark, ids=ids)).withColumn("objective", F.round("objective", 4))
