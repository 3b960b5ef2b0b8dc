"""Memory records, rewards and graphs, made from the driver's tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import graph, memory, pack
from skein.plans.base import Query, load, register

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# A record a customer: the market segment is its tier, nation and status words are its tags.
_TIERS = {"AUTOMOBILE": "episodic", "BUILDING": "episodic", "FURNITURE": "semantic", "HOUSEHOLD": "procedural", "MACHINERY": "asset_profile"}
_RECORDS = """r AS (
  SELECT (CASE WHEN c_custkey % 41 = 0 THEN 'seed-' ELSE 'm-' END) || c_custkey AS memory_id,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'episodic' WHEN 'BUILDING' THEN 'episodic' WHEN 'FURNITURE' THEN 'semantic' WHEN 'HOUSEHOLD' THEN 'procedural' ELSE 'asset_profile' END AS tier,
         ['n' || c_nationkey, 'k' || (c_custkey % 13), 'v' || (c_custkey % 5), 'root:' || (c_custkey % 3)] AS tags, ['a' || (c_custkey % 17)] AS asset_ids,
         1 + (c_custkey % 9) / 4.0 AS confidence, (c_custkey % 6) / 2.0 AS importance, 1.0 / (1 + c_custkey % 4) AS strength, c_custkey % 10 AS access_count,
         list_transform(range(0, c_custkey % 4), lambda i: 'l' || i) AS links, c_custkey % 23 = 0 AS quarantined, c_custkey AS insertion_order
  FROM customer)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = load(spark, sf_dir, "customer"), F.col("c_custkey")
    tier = F.element_at(F.create_map(*[F.lit(x) for pair in _TIERS.items() for x in pair]), F.col("c_mktsegment"))
    part = lambda p, m: F.concat(F.lit(p), k % m)
    return c.select(
        F.concat(F.when(k % 41 == 0, "seed-").otherwise("m-"), k).alias("memory_id"), tier.alias("tier"),
        F.array(F.concat(F.lit("n"), "c_nationkey"), part("k", 13), part("v", 5), part("root:", 3)).alias("tags"), F.array(part("a", 17)).alias("asset_ids"),
        (1 + (k % 9) / 4.0).alias("confidence"), ((k % 6) / 2.0).alias("importance"), (1.0 / (1 + k % 4)).alias("strength"), (k % 10).alias("access_count"),
        F.transform(F.when(k % 4 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), (k % 4 - 1).cast("int"))), lambda i: F.concat(F.lit("l"), i)).alias("links"),
        (k % 23 == 0).alias("quarantined"), k.alias("insertion_order"),
    )


_SIM = """round(0.6 * len(list_intersect(c.t, r.t)) / len(list_distinct(c.t || r.t)) + 0.4 * len(list_intersect(c.asset_ids, r.asset_ids)) / len(list_distinct(c.asset_ids || r.asset_ids)), 4)"""


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_RECORDS}, x AS (SELECT *, tags[1:3] AS t FROM r WHERE NOT quarantined), c AS (SELECT 'c-' || s_suppkey AS memory_id, CASE s_suppkey % 2 WHEN 0 THEN 'episodic' ELSE 'semantic' END AS tier,
      ['n' || s_nationkey, 'k' || (s_suppkey % 13), 'v' || (s_suppkey % 5)] AS t, 'root:' || (s_suppkey % 2) AS root, ['a' || (s_suppkey % 17)] AS asset_ids FROM supplier),
    s AS (SELECT c.memory_id, r.memory_id AS rid, {_SIM} AS s, r.tags[4] <> c.root AS conflict, r.insertion_order AS o, len(list_filter(c.t, lambda v: NOT list_contains(r.t, v))) + len(list_filter(c.asset_ids, lambda v: NOT list_contains(r.asset_ids, v))) AS fresh FROM c JOIN x r ON c.tier = r.tier),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY s DESC, o) AS n FROM s WHERE s > 0) WHERE n = 1),
    d AS (SELECT *, CASE WHEN s < 0.62 THEN 'ADD' WHEN conflict THEN 'SUPERSEDE' WHEN s >= 0.97 AND fresh = 0 THEN 'NOOP' ELSE 'UPDATE' END AS op FROM b)
    SELECT c.memory_id, coalesce(op, 'ADD') AS op, CASE WHEN op <> 'ADD' THEN rid END AS target_id, coalesce(s, 0.0)::DOUBLE AS similarity FROM c LEFT JOIN d USING (memory_id)""",
)
def route_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    part = lambda p, m: F.concat(F.lit(p), k % m)
    candidates = s.select(
        F.concat(F.lit("c-"), k).alias("memory_id"), F.when(k % 2 == 0, "episodic").otherwise("semantic").alias("tier"),
        F.array(F.concat(F.lit("n"), "s_nationkey"), part("k", 13), part("v", 5), part("root:", 2)).alias("tags"), F.array(part("a", 17)).alias("asset_ids"),
    )
    return memory.route(_records(spark, sf_dir), candidates)


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_RECORDS}, m AS (SELECT asset_ids[1] AS family, * FROM r WHERE NOT quarantined AND tier = 'episodic')
    SELECT 'insight-' || family AS memory_id, family, count(*) AS members, round(sum(importance + confidence), 6)::DOUBLE AS salience, round(1.0 + 0.2 * count(*), 6)::DOUBLE AS confidence,
           string_agg(DISTINCT tags[4][6:], ',' ORDER BY tags[4][6:]) AS roots FROM m GROUP BY family HAVING count(*) >= 2 AND sum(importance + confidence) >= 3""",
)
def reflect_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.reflect(_records(spark, sf_dir))


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_RECORDS}, p AS (SELECT *, NOT quarantined AND NOT regexp_matches(memory_id, '^(seed|asset|insight)') AS mortal FROM r)
    SELECT memory_id, round(CASE WHEN mortal THEN strength * 0.55 ELSE strength END, 6)::DOUBLE AS strength, quarantined OR (mortal AND strength * 0.55 < 0.4) AS quarantined FROM p""",
)
def decay_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.decay(_records(spark, sf_dir)).select("memory_id", F.round("strength", 6).alias("strength"), "quarantined")


_UTILITY = f"""WITH {_RECORDS}, a AS (SELECT *, len(links) AS l FROM r WHERE NOT quarantined AND NOT regexp_matches(memory_id, '^(seed|asset|insight)')),
u AS (SELECT memory_id, strength, insertion_order, round(0.25 * importance / max(importance) OVER () + 0.25 * access_count / max(access_count) OVER () + 0.25 * strength / max(strength) OVER () + 0.25 * l / max(l) OVER (), 6)::DOUBLE AS utility FROM a)
"""


@register(QUERIES, ORACLE, _UTILITY + "SELECT memory_id, utility FROM u")
def utility_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.utilities(_records(spark, sf_dir)).select("memory_id", "utility")


@register(
    QUERIES,
    ORACLE,
    _UTILITY + ", n AS (SELECT count(*) - 100 AS k FROM r WHERE NOT quarantined) SELECT memory_id, utility FROM (SELECT *, row_number() OVER (ORDER BY utility, strength, insertion_order) AS rn FROM u), n WHERE rn <= k",
)
def utility_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.evict(_records(spark, sf_dir), 100)


@register(QUERIES, ORACLE, f"WITH {_RECORDS} SELECT count(*) FILTER (NOT quarantined) AS active, count(*) FILTER (quarantined) AS forgotten, count(*) FILTER (NOT quarantined AND list_contains(tags, 'insight')) AS insights, sum(CASE WHEN NOT quarantined THEN len(links) ELSE 0 END)::BIGINT AS links FROM r")
def memory_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.health(_records(spark, sf_dir))


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_RECORDS} SELECT memory_id, round(0.30 * least(1, strength) + 0.25 * least(1, len(links) / 5.0) + 0.20 * (1 - 1 / (1 + importance)) + 0.15 * least(1, greatest(0, (confidence - 1) / 2)) +
    0.10 * CASE tier WHEN 'asset_profile' THEN 1.0 WHEN 'semantic' THEN 0.75 WHEN 'procedural' THEN 0.5 ELSE 0.25 END, 6)::DOUBLE AS prior FROM r""",
)
def structural_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = T.structural_prior(F.col("strength"), F.size("links"), F.col("importance"), F.col("confidence"), F.col("tier"))
    return _records(spark, sf_dir).select("memory_id", F.round(prior, 6).alias("prior"))


_RUNS = """e AS (SELECT o_custkey % 50 AS case_id, o_orderkey AS run_id, CASE l_linenumber % 3 WHEN 0 THEN 'diagnosis' WHEN 1 THEN 'verifier' ELSE 'cost' END AS kind, l_returnflag <> 'R' AS ok, l_quantity::DOUBLE AS cost
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT case_id, run_id, round(sum(CASE WHEN kind = 'diagnosis' AND ok THEN 1.0 WHEN kind = 'verifier' AND ok THEN 0.5 WHEN kind = 'cost' THEN -0.02 * cost ELSE 0 END), 6) AS reward FROM e GROUP BY 1, 2)"""


@register(QUERIES, ORACLE, f"WITH {_RUNS} SELECT case_id, run_id, reward::DOUBLE + 0.0 AS reward, round((reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-8), 4)::DOUBLE + 0.0 AS advantage FROM g WINDOW w AS (PARTITION BY case_id)")
def run_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "diagnosis").when(F.col("l_linenumber") % 3 == 1, "verifier").otherwise("cost")
    events = rows.select((F.col("o_custkey") % 50).alias("case_id"), F.col("o_orderkey").alias("run_id"), kind.alias("kind"), (F.col("l_returnflag") != "R").alias("ok"), F.col("l_quantity").cast("double").alias("cost"))
    return memory.rewards(events)


@register(
    QUERIES,
    ORACLE,
    """WITH RECURSIVE s AS (SELECT user_id, (value - 20) / 4 AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT user_id, 0::BIGINT AS n, 1.0::DOUBLE AS c FROM s WHERE n = 1 UNION ALL SELECT f.user_id, s.n, least(3.0, greatest(0.0, f.c + 0.2 * s.d)) FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1)
    SELECT user_id, round(max_by(c, n), 6) AS confidence FROM f GROUP BY 1""",
)
def clamped_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = load(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), ((F.col("value") - 20) / 4).alias("d"))
    return memory.apply_steps(steps, "user_id", "at", "d")


# Graphs: nations tied by the customers that buy from suppliers elsewhere.
_NATIONS = "e AS (SELECT DISTINCT c_nationkey AS src, (c_nationkey * 7 + c_custkey % 3) % 25 AS dst FROM customer)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").cast("long").alias("src"), ((F.col("c_nationkey") * 7 + F.col("c_custkey") % 3) % 25).cast("long").alias("dst")).distinct()


@register(
    QUERIES,
    ORACLE,
    f"""WITH RECURSIVE {_NATIONS}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    b(start, node, distance) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation WHERE n_regionkey = 0 UNION SELECT b.start, u.dst, b.distance + 1 FROM b JOIN u ON b.node = u.src WHERE b.distance < 3)
    SELECT start::BIGINT AS start, node::BIGINT AS node, min(distance)::INT AS distance FROM b GROUP BY 1, 2""",
)
def bfs_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = load(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").cast("long").alias("node"))
    return graph.distances(_edges(spark, sf_dir), starts, 3)


@register(
    QUERIES,
    ORACLE,
    f"""WITH RECURSIVE {_NATIONS}, p(root, tail, path) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, [n_nationkey::BIGINT] FROM nation UNION ALL SELECT root, dst::BIGINT, list_append(path, dst::BIGINT) FROM p JOIN e ON tail = src WHERE NOT list_contains(path, dst::BIGINT) AND len(path) <= 4)
    SELECT root, (len(path) - 1)::INT AS hops, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY len(path) DESC, path) AS r FROM p) WHERE r = 1""",
)
def longest_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    return graph.longest_chains(_edges(spark, sf_dir), roots, 4)


_SHARED = """h AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS n FROM lineitem), u AS (SELECT k FROM h GROUP BY 1 HAVING count(*) BETWEEN 2 AND 12),
s AS (SELECT a.n AS a, b.n AS b, count(*) AS weight FROM h a JOIN h b ON a.k = b.k AND a.n < b.n WHERE a.k IN (SELECT k FROM u) GROUP BY 1, 2)"""


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shared_key_edges(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", 2, 12)


@register(QUERIES, ORACLE, f"WITH {_SHARED} SELECT a, b, weight FROM s")
def shared_order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir)


@register(QUERIES, ORACLE, f"WITH {_SHARED} SELECT node, count(*) AS degree, sum(weight)::BIGINT AS strength FROM (SELECT a AS node, weight FROM s UNION ALL SELECT b, weight FROM s) GROUP BY 1")
def hub_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hubs(_shared(spark, sf_dir))


@register(
    QUERIES,
    ORACLE,
    """WITH t AS (SELECT DISTINCT event_type AS g, user_id AS n, epoch_us(ts) AS t FROM events), h AS (SELECT a.n AS a, b.n AS b, count(DISTINCT a.t) AS hits FROM t a JOIN t b ON a.g = b.g AND a.n < b.n AND abs(a.t - b.t) <= 300000000 GROUP BY 1, 2),
    m AS (SELECT n, count(DISTINCT t) AS m FROM t GROUP BY 1)
    SELECT a, b, hits, round(hits / least(x.m, y.m), 4) AS ratio FROM h JOIN m x ON x.n = a JOIN m y ON y.n = b WHERE hits >= 2 AND round(hits / least(x.m, y.m), 4) >= 0.02""",
)
def lockstep_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lockstep(load(spark, sf_dir, "events"), "user_id", "ts", 300, 2, 0.02, "event_type")


@register(QUERIES, ORACLE)
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of suppliers inside one of two halves of the nations."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey"), (F.col("s_nationkey") % 2).alias("s_half"))
    pairs = _shared(spark, sf_dir).join(s.select(F.col("s_suppkey").alias("a"), F.col("s_half").alias("g")), "a").join(s.select(F.col("s_suppkey").alias("b"), F.col("s_half").alias("h")), "b")
    return graph.label_propagation(pairs.where("g = h").select("g", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "weight"), "g")


@register(
    QUERIES,
    ORACLE,
    """WITH n AS (SELECT conv_id, turn, ceil(length(text) / 4.0)::BIGINT AS need, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS o FROM conversations),
    c AS (SELECT *, sum(need) OVER (PARTITION BY conv_id ORDER BY o) AS used FROM n)
    SELECT conv_id, turn, need, used::BIGINT AS used FROM c WHERE used <= 200""",
)
def pack_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.ceil(F.length("text") / 4.0).alias("need"))
    return pack.prefix(turns, "conv_id", "turn", "need", 200).select("conv_id", "turn", "need", "used")


@register(
    QUERIES,
    ORACLE,
    """WITH w AS (SELECT conv_id, turn, length(text) AS w FROM conversations), s AS (SELECT *, 1000.0 * w / sum(w) OVER (PARTITION BY conv_id) AS exact FROM w),
    f AS (SELECT *, floor(exact)::BIGINT AS base, row_number() OVER (PARTITION BY conv_id ORDER BY exact - floor(exact) DESC, turn) AS r, 1000 - sum(floor(exact)) OVER (PARTITION BY conv_id) AS rest FROM s WHERE w > 0)
    SELECT conv_id, turn, base + (r <= rest)::BIGINT AS budget FROM f""",
)
def budget_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("w")).where("w > 0")
    return pack.largest_remainder(turns, "conv_id", "turn", "w", 1000)
