"""An evolving store, nested values, explained ways, contracts and coded search over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators import contracts, graph, knowledge, nested
from skein.plans.base import Query, load, once, register, spread
from skein.plans.knowledge import vector_approximate
from skein.plans.retrieval import vector_flat
from skein.streaming import evolve

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def order_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate an order, in the order of dates; a pass is a year, an asset one of 97 groups of customers."""
    o, c, k = load(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderkey")
    tier = F.when(F.col("o_orderstatus") == "F", "episodic").when(F.col("o_orderstatus") == "O", "semantic").otherwise("procedural")
    day = F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long")
    tags = F.array(F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)), F.concat(F.lit("k"), c % 5), F.concat(F.lit("root:"), k % 3))
    return o.select(
        tier.alias("tier"), F.concat(F.lit("a"), c % 97).alias("store"), (day * 100_000_000_000 + k).alias("seq"), F.year("o_orderdate").cast("long").alias("pass_no"), F.concat(F.lit("o-"), k).alias("memory_id"),
        tags.alias("tags"), F.array(F.concat(F.lit("a"), c % 97)).alias("asset_ids"), F.lit(1.0).alias("confidence"), (k % 4).cast("double").alias("importance"),
    )


@register(QUERIES, ORACLE)
def evolving_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifecycle of all orders as candidates; tests hold it against a loop."""
    ops = evolve.evolve(order_candidates(spark, sf_dir), budget=40)
    return ops.select(
        "tier", "store", "seq", "step", "op", "memory_id", "target_id", "similarity", F.round("before.strength", 6).alias("strength_before"), F.round("after.strength", 6).alias("strength_after"),
        F.round("after.confidence", 6).alias("confidence"), F.concat_ws(",", "added_tags").alias("added_tags"),
    )


_LINES = """l AS (SELECT l_orderkey AS k, string_agg('part ' || l_partkey || ' qty ' || l_quantity::BIGINT, ' ' ORDER BY l_partkey, l_quantity) AS said, string_agg('"[depth-limited]"', ',') AS cut FROM lineitem GROUP BY 1)"""


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, entity, attrs): each customer with its orders and their lines as nested JSON."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("qty")))).alias("lines"))  # an order's lines
    orders = load(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    listed = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), "lines", F.col("o_orderstatus").alias("status")))).alias("orders"))  # a customer's orders
    c = load(spark, sf_dir, "customer").join(listed, F.col("c_custkey") == F.col("o_custkey"))
    value = F.struct(F.col("c_mktsegment").alias("segment"), F.struct(F.concat(F.lit("k-"), "c_custkey").alias("api_key"), F.col("c_name").alias("name")).alias("login"), "orders")
    return c.select(F.col("c_custkey").alias("record_id"), F.concat(F.lit(" Nation-"), "c_nationkey").alias("entity"), F.to_json(value).alias("attrs"))


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_LINES}, o AS (SELECT o_custkey AS c, string_agg('key ' || o_orderkey || ' lines ' || said || ' status ' || o_orderstatus, ' ' ORDER BY o_orderkey) AS said FROM orders JOIN l ON k = o_orderkey GROUP BY 1)
    SELECT c_custkey AS record_id, 'login api_key k-' || c_custkey || ' name ' || c_name || ' orders ' || said || ' segment ' || c_mktsegment AS text FROM customer JOIN o ON c = c_custkey""",
)
def nested_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.text(_accounts(spark, sf_dir), "attrs", "record_id")


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_LINES}, o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders JOIN l ON k = o_orderkey),
    s AS (SELECT o_custkey AS c, any_value(n) AS n, string_agg('{{"key":' || o_orderkey || ',"lines":[' || cut || '],"status":"' || o_orderstatus || '"}}', ',' ORDER BY o_orderkey) FILTER (r <= 5) AS said FROM
      (SELECT * REPLACE (CASE WHEN len(string_split(cut, ',')) > 5 THEN '"[depth-limited]","[depth-limited]","[depth-limited]","[depth-limited]","[depth-limited]","[truncated ' || (len(string_split(cut, ',')) - 5) || ' items]"' ELSE cut END AS cut) FROM o) GROUP BY 1)
    SELECT c_custkey AS record_id, '{{"login":{{"api_key":"[redacted]","name":"' || c_name[1:12] || '…[truncated 6 chars]"}},"orders":[' || said || CASE WHEN n > 5 THEN ',"[truncated ' || (n - 5) || ' items]"' ELSE '' END || '],"segment":"' || c_mktsegment || '"}}' AS summary
    FROM customer JOIN s ON c = c_custkey""",
)
def nested_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.summaries(_accounts(spark, sf_dir), "attrs", "record_id", max_depth=4, max_items=5, max_string=12)


@register(
    QUERIES,
    ORACLE,
    """WITH h AS (SELECT DISTINCT p_partkey AS query_id, o_custkey AS record_id FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE p_partkey > 50),
    x AS (SELECT DISTINCT o_custkey AS c, v FROM (SELECT o_custkey, o_orderkey AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT o_custkey, l_quantity::BIGINT FROM orders JOIN lineitem ON l_orderkey = o_orderkey) JOIN customer ON c_custkey = o_custkey),
    f AS (SELECT * FROM h UNION SELECT p_partkey, c FROM part JOIN x ON v = p_partkey WHERE p_partkey > 50),
    d AS (SELECT -1 - n_nationkey AS query_id, c_custkey AS record_id FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey))
    SELECT query_id::BIGINT AS query_id, record_id, 'attribute' AS via FROM f UNION ALL SELECT query_id, record_id, 'direct' FROM d""",
)
def nested_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation and every part numbered above 50 is looked up in the customers' records."""
    nations = load(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("query_id"), F.concat(F.lit("NATION-"), "n_nationkey").alias("entity"))
    parts = load(spark, sf_dir, "part").where("p_partkey > 50").select(F.col("p_partkey").alias("query_id"), F.col("p_partkey").cast("string").alias("entity"))
    return nested.entity_records(_accounts(spark, sf_dir), nations.unionAll(parts))


_HOPS = """e AS (SELECT l_suppkey AS src, -1 - l_partkey AS dst, l_returnflag AS relation, bool_or(l_linenumber = 1) AS verified FROM lineitem GROUP BY 1, 2, 3),
u AS (SELECT src, dst, relation, verified, true AS forward FROM e UNION ALL SELECT dst, src, relation, verified, false FROM e),
d0 AS (SELECT s_suppkey AS start, s_suppkey AS node, 0 AS distance, NULL::BIGINT AS parent, NULL::VARCHAR AS relation, NULL::BOOLEAN AS forward, true AS verified FROM supplier WHERE s_suppkey % 20 = 0)"""
for _d in (1, 2):
    _seen = " UNION ALL ".join(f"SELECT start, node FROM d{i}" for i in range(_d))
    _HOPS += f""", d{_d} AS (SELECT start, node, {_d} AS distance, parent, relation, forward, verified FROM (
      SELECT f.start, u.dst AS node, f.node AS parent, u.relation, u.forward, u.verified, row_number() OVER (PARTITION BY f.start, u.dst ORDER BY f.node, u.verified DESC, u.relation, u.forward DESC) AS r
      FROM d{_d - 1} f JOIN u ON u.src = f.node ANTI JOIN ({_seen}) s ON s.start = f.start AND s.node = u.dst) WHERE r = 1)"""
_HOPS += ", d AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2)"


def _trades(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and the parts (negative) they ship, each flag a relation; every twentieth supplier asks."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst"), F.col("l_returnflag").alias("relation"), (F.col("l_linenumber") == 1).alias("v"))
    starts = load(spark, sf_dir, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("node"))
    return rows.withColumnRenamed("v", "verified"), starts


@register(QUERIES, ORACLE, f"WITH {_HOPS} SELECT start, node, distance::INT AS distance, parent, relation, forward, verified FROM d")
def explained_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.explained_distances(*_trades(spark, sf_dir), 2)


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_HOPS} SELECT b.start, b.node, 2::INT AS distance, b.start || '>' || b.parent || '>' || b.node AS path, a.relation || ',' || b.relation AS relations, a.verified AND b.verified AS verified
    FROM d2 b JOIN d1 a ON a.start = b.start AND a.node = b.parent""",
)
def explained_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = graph.explained_distances(*_trades(spark, sf_dir), 2)
    ways = graph.explained_paths(reached, F.col("distance") == 2, 2)
    return ways.select("start", "node", "distance", F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"), F.concat_ws(",", "relations").alias("relations"), "verified")


_WALK = """r AS (SELECT c_custkey AS id, 'a' || c_nationkey AS asset, c_custkey % 29 = 0 AS gone, 1.0 / (1 + c_custkey % 3) AS strength, (c_custkey % 5)::DOUBLE AS importance, 1 + c_custkey % 3 * 0.5 AS confidence, c_custkey % 4 AS t FROM customer),
v AS (SELECT * FROM r WHERE NOT gone), q AS (SELECT n_nationkey AS query_id, 'a' || n_nationkey AS asset FROM nation),
l AS (SELECT a.id, b.id AS dst FROM v a JOIN v b ON b.id IN (a.id * 7 + 1, a.id * 3 + 2)),
s0 AS (SELECT query_id, id, 2.0 AS score, 0 AS hop, NULL::BIGINT AS parent FROM v JOIN q USING (asset))"""
for _d in (1, 2):
    _front = "s0" if _d == 1 else "f1"
    _WALK += f""", f{_d} AS (SELECT p.query_id, p.dst AS id, p.score, {_d} AS hop, p.parent FROM (
        SELECT query_id, dst, b.score * 0.35 AS score, b.id AS parent, row_number() OVER (PARTITION BY query_id, dst ORDER BY b.score DESC, b.id) AS n FROM
          (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR) AS r FROM {_front}) b JOIN l ON l.id = b.id WHERE b.r <= 48) p
      LEFT JOIN s{_d - 1} k ON k.query_id = p.query_id AND k.id = p.dst WHERE p.n = 1 AND p.score > coalesce(k.score, 0)),
    s{_d} AS (SELECT query_id, id, max(score) AS score, min(hop) AS hop, max_by(coalesce(parent, -1), score) AS parent FROM (SELECT * FROM s{_d - 1} UNION ALL SELECT * FROM f{_d}) GROUP BY 1, 2)"""


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_WALK.replace("ORDER BY b.score DESC, b.id)", "ORDER BY b.score DESC, b.id::VARCHAR)")}, n AS (SELECT id, count(*) AS links FROM (SELECT a.id, unnest([a.id * 7 + 1, a.id * 3 + 2]) FROM r a) GROUP BY 1),
    p AS (SELECT id, t, 0.30 * least(1, strength) + 0.25 * least(1, links / 5.0) + 0.20 * (1 - 1 / (1 + importance)) + 0.15 * greatest(0, least(1, (confidence - 1) / 2.0)) + 0.10 * [0.25, 0.75, 0.5, 1.0][t + 1] AS prior FROM v JOIN n USING (id))
    SELECT query_id::BIGINT AS query_id, id::VARCHAR AS memory_id, ['episodic', 'semantic', 'procedural', 'asset_profile'][t + 1] AS tier, CASE WHEN hop = 0 THEN 2.0 END::DOUBLE AS assets, round(score, 6)::DOUBLE AS base, hop::INT AS hop,
      CASE WHEN parent >= 0 THEN parent::VARCHAR END AS parent, round(prior, 6)::DOUBLE AS prior, round(score + 0.15 * max(score) OVER (PARTITION BY query_id) * prior, 5)::DOUBLE AS final FROM s2 JOIN p USING (id)""",
)
def walked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records of four tiers, their nation as asset, linked to two others; every nation asks."""
    c, k = load(spark, sf_dir, "customer"), F.col("c_custkey")
    tier = F.element_at(F.array(*map(F.lit, ("episodic", "semantic", "procedural", "asset_profile"))), (k % 4 + 1).cast("int"))
    no_words = F.array().cast("array<string>")
    records = c.select(
        k.cast("string").alias("memory_id"), tier.alias("tier"), no_words.alias("tokens"), F.array(F.concat(F.lit("a"), "c_nationkey")).alias("asset_ids"), F.array((k * 7 + 1).cast("string"), (k * 3 + 2).cast("string")).alias("links"),
        (1.0 / (1 + k % 3)).alias("strength"), (k % 5).cast("double").alias("importance"), (1 + k % 3 * 0.5).alias("confidence"), (k % 29 == 0).alias("quarantined"), k.alias("insertion_order"),
    )
    asked = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), no_words.alias("tokens"), F.array(F.concat(F.lit("a"), "n_nationkey")).alias("assets"))
    told = knowledge.tiered_candidates(records, asked)
    return told.select("query_id", "memory_id", "tier", "assets", F.round("base", 6).alias("base"), "hop", "parent", F.round("prior", 6).alias("prior"), F.round("final", 5).alias("final"))


_RULES = [
    ("ship", "pre", "r1", "before", "$.state.status", "ne", "P", None, "order is pending"),
    ("ship", "pre", "r2", "args", "$.priority", "in", "1|2|3", None, "priority too low"),
    ("ship", "post", "r3", "after", "$.total", "ge", "$.total", "before", "total fell"),
    ("ship", "invariant", "r4", "", "$.total", "lt", "400000", None, "total out of bounds"),
    ("ship", "readback", "r5", "", "", "", None, None, ""),
    ("bill", "post", "r6", "result", "$.paid", "exists", None, None, "not paid"),
]


@register(
    QUERIES,
    ORACLE,
    """WITH s AS (SELECT o_orderkey AS k, o_orderkey % 3 AS m, o_orderstatus AS st, floor(o_totalprice)::BIGINT AS t, floor(o_totalprice)::BIGINT + (o_orderkey % 7 - 1) * 1000 AS u, left(o_orderpriority, 1) AS p, o_custkey % 11 = 0 AS odd, o_custkey % 5 AS w FROM orders),
    v AS (SELECT *, CASE WHEN m < 2 THEN list_filter([CASE WHEN st = 'P' THEN 'order is pending' END, CASE WHEN p NOT IN ('1', '2', '3') THEN 'priority too low' END], lambda x: x IS NOT NULL) ELSE [] END AS pre,
      CASE WHEN m < 2 AND u < t THEN ['total fell'] WHEN m = 2 AND w = 0 THEN ['not paid'] ELSE [] END AS post,
      CASE WHEN m < 2 THEN list_filter([CASE WHEN t >= 400000 THEN 'before: total out of bounds' END, CASE WHEN u >= 400000 THEN 'after: total out of bounds' END], lambda x: x IS NOT NULL) ELSE [] END AS inv,
      CASE WHEN m < 2 AND w = 1 THEN ['claimed but not landed: intended effect absent from observed state'] ELSE [] END AS rb FROM s),
    j AS (SELECT *, pre || post || inv || rb AS b, CASE WHEN len(pre || post || inv || rb) > 0 THEN 0.0 WHEN odd THEN 0.25 ELSE 1.0 END AS score FROM v)
    SELECT k AS step_id, score >= 0.5 AS passed, score::DOUBLE AS score, len(pre)::BIGINT AS pre, len(post)::BIGINT AS post, len(inv)::BIGINT AS invariants, len(rb)::BIGINT AS readback,
      array_to_string(CASE WHEN score < 0.5 THEN list_append(b, 'step judge score below threshold: ' || CASE WHEN score = 0 THEN '0.0000' ELSE '0.2500' END) ELSE b END, '; ') AS violations FROM j""",
)
def step_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as steps: two thirds ship, which is read back, the others bill; rules come from a table."""
    o, k = spread(load(spark, sf_dir, "orders")), F.col("o_orderkey")
    total, w = F.floor("o_totalprice"), F.col("o_custkey") % 5
    ship = k % 3 < 2
    state = lambda t: F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.lit(9).alias("n")).alias("state"), t.alias("total"))
    meant = F.when(w == 1, F.lit('{"state":{"status":"Z"}}')).otherwise(F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("status")).alias("state"))))
    name = F.when(ship, "ship").otherwise("bill")
    steps = o.select(
        k.alias("step_id"), name.alias("skill"), F.when(F.col("o_custkey") % 11 == 0, "other").otherwise(name).alias("result_skill"), F.to_json(state(total)).alias("before"), F.to_json(state(total + (k % 7 - 1) * 1000)).alias("after"),
        F.to_json(F.struct(F.substring("o_orderpriority", 1, 1).alias("priority"))).alias("args"), F.when(w == 0, "{}").otherwise('{"paid":true}').alias("result"), F.when(ship, meant).alias("intended"),
    )
    rules = spark.createDataFrame(_RULES, "skill string, phase string, rule string, side string, path string, op string, operand string, other string, message string")
    told = contracts.check_steps(steps, rules)
    return told.withColumn("violations", F.array_join("violations", "; "))


@register(QUERIES, ORACLE, "SELECT count(*) AS queries, 10 * count(*) AS wanted, true AS recall_held, true AS few_scored FROM embeddings WHERE vec_id % 20 = 0")
def vector_recall_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether coded search finds nine tenths of the exact first ten, scoring a tenth of the rows exactly where these are 2,000 or more."""
    exact, found = once(vector_flat(spark, sf_dir)), once(vector_approximate(spark, sf_dir))
    recall = knowledge.recall_against(found, exact)
    sizes = exact.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"))
    rows = load(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("rows"))
    few = (F.lit(200) * 10 <= F.col("rows")) | (F.col("rows") < 2000)
    return sizes.join(recall).join(rows).select("queries", "wanted", (F.col("recall") >= 0.9).alias("recall_held"), few.alias("few_scored"))  # one row each


_LABELS = """e AS (SELECT o_custkey % 500 AS a, 1000 + l_suppkey AS b, count(*) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2), u AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e), l0 AS (SELECT DISTINCT a, a AS l FROM u)"""
for _d in range(1, 5):
    _LABELS += f""", l{_d} AS (SELECT a, l FROM (SELECT a, l, row_number() OVER (PARTITION BY a ORDER BY sum(w) DESC, l) AS r FROM (SELECT u.a, k.l, u.w FROM u JOIN l{_d - 1} k ON k.a = u.b UNION ALL SELECT a, l, 3 FROM l{_d - 1}) GROUP BY a, l) WHERE r = 1)"""


@register(QUERIES, ORACLE, f"WITH {_LABELS} SELECT a AS node, l AS label FROM l4")
def synchronous_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of customers (in 500 groups) and suppliers by what is ordered, after four rounds."""
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    edges = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy((F.col("o_custkey") % 500).alias("a"), (1000 + F.col("l_suppkey")).alias("b")).agg(F.count(F.lit(1)).alias("weight"))
    return graph.synchronous_labels(edges, rounds=4, stay=3.0)


@register(
    QUERIES,
    ORACLE,
    """WITH o AS (SELECT *, row_number() OVER w - 1 AS i, lead(o_orderkey) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    c AS (SELECT o_custkey AS c, count(*) AS n, string_agg(o_orderkey::VARCHAR, '>' ORDER BY i) AS path, min_by(o_orderkey, i) FILTER (o_orderpriority = '1-URGENT' OR o_orderkey % 9 = 0) AS early, max_by(o_orderpriority, i) AS last, count(DISTINCT o_orderkey % 4) AS assets,
      string_agg(CASE WHEN o_orderkey % 2 = 0 THEN 'causes' ELSE 'precedes' END, ',' ORDER BY i) FILTER (nxt IS NOT NULL) AS relations, coalesce(bool_and(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 10 <> 4 ELSE true END) FILTER (nxt IS NOT NULL), true) AS verified FROM o GROUP BY 1)
    SELECT c AS chain_id, path, coalesce(relations, '') AS relations, assets::INT AS assets, early AS early_change, early IS NOT NULL AND assets >= 2 AND last = '5-LOW' AS hidden_failure, verified FROM c""",
)
def explained_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in time as a chain; even orders cause the next one with evidence, mostly, odd ones precede it."""
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = o.select("o_custkey", k, F.row_number().over(order).alias("i"), F.lead(k).over(order).alias("nxt"))
    chains = rows.groupBy(F.col("o_custkey").alias("chain_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("path"))  # a customer's orders
    even = k % 2 == 0
    proof = F.when(even & (k % 10 != 4), F.array(F.concat(F.lit("e"), k))).otherwise(F.array().cast("array<string>"))
    edges = rows.where("nxt IS NOT NULL").select(k.alias("src"), F.col("nxt").alias("dst"), F.when(even, "causes").otherwise("precedes").alias("relation"), (~even).alias("temporal"), proof.alias("evidence"))
    records = o.select(k.alias("memory_id"), F.array(F.concat(F.lit("a"), k % 4)).alias("asset_ids"), F.col("o_orderpriority").alias("event_type"), F.col("o_orderdate").alias("observed_at"), (k % 9 == 0).alias("changed"))
    told = graph.explained_chains(chains, edges, records, ["1-URGENT"], ["5-LOW"])
    return told.select("chain_id", F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"), F.concat_ws(",", "relations").alias("relations"), F.size("assets").alias("assets"), "early_change", "hidden_failure", "verified")
