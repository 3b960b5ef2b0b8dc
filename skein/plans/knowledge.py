"""Queries over records, claims, votes and snapshots made from the driver's tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import ann, knowledge, retrieval
from skein.plans.base import Query, load, register, spread
from skein.plans.retrieval import vector_flat

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return v, v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")


@register(QUERIES, ORACLE)
def vector_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(*_vectors(spark, sf_dir))


@register(QUERIES, ORACLE)
def vector_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.recall_against(vector_approximate(spark, sf_dir), vector_flat(spark, sf_dir))


_VOTES = "v AS (SELECT l_orderkey AS claim_id, CASE l_returnflag WHEN 'A' THEN 'supported' WHEN 'R' THEN 'unsupported' ELSE 'insufficient' END AS label FROM lineitem)"


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_VOTES}, c AS (SELECT claim_id, label, count(*) AS n FROM v GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY n DESC, label) AS r, max(n) OVER w AS m, sum(n) OVER w AS t FROM c WINDOW w AS (PARTITION BY claim_id)),
    b AS (SELECT claim_id, max(label) FILTER (r = 1) AS label, any_value(m / t) AS share, count(*) FILTER (n = m) AS ties FROM m GROUP BY 1)
    SELECT claim_id, CASE WHEN share < 0.6 OR ties > 1 THEN 'insufficient' ELSE label END AS verdict, round(share, 6)::DOUBLE AS agreement, share < 0.6 OR ties > 1 AS disputed FROM b""",
)
def vote_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    label = F.when(flag == "A", "supported").when(flag == "R", "unsupported").otherwise("insufficient")
    return knowledge.consensus(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), label.alias("label")))


@register(
    QUERIES,
    ORACLE,
    """WITH c AS (SELECT o_orderkey AS claim_id, o_custkey AS case_id, o_orderpriority[1] AS cause FROM orders), d AS (SELECT DISTINCT o_orderkey AS claim_id, l_suppkey % 50 AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    k AS (SELECT DISTINCT o_custkey AS case_id, l_suppkey % 50 AS e, (l_partkey % 9)::VARCHAR AS against FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <> 3),
    x AS (SELECT d.claim_id, d.e, EXISTS (SELECT 1 FROM k WHERE k.case_id = c.case_id AND k.e = d.e) AS known, EXISTS (SELECT 1 FROM k WHERE k.case_id = c.case_id AND k.e = d.e AND k.against = c.cause) AS contrary FROM d JOIN c USING (claim_id))
    SELECT c.claim_id, count(x.e) AS cited, count(*) FILTER (x.e IS NOT NULL AND NOT known) AS unknown, count(*) FILTER (contrary) AS contrary, count(x.e) > 0 AND count(*) FILTER (x.e IS NOT NULL AND NOT known) = 0 AND count(*) FILTER (contrary) = 0 AS passed
    FROM c LEFT JOIN x USING (claim_id) GROUP BY 1""",
)
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    cited = li.groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.collect_set(F.col("l_suppkey") % 50).alias("cited"))
    claims = o.select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("case_id"), F.substring("o_orderpriority", 1, 1).alias("cause")).join(cited, "claim_id", "left")
    seen = li.where("l_linenumber <> 3").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    evidence = seen.select(F.col("o_custkey").alias("case_id"), (F.col("l_suppkey") % 50).alias("evidence_id"), (F.col("l_partkey") % 9).cast("string").alias("contradicts"))
    return knowledge.verify(claims, evidence)


@register(
    QUERIES,
    ORACLE,
    """WITH a AS (SELECT user_id, event_id, value AS age FROM events), h AS (SELECT user_id, list_sort(list(age))[len(list(age)) // 2 + 1] AS h FROM a GROUP BY 1)
    SELECT user_id, event_id, age, round(pow(0.5, age / CASE WHEN h > 1e-6 THEN h ELSE 1 END), 6) AS strength FROM a JOIN h USING (user_id)""",
)
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.half_life(load(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("age")), "user_id", "age")


@register(
    QUERIES,
    ORACLE,
    """WITH b AS (SELECT user_id, sum(value) AS v FROM events WHERE event_id % 3 <> 0 AND user_id % 5 <> 0 GROUP BY 1), n AS (SELECT user_id, sum(value) AS v FROM events WHERE user_id % 4 <> 0 OR event_id % 2 = 0 GROUP BY 1)
    SELECT user_id, round(CASE WHEN b.v IS NULL THEN 0 ELSE greatest(0, n.v - b.v) END * 8 / 60, 4)::DOUBLE AS bps FROM n LEFT JOIN b USING (user_id)""",
)
def snapshot_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    before = e.where("event_id % 3 <> 0 AND user_id % 5 <> 0").groupBy("user_id").agg(F.sum("value").alias("v"))
    now = e.where("user_id % 4 <> 0 OR event_id % 2 = 0").groupBy("user_id").agg(F.sum("value").alias("v"))
    return knowledge.rates(before, now, ["user_id"], "v", 60).select("user_id", F.round("bps", 4).alias("bps"))


@register(
    QUERIES,
    ORACLE,
    """WITH s AS (SELECT p_partkey AS skill_id, p_size AS cost, p_partkey % 12 AS good, p_partkey % 5 AS bad, p_partkey % 4 AS hits, p_partkey % 31 = 0 AS preferred FROM part),
    x AS (SELECT *, round(hits + CASE WHEN preferred THEN 5 ELSE 0 END + CASE WHEN good + bad > 0 THEN good / (good + bad) ELSE 0.5 END - 2 * CASE WHEN good + bad > 0 THEN bad / (good + bad) ELSE 0 END - 0.05 * cost, 6) AS score FROM s WHERE hits > 0 OR preferred)
    SELECT skill_id, score FROM x ORDER BY score DESC, skill_id LIMIT 25""",
)
def skill_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    skills = load(spark, sf_dir, "part").select(k.alias("skill_id"), F.col("p_size").alias("cost"), (k % 12).alias("good"), (k % 5).alias("bad"), (k % 4).alias("hits"), (k % 31 == 0).alias("preferred"))
    score = F.round(knowledge.skill_score(F.col("hits"), F.col("preferred"), F.col("good"), F.col("bad"), F.col("cost")), 6)
    return skills.where("hits > 0 OR preferred").select("skill_id", score.alias("score")).orderBy(F.desc("score"), "skill_id").limit(25)


@register(
    QUERIES,
    ORACLE,
    """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, label, round(list_inner_product(e::DOUBLE[], embedding::DOUBLE[]), 5) AS score FROM q, embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s), f AS (SELECT query_id, label AS section, min(rank) AS m FROM r WHERE rank <= 10 GROUP BY 1, 2)
    SELECT query_id, section, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m, section) AS rank FROM f) WHERE rank <= 5""",
)
def section_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("section"))
    return knowledge.collapse(vector_flat(spark, sf_dir), sections, 5)


@register(QUERIES, ORACLE)
def tiered_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of four tiers, their source as asset, linked to the next two; benchmark items ask."""
    from skein.functions.text import tokens

    i = F.col("doc_id")
    tier = F.element_at(F.array(*map(F.lit, ("episodic", "semantic", "procedural", "asset_profile"))), (i % 4 + 1).cast("int"))
    records = spread(load(spark, sf_dir, "documents")).select(
        i.cast("string").alias("memory_id"), tier.alias("tier"), tokens(F.col("text")).alias("tokens"), F.array("source").alias("asset_ids"), F.array((i + 1).cast("string"), (i + 2).cast("string")).alias("links"),
        (1.0 / (1 + i % 3)).alias("strength"), (i % 5).cast("double").alias("importance"), (1 + i % 3 * 0.5).alias("confidence"), (i % 29 == 0).alias("quarantined"), i.alias("insertion_order"),
    )
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("tokens"), F.array(F.concat(F.lit("src"), F.col("item_id") % 20)).alias("assets"))
    return knowledge.tiered(records, asked)


_PATHS = """e AS (SELECT DISTINCT c_nationkey AS src, (c_nationkey * 7 + c_custkey % 3) % 25 AS dst FROM customer), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
b(start, node, distance) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT b.start, u.dst, b.distance + 1 FROM b JOIN u ON b.node = u.src WHERE b.distance < 2),
d AS (SELECT start, node, min(distance) AS distance FROM b GROUP BY 1, 2)"""


@register(
    QUERIES,
    ORACLE,
    f"""WITH RECURSIVE {_PATHS}, r AS (SELECT s_suppkey AS record_id, s_nationkey AS entity, s_suppkey % 4 AS n FROM supplier),
    s AS (SELECT start::BIGINT AS query_id, record_id, distance::INT AS distance, round(CASE WHEN distance = 0 THEN 3.0 ELSE 0 END + greatest(0, 2.0 - 0.5 * distance) + least(3, n) * 0.1, 6)::DOUBLE AS score FROM d JOIN r ON r.entity = d.node WHERE n > 0)
    SELECT query_id, record_id, score, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, record_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5""",
)
def entity_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.plans.lifecycle import _edges

    n = (F.col("s_suppkey") % 4).cast("int")
    evidence = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), n))
    records = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record_id"), F.col("s_nationkey").cast("long").alias("entity"), evidence.alias("evidence"))
    asked = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_nationkey").cast("long").alias("entity"))
    return knowledge.entity_paths(records, _edges(spark, sf_dir), asked, 5, {"exact": 3.0, "base": 2.0, "per_hop": 0.5, "per_evidence": 0.1, "most_evidence": 3.0}, depth=2)


@register(
    QUERIES,
    ORACLE,
    f"""WITH RECURSIVE {_PATHS}, r AS (SELECT s_suppkey AS record_id, s_nationkey AS entity, s_suppkey % 4 AS n, (s_nationkey + s_suppkey) % 25 AS target FROM supplier),
    w AS (SELECT start, record_id, distance FROM d JOIN r ON r.entity = d.node UNION ALL SELECT start, record_id, distance + 1 FROM d JOIN r ON r.target = d.node), m AS (SELECT start, record_id, min(distance) AS distance FROM w GROUP BY 1, 2),
    s AS (SELECT start::BIGINT AS query_id, record_id, distance::INT AS distance, round(CASE WHEN distance = 0 THEN 3.0 ELSE 0 END + greatest(0, 2.0 - 0.5 * distance) + least(3, n) * 0.1, 6)::DOUBLE AS score FROM m JOIN r USING (record_id) WHERE n > 0)
    SELECT query_id, record_id, score, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, record_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5""",
)
def related_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.plans.lifecycle import _edges

    n = (F.col("s_suppkey") % 4).cast("int")
    evidence = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), n))
    held = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record_id"), F.col("s_nationkey").cast("long").alias("entity"), evidence.alias("evidence"))
    relations = held.select("record_id", ((F.col("entity") + F.col("record_id")) % 25).alias("target"))
    asked = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_nationkey").cast("long").alias("entity"))
    weights = {"exact": 3.0, "base": 2.0, "per_hop": 0.5, "per_evidence": 0.1, "most_evidence": 3.0}
    return knowledge.entity_paths(held, _edges(spark, sf_dir), asked, 5, weights, depth=2, relations=relations)
