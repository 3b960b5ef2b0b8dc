"""Exposed services, what to do about them, and similar specifications over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import exposure
from skein.plans.base import Query, load, register

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_PORTS = (22, 21, 443, 3306, 6379, 23, 8443, 80, 8080, 5432)
_ASPECTS = """s AS (SELECT DISTINCT o_custkey % 350 AS h, [22, 21, 443, 3306, 6379, 23, 8443, 80, 8080, 5432][o_orderkey % 10 + 1] AS port FROM orders),
g AS (SELECT h, '10.0.' || (h % 7) || '.' || (h % 50) AS ip, array_agg(port ORDER BY port) AS ports FROM s GROUP BY 1),
a AS (
  SELECT h, ip, 'exposed_db' AS aspect, CASE WHEN list_contains(ports, 6379) THEN 8.0 ELSE 7.5 END AS severity, 'public_database_exposure' AS risk, CASE WHEN list_contains(ports, 3306) THEN 3306 WHEN list_contains(ports, 5432) THEN 5432 ELSE 6379 END AS port,
    list_filter(ports, lambda p: p IN (3306, 5432, 6379)) AS ps, NULL AS detail FROM g WHERE list_has_any(ports, [3306, 5432, 6379])
  UNION ALL SELECT h, ip, 'exposed_admin', CASE WHEN list_contains(ports, 23) THEN 8.5 ELSE 7.0 END, 'internet_exposed_admin', CASE WHEN list_contains(ports, 23) THEN 23 ELSE 8443 END, list_filter(ports, lambda p: p IN (23, 8443)), NULL FROM g WHERE list_has_any(ports, [23, 8443])
  UNION ALL SELECT h, ip, 'weak_tls', 5.5, 'weak_tls_exposed', 443, [443], CASE WHEN h % 4 = 0 THEN 'TLSv1' ELSE 'TLSv1.3' END FROM g WHERE list_contains(ports, 443) AND (h % 4 = 0 OR 2015 + h % 10 <= 2022)
  UNION ALL SELECT h, ip, 'info', 4.5, 'informational_exposure', CASE WHEN list_contains(ports, 21) AND h % 3 = 0 THEN 21 ELSE 22 END, [CASE WHEN list_contains(ports, 21) AND h % 3 = 0 THEN 21 ELSE 22 END],
    CASE WHEN list_contains(ports, 21) AND h % 3 = 0 THEN 'FileZilla Server 0.9.41 beta' ELSE 'OpenSSH 7.4p1' END FROM g WHERE list_contains(ports, 21) AND h % 3 = 0 OR list_contains(ports, 22) AND h % 2 = 0
), b AS (
  SELECT * FROM a UNION ALL SELECT h, ip, 'info', 2.5, 'informational_exposure', CASE WHEN list_contains(ports, 80) THEN 80 ELSE ports[1] END, ports[1:6], NULL FROM g WHERE h NOT IN (SELECT h FROM a))
"""


def _services(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 350).alias("h"), F.element_at(F.array(*map(F.lit, _PORTS)), (F.col("o_orderkey") % 10 + 1).cast("int")).alias("port"))
    h, port = F.col("h"), F.col("port")
    banner = F.when(port == 22, F.when(h % 2 == 0, "SSH-2.0-OpenSSH_7.4p1").otherwise("SSH-2.0-OpenSSH_9.0")).when(port == 21, F.when(h % 3 == 0, "220 FileZilla Server 0.9.41 beta").otherwise("vsftpd")).when(port == 443, F.concat(F.lit("HTTP Date: Mon, 01 Jan "), 2015 + h % 10))
    return o.select(F.concat(F.lit("10.0."), h % 7, F.lit("."), h % 50).alias("ip"), "port", banner.alias("banner"), F.when(port == 443, F.when(h % 4 == 0, "TLSv1").otherwise("TLSv1.3")).alias("protocol"))


@register(QUERIES, ORACLE, f"WITH {_ASPECTS} SELECT ip, aspect, severity::DOUBLE AS severity, risk, port, array_to_string(ps, ',') AS ports, detail FROM b")
def host_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.aspects(_services(spark, sf_dir), 2024).withColumn("ports", F.array_join(F.col("ports").cast("array<string>"), ","))


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_ASPECTS}, h AS (SELECT ip, max(severity)::DOUBLE AS severity, count(*) AS aspects, string_agg(DISTINCT risk, ',' ORDER BY risk) AS risks FROM b GROUP BY 1)
    SELECT rank, ip, severity, aspects, risks FROM (SELECT *, row_number() OVER (ORDER BY severity DESC, aspects DESC, ip) AS rank FROM h) WHERE rank <= 50""",
)
def attack_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.attack_surface(exposure.aspects(_services(spark, sf_dir), 2024))


@register(
    QUERIES,
    ORACLE,
    """WITH e AS (SELECT o_custkey AS site, 'e-' || o_orderkey AS id, o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'critical_cve_exposed' END AS r1, CASE WHEN o_orderkey % 5 = 0 THEN 'internet_exposed_admin' WHEN o_orderkey % 5 = 1 THEN 'public_database_exposure' END AS r2,
      CASE WHEN o_orderkey % 7 = 0 THEN 'weak_tls_exposed' END AS r3 FROM orders WHERE o_custkey % 3 > 0 OR o_orderkey % 315 = 2),
    r AS (SELECT site, id, unnest(list_filter([r1, r2, r3], lambda x: x IS NOT NULL)) AS risk FROM e), g AS (SELECT DISTINCT site FROM r UNION SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0),
    x AS (SELECT * FROM r UNION ALL SELECT site, id, 'informational_exposure' FROM e WHERE site NOT IN (SELECT site FROM g)),
    s AS (SELECT site, risk, string_agg(DISTINCT id, ',' ORDER BY id) AS evidence_ids, list_position(['critical_cve_exposed', 'internet_exposed_admin', 'public_database_exposure', 'weak_tls_exposed', 'informational_exposure'], risk) AS o FROM x GROUP BY 1, 2)
    SELECT site, risk, row_number() OVER (PARTITION BY site ORDER BY o) AS priority, evidence_ids, o < 5 AS requires_approval FROM s""",
)
def hardening(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    evidence = o.where("o_custkey % 3 > 0 OR o_orderkey % 315 = 2").select(
        F.col("o_custkey").alias("site"), F.concat(F.lit("e-"), k).alias("evidence_id"), F.when(k % 5 == 0, "SSH").when(k % 5 == 1, "Redis").otherwise("http").alias("service"), F.when(k % 7 == 0, "expired").alias("tls"), F.when(k % 9 == 0, 9.5).otherwise(3.0).alias("severity")
    )
    shown = evidence.groupBy("site").agg(F.collect_set("evidence_id").alias("exposures"))  # a site's evidence
    pictures = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), F.when(F.col("c_custkey") % 10 == 0, "weak_tls_exposed").alias("top_risk")).join(shown, "site", "left")
    return exposure.recommend(evidence, pictures)


@register(
    QUERIES,
    ORACLE,
    """WITH w AS (SELECT p_partkey AS spec_id, list_distinct(string_split(p_name, ' ') || [p_brand, p_type, 'size' || (p_size // 5), 'k' || (p_partkey % 40)]) AS w, ['n' || (p_partkey % 3), 'm' || (p_partkey % 4)] AS p FROM part), u AS (SELECT spec_id, len(w) AS n, unnest(w) AS t FROM w),
    m AS (SELECT a.spec_id, b.spec_id AS other, count(*) AS s, any_value(a.n) AS n, any_value(b.n) AS m FROM u a JOIN u b ON a.t = b.t AND a.spec_id <> b.spec_id WHERE a.spec_id % 20 = 0 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY s / (n + m - s) DESC, other) AS rank FROM m)
    SELECT r.spec_id, other, round(s / (n + m - s), 4)::DOUBLE AS score, array_to_string(list_sort(list_intersect(a.p, b.p)), ',') AS shared, rank FROM r JOIN w a ON a.spec_id = r.spec_id JOIN w b ON b.spec_id = other WHERE rank <= 2""",
)
def similar_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as specifications; every twentieth asks."""
    p, k = load(spark, sf_dir, "part"), F.col("p_partkey")
    words = F.concat(F.split("p_name", " "), F.array("p_brand", "p_type", F.concat(F.lit("size"), F.floor(F.col("p_size") / 5)), F.concat(F.lit("k"), k % 40)))
    specs = p.select(k.alias("spec_id"), words.alias("words"), F.array(F.concat(F.lit("n"), k % 3), F.concat(F.lit("m"), k % 4)).alias("params"))
    return exposure.similar_specs(specs, specs.where("spec_id % 20 = 0"))
