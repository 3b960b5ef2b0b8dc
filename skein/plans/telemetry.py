"""Log parsing, portraits and detectors over lines made from ``events`` by a fixed rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import net
from skein.operators import detect, pack, sweep
from skein.plans.base import Query, load, once, register, spread
from skein.sources import corpus, syslog

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_PORTS = ("443", "37777", "22", "70000", "53")
_LINES = """p AS (
  SELECT event_id, user_id, ts, event_type, value, '10.' || (user_id % 3) || '.' || (user_id % 7) || '.' || (user_id % 250 + 1) AS srcip, '192.168.1.' || (event_id % 90) AS dstip,
         ['443', '37777', '22', '70000', '53'][event_id % 5 + 1] AS port, CASE WHEN event_type = 'error' THEN 'deny' ELSE 'accept' END AS action,
         CASE event_id % 4 WHEN 0 THEN 'dhcp' WHEN 1 THEN 'system' ELSE 'traffic' END AS type FROM events)
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, line): one key-value log line an event."""
    e = spread(load(spark, sf_dir, "events"))
    u, i = F.col("user_id"), F.col("event_id")
    src = F.concat(F.lit("10."), u % 3, F.lit("."), u % 7, F.lit("."), u % 250 + 1)
    dst = F.concat(F.lit("192.168.1."), i % 90)
    port = F.element_at(F.array(*map(F.lit, _PORTS)), (i % 5 + 1).cast("int"))
    action = F.when(F.col("event_type") == "error", "deny").otherwise("accept")
    kind = F.when(i % 4 == 0, "dhcp").when(i % 4 == 1, "system").otherwise("traffic")
    mac = F.concat(F.when(u % 5 == 0, "02").otherwise("00"), F.lit(":11:22:33:44:"), F.lpad(F.lower(F.hex((u + i % 2 * (u % 9 == 0).cast("int")) % 256)), 2, "0"))
    described = F.when(i % 4 == 0, "DHCP Ack log").when((i % 4 == 1) & (F.col("event_type") == "error"), "Admin login failed").otherwise("")
    pairs = [("date", F.date_format("ts", "yyyy-MM-dd")), ("time", F.date_format("ts", "HH:mm:ss")), ("type", kind), ("logdesc", F.concat(F.lit('"'), described, F.lit('"'))), ("srcip", src), ("dstip", dst), ("dstport", port), ("action", action), ("mac", mac), ("sentbyte", F.floor(F.col("value") * 100).cast("string"))]
    text = F.concat_ws(" ", F.lit("<134> gateway"), *[F.concat(F.lit(f"{k}="), v) for k, v in pairs])
    return e.select("event_id", text.alias("line"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syslog.parse(lines(spark, sf_dir))


@register(QUERIES, ORACLE, f"WITH {_LINES} SELECT event_id, 10 AS n_fields, type, srcip, port AS dstport, strftime(ts, '%H:%M:%S') AS time FROM p")
def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("fields")
    return parsed(spark, sf_dir).select("event_id", F.size(f).alias("n_fields"), f["type"].alias("type"), f["srcip"].alias("srcip"), f["dstport"].alias("dstport"), f["time"].alias("time"))


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_LINES} SELECT category, count(*) AS n FROM (SELECT CASE WHEN type = 'dhcp' THEN 'dhcp_ack' WHEN type = 'system' AND event_type = 'error' THEN 'admin_login_failed'
    WHEN action = 'deny' AND port = '37777' THEN 'device_port_probe' WHEN action = 'deny' THEN 'policy_deny' ELSE 'traffic_accept' END AS category FROM p) GROUP BY 1""",
)
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).groupBy(syslog.category(F.col("fields")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def _facts(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    return syslog.facts(parsed(spark, sf_dir) if rows is None else rows)


_FACTS = f"{_LINES}, f AS (SELECT date_trunc('second', ts) AS ts, srcip, dstip, CASE WHEN port = '70000' THEN 0 ELSE port::INT END AS dstport, action, floor(value * 100)::BIGINT AS sent FROM p WHERE type = 'traffic')"


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_FACTS} SELECT srcip, count(*) AS flows, sum(sent)::BIGINT AS sent, count(*) FILTER (action = 'deny') AS denied, count(DISTINCT dstip) AS peers, min(ts) AS first_seen, max(ts) AS last_seen FROM f GROUP BY 1""",
)
def portrait_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).groupBy("srcip").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("sent").alias("sent"), F.count_if(F.col("action") == "deny").alias("denied"), F.countDistinct("dstip").alias("peers"),
        F.min("ts").cast("timestamp_ntz").alias("first_seen"), F.max("ts").cast("timestamp_ntz").alias("last_seen"),
    )


@register(QUERIES, ORACLE, f"WITH {_FACTS} SELECT srcip, strftime(ts, '%Y-%m-%d') AS day, count(*) AS flows, sum(sent)::BIGINT AS sent FROM f GROUP BY 1, 2")
def portrait_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).groupBy("srcip", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("flows"), F.sum("sent").alias("sent"))


@register(QUERIES, ORACLE, f"WITH {_FACTS} SELECT srcip, hour(ts)::INT AS hour, count(*) AS flows FROM f GROUP BY 1, 2")
def portrait_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).groupBy("srcip", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("flows"))


@register(QUERIES, ORACLE, f"WITH {_FACTS} SELECT srcip, dstip, n, rank FROM (SELECT srcip, dstip, count(*) AS n, row_number() OVER (PARTITION BY srcip ORDER BY count(*) DESC, dstip) AS rank FROM f GROUP BY 1, 2) WHERE rank <= 3")
def portrait_top_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.operators.sequences import top_per_group

    return top_per_group(_facts(spark, sf_dir), "srcip", "dstip", 3)


@register(
    QUERIES,
    ORACLE,
    f"WITH {_FACTS} SELECT regexp_replace(srcip, '\\.[0-9]+$', '.0/24') AS segment, count(*) AS flows, count(DISTINCT srcip) AS hosts, round(count(*) FILTER (action = 'deny') / greatest(1, count(*)), 3) AS deny_rate FROM f GROUP BY 1",
)
def segment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir)
    return f.groupBy(net.segment(F.col("srcip")).alias("segment")).agg(F.count(F.lit(1)).alias("flows"), F.countDistinct("srcip").alias("hosts"), F.round(F.count_if(F.col("action") == "deny") / F.greatest(F.lit(1), F.count(F.lit(1))), 3).alias("deny_rate"))


@register(QUERIES, ORACLE, f"WITH {_FACTS} SELECT action, dstport, count(*) AS n, sum(sent)::BIGINT AS sent FROM f GROUP BY GROUPING SETS ((action), (action, dstport), ())")
def evidence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir)
    return f.groupingSets([["action"], ["action", "dstport"], []], "action", "dstport").agg(F.count(F.lit(1)).alias("n"), F.sum("sent").alias("sent"))


def _leases(rows: DataFrame) -> DataFrame:
    f = F.col("fields")
    at = F.try_to_timestamp(F.concat_ws(" ", f["date"], f["time"]))
    return rows.where(f["logdesc"] == "DHCP Ack log").select(at.alias("ts"), f["srcip"].alias("ip"), f["mac"].alias("mac"))


def _logins(rows: DataFrame) -> DataFrame:
    f = F.col("fields")
    return rows.where(f["type"] == "system").select(f["srcip"].alias("srcip"), (f["logdesc"] != "Admin login failed").alias("ok"))


_LEASES = _LINES + """, l AS (SELECT date_trunc('second', ts) AS ts, srcip AS ip, (CASE WHEN user_id % 5 = 0 THEN '02' ELSE '00' END) || ':11:22:33:44:' || lpad(lower(printf('%X', (user_id + (event_id % 2) * (user_id % 9 = 0)::INT) % 256)), 2, '0') AS mac FROM p WHERE type = 'dhcp')"""
_DETECTED = """
SELECT 'multi_address' AS fault, mac AS subject, 'low' AS severity, 0.7::DOUBLE AS confidence, count(DISTINCT ip)::DOUBLE AS measured FROM l GROUP BY mac HAVING count(DISTINCT ip) > 1
UNION ALL SELECT 'unmanaged_identity', regexp_replace(ip, '\\.[0-9]+$', '.0/24'), 'low', 0.6, count(DISTINCT mac) FROM l WHERE substr(mac, 1, 2) = '02' GROUP BY 2 HAVING count(DISTINCT mac) >= 2
UNION ALL SELECT 'login_bruteforce', srcip, 'high', 0.95, count(*) FROM p WHERE type = 'system' AND event_type = 'error' GROUP BY srcip HAVING count(*) >= 3
UNION ALL SELECT 'duplicate_lease', ip, 'high', 0.9, min(gap) FROM (SELECT a.ip, least(abs(a.f - b.f), abs(a.f - b.l), abs(a.l - b.f), abs(a.l - b.l)) AS gap FROM c a JOIN c b ON a.ip = b.ip AND a.mac < b.mac) WHERE gap <= 86400 GROUP BY ip
UNION ALL SELECT 'unmanaged_address', ip, 'medium', 0.75, n FROM (SELECT srcip AS ip, count(*) AS n FROM p WHERE type = 'traffic' AND NOT regexp_matches(srcip, '\\.(0|255)$') GROUP BY 1) h
  WHERE ip NOT IN (SELECT ip FROM l) AND regexp_replace(ip, '\\.[0-9]+$', '') IN (SELECT regexp_replace(ip, '\\.[0-9]+$', '') FROM l)
"""


@register(QUERIES, ORACLE, f"WITH {_LEASES}, c AS (SELECT ip, mac, epoch(min(ts)) AS f, epoch(max(ts)) AS l FROM l GROUP BY 1, 2) {_DETECTED}")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.findings(once(sweep.observed(parsed(spark, sf_dir))), logins=3, lease_gap=86400)


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_LEASES}, f AS (SELECT srcip AS a FROM p WHERE type = 'traffic' UNION ALL SELECT dstip FROM p WHERE type = 'traffic'), s AS (SELECT event_id, date_trunc('second', ts) AS ts FROM events)
    SELECT 'corpus' AS kind, '' AS subject, '' AS detail, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM s
    UNION ALL SELECT 'ack', ip, mac, count(*), min(ts), max(ts) FROM l GROUP BY 2, 3
    UNION ALL SELECT 'login_failed', srcip, '', count(*), min(date_trunc('second', ts)), max(date_trunc('second', ts)) FROM p WHERE type = 'system' AND event_type = 'error' GROUP BY 2
    UNION ALL SELECT 'flow', a, '', count(*), min(ts), max(ts) FROM (SELECT srcip AS a, date_trunc('second', ts) AS ts FROM p UNION ALL SELECT dstip, date_trunc('second', ts) FROM p) GROUP BY 2
    UNION ALL SELECT 'source', k, '', n, a, b FROM (SELECT 'dhcp_ack' AS k, count(*) AS n, min(ts) AS a, max(ts) AS b FROM l UNION ALL SELECT 'admin_auth', count(*), min(date_trunc('second', ts)), max(date_trunc('second', ts)) FROM p WHERE type = 'system' AND event_type = 'error'
      UNION ALL SELECT 'l3_flow', 2 * count(*), min(date_trunc('second', ts)), max(date_trunc('second', ts)) FROM p) WHERE n > 0
    UNION ALL SELECT 'traffic', srcip, '', count(*), min(date_trunc('second', ts)), max(date_trunc('second', ts)) FROM p WHERE type = 'traffic' GROUP BY 2""",
)
def swept_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables of the one scan: counts and times of each kind of observation."""
    seen = sweep.observed(parsed(spark, sf_dir))
    return seen.select("kind", "subject", "detail", "n", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_LEASES}, o AS (SELECT ip, count(DISTINCT mac) AS n FROM l GROUP BY 1), t AS (SELECT DISTINCT srcip AS ip FROM p WHERE type = 'traffic'),
    s AS (SELECT DISTINCT regexp_replace(ip, '\\.[0-9]+$', '.') AS s FROM (SELECT ip FROM o UNION ALL SELECT ip FROM t)),
    c AS (SELECT s || '0/24' AS segment, i::INT AS cell, s || i AS ip FROM s, range(1, 255) r(i))
    SELECT segment, cell, CASE WHEN n > 1 THEN 'contested' WHEN n = 1 THEN 'leased' WHEN t.ip IS NOT NULL THEN 'unbound' ELSE 'silent' END AS state FROM c LEFT JOIN o USING (ip) LEFT JOIN t ON t.ip = c.ip""",
)
def address_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(parsed(spark, sf_dir))
    return detect.address_space(_leases(rows), _facts(spark, sf_dir, rows).select(F.col("srcip").alias("ip")))


@register(
    QUERIES,
    ORACLE,
    """WITH n AS (SELECT DISTINCT '10.0.0.' || (user_id % 50) AS ip, '00:' || (user_id % 100) AS mac FROM events WHERE event_type = 'view'),
    l AS (SELECT DISTINCT '10.0.0.' || (user_id % 50) AS ip, '00:' || (user_id % 150) AS mac FROM events WHERE event_type = 'click'),
    c AS (SELECT n.ip, count(*) AS n, count(l.mac) AS known, bool_or(n.ip IN (SELECT ip FROM l)) AS leased FROM n LEFT JOIN l ON n.ip = l.ip AND n.mac = l.mac GROUP BY n.ip),
    s AS (SELECT event_type AS pool, floor(value) / 50 AS u FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)
    SELECT 'duplicate_ip_static' AS fault, ip AS subject, 'critical' AS severity, (CASE WHEN n > 1 THEN 0.98 ELSE 0.9 END)::DOUBLE AS confidence, n::DOUBLE AS measured FROM c WHERE n > 1 OR (leased AND known = 0)
    UNION ALL SELECT 'pool_pressure', pool, 'high', 0.9, round(u, 3) FROM s WHERE u >= 0.2
    UNION ALL SELECT 'session_tuple_clash', '10.0.0.' || (user_id % 50), 'medium', 0.75, count(*) FROM events WHERE event_type = 'error' GROUP BY 2 HAVING count(*) >= 10""",
)
def owner_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    ip, machine = F.concat(F.lit("10.0.0."), F.col("user_id") % 50), lambda m: F.concat(F.lit("00:"), F.col("user_id") % m).alias("mac")
    neighbours, leases = e.where("event_type = 'view'").select(ip.alias("ip"), machine(100)), e.where("event_type = 'click'").select(ip.alias("ip"), machine(150))
    stats = e.select(F.col("event_type").alias("pool"), F.struct("ts", "event_id").alias("at"), F.lit(50).alias("total"), F.floor("value").alias("used"))
    clashes = e.where("event_type = 'error'").select(ip.alias("srcip"))
    return detect.report([detect.contradicted_owners(neighbours, leases), detect.pool_pressure(stats, 0.2), detect.session_clashes(clashes)])


@register(QUERIES, ORACLE)
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.html_blocks(load(spark, sf_dir, "pages"))


@register(
    QUERIES,
    ORACLE,
    r"""WITH n AS (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages), e AS (SELECT page_id, unnest(regexp_extract_all(nav, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(nav, '<a href="[^"]*">([^<]*)</a>', 1)) AS title, generate_subscripts(regexp_extract_all(nav, '<a href="([^"]*)">', 1), 1) - 1 AS place FROM n)
    SELECT page_id, place::INT AS place, NULL::INT AS parent, replace(replace(replace(href, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS href, replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS path FROM e""",
)
def page_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every page's menus, with the titles above them."""
    return corpus.toc(load(spark, sf_dir, "pages")).select("page_id", "place", "parent", "href", F.array_join("path", " > ").alias("path"))


@register(QUERIES, ORACLE)
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.chunks(pack.html_blocks(load(spark, sf_dir, "pages")))


@register(
    QUERIES,
    ORACLE,
    """SELECT l_linestatus AS purpose, l_returnflag AS model, count(*) AS calls, sum(l_quantity)::DOUBLE AS tokens, round(sum(l_quantity * CASE l_returnflag WHEN 'A' THEN 0.002 WHEN 'R' THEN 0.004 ELSE 0.001 END), 4)::DOUBLE AS cost
    FROM lineitem GROUP BY GROUPING SETS ((l_linestatus), (l_returnflag), ())""",
)
def spend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("purpose"), F.col("l_returnflag").alias("model"), F.col("l_quantity").cast("double").alias("q"))
    rate = F.when(F.col("model") == "A", 0.002).when(F.col("model") == "R", 0.004).otherwise(0.001)
    return rows.withColumn("c", F.col("q") * rate).groupingSets([["purpose"], ["model"], []], "purpose", "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("q").alias("tokens"), F.round(F.sum("c"), 4).alias("cost"))
