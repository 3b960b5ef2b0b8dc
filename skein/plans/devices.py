"""Host profiles, ties, window statistics and ownership over hosts made from ``customer`` and flows made from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import detect, devices
from skein.plans.base import Query, load, once, register
from skein.plans.telemetry import _LINES, parsed

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_HOSTS = r"""h AS (SELECT c_custkey AS k, '10.' || (c_custkey // 62500) || '.' || ((c_custkey // 250) % 250) || '.' || (c_custkey % 250 + 1) AS ip,
  CASE WHEN c_custkey % 3 = 0 THEN 'F4:B1:C2' ELSE 'A8:6D:' || printf('%X', 150 + c_custkey % 40) END || ':00:00:01' AS mac,
  ['VTO-', 'ipc', 'Galaxy', 'DESKTOP-', 'nas', 'printer '][c_custkey % 6 + 1] || chr((97 + c_custkey % 26)::INT) || '-' || c_custkey AS name,
  CASE c_custkey % 4 WHEN 0 THEN 'Android' WHEN 1 THEN 'Windows' END AS system, [['443', '554'][c_custkey % 2 + 1], ['22', '8080', '3702'][c_custkey % 3 + 1]] AS ports, (c_custkey * 37) % 25000 AS denied FROM customer),
d AS (SELECT ip, name, CASE WHEN mac LIKE 'F4:B1:C2%' THEN 'Dahua' WHEN mac LIKE 'A8:6D:AA%' THEN 'Intel' ELSE 'unknown' END AS maker,
  CASE WHEN regexp_matches(name, '^(vto|vth)', 'i') THEN 'intercom' WHEN regexp_matches(name, '^(es-|ipc|nvr|dvr|dh-)', 'i') THEN 'camera' WHEN regexp_matches(name, 'galaxy', 'i') THEN 'mobile'
       WHEN regexp_matches(name, '(desktop-|laptop-|-pc$|^win|^mh$|^hub)', 'i') THEN 'workstation' WHEN regexp_matches(name, '(server|nas|srv|r230)', 'i') THEN 'server'
       WHEN system = 'Android' THEN 'mobile' WHEN system = 'Windows' THEN 'workstation' WHEN len(list_intersect(ports, ['554', '37777', '3702'])) > 0 THEN 'camera' ELSE 'unknown' END AS role,
  lower(substr(regexp_replace(regexp_replace(trim(name), '[-_\s]?[0-9A-Fa-f]{4,}$', ''), '[-_\s]?[0-9]+$', ''), 1, 14)) AS family,
  CASE WHEN denied >= 20000 OR (denied > 4000 AND len(list_distinct(ports)) > 6) THEN 'high' WHEN denied >= 2000 THEN 'watch' ELSE 'ok' END AS band, 'internal' AS side, regexp_replace(ip, '\.[0-9]+$', '.0/24') AS segment, mac FROM h)
"""


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = load(spark, sf_dir, "customer"), F.col("c_custkey")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n + 1).cast("int"))
    return c.select(
        F.concat(F.lit("10."), F.floor(k / 62500), F.lit("."), F.floor(k / 250) % 250, F.lit("."), k % 250 + 1).alias("ip"),
        F.concat(F.when(k % 3 == 0, "F4:B1:C2").otherwise(F.concat(F.lit("A8:6D:"), F.hex(150 + k % 40))), F.lit(":00:00:01")).alias("mac"),
        F.concat(pick(("VTO-", "ipc", "Galaxy", "DESKTOP-", "nas", "printer "), k % 6), F.chr(97 + k % 26), F.lit("-"), k).alias("name"),
        F.when(k % 4 == 0, "Android").when(k % 4 == 1, "Windows").alias("system"), F.array(pick(("443", "554"), k % 2), pick(("22", "8080", "3702"), k % 3)).alias("ports"), (k * 37 % 25000).alias("denied"),
    )


@register(QUERIES, ORACLE, f"WITH {_HOSTS} SELECT ip, name, maker, role, family, band, side, segment FROM d")
def device_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.describe(hosts(spark, sf_dir))


_PAIRS = "SELECT a.ip AS src, b.ip AS dst, '{kind}' AS kind, round({w} * log10(2) + {w} * 0.35, 3)::DOUBLE AS weight, {note} AS note FROM m a JOIN m b USING (segment, {by}) WHERE a.ip < b.ip"


@register(
    QUERIES,
    ORACLE,
    f"WITH {_HOSTS}, x AS (SELECT ip, segment, substr(mac, 1, 8) AS oui FROM d), m AS (SELECT * FROM x WHERE (segment, oui) IN (SELECT (segment, oui) FROM x GROUP BY segment, oui HAVING count(*) BETWEEN 2 AND 10)) " + _PAIRS.format(kind="fleet", w=0.9, note="oui", by="oui"),
)
def fleet_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hosts(spark, sf_dir).select(F.col("ip").alias("node"), F.concat(F.substring_index("ip", ".", 3), F.lit(".0/24")).alias("segment"), F.upper(F.substring("mac", 1, 8)).alias("oui"))
    return devices.group_ties(rows, "fleet", ["segment", "oui"], 2, 10)


@register(
    QUERIES,
    ORACLE,
    f"WITH {_HOSTS}, m AS (SELECT ip, segment, family FROM d WHERE (segment, family) IN (SELECT (segment, family) FROM d GROUP BY segment, family HAVING count(*) BETWEEN 2 AND 14)) " + _PAIRS.format(kind="family", w=1.0, note="family", by="family"),
)
def family_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = devices.describe(hosts(spark, sf_dir)).select(F.col("ip").alias("node"), "segment", "family")
    return devices.group_ties(rows, "family", ["segment", "family"], 2, 14)


_MARKS = """u AS (SELECT user_id AS node, (event_id % 9)::VARCHAR AS port, count(*) AS n FROM events GROUP BY 1, 2),
t AS (SELECT node, string_agg(port, ' ' ORDER BY port) AS mark, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, port) AS r FROM u) WHERE r <= 3 GROUP BY node HAVING count(*) >= 2)"""


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_MARKS}, m AS (SELECT node, mark FROM t WHERE mark IN (SELECT mark FROM t GROUP BY mark HAVING count(*) BETWEEN 2 AND 8))
    SELECT a.node AS src, b.node AS dst, 'portfp' AS kind, round(1.8 * log10(3) + 1.8 * 0.35, 3)::DOUBLE AS weight, mark AS note FROM m a JOIN m b USING (mark) WHERE a.node < b.node""",
)
def port_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = load(spark, sf_dir, "events").select(F.col("user_id").alias("node"), (F.col("event_id") % 9).cast("string").alias("port"))
    return devices.group_ties(devices.port_marks(flows), "portfp", ["mark"], 2, 8, hits=2)


@register(QUERIES, ORACLE)
def strongest_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy degree caps go in order, which SQL cannot say; a test holds it against a plain loop."""
    ties = fleet_ties(spark, sf_dir).unionByName(family_ties(spark, sf_dir)).withColumn("segment", F.concat(F.substring_index("src", ".", 3), F.lit(".0/24")))
    return devices.strongest(ties, "segment")


_STATS = f"""{_LINES}, c AS (SELECT srcip AS src, port, CASE WHEN type = 'dhcp' THEN 'lease' WHEN type = 'system' AND event_type = 'error' THEN 'login' WHEN action = 'deny' THEN 'deny' ELSE 'accept' END AS kind FROM p),
dp AS (SELECT port AS k, count(*) AS n FROM c WHERE kind = 'deny' GROUP BY 1 ORDER BY n DESC, k LIMIT 6), ds AS (SELECT src AS k, count(*) AS n FROM c WHERE kind = 'deny' GROUP BY 1 ORDER BY n DESC, k LIMIT 6),
lt AS (SELECT src AS k, count(*) AS n FROM c WHERE kind = 'login' GROUP BY 1 ORDER BY n DESC, k LIMIT 6),
w AS (SELECT count(*) FILTER (kind = 'login') AS login_failed, count(DISTINCT src) FILTER (kind = 'login') AS login_sources, 0::BIGINT AS lockouts, count(*) FILTER (kind = 'deny') AS denied, count(*) FILTER (kind = 'accept') AS accepted, 0::BIGINT AS clashes,
 count(*) FILTER (kind = 'lease') AS leases, count(*) FILTER (kind = 'deny' AND port = '37777') AS device_denied FROM c)
"""
_SAID = "(SELECT coalesce(string_agg(k || ':' || n, ',' ORDER BY n DESC, k), '') FROM {0})"


@register(QUERIES, ORACLE, f"WITH {_STATS} SELECT *, {_SAID.format('dp')} AS denied_ports, {_SAID.format('ds')} AS denied_sources, {_SAID.format('lt')} AS login_top FROM w")
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.window_stats(once(parsed(spark, sf_dir)))


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_STATS} SELECT 'logins_per_source' AS evidence, round(login_failed / greatest(login_sources, 1), 2)::DOUBLE AS value FROM w UNION ALL SELECT 'deny_ratio', round(denied / greatest(denied + accepted, 1), 3) FROM w
    UNION ALL SELECT 'device_deny_share', round(device_denied / greatest(denied, 1), 3) FROM w UNION ALL SELECT 'lease_count', leases FROM w UNION ALL SELECT 'lockouts', lockouts FROM w""",
)
def window_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.evidence_of(devices.window_stats(once(parsed(spark, sf_dir))))


_FLOWS = """f AS (SELECT CASE WHEN event_id % 11 = 0 THEN '203.0.' || (user_id % 20) || '.' || (user_id % 200) ELSE '10.0.' || (user_id % 5) || '.' || (user_id % 90) END AS src,
 CASE WHEN event_id % 7 = 0 THEN '8.8.' || (event_id % 4) || '.8' ELSE '10.0.9.' || (event_id % 12) END AS dst, (event_id % 6)::VARCHAR AS port, CASE WHEN event_type = 'error' THEN 'deny' ELSE 'accept' END AS action FROM events)"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i, u = load(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    src = F.when(i % 11 == 0, F.concat(F.lit("203.0."), u % 20, F.lit("."), u % 200)).otherwise(F.concat(F.lit("10.0."), u % 5, F.lit("."), u % 90))
    dst = F.when(i % 7 == 0, F.concat(F.lit("8.8."), i % 4, F.lit(".8"))).otherwise(F.concat(F.lit("10.0.9."), i % 12))
    return e.select(src.alias("src"), dst.alias("dst"), (i % 6).cast("string").alias("port"), F.when(F.col("event_type") == "error", "deny").otherwise("accept").alias("action"))


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_FLOWS}, o AS (SELECT src AS ip, count(*) AS oh, count(*) FILTER (action = 'deny') AS od, count(DISTINCT dst) FILTER (dst LIKE '8.%') AS ext FROM f GROUP BY 1), i AS (SELECT dst AS ip, count(*) AS ih, count(*) FILTER (action = 'deny') AS id FROM f GROUP BY 1),
    b AS (SELECT coalesce(o.ip, i.ip) AS ip, coalesce(oh, 0) AS out_hits, coalesce(ih, 0) AS in_hits, coalesce(od, 0) + coalesce(id, 0) AS denied, coalesce(ext, 0) AS external FROM o FULL JOIN i ON o.ip = i.ip)
    SELECT *, concat_ws(',', CASE WHEN external > 0 THEN 'talks to WAN' ELSE 'internal-only' END, CASE WHEN in_hits > out_hits * 3 AND in_hits > 20 THEN 'server-like' WHEN out_hits > in_hits * 3 AND out_hits > 20 THEN 'client-like' END,
      CASE WHEN denied > (out_hits + in_hits) * 0.5 AND denied > 20 THEN 'policy-denied' END) AS tags FROM b""",
)
def host_portraits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.portraits(flows(spark, sf_dir))


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_FLOWS}, e AS (SELECT src, count(*) AS n, regexp_replace(src, '\\.[0-9]+$', '.0/24') AS segment FROM f WHERE action = 'deny' GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY n DESC, src) AS r FROM e)
    SELECT segment, sum(n)::BIGINT AS hits, count(*) AS sources, string_agg(src, ',' ORDER BY r) FILTER (r <= 5) AS worst FROM r GROUP BY 1""",
)
def wan_attackers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.attackers(flows(spark, sf_dir))


@register(QUERIES, ORACLE, f"WITH {_FLOWS} SELECT src, dst, port, count(*) AS n, count(*) FILTER (action = 'deny') AS denied FROM f GROUP BY 1, 2, 3")
def flow_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).groupBy("src", "dst", "port").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "deny").alias("denied"))


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_HOSTS}, m AS (SELECT segment, role, count(*) AS n, count(*) FILTER (band <> 'ok') AS bad FROM d GROUP BY 1, 2)
    SELECT segment, sum(n)::BIGINT AS hosts, sum(bad)::BIGINT AS exposed, string_agg(role || ':' || n, ',' ORDER BY role) AS roles FROM m GROUP BY 1""",
)
def asset_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.exposure(devices.describe(hosts(spark, sf_dir)))


_CAPTURES = "c AS (SELECT '10.1.0.' || (user_id % 200) AS ip, ts, '00:' || (user_id + event_id % 3 * (user_id % 5 = 0)::INT) AS mac, CASE WHEN event_type = 'error' THEN NULL ELSE '00:' || (user_id + event_id % 3) END AS owner FROM events)"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i, u = load(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    mac = F.concat(F.lit("00:"), u + i % 3 * (u % 5 == 0).cast("int"))
    owner = F.when(F.col("event_type") != "error", F.concat(F.lit("00:"), u + i % 3))
    return e.select(F.concat(F.lit("10.1.0."), u % 200).alias("ip"), "ts", mac.alias("mac"), owner.alias("owner"))


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_CAPTURES}, s AS (SELECT *, lag(mac) OVER (PARTITION BY ip ORDER BY ts, mac) AS before FROM c)
    SELECT ip, count(*) AS changes, max_by(before, (ts, mac)) AS last_from, max_by(mac, (ts, mac)) AS last_to FROM s WHERE before IS NOT NULL AND before <> mac GROUP BY ip""",
)
def ownership_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.ownership_drift(captures(spark, sf_dir))


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_CAPTURES}, t AS (SELECT ip, count(*) AS n, count(DISTINCT owner) AS o, round(count(*) FILTER (owner IS NULL) / count(*), 4)::DOUBLE AS unreachable FROM c GROUP BY 1 HAVING count(DISTINCT owner) > 1)
    SELECT ip, owner, round(count(*) / any_value(n), 4)::DOUBLE AS share, any_value(unreachable) AS unreachable FROM c JOIN t USING (ip) WHERE owner IS NOT NULL GROUP BY 1, 2""",
)
def contested_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.contested_share(captures(spark, sf_dir))


@register(
    QUERIES,
    ORACLE,
    f"""WITH {_HOSTS}, r AS (SELECT event_id, '10.0.' || (user_id // 250) || '.' || (user_id % 250 + 1) AS ip, CASE WHEN event_id % 2 = 0 THEN 'm' || (user_id % 70) END AS mac FROM events), a AS (SELECT ip, name AS owner FROM h), m AS (SELECT DISTINCT 'm' || (k % 50) AS mac, 'owner ' || (k % 50) AS owner FROM h)
    SELECT event_id, r.ip, r.mac, coalesce(m.owner, a.owner) AS owner FROM r LEFT JOIN m ON m.mac = r.mac LEFT JOIN a ON a.ip = r.ip""",
)
def enriched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = load(spark, sf_dir, "events"), F.col("user_id")
    rows = e.select("event_id", F.concat(F.lit("10.0."), F.floor(u / 250), F.lit("."), u % 250 + 1).alias("ip"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("m"), u % 70)).alias("mac"))
    k = F.col("c_custkey") % 50
    machines = load(spark, sf_dir, "customer").select(F.concat(F.lit("m"), k).alias("mac"), F.concat(F.lit("owner "), k).alias("owner")).distinct()
    return devices.enrich(rows, machines, hosts(spark, sf_dir).select("ip", F.col("name").alias("owner"))).select("event_id", "ip", "mac", "owner")


# Evidence of a case: what each of its orders and lines says.
_EVIDENCE = """e AS (SELECT o_custkey AS case_id, min(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) = 0 AS carrier_down, min(o_orderkey % 5) = 0 AS no_link, sum(o_orderkey % 7) AS dropped, max(o_orderkey % 3) AS hw_errors, sum(o_orderkey % 400) AS failed_logins,
 count(*) FILTER (o_orderpriority = '1-URGENT') AS lockouts, (sum(o_totalprice) / 100)::BIGINT AS denied, avg((o_orderkey % 4 < 3)::INT)::DOUBLE AS internal_share, count(*) FILTER (o_orderpriority = '5-LOW') AS leases, max(o_orderkey % 100) AS cpu FROM orders GROUP BY 1)"""
_LADDER = """CASE WHEN carrier_down AND no_link THEN 'carrier_down' WHEN dropped > 0 AND hw_errors = 0 THEN 'benign_rx_dropped' WHEN failed_logins >= 1000 AND lockouts >= 1 THEN 'admin_bruteforce_lockout'
 WHEN denied >= 10000 AND internal_share >= 0.5 THEN 'internal_policy_deny_expected' WHEN leases > 0 THEN 'dhcp_service_healthy' WHEN cpu < 60 THEN 'firewall_resource_healthy' ELSE 'unknown' END"""


@register(QUERIES, ORACLE, f"WITH {_EVIDENCE} SELECT case_id, {_LADDER} AS cause FROM e")
def root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    facts = {
        "carrier_down": (F.col("o_orderstatus") == "F").cast("double"), "no_link": (k % 5 == 0).cast("double"), "dropped": (k % 7).cast("double"), "hw_errors": (k % 3).cast("double"), "failed_logins": (k % 400).cast("double"),
        "lockouts": (F.col("o_orderpriority") == "1-URGENT").cast("double"), "denied": F.col("o_totalprice") / 100, "internal": (k % 4 < 3).cast("double"), "leases": (F.col("o_orderpriority") == "5-LOW").cast("double"), "cpu": (k % 100).cast("double"),
    }
    rows = o.select(F.col("o_custkey").alias("case_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("evidence"), v.alias("value")) for n, v in facts.items()])).alias("e")).select("case_id", "e.*")
    return detect.infer(rows)


_CLAIMS = "x AS (SELECT s_suppkey AS id, ['lease', 'flow', 'arp'][s_suppkey % 3 + 1] AS fault, s_suppkey % 90 AS subject FROM supplier), r AS (SELECT user_id % 90 AS subject, ['lease', 'flow', 'arp'][event_id % 3 + 1] AS source, count(*) AS n FROM events WHERE event_type <> 'view' AND user_id % 4 <> 1 GROUP BY 1, 2), g AS (SELECT source, max(n) AS newest FROM r GROUP BY 1)"


@register(QUERIES, ORACLE, f"WITH {_CLAIMS} SELECT id, fault, CASE WHEN g.source IS NULL THEN 'unverifiable' WHEN r.n > 0 THEN 'confirmed' ELSE 'resolved' END AS state FROM x LEFT JOIN g ON g.source = x.fault LEFT JOIN r ON r.source = x.fault AND r.subject = x.subject")
def verified_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda n: F.element_at(F.array(*map(F.lit, ("lease", "flow", "arp"))), (n % 3 + 1).cast("int"))
    found = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), pick(F.col("s_suppkey")).alias("fault"), (F.col("s_suppkey") % 90).alias("subject"))
    recent = load(spark, sf_dir, "events").where("event_type <> 'view' AND user_id % 4 <> 1").select(pick(F.col("event_id")).alias("source"), (F.col("user_id") % 90).alias("subject"))
    return detect.verify(found, recent)


@register(
    QUERIES,
    ORACLE,
    """WITH e AS (SELECT n_nationkey AS host, '10.' || i || '.0.' || n_nationkey AS address, i::INT AS i FROM nation, range(0, 4) r(i)), a AS (SELECT * FROM e WHERE (host * 7 + i) % 5 <> 0), u AS (SELECT * FROM a WHERE (host + i) % 3 <> 0)
    SELECT e.host, string_agg(e.address, ',' ORDER BY e.address) FILTER (u.address IS NULL) AS missing, coalesce(string_agg(e.address, ',' ORDER BY e.address) FILTER (a.address IS NOT NULL AND u.address IS NULL), '') AS at_reboot FROM e LEFT JOIN a USING (host, i) LEFT JOIN u USING (host, i) GROUP BY 1 HAVING count(*) FILTER (u.address IS NULL) > 0""",
)
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("n_nationkey")
    wanted = load(spark, sf_dir, "nation").select(h.alias("host"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).withColumn("address", F.concat(F.lit("10."), "i", F.lit(".0."), "host"))
    now = wanted.where("(host * 7 + i) % 5 <> 0")
    return detect.preflight(wanted.select("host", "address"), now.where("(host + i) % 3 <> 0").select("host", "address"), now.select("host", "address"))


@register(
    QUERIES,
    ORACLE,
    """WITH x AS (SELECT event_id // 500 AS w, regexp_extract(line, 'from ([0-9.]+) port', 1) AS src FROM (SELECT event_id, CASE WHEN event_type <> 'click' THEN 'Failed password for root from 10.9.0.' || (user_id % 30) || ' port 22' ELSE 'Accepted password for joe from 10.9.0.' || (user_id % 30) || ' port 22' END AS line FROM events) WHERE line LIKE 'Failed password%')
    SELECT w AS time_window, src, count(*) AS failures FROM x GROUP BY 1, 2 HAVING count(*) >= 8""",
)
def shell_bruteforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    tail = F.concat(F.lit(" from 10.9.0."), F.col("user_id") % 30, F.lit(" port 22"))
    line = F.concat(F.when(F.col("event_type") != "click", "Failed password for root").otherwise("Accepted password for joe"), tail)
    return detect.shell_failures(e.select(F.expr("event_id div 500").alias("time_window"), line.alias("line")), 8)


@register(
    QUERIES,
    ORACLE,
    """SELECT 'dead_interface' AS fault, 'eth' || s_suppkey AS subject FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0
    UNION ALL SELECT 'failed_unit', n_name || '.service' FROM nation WHERE n_nationkey % 2 = 1 AND n_name NOT LIKE 'NATION_1%'""",
)
def host_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(F.lit("eth"), k).alias("interface")
    s = load(spark, sf_dir, "supplier")
    links, addresses = s.where("s_suppkey % 5 <> 0").select(name, F.when(k % 3 == 0, "UP").otherwise("DOWN").alias("state")), s.where("s_suppkey % 4 = 0").select(name, F.lit("10.0.0.1").alias("ipv4"))
    units = load(spark, sf_dir, "nation").where("n_nationkey % 2 = 1").select(F.concat("n_name", F.lit(".service")).alias("unit"))
    return detect.dead_interfaces(links, addresses).unionByName(detect.failed_units(units, ("NATION_1",)))


@register(
    QUERIES,
    ORACLE,
    """WITH s AS (SELECT ['lease', 'flow', 'arp'][i + 1] AS source, i FROM range(0, 3) r(i)), e AS (SELECT ['lease', 'flow', 'arp'][event_id % 3 + 1] AS source, max(ts) AS newest, count(*) AS n FROM events WHERE event_id % 3 < 2 GROUP BY 1), t AS (SELECT max(ts) AS now FROM events)
    SELECT s.source, coalesce(n, 0) AS n, CASE WHEN newest IS NULL THEN 'missing' WHEN epoch(now - newest) > 900 THEN 'stale' ELSE 'fresh' END AS state FROM s LEFT JOIN e USING (source), t""",
)
def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    seen = e.where("event_id % 3 < 2").select(F.element_at(F.array(*map(F.lit, ("lease", "flow", "arp"))), (F.col("event_id") % 3 + 1).cast("int")).alias("source"), "ts")
    return detect.freshness(seen, ["lease", "flow", "arp"], e.agg(F.max("ts")).first()[0], 900)
