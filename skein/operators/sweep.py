"""One scan of a log for all tables the detectors need.

Every line gives its observations as typed rows (kind, subject, detail, ...) in one array; one
explode and one aggregation, summed within tasks first, make a single table of them. What grows with
the log is read once; detectors read the table, whose rows are distinct subjects. A further kind is
a further entry of the array, never a further scan or shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from skein.functions import net
from skein.operators import detect

#: The kinds, with the source each speaks for: an empty kind is a blind spot, not a clean one.
KINDS = {
    "ack": "dhcp_ack", "lease": "dhcp_ack", "hostname": "dhcp_ack", "interface": "dhcp_ack", "pool": "dhcp_stats", "clash": "session_clash", "clash_source": "session_clash",
    "login_failed": "admin_auth", "login_disabled": "admin_auth", "flow": "l3_flow", "traffic": None, "source": None, "corpus": None,
}
# Fixed value: where a session clash names its source.
CLASH_SOURCE = r"(\d+\.\d+\.\d+\.\d+):\d+->"


#: The fields that observations are made of.
USED = ("logdesc", "ip", "mac", "srcip", "dstip", "lease", "hostname", "interface", "total", "used", "type")


def _rows(f: dict[str, Column], line: Column) -> Column:
    """The observations of one line as an array of (kind, subject, detail, value)."""
    said = F.coalesce(f["logdesc"], F.lit(""))
    text = lambda c: F.coalesce(c, F.lit("")).cast("string")

    def row(kind: str, subject: Column, detail: Column | None = None, value: Column | None = None, when: Column | None = None) -> Column:
        one = F.struct(F.lit(kind).alias("kind"), text(subject).alias("subject"), text(F.lit("") if detail is None else detail).alias("detail"), (F.lit(None) if value is None else value).cast("string").alias("value"))
        return F.when(F.lit(True) if when is None else when, F.array(one)).otherwise(F.array().cast(kind_type))

    kind_type = "array<struct<kind: string, subject: string, detail: string, value: string>>"
    ip, mac = F.coalesce(f["ip"], f["srcip"]), F.lower(F.translate(f["mac"], "-", ":"))
    is_ack = (said == "DHCP Ack log") & (F.coalesce(ip, F.lit("")) != "") & (F.coalesce(mac, F.lit("")) != "")
    is_pool = (said == "DHCP statistics") & f["total"].try_cast("int").isNotNull() & f["used"].try_cast("int").isNotNull()
    is_clash = said == "session clash"
    inner = [c for c in ("srcip", "dstip")]
    sources = F.filter(F.regexp_extract_all(line, F.lit(CLASH_SOURCE), F.lit(1)), net.is_private)
    parts = [
        row("corpus", F.lit("")),
        row("ack", ip, mac, when=is_ack),
        row("lease", ip, value=f["lease"].try_cast("int"), when=is_ack & f["lease"].try_cast("int").isNotNull()),
        row("hostname", ip, value=f["hostname"], when=is_ack & (F.coalesce(f["hostname"], F.lit("N/A")) != "N/A")),
        row("interface", ip, value=f["interface"], when=is_ack & F.coalesce(f["interface"] != "", F.lit(False))),
        row("pool", F.coalesce(f["interface"], F.lit("unknown")), value=F.concat_ws("/", f["used"], f["total"]), when=is_pool),
        row("clash", F.lit(""), when=is_clash),
        F.when(is_clash, F.transform(sources, lambda s: F.struct(F.lit("clash_source").alias("kind"), s.alias("subject"), F.lit("").alias("detail"), F.lit(None).cast("string").alias("value")))).otherwise(F.array().cast(kind_type)),
        row("login_failed", F.coalesce(f["srcip"], F.lit("unknown")), when=said == "Admin login failed"),
        row("login_disabled", F.coalesce(f["srcip"], F.lit("unknown")), when=said == "Admin login disabled"),
        row("traffic", f["srcip"], when=F.coalesce(f["type"].isin("traffic", "voip"), F.lit(False)) & f["srcip"].isNotNull()),
        *[row("flow", f[c], when=f[f"inner_{c}"]) for c in inner],
        row("source", F.lit("dhcp_ack"), when=is_ack),
        row("source", F.lit("dhcp_stats"), when=is_pool),
        row("source", F.lit("session_clash"), when=is_clash),
        row("source", F.lit("admin_auth"), when=said.isin("Admin login failed", "Admin login disabled")),
        *[row("source", F.lit("l3_flow"), when=f[f"inner_{c}"]) for c in inner],
    ]
    return F.concat(*parts)


def observed(lines: DataFrame, order: str | None = None, counts: Observation | None = None) -> DataFrame:
    """(kind, subject, detail, n, first_seen, last_seen, value) of parsed ``lines`` (line, fields).

    ``value`` is the last one that was told, by ``order`` (a column of ``lines``), then by time; lines
    without pairs count for nothing. ``counts`` is filled with lines, first_seen and last_seen of the
    scan by whatever action runs first.
    """
    f = F.col("fields")
    at = F.try_to_timestamp(F.concat_ws(" ", f["date"], f["time"]))
    rows = lines.where(F.size(f) > 0).withColumn("_at", at)
    if counts is not None:
        rows = rows.observe(counts, F.count(F.lit(1)).alias("lines"), F.min("_at").alias("first_seen"), F.max("_at").alias("last_seen"))
    place = [F.col(order)] if order else []
    # The generator keeps each field from being looked up once a use.
    inner = {f"inner_{c}": F.coalesce(net.is_private(f[c]), F.lit(False)) for c in ("srcip", "dstip")}
    told = F.explode(F.array(F.struct(*[f[c].alias(c) for c in USED], *[c.alias(n) for n, c in inner.items()]))).alias("_f")
    plain = rows.select(F.struct(*place, F.col("_at")).alias("_o"), "_at", "line", told)
    typed = plain.select("_o", "_at", F.explode(_rows({c: F.col(f"_f.{c}") for c in (*USED, *inner)}, F.col("line"))).alias("r"))
    last = F.max(F.when(F.col("r.value").isNotNull(), F.struct(F.col("_o"), F.col("r.value").alias("v"))))
    return typed.groupBy("r.kind", "r.subject", "r.detail").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first_seen"), F.max("_at").alias("last_seen"), last["v"].alias("value"))


def of(seen: DataFrame, kind: str) -> DataFrame:
    """One kind's rows: the table of that name."""
    if kind not in KINDS:
        raise ValueError(f"no kind {kind}")
    return seen.where(F.col("kind") == kind).drop("kind")


def blind_spots(seen: DataFrame) -> DataFrame:
    """(source, told): each source that the log should speak for, and whether it said anything."""
    every = sorted({s for s in KINDS.values() if s})
    return seen.sparkSession.createDataFrame([(s,) for s in every], "source string").join(of(seen, "source").select(F.col("subject").alias("source"), F.lit(True).alias("_t")), "source", "left").select("source", F.coalesce("_t", F.lit(False)).alias("told"))


def findings(seen: DataFrame, logins: int = 20, lease_gap: int = 300, clashes: int = 10, pressure: float = 0.8) -> DataFrame:
    """The findings that the table of ``observed`` alone supports, the worst first.

    First and last times are all a lease pair needs, counts all the others do, so each detector reads
    distinct subjects, not the log.
    """
    acks = of(seen, "ack").select(F.col("subject").alias("ip"), F.col("detail").alias("mac"), F.explode(F.array("first_seen", "last_seen")).alias("ts"))
    leases = acks.where("ts IS NOT NULL OR ip IS NOT NULL")
    failed = of(seen, "login_failed").where(F.col("n") >= logins)
    talking = of(seen, "traffic").where(net.is_host(F.col("subject")) & ~net.is_structural(F.col("subject"))).select(F.col("subject").alias("ip"), "n")
    served = leases.select(net.segment(F.col("ip")).alias("segment")).distinct()
    free = talking.withColumn("segment", net.segment(F.col("ip"))).join(served, "segment", "left_semi").join(leases.select("ip").distinct(), "ip", "left_anti")
    pools = of(seen, "pool").select(F.col("subject").alias("pool"), F.lit(1).alias("at"), F.split("value", "/")[1].cast("int").alias("total"), F.split("value", "/")[0].cast("int").alias("used"))
    clashing = of(seen, "clash_source").where(F.col("n") >= clashes)
    return detect.report([
        detect.many_addresses(leases), detect.random_machines(leases), detect.duplicate_leases(leases, lease_gap), detect.pool_pressure(pools, pressure),
        detect.finding(failed, "login_bruteforce", "subject", "high", 0.95, F.col("n")), detect.finding(free, "unmanaged_address", "ip", "medium", 0.75, F.col("n")), detect.finding(clashing, "session_tuple_clash", "subject", "medium", 0.75, F.col("n")),
    ])
