"""Rule detectors over parsed lease, neighbour and login rows; each gives (fault, subject, severity, confidence, measured)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import net


def finding(rows: DataFrame, fault: str, subject: str, severity: str, confidence: float | Column, measured: Column) -> DataFrame:
    sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return rows.select(F.lit(fault).alias("fault"), F.col(subject).cast("string").alias("subject"), F.lit(severity).alias("severity"), sure.alias("confidence"), measured.cast("double").alias("measured"))


def duplicate_leases(leases: DataFrame, seconds: int = 300) -> DataFrame:
    """Addresses leased to two machines whose first or last stamps lie within ``seconds``."""
    claims = leases.groupBy("ip", "mac").agg(F.min(F.unix_seconds("ts")).alias("f"), F.max(F.unix_seconds("ts")).alias("l"))
    a, b = claims.select("ip", F.col("mac").alias("a"), F.col("f").alias("af"), F.col("l").alias("al")), claims.select("ip", F.col("mac").alias("b"), F.col("f").alias("bf"), F.col("l").alias("bl"))
    gap = F.least(*[F.abs(F.col(x) - F.col(y)) for x in ("af", "al") for y in ("bf", "bl")])
    pairs = a.join(b, "ip").where("a < b").withColumn("gap", gap).where(F.col("gap") <= seconds)
    return finding(pairs.groupBy("ip").agg(F.min("gap").alias("gap")), "duplicate_lease", "ip", "high", 0.9, F.col("gap"))


def churning_leases(leases: DataFrame, lease_seconds: int = 3600, least: int = 4, share: float = 0.05) -> DataFrame:
    """Segments whose machines renew far faster than their lease asks for."""
    from skein.operators.sequences import median_gap

    keyed = leases.withColumn("k", F.concat_ws("|", "ip", "mac"))
    gaps = median_gap(keyed, "k", "ts", "mac").where((F.col("n") >= least) & (F.col("median_gap") < share * lease_seconds))
    of = gaps.withColumn("segment", net.segment(F.substring_index("k", "|", 1))).groupBy("segment").agg(F.median("median_gap").alias("m"))
    return finding(of, "lease_churn", "segment", "medium", 0.8, F.col("m"))


def many_addresses(leases: DataFrame) -> DataFrame:
    """Machines with several addresses."""
    return finding(leases.groupBy("mac").agg(F.countDistinct("ip").alias("n")).where("n > 1"), "multi_address", "mac", "low", 0.7, F.col("n"))


def random_machines(leases: DataFrame, least: int = 2) -> DataFrame:
    """Segments with locally administered machine addresses."""
    local = leases.where(net.is_local_mac(F.col("mac"))).withColumn("segment", net.segment(F.col("ip")))
    return finding(local.groupBy("segment").agg(F.countDistinct("mac").alias("n")).where(F.col("n") >= least), "unmanaged_identity", "segment", "low", 0.6, F.col("n"))


def unmanaged(flows: DataFrame, leases: DataFrame) -> DataFrame:
    """Hosts that talk in a leased segment without a lease."""
    hosts = flows.where(net.is_host(F.col("srcip")) & ~net.is_structural(F.col("srcip"))).groupBy(F.col("srcip").alias("ip")).agg(F.count(F.lit(1)).alias("n"))
    served = leases.select(net.segment(F.col("ip")).alias("segment")).distinct()
    free = hosts.withColumn("segment", net.segment(F.col("ip"))).join(served, "segment", "left_semi").join(leases.select("ip").distinct(), "ip", "left_anti")
    return finding(free, "unmanaged_address", "ip", "medium", 0.75, F.col("n"))


def failed_logins(logins: DataFrame, least: int = 20) -> DataFrame:
    """Sources with at least ``least`` failed logins."""
    return finding(logins.where("NOT ok").groupBy("srcip").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "login_bruteforce", "srcip", "high", 0.95, F.col("n"))


def contradicted_owners(neighbours: DataFrame, leases: DataFrame) -> DataFrame:
    """Addresses that several machines answer for, or one that never leased them although others did."""
    known = leases.select("ip", F.lower("mac").alias("mac")).distinct()
    seen = neighbours.select("ip", F.lower("mac").alias("mac")).distinct().join(known.withColumn("_known", F.lit(1)), ["ip", "mac"], "left")
    owners = seen.groupBy("ip").agg(F.count(F.lit(1)).alias("n"), F.count("_known").alias("k"))
    held = owners.join(known.select("ip").distinct().withColumn("_leased", F.lit(True)), "ip", "left").where("n > 1 OR (_leased AND k = 0)")
    return finding(held, "duplicate_ip_static", "ip", "critical", F.when(F.col("n") > 1, 0.98).otherwise(0.9), F.col("n"))


def pool_pressure(stats: DataFrame, share: float = 0.8) -> DataFrame:
    """Pools whose latest row (pool, at, total, used) has at least ``share`` of its addresses in use; empty pools tell nothing."""
    last = stats.groupBy("pool").agg(F.max_by(F.struct("total", "used"), "at").alias("s")).select("pool", F.try_divide("s.used", "s.total").alias("u"), "s.total")
    return finding(last.where((F.col("total") > 0) & (F.col("u") >= share)), "pool_pressure", "pool", "high", 0.9, F.round("u", 3))


def session_clashes(clashes: DataFrame, least: int = 10) -> DataFrame:
    """Sources of at least ``least`` clashing sessions."""
    return finding(clashes.groupBy("srcip").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "session_tuple_clash", "srcip", "medium", 0.75, F.col("n"))


def report(parts: list[DataFrame], limit: int | None = None) -> DataFrame:
    """All findings, the worst first: severity, confidence, fault, subject."""
    rank = F.when(F.col("severity") == "critical", -1).when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    every = reduce(DataFrame.unionByName, parts).orderBy(rank, F.desc("confidence"), "fault", "subject")
    return every if limit is None else every.limit(limit)


def address_space(leases: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(segment, cell, state) of the 254 cells of each seen /24: contested, leased, unbound or silent."""
    held = leases.groupBy("ip").agg(F.countDistinct("mac").alias("owners"))
    seen = neighbours.select("ip").distinct().withColumn("seen", F.lit(True))
    segments = leases.select(net.segment(F.col("ip")).alias("segment")).union(neighbours.select(net.segment(F.col("ip")).alias("segment"))).where("segment <> ''").distinct()
    cells = segments.withColumn("cell", F.explode(F.sequence(F.lit(1), F.lit(254)))).withColumn("ip", F.concat(F.substring_index("segment", ".", 3), F.lit("."), "cell"))
    state = F.when(F.col("owners") > 1, "contested").when(F.col("owners") == 1, "leased").when(F.col("seen"), "unbound").otherwise("silent")
    return cells.join(held, "ip", "left").join(seen, "ip", "left").select("segment", "cell", state.alias("state"))


DETECTORS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (duplicate_leases, churning_leases, many_addresses, random_machines, unmanaged, failed_logins, contradicted_owners, pool_pressure, session_clashes)}


def infer(evidence: DataFrame) -> DataFrame:
    """(case_id, cause) of (case_id, evidence, value): the first rule that a case's evidence meets.

    Evidence is pivoted to one row a case with map-side combined aggregates; what a case lacks fails its rule.
    """
    of = lambda name, f: f(F.when(F.col("evidence") == name, F.col("value"))).alias(name)
    e = evidence.groupBy("case_id").agg(
        of("carrier_down", F.max), of("no_link", F.max), of("dropped", F.sum), of("hw_errors", F.max), of("failed_logins", F.sum), of("lockouts", F.sum), of("denied", F.sum), of("internal", F.avg), of("leases", F.sum), of("cpu", F.max)
    )
    c = F.col
    ladder = (
        F.when((c("carrier_down") == 1) & (c("no_link") == 1), "carrier_down").when((c("dropped") > 0) & (c("hw_errors") == 0), "benign_rx_dropped")
        .when((c("failed_logins") >= 1000) & (c("lockouts") >= 1), "admin_bruteforce_lockout").when((F.round("denied") >= 10000) & (c("internal") >= 0.5), "internal_policy_deny_expected")
        .when(c("leases") > 0, "dhcp_service_healthy").when(c("cpu") < 60, "firewall_resource_healthy").otherwise("unknown")
    )
    return e.select("case_id", ladder.alias("cause"))


def verify(findings: DataFrame, recent: DataFrame) -> DataFrame:
    """(id, fault, state) of (id, fault, subject) against recent (source, subject): a finding whose source tells
    nothing of late is unverifiable, else confirmed if its subject is seen again, else resolved."""
    told = recent.select(F.col("source").alias("fault"), F.lit(True).alias("_told")).distinct()
    seen = recent.select(F.col("source").alias("fault"), "subject", F.lit(True).alias("_seen")).distinct()
    rows = findings.join(told, "fault", "left").join(seen, ["fault", "subject"], "left")
    return rows.select("id", "fault", F.when(F.col("_told").isNull(), "unverifiable").when(F.col("_seen"), "confirmed").otherwise("resolved").alias("state"))


def preflight(wanted: DataFrame, durable: DataFrame, live: DataFrame) -> DataFrame:
    """(host, missing, at_reboot) of (host, address) rows: wanted addresses that no durable setting holds, and
    those of them that are live now and would go with a reboot. Hosts without such are left out."""
    rows = wanted.join(durable.withColumn("_d", F.lit(True)), ["host", "address"], "left").join(live.withColumn("_l", F.lit(True)), ["host", "address"], "left").where("_d IS NULL")
    said = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return rows.groupBy("host").agg(said("address").alias("missing"), said(F.when(F.col("_l"), F.col("address"))).alias("at_reboot"))


def shell_failures(lines: DataFrame, least: int = 8) -> DataFrame:
    """(time_window, src, failures) of (time_window, line): sources with at least ``least`` failed passwords in a window."""
    src = F.regexp_extract("line", r"from ([0-9.]+) port", 1)
    failed = lines.where(F.col("line").startswith("Failed password")).groupBy("time_window", src.alias("src")).agg(F.count(F.lit(1)).alias("failures"))
    return failed.where(F.col("failures") >= least)


def dead_interfaces(links: DataFrame, addresses: DataFrame) -> DataFrame:
    """(fault, subject): interfaces with an address that are not up."""
    down = links.where("state <> 'UP'").join(addresses.where("ipv4 IS NOT NULL").select("interface").distinct(), "interface", "left_semi")
    return down.select(F.lit("dead_interface").alias("fault"), F.col("interface").alias("subject"))


def failed_units(units: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """(fault, subject): failed units but those whose name begins with an allowed prefix."""
    fine = reduce(lambda a, b: a | b, [F.col("unit").startswith(p) for p in allowed], F.lit(False))
    return units.where(~fine).select(F.lit("failed_unit").alias("fault"), F.col("unit").alias("subject"))


def freshness(seen: DataFrame, sources: list[str], now, seconds: int) -> DataFrame:
    """(source, n, state): each stated source is missing, stale beyond ``seconds`` before ``now``, or fresh."""
    every = seen.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    last = seen.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("newest"))
    late = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("newest") > seconds * 1_000_000
    return every.join(last, "source", "left").select("source", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("newest").isNull(), "missing").when(late, "stale").otherwise("fresh").alias("state"))
