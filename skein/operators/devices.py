"""Profiles of hosts, ties between them, and what a window of log lines amounts to."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import net
from skein.sources import syslog

# The weight of each kind of tie.
TIES = {"clash": 5.0, "bcast": 3.0, "codst": 2.4, "portfp": 1.8, "lease": 1.4, "family": 1.0, "fleet": 0.9}


def describe(hosts: DataFrame) -> DataFrame:
    """(ip, name, maker, role, family, band, side, segment) of (ip, mac, name, system, ports, denied)."""
    return hosts.select(
        "ip", "name", net.maker(F.col("mac")).alias("maker"), net.role(F.col("name"), F.col("system"), F.col("ports")).alias("role"), net.family(F.col("name")).alias("family"),
        net.threat_band(F.col("denied"), F.size(F.array_distinct("ports"))).alias("band"), net.side(F.col("ip")).alias("side"), net.segment(F.col("ip")).alias("segment"),
    )


def tie_weight(kind: str, hits: Column) -> Column:
    return F.round(TIES[kind] * F.log10(hits + 1) + TIES[kind] * 0.35, 3)


def group_ties(members: DataFrame, kind: str, by: list[str], low: int, high: int, hits: int = 1) -> DataFrame:
    """(src, dst, kind, weight, note): each pair of ``node``s in a group of ``low`` to ``high`` of them.

    Groups above the bound make no ties, so the self-join is bounded by it; sizes are counted first.
    """
    rows = members.where(F.col(by[-1]).isNotNull() & (F.col(by[-1]) != "")).select(*by, "node").distinct()
    sized = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(low, high)).drop("n")
    kept = rows.join(sized, by)
    a, b = kept.select(*by, F.col("node").alias("src")), kept.select(*by, F.col("node").alias("dst"))
    return a.join(b, by).where("src < dst").select("src", "dst", F.lit(kind).alias("kind"), tie_weight(kind, F.lit(hits)).alias("weight"), F.col(by[-1]).alias("note"))


def port_marks(flows: DataFrame, key: str = "node", port: str = "port") -> DataFrame:
    """(node, mark): a host's three most used ports, sorted; hosts with fewer than two have none. Ties go to the lesser port."""
    used = flows.groupBy(key, port).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), port))
    top = used.withColumn("_r", rank).where("_r <= 3").groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(port)), " ").alias("mark"), F.count(F.lit(1)).alias("n"))
    return top.where("n >= 2").select(key, "mark")


def strongest(ties: DataFrame, by: str, cap: int = 7) -> DataFrame:
    """The ties of each group kept greedily by weight (then src, dst, kind) while both ends have fewer than ``cap``.

    Greedy choice goes in order, so a group is one task: groups are segments, of at most 254 hosts.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["weight", "src", "dst", "kind"], ascending=[False, True, True, True])
        degree: dict[str, int] = {}
        keep = []
        for a, b in zip(frame["src"], frame["dst"], strict=True):
            ok = degree.get(a, 0) < cap and degree.get(b, 0) < cap
            keep.append(ok)
            if ok:
                degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        return frame[keep]

    return ties.groupBy(by).applyInPandas(run, ties.schema)


def _top(rows: DataFrame, key: Column, n: int, name: str) -> DataFrame:
    """One row: the ``n`` most frequent keys as key:count, the lesser key first on ties."""
    counts = rows.where(key.isNotNull() & (key != "")).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").limit(n)
    said = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "k"))), lambda x: F.concat_ws(":", x["k"], -x["m"]))
    return counts.agg(F.array_join(said, ",").alias(name))


def window_stats(rows: DataFrame) -> DataFrame:
    """One row of counters and top lists over (fields): what a described event is counts by its description, else by its action."""
    f = F.col("fields")
    said = rows.select(syslog.category(f).alias("kind"), f["srcip"].alias("src"), f["dstport"].alias("port"), f["action"].alias("action"))
    is_ = lambda *k: F.col("kind").isin(*k)
    denied = is_("policy_deny", "device_port_probe")
    totals = said.agg(
        F.count_if(is_("admin_login_failed") & (F.col("src") != "")).alias("login_failed"), F.countDistinct(F.when(is_("admin_login_failed"), F.col("src"))).alias("login_sources"),
        F.count_if(is_("admin_login_disabled")).alias("lockouts"), F.count_if(denied).alias("denied"), F.count_if(is_("traffic_accept")).alias("accepted"),
        F.count_if(is_("session_clash")).alias("clashes"), F.count_if(is_("dhcp_ack")).alias("leases"), F.count_if(is_("device_port_probe")).alias("device_denied"),
    )
    tops = [_top(said.where(denied), F.col("port"), 6, "denied_ports"), _top(said.where(denied), F.col("src"), 6, "denied_sources"), _top(said.where(is_("admin_login_failed")), F.col("src"), 6, "login_top")]
    for one in tops:  # one row each
        totals = totals.join(F.broadcast(one))
    return totals


def evidence_of(stats: DataFrame) -> DataFrame:
    """(evidence, value): what the counters of a window say, one row a claim."""
    total = F.col("denied") + F.col("accepted")
    rows = {
        "logins_per_source": F.round(F.col("login_failed") / F.greatest(F.col("login_sources"), F.lit(1)), 2), "deny_ratio": F.round(F.col("denied") / F.greatest(total, F.lit(1)), 3),
        "device_deny_share": F.round(F.col("device_denied") / F.greatest(F.col("denied"), F.lit(1)), 3), "lease_count": F.col("leases").cast("double"), "lockouts": F.col("lockouts").cast("double"),
    }
    return stats.select(F.explode(F.array(*[F.struct(F.lit(k).alias("evidence"), v.cast("double").alias("value")) for k, v in rows.items()])).alias("e")).select("e.*")


def portraits(flows: DataFrame) -> DataFrame:
    """(ip, out_hits, in_hits, denied, external, tags) of (src, dst, port, action): what a host does, by its totals."""
    out = flows.groupBy(F.col("src").alias("ip"), "dst").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "deny").alias("deny"))
    sent = out.groupBy("ip").agg(F.sum("n").alias("out_hits"), F.sum("deny").alias("out_deny"), F.count_if(net.side(F.col("dst")) == "external").alias("external"))
    got = flows.groupBy(F.col("dst").alias("ip")).agg(F.count(F.lit(1)).alias("in_hits"), F.count_if(F.col("action") == "deny").alias("in_deny"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    both = sent.join(got, "ip", "full").select("ip", zero("out_hits").alias("out_hits"), zero("in_hits").alias("in_hits"), (zero("out_deny") + zero("in_deny")).alias("denied"), zero("external").alias("external"))
    o, i, d, total = F.col("out_hits"), F.col("in_hits"), F.col("denied"), F.col("out_hits") + F.col("in_hits")
    tags = F.array_compact(
        F.array(
            F.when(F.col("external") > 0, "talks to WAN").otherwise("internal-only"), F.when((i > o * 3) & (i > 20), "server-like").when((o > i * 3) & (o > 20), "client-like"),
            F.when((d > total * 0.5) & (d > 20), "policy-denied"),
        )
    )
    return both.withColumn("tags", F.array_join(tags, ","))


def attackers(flows: DataFrame) -> DataFrame:
    """(segment, hits, sources, worst) of denied (src): attackers by their /24, the worst five sources listed."""
    each = flows.where("action = 'deny'").groupBy("src").agg(F.count(F.lit(1)).alias("n")).withColumn("segment", net.segment(F.col("src")))
    rank = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("n"), "src"))
    listed = F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "src"))))
    return each.withColumn("r", rank).groupBy("segment").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("sources"), F.array_join(F.transform(listed, lambda x: x["src"]), ",").alias("worst"))


def exposure(profiles: DataFrame) -> DataFrame:
    """(segment, hosts, exposed, roles): per subnet its hosts, those with an alarming band, and its mix of roles."""
    mix = profiles.groupBy("segment", "role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("band") != "ok").alias("bad"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role", "n"))), lambda x: F.concat_ws(":", x["role"], x["n"])), ",")
    return mix.groupBy("segment").agg(F.sum("n").alias("hosts"), F.sum("bad").alias("exposed"), said.alias("roles"))


def enrich(rows: DataFrame, machines: DataFrame, addresses: DataFrame) -> DataFrame:
    """``rows`` (mac, ip, ...) with ``owner``: by machine first, else by address; both sides have one owner a key."""
    m, a = machines.select("mac", F.col("owner").alias("_m")), addresses.select("ip", F.col("owner").alias("_a"))
    return rows.join(m, "mac", "left").join(a, "ip", "left").withColumn("owner", F.coalesce("_m", "_a")).drop("_m", "_a")


def ownership_drift(captures: DataFrame) -> DataFrame:
    """(ip, changes, last_from, last_to) of (ip, ts, mac): addresses whose machine differs from that of the capture before."""
    w = Window.partitionBy("ip").orderBy("ts", "mac")
    steps = captures.withColumn("before", F.lag("mac").over(w)).where("before IS NOT NULL AND before <> mac")
    last = lambda c: F.max_by(c, F.struct("ts", "mac"))
    return steps.groupBy("ip").agg(F.count(F.lit(1)).alias("changes"), last("before").alias("last_from"), last("mac").alias("last_to"))


def contested_share(samples: DataFrame) -> DataFrame:
    """(ip, owner, share, unreachable): how a contested address's samples fall to its owners; sole owners are left out."""
    total = samples.groupBy("ip").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("owner").alias("owners"), F.round(F.count_if(F.col("owner").isNull()) / F.count(F.lit(1)), 4).alias("unreachable")).where("owners > 1")
    held = samples.where("owner IS NOT NULL").groupBy("ip", "owner").agg(F.count(F.lit(1)).alias("k"))
    return held.join(total, "ip").select("ip", "owner", F.round(F.col("k") / F.col("n"), 4).alias("share"), "unreachable")


def dual_owners(rows: DataFrame, seconds: int = 60, late: str = "30 seconds") -> DataFrame:
    """A stream of (ip, ts, mac) to (ip, ts, macs): an address claimed by a second machine within ``seconds``.

    The state of an address is its claims of the last ``seconds``; it goes when the watermark has
    passed them, so state is bounded by the window and not by the stream.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get, strict=True)) if state.exists else []
        out = []
        fresh = sorted((t.value // 1000, m) for frame in frames for t, m in zip(frame["ts"], frame["mac"], strict=True))
        for at, mac in fresh:
            near = {m for t, m in held if abs(at - t) <= seconds * 1_000_000}
            if near - {mac}:
                out.append((key[0], pd.Timestamp(at, unit="us"), len(near | {mac})))
            held.append((at, mac))
        newest = max(t for t, _ in held)
        held = [(t, m) for t, m in held if newest - t <= seconds * 1_000_000]
        state.update(([t for t, _ in held], [m for _, m in held]))
        state.setTimeoutTimestamp(max(newest // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["ip", "ts", "macs"])

    marked = rows.withWatermark("ts", late)
    return marked.groupBy("ip").applyInPandasWithState(run, "ip string, ts timestamp, macs long", "times array<long>, macs array<string>", "append", "EventTimeTimeout")
