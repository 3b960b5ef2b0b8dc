"""Key-value log lines, neighbour tables and JSON ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

PAIR = r'(\w+)=("(?:[^"\\]|\\.)*"|\S+)'


def fields(line: Column) -> Column:
    """The line's pairs as a map, quotes taken off; of repeated keys the last holds. Any line parses."""
    keys, values = (F.regexp_extract_all(line, F.lit(PAIR), F.lit(i)) for i in (1, 2))
    bare = lambda v: F.when(F.startswith(v, F.lit('"')) & F.endswith(v, F.lit('"')) & (F.length(v) > 1), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    pairs = F.struct(keys.alias("k"), F.transform(values, bare).alias("v"))
    # Hardly a line repeats a key; one that does takes each key's last place.
    last = lambda p: F.transform(F.array_distinct(p["k"]), lambda k: F.element_at(p["v"], (F.size(p["k"]) - F.array_position(F.reverse(p["k"]), k) + 1).cast("int")))
    made = F.transform(F.array(pairs), lambda p: F.when(F.size(F.array_distinct(p["k"])) == F.size(p["k"]), F.map_from_arrays(p["k"], p["v"])).otherwise(F.map_from_arrays(F.array_distinct(p["k"]), last(p))))
    return F.element_at(made, 1)


def parse(lines: DataFrame) -> DataFrame:
    """``lines`` (line) with ``fields``. The generator keeps the map from being built once a use."""
    return lines.withColumn("fields", F.explode(F.array(fields(F.col("line")))))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, fields) of text files, plain or gzip, of the lines that hold a pair."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return parse(lines).where(F.size("fields") > 0)


# Ports of recorders, and the categories of log descriptions.
RECORDER_PORTS = ("37777", "37778", "37809", "37810")
CATEGORIES = {
    "Admin login failed": "admin_login_failed",
    "Admin login disabled": "admin_login_disabled",
    "session clash": "session_clash",
    "DHCP Ack log": "dhcp_ack",
    "DHCP statistics": "dhcp_statistics",
    "FortiGate update succeeded": "fortigate_update",
    "System performance statistics": "perf_stats",
}


def category(f: Column) -> Column:
    """The signal category: by description, else by action and port; null if neither tells."""
    described = F.trim(f["logdesc"])
    out = F.when(F.lit(False), F.lit(""))
    for text, name in CATEGORIES.items():
        out = out.when(described == text, name)
    action = F.trim(f["action"])
    out = out.when((action == "deny") & f["dstport"].isin(*RECORDER_PORTS), "device_port_probe").when(action == "deny", "policy_deny")
    return out.when(action.isin("accept", "permit"), "traffic_accept")


def facts(lines: DataFrame) -> DataFrame:
    """Flow facts of (fields): traffic and voip lines only, bad ports as 0, missing bytes as 0."""
    f = F.col("fields")
    port = f["dstport"].try_cast("int")
    whole = lambda k: F.coalesce(f[k].try_cast("bigint"), F.lit(0))
    at = F.coalesce(F.timestamp_micros(F.floor(f["eventtime"].try_cast("bigint") / 1000)), F.try_to_timestamp(F.concat_ws(" ", f["date"], f["time"])))
    return lines.where(f["type"].isin("traffic", "voip")).select(
        at.alias("ts"), f["srcip"].alias("srcip"), f["dstip"].alias("dstip"), F.when(port.between(0, 65535), port).otherwise(0).alias("dstport"), f["action"].alias("action"), whole("sentbyte").alias("sent"), whole("rcvdbyte").alias("received")
    )


def select_lines(rows: DataFrame, start=None, end=None, filters: dict[str, str] | None = None) -> DataFrame:
    """Parsed rows (fields) whose fields equal ``filters`` and whose date and time lie in [start, end].

    A bound leaves out rows that have no time; rows without a filtered field never fit.
    """
    f = F.col("fields")
    at = F.try_to_timestamp(F.concat_ws(" ", f["date"], f["time"]))
    for name, value in (filters or {}).items():
        rows = rows.where(f[name] == value)
    if start is not None:
        rows = rows.where(at >= F.lit(start))
    return rows if end is None else rows.where(at <= F.lit(end))


def tail(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` rows by ``order``, kept as a partial top n by each task before the merge."""
    return rows.orderBy(F.desc(order)).limit(n)


def write_facts(rows: DataFrame, path: str) -> None:
    rows.withColumn("event_date", F.to_date("ts")).write.mode("append").partitionBy("event_date").parquet(path)


def neighbours(line: Column) -> Column:
    """struct(ip, mac, interface) of a neighbour-table line in any of three dialects, null if none fits."""
    ip, mac = r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})", r"([0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5})"
    dialects = ((ip + r"\s+\d+\s+" + mac + r"\s+(\S+)", 1, 2, 3), (ip + r"\s+dev\s+(\S+)\s+lladdr\s+" + mac, 1, 3, 2), (r"\(" + ip + r"\)\s+at\s+" + mac + r".*\son\s+(\S+)", 1, 2, 3))
    found = [F.when(line.rlike(p), F.struct(F.regexp_extract(line, p, a).alias("ip"), F.lower(F.regexp_extract(line, p, b)).alias("mac"), F.regexp_extract(line, p, c).alias("interface"))) for p, a, b, c in dialects]
    return F.coalesce(*found)


def neighbour_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(ip, mac, interface) of a neighbour dump; a missing file is an empty table, which says nothing about health."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], "ip string, mac string, interface string")
    return lines.select(neighbours(F.col("value")).alias("n")).where("n IS NOT NULL").select("n.*")


def snapshot_age(spark: SparkSession, path: str, now, stale: int = 900) -> DataFrame:
    """(path, age_seconds, stale) of each file of a snapshot, by when it was written; no file, no row."""
    try:
        files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    except AnalysisException:
        return spark.createDataFrame([], "path string, age_seconds double, stale boolean")
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now)) - F.unix_micros("modificationTime")) / 1_000_000)
    return files.select("path", F.round(age, 1).alias("age_seconds"), (age > stale).alias("stale"))


def read_ledger(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """A JSON-lines ledger; a corrupt line fails the read, or is dropped where ``strict`` is off."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
