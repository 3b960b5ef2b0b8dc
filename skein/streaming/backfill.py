"""Catching up with rotated logs, and what is still to be done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from skein.sources import syslog


def backfill(spark: SparkSession, logs: str, out: str, log: str, files: int = 100, keep: str = r'type="?traffic|subtype="?voip') -> StreamingQuery:
    """Append the flow facts of all log files under ``logs`` (gzip or plain) that were not taken yet, and stop.

    Files go by their time, the oldest first, ``files`` a batch; ``log`` is the commit log: a file is
    taken once, and what a stopped run has written without committing is written again in its place
    and not read twice. Lines are told apart before they are parsed; facts go by day.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files).option("latestFirst", False).text(logs).select(F.col("value").alias("line"))
    facts = syslog.facts(syslog.parse(lines.where(F.col("line").rlike(keep)))).withColumn("event_date", F.to_date("ts"))
    return facts.writeStream.format("parquet").option("checkpointLocation", log).partitionBy("event_date").outputMode("append").trigger(availableNow=True).start(out)


def pending(log: DataFrame, offset: int, by: str = "event_offset") -> bool:
    """Whether a change log holds anything past ``offset``: one row is looked for, none counted."""
    return not log.where(F.col(by) > offset).select(by).limit(1).isEmpty()


def snapshot_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change) of two snapshots with unique keys: ``added``, ``removed`` or ``changed``; what is alike is left out.

    Rows are told apart by a hash of all common columns; a null is a value like any other.
    """
    shared = sorted(set(before.columns) & set(after.columns) - {key})
    mark = lambda df, name: df.select(key, F.xxhash64(F.to_json(F.struct(*[f"`{c}`" for c in shared]), {"ignoreNullFields": "false"})).alias(name))
    both = mark(before, "_b").join(mark(after, "_a"), key, "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_b") != F.col("_a"), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def lit_path(delta: DataFrame, after: DataFrame, key: str, ts: str, path: str) -> DataFrame:
    """(path): that of the newest added item, the lesser key on ties; nothing added, no row."""
    return delta.where("change = 'added'").join(after, key).orderBy(F.desc(ts), key).limit(1).select(path)


def tail_rate(events: DataFrame, key: str, ts: str, last: int = 200) -> DataFrame:
    """(key, n, per_second) of each key's last ``last`` events: steps between them over the time they span; null where that is none."""
    from pyspark.sql import Window

    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts)))
    rows = events.select(key, ts).withColumn("_r", newest).where(F.col("_r") <= last)
    span = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1_000_000
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), span.alias("_s")).select(key, "n", F.round(F.when(F.col("_s") > 0, (F.col("n") - 1) / F.col("_s")), 6).alias("per_second"))
