"""Windows and sequences over keyed, timed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.graph import settle


def sliding_distinct(rows: DataFrame, key: str, ts: str, value: str, seconds: int) -> DataFrame:
    """Per key the window of ``seconds`` (both ends in) with the most distinct values, the earliest on ties.

    Rows with one timestamp see each other.
    """
    at = F.unix_micros(F.col(ts))
    frame = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    seen = rows.withColumn("n_values", F.size(F.collect_set(value).over(frame)))
    return seen.groupBy(key).agg(F.max(F.struct(F.col("n_values"), (-at).alias("at"))).alias("w")).select(key, F.col("w.n_values").alias("n_values"), F.timestamp_micros(-F.col("w.at")).alias("window_end"))


def handovers(rows: DataFrame, key: str, ts: str, owner: str, tie: str) -> DataFrame:
    """(key, handovers, owners): how often the owner changes in time order."""
    before = F.lag(owner).over(Window.partitionBy(key).orderBy(ts, tie))
    return rows.withColumn("_b", before).groupBy(key).agg(F.count_if(F.col("_b").isNotNull() & (F.col("_b") != F.col(owner))).alias("handovers"), F.countDistinct(owner).alias("owners"))


def median_gap(rows: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """(key, n, median_gap) in seconds between rows that follow each other."""
    gap = (F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(Window.partitionBy(key).orderBy(ts, tie)))) / 1e6
    return rows.withColumn("_g", gap).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.median("_g"), 3).alias("median_gap"))


def leading(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows by ``order``, however many: a range-partitioned sort that is cut where its parts reach n.

    The sort is written where the session names a shared folder; only the sizes of its parts reach the
    driver. Without such a folder, on one machine, it is a plain limit.
    """
    if n <= 0:
        return rows.limit(0)
    if not rows.sparkSession.conf.get("spark.checkpoint.dir", None):
        return rows.orderBy(*order).limit(n)
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    left, cut = n, -1
    for r in sorted(placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a part of the sort
        if left <= r.n:
            cut = r.p
            break
        left -= r.n
    return placed.where((part < cut) | (part == cut) & (place < left)).drop("_at") if cut >= 0 else placed.drop("_at")


def top_per_group(rows: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """The ``n`` most frequent values of each group, ties by value."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def diverse_top(rows: DataFrame, kind: str, severity: str, tie: str, n: int) -> DataFrame:
    """The worst of every kind first, then by severity, ``n`` in all."""
    first = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(severity), tie))
    return rows.withColumn("_first", (first == 1).cast("int")).orderBy(F.desc("_first"), F.desc(severity), tie).limit(n).drop("_first")


def zscores(rows: DataFrame, group: str, value: str, epsilon: float = 1e-8) -> DataFrame:
    """(value - group mean) / (population deviation + epsilon) as ``advantage``."""
    w = Window.partitionBy(group)
    return rows.withColumn("advantage", F.round((F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + epsilon), 6))


def streaks(rows: DataFrame, key: str, ts: str, tie: str, flag: str) -> DataFrame:
    """(key, longest, current): runs of rows with a true flag, in time order."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    island = F.sum(F.when(F.col(flag), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("_i", island).groupBy(key, "_i").agg(F.count_if(flag).alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"), F.max_by("n", "_i").alias("current"))


def latest_regression(rows: DataFrame, key: str, ts: str, tie: str, value: str, ratio: float, delta: float) -> DataFrame:
    """Keys whose last value exceeds the median of those before by ``ratio`` times and by ``delta``."""
    order = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    marked = rows.withColumn("_r", F.row_number().over(order))
    both = marked.groupBy(key).agg(F.max(F.when(F.col("_r") == 1, F.col(value))).alias("latest"), F.median(F.when(F.col("_r") > 1, F.col(value))).alias("baseline"))
    return both.where((F.col("baseline") > 0) & (F.col("latest") >= ratio * F.col("baseline")) & (F.col("latest") - F.col("baseline") >= delta)).withColumn("baseline", F.round("baseline", 6))


def status_changes(rows: DataFrame, key: str, ts: str, tie: str, status: str) -> DataFrame:
    """(key, before, after) of the last two rows of each key, where the status differs."""
    order = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    last = rows.withColumn("after", F.col(status)).withColumn("before", F.lead(status).over(order)).withColumn("_r", F.row_number().over(order))
    return last.where("_r = 1 AND before <> after").select(key, "before", "after")


def peak_overlap(intervals: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """(group, peak): the most intervals open at once; one that ends when another starts is closed first."""
    edges = intervals.select(group, F.col(start).alias("t"), F.lit(1).alias("d")).union(intervals.select(group, F.col(end).alias("t"), F.lit(-1).alias("d")))
    open_ = F.sum("d").over(Window.partitionBy(group).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0))
    return edges.withColumn("_o", open_).groupBy(group).agg(F.max("_o").alias("peak"))


def sessions(rows: DataFrame, key: str, ts: str, gap: int, least: int = 1) -> DataFrame:
    """(key, start, end, n): groups of rows no further apart than ``gap`` seconds, with at least ``least`` rows."""
    w = F.session_window(F.col(ts), f"{gap} seconds")
    return rows.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
