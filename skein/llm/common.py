"""Shared helpers: shared scratch tables, connected components, table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
#: Bounds of an Arrow batch of whole texts; a batch holds one row at least.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

#: A key is hot when it holds more than one HOT_SHARE-th of all rows; it is then dealt over SALTS tasks.
HOT_SHARE, SALTS = 2000, 32
#: Rows of short keys that may be broadcast.
SMALL = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, one machine) is a temporary folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="skein-")
    return _OWN_DIR[app]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, which Spark holds off the heap at both ends of a task.

    Every operator that sends texts to Python calls this, so none depends on what ran before; what
    the session itself has set stays. The bounds change no result.
    """
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def hot_keys(counts: DataFrame, on: list[str], total: int) -> DataFrame:
    """The keys of ``counts`` (on..., n) with more than ``total / HOT_SHARE`` rows: fewer than HOT_SHARE of them."""
    return counts.where(F.col("n") > max(total // HOT_SHARE, 1)).select(*on)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` where the keys in ``hot`` may hold a large share of ``left``.

    Rows of hot keys are dealt over SALTS tasks and their partners repeated to each. ``hot`` comes
    from ``hot_keys``, so it is small enough to broadcast at any size. ``on`` columns are not null.
    """
    marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = left.join(marked, on, "left").withColumn("_salt", salt).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    again = right.join(marked, on, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return dealt.join(again.hint("merge"), [*on, "_salt"], how).drop("_salt")


def side_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a large table with one of unique keys that is broadcast up to SMALL rows.

    Above that the right side is repeated SALTS times and the left one dealt, so that a key with a
    large share of ``left`` is not one task's. The rows are the same either way.
    """
    if right.count() <= SMALL:
        return left.join(F.broadcast(right), on, how)
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an undirected graph given as edges (a, b) of longs.

    Alternates the large-star and small-star steps until the edge set stays the same. Each step
    is a map-side combined minimum per node and a join that deals hot nodes over several tasks;
    nothing but a count and a checksum reaches the driver. Self loops and null ends are ignored;
    repeated edges count once. Returns (node, component), one row per node of a proper edge,
    component the smallest node reachable.
    """
    edges = save(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    state = (edges.count(), None)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        hot = hot_keys(least, ["a"], 2 * state[0])
        # Large star: neighbours above a node are tied to the least of its neighbourhood.
        tied = spread_join(both, least.select("a", F.least("a", "m").alias("m")), ["a"], hot)
        large = save(tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), name)
        # Small star: a node and its smaller neighbours are tied to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = spread_join(large, low.select("a", "m"), ["a"], hot_keys(low, ["a"], state[0])).select(F.explode(ends).alias("e"))
        edges = save(small.select("e.a", "e.b").where("a <> b").distinct(), name)
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (seen.n, seen.s) == state:
            break
        state = (seen.n, seen.s)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
