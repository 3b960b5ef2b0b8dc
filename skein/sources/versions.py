"""A versioned record store on Parquet: an append-only change log, and checked snapshots.

There is one writer; a batch is one folder that is written whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(ValueError):
    """The store holds another version than the writer expected."""


def _hash(df: DataFrame, key: str):
    return F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in (key, "version", "event_offset")))), 256)


def current(log: DataFrame, key: str) -> DataFrame:
    """The latest version of each key."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("_v")).select(key, "_v.*")


def changes(log: DataFrame | None, records: DataFrame, key: str, expected: DataFrame | None = None) -> DataFrame:
    """The rows to append for ``records``: those that differ from the store, with the next version and offset.

    ``expected`` (key, version) names the versions the writer has read; any other version in the
    store raises Conflict, and nothing is returned. Repeated keys raise ValueError.
    """
    if not records.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"a {key} occurs twice")
    fresh = records.withColumn("_new", _hash(records, key))
    if log is None:
        known, last = None, 0
        out = fresh.withColumn("version", F.lit(1).cast("long"))
    else:
        state = current(log, key)
        known = state.select(key, F.col("version").alias("_have"), _hash(state, key).alias("_old"))
        last = log.agg(F.max("event_offset")).first()[0] or 0
        if expected is not None:
            wrong = expected.select(key, F.col("version").alias("_want")).join(known, key, "left").where(F.coalesce("_have", F.lit(0)) != F.col("_want"))
            if not wrong.isEmpty():
                raise Conflict(f"{wrong.count()} records have changed")
        out = fresh.join(known, key, "left").where("_old IS NULL OR _old <> _new").withColumn("version", F.coalesce(F.col("_have"), F.lit(0)) + 1).drop("_have", "_old")
    # Offsets grow and are unique; they need not be consecutive.
    return out.drop("_new").withColumn("event_offset", F.lit(last + 1) + F.monotonically_increasing_id())


def append(records: DataFrame, path: str, key: str, expected: DataFrame | None = None) -> int:
    """Append what has changed; the number of rows written."""
    spark = records.sparkSession
    try:
        log = spark.read.parquet(path)
    except Exception as e:  # no such path yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log = None
    rows = changes(log, records, key, expected)
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def events_after(log: DataFrame, offset: int, limit: int) -> DataFrame:
    """The next ``limit`` changes after ``offset``, in order."""
    return log.where(F.col("event_offset") > offset).orderBy("event_offset").limit(limit)


def save_snapshot(df: DataFrame, path: str) -> None:
    """Write ``df`` and, last, a manifest with its row count and an order-free checksum."""
    df.write.parquet(f"{path}/data")
    written = df.sparkSession.read.parquet(f"{path}/data")
    _sums(written).coalesce(1).write.json(f"{path}/manifest")


def _sums(df: DataFrame) -> DataFrame:
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("checksum"))


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Read a snapshot back; raises ValueError where rows do not match the manifest."""
    want = spark.read.schema("rows long, checksum string").json(f"{path}/manifest").first()
    df = spark.read.parquet(f"{path}/data")
    if want is None or tuple(_sums(df).first()) != tuple(want):
        raise ValueError("the snapshot does not match its manifest")
    return df
