"""Generations of tables under one root: whole or absent, checked, the last few kept.

A generation is a numbered folder of Parquet tables and, written last under its final name in one
rename, a manifest with the rows and an order-free checksum of each table. A folder without a
manifest is a torn write: readers do not see it and the next writer removes it. There is one writer.
All files go through Hadoop's file systems, so a root may be any store the session can write.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "MANIFEST.json"


class Corrupt(ValueError):
    """A generation's tables do not match its manifest."""


def _store(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _sums(df: DataFrame) -> tuple[int, str]:
    h = F.xxhash64(F.to_json(F.struct(*[f"`{c}`" for c in sorted(df.columns)]), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("s")).first()
    return r.n, r.s


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The whole generations, oldest first."""
    fs, where = _store(spark, root)
    if not fs.exists(where):
        return []
    found = []
    for status in fs.listStatus(where):  # a handful of folders
        name = status.getPath().getName()
        if name.startswith("generation-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), MANIFEST)):
            found.append(int(name.removeprefix("generation-")))
    return sorted(found)


def _folder(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/generation-{number:012d}"


def clear(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Remove torn writes and all but the last ``keep`` whole generations; the names that went."""
    if keep < 1:
        raise ValueError("one generation has to stay")
    fs, where = _store(spark, root)
    stay = {_folder("", n).lstrip("/") for n in numbers(spark, root)[-keep:]}
    gone = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("generation-") and s.getPath().getName() not in stay] if fs.exists(where) else []
    for path in gone:
        fs.delete(path, True)
    return sorted(p.getName() for p in gone)


def save(tables: dict[str, DataFrame], root: str, notes: dict | None = None, keep: int = 2) -> int:
    """Write the next generation and remove what is older than the last ``keep``; its number.

    ``tables`` may be made from the generation before: that stays readable until this one is whole.
    ``notes`` (small, JSON) go into the manifest.
    """
    if keep < 1:
        raise ValueError("one generation has to stay")
    spark = next(iter(tables.values())).sparkSession
    number = (numbers(spark, root) or [0])[-1] + 1
    folder = _folder(root, number)
    fs, where = _store(spark, folder)
    fs.delete(where, True)  # what a torn write of this number has left
    told = {}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        rows, checksum = _sums(spark.read.schema(df.schema).parquet(f"{folder}/{name}"))
        told[name] = {"rows": rows, "checksum": checksum, "schema": df.schema.jsonValue()}
    body = json.dumps({"number": number, "notes": notes or {}, "tables": told}, sort_keys=True).encode()
    part = spark._jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}.tmp")
    out = fs.create(part, False)
    try:
        out.write(bytearray(body))
    finally:
        out.close()
    if not fs.rename(part, spark._jvm.org.apache.hadoop.fs.Path(folder, MANIFEST)):
        raise OSError(f"no manifest could be written in {folder}")
    clear(spark, root, keep)
    return number


def manifest(spark: SparkSession, root: str, number: int | None = None) -> dict | None:
    """The manifest of a generation, the last by default; None where there is none."""
    every = numbers(spark, root)
    if not every or number is not None and number not in every:
        return None
    return json.loads(spark.read.text(f"{_folder(root, every[-1] if number is None else number)}/{MANIFEST}", wholetext=True).first()[0])


def load(spark: SparkSession, root: str, number: int | None = None, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a generation, the last by default; with ``verify`` their rows are checked against the manifest."""
    from pyspark.sql.types import StructType

    told = manifest(spark, root, number)
    if told is None:
        raise FileNotFoundError(f"no whole generation under {root}")
    out = {}
    for name, want in told["tables"].items():
        try:
            out[name] = spark.read.schema(StructType.fromJson(want["schema"])).parquet(f"{_folder(root, told['number'])}/{name}")
            got = _sums(out[name]) if verify else None
        except Exception as e:
            raise Corrupt(f"table {name} of generation {told['number']} cannot be read") from e
        if verify and got != (want["rows"], want["checksum"]):
            raise Corrupt(f"table {name} of generation {told['number']} does not match its manifest")
    return out
