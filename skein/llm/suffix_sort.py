"""The difference-cover suffix sort with every step a Spark job.

Each level sorts the triples at positions 1 and 2 modulo 3 by range partitioning, names them in
that order, recurses on the string of names until all differ, then merges the remaining suffixes
by two more sorts: with those at 1 modulo 3 by (character, rank of the next), with those at 2 by
(two characters, rank after them). A suffix's rank is the number of suffixes before it. No step
gathers more than one number for each partition; strings of up to LOCAL characters are sorted at
once, so that recursion ends.

A row a suffix and level makes this dear: see the README for what it takes beside
``suffix_dedup``, which brings equal strings together first and sorts only what may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import save, small_batches
from skein.llm.suffix_dedup import _hashes, suffix_array
from skein.llm.textbatch import hash_prefix

LOCAL = 1 << 16


def _counted(df: DataFrame, keys: list[str], weight: str, name: str) -> DataFrame:
    """``df`` with ``before``, the sum of ``weight`` over all rows before each in the order of ``keys``, and ``new``, whether its keys first occur.

    Range partitions are summed on their own; the totals of the partitions, one number each, are added up on the driver.
    """
    spark = df.sparkSession
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, last = 0, None
        for frame in batches:
            if not len(frame):
                continue
            own = frame[keys].to_numpy(np.int64)
            new = np.r_[True, (own[1:] != own[:-1]).any(1)]
            new[0] = last is None or tuple(own[0]) != last
            last = tuple(own[-1])
            worth = new.astype(np.int64) if weight == "new" else frame[weight].to_numpy(np.int64)
            upto = np.cumsum(worth)
            yield frame.assign(_p=frame["_p"], before=total + upto - worth, new=new)
            total += int(upto[-1])

    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id())
    parts = save(ranged.mapInPandas(run, f"{fields}, _p int, before long, new boolean"), name)
    worth = F.col("new").cast("long") if weight == "new" else F.col(weight)
    totals = sorted((r._p, r.n) for r in parts.groupBy("_p").agg(F.sum(worth).alias("n")).collect())
    offsets, at = [], 0
    for p, n in totals:
        offsets.append((p, at))
        at += n
    shift = spark.createDataFrame(offsets, "_p int, _o long")
    return parts.join(F.broadcast(shift), "_p").withColumn("before", F.col("before") + F.col("_o")).drop("_p", "_o")  # one row a partition


def _local(chars: DataFrame) -> DataFrame:
    rows = chars.orderBy("pos").collect()  # at most LOCAL
    order = suffix_array(np.array([r.c for r in rows], np.int64))
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.arange(len(rows))
    return chars.sparkSession.createDataFrame([(i, int(r)) for i, r in enumerate(rank)], "pos long, rank long")


def suffix_ranks(chars: DataFrame, n: int, local: int = LOCAL) -> DataFrame:
    """(pos, rank) of every suffix of (pos, c): positions 0..n-1, positive integers."""
    if n <= max(local, 3):
        return _local(chars)
    here = lambda d: F.max(F.when(F.col("d") == d, F.col("c")))
    spread = chars.select("c", F.explode(F.array(*[F.struct((F.col("pos") - d).alias("start"), F.lit(d).alias("d")) for d in range(3)])).alias("x")).select("c", "x.start", "x.d")
    triples = spread.where("start >= 0 AND start % 3 <> 0").groupBy("start").agg(*[F.coalesce(here(d), F.lit(0)).cast("long").alias(f"c{d}") for d in range(3)])
    if n % 3 == 1:  # a triple of nothing closes the first part
        triples = triples.union(chars.sparkSession.createDataFrame([(n, 0, 0, 0)], "start long, c0 long, c1 long, c2 long"))
    named = save(_counted(triples, ["c0", "c1", "c2"], "new", "triples").select("start", (F.col("before") + F.col("new").cast("long")).alias("name")), "names")
    one, count = (n + 2) // 3 if n % 3 == 1 else (n + 1) // 3, named.count()
    if named.agg(F.max("name")).first()[0] == count:
        ranks = named.select("start", F.col("name").alias("rank"))
    else:
        place = F.expr("start div 3") + F.when(F.col("start") % 3 == 2, one).otherwise(0)
        deeper = suffix_ranks(named.select(place.cast("long").alias("pos"), F.col("name").alias("c")), count, local)
        start = F.when(F.col("pos") < one, F.col("pos") * 3 + 1).otherwise((F.col("pos") - one) * 3 + 2)
        ranks = save(deeper.select(start.alias("start"), (F.col("rank") + 1).alias("rank")), "ranks")
    return _merged(chars, ranks, n)


def _merged(chars: DataFrame, ranks: DataFrame, n: int) -> DataFrame:
    """The ranks of all suffixes from those of the sampled ones."""
    # What belongs to positions 3 b .. 3 b + 4, gathered by b.
    tell = lambda at, v, k: F.array(F.struct(F.floor(at / 3).alias("b"), (at % 3).alias("o"), F.lit(k).alias("k"), v.alias("v")), F.struct((F.floor(at / 3) - 1).alias("b"), (at % 3 + 3).alias("o"), F.lit(k).alias("k"), v.alias("v")))
    said = chars.select(F.explode(tell(F.col("pos"), F.col("c").cast("long"), "c")).alias("x")).union(ranks.select(F.explode(tell(F.col("start"), F.col("rank"), "r")).alias("x")))
    value = lambda k, o: F.coalesce(F.max(F.when((F.col("k") == k) & (F.col("o") == o), F.col("v"))), F.lit(0)).alias(f"{k}{o}")
    rows = said.select("x.*").where("b >= 0 AND o <= 4").groupBy("b").agg(*[value("c", o) for o in range(4)], *[value("r", o) for o in (1, 2, 4)])
    rows = save(rows, "around")
    pos = lambda o: (F.col("b") * 3 + o).alias("pos")
    key = lambda c: F.col(c) if isinstance(c, str) else c

    def side(o: int, kind: int, *keys: str | Column) -> DataFrame:
        return rows.select(pos(o), *[key(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(kind).cast("long").alias("zero"), F.col(f"r{o}" if o else "c0").alias("own")).where(F.col("pos") < n)

    first = _counted(side(0, 1, "c0", "r1").union(side(1, 0, "c1", "r2")).withColumn("other", 1 - F.col("zero")), ["k0", "k1", "zero"], "zero", "merge")
    second = _counted(side(0, 1, "c0", "c1", "r2").union(side(2, 0, "c2", "c3", "r4")).withColumn("other", 1 - F.col("zero")), ["k0", "k1", "k2", "zero"], "zero", "merge")
    ones = _counted(first.select("pos", "k0", "k1", "zero", "other"), ["k0", "k1", "zero"], "other", "merge").where("zero = 1").select("pos", "before")
    twos = _counted(second.select("pos", "k0", "k1", "k2", "zero", "other"), ["k0", "k1", "k2", "zero"], "other", "merge").where("zero = 1").select("pos", "before")
    zeros = first.where("zero = 1").select("pos", "before").union(ones).union(twos)
    sampled = first.where("zero = 0").select("pos", "own", "before").union(second.where("zero = 0").select("pos", "own", "before"))
    # The empty suffix at n, sampled if n is 1 modulo 3, stands first among the sampled ones and is no suffix.
    less = 2 if n % 3 == 1 else 1
    placed = sampled.select("pos", (F.col("own") - less + F.col("before")).alias("rank"))
    return save(zeros.groupBy("pos").agg(F.sum("before").alias("rank")).union(placed), "suffixes")


def repeated_starts(texts: DataFrame, length: int, local: int = LOCAL) -> DataFrame:
    """(key, a): each start of a string of ``length`` bytes that also starts elsewhere in (key, text), by sorted suffixes.

    Null texts are empty; keys are distinct longs. Strings do not cross texts.
    """
    small_batches(texts.sparkSession)
    sized = texts.select("key", F.coalesce("text", F.lit("")).alias("text")).withColumn("size", (F.octet_length("text") + 1).cast("long"))
    placed = _counted(sized, ["key"], "size", "texts").select("text", "key", F.col("before").alias("offset"))

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, key, offset in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist(), batch.column("offset").to_pylist(), strict=True):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                m, fits = len(raw), max(0, len(raw) - length + 1)
                x, y = (np.zeros(m + 1, np.int64) for _ in range(2))
                if fits:
                    at = np.arange(fits)
                    x[:fits], y[:fits] = _hashes(raw, at, at + length, hash_prefix(raw)[0])
                c = np.r_[raw.astype(np.int64) + 2, 1]
                at = np.arange(m + 1)
                yield pa.RecordBatch.from_arrays([pa.array(at + offset), pa.array(c), pa.array(np.full(m + 1, key)), pa.array(at), pa.array(at < fits), pa.array(x), pa.array(y)], names=["pos", "c", "key", "a", "fits", "x", "y"])

    chars = save(placed.select("text", "key", "offset").mapInArrow(letters, "pos long, c long, key long, a long, fits boolean, x long, y long"), "letters")
    ranks = suffix_ranks(chars.select("pos", "c"), chars.count(), local)
    # Equal prefixes stand side by side: compare each with the next one's.
    rows = save(chars.where("fits").select("pos", "key", "a", "x", "y").join(ranks, "pos").select("rank", "key", "a", "x", "y"), "prefixes")
    after = rows.select((F.col("rank") - 1).alias("rank"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    before = rows.select((F.col("rank") + 1).alias("rank"), F.col("x").alias("px"), F.col("y").alias("py"))
    both = rows.join(after, "rank", "left").join(before, "rank", "left")
    return both.where("(x = nx AND y = ny) OR (x = px AND y = py)").select("key", "a")
