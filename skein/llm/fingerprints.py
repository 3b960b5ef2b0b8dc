"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

Each five-word shingle is hashed once: its top bits choose one of BINS bins, the rest is its value
there; a bin keeps its least value. An empty bin copies a bin that some other text filled, found
by a chain of hashes of the bin alone, so that equal bins of two texts are filled alike. The low
BITS bits of each bin are stored as hexadecimal. Two fingerprints that agree in a share m of
their bins are alike by (m - c) / (1 - c), c = 2**-BITS being the agreement of chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import small_batches
from skein.llm.textbatch import Words, mix, text_slices

BINS, BITS, SHINGLE = 256, 4, 5
#: Texts of about so many bytes are to be in one partition of the ordered walk.
PARTITION_BYTES = 64 << 20


def _chain() -> np.ndarray:
    """The bins an empty bin tries, in order: 2-universal hashes of the bin and the attempt."""
    bins, tries = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(1, 4 * BINS + 1, dtype=np.uint64), indexing="ij")
    return (mix(bins * np.uint64(0x9E3779B97F4A7C15) + tries * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(BINS)).astype(np.int64)


_TRIES = _chain()


def fingerprints(raw: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(bins of BITS low bits as uint8, whether the text has words) of each text of a slice."""
    n = len(off) - 1
    doc, h = Words(raw, off).shingles(shingle)
    low = np.full(n * BINS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    np.minimum.at(low, doc * BINS + (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), mix(h) >> np.uint64(1))
    low = low.reshape(n, BINS)
    filled = low != np.uint64(0xFFFFFFFFFFFFFFFF)
    some = filled.any(1)
    row, bin_ = np.nonzero(~filled & some[:, None])
    source, step = low.copy(), 0
    while len(row):
        at = _TRIES[bin_, step] if step < _TRIES.shape[1] else (bin_ + step) % BINS
        ok = filled[row, at]
        low[row[ok], bin_[ok]] = source[row[ok], at[ok]]
        row, bin_, step = row[~ok], bin_[~ok], step + 1
    # The bin takes part, so that copies of one value agree by chance in each bin anew.
    return (mix(low + np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << BITS) - 1)).astype(np.uint8), some


def pack(bins: np.ndarray, some: np.ndarray) -> list[str]:
    """The hexadecimal form; that of a text without words is empty."""
    packed = (bins[:, 0::2] << 4 | bins[:, 1::2]).astype(np.uint8)
    return [packed[i].tobytes().hex() if some[i] else "" for i in range(len(bins))]


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity; 1 for two texts without words, 0 for one of them."""
    c = 2.0**-BITS
    raw = np.clip(((a == b).mean(1) - c) / (1 - c), 0, 1)
    return np.where(some_a & some_b, raw, (some_a == some_b).astype(float))


def sketch(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint) of each row of ``docs``, without any exchange. Null and wordless texts: ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, off in text_slices(batch.column("text")):
                prints = pack(*fingerprints(raw, off, shingle))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


@dataclass
class Cuts:
    """The least (key, hash) of each range but the first, in order; range p follows cut p - 1."""

    key: np.ndarray
    hash: np.ndarray

    def place(self, key: np.ndarray, hash_: np.ndarray) -> np.ndarray:
        """The range of each row; only rows whose key is a cut's are told apart by their hash."""
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        tied = np.flatnonzero(low < high)
        for a in np.unique(low[tied]):
            own = tied[low[tied] == a]
            high[own] = a + np.searchsorted(self.hash[a : high[own[0]]], hash_[own], "right")
        return high

    def before(self, key: np.ndarray, hash_: np.ndarray) -> np.ndarray:
        """The range to which a row is the look-ahead: the one before, if the row is the least of its range; else -1."""
        part = self.place(key, hash_)
        at = np.maximum(part - 1, 0)
        least = (part > 0) & (self.key[at] == key) & (self.hash[at] == hash_) if len(self.key) else np.zeros(len(key), bool)
        return np.where(least, part - 1, -1)


def in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, text) dealt over ranges in order of (doc_id, hash of the text), each followed by a look-ahead.

    A range is one partition; behind its own rows (ahead = 0) come those with the least key of the
    next range (ahead = 1; the first range follows the last). The cuts, two numbers for each
    PARTITION_BYTES of text, come from a range partitioning of the keys alone; they are all that
    the driver and the tasks hold. Returns the rows with _part and ahead, and the number of ranges.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))).withColumn("_hash", F.xxhash64("text"))
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, min(size.n, -(-(size.bytes or 0) // PARTITION_BYTES)), min(size.n, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    ranged = keyed.select("_key", "_hash").repartitionByRange(parts, "_key", "_hash").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("_key", "_hash")).alias("m"))
    least = sorted((r.m._key, r.m._hash) for r in ranged.select("m").collect())
    shared = spark.sparkContext.broadcast(Cuts(np.array([k for k, _ in least[1:]], np.int64), np.array([h for _, h in least[1:]], np.int64)))
    first = least[0] if least else (0, 0)

    @F.pandas_udf("part int, before int")
    def ranges(key: pd.Series, hash_: pd.Series) -> pd.DataFrame:
        k, h = key.to_numpy(np.int64), hash_.to_numpy(np.int64)
        return pd.DataFrame({"part": shared.value.place(k, h), "before": shared.value.before(k, h)}, dtype="int32")

    # Only the two numbers of a row go to Python here.
    found = keyed.withColumn("_range", ranges("_key", "_hash"))
    last = F.when((F.col("_key") == first[0]) & (F.col("_hash") == first[1]), F.lit(max(len(least) - 1, 0)))
    before = F.coalesce(last, F.when(F.col("_range.before") >= 0, F.col("_range.before")))
    copies = F.array_compact(F.array(F.struct(F.col("_range.part").alias("_part"), F.lit(0).alias("ahead")), F.when(before.isNotNull(), F.struct(before.alias("_part"), F.lit(1).alias("ahead")))))
    dealt = found.withColumn("_copy", F.explode(copies)).select("doc_id", "text", "_hash", F.col("_copy._part").alias("_part"), F.col("_copy.ahead").alias("ahead"))
    return dealt, max(len(least), 1)


def _walk(shingle: int):
    empty = pd.DataFrame({"doc_id": pd.array([], "Int64"), "text": [], "_part": [], "ahead": []})

    def pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Results for all rows but the last, which is looked ahead to."""
        texts = [t if isinstance(t, str) else "" for t in rows["text"]]
        a = 0
        while a < len(texts) - 1:
            b, total = a, 0
            while b < len(texts) - 1 and (b == a or total < 1 << 20):
                total += len(texts[b])
                b += 1
            own, nxt = texts[a:b], texts[a + 1 : b + 1]
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(own, nxt, strict=True)]
            x, e = (fingerprints(*next(text_slices(pa.array(s, pa.large_string()), 1 << 40))[2:], shingle) for s in (texts[a : b + 1], edited))
            m = b - a
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"].iloc[a:b].array,
                    "n_chars": [len(t) for t in own],
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                    "fingerprint": pack(x[0][:m], x[1][:m]),
                    "edited_fingerprint": pack(*e),
                    "near_edited": likeness(x[0][:m], x[1][:m], *e),
                    "near_next": likeness(x[0][:m], x[1][:m], x[0][1:], x[1][1:]),
                    "ahead": rows["ahead"].iloc[a:b].to_numpy(),
                }
            )
            a = b

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = empty
        for frame in frames:
            if not len(frame):
                continue
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            rows = pd.concat([rest, frame], ignore_index=True) if len(rest) else frame.reset_index(drop=True)
            # Ranges may share a partition; none crosses into the next range's rows.
            part = rows["_part"].to_numpy()
            for cut in np.split(np.arange(len(rows)), np.flatnonzero(part[1:] != part[:-1]) + 1):
                for out in pairs(rows.iloc[cut].reset_index(drop=True)):
                    yield out[out["ahead"] == 0].drop(columns="ahead")
            rest = rows.iloc[-1:]
        # What is left is the look-ahead row itself.

    return run


def with_next(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness to it and the next one's.

    The next document is that with the next greater doc_id (rows with one doc_id follow each other
    by a hash of the text, then by text; null ids come first; after the last comes the first, so a single document is its own
    next). The edited text is the document with its last floor(n_chars / 2) code points replaced by
    the first as many (or all) of the next one. Texts cross the network once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    dealt, parts = in_order(docs)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.repartitionById(parts, "_part").sortWithinPartitions("_part", "ahead", "doc_id", "_hash", "text").mapInPandas(_walk(shingle), schema)
