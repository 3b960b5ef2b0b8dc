"""MinHash near-duplicate search with circulant signatures.

1. One pass over the texts makes each document's shingle set, its circulant MinHash signature (two
   permutations of the 2**32 shingle codes; the second one, circularly shifted, gives every
   coordinate) and the keys of its bands. Documents with equal sets are one class from here on.
2. Classes that share a band key meet in a bucket. Pairs of a bucket whose signatures agree in at
   least ``MAYBE`` of the coordinates tie their classes into candidate groups. A bucket above
   ``BUCKET`` members is not gathered: each member is tied to its least one by an aggregation and
   a join, which can only enlarge groups.
3. Groups above ``BLOCK`` classes or ``BLOCK_BYTES`` of text are first compared with a few pivots of
   each group, in the tasks where the members lie. The members linked to the pivot with most
   links are one component already, and two of them need not be compared again.
4. The full sets of what is left meet in blocks bounded by classes and bytes, every pair of blocks
   with an open pair in a task of its own, where exact Jaccard links are found with one matrix
   product per block pair; only a spanning forest of the links leaves the task.
5. Connected components of the confirmed links.

With 24 bands of 4 rows a pair at similarity 0.8 shares no bucket with probability 3e-6, and
agrees in less than 0.55 of 96 coordinates with probability below 1e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import components, hot_keys, save, small_batches, spread_join
from skein.llm.textbatch import Words, distinct, mix, text_slices

BANDS, ROWS = 24, 4
COORDS = BANDS * ROWS
MAYBE = 0.55
BUCKET = 2048
BLOCK, BLOCK_BYTES = 1024, 8 << 20
PIVOTS = 16
_U32 = np.uint32


def _permute(x: np.ndarray, out: np.ndarray, tmp: np.ndarray) -> np.ndarray:
    """A fixed bijection of the 32-bit integers."""
    np.right_shift(x, _U32(16), out=tmp)
    np.bitwise_xor(x, tmp, out=out)
    out *= _U32(0x7FEB352D)
    np.right_shift(out, _U32(15), out=tmp)
    out ^= tmp
    out *= _U32(0x846CA68B)
    np.right_shift(out, _U32(16), out=tmp)
    out ^= tmp
    return out


def circulant_signatures(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """Signatures, one row of COORDS uint32 a document; rows of documents without shingles are all ones.

    Coordinate k is the least value of pi((sigma(x) + k) mod 2**32) over the shingle codes x.
    """
    sig = np.full((n_docs, COORDS), 0xFFFFFFFF, np.uint32)
    if not len(h):
        return sig
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    codes = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    tmp, val = np.empty_like(codes), np.empty_like(codes)
    sigma = _permute(codes ^ _U32(0x5BD1E995), np.empty_like(codes), tmp)
    shifted = np.empty_like(codes)
    for k in range(COORDS):
        np.add(sigma, _U32(k), out=shifted)
        sig[doc[starts], k] = np.minimum.reduceat(_permute(shifted, val, tmp), starts)
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    acc = np.zeros((len(sig), BANDS), np.uint64)
    rows = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    for j in range(ROWS):
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + rows[:, :, j] + np.uint64(1))
    return mix(acc + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column("doc_id"), batch.column("key")
            for a, b, raw, off in text_slices(batch.column("text")):
                doc, h = distinct(*Words(raw, off).shingles(k))
                n = b - a
                count = np.bincount(doc, minlength=n)
                first = np.concatenate([[0], np.cumsum(count)])
                sums = []
                for salt in (0x2545F4914F6CDD1D, 0xDA942042E4DD58B5):
                    total = np.concatenate([[0], np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
                    sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                sig = circulant_signatures(doc, h, n)
                keys = band_keys(sig)
                some = np.flatnonzero(count)
                lens = np.zeros(n + 1, np.int32)
                lens[1:] = np.cumsum(np.where(count > 0, BANDS, 0))
                low = np.ascontiguousarray((sig & _U32(255)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, n),
                        own.slice(a, n),
                        pa.array(count.astype(np.int64)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDS), n, [None, pa.py_buffer(low)]).cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(lens), pa.array(keys[some].ravel())),
                    ],
                    names=["doc_id", "key", "n_shingles", "set_a", "set_b", "sig", "keys"],
                )

    return run


def _groups(columns: list[str], each):
    """Batches sorted by ``key`` to whole runs of one key: ``each(frame)`` gets frames that no run crosses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for frame in batches:
            if not len(frame):
                continue
            key = frame["key"].to_numpy()
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if rest and rest[-1]["key"].iloc[-1] != key[0] or cut:
                yield each(pd.concat([*rest, frame.iloc[:cut]], ignore_index=True))
                rest = []
            rest.append(frame.iloc[cut:])
        if rest:
            yield each(pd.concat(rest, ignore_index=True))

    return run


def _maybe(frame: pd.DataFrame) -> pd.DataFrame:
    """Ties between members of a bucket, a forest of each bucket, from agreement of signatures."""
    if not len(frame):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    key, rep = frame["key"].to_numpy(), frame["rep"].to_numpy()
    sig = np.frombuffer(b"".join(frame["sig"]), np.uint8).reshape(len(frame), COORDS)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    least = MAYBE * COORDS
    two = start[size == 2]
    near = (sig[two] == sig[two + 1]).sum(1) >= least
    a, b = [rep[two][near]], [rep[two + 1][near]]
    for s, m in zip(start[size > 2], size[size > 2], strict=True):
        label = np.arange(m)
        own = sig[s : s + m]
        for i in range(m - 1):
            hit = np.flatnonzero((own[i + 1 :] == own[i]).sum(1) >= least) + i + 1
            new = hit[label[hit] != label[i]]
            while len(new):
                label[label == label[new[0]]] = label[i]
                a.append(rep[[s + i]])
                b.append(rep[[s + new[0]]])
                new = new[label[new] != label[i]]
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}, dtype="int64")


def _sets(k: int):
    """The columns of each row, its text replaced by its sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for a, b, raw, off in text_slices(batch.column("text")):
                doc, h = distinct(*Words(raw, off).shingles(k))
                cut = np.searchsorted(doc, np.arange(b - a + 1)) * 8
                shingles = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(h)]).cast(pa.binary())
                yield batch.slice(a, b - a).set_column(at, "shingles", shingles)

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _to_pivots(percent: int):
    """(component, rep, pivot) for each row and each pivot of its group that it is linked to."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for component, rep, own, pivots in zip(frame["component"], frame["rep"], frame["shingles"], frame["pivots"], strict=True):
                mine = np.frombuffer(own, np.uint64)
                found += [(component, rep, p["rep"]) for p in pivots if _linked(mine, np.frombuffer(p["shingles"], np.uint64), percent)]
            yield pd.DataFrame(found, columns=["component", "rep", "pivot"], dtype="int64")

    return run


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those j) of exact links between ``left`` and ``right`` rows."""
    size = np.array([len(s) for s in sets])
    own = left is right
    if len(sets) <= 12:
        for i in left:
            hits = []
            for j in right:
                if (i < j or not own) and 100 * min(size[i], size[j]) >= percent * max(size[i], size[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        hits.append(j)
            yield i, np.array(hits, np.int64)
        return
    # Codes of the shingles that at least two rows hold; the rest never meet.
    code, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = df > 1
    to = np.cumsum(shared) - 1
    keep = shared[inverse]
    row, col, width = row[keep], to[inverse[keep]], int(shared.sum())
    both = np.zeros((len(left), len(right)), np.float32)
    at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    for c in range(0, width, 4096):  # a block of the shingles at a time
        w = min(4096, width - c)
        x, y = np.zeros((len(left), w), np.float32), np.zeros((len(right), w), np.float32)
        part = (col >= c) & (col < c + w)
        r, q = row[part], col[part] - c
        m = at_left[r] >= 0
        x[at_left[r[m]], q[m]] = 1
        m = at_right[r] >= 0
        y[at_right[r[m]], q[m]] = 1
        both += x @ y.T
    for n, i in enumerate(left):
        inter = both[n].astype(np.int64)
        ok = 100 * inter >= percent * (size[i] + size[right] - inter)
        yield i, right[ok & (right > i) if own else ok]


def _verify(percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rep, side = frame["rep"].to_numpy(), frame["side"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
        everyone = np.arange(len(sets))
        one, two = everyone[side == 0], everyone[side == 1]
        if not len(two):
            two = one
        label, a, b = everyone.copy(), [], []
        for i, hits in _links(sets, one, two, percent):
            for j in hits:
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    a.append(rep[i])
                    b.append(rep[j])
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return run


def _ties(classes: DataFrame) -> DataFrame:
    """(a, b) ties between classes that share a bucket and may be similar."""
    exploded = classes.select("rep", F.explode("keys").alias("key"))
    shared = save(exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least")).where("n > 1"), "buckets")
    rows = exploded.join(shared.where(F.col("n") <= BUCKET).select("key"), "key").join(classes.select("rep", "sig"), "rep")
    near = rows.select("key", "rep", "sig").repartition("key").sortWithinPartitions("key", "rep").mapInPandas(_groups(["rep", "sig"], _maybe), "a long, b long")
    large = shared.where(F.col("n") > BUCKET)
    whole = spread_join(exploded, large.select("key", "least"), ["key"], large_keys(large)).where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    return near.union(whole.distinct())


def large_keys(large: DataFrame) -> DataFrame:
    """Keys to deal over tasks: those with over a HOT_SHARE-th of the members of all large buckets."""
    return hot_keys(large, ["key"], int(large.agg(F.sum("n")).first()[0] or 0))


def _placed(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each member once for each pair of blocks it takes part in: (rep, unit, side).

    ``groups`` are (rep, component, pivot), ``sizes`` (component, n, n_open, bytes): members of large
    groups that are linked to a pivot (not open) only meet those that are open.
    """
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    open_blocks = F.ceil(F.col("n_open") * F.col("blocks") / F.col("n")).cast("int")
    counted = sizes.select("component", "n", "n_open", blocks.alias("blocks")).withColumn("open", open_blocks)
    dealt = spread_join(groups, counted, ["component"], hot_keys(sizes, ["component"], int(sizes.agg(F.sum("n")).first()[0] or 0)))
    # Open blocks are 0..open-1, the others follow; a pair of blocks is work if one of it is open.
    h = F.xxhash64("rep")
    block = F.when(F.col("pivot").isNull(), F.pmod(h, F.col("open"))).otherwise(F.col("open") + F.pmod(h, F.col("blocks"))).cast("int")
    others = F.when(F.col("pivot").isNull(), F.sequence(F.lit(0), F.col("open") + F.when(F.col("n_open") < F.col("n"), F.col("blocks")).otherwise(0) - 1)).otherwise(
        F.when(F.col("open") > 0, F.sequence(F.lit(0), F.col("open") - 1))
    )
    return dealt.withColumn("block", block).withColumn("other", F.explode(others)).select(
        "rep", F.concat_ws(":", "component", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), (F.col("block") > F.col("other")).cast("int").alias("side")
    )


def _key(docs: DataFrame) -> Column:
    """doc_id, or a 64-bit hash of the text where it is null."""
    return F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(F.lit("text"), F.coalesce(docs["text"].cast("string"), F.lit(""))))


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """Components of near duplicates: (doc_id, n_shingles, component_id, kept), one row a row of ``docs``.

    Documents are linked when 100 * |A and B| >= percent * |A or B| on sets of ``shingle``-word
    shingles (A-Z read as a-z; a shorter text is one shingle). Null and empty texts have empty
    sets and no links. A component's id is the least doc_id in it; rows that share a doc_id count
    as one document. A null doc_id takes part through its text but names no component unless all
    members are null; of those the rows of one text are kept. Only doc_id and text are read,
    so further columns of any name are harmless. An empty table gives an empty result.
    """
    return _marked(docs, shingle, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _marked(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The result of ``near_duplicates`` and each row's ``_key``."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(docs).alias("key"), F.col("text").cast("string").alias("text"))
    sketch = save(docs.mapInArrow(_sketch(shingle), "doc_id long, key long, n_shingles long, set_a long, set_b long, sig binary, keys array<long>"), "sketch")
    classes = save(
        sketch.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.coalesce(F.min("doc_id"), F.min("key")).alias("rep"), F.first("sig").alias("sig"), F.first("keys").alias("keys")), "classes"
    )
    groups = save(components(_ties(classes), "ties").select(F.col("node").alias("rep"), "component"), "groups")
    # One text of each class that is in a group: the first of those with the least doc_id, or key.
    # The members are a share of all documents, so neither side is broadcast at any size.
    texts = docs.join(groups.select(F.col("rep").alias("key")).hint("merge"), "key").groupBy("key", F.xxhash64("text")).agg(F.first("text").alias("text"))
    texts = save(texts.select(F.col("key").alias("rep"), "text"), "texts")
    n = groups.count()
    weights = groups.join(texts.select("rep", F.octet_length("text").alias("size")), "rep")
    sizes = save(weights.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "sizes")
    large = save(sizes.where((F.col("n") > BLOCK) | (F.col("bytes") > BLOCK_BYTES)).select("component", "n"), "large")
    hot = hot_keys(large, ["component"], n)
    member = spread_join(groups, large.select("component"), ["component"], hot)
    # One pivot of each of PIVOTS hash ranges: bounded for a group of any size.
    part = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(PIVOTS))
    pivots = member.groupBy("component", part.alias("part")).agg(F.min_by("rep", F.xxhash64("rep")).alias("rep"))
    pivots = pivots.join(texts, "rep").select("component", "rep", "text").mapInArrow(_sets(shingle), "component long, rep long, shingles binary")
    pivots = pivots.groupBy("component").agg(F.collect_list(F.struct("rep", "shingles")).alias("pivots"))
    sets = member.join(texts, "rep").select("component", "rep", "text").mapInArrow(_sets(shingle), "component long, rep long, shingles binary")
    asked = spread_join(sets, pivots, ["component"], hot).select("component", "rep", "shingles", "pivots")
    linked = save(asked.mapInPandas(_to_pivots(percent), "component long, rep long, pivot long"), "pivots")
    votes = linked.groupBy("component", "pivot").agg(F.count(F.lit(1)).alias("n"))
    chosen = save(votes.groupBy("component").agg(F.max_by("pivot", F.struct("n", "pivot")).alias("pivot"), F.max("n").alias("n")), "chosen")
    closed = spread_join(linked, chosen.drop("n"), ["component", "pivot"], hot_keys(chosen, ["component", "pivot"], n)).select("rep", "pivot")
    placed = groups.join(closed, "rep", "left")
    opened = placed.groupBy("component").agg(F.count(F.when(F.col("pivot").isNull(), 1)).alias("n_open"))
    placed = _placed(placed, save(sizes.join(opened, "component"), "counted"))
    wanted = placed.join(texts, "rep").select("unit", "side", "rep", "text")
    links = wanted.mapInArrow(_sets(shingle), "unit string, side int, rep long, shingles binary").groupBy("unit").applyInPandas(_verify(percent), "a long, b long")
    links = links.union(linked.select(F.col("rep").alias("a"), F.col("pivot").alias("b")).where("a <> b"))
    found = save(components(links, "links"), "components")
    if classes.where("id IS NULL").isEmpty():
        found = found.withColumn("name", F.col("component"))
    else:  # the least node may stand for a null id
        names = found.join(classes.select("rep", "id"), F.col("node") == F.col("rep")).groupBy("component").agg(F.min("id").alias("name"))
        found = found.join(names, "component").select("node", F.coalesce("name", "component").alias("component"), "name")
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("set_a").alias("class_a"), F.col("set_b").alias("class_b"), F.coalesce("component", "rep").alias("head"), F.coalesce("name", "id").alias("named")
    )
    joined = sketch.join(named, (F.col("n_shingles") > 0) & (F.col("set_a") == F.col("class_a")) & (F.col("set_b") == F.col("class_b")), "left")
    # A null id that is a near copy of a row with an id has that id's key as its head.
    kept = (F.col("key") == F.coalesce("head", "key")) & F.col("doc_id").eqNullSafe(F.coalesce("named", "doc_id"))
    return joined.select("doc_id", "n_shingles", F.coalesce("named", "doc_id").alias("component_id"), kept.alias("kept"), "key")


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate component: that with the least doc_id.

    Rows that repeat a kept doc_id stay only once (the first by a hash of the text, then of the whole
    row). A component of null ids alone keeps one row; null ids without words all stay. Rows travel
    as structs, so columns of any name and type stay as they are.
    """
    marked = _marked(docs, shingle, percent)
    drop = save(marked.where("NOT kept").select("key").distinct(), "dropped")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(docs).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = rows.join(drop, "key", "left_anti").select("row", "key", "doc_id", "text")
    again = save(marked.where("kept AND (doc_id IS NOT NULL OR n_shingles > 0)").groupBy("key").count().where("count > 1").select("key"), "again")
    if not again.isEmpty():
        order = F.struct(F.xxhash64("text"), F.sha2(F.to_json("row"), 256))
        repeated = kept.join(again, "key", "left_semi").groupBy("doc_id", "key").agg(F.min_by("row", order).alias("row")).select("row")
        kept = kept.join(again, "key", "left_anti").select("row").unionByName(repeated)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
