"""Hard negatives of anchors in an embedding space, by one-dimensional distance keys.

Inner products become distances: every vector x gets one more component, sqrt(M^2 - |x|^2) with M
the largest norm, and an anchor q gets a zero, so that |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. The
augmented vectors are assigned to the nearest of a few pivots and stored sorted by (pivot, distance
to it), cut into blocks. For an anchor, a block of distances [lo, hi] around pivot p holds nothing
nearer than max(0, d(q', p) - hi, lo - d(q', p)): it scans blocks in the order of that bound, a few
more each round, until the next bound exceeds the distance of its k-th result, which certifies it.

Scores are integers and exact; distances only choose and certify blocks, with a margin for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import save, small_batches

PIVOTS, SAMPLE, ROUNDS_OF_MEANS = 32, 4_096, 5
#: Rows of a block: at least LEAST_BLOCK, more where there would be over MOST_BLOCKS of them, so the
#: directory of blocks (28 bytes each) that is broadcast stays under 8 MB at any size.
LEAST_BLOCK, MOST_BLOCKS = 1_024, 1 << 18
#: Anchors that meet a block together (fewer where the directory is long), and blocks of the first
#: round; each round takes GROW times as many.
CHUNK, FIRST, GROW = 256, 8, 8
#: Scores stay below this in size, so that a hundred times a score is exact in a double.
MOST_SCORE = 2.0**45
_NONE = np.iinfo(np.int64).max


def prepared(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(uid, vec_id, label, x): rows that take part, components as floor(scale * x), written once.

    Rows with a null label, a null vector, or a null or non-finite component take no part. A vector
    shorter than the longest is padded with zeros where it is used. Rows that repeat an id stay rows
    of their own; a null id comes after all others.
    """
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    x = F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    return save(kept.withColumn("uid", F.monotonically_increasing_id()), "vectors")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as a matrix, shorter rows padded with zeros."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dims).all():
        return flat.reshape(n, dims)
    out = np.zeros((n, dims))
    row = np.repeat(np.arange(n), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Space:
    """Pivots of the augmented space, fitted on a bounded sample. Small: PIVOTS x (dims + 1) numbers."""

    def __init__(self, sample: np.ndarray, most: float):
        self.dims, self.most = sample.shape[1], most
        x = self.augmented(sample)
        self.pivots = x[: min(PIVOTS, len(x))].copy()
        for _ in range(ROUNDS_OF_MEANS):
            own = self.distances(x).argmin(1)
            for p in range(len(self.pivots)):
                if (own == p).any():
                    self.pivots[p] = x[own == p].mean(0)
        #: What rounding may add to a distance.
        self.slack = 1e-6 * (1.0 + most)

    def augmented(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.most**2 - (x * x).sum(1), 0.0))
        return np.concatenate([x, rest[:, None]], 1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Distances of augmented rows to all pivots."""
        square = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None, :] - 2.0 * (x @ self.pivots.T)
        return np.sqrt(np.maximum(square, 0.0))

    def anchored(self, q: np.ndarray) -> np.ndarray:
        return self.distances(np.concatenate([q, np.zeros((len(q), 1))], 1))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a row of ``q`` has ``score``, rounded up."""
        return np.sqrt(np.maximum((q * q).sum(1) + self.most**2 - 2.0 * score, 0.0)) + self.slack


def fitted(rows: DataFrame) -> Space | None:
    """The space of ``rows``, None where there are none. The sample is of SAMPLE rows at most, by hash."""
    square = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    seen = rows.agg(F.max(square).alias("m"), F.max(F.size("x")).alias("d")).first()
    if seen.m is None:
        return None
    if seen.m >= MOST_SCORE:
        raise ValueError("components are too large: a squared norm reaches 2**45")
    dims = max(1, seen.d)
    sample = rows.orderBy(F.xxhash64("uid")).limit(SAMPLE).select("x").toArrow().column("x")
    return Space(_matrix(sample, dims), float(np.sqrt(seen.m)) * (1 + 1e-12))


def index(rows: DataFrame, space: Space, n: int) -> DataFrame:
    """(block, pivot, lo, hi, n, ids, uids, labels, x): blocks of consecutive rows in the order of (pivot, distance).

    Ranges are cut by (pivot, distance, uid), so that one vector in very many rows fills many blocks.
    """
    shared = rows.sparkSession.sparkContext.broadcast(space)
    size = max(LEAST_BLOCK, n // MOST_BLOCKS)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            d = space.distances(space.augmented(_matrix(batch.column("x"), space.dims)))
            own = d.argmin(1)
            columns = [batch.column(c) for c in ("uid", "vec_id", "label", "x")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(d)), own])], names=["uid", "vec_id", "label", "x", "pivot", "d"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, held = shared.value.dims, []

        def block(t: pa.Table) -> pa.RecordBatch:
            d, ids = t.column("d").to_numpy(), t.column("vec_id").fill_null(_NONE).to_numpy()
            # Rows of a block are in the order of their ids, so that positions break ties.
            at = np.lexsort((t.column("uid").to_numpy(), ids))
            parts = [ids, t.column("uid").to_numpy(), t.column("label").to_numpy(), _matrix(t.column("x"), dims)]
            whole = [pa.array([p[at].tobytes()], pa.binary()) for p in parts]
            return pa.RecordBatch.from_arrays([pa.array([t.column("pivot")[0].as_py()], pa.int32()), pa.array([float(d[0])]), pa.array([float(d[-1])]), pa.array([len(d)], pa.int32()), *whole], names=["pivot", "lo", "hi", "n", "ids", "uids", "labels", "x"])

        def cut(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            pivot = t.column("pivot").to_numpy()
            ends = [*(np.flatnonzero(pivot[1:] != pivot[:-1]) + 1), len(pivot)]
            start = 0
            for end in ends:
                while end - start >= size or (start < end and (last or end < len(pivot))):
                    yield block(t.slice(start, min(size, end - start)))
                    start = min(start + size, end)
            held[:] = [t.slice(start)] if start < len(pivot) else []

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) >= size:
                yield from cut(pa.concat_tables(held), False)
        if held and sum(map(len, held)):
            yield from cut(pa.concat_tables(held), True)

    keys = rows.select("uid", "vec_id", "label", "x").mapInArrow(keyed, "uid long, vec_id long, label long, x array<long>, pivot int, d double")
    ordered = keys.repartitionByRange("pivot", "d", "uid").sortWithinPartitions("pivot", "d", "uid")
    blocks = ordered.mapInArrow(packed, "pivot int, lo double, hi double, n int, ids binary, uids binary, labels binary, x binary")
    return save(blocks.withColumn("block", F.monotonically_increasing_id()), "distance-keys")


def first_of(scores: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``k`` wanted entries of each row, by score descending, then column."""
    low = -np.inf
    held = np.where(wanted, scores, low)
    if held.shape[1] > k:
        least = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        wanted = wanted & (held >= least[:, None])
    row, col = np.nonzero(wanted)
    value = np.unique(held[row, col], return_inverse=True)[1]
    order = np.lexsort((col, -value, row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


class Search:
    """One kind of search over the index: what a block gives an anchor, and how far an anchor must look."""

    def __init__(self, space: Space, directory: dict[str, np.ndarray], k: int, low: int = 0, high: int = 0):
        self.space, self.directory, self.k, self.low, self.high = space, directory, k, low, high

    def chunk(self) -> int:
        """Anchors whose bounds to all blocks are held at once: a few million numbers."""
        return max(1, min(CHUNK, (1 << 22) // max(1, len(self.directory["block"]))))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance that each block may hold for each anchor."""
        d = self.space.anchored(q)[:, self.directory["pivot"]]
        return np.maximum(np.maximum(d - self.directory["hi"], self.directory["lo"] - d), 0.0), d + self.directory["hi"]


def _wanted(search, asked: DataFrame, round_: int) -> DataFrame:
    """(block, anchors...) of this round: chunks of anchors beside each block that any of them has to scan next.

    ``asked`` has uid, label, x, reach (how far an anchor must look), skip (nearer than this there is
    nothing to find). Blocks go by (bound, place); a round takes its share of that order, within reach.
    """
    first = 0 if round_ == 0 else FIRST * (GROW**round_ - 1) // (GROW - 1)
    last = FIRST * (GROW ** (round_ + 1) - 1) // (GROW - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = search.value
        for batch in batches:
            for a in range(0, batch.num_rows, s.chunk()):
                part = batch.slice(a, s.chunk())
                q = _matrix(part.column("x"), s.space.dims)
                least, most = s.bounds(q)
                reach, skip = (part.column(c).to_numpy()[:, None] for c in ("reach", "skip"))
                order = np.argsort(least, axis=1, kind="stable")
                mine = np.zeros(least.shape, bool)
                np.put_along_axis(mine, order[:, first:last], True, axis=1)
                mine &= (least - s.space.slack <= reach) & (most + s.space.slack >= skip)
                uid, label, extra = part.column("uid").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("extra"), 5)
                for b in np.flatnonzero(mine.any(0)):
                    at = mine[:, b]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(s.directory["block"][b])]), *[pa.array([p[at].tobytes()], pa.binary()) for p in (uid, label, extra, q)]], names=["block", "auids", "alabels", "extra", "q"]
                    )

    return asked.select("uid", "label", "x", "reach", "skip", "extra").mapInArrow(run, "block long, auids binary, alabels binary, extra binary, q binary")


def _scanned(search, pairs: DataFrame, blocks: DataFrame, negatives: bool) -> DataFrame:
    """(uid, slot, score, id, ruid): for each anchor and block the first rows that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = search.value
        for batch in batches:
            for i in range(batch.num_rows):
                raw = {c: batch.column(c)[i].as_buffer() for c in ("ids", "uids", "labels", "x", "auids", "alabels", "extra", "q")}
                of = lambda c, kind=np.int64: np.frombuffer(raw[c], kind)  # noqa: B023, E731
                ids, uids, labels, auids, alabels = (of(c) for c in ("ids", "uids", "labels", "auids", "alabels"))
                x, q, extra = (of(c, np.float64).reshape(n, -1) for c, n in (("x", len(ids)), ("q", len(auids)), ("extra", len(auids))))
                score = q @ x.T
                same = alabels[:, None] == labels[None, :]
                if negatives:
                    found = []
                    for j in range(extra.shape[1]):
                        p = extra[:, j][:, None]  # NaN: no such positive
                        row, col = first_of(score, ~same & (s.low * p <= 100 * score) & (100 * score <= s.high * p), s.k)
                        found.append((row, col, np.full(len(row), j)))
                    row, col, slot = (np.concatenate(c) for c in zip(*found, strict=True))
                else:
                    row, col = first_of(score, same & (auids[:, None] != uids[None, :]), s.k)
                    slot = np.zeros(len(row), np.int64)
                if len(row):
                    told = pa.array(score[row, col].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(auids[row]), pa.array(slot.astype(np.int32)), told, pa.array(ids[col]), pa.array(uids[col])], names=["uid", "slot", "score", "id", "ruid"])

    both = pairs.join(blocks.select("block", "ids", "uids", "labels", "x").hint("merge"), "block")
    return both.mapInArrow(run, "uid long, slot int, score long, id long, ruid long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("uid", "slot").orderBy(F.desc("score"), "id", "ruid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _rounds(search: Search, asked: DataFrame, blocks: DataFrame, negatives: bool, name: str) -> DataFrame:
    """(uid, slot, score, id, ruid, rank) of the first ``k`` rows of each (anchor, slot): rounds of blocks until no anchor has a block left within its reach."""
    spark: SparkSession = asked.sparkSession
    shared, n = spark.sparkContext.broadcast(search), len(search.directory["block"])
    everything = spark.createDataFrame([], "uid long, slot int, score long, id long, ruid long, rank int")
    k, round_, seen = search.k, 0, 0
    while seen < n:
        pairs = save(_wanted(shared, asked, round_), f"{name}-pairs")
        seen += FIRST * GROW**round_
        round_ += 1
        found = _scanned(shared, pairs, blocks, negatives).unionByName(everything.drop("rank"))
        everything = save(_best(found, k), name)
        if seen >= n:
            break
        # The reach shrinks to the k-th score of the slot that is worst off; slots that lack rows keep theirs.
        worst = everything.where(F.col("rank") == k).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))  # five slots at most

        def shrink(batches: Iterator[pa.RecordBatch], done: int = seen) -> Iterator[pa.RecordBatch]:
            s = shared.value
            for whole in batches:
                for a in range(0, whole.num_rows, s.chunk()):
                    part = whole.slice(a, s.chunk())
                    q, extra = _matrix(part.column("x"), s.space.dims), _matrix(part.column("extra"), 5)
                    reach = part.column("reach").to_numpy(zero_copy_only=False).copy()
                    for i, kth in enumerate(part.column("kth").to_pylist()):
                        got = dict(kth or [])
                        slots = [j for j in range(5) if extra[i, j] == extra[i, j]] if negatives else [0]
                        # A slot that lacks rows looks on: to the end of its band, or everywhere.
                        if negatives or 0 in got:
                            lowest = min(float(got[j]) if j in got else s.low * extra[i, j] / 100 for j in slots)
                            reach[i] = min(reach[i], s.space.reach(q[i : i + 1], np.array([lowest]))[0])
                    least = np.sort(s.bounds(q)[0], axis=1)[:, done]
                    keep = np.flatnonzero(least - s.space.slack <= reach)
                    rows = part.select(["uid", "label", "x", "skip", "extra"]).take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(reach[keep])], names=[*rows.schema.names, "reach"])

        kind = "uid long, label long, x array<long>, skip double, extra array<double>, reach double"
        asked = save(asked.join(worst, "uid", "left").mapInArrow(shrink, kind), f"{name}-asked")
        if asked.isEmpty():
            break
    return everything


def mine(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, relabel: tuple[int, int] | None = None, scale: int = 256
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of hard negatives.

    ``vectors`` has vec_id, embedding and label; other columns are not read. Anchors are rows whose
    id is divisible by ``every``. An anchor's positives are the first ``positives`` (five at most)
    other rows of its label by score, then id; for each, the first ``negatives`` rows of other labels
    with low * positive_score <= 100 * score <= high * positive_score. With ``relabel`` (step, labels)
    ids divisible by step get label (label + 1) % labels first. All rows are searched and every result
    is exact; an anchor or positive without negatives gives no row. Repeated rows count as rows of
    their own, a null id is never an anchor and comes last on ties. Squared norms from 2**45 on are
    an error, as scores would not be exact.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    if not 0 < positives <= 5:
        raise ValueError("between one and five positives")
    if relabel:
        moved = F.when(F.col("vec_id") % relabel[0] == 0, (F.col("label") + 1) % relabel[1]).otherwise(F.col("label"))
        vectors = vectors.select("vec_id", "embedding", moved.alias("label"))
    rows = prepared(vectors.select("vec_id", "embedding", "label"), scale)
    space = fitted(rows)
    if space is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = index(rows, space, rows.count())
    told = blocks.select("block", "pivot", "lo", "hi").orderBy("pivot", "lo", "block").toArrow()  # MOST_BLOCKS rows at most, near enough
    directory = {c: told.column(c).to_numpy() for c in told.column_names}
    nobody = F.array(*[F.lit(float("nan"))] * 5)
    anchors = rows.where(F.col("vec_id") % every == 0)
    asked = anchors.select("uid", "label", "x", F.lit(float("inf")).alias("reach"), F.lit(0.0).alias("skip"), nobody.alias("extra"))
    near = _rounds(Search(space, directory, positives), asked, blocks, False, "positives")
    scores = near.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("s"))  # five at most
    listed = F.array(*[F.coalesce(F.try_element_at("s", F.lit(j)).cast("double"), F.lit(float("nan"))) for j in range(1, 6)])
    second = anchors.join(scores, "uid").select("uid", "label", "x", listed.alias("extra"))

    def spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, extra = _matrix(batch.column("x"), space.dims), _matrix(batch.column("extra"), 5)
                # Nothing counts that is nearer than the best positive or beyond the band of the last one.
                skip = space.reach(q, np.nanmax(extra, axis=1) * (high / 100)) - 2 * space.slack
                reach = space.reach(q, np.nanmin(extra, axis=1) * (low / 100))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach), pa.array(skip)], names=[*batch.schema.names, "reach", "skip"])

    asked = save(second.mapInArrow(spanned, "uid long, label long, x array<long>, extra array<double>, reach double, skip double"), "bands")
    hard = _rounds(Search(space, directory, negatives, low, high), asked, blocks, True, "negatives")
    pos = near.select("uid", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    neg = hard.select("uid", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = lambda c: F.when(F.col(c) == _NONE, F.lit(None)).otherwise(F.col(c)).cast("long").alias(c)
    joined = anchors.select("uid", F.col("vec_id").alias("anchor_id")).join(pos, "uid").join(neg, ["uid", "slot"])
    return joined.select("anchor_id", named("positive_id"), F.col("rank").cast("int").alias("rank"), named("negative_id"), "positive_score", "negative_score")


#: The contract's rows by DuckDB.
MINE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.u AS au, a.vec_id AS anchor_id, b.vec_id AS id, b.u AS bu, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.u <> b.u
), p AS (
  SELECT *, row_number() OVER (PARTITION BY au ORDER BY score DESC, id, bu) AS r FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.au, p.r ORDER BY s.score DESC, s.id, s.bu) AS rank
  FROM p JOIN s ON p.au = s.au AND p.r <= 5 AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
