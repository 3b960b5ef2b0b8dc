"""Approximate inner-product search by product-quantised residual codes.

A bounded sample fits coarse centres and, for what is left of a vector past its centre, a small
codebook for each group of dimensions. The index holds a byte a group for each row. A query turns
into one table of products a group, a row's approximate score is its centre's product plus one
look-up a group, and only the best few rows by that score are fetched and scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import retrieval
from skein.operators.graph import settle

#: Rows of an index block, queries that are broadcast together, and those of them that are scored at once.
BLOCK, ASKED, CHUNK = 4_096, 4_096, 256


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means centres of ``x``; a centre that loses all its rows takes one of the worst placed."""
    centre = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        gap = (centre * centre).sum(1)[None, :] - 2 * (x @ centre.T)
        own, worst = gap.argmin(1), gap.min(1) + (x * x).sum(1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(centre))
        empty = np.flatnonzero(n == 0)
        centre = total / np.maximum(n, 1)[:, None]
        if len(empty):
            centre[empty] = x[np.argsort(-worst)[: len(empty)]]
    return centre


class Codes:
    """Coarse centres and the codebooks of residuals: (cells + 256) x dimensions numbers at most."""

    def __init__(self, sample: np.ndarray, cells: int, groups: int, seed: int):
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        self.cuts = np.linspace(0, dims, min(groups, dims) + 1).astype(int)
        self.centre = _means(sample, min(cells, len(sample)), 12, rng)
        left = sample - self.centre[self.cell(sample)]
        self.books = [_means(left[:, a:b], min(256, len(left)), 12, rng) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def cell(self, x: np.ndarray) -> np.ndarray:
        return ((self.centre * self.centre).sum(1)[None, :] - 2 * (x @ self.centre.T)).argmin(1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, a byte a group) of each row."""
        own = self.cell(x)
        left = x - self.centre[own]
        codes = [((b * b).sum(1)[None, :] - 2 * (left[:, lo:hi] @ b.T)).argmin(1) for b, lo, hi in zip(self.books, self.cuts, self.cuts[1:], strict=False)]
        return own, np.stack(codes, 1).astype(np.uint8)

    def scores(self, q: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate products of queries with coded rows, of which each has its cell."""
        out = np.take(q @ self.centre.T, cells, axis=1)
        for g, (b, lo, hi) in enumerate(zip(self.books, self.cuts, self.cuts[1:], strict=False)):
            out += np.take(q[:, lo:hi] @ b.T, codes[:, g], axis=1)
        return out


def fit(vectors: DataFrame, cells: int | None = None, groups: int = 16, sample: int = 65_536, seed: int = 7) -> Broadcast | None:
    """Codes fitted on at most ``sample`` rows by a hash of their id: the only vectors that are collected.

    The sample is cut by the hash's own value, so no sort of all rows is needed. There are about as
    many cells as the square root of the rows, a sixteenth of the sample at most. None: no rows.
    """
    n = vectors.count()
    if not n:
        return None
    share = min(1.0, sample / n)
    some = vectors.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector").limit(sample)
    rows = _matrix(some.toArrow().column("vector").combine_chunks())
    if cells is None:
        cells = max(1, min(round(n**0.5 / 4), sample // 16))
    return vectors.sparkSession.sparkContext.broadcast(Codes(rows if len(rows) else np.zeros((1, 1)), cells, groups, seed))


def index(vectors: DataFrame, codes: Broadcast, salts: int = 8) -> DataFrame:
    """(cell, n, ids, codes): blocks of at most BLOCK coded rows of one cell; a full cell's rows are dealt over ``salts`` tasks."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, code = codes.value.encode(_matrix(batch.column("vector")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], names=["doc_id", "cell", "code"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)] if len(cell) else [0]
            for a, z in zip(edges, edges[1:], strict=False):
                for s in range(a, z, BLOCK):
                    part = batch.slice(s, min(BLOCK, z - s))
                    ids, code = part.column("doc_id").to_numpy().tobytes(), b"".join(part.column("code").to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array([int(cell[s])], pa.int32()), pa.array([part.num_rows], pa.int32()), pa.array([ids], pa.binary()), pa.array([code], pa.binary())], names=["cell", "n", "ids", "codes"])

    rows = vectors.select("doc_id", "vector").mapInArrow(coded, "doc_id long, cell int, code binary")
    dealt = rows.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).sortWithinPartitions("cell", "doc_id")
    return settle(dealt.mapInArrow(packed, "cell int, n int, ids binary, codes binary"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cell, id, code) of the rows of index blocks, as many blocks together as make BLOCK rows."""
    held, n = [], 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    for batch in batches:
        for cell, size, ids, code in zip(*(batch.column(x) for x in ("cell", "n", "ids", "codes")), strict=True):
            rows = size.as_py()
            held.append((np.full(rows, cell.as_py()), np.frombuffer(ids.as_py(), np.int64), np.frombuffer(code.as_py(), np.uint8).reshape(rows, -1)))
            n += rows
            if n >= BLOCK:
                yield joined()
                held, n = [], 0
    if held:
        yield joined()


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, short: int = 200, probed: float = 1.0, codes: Broadcast | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the first ``k`` by exact product of the ``short`` best by code.

    ``vectors`` (doc_id, vector), ``queries`` (query_id, vector), of one length; ``codes`` and ``blocks``
    are those of ``fit`` and ``index``, made here where they are not given. A query looks into the
    share ``probed`` of cells with the greatest products; all of them by default, since a code takes
    a byte a group where the row takes eight a dimension. No more than ``short`` rows a query are
    fetched and scored exactly. Queries are broadcast in blocks of ASKED; every task scores the blocks it
    reads, about BLOCK rows with CHUNK queries at once, and keeps ``short`` a query, so it holds no more
    than that at once and only ``short`` rows a query and task are shuffled, however many blocks there are.
    """
    codes = codes or fit(vectors)
    if codes is None:
        return retrieval.flat_search(vectors, queries, k)
    blocks = index(vectors, codes) if blocks is None else blocks
    context = vectors.sparkSession.sparkContext

    def look_up(part: list) -> DataFrame:
        shared = context.broadcast((np.array([r.query_id for r in part], np.int64), np.array([r.vector for r in part], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (ids, q), c = shared.value, codes.value
            if not len(ids):
                return
            probes = max(1, round(probed * len(c.centre)))
            wanted = None
            if probes < len(c.centre):
                wanted = np.zeros((len(ids), len(c.centre)), bool)
                np.put_along_axis(wanted, np.argsort(-(q @ c.centre.T), axis=1, kind="stable")[:, :probes], True, axis=1)
            score, name = np.full((len(ids), short), -np.inf), np.full((len(ids), short), retrieval.NONE)
            for cells, doc, code in _gathered(batches):
                for i in range(0, len(ids), CHUNK):
                    own = slice(i, i + CHUNK)
                    about = c.scores(q[own], cells, code)
                    if wanted is not None:
                        about[~wanted[own][:, cells]] = -np.inf
                    score[own], name[own] = retrieval._first(score[own], name[own], about, doc)
            told = (name != retrieval.NONE) & (score != -np.inf)
            for i in range(0, len(ids), CHUNK):
                own = told[i : i + CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i : i + CHUNK], own.sum(1))), pa.array(name[i : i + CHUNK][own]), pa.array(score[i : i + CHUNK][own])], names=["query_id", "doc_id", "about"])

        return blocks.mapInArrow(run, "query_id long, doc_id long, about double")

    met: DataFrame | None = None
    part: list = []
    for r in queries.select("query_id", "vector").toLocalIterator():
        part.append(r)
        if len(part) == ASKED:
            met = look_up(part) if met is None else met.unionByName(look_up(part))
            part = []
    if part or met is None:
        met = look_up(part) if met is None else met.unionByName(look_up(part))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("about"), "doc_id"))
    best = met.withColumn("_r", place).where(F.col("_r") <= short).select("query_id", "doc_id")
    both = best.join(queries.select("query_id", F.col("vector").alias("asked")), "query_id").join(vectors.select("doc_id", "vector"), "doc_id")
    dot = F.aggregate(F.zip_with("vector", "asked", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return retrieval.top(both.select("query_id", "doc_id", F.round(dot, 5).alias("score")), k)
