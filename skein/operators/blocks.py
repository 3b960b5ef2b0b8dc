"""Rows that all have to meet: packed into blocks, of which a task meets two as arrays, so that pairs never become rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = 12  # into which rows are dealt, unless memory asks for more
CELLS = 1 << 20  # pairs looked at together
HEAVY = 200  # a term is heavy if one pair in so many shares it


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder where the session names one; else stay lazy."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number(count: int, small: int, large: int) -> int:
    """``count`` rows make a block for each ``small`` of them, no more than ``BLOCKS`` until a block would hold more than ``large``."""
    return max(min(BLOCKS, 1 + count // small), -(-count // large))


def packed(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """(_b, _rows): the rows of each block in the order of ``key``, as Arrow bytes. Rows of a key are in one block."""

    def pack(table: pa.Table) -> pa.Table:
        number, sink = table.column("_b")[0].as_py(), pa.BufferOutputStream()
        table = table.drop_columns(["_b"]).sort_by(key)
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return pa.table({"_b": pa.array([number], pa.int32()), "_rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    own = rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    dealt = own.repartition(4 * blocks if blocks > 1 else 1, "_b")
    return settle(dealt.groupBy("_b").applyInArrow(pack, "_b int, _rows binary"))


def meet(x: DataFrame, y: DataFrame | None, blocks: int, run: Callable[[pa.Table, pa.Table | None], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``run`` yields for each pair of a ``packed`` block of ``x`` and one of ``y``.

    Without ``y`` the ``blocks`` of ``x`` meet each other, each two once, and each meets itself: then the second table is None.
    Tasks read the blocks they meet, which are not shuffled.
    """
    i, j = F.col("_i"), F.col("_j")
    apart = F.pmod(j - i, F.lit(blocks))
    once = (apart * 2 < blocks) | ((apart * 2 == blocks) & (i < j))  # as many partners for each block
    left = x.select(F.col("_b").alias("_i"), F.col("_rows").alias("_x")).hint("shuffle_replicate_nl")
    right = (x if y is None else y).select(F.col("_b").alias("_j"), F.col("_rows").alias("_y"))
    itself = y is None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda cell: pa.ipc.open_stream(cell.as_buffer()).read_all()
        for batch in batches:
            for n in range(len(batch)):
                same = itself and batch.column("_i")[n].as_py() == batch.column("_j")[n].as_py()
                yield from run(read(batch.column("_x")[n]), None if same else read(batch.column("_y")[n]))
            del batch  # before the next one is read
        pa.default_memory_pool().release_unused()  # the worker stays

    return left.join(right, once if itself else F.lit(True)).mapInArrow(task, schema)


class Sets:
    """Sets of terms by id: their sizes ``n``, and (who, term) of their terms from ``start`` on, numbered alike for all sets made together.

    A null term counts in a set's size and is shared with no other.
    """

    def __init__(self, ids: pa.Array, lists: pa.Array, term: np.ndarray, known: np.ndarray):
        self.id, self.n = ids, lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.who = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)[known]
        self.term = term[known]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(self.who, minlength=len(self.n)))])


def sets(tables: list[pa.Table], key: str, items: str) -> tuple[list[Sets], int]:
    """The ``Sets`` of each table, and how many terms they have together."""
    whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    lists = [whole(t.column(items)) for t in tables]
    flat = pa.chunked_array([x.flatten() for x in lists]).combine_chunks().dictionary_encode()
    flat = whole(flat)
    known = flat.indices.is_valid().to_numpy(zero_copy_only=False)
    term = flat.indices.fill_null(0).to_numpy().astype(np.int32)
    out, at = [], 0
    for t, x in zip(tables, lists, strict=True):
        end = at + len(x.flatten())
        out.append(Sets(whole(t.column(key)), x, term[at:end], known[at:end]))
        at = end
    return out, len(flat.dictionary)


def shared(x: Sets, y: Sets, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first, counts): how many terms each set of ``x`` from ``first`` on shares with each of ``y``, in pieces.

    Terms that many pairs share are multiplied as rows of zeros and ones, others counted where their holders meet.
    """
    dx, dy = np.bincount(x.term, minlength=width), np.bincount(y.term, minlength=width)
    heavy = dx.astype(float) * dy * HEAVY > len(x.n) * len(y.n)
    place = np.where(heavy, np.cumsum(heavy) - 1, -1)
    h = int(heavy.sum())
    columns = np.zeros((h, len(y.n)), np.float32)
    at = place[y.term]
    columns[at[at >= 0], y.who[at >= 0]] = 1
    order = np.argsort(y.term, kind="stable")
    holder, begin = y.who[order], np.concatenate([[0], np.cumsum(dy)])
    step = max(1, CELLS // max(1, len(y.n)))
    for lo in range(0, len(x.n), step):
        hi = min(len(x.n), lo + step)
        who, term = x.who[x.start[lo] : x.start[hi]].astype(np.int64) - lo, x.term[x.start[lo] : x.start[hi]]
        at = place[term]
        rows = np.zeros((hi - lo, h), np.float32)
        rows[who[at >= 0], at[at >= 0]] = 1
        counts = rows @ columns
        who, term = who[at < 0], term[at < 0]
        n = dy[term]
        if n.any():
            spot = np.repeat(begin[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            counts += np.bincount(np.repeat(who, n) * len(y.n) + holder[spot], minlength=counts.size).reshape(counts.shape)
        yield lo, counts


def nearest(x: Sets, y: Sets, width: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, score) of the first ``k`` sets of ``y`` by Jaccard (of equals the lesser place, none without a shared term) for each of ``x``.

    A set's rarest terms are looked up first, until no set that holds none of them can come among its first k.
    """
    d = np.bincount(y.term, minlength=width)
    order = np.argsort(y.term, kind="stable")
    holder, begin = y.who[order], np.concatenate([[0], np.cumsum(d)])
    least, size = y.n.min(initial=1), np.diff(y.start)
    held, seen = np.zeros(width + 1, np.int8), np.zeros(len(y.n), bool)
    # Sets of about one size are columns of a table, filled up with a term that none holds; else each is looked up from its start.
    table = None
    if len(y.n) * int(size.max(initial=0)) <= 2 * len(y.term):
        table = np.full((int(size.max(initial=0)), len(y.n)), width, np.int32)
        table[np.arange(len(y.term)) - y.start[y.who], y.who] = y.term

    def common(new: np.ndarray) -> np.ndarray:
        if table is not None:
            out = held[table[0][new]].astype(np.int32)
            for terms in table[1:]:
                out += held[terms[new]]
            return out
        n = size[new]
        before = np.cumsum(n) - n
        return np.add.reduceat(held[y.term[np.repeat(y.start[new] - before, n) + np.arange(n.sum())]], before, dtype=np.int32)

    for a in range(len(x.n)):
        terms = x.term[x.start[a] : x.start[a + 1]]
        held[terms] = 1
        known = terms[d[terms] > 0]
        known = known[np.argsort(d[known], kind="stable")]
        b, score = np.zeros(0, np.int64), np.zeros(0)
        for p, t in enumerate(known):
            most = len(known) - p  # a set not seen yet shares no more
            if len(b) == k and score[-1] > most / (x.n[a] + max(least, most) - most):
                break
            new = holder[begin[t] : begin[t + 1]]
            new = new[~seen[new]].astype(np.int64)
            if not len(new):
                continue
            seen[new] = True
            both = common(new)
            told = both / (x.n[a] + y.n[new] - both)
            if len(told) > k:
                kept = told >= np.partition(told, len(told) - k)[len(told) - k]
                new, told = new[kept], told[kept]
            b, score = np.concatenate([b, new]), np.concatenate([score, told])
            first = np.lexsort((b, -score))[:k]
            b, score = b[first], score[first]
        for t in known[: p + 1] if len(known) else ():
            seen[holder[begin[t] : begin[t + 1]]] = False
        held[terms] = 0
        if len(b):
            yield np.full(len(b), a), b, score
