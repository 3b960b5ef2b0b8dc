"""Graphs held as edge relations."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import blocks
from skein.operators.blocks import settle

STAMPS, CHUNK = 500_000, 1_000_000  # stamps that a block holds at most; near stamps, and arcs, looked at together


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): component is the least node that can be reached.

    Each round takes the least label of a node's neighbours and then that label's own label, so the
    way to the least node about halves; it ends with the round that changes nothing. A self loop
    keeps a lone node; null ends are ignored.
    """
    both = settle(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")).distinct())
    label = settle(both.groupBy("a").agg(F.least("a", F.min("b")).alias("c")))
    while True:
        near = both.join(label.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        lower = settle(label.join(near, "a").select("a", F.least("c", "m").alias("c"), F.col("c").alias("old")))
        jumped = lower.join(lower.select(F.col("a").alias("c"), F.col("c").alias("next")), "c").select("a", F.col("next").alias("c"), "old")
        after = settle(jumped)
        label = after.select("a", "c")
        if after.where("c <> old").isEmpty():
            return label.select(F.col("a").alias("node"), F.col("c").alias("component"))


def distances(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, distance) within ``depth`` hops of each start, over undirected edges.

    One join a level; nodes that a start has reached are not visited again.
    """
    both = undirected(edges)
    reached = starts.select(F.col("node").alias("start"), "node").distinct().withColumn("distance", F.lit(0))
    front = reached
    for d in range(1, depth + 1):
        step = front.select("start", F.col("node").alias("src")).join(both, "src").select("start", F.col("dst").alias("node")).distinct()
        front = settle(step.join(reached.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(d)))
        reached = settle(reached.unionByName(front))
    return reached


def explained_distances(edges: DataFrame, starts: DataFrame, depth: int, relation: str | None = None) -> DataFrame:
    """(start, node, distance, parent, relation, forward, verified): one shortest way to each node, by its last hop.

    ``edges`` has src, dst, relation and verified and is walked both ways; ``forward`` says whether the
    hop goes along its edge. Of the hops that reach a node in one level that from the least parent
    counts (then a verified one, then by relation; null comes last), so every node but a start has one parent that is
    one nearer. With ``relation`` only edges of that kind are walked.

    A pair of nodes is one row with a code for the best hop each way, and a level sends node, parent and code only.
    """
    kept = edges.select("src", "dst", "relation", "verified")
    kept = kept if relation is None else kept.where(F.col("relation") == relation)
    named = kept.select("relation").distinct()  # kinds of edges, few
    names = settle(named.withColumn("_k", F.row_number().over(Window.orderBy(F.asc_nulls_last("relation"))) - 1))
    told = kept.join(F.broadcast(names.withColumnRenamed("relation", "_n")), F.col("relation").eqNullSafe(F.col("_n")))
    # Of verified (0, 1 not, 2 null), relation and forward (0, 1 against); the way from the lesser node up and back.
    code = 2 * F.col("_k") + F.when(F.col("verified"), 0).when(~F.col("verified"), 1 << 30).otherwise(1 << 31)
    up = F.coalesce(F.col("src") <= F.col("dst"), F.lit(False))
    ends = told.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"), code.cast("long").alias("c"), up.alias("up"))
    against = F.when(F.col("up"), 0).otherwise(1)
    pairs = settle(ends.groupBy("a", "b").agg(F.min(F.col("c") + against).alias("up"), F.min(F.col("c") + 1 - against).alias("down")))
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("up").alias("c")).union(pairs.select("b", "a", "down"))
    node = edges.schema["src"].dataType
    reached = starts.select(F.col("node").cast(node).alias("start"), F.col("node").cast(node).alias("node")).distinct().withColumns(
        {"distance": F.lit(0), "parent": F.lit(None).cast(node), "c": F.lit(None).cast("long")}
    )
    front = reached
    for d in range(1, depth + 1):
        step = front.select("start", F.col("node").alias("src")).join(both, "src").select("start", F.col("dst").alias("node"), F.col("src").alias("parent"), "c")
        new = step.groupBy("start", "node").agg(F.min_by("c", "parent").alias("c"), F.min("parent").alias("parent")).join(reached.select("start", "node"), ["start", "node"], "left_anti")
        front = settle(new.select("start", "node", F.lit(d).alias("distance"), "parent", "c"))
        reached = reached.unionByName(front)
        if front.isEmpty():
            break
    doubt, rest = F.shiftright("c", 30), F.col("c").bitwiseAND((1 << 30) - 1)
    own = reached.withColumns({"_k": F.shiftright(rest, 1).cast("int"), "forward": rest % 2 == 0, "verified": F.when(F.col("c").isNull() | (doubt == 0), True).when(doubt == 1, False)})
    return own.join(F.broadcast(names), "_k", "left").select("start", "node", "distance", "parent", "relation", "forward", "verified")


def explained_paths(reached: DataFrame, targets: DataFrame | Column, depth: int) -> DataFrame:
    """(start, node, distance, path, relations, verified) of the ``targets`` that were reached: (start, node), or a condition on ``reached``.

    Ways are rebuilt from their ends, whose rows hold the last hop; each hop before is one join with the hops of the levels it can be of.
    A way is verified if every hop is.
    """
    ways = reached.where(targets) if isinstance(targets, Column) else reached.join(targets.select("start", "node").distinct(), ["start", "node"], "left_semi")
    ways = ways.select("start", "node", "distance", F.col("parent").alias("_a1"), F.col("relation").alias("_r1"), F.col("verified").alias("ok"))
    deep = max(depth, 1)
    for k in range(2, deep + 1):
        near = reached.where(F.col("distance").between(1, deep - k + 1))
        hops = near.select("start", F.col("node").alias(f"_a{k - 1}"), F.col("parent").alias(f"_a{k}"), F.col("relation").alias(f"_r{k}"), F.col("verified").alias("_v"), F.lit(True).alias("_h"))
        ways = ways.join(hops, ["start", f"_a{k - 1}"], "left").withColumn("ok", F.when(F.col("_h"), F.col("ok") & F.col("_v")).otherwise(F.col("ok"))).drop("_v", "_h")
    n = F.col("distance")
    told = lambda c: F.slice(F.array(*(f"{c}{k}" for k in range(deep, 0, -1))), F.greatest(F.lit(1), deep - n + 1), F.least(n, F.lit(deep)))
    return ways.select("start", "node", "distance", F.array_append(told("_a"), F.col("node")).alias("path"), told("_r").alias("relations"), F.col("ok").alias("verified"))


def explained_chains(chains: DataFrame, edges: DataFrame, records: DataFrame, early: list[str], failures: list[str]) -> DataFrame:
    """(chain_id, path, relations, assets, early_change, hidden_failure, verified) of chains (chain_id, path array of ids in order).

    ``edges`` (src, dst, relation, temporal, evidence array), ``records`` (memory_id, asset_ids,
    event_type, observed_at, changed). A hop is verified by evidence or, if temporal, by the times of
    both ends. ``early_change`` is the first record of an early kind or with a changed baseline; a
    hidden failure starts with one, spans two assets and ends in a failure.
    """
    at = chains.select("chain_id", F.posexplode("path").alias("place", "memory_id"))
    known = at.join(records.select("memory_id", "asset_ids", "event_type", "observed_at", "changed"), "memory_id", "left")
    is_early = F.col("event_type").isin(*early) | F.coalesce("changed", F.lit(False))
    listed = F.sort_array(F.collect_list(F.struct("place", "memory_id", "asset_ids", "event_type")))  # one chain's records
    by_chain = known.groupBy("chain_id").agg(listed.alias("l"), F.min(F.when(is_early, F.struct("place", "memory_id"))).alias("e"))
    hops = known.select("chain_id", "place", F.col("memory_id").alias("src"), F.col("observed_at").alias("a")).join(
        known.select("chain_id", (F.col("place") - 1).alias("place"), F.col("memory_id").alias("dst"), F.col("observed_at").alias("b")), ["chain_id", "place"]
    )
    proof = (F.size("evidence") > 0) | (F.col("temporal") & F.col("a").isNotNull() & F.col("b").isNotNull())
    told = hops.join(edges, ["src", "dst"], "left").groupBy("chain_id", "place").agg(F.min(F.struct("relation", F.coalesce(proof, F.lit(False)).alias("ok"))).alias("h"))
    ways = told.groupBy("chain_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "h"))), lambda x: x["h"]["relation"]).alias("relations"), F.min("h.ok").alias("verified"))
    assets = F.array_distinct(F.flatten(F.transform("l", lambda x: F.coalesce(x["asset_ids"], F.array().cast("array<string>")))))
    last = F.element_at("l", -1)["event_type"]
    return by_chain.join(ways, "chain_id", "left").select(
        "chain_id", F.transform("l", lambda x: x["memory_id"]).alias("path"), F.coalesce("relations", F.array().cast("array<string>")).alias("relations"), assets.alias("assets"), F.col("e.memory_id").alias("early_change"),
        (F.col("e").isNotNull() & (F.size(assets) >= 2) & F.coalesce(last.isin(*failures), F.lit(False))).alias("hidden_failure"), F.coalesce("verified", F.lit(True)).alias("verified"),
    )


def longest_chains(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(root, hops, path): the longest simple directed path from each root, ties by the path itself."""
    paths = roots.select(F.col("node").alias("root"), F.col("node").alias("tail"), F.array("node").alias("path")).distinct()
    every = paths
    for _ in range(hops):
        paths = paths.join(edges.select(F.col("src").alias("tail"), F.col("dst").alias("next")).distinct(), "tail").where(~F.array_contains("path", F.col("next")))
        paths = settle(paths.select("root", F.col("next").alias("tail"), F.array_append("path", F.col("next")).alias("path")))
        every = every.unionByName(paths)
    order = Window.partitionBy("root").orderBy(F.desc(F.size("path")), "path")
    return every.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("root", (F.size("path") - 1).alias("hops"), F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"))


def shared_key_edges(members: DataFrame, key: str, node: str, least: int, most: int) -> DataFrame:
    """(a, b, weight): nodes that share keys held by ``least`` to ``most`` nodes; weight counts the keys.

    Keys with more holders say nothing and are left out before the join, so no key yields more than
    most * (most - 1) / 2 pairs.
    """
    held = members.select(key, node).distinct()
    useful = held.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(least, most)).select(key)
    kept = held.join(useful, key, "left_semi")
    a, b = kept.select(key, F.col(node).alias("a")), kept.select(key, F.col(node).alias("b"))
    return a.join(b, key).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def _near(seconds: int, least_hits: int, least_ratio: float) -> Callable[[pa.Table, pa.Table | None], Iterator[pa.RecordBatch]]:
    """Of two blocks of nodes the pairs (a, b, hits, m) that may do, in pieces, m the fewer stamps of both."""
    micros = seconds * 1_000_000

    def run(left: pa.Table, right: pa.Table | None) -> Iterator[pa.RecordBatch]:
        same, cut = right is None, len(left)
        rows = (left if same else pa.concat_tables([left, right])).combine_chunks()
        whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        names = whole(rows.column("n")).unique().sort()  # numbered in the order of names
        who = pc.index_in(whole(rows.column("n")), names).to_numpy()
        g, t = whole(rows.column("g")).dictionary_encode().indices.to_numpy(), rows.column("t").to_numpy()
        m = np.zeros(len(names), np.int64)
        m[who] = rows.column("m").to_numpy()
        del rows, left, right
        part = (np.arange(len(t)) >= cut).astype(np.int64) * (int(g.max(initial=0)) + 1) + g  # a group of a side
        order = np.lexsort((t, part))
        who, t, part = who[order], t[order], part[order]
        order = np.lexsort((t, who))
        new = (np.diff(who[order], prepend=-1) != 0) | (np.diff(t[order], prepend=0) != 0)
        first = np.flatnonzero(np.diff(who[order], prepend=-1))
        stamp = np.empty(len(t), np.int64)  # of one node, by time
        at = np.cumsum(new)
        stamp[order] = at - np.repeat(at[first], np.diff(np.append(first, len(t))))
        most = int(stamp.max(initial=0)) + 1
        del order, new, at
        edge = np.concatenate([np.flatnonzero(np.diff(part, prepend=-1)), [len(part)]])
        place = {int(part[i]): slice(i, j) for i, j in zip(edge[:-1], edge[1:], strict=True)}
        lo, n = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        for k, x in place.items():
            y = x if same else place.get(k + int(g.max()) + 1)
            if y is not None:
                lo[x] = y.start + np.searchsorted(t[y], t[x] - micros, "left")
                n[x] = y.start + np.searchsorted(t[y], t[x] + micros, "right") - lo[x]
        asked = np.flatnonzero(n)
        asked = asked[np.argsort(who[asked], kind="stable")]
        before = np.concatenate([[0], np.cumsum(n[asked])])
        cuts = np.concatenate([np.flatnonzero(np.diff(who[asked], prepend=-1)), [len(asked)]])  # where each node begins
        at = 0
        while at < len(cuts) - 1:
            end = max(at + 1, int(np.searchsorted(before[cuts], before[cuts[at]] + CHUNK, "right")) - 1)
            x = asked[cuts[at] : cuts[end]]
            y = np.repeat(lo[x] - (before[cuts[at] : cuts[end]] - before[cuts[at]]), n[x]) + np.arange(before[cuts[end]] - before[cuts[at]])
            x = np.repeat(x, n[x])
            # The stamps of the lesser node count.
            kept = who[x] < who[y] if same else who[x] != who[y]
            x, y = x[kept], y[kept]
            a, b = np.where(who[x] < who[y], x, y), np.where(who[x] < who[y], y, x)
            key = np.sort((who[a].astype(np.int64) * len(names) + who[b]) * most + stamp[a])
            pair = key[np.diff(key, prepend=-1) > 0] // most
            new = np.flatnonzero(np.diff(pair, prepend=-1))
            pair, hits = pair[new], np.diff(np.append(new, len(pair)))
            a, b = pair // len(names), pair % len(names)
            fewer = np.minimum(m[a], m[b])
            kept = (hits >= least_hits) & (hits / fewer >= least_ratio - 1e-4)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(a[kept])), names.take(pa.array(b[kept])), pa.array(hits[kept]), pa.array(fewer[kept])], names=["a", "b", "hits", "m"])
            at = end

    return run


def _steps(seconds: int, least_hits: int, least_ratio: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``_near`` of a frame that holds both blocks (i, j) by their side, all pieces at once."""
    run = _near(seconds, least_hits, least_ratio)

    def both(frame: pd.DataFrame) -> pd.DataFrame:
        sides = [pa.Table.from_pandas(x[["g", "n", "t", "m"]], preserve_index=False) for _, x in frame.groupby("side")]
        return pa.Table.from_batches(run(sides[0], None if frame["i"].iloc[0] == frame["j"].iloc[0] else sides[1])).to_pandas()

    return both


def lockstep(stamps: DataFrame, node: str, ts: str, seconds: int, least_hits: int, least_ratio: float, group: str) -> DataFrame:
    """(a, b, hits, ratio): pairs of a group whose stamps often lie within ``seconds`` of each other.

    hits counts the stamps of ``a`` with one of ``b`` near; ratio divides by the fewer stamps. Nodes
    are dealt into blocks, and a task meets two of them in the order of time: what is near is counted
    there in pieces, so only pairs that are told become rows.
    """
    rows = settle(stamps.select(F.col(group).alias("g"), F.col(node).alias("n"), F.unix_micros(F.col(ts)).alias("t")).distinct())
    size = rows.groupBy("n").agg(F.countDistinct("t").alias("m"))
    whole = rows.dropna().join(size, "n").select("g", "n", "t", "m")
    kind = rows.schema["n"].dataType.simpleString()
    number = blocks.number(rows.count(), 20_000, STAMPS)
    found = blocks.meet(blocks.packed(whole, "n", number), None, number, _near(seconds, least_hits, least_ratio), f"a {kind}, b {kind}, hits long, m long")
    ratio = F.round(F.col("hits") / F.col("m"), 4)
    return found.select("a", "b", "hits", ratio.alias("ratio")).where((F.col("hits") >= least_hits) & (F.col("ratio") >= least_ratio))


def hubs(edges: DataFrame) -> DataFrame:
    """(node, degree, strength) of undirected weighted edges (a, b, weight)."""
    ends = edges.select(F.col("a").alias("node"), "weight").union(edges.select(F.col("b").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


class _Arcs:
    """The arcs of one part, told in the order of their nodes: what is large waits in a file of the task, which is gone when closed; nodes and labels are arrays."""

    def __init__(self) -> None:
        self.other, self.weight = self._file(), self._file()
        self.names, self.degrees, self.last = [], [], None

    @staticmethod
    def _file() -> tempfile.SpooledTemporaryFile:
        return tempfile.SpooledTemporaryFile(max_size=16 * CHUNK)

    @staticmethod
    def _read(file: tempfile.SpooledTemporaryFile, kind: type, n: int) -> np.ndarray:
        return np.frombuffer(file.read(n * np.dtype(kind).itemsize), kind)

    def add(self, node: np.ndarray, other: np.ndarray, weight: np.ndarray) -> None:
        new = np.flatnonzero(np.diff(node, prepend=node[0] - 1))
        names, degree = node[new], np.diff(np.append(new, len(node)))
        if names[0] == self.last:
            self.degrees[-1][-1] += degree[0]
            names, degree = names[1:], degree[1:]
        if len(names):
            self.names.append(names)
            self.degrees.append(degree)
            self.last = names[-1]
        self.other.write(other.astype(np.int64).tobytes())
        self.weight.write(weight.astype(np.float64).tobytes())

    def labels(self, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """(names, labels) after ``rounds``, each of which reads the arcs once, ``CHUNK`` or one node's at a time."""
        names, edge = np.concatenate(self.names), np.concatenate([[0], np.cumsum(np.concatenate(self.degrees))])
        self.other.seek(0)
        with self.other as told, self.weight as weights, self._file() as other:
            for _ in range(0, edge[-1], CHUNK):
                other.write(np.searchsorted(names, self._read(told, np.int64, CHUNK)).astype(np.int32).tobytes())
            told.close()
            label = np.arange(len(names))
            for _ in range(rounds):
                changed, i = False, 0
                other.seek(0)
                weights.seek(0)
                while i < len(names):
                    j = max(i + 1, int(np.searchsorted(edge, edge[i] + CHUNK, "right")) - 1)
                    to, weight = self._read(other, np.int32, edge[j] - edge[i]), self._read(weights, np.float64, edge[j] - edge[i])
                    cuts = (edge[i : j + 1] - edge[i]).tolist()
                    for n, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), i):
                        seen, which = np.unique(label[to[x:y]], return_inverse=True)
                        best = seen[np.argmax(np.bincount(which, weight[x:y]))]
                        changed |= bool(best != label[n])
                        label[n] = best
                    i = j
                if not changed:
                    break
        return names, names[label]


def label_propagation(edges: DataFrame, group: str, rounds: int = 24) -> DataFrame:
    """(group, node, label) by asynchronous weighted label propagation inside each group.

    Nodes are visited in order and take the neighbours' heaviest label, ties by the lesser one. The
    order matters, so what hangs together is one task's; parts of a group that do not hang
    together never change each other's labels and go to tasks of their own. A task reads the arcs of a part in the
    order of nodes, from a file of its own in each round: only nodes and labels stay in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def done() -> pa.RecordBatch:
            names, labels = held.labels(rounds)
            return pa.RecordBatch.from_arrays([pa.repeat(key[0], len(names)), pa.array(names), pa.array(labels)], names=["group", "node", "label"])

        for batch in batches:
            g, part = batch.column(group), batch.column("_part").to_numpy()
            kind = g.dictionary_encode(null_encoding="encode").indices.to_numpy()
            a, b, weight = (batch.column(c).to_numpy() for c in ("a", "b", "weight"))
            cuts = np.flatnonzero((np.diff(kind, prepend=-1) != 0) | (np.diff(part, prepend=0) != 0)).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                one = (g[i], int(part[i]))
                if held is not None and (one[1] != key[1] or one[0].as_py() != key[0].as_py()):
                    yield done()
                    held = None
                key, held = one, held or _Arcs()
                held.add(a[i:j], b[i:j], weight[i:j])
        if held is not None:
            yield done()

    kind = edges.schema[group].dataType.simpleString()
    edges = settle(edges.select(group, "a", "b", F.col("weight").cast("double").alias("weight")).where("a IS NOT NULL AND b IS NOT NULL"))
    part = components(edges).select(F.col("node").alias("a"), F.col("component").alias("_part"))
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    arcs = edges.join(part, "a").select(group, "_part", F.explode(ways).alias("_w"), "weight").select(group, "_part", "_w.*", "weight")
    dealt = arcs.repartition(group, "_part").sortWithinPartitions(group, "_part", "a", "b")
    return dealt.mapInArrow(run, f"group {kind}, node long, label long")


def synchronous_labels(edges: DataFrame, rounds: int = 24, stay: float = 0.0) -> DataFrame:
    """(node, label) by weighted label propagation over all edges (a, b, weight), every node at once.

    Each round a node takes the label that weighs most among its neighbours, its own counting ``stay``
    besides, ties to the lesser label; the loop ends with the round that changes nothing. A round is
    one join and two aggregations summed within tasks first, so no group of nodes is one task's.
    """
    both = settle(edges.select("a", "b", "weight").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).where("a <> b").groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    label = both.select("a").distinct().withColumn("l", F.col("a"))
    for _ in range(rounds):
        told = both.join(label.select(F.col("a").alias("b"), "l"), "b").select("a", "l", F.col("weight").cast("double").alias("w"))
        own = label.select("a", "l", F.lit(float(stay)).alias("w"))
        sums = told.unionByName(own).where("w > 0").groupBy("a", "l").agg(F.sum("w").alias("w"))
        best = sums.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("w"), "l")).alias("x")).select("a", "x.l")
        after = settle(best.join(label.select("a", F.col("l").alias("old")), "a"))
        label = after.select("a", "l")
        if after.where("l <> old").isEmpty():
            break
    return label.select(F.col("a").alias("node"), F.col("l").alias("label"))
