"""A memory store that evolves along an ordered stream of candidates: a keyed, stateful fold.

Each candidate is judged against the store as the ones before it left it, which a join against one
generation cannot say. Stores are independent where no decision can cross them: a match at
``update`` above 0.6 needs a shared asset, so records and candidates of one tier whose assets hang
together (``stores``) form one store, and Spark keeps, checkpoints and deals the stores by key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skein.operators.graph import components
from skein.operators.memory import NOOP, PROTECTED, UPDATE

_SNAPSHOT = "struct<confidence: double, importance: double, strength: double, tags: array<string>, asset_ids: array<string>, links: array<string>>"
OPS = f"tier string, store string, seq long, pass_no long, step int, op string, memory_id string, target_id string, similarity double, before {_SNAPSHOT}, after {_SNAPSHOT}, added_tags array<string>, added_assets array<string>"
_RECORD = "tags array<string>, asset_ids array<string>, links array<string>, confidence double, importance double, strength double, access_count long, place long, retired string, superseded_by string"
_FIELDS = ("tags", "asset_ids", "links", "confidence", "importance", "strength", "access_count", "place", "retired", "superseded_by")
#: Columns of a candidate row, and of a record of the initial state besides.
CANDIDATE = ("tier", "store", "seq", "pass_no", "memory_id", "tags", "asset_ids", "confidence", "importance")
#: Operations that are handed on together.
TOLD = 10_000
_SKIPPED, _PROTECTED = re.compile(r"^(skill:|quarantine:|root:)"), re.compile(PROTECTED)


def _content(tags: list[str]) -> set[str]:
    return {t.lower() for t in tags if not _SKIPPED.match(t) and t != "insight"}


def _roots(tags: list[str]) -> set[str]:
    return {t[5:] for t in tags if t.startswith("root:")}


def _share(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def _snapshot(record: dict) -> dict:
    return {k: list(v) if isinstance(v := record[k], list) else v for k in ("confidence", "importance", "strength", "tags", "asset_ids", "links")}


class Fold:
    """One store: candidates change it in order, and each change is told as (op, id, target, similarity, before, after).

    ``live`` are the records that nothing has retired, by place. A step looks at these only, so that its cost does not
    grow with the records that the store has retired.
    """

    def __init__(self, records: dict[str, dict], update: float, noop: float, budget: int | None, retention: float, floor: float):
        self.records, self.update, self.noop, self.budget, self.retention, self.floor = records, update, noop, budget, retention, floor
        self.place = max((r["place"] for r in records.values()), default=-1) + 1
        self.live = {i: r for i, r in sorted(records.items(), key=lambda x: x[1]["place"]) if not r["retired"]}
        self.holders: dict[str, set[str]] = {}
        self.sets: dict[str, tuple[set[str], set[str]]] = {}
        for i, r in self.live.items():
            self._hold(i, r)
        self.changed: set[str] = set()

    def _hold(self, i: str, r: dict) -> None:
        self.sets[i] = _content(r["tags"]), set(r["asset_ids"])
        for a in r["asset_ids"]:
            self.holders.setdefault(a, set()).add(i)

    def _retire(self, i: str, reason: str) -> None:
        r = self.live.pop(i)
        r["retired"] = reason
        r["tags"] = [*r["tags"], f"quarantine:{reason}"]
        self.changed.add(i)
        for a in self.sets.pop(i)[1]:
            self.holders[a].discard(i)

    def _nearest(self, c: dict) -> tuple[str | None, float]:
        best, most, earliest = None, 0.0, -1
        tags, assets = _content(c["tags"]), set(c["asset_ids"])
        for i in {i for a in assets for i in self.holders.get(a, ())}:
            if i == c["memory_id"]:
                continue
            place, (said, held) = self.live[i]["place"], self.sets[i]
            s = round(0.6 * _share(tags, said) + 0.4 * _share(assets, held), 4)
            if s > most or s == most and s > 0 and place < earliest:
                best, most, earliest = i, s, place
        return best, most

    def _add(self, c: dict, links: list[str]) -> None:
        if c["memory_id"] in self.records:
            return
        self.records[c["memory_id"]] = {
            "tags": list(c["tags"]), "asset_ids": list(c["asset_ids"]), "links": links, "confidence": c["confidence"], "importance": c["importance"], "strength": 1.0, "access_count": 0, "place": self.place, "retired": None, "superseded_by": None,
        }
        self.place += 1
        self.live[c["memory_id"]] = self.records[c["memory_id"]]
        self._hold(c["memory_id"], self.records[c["memory_id"]])
        self.changed.add(c["memory_id"])

    def take(self, c: dict) -> Iterator[tuple]:
        target, s = self._nearest(c)
        r = self.records.get(target)
        if target is None or s < self.update:
            self._add(c, [])
            yield "ADD", c["memory_id"], None, s, None, _snapshot(self.records[c["memory_id"]])
            return
        before = _snapshot(r)
        if _roots(r["tags"]) and _roots(c["tags"]) - _roots(r["tags"]):
            self._add(c, [target])
            self._retire(target, "superseded")
            r["superseded_by"] = c["memory_id"]
            yield "SUPERSEDE", target, c["memory_id"], s, before, _snapshot(r)
            return
        fresh = _content(c["tags"]) - _content(r["tags"]) or set(c["asset_ids"]) - set(r["asset_ids"])
        op = "NOOP" if s >= self.noop and not fresh else "UPDATE"
        r["strength"], r["access_count"] = 1.0, r["access_count"] + 1
        if op == "UPDATE":
            r["tags"] = list(dict.fromkeys([*r["tags"], *c["tags"]]))
            r["asset_ids"] = list(dict.fromkeys([*r["asset_ids"], *c["asset_ids"]]))
            r["confidence"], r["importance"] = min(3.0, r["confidence"] + 0.3), r["importance"] + 1.0
            self._hold(target, r)
        self.changed.add(target)
        yield op, target, target, s, before, _snapshot(r)

    def evict(self) -> Iterator[tuple]:
        """What is of least use goes until the budget holds; protected records count but stay."""
        if self.budget is None or len(self.live) <= self.budget:
            return
        mortal = [(i, r) for i, r in self.live.items() if not _PROTECTED.match(i)]
        signals = [lambda r: max(0.0, r["importance"]), lambda r: float(r["access_count"]), lambda r: max(0.0, r["strength"]), lambda r: float(len(r["links"]))]
        tops = [max((f(r) for _, r in mortal), default=0.0) for f in signals]
        use = {i: round(sum(0.25 * f(r) / top for f, top in zip(signals, tops, strict=True) if top > 0), 6) for i, r in mortal}
        over = len(mortal) - max(0, self.budget - (len(self.live) - len(mortal)))
        for i, r in sorted(mortal, key=lambda x: (use[x[0]], x[1]["strength"]))[: max(0, over)]:
            before = _snapshot(r)
            self._retire(i, "evicted")
            yield "EVICT", i, None, use[i], before, _snapshot(r)

    def tick(self) -> Iterator[tuple]:
        """The end of a pass: strength fades, and what falls below the floor is forgotten."""
        for i, r in list(self.live.items()):
            if _PROTECTED.match(i):
                continue
            before = _snapshot(r)
            r["strength"] *= self.retention
            self.changed.add(i)
            if r["strength"] < self.floor:
                self._retire(i, "forgotten")
                yield "FORGET", i, None, None, before, _snapshot(r)
            else:
                yield "DECAY", i, None, None, before, _snapshot(r)


class Evolve(StatefulProcessor):
    """The fold of every store, its records in a map state and its clock in a value state.

    Rows of a batch are taken in the order of ``seq``; one at or before the clock was taken already
    and changes nothing, so a source that repeats itself does no harm. A batch frame hands over all rows
    of a store at once and no batch follows, so that its records need not be ``kept``.
    """

    def __init__(self, kept: bool = True, **settings):
        self.kept, self.settings = kept, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getMapState("records", "memory_id string", _RECORD)
        self.clock = handle.getValueState("clock", "seq long, pass_no long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        for place, r in enumerate(initialState.sort_values("place").to_dict("records")):
            row = {"tags": list(r["tags"]), "asset_ids": list(r["asset_ids"]), "links": list(r["links"]), "confidence": float(r["confidence"]), "importance": float(r["importance"]), "strength": float(r["strength"]), "access_count": int(r["access_count"])}
            self.stored.updateValue((r["memory_id"],), tuple((row | {"place": place, "retired": None, "superseded_by": None})[f] for f in _FIELDS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        records = {k[0]: {f: list(x) if f in ("tags", "asset_ids", "links") else x for f, x in zip(_FIELDS, v, strict=True)} for k, v in self.stored.iterator()}
        fold, (last, pass_no) = Fold(records, **self.settings), self.clock.get() if self.clock.exists() else (-(1 << 62), None)
        told, names = [], ["tier", "store", "seq", "pass_no", "step", "op", "memory_id", "target_id", "similarity", "before", "after", "added_tags", "added_assets"]
        for c in pd.concat(list(rows)).sort_values("seq", kind="stable").to_dict("records"):
            if c["seq"] <= last:
                continue
            last, steps = int(c["seq"]), []
            for _ in range(0 if pass_no is None else int(c["pass_no"]) - pass_no):
                steps += fold.tick()
            pass_no = int(c["pass_no"])
            if c["memory_id"] is not None:  # else a row that only moves the clock
                c = {"memory_id": c["memory_id"], "tags": list(c["tags"]), "asset_ids": list(c["asset_ids"]), "confidence": float(c["confidence"]), "importance": float(c["importance"])}
                steps += [*fold.take(c), *fold.evict()]
            for n, (op, i, target, s, before, after) in enumerate(steps):
                added = [[x for x in after[f] if x not in set(before[f])] if before else [] for f in ("tags", "asset_ids")]
                told.append((*key, last, pass_no, n, op, i, target, s, before, after, *added))
            if len(told) >= TOLD:
                yield pd.DataFrame(told, columns=names)
                told = []
        for i in fold.changed if self.kept else ():
            self.stored.updateValue((i,), tuple(records[i][f] for f in _FIELDS))
        if pass_no is not None:
            self.clock.update((last, pass_no))
        yield pd.DataFrame(told, columns=names)

    def close(self) -> None:
        pass


def stores(rows: DataFrame) -> DataFrame:
    """(tier, asset, store) of rows with tier and asset_ids: assets that occur together, in one row or by way of others, share a store."""
    held = rows.select("tier", F.transform(F.array_distinct("asset_ids"), lambda a: F.to_json(F.struct("tier", a.alias("asset")))).alias("a")).where(F.size("a") > 0)
    found = components(held.select(F.get("a", 0).alias("a"), F.explode("a").alias("b")))
    pair = F.from_json("node", "tier string, asset string")
    return found.select(pair.alias("p"), F.col("component").alias("store")).select("p.tier", "p.asset", "store")


def stored(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with their ``store``; a row without assets, or of unknown ones, is a store of its own."""
    first = rows.withColumn("asset", F.get("asset_ids", 0))
    return first.join(known, ["tier", "asset"], "left").withColumn("store", F.coalesce("store", F.concat(F.lit("alone:"), "memory_id"))).drop("asset")


def evolve(
    candidates: DataFrame, records: DataFrame | None = None, update: float = UPDATE, noop: float = NOOP, budget: int | None = None, retention: float = 0.55, floor: float = 0.4
) -> DataFrame:
    """The lifecycle operations of ``candidates``, with snapshots before and after each.

    ``candidates`` is a streaming or a batch frame with the columns of CANDIDATE: ``seq`` orders
    them (one number one row), ``pass_no`` is that of their pass over the world; a row with a null
    memory_id only moves the clock of its store. ``records`` (tier, store, memory_id, tags,
    asset_ids, links, confidence, importance, strength, access_count, place) is the store to begin with.
    Each row is routed (ADD, UPDATE, NOOP, SUPERSEDE), then, with a ``budget`` of active records a
    store, what is of least use is evicted; between passes strength decays and what is weak is
    forgotten. The similarity of an ADD is that of the nearest record with a shared asset.

    State grows with the records of a store, which one task holds; a streaming frame needs the
    RocksDB state store, which is set where the session names none.
    """
    if update <= 0.6:
        raise ValueError("stores are only independent if an update needs a shared asset: update must be above 0.6")
    spark = candidates.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # The session's streams start the coordinator of state stores, which a batch frame needs as well.
    len(spark.streams.active)
    start: GroupedData | None = None if records is None else records.groupBy("tier", "store")
    settings = {"update": update, "noop": noop, "budget": budget, "retention": retention, "floor": floor}
    return candidates.select(*CANDIDATE).groupBy("tier", "store").transformWithStateInPandas(Evolve(candidates.isStreaming or records is not None, **settings), OPS, "Append", "None", start)
