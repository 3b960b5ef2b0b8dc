"""Nested values, explained ways, contracts of steps and coded search against plain loops."""

from __future__ import annotations

import json
import random
import re

import numpy as np
import pytest

from skein.operators import ann, contracts, graph, nested, retrieval

SECRET = re.compile(r"(^|_)(password|passwd|secret|api_?key|access_?token|refresh_?token|authorization)($|_)", re.I)


def values():
    r = random.Random(4)

    def value(depth):
        kind = r.random()
        if depth > 6 or kind < 0.35:
            return r.choice([True, False, None, 3, -17, "core-sw", "Edge 1", "", "a\"b\\c\n", "é日", "x" * 30])
        if kind < 0.65:
            return [value(depth + 1) for _ in range(r.randrange(5))]
        return {r.choice(["host", "b", "port", "API_Key", "password", "user_secret", "tokens", "é", "z z"]): value(depth + 1) for _ in range(r.randrange(6))}

    deep = "end"
    for i in range(30):
        deep = {"k": deep} if i % 2 else [deep]
    return [value(0) for _ in range(120)] + [{}, [], "lone", 5, None, True, {"a": {}}, deep, list(range(60)), {f"k{i:02d}": i for i in range(40)}, {"password": {"in": [1]}, "note": "y" * 600}]


def plain_text(v):
    if isinstance(v, dict):
        return " ".join(f"{k} {plain_text(x)}" for k, x in sorted(v.items()))
    return " ".join(map(plain_text, v)) if isinstance(v, list) else str(v)


def plain_match(needle, v):
    if isinstance(v, (dict, list)):
        return any(plain_match(needle, x) for x in (v.values() if isinstance(v, dict) else v))
    return needle.strip().lower() == str(v).strip().lower()


def plain_summary(v, depth=0, most_depth=4, items=24, size=512):
    if depth >= most_depth:
        return "[depth-limited]"
    if isinstance(v, str) and len(v) > size:
        return v[:size] + f"…[truncated {len(v) - size} chars]"
    if isinstance(v, dict):
        every = sorted(v.items())
        out = {k: "[redacted]" if SECRET.search(k) else plain_summary(x, depth + 1, most_depth, items, size) for k, x in every[:items]}
        return out | ({"_truncated_items": len(every) - items} if len(every) > items else {})
    if isinstance(v, list):
        return [plain_summary(x, depth + 1, most_depth, items, size) for x in v[:items]] + ([f"[truncated {len(v) - items} items]"] if len(v) > items else [])
    return v


@pytest.fixture(scope="module")
def held(spark):
    rows = [(i, json.dumps(v)) for i, v in enumerate(values())] + [(1000, None), (1001, "{broken"), (1002, "")]
    return spark.createDataFrame(rows, "record_id long, attrs string")


def test_text_of_nested_values(held):
    got = {r.record_id: r.text.split() for r in nested.text(held, "attrs", "record_id").collect()}
    assert got == {i: plain_text(v).split() for i, v in enumerate(values())}


def test_values_are_found_at_any_depth(spark, held):
    asked = ["CORE-SW", " end ", "3", "none", "true", "nowhere", "é日", ""]
    found = {(r.query_id, r.record_id) for r in nested.holders(held, "attrs", "record_id", spark.createDataFrame(list(enumerate(asked)), "query_id long, entity string")).collect()}
    assert found == {(q, i) for q, a in enumerate(asked) for i, v in enumerate(values()) if plain_match(a, v)}
    records = held.selectExpr("record_id", "attrs", "CASE WHEN record_id % 7 = 0 THEN 'Core-SW ' ELSE 'other' END AS entity")
    got = {r.record_id: r.via for r in nested.entity_records(records, spark.createDataFrame([(1, "core-sw")], "query_id long, entity string")).collect()}
    every = [(i, v) for i, v in enumerate(values())] + [(1000, []), (1001, []), (1002, [])]
    assert got == {i: "direct" if i % 7 == 0 else "attribute" for i, v in every if i % 7 == 0 or plain_match("core-sw", v)}


@pytest.mark.parametrize("bounds", [(4, 24, 512), (1, 2, 3), (6, 3, 10)])
def test_summaries_are_bounded_and_hide_secrets(held, bounds):
    got = {r.record_id: json.loads(r.summary) for r in nested.summaries(held, "attrs", "record_id", *bounds).collect()}
    assert got == {i: plain_summary(v, 0, *bounds) for i, v in enumerate(values())}


def test_every_hop_has_its_parent(spark):
    r = random.Random(8)
    edges = {(r.randrange(60), r.randrange(60)): (r.choice("abc"), r.random() < 0.7) for _ in range(110)}
    frame = spark.createDataFrame([(a, b, *x) for (a, b), x in edges.items()], "src long, dst long, relation string, verified boolean")
    starts = [0, 7, 33]
    reached = graph.explained_distances(frame, spark.createDataFrame([(x,) for x in starts], "node long"), 5)
    got = {(x.start, x.node): x for x in reached.collect()}
    for s in starts:
        level, seen, d = {s}, {s: 0}, 0
        while level and d < 5:
            d += 1
            level = {y for x in level for a, b in edges for y in ((b,) if a == x else (a,) if b == x else ())} - seen.keys()
            seen |= dict.fromkeys(level, d)
        assert {n: got[k].distance for k in got if k[0] == s for n in [k[1]]} == seen
        for (start, node), x in got.items():
            if start == s and node != s:
                near = [p for p, d in seen.items() if d == x.distance - 1 and ((p, node) in edges or (node, p) in edges)]
                assert x.parent == min(near)
                kind = edges[(x.parent, node) if x.forward else (node, x.parent)]
                assert (x.relation, x.verified) == kind
    ways = graph.explained_paths(reached, reached.where("distance >= 2"), 5).collect()
    assert {(w.start, w.node) for w in ways} == {k for k, x in got.items() if x.distance >= 2}
    for w in ways:
        assert w.path[0] == w.start and w.path[-1] == w.node and len(w.path) == w.distance + 1
        hops = [got[w.start, n] for n in w.path[1:]]
        assert [h.parent for h in hops] == w.path[:-1] and [h.relation for h in hops] == w.relations and w.verified == all(h.verified for h in hops)
    only = graph.explained_distances(frame, spark.createDataFrame([(0,)], "node long"), 5, "a").collect()
    assert {x.relation for x in only} <= {"a", None}


def test_chains_are_explained(spark):
    chains = spark.createDataFrame([("x", ["m1", "m2", "m3"]), ("y", ["m2", "m3"]), ("z", ["m4"])], "chain_id string, path array<string>")
    edges = spark.createDataFrame([("m1", "m2", "causes", False, ["e1"]), ("m2", "m3", "precedes", True, []), ("m9", "m1", "causes", False, [])], "src string, dst string, relation string, temporal boolean, evidence array<string>")
    records = spark.createDataFrame(
        [("m1", ["a"], "config_change", 1, False), ("m2", ["a", "b"], "event", 2, False), ("m3", ["c"], "outage", None, False), ("m4", None, "event", 4, True)],
        "memory_id string, asset_ids array<string>, event_type string, observed_at long, changed boolean",
    )
    got = {r.chain_id: r for r in graph.explained_chains(chains, edges, records, ["config_change"], ["outage", "alarm"]).collect()}
    x, y, z = got["x"], got["y"], got["z"]
    assert (x.path, x.relations, x.assets, x.early_change, x.hidden_failure, x.verified) == (["m1", "m2", "m3"], ["causes", "precedes"], ["a", "b", "c"], "m1", True, False)
    assert (y.relations, y.early_change, y.hidden_failure) == (["precedes"], None, False)
    assert (z.relations, z.assets, z.early_change, z.verified) == ([], [], "m4", True)


def test_contracts_come_from_a_table(spark):
    rules = [
        ("ban", "pre", "r1", "before", "$.host.up", "eq", "true", None, "host is down"),
        ("ban", "pre", "r2", "args", "$.ttl", "le", "3600", None, "ttl too long"),
        ("ban", "post", "r3", "after", "$.rules", "gt", "$.rules", "before", "no rule added"),
        ("ban", "invariant", "r4", "", "$.owner", "in", "noc|soc", None, "owner unknown"),
        ("ban", "readback", "r5", "after", "", "", None, None, ""),
        ("look", "post", "r6", "result", "$.rows", "exists", None, None, "no rows"),
        ("look", "pre", "r7", "args", "$.q", "matches", "^[a-z]+$", None, "bad query"),
    ]
    good = {"host": {"up": True}, "rules": 9, "owner": "noc"}
    then = {"host": {"up": True, "ban": {"ip": "10.0.0.1", "tags": ["a", {"b": 1.0}]}}, "rules": 10, "owner": "soc"}
    want = {"host": {"ban": {"ip": "10.0.0.1", "tags": ["a", {"b": 1}]}}}
    steps = [
        (1, "ban", "ban", good, then, {"ttl": 60}, {}, want),
        (2, "ban", "ban", good | {"host": {"up": False}}, then | {"rules": 9, "owner": "x"}, {"ttl": 7200}, {}, {"host": {"ban": {"ip": "10.0.0.2"}}}),
        (3, "ban", "ban", good, then, {"ttl": 60}, {}, None),  # writes, but states no effect
        (4, "ban", "ban", good, then, {"ttl": 60}, {}, {"host": {"ban": {"tags": ["a"]}}}),  # arrays are wholes
        (5, "look", "other", {}, {}, {"q": "abc"}, {"rows": []}, None),
        (6, "look", None, None, None, {"q": "A1"}, {"rows": None}, {}),
        (7, "unknown", "unknown", None, None, None, None, {"a": 1}),
        (8, "unknown", "unknown", None, None, None, None, None),
    ]
    text = lambda v: None if v is None else json.dumps(v)
    frame = spark.createDataFrame([(i, s, n, *map(text, x)) for i, s, n, *x in steps], "step_id long, skill string, result_skill string, before string, after string, args string, result string, intended string")
    table = spark.createDataFrame(rules, "skill string, phase string, rule string, side string, path string, op string, operand string, other string, message string")
    got = {r.step_id: r for r in contracts.check_steps(frame, table).collect()}
    lost, low = contracts.NOT_LANDED, "step judge score below threshold: "
    assert got[1].passed and got[1].violations == [] and got[1].score == 1.0
    assert got[2].violations == ["host is down", "ttl too long", "no rule added", "after: owner unknown", lost, low + "0.0000"]
    assert (got[2].pre, got[2].post, got[2].invariants, got[2].readback) == (2, 1, 1, 1)
    assert got[3].violations == got[4].violations == [lost, low + "0.0000"]
    assert got[5].violations == [low + "0.2500"]
    assert got[6].violations == ["bad query", "no rows", low + "0.0000"]
    assert got[7].violations == [lost, low + "0.0000"] and got[8].passed
    assert contracts.check_steps(frame.limit(0), table).count() == 0


def test_coded_search_finds_most_and_scores_few(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24))
    x[1000:2000] = x[1000] + 1e-3 * rng.normal(size=(1000, 24))  # a third of the rows all but equal: one full cell
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>").repartition(6)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 3000, 60)], "query_id long, vector array<double>")
    found, exact = ann.search(rows, asked, 10, short=300).collect(), retrieval.flat_search(rows, asked, 10).collect()
    pairs = lambda r: {(a.query_id, a.doc_id) for a in r}
    # Ties of the near copies are left out: of those any ten are as good.
    score = {(r.query_id, r.doc_id): r.score for r in exact}
    last = {q: min(s for (a, _), s in score.items() if a == q) for q, _ in score}
    good = sum(r.score >= last[r.query_id] - 1e-2 for r in found)
    assert good >= 0.95 * len(exact) and len(pairs(found)) == len(found)
    assert all(r.score == pytest.approx(float(x[r.query_id] @ x[r.doc_id]), abs=1e-4) for r in found)
    assert ann.search(rows.limit(0), asked, 10).count() == 0
    assert ann.search(rows, asked.limit(0), 10).count() == 0
    assert ann.search(rows.limit(3), asked, 10).groupBy("query_id").count().where("count <> 3").count() == 0
