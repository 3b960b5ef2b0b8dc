"""Work that has to grow with the input, not with the square of its groups; results against plain loops."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import ann, blocks, casework, contracts, evaluate, exposure, graph, joins, knowledge, memory, nested, retrieval, signals
from skein.plans import casework as cases_plan
from skein.plans import timeline, upkeep
from skein.streaming import learn


def shuffled(spark, run):
    """What ``run`` gives, and how many records its stages wrote to shuffles."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    nothing = gateway.jvm.java.util.ArrayList

    def stages():
        found = store.stageList(nothing(), False, False, gateway.new_array(gateway.jvm.double, 0), nothing())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = set(stages())
    rows = run()
    return rows, sum(n for k, n in stages().items() if k not in before)


def memories(spark, rows, prefix="m"):
    cols = "memory_id string, tier string, tags array<string>, asset_ids array<string>, quarantined boolean, insertion_order long"
    return spark.createDataFrame([(f"{prefix}{n}", t, tags, assets, False, n) for n, (t, tags, assets) in enumerate(rows)], cols)


def drawn(rng, n, most):
    return [(rng.choice("ab"), rng.sample([f"t{i}" for i in range(12)], rng.randint(0, most)), rng.sample("xyz", rng.randint(0, 2))) for _ in range(n)]


def alike(a, b):
    j = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    return round(0.6 * j(set(a[1]), set(b[1])) + 0.4 * j(set(a[2]), set(b[2])), 4)


def nearest(asked, records, k, own, tiers, least=1e-9):
    out = []
    for i, a in enumerate(asked):
        near = sorted((-alike(a, b), j) for j, b in enumerate(records) if not (own and i == j) and (not tiers or a[0] == b[0]) and alike(a, b) >= least)
        out += [(i, j, -s) for s, j in near[:k]]
    return sorted(out)


def test_the_closest_records_equal_a_loop(spark):
    rng = random.Random(5)
    records, asked = drawn(rng, 150, 9), drawn(rng, 60, 9)  # some on either side hold more keys than are met on subsets
    got = memory.closest(memories(spark, records), memories(spark, asked, "c"), 2, ["tier"]).collect()
    assert sorted((int(r.cid[1:]), r.o, r.s) for r in got) == nearest(asked, records, 2, False, True)
    got = memory.similar_links(memories(spark, records)).collect()
    assert sorted((int(r.memory_id[1:]), int(r.other[1:]), r.score) for r in got) == nearest(records, records, 3, True, False, 0.34)


def test_copies_of_records_do_not_meet_in_pairs(spark):
    store, asked = memories(spark, [("a", ["x", "y"], ["h"])] * 2000).repartition(4).cache(), memories(spark, [("a", ["x", "z"], ["h"])] * 1000, "c").repartition(4).cache()
    store.count(), asked.count()
    rows, n = shuffled(spark, lambda: memory.route(store, asked).collect())
    assert len(rows) == 1000 and {(r.op, r.target_id, r.similarity) for r in rows} == {("ADD", None, 0.6)} and n < 20_000
    rows, n = shuffled(spark, lambda: memory.similar_links(store).collect())
    first = {r.other for r in rows}
    assert len(rows) == 6000 and first == {"m0", "m1", "m2", "m3"} and n < 60_000


def test_the_best_skill_equals_a_loop_and_copies_do_not_meet_in_pairs(spark):
    rng = random.Random(7)
    skills = [(f"s{i}", rng.randint(0, 3), rng.sample(range(15), rng.randint(0, 9))) for i in range(120)]
    cases = [(i, [rng.randrange(15) for _ in range(rng.randint(0, 9))]) for i in range(80)]
    frames = lambda c, s: (spark.createDataFrame(c, "case_id long, terms array<long>"), spark.createDataFrame(s, "name string, cost long, tags array<long>"))
    want = {}
    for i, terms in cases:
        hits = [(len(set(terms) & set(tags)), -cost, name) for name, cost, tags in skills if set(terms) & set(tags)]
        want |= {i: (max(hits)[2], max(hits)[0])} if hits else {}
    assert {r.case_id: (r.skill, r.hits) for r in evaluate.best_skill(*frames(cases, skills)).collect()} == want
    many = frames([(i, [1, 2]) for i in range(2000)], [(f"s{i:04}", 1, [2, 1, 3]) for i in range(1000)])
    rows, n = shuffled(spark, lambda: evaluate.best_skill(*many).collect())
    assert len(rows) == 2000 and {(r.skill, r.hits) for r in rows} == {("s0999", 2)} and n < 20_000


def test_flat_search_holds_a_tile_at_once(spark):
    rng = np.random.default_rng(4)
    vectors, asked = rng.integers(-3, 4, (3000, 8)).astype(float), rng.integers(-3, 4, (600, 8)).astype(float)  # many equal scores
    frame = lambda x, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vector array<double>")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in retrieval.flat_search(frame(vectors, "doc_id"), frame(asked, "query_id"), 7).collect()}
    score = asked @ vectors.T
    want = {(i, n + 1): (int(j), score[i, j]) for i in range(600) for n, j in enumerate(np.lexsort((np.arange(3000), -score[i]))[:7])}
    assert got == want
    rows, names = np.full((256, 7), -np.inf), np.full((256, 7), retrieval.NONE)
    tracemalloc.start()
    for i in range(0, 3000, 1024):
        rows, names = retrieval._first(rows, names, score[:256, i : i + 1024], np.arange(i, min(i + 1024, 3000)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(names, [[want[i, n + 1][0] for n in range(7)] for i in range(256)]) and peak < 64 << 20


def test_ties_of_communities_grow_with_their_nodes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(casework, "community_profiles", lambda members, ties: seen.append((members, ties)) or members)
    cases_plan.community_profiles(spark, "/root/testdata/sf0.1")
    members, ties = seen[0]
    assert ties.count() <= 4 * members.count()  # pairs within a segment and group were 5.8 times as many


def test_recall_equals_a_loop_and_copies_do_not_meet_in_pairs(spark):
    rng = random.Random(3)
    pick = lambda n, most: rng.sample([f"t{i}" for i in range(10)], rng.randint(0, min(n, most)))
    records = [(f"m{i}", pick(9, 9), rng.sample("xyz", rng.randint(0, 2)), rng.choice([0.5, 0.95]), rng.random() < 0.8, i) for i in range(150)]
    asked = [(i, pick(9, 9), rng.sample("xyz", rng.randint(0, 2))) for i in range(60)]
    frames = lambda r, c: (spark.createDataFrame(r, "memory_id string, tags array<string>, asset_ids array<string>, confidence double, observed boolean, insertion_order long"), spark.createDataFrame(c, "case_id long, terms array<string>, assets array<string>"))
    want = {}
    for i, terms, assets in asked:
        fit = [m for m, tags, own, sure, seen, _ in records if terms and sure >= 0.9 and seen and set(own) & set(assets) and len(set(tags) & set(terms)) / len(terms) >= 0.6]
        want |= {i: fit[0]} if fit else {}
    assert want and {r.case_id: r.memory_id for r in casework.recall_episode(*frames(records, asked), least=0.6).collect()} == want
    many = frames([(f"m{i}", ["a", "b", "c"], ["x"], 1.0, True, i) for i in range(2000)], [(i, ["a", "b"], ["x"]) for i in range(1000)])
    rows, n = shuffled(spark, lambda: casework.recall_episode(*many).collect())
    assert len(rows) == 1000 and {r.memory_id for r in rows} == {"m0"} and n < 20_000


def test_event_search_equals_a_loop_and_entities_do_not_meet_in_pairs(spark):
    rng = random.Random(9)
    maybe = lambda x: None if rng.random() < 0.1 else x
    events = [(i, maybe(rng.randrange(6)), maybe(rng.randrange(30)), maybe(rng.choice("FOP")), maybe(rng.sample(range(8), rng.randint(0, 3)))) for i in range(400)]
    asked = [(i, maybe(rng.randrange(8)), a, a + rng.randrange(4), maybe(rng.choice("FO")), maybe(rng.sample(range(8), rng.randint(0, 2)))) for i in range(50) for a in [rng.randrange(30)]]
    frames = lambda e, q: (spark.createDataFrame(e, "doc_id long, entity long, day int, type string, hints array<int>"), spark.createDataFrame(q, "query_id long, entity long, first_day int, last_day int, type string, hints array<int>"))
    want = {}
    for q, e, a, z, y, hs in asked:
        scored = []
        for d, own, day, kind, hints in events:
            entity, time = e is not None and own == e, day is not None and a <= day <= z
            if entity or time:
                scored.append((-(3.0 * entity + 2.0 * time + 0.5 * (y is not None and kind == y) + 0.5 * bool(set(hints or []) & set(hs or []))), d))
        want |= {(q, n + 1): (d, -s) for n, (s, d) in enumerate(sorted(scored)[:10])}
    assert {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in evaluate.event_search(*frames(events, asked)).collect()} == want
    many = frames([(i, 1, 1, "F", [1]) for i in range(2000)], [(i, 1, 5, 6, "F", [1]) for i in range(500)])
    rows, n = shuffled(spark, lambda: evaluate.event_search(*many).collect())
    assert len(rows) == 5000 and {(r.doc_id, r.score) for r in rows} == {(i, 4.0) for i in range(10)} and n < 100_000


def test_counts_between_equal_a_loop_without_pairs(spark):
    rng = random.Random(1)
    points = [(rng.choice("ab"), rng.randrange(20_000)) for _ in range(300)]
    spans = [(i, rng.choice("abc"), a, a + rng.randrange(-50, 9_000)) for i in range(100) for a in [rng.randrange(20_000)]]
    at = lambda df, *c: df.selectExpr(*[x for x in df.columns if x not in c], *[f"timestamp_seconds({x}) AS {x}" for x in c])
    p, s = at(spark.createDataFrame(points, "u string, t long"), "t"), at(spark.createDataFrame(spans, "id long, u string, s long, e long"), "s", "e")
    for by in ((), ("u",)):
        got = {r.id: r.n for r in joins.counts_between(p, "t", s, "id", "s", "e", by, 1000).collect() if r.n}
        assert got == {i: n for i, u, a, z in spans if (n := sum(a <= t <= z and (not by or u == v) for v, t in points))}
    _, n = shuffled(spark, lambda: timeline.entity_or_time(spark, "/root/testdata/sf0.01").collect())
    assert n < 10 * 10_000  # a few for each event


def test_labels_run_by_what_hangs_together(spark):
    rng = random.Random(6)
    edges = sorted({("g", *sorted(rng.sample(range(k, k + 12), 2))) for k in (0, 100, 200) for _ in range(25)})
    edges = [(g, a, b, float(rng.randint(1, 3))) for g, a, b in edges]
    label = {n: n for e in edges for n in e[1:3]}
    for _ in range(24):
        for n in sorted(label):
            weight = {}
            for _, a, b, w in edges:
                for m in ([b] if a == n else []) + ([a] if b == n else []):
                    weight[label[m]] = weight.get(label[m], 0) + w
            label[n] = min(weight, key=lambda x: (-weight[x], x))
    found = graph.label_propagation(spark.createDataFrame(edges, "g string, a long, b long, weight double"), "g")
    assert {r.node: r.label for r in found.collect()} == label
    assert "_part" in found._jdf.queryExecution().toString()  # each part of a group that hangs together is a task's own


def test_values_of_parameters_are_told_once(spark):
    params, cases, inputs, _ = upkeep._suite(spark, "/root/testdata/sf0.01")
    told = upkeep._values(params, cases)
    key = ["spec", "param", "value"]
    assert told.count() <= 12 * params.count() < inputs.count() and told.exceptAll(inputs).isEmpty()
    assert sorted(map(tuple, told.select(*key).distinct().collect())) == sorted(map(tuple, inputs.select(*key).distinct().collect()))


def test_mutual_nearest_compares_equal_sets_once(spark):
    rng = random.Random(8)
    sets = [(i, rng.sample(range(9), rng.randint(0, 4))) for i in range(120)]  # many are equal
    j = lambda a, b: round(len(set(a) & set(b)) / len(set(a) | set(b)), 6) if a or b else 0.0
    best = {a: min((-j(x, y), b) for b, y in sets if b != a) for a, x in sets}
    want = {(a, b, -s) for a, (s, b) in best.items() if -s >= 0.3 and best[b][1] == a and a < b}
    pairs = joins.nearest_pairs(spark.createDataFrame(sets, "id long, s array<long>"), "id", "s", 0.3)
    assert want and {(r.a, r.b, r.score) for r in joins.mutual_nearest(pairs).collect()} == want
    copies = joins.nearest_pairs(spark.range(2000).selectExpr("id", "array(1, 2, 3) AS s"), "id", "s", 0.3)
    assert copies.count() == 2 * 1999


def test_similar_specs_count_equal_words_once(spark):
    rng = random.Random(2)
    specs = [(i, rng.sample("abcdefgh", rng.randint(0, 4)), ["p"]) for i in range(150)]  # many are equal
    frame = spark.createDataFrame(specs, "spec_id long, words array<string>, params array<string>")
    want = set()
    for i, x, _ in specs[::5]:
        near = sorted((-len(set(x) & set(y)) / len(set(x) | set(y)), k) for k, y, _ in specs if k != i and set(x) & set(y))
        want |= {(i, k, n + 1, round(-s, 4)) for n, (s, k) in enumerate(near[:2])}
    assert {(r.spec_id, r.other, r["rank"], r.score) for r in exposure.similar_specs(frame, frame.where("spec_id % 5 = 0")).collect()} == want
    many = spark.range(2000).selectExpr("id AS spec_id", "array('a', 'b') AS words", "array('p') AS params").repartition(4)
    rows, n = shuffled(spark, lambda: exposure.similar_specs(many, many).collect())
    assert len(rows) == 4000 and {r.other for r in rows} == {0, 1, 2} and n < 60_000


def test_coded_search_tells_no_more_than_the_best_of_a_task(spark, monkeypatch):
    """Many small cells and several blocks of queries: rows told to the shuffle do not grow with the blocks of the index."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 4000, 100)], "query_id long, vector array<double>")
    codes = ann.fit(rows, cells=32)
    blocks = ann.index(rows, codes)
    assert blocks.count() >= 32
    monkeypatch.setattr(ann, "ASKED", 16)
    monkeypatch.setattr(ann, "CHUNK", 7)
    monkeypatch.setattr(ann, "BLOCK", 500)
    found, n = shuffled(spark, lambda: ann.search(rows, asked, 10, short=50, codes=codes, blocks=blocks).collect())
    # Of the 40 queries 50 rows a task that reads the index, these once more to fetch them, and the rows themselves.
    assert len(found) == 400 and n <= 40 * 50 * blocks.rdd.getNumPartitions() + 3 * 40 * 50 + 4000
    c = codes.value
    cell, code = c.encode(x)
    about = c.scores(x[::100], cell, code)
    for i, q in enumerate(range(0, 4000, 100)):
        best = np.lexsort((np.arange(4000), -about[i]))[:50]
        exact = np.round(x[best] @ x[q], 5)
        want = best[np.lexsort((best, -exact))][:10]
        assert [r.doc_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == want.tolist()
    some = ann.search(rows, asked, 10, short=50, codes=codes, blocks=blocks, probed=0.5).collect()
    near = x[::100] @ c.centre.T
    for i, q in enumerate(range(0, 4000, 100)):
        probes = set(np.argsort(-near[i], kind="stable")[:16].tolist())
        assert all(int(cell[r.doc_id]) in probes for r in some if r.query_id == q)


def test_inputs_shared_by_profile_judge_cases_as_inputs_by_case(spark):
    """The same cases with every input listed, and with what they have alike given once a profile."""
    params = spark.createDataFrame([(s, p, p % 4, 2 if p % 3 else None, 8 if p % 3 else None, p % 4 == 0) for s in (0, 1) for p in range(9)], "spec int, param long, default long, low long, high long, required boolean")
    kinds, roles = casework.KINDS[:4], ("min", "just_inside", None)
    listed = [(c % 2, c, kinds[c % 7 % 4], c % 9 if c % 3 else None, roles[c % 5 % 3], None, "E1", c % 12) for c in range(240)]
    cases = spark.createDataFrame(listed, "spec int, case_id long, kind string, target_param long, role string, target_error string, expected string, profile long")
    sets = lambda i, p: (i + p) % 11 if (i + p) % 5 < 3 or p % 4 == 0 and i % 3 else None
    shared = [(s, i, p, sets(i, p)) for s in (0, 1) for i in range(12) if i % 2 == s for p in range(9) if sets(i, p) is not None]
    own = [(s, c, t, c % 10) for s, c, _, t, _, _, _, i in listed if t is not None and sets(i, t) is None and c % 4] + [(s, c, 100 + c, 1) for s, c, *_ in listed if c % 31 == 0]
    every = own + [(s, c, p, sets(i, p)) for s, c, *_, i in listed for p in range(9) if sets(i, p) is not None]
    frame = lambda rows, key: spark.createDataFrame(rows, f"spec int, {key} long, param long, value long")
    errors = spark.createDataFrame([(s, "E1") for s in (0, 1)], "spec int, code string")
    ask = lambda df: sorted(map(str, df.collect()))
    by_case, by_profile = frame(every, "case_id"), (frame(own, "case_id"), frame(shared, "profile"))
    got = casework.case_defects(params, cases, *by_profile)
    assert ask(got) == ask(casework.case_defects(params, cases, by_case)) and got.select("defect").distinct().count() >= 6
    assert ask(casework.scorecard(params, cases, by_profile[0], errors, by_profile[1])) == ask(casework.scorecard(params, cases, by_case, errors))


def test_corpus_signals_count_pairs_of_records_in_tasks(spark, monkeypatch):
    rng = random.Random(31)
    monkeypatch.setattr(signals, "BLOCK", 90, raising=False)  # several blocks
    rows = [(i, [f"t{j}" for j in rng.sample(range(14), 5)]) for i in range(400)] + [(400 + i, ["t1", "t2", "t3", "t4", "t5"]) for i in range(500)] + [(900, []), (901, ["one"])]
    frame = spark.createDataFrame(rows, "memory_id long, tags array<string>").repartition(4).cache()
    frame.count()
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # else what is small is joined in one task, which shuffles nothing
    for k, v in held.items():
        spark.conf.set(k, v)
    got, n = shuffled(spark, lambda: signals.corpus_signals(frame, link=0.5, probe_terms=3, probe_k=4).collect())
    for k in held:
        spark.conf.unset(k)
    assert n < 40_000  # 902 records make over 100,000 pairs
    sets = {i: set(t) for i, t in rows}
    df = Counter(t for s in sets.values() for t in s)
    access = Counter()
    for i, s in sets.items():
        probe = set(sorted(s, key=lambda t: (df[t], t))[:3])
        access.update(j for m, j in sorted((-len(probe & sets[j]), j) for j in sets if j != i)[:4] if m < 0)
    links = {i: sum(1 for j, t in sets.items() if j != i and s and t and len(s & t) / len(s | t) >= 0.5) for i, s in sets.items()}
    assert {r.memory_id: (r.links, r.access_count) for r in got} == {i: (links[i], access[i]) for i in sets}


def test_shared_terms_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(signals, "CHUNK", 7)
    rng = np.random.default_rng(3)
    sides = [[np.unique(rng.integers(0, 12, rng.integers(1, 8))) for _ in range(n)] for n in (9, 11)]
    x, y = ((np.repeat(np.arange(len(s)), [len(t) for t in s]), np.concatenate(s)) for s in sides)
    pieces = list(signals._pairs(x, y, 12))
    want = {(a, b): len(np.intersect1d(s, t)) for a, s in enumerate(sides[0]) for b, t in enumerate(sides[1]) if len(np.intersect1d(s, t))}
    assert len(pieces) > 1 and {(int(a), int(b)): int(n) for p in pieces for a, b, n in zip(*p)} == want


def test_lockstep_equals_a_loop_and_near_stamps_do_not_become_rows(spark):
    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    rows = {(rng.choice("xy"), rng.randrange(60), start + timedelta(seconds=rng.randrange(900))) for _ in range(1500)} | {(None, 1, start), ("x", None, start), ("x", 1, None)}
    frame = spark.createDataFrame(sorted(rows, key=str), "g string, n long, t timestamp").repartition(4).cache()
    frame.count()
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in held.items():
        spark.conf.set(k, v)
    got, n = shuffled(spark, lambda: graph.lockstep(frame, "n", "t", 60, 4, 0.9, "g").collect())
    for k in held:
        spark.conf.unset(k)
    assert n < 15_000  # about 1,500 stamps have over 140,000 others near
    hits, size = {}, {}
    for g, a, t in rows:
        if a is not None and t is not None:
            size.setdefault(a, set()).add(t)
        for h, b, u in rows:
            if None not in (g, a, t, b, u) and g == h and a < b and abs((t - u).total_seconds()) <= 60:
                hits.setdefault((a, b), set()).add(t)
    ratio = {p: len(h) / min(len(size[p[0]]), len(size[p[1]])) for p, h in hits.items()}
    want = {(a, b): (len(hits[a, b]), round(r, 4)) for (a, b), r in ratio.items() if len(hits[a, b]) >= 4 and round(r, 4) >= 0.9}
    assert 0 < len(want) < len(hits) and {(r.a, r.b): (r.hits, r.ratio) for r in got} == want


def test_lockstep_counts_near_stamps_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    tiles = [pd.DataFrame({"i": 0, "j": j, "side": n % 2 * j, "g": rng.choice(["x", "y"], 90), "n": n, "t": rng.integers(0, 40, 90) * 1_000_000, "m": 9}).drop_duplicates() for j in (0, 1) for n in [rng.integers(0, 12, 90)]]
    run = graph._steps(3, 2, 0.1)
    whole = [run(t.copy()) for t in tiles]
    monkeypatch.setattr(graph, "CHUNK", 5)
    for a, t in zip(whole, tiles):
        order = ["a", "b", "hits", "m"]
        assert len(a) and a.sort_values(order).to_numpy().tolist() == run(t.copy()).sort_values(order).to_numpy().tolist()


def test_nested_values_are_taken_apart_within_their_rows(spark):
    rows = [(i, '{"b": [1, {"x": null, "a": [true, [2.5, {"d": {"e": "deep"}}]]}], "a": "%d"}' % i) for i in range(50)]
    frame = spark.createDataFrame(rows, "k long, j string").repartition(4).cache()
    frame.count()
    got, n = shuffled(spark, lambda: nested.text(frame, "j", "k").collect())
    assert {r.k: r.text for r in got} == {i: f"a {i} b 1 a True 2.5 d e deep x None" for i in range(50)} and n < 20
    got, n = shuffled(spark, lambda: nested.summaries(frame, "j", "k").collect())
    assert {r.k: r.summary for r in got} == {i: '{"a":"%d","b":[1,{"a":[true,"[depth-limited]"],"x":null}]}'.replace("true,", '"[depth-limited]",') % i for i in range(50)} and n < 20
    got, n = shuffled(spark, lambda: nested.nodes(frame, "j", "k").collect())
    assert len(got) == 50 * 13 and n < 50


def test_steps_are_not_sent_by_skill(spark):
    steps = [(i, "ab"[i % 2], "ab"[i % 2], '{"s": 1}', '{"s": {"t": [1, 2]}}', "{}", "{}", '{"s": {"t": [1, %d]}}' % (i % 3)) for i in range(600)]
    frame = spark.createDataFrame(steps, "step_id long, skill string, result_skill string, before string, after string, args string, result string, intended string").repartition(4).cache()
    frame.count()
    rules = spark.createDataFrame([("a", "pre", "r1", "before", "$.s", "eq", "1", None, "no"), ("b", "post", "r2", "after", "$.s", "exists", None, None, "none")], "skill string, phase string, rule string, side string, path string, op string, operand string, other string, message string")
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in held.items():
        spark.conf.set(k, v)
    got, n = shuffled(spark, lambda: contracts.check_steps(frame, rules).collect())
    for k in held:
        spark.conf.unset(k)
    assert {r.step_id: r.readback for r in got} == {i: int(i % 3 != 2) for i in range(600)} and n < 1500


def test_what_roots_learn_is_not_ordered_by_root(spark):
    payload = lambda kind, i: {"diagnosis_completed": '{"root_cause_key": "c%d", "evidence": [{"evidence_id": "e"}]}' % (i % 2), "verifier_result": '{"passed": true}', "tool_called": '{"skill": "s%d", "evidence_ids": ["e"]}' % (i % 3)}[kind]
    events = [(f"r{i:03}", i * 10 + j, kind, payload(kind, i)) for i in range(40) for j, kind in enumerate(("tool_called", "diagnosis_completed", "verifier_result"))]
    frame = spark.createDataFrame(events, "run_id string, seq long, kind string, payload string")
    cases = spark.createDataFrame([], "run_id string, terms array<string>, assets array<string>")
    told = learn.learn(learn.empty(spark), frame, cases, spark.createDataFrame([], "run_id string, evidence_id string, contradicts string"))["memories"]
    assert "Window" not in told._jdf.queryExecution().executedPlan().toString()  # two roots would be two tasks
    got = {r.memory_id: (r.tags, r.importance, r.last_run) for r in told.collect()}
    assert got["proc-c1"] == (["c1", "root:c1", "skill:s1", "skill:s0", "skill:s2"], 19.0, "r039") and got["sem-c0"] == (["c0", "root:c0"], 19.0, "r038")


def test_a_second_search_reads_made_tokens(spark):
    made = spark.sparkContext.accumulator(0)

    def cut(text):
        made.add(1)
        return text.split()

    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i}") for i in range(30)], "doc_id long, text string").select("doc_id", F.udf(cut, "array<string>")("text").alias("tokens"))
    asked = spark.createDataFrame([(1, ["b1"]), (2, ["a", "c2"])], "query_id long, tokens array<string>")
    assert len(casework.reflect(docs, asked, 4, 2, 3).collect()) == 8 and made.value == 30


def test_tiers_equal_all_candidates_and_pairs_stay_in_tasks(spark):
    rng = random.Random(26)
    said = [f"w{i}" for i in range(12)]
    links = lambda n: [f"m{rng.randrange(n)}" for _ in range(rng.randint(0, 3))]
    rows = [(f"m{i}", rng.choice([*"abc", None]), rng.choices(said, k=rng.randint(1, 9)) if i % 17 else None, rng.choices("xyz", k=rng.randint(0, 2)), links(400), rng.random(), float(rng.randint(0, 4)), 1 + rng.random(), i % 29 == 0, i // 2) for i in range(400)]
    rows += [(f"copy{i}", "a", ["w1", "w2"], ["x"], [f"m{i}"], 1.0, 1.0, 1.0, False, 1000 + i) for i in range(3000)]
    cols = "memory_id string, tier string, tokens array<string>, asset_ids array<string>, links array<string>, strength double, importance double, confidence double, quarantined boolean, insertion_order long"
    records = spark.createDataFrame(rows, cols).repartition(4).cache()
    asked = spark.createDataFrame([(i, rng.choices(said, k=5) if i % 7 else [], rng.choices("xyz", k=2)) for i in range(40)] + [(40, [], []), (41, None, None)], "query_id int, tokens array<string>, assets array<string>").cache()
    near = spark.createDataFrame([(i, f"m{rng.randrange(400)}", rng.uniform(-0.5, 1)) for i in range(41) for _ in range(9)], "query_id int, memory_id string, score double")
    records.count(), asked.count()
    for dense, per_tier, frontier in ((None, 3, 48), (near, 4, 2)):
        order = Window.partitionBy("query_id", "tier").orderBy(F.desc("final"), "insertion_order", "memory_id")
        every = knowledge.tiered_candidates(records, asked, 2, frontier, dense).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_tier)
        want = {tuple(r) for r in every.select("query_id", "tier", "memory_id", "final", "hop", "parent", "rank").collect()}
        rows, n = shuffled(spark, lambda: knowledge.tiered(records, asked, per_tier, 2, frontier, dense).collect())  # noqa: B023
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
        assert n < 60_000  # of pairs of a query and a record there are 130,000


def test_rounding_in_tasks_is_that_of_spark(spark):
    x = [0.0, 0.0000005, 1.0000005, 2.5000015, 1234.5678905, 0.1234565, 7.0000014999999999] + [random.Random(i).random() * 40 for i in range(500)]
    want = [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").withColumn("y", F.round("x", 6)).orderBy("i").collect()]
    assert retrieval.round_half_up(np.array(x)).tolist() == want


def test_ways_are_told_by_codes_and_nulls_come_last(spark):
    edges = [(0, 1, "b", None), (0, 1, "b", False), (0, 2, None, True), (0, 2, "z", True), (2, 3, None, None), (3, 0, "a", False)]
    frame = spark.createDataFrame(edges, "src long, dst long, relation string, verified boolean")
    got = {tuple(r)[1:] for r in graph.explained_distances(frame, spark.createDataFrame([(0,)], "node long"), 2).collect()}
    assert got == {(0, 0, None, None, None, True), (1, 1, 0, "b", True, False), (2, 1, 0, "z", True, True), (3, 1, 0, "a", False, False)}
    rng = random.Random(30)
    rows = spark.createDataFrame([(rng.randrange(400), -1 - rng.randrange(2000), rng.choice("ARN"), rng.random() < 0.5) for _ in range(30_000)], "src long, dst long, relation string, verified boolean").repartition(4).cache()
    starts = spark.createDataFrame([(i,) for i in range(0, 400, 10)], "node long").cache()
    rows.count(), starts.count()

    def run():
        reached = graph.explained_distances(rows, starts, 2)
        return graph.explained_paths(reached, F.col("distance") == 2, 2).collect()

    ways, n = shuffled(spark, run)
    hops = {}
    for a, b, kind, sure in (tuple(r) for r in rows.collect()):
        for x, y, against in ((a, b, False), (b, a, True)):
            hops.setdefault(x, {}).setdefault(y, []).append((not sure, kind, against))
    want = set()
    for s in range(0, 400, 10):
        for y in {y for p in hops.get(s, {}) for y in hops[p]} - {s} - set(hops.get(s, {})):
            p = min(p for p in hops[s] if y in hops[p])
            one, two = min(hops[s][p]), min(hops[p][y])
            want.add((s, y, 2, (s, p, y), (one[1], two[1]), not (one[0] or two[0])))
    assert {(r.start, r.node, r.distance, tuple(r.path), tuple(r.relations), r.verified) for r in ways} == want and len(ways) == len(want)
    print("records shuffled", n)
    assert n < 130_000


def test_similar_specs_of_many_sets_are_counted_in_tasks(spark, monkeypatch):
    rng = random.Random(21)
    monkeypatch.setattr(exposure, "ASKED", 40, raising=False)  # several blocks on either side
    monkeypatch.setattr(exposure, "HELD", 500, raising=False)
    specs = [(i, [f"{c}{rng.randrange(n)}" for c, n in zip("abcde", (3, 4, 8, 15, 25))][: 5 if i % 7 else 2], ["p"]) for i in range(1500)]
    frame = spark.createDataFrame(specs, "spec_id long, words array<string>, params array<string>").repartition(4).cache()
    frame.count()
    want = set()
    for i, x, _ in specs[::10]:
        near = sorted((-len(set(x) & set(y)) / len(set(x) | set(y)), k) for k, y, _ in specs if k != i and set(x) & set(y))
        want |= {(i, k, n + 1, round(-s, 4)) for n, (s, k) in enumerate(near[:2])}
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in held.items():
        spark.conf.set(k, v)
    rows, n = shuffled(spark, lambda: exposure.similar_specs(frame, frame.where("spec_id % 10 = 0")).collect())
    for k in held:
        spark.conf.unset(k)
    assert {(r.spec_id, r.other, r["rank"], r.score) for r in rows} == want
    assert n < 30_000  # 150 asked sets share words with most of 1,500


def test_nearest_of_many_sets_are_found_in_tasks(spark, monkeypatch):
    rng = random.Random(22)
    monkeypatch.setattr(joins, "MET", (150, 200), raising=False)  # several blocks
    sets = [(i, [*rng.sample(range(40), rng.randint(10, 20)), *rng.sample(range(100, 400), rng.randint(0, 3))]) for i in range(700)]
    j = lambda a, b: round(len(a & b) / len(a | b), 6)
    whole = [(i, set(s)) for i, s in sets]
    best = {a: min((-j(x, y), b) for b, y in whole if b != a) for a, x in whole}
    want = {(a, b, -s) for a, (s, b) in best.items() if -s >= 0.3 and best[b][1] == a and a < b}
    frame = spark.createDataFrame(sets, "id long, s array<long>").repartition(4).cache()
    frame.count()
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in held.items():
        spark.conf.set(k, v)
    rows, n = shuffled(spark, lambda: joins.mutual_nearest(joins.nearest_pairs(frame, "id", "s", 0.3)).collect())
    for k in held:
        spark.conf.unset(k)
    assert want and {(r.a, r.b, r.score) for r in rows} == want
    assert n < 20_000  # 700 sets make 244,650 pairs


def test_corpus_signals_of_long_texts_keep_to_blocks_of_terms(spark, monkeypatch):
    """Blocks are bounded by their terms, and the terms of pairs are looked at in pieces."""
    tracemalloc.start()
    rng = np.random.default_rng(4)
    texts = [np.unique(rng.integers(0, 30_000, 4000)) for _ in range(150)]
    texts += [np.unique(np.concatenate([t[: 9 * len(t) // 10], rng.integers(0, 30_000, 300)])) for t in texts]
    tables = [pa.table({"id": pa.array(range(k, 300, 2)), "m": pa.array([1] * 150), "s": pa.array([t.tolist() for t in texts[k::2]])}) for k in (0, 1)]
    monkeypatch.setattr(signals, "CHUNK", 100_000)
    monkeypatch.setattr(signals, "PART", 100_000)
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    told = pa.Table.from_batches(list(signals._tile(0.5, 3, 4)(*tables)))
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    links = Counter()
    for r in told.to_pylist():
        if r["id"] is None:
            links[r["ask"]] += r["n"]
    alike = lambda a, b: len(np.intersect1d(texts[a], texts[b])) / len(np.union1d(texts[a], texts[b])) >= 0.5
    assert links == Counter({a: n for a in range(300) if (n := sum(alike(a, b) for b in range(1 - a % 2, 300, 2)))})
    assert peak < 120e6
    monkeypatch.setattr(signals, "TERMS", 2000, raising=False)
    asked = []
    monkeypatch.setattr(blocks, "packed", lambda rows, key, n, packed=blocks.packed: asked.append(n) or packed(rows, key, n))
    frame = spark.createDataFrame([(i, [f"t{j}" for j in rng.integers(0, 3000, 400)]) for i in range(12)], "memory_id long, tags array<string>")
    assert signals.corpus_signals(frame).count() == 12 and asked[0] >= 2


def test_lockstep_keeps_to_blocks_and_tells_pairs_in_pieces(spark, monkeypatch):
    rng = random.Random(23)
    rows = sorted({("x", rng.randrange(80), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(9000))) for _ in range(2000)})
    frame = spark.createDataFrame(rows, "g string, n long, t timestamp").repartition(4).cache()
    want = sorted(map(tuple, graph.lockstep(frame, "n", "t", 60, 2, 0.1, "g").collect()))
    monkeypatch.setattr(graph, "STAMPS", 120, raising=False)
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in held.items():
        spark.conf.set(k, v)
    got, n = shuffled(spark, lambda: sorted(map(tuple, graph.lockstep(frame, "n", "t", 60, 2, 0.1, "g").collect())))
    for k in held:
        spark.conf.unset(k)
    assert want and got == want
    assert n < 6 * 2000  # stamps are dealt into 17 blocks once
    monkeypatch.setattr(graph, "CHUNK", 500)
    table = pa.table({"g": ["x"] * 300, "n": [i % 20 for i in range(300)], "t": [i * 1_000_000 for i in range(300)], "m": [15] * 300})
    pieces = list(graph._near(30, 1, 0.0)(table, None))
    assert len(pieces) > 4 and pa.Table.from_batches(pieces).num_rows == 190


def test_labels_keep_nodes_not_arcs_in_memory(spark, monkeypatch):
    rng = np.random.default_rng(24)
    monkeypatch.setattr(graph, "CHUNK", 2000, raising=False)
    pairs = np.unique(np.sort(rng.integers(0, 900, (150_000, 2)), axis=1), axis=0)
    pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    a, b, w = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]]), np.tile(rng.integers(1, 4, len(pairs)), 2).astype(float)
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    tracemalloc.start()
    arcs = graph._Arcs()
    for i in range(0, len(a), 1500):
        arcs.add(a[i : i + 1500], b[i : i + 1500], w[i : i + 1500])
    names, labels = arcs.labels(3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000 < 16 * len(a)  # 900 nodes, over 200,000 arcs
    want = list(range(900))
    edge = np.searchsorted(a, np.arange(901))
    for _ in range(3):
        for n in range(900):
            weight = Counter()
            for m, x in zip(b[edge[n] : edge[n + 1]].tolist(), w[edge[n] : edge[n + 1]].tolist()):
                weight[want[m]] += x
            want[n] = min(weight, key=lambda x: (-weight[x], x))
    assert names.tolist() == list(range(900)) and labels.tolist() == want
    found = graph.label_propagation(spark.createDataFrame([("g", 1, 2, 1.0), ("h", 1, 2, 1.0), (None, 5, 6, 1.0), ("g", None, 2, 9.0)], "g string, a long, b long, weight double"), "g")
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()  # which takes a group whole
    assert {(r.group, r.node) for r in found.collect()} == {("g", 1), ("g", 2), ("h", 1), ("h", 2), (None, 5), (None, 6)}


def test_a_second_search_makes_no_rows_of_pairs(spark):
    rng = random.Random(25)
    texts = [(i, [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(1, 30))]) for i in range(1200)]
    asked = [(q, [f"w{rng.randrange(30)}" for _ in range(4)]) for q in range(40)]
    docs, queries = spark.createDataFrame(texts, "doc_id long, tokens array<string>").repartition(4).cache(), spark.createDataFrame(asked, "query_id long, tokens array<string>").cache()
    docs.count(), queries.count()
    got, n = shuffled(spark, lambda: casework.reflect(docs, queries, 10, 5, 4).collect())
    assert n < 12_000  # most of the 48,000 pairs share a word
    best: dict = {}
    for r in retrieval.bm25(docs, queries, 5).collect():
        best.setdefault(r.query_id, set()).add(r.doc_id)
    wider = []
    for q, words in asked:
        counts = Counter(w for i, t in texts if i in best.get(q, ()) for w in t if w not in words)
        wider.append((q, words + sorted(counts, key=lambda w: (-counts[w], w))[:4]))
    want = retrieval.bm25(docs, spark.createDataFrame(wider, queries.schema), 10).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in got) == sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in want)
