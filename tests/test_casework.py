"""Case scalars, merged evidence, recall and a second search against plain loops and worked cases, with nulls and empty tables."""

from __future__ import annotations

import os
import random
from collections import Counter
from datetime import datetime, timezone

from pyspark.sql import functions as F

from skein.functions import cases as scalars
from skein.operators import casework, evaluate, joins, knowledge, retrieval
from skein.sources import syslog


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_banners_without_text(spark):
    none = F.lit(None).cast("string")
    assert one(spark, scalars.clean_banner(none), scalars.outdated_shell(none)) == ("", None)
    ports, banners = F.array().cast("array<int>"), F.create_map().cast("map<int,string>")
    assert one(spark, scalars.host_label(F.lit("10.0.0.7"), ports, banners)) == ("host-.7",)
    assert one(spark, scalars.outdated_shell(F.lit("ssh openssh_7.4")), scalars.outdated_shell(F.lit("OpenSSH 9.1p1"))) == ("OpenSSH 7.4", None)


def test_records_without_tags(spark):
    tags = F.array().cast("array<string>")
    assert one(spark, scalars.quarantine_reason(F.lit(True), tags), scalars.added(F.lit(None).cast("array<string>"), tags)) == (None, [])
    assert one(spark, scalars.gist(F.lit(None).cast("string"))) == (("", False),)


def test_positions_that_can_be_reached(spark):
    n = lambda v: F.lit(v).cast("int")
    at = lambda v, low, high, whole=True: scalars.position(n(v), n(low), n(high), F.lit(whole))
    can = lambda low, high: scalars.positions(n(low), n(high), F.lit(True))
    assert one(spark, at(2, 2, 8), at(8, 2, 8), at(3, 2, 8), at(9, 2, 8), at(12, 2, 8), at(5, 2, 8), at(None, 2, 8), at(5, None, None)) == ("min", "max", "just_inside", "just_outside", None, None, None, None)
    assert one(spark, at(12, 2, 8, False), at(3, None, 4), at(5, 4, None)) == ("just_outside", "just_inside", "just_inside")
    assert one(spark, can(1, 2), can(1, 3), can(None, 4), can(None, None)) == (["min", "max", "just_outside"], ["min", "max", "just_inside", "just_outside"], ["max", "just_inside", "just_outside"], [])


def test_a_suite_is_scored_by_what_it_can_reach(spark):
    params = spark.createDataFrame([("s", "a", 1, 2), ("s", "b", None, None)], "spec string, param string, low int, high int")
    inputs = spark.createDataFrame([("s", "a", 1), ("s", "a", 2), ("s", "a", 3), ("s", "b", 1)], "spec string, param string, value int")
    assert [tuple(r) for r in evaluate.boundary_axis(params, inputs).collect()] == [("s", 1.0, 0)]


def test_evidence_with_conflicts(spark):
    rows = [
        (1, 1, "e1", "p", "log", "k", "up"), (1, 2, "e1", "p", "net", "k", "down"), (1, 3, "e2", "q", None, "k", "up"), (1, 4, "e3", None, "net", "k", "down"), (1, 5, "e3", "x", "net", None, None),
        (1, 6, None, "p", "log", None, None), (2, 1, "e1", None, "log", "k", None), (2, 2, "e1", None, "log", "k", None),
    ]
    schema = "case_id int, seq int, evidence_id string, payload string, role string, claim_key string, claim_value string"
    merged, conflicts = casework.merge_evidence(spark.createDataFrame(rows, schema))
    assert sorted((r.case_id, r.evidence_id, r.seq) for r in merged.collect()) == [(1, "e1", 1), (1, "e2", 3), (1, "e3", 4), (2, "e1", 1)]
    assert sorted(tuple(r) for r in conflicts.collect()) == [(1, "claim:k:unknown!=net"), (1, "duplicate_id:e3"), (1, "evidence_without_id")]
    merged, conflicts = casework.merge_evidence(spark.createDataFrame([], schema))
    assert merged.count() == 0 and conflicts.count() == 0


def test_recall_meets_on_every_fit_record(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(7)]
    records = [(f"m{i}", rng.sample(words, rng.randint(0, 6)), rng.sample("abc", rng.randint(0, 2)), rng.choice([0.5, 0.9, 2.0]), rng.random() < 0.8, i) for i in range(200)]
    cases = [(i, rng.choices(words, k=rng.randint(0, 6)), rng.sample("abc", rng.randint(0, 2))) for i in range(60)]
    held = spark.createDataFrame(records, "memory_id string, tags array<string>, asset_ids array<string>, confidence double, observed boolean, insertion_order int")
    asked = spark.createDataFrame(cases, "case_id int, terms array<string>, assets array<string>")
    for least in (0.8, 0.5, 1.0):
        want = {}
        for case, terms, assets in cases:
            fit = [m for m, tags, own, sure, seen, _ in records if terms and seen and sure >= 0.9 and set(own) & set(assets) and len(set(terms) & set(tags)) / len(set(terms)) >= least]
            if fit:
                want[case] = fit[0]
        assert {r.case_id: r.memory_id for r in casework.recall_episode(held, asked, least).collect()} == want


def test_claims_without_anything(spark):
    claims = spark.createDataFrame([(1, 1, None, None, None), (2, 1, "x", True, ["e"])], "claim_id int, case_id int, cause string, readonly boolean, cited array<string>")
    evidence = spark.createDataFrame([], "case_id int, evidence_id string, kind string, current boolean, contradicts string")
    contracts, required = spark.createDataFrame([], "cause string, evidence_id string"), spark.createDataFrame([], "case_id int, evidence_id string")
    got = {r.claim_id: (r.errors, r.recall, r.passed) for r in casework.check_claims(claims, evidence, contracts, required).collect()}
    assert got == {1: ("not_readonly,no_cause,no_citation", 1.0, False), 2: ("unknown_citation,no_current_observation", 1.0, False)}


def test_updates_that_cannot_be_read(spark):
    lines = [(1, '{"id":"a","s":"x"}'), (2, "nonsense"), (3, '{"id":"a","s":null}'), (4, None), (5, "")]
    state, bad = casework.replay_updates(spark.createDataFrame(lines, "seq int, line string"), "id string, s string", "id")
    assert [tuple(r) for r in state.collect()] == [("a", None)] and sorted(r.seq for r in bad.collect()) == [2, 4, 5]


def test_a_second_search_takes_words_of_the_first(spark):
    rng = random.Random(2)
    texts = [(i, [f"w{int(rng.paretovariate(1.2)) % 25}" for _ in range(rng.randint(1, 12))]) for i in range(60)]
    asked = [(1, ["w3", "w4"]), (2, ["w2"]), (3, ["nowhere"]), (4, [])]
    docs, queries = spark.createDataFrame(texts, "doc_id long, tokens array<string>"), spark.createDataFrame(asked, "query_id long, tokens array<string>")
    by_id = dict(texts)
    first: dict = {}
    for r in retrieval.bm25(docs, queries, 5).collect():
        first.setdefault(r.query_id, []).append(r.doc_id)
    wider = []
    for q, words in asked:
        counts = Counter(w for d in first.get(q, []) for w in by_id[d] if w not in words)
        wider.append((q, words + sorted(counts, key=lambda w: (-counts[w], w))[:4]))
    want = retrieval.bm25(docs, spark.createDataFrame(wider, queries.schema), 10)
    got = casework.reflect(docs, queries, 10, 5, 4)
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) > 15


def test_chains_take_each_skill_once(spark):
    rng = random.Random(9)
    words = ["price", "status", "approve", "run", "list", "x1"]
    skills = [(f"s{i}", rng.choice(words), rng.sample(words, rng.randint(0, 2)), float(rng.randint(0, 2)), rng.random() < 0.2) for i in range(8)]
    requests = [(i, rng.choice([",", ";", " then "]).join(" ".join(rng.choices([*words, "none"], k=rng.randint(0, 2))) for _ in range(rng.randint(1, 4)))) for i in range(60)] + [(99, ""), (100, "nothing here")]
    got = casework.skill_chains(spark.createDataFrame(requests, "request_id int, request string"), spark.createDataFrame(skills, "name string, description string, tags array<string>, cost double, frozen boolean"))

    def best(terms, taken):
        scored = [(len(terms & {n, d, *t}), -c, n) for n, d, t, c, f in skills if not f and n not in taken and terms & {n, d, *t}]
        return max(scored) if scored else None

    want = {}
    for key, text in requests:
        steps = [p.strip() for p in text.replace(" then ", "|").replace(",", "|").replace(";", "|").split("|") if p.strip()]
        chain = []
        for step in steps:
            if found := best(set(step.split()), {n for _, _, n in chain}):
                chain.append(found)
        whole = best(set(text.replace(",", " ").replace(";", " ").split()), set()) if not chain else None
        said = chain or ([whole] if whole else [])
        want[key] = (">".join(n for _, _, n in said), ",".join(str(h) for h, _, _ in said), len(steps), len(chain), bool(whole))
    assert {r.request_id: tuple(r)[1:] for r in got.collect()} == want


def test_dense_hits_find_records_but_stay_below_exact_ones(spark):
    none = [[]] * 3
    rows = [(f"m{i}", "episodic", tokens, [], none[0], 0.0, 0.0, 1.0, i == 3, i) for i, tokens in enumerate((["router"], ["printer"], ["camera"], ["router"]))]
    records = spark.createDataFrame(rows, "memory_id string, tier string, tokens array<string>, asset_ids array<string>, links array<string>, strength double, importance double, confidence double, quarantined boolean, insertion_order int")
    asked = spark.createDataFrame([(1, ["router"], []), (2, ["unknown"], [])], "query_id int, tokens array<string>, assets array<string>")
    dense = spark.createDataFrame([(1, "m1", 0.9), (1, "m1", 0.5), (1, "m3", 1.0), (1, "m2", -0.5), (2, "m2", 0.5), (2, "gone", 0.9)], "query_id int, memory_id string, score double")
    plain = {(r.query_id, r.memory_id): r.score for r in knowledge.tiered(records, asked).collect()}
    got = {(r.query_id, r.memory_id): (r.score, r["rank"]) for r in knowledge.tiered(records, asked, dense=dense).collect()}
    assert set(plain) == {(1, "m0")} and set(got) == {(1, "m0"), (1, "m1"), (2, "m2")}
    assert got[1, "m0"][0] == plain[1, "m0"] and got[1, "m0"][1] == 1
    prior = 0.15 * 0.10 * 0.25  # of an episodic record without signals, times the best score of its query
    assert abs(got[2, "m2"][0] - 0.35 * 0.5 * (1 + prior)) < 1e-6


def test_snapshots_of_neighbours(spark, tmp_path):
    assert syslog.neighbour_snapshot(spark, str(tmp_path / "none")).count() == 0 and syslog.snapshot_age(spark, str(tmp_path / "none"), datetime(2024, 1, 1)).count() == 0
    path = tmp_path / "arp.txt"
    path.write_text("10.0.0.1 3 AA:bb:cc:00:11:22 lan\nno entry\n? (10.0.0.2) at 00:11:22:33:44:55 [ether] on eth0\n")
    os.utime(path, (1_700_000_000, 1_700_000_000))
    assert sorted(tuple(r) for r in syslog.neighbour_snapshot(spark, str(path)).collect()) == [("10.0.0.1", "aa:bb:cc:00:11:22", "lan"), ("10.0.0.2", "00:11:22:33:44:55", "eth0")]
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, tz=timezone.utc)
    assert [tuple(r)[1:] for late in (-5, 900, 901) for r in syslog.snapshot_age(spark, str(path), at(late)).collect()] == [(0.0, False), (900.0, False), (901.0, True)]


def test_lines_without_a_time_or_field(spark):
    rows = spark.createDataFrame([(1, "date=2024-01-01 time=10:00:00 a=x"), (2, "a=x"), (3, "date=2024-01-01 time=12:00:00 a=y"), (4, "date=2024-01-01 time=11:00:00 b=x")], "id int, line string")
    parsed = syslog.parse(rows)
    ids = lambda *args: sorted(r.id for r in syslog.select_lines(parsed, *args).collect())
    assert ids(None, None, {"a": "x"}) == [1, 2] and ids(datetime(2024, 1, 1, 10), None) == [1, 3, 4] and ids(None, datetime(2024, 1, 1, 11), {"a": "x"}) == [1]
    assert [r.id for r in syslog.tail(rows, "id", 2).collect()] == [4, 3]


def test_similar_sets_lose_no_pair(spark):
    rng = random.Random(4)
    sets = [(i, rng.sample(range(14), rng.randint(0, 9))) for i in range(70)] + [(90, [1, 1, 2]), (91, [2, 1]), (92, None)]
    frame = spark.createDataFrame(sets, "id int, s array<int>")
    for least in (0.2, 0.5, 0.8, 1.0):
        want = {(a, b) for a, x in sets for b, y in sets if a != b and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= least}
        assert {(r.a, r.b) for r in joins.jaccard_pairs(frame, "id", "s", least).collect()} == want
