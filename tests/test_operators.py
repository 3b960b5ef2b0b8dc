"""Semantics that the tables cannot show, on hand-made rows."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import net, text
from skein.operators import detect, graph, joins, memory, pack, retrieval, sequences
from skein.sources import syslog
from skein.streaming import jobs


def one(spark, expr, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return frame.select(expr.alias("x")).first().x


def test_text(spark):
    assert one(spark, text.tokens(F.col("t")), t="The DENIED flows, a b2 of x") == ["denied", "flows", "b2"]
    assert one(spark, text.stems(F.col("w")), w=["denying", "flows", "is", "passes", "markedly", "red"]) == ["deny", "flow", "is", "pass", "mark", "red"]
    assert one(spark, text.expand(F.col("w")), w=["flows", "deny"]) == ["flow", "traffic", "deny", "block", "deni"]
    assert one(spark, text.token_estimate(F.col("t")), t="ab 中文 !? c") == 5
    assert one(spark, text.jaccard(F.col("a"), F.col("b")), a=[], b=[]) == 0.0
    assert one(spark, text.tagset(F.col("t")), t=["Net", "skill:x", "insight", "root:a", "net"]) == ["net"]


def test_addresses(spark):
    rows = ["10.1.2.3", "172.32.0.1", "224.0.0.1", "255.255.255.255", "1.2.3", "256.1.1.1", "8.8.8.8", None]
    frame = spark.createDataFrame([(r,) for r in rows], "ip string")
    got = frame.select(net.is_private(F.col("ip")).alias("p"), net.is_group(F.col("ip")).alias("g"), net.segment(F.col("ip")).alias("s")).collect()
    assert [r.p for r in got] == [True, False, False, True, False, False, False, False]
    assert [r.g for r in got] == [False, False, True, True, False, False, False, False]
    assert got[0].s == "10.1.2.0/24" and got[4].s == "" and got[7].s == ""
    assert one(spark, net.is_local_mac(F.col("m")), m="02:00:00:00:00:01") and not one(spark, net.is_local_mac(F.col("m")), m="01:00:00:00:00:01")
    assert one(spark, net.seconds_of_day(F.col("t")), t="01:02:03") == 3723 and one(spark, net.seconds_of_day(F.col("t")), t="x") == -1


def test_log_lines(spark):
    got = one(spark, syslog.fields(F.col("l")), l='<1> x a=1 msg="two words \\" q" a=2 b=')
    assert got == {"a": "2", "msg": 'two words \\" q'}
    frame = spark.createDataFrame([("10.0.0.1 3 AA:bb:cc:dd:ee:01 port1",), ("10.0.0.2 dev eth0 lladdr aa:bb:cc:dd:ee:02 REACHABLE",), ("? (10.0.0.3) at aa:bb:cc:dd:ee:03 [ether] on eth1",), ("junk",)], "l string")
    assert [r.n and tuple(r.n) for r in frame.select(syslog.neighbours(F.col("l")).alias("n")).collect()] == [
        ("10.0.0.1", "aa:bb:cc:dd:ee:01", "port1"), ("10.0.0.2", "aa:bb:cc:dd:ee:02", "eth0"), ("10.0.0.3", "aa:bb:cc:dd:ee:03", "eth1"), None,
    ]


def test_ledger(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    syslog.append_ledger(spark.createDataFrame([(1, "a")], "n long, k string"), path)
    syslog.append_ledger(spark.createDataFrame([(2, "b")], "n long, k string"), path)
    assert sorted(r.n for r in syslog.read_ledger(spark, path, "n long, k string").collect()) == [1, 2]
    (tmp_path / "ledger" / "bad.json").write_text("{broken\n")
    assert syslog.read_ledger(spark, path, "n long, k string", strict=False).where("n IS NOT NULL").count() == 2
    with pytest.raises(Exception):
        syslog.read_ledger(spark, path, "n long, k string").collect()


def test_bm25_counts_query_words_and_prefers_the_lesser_id_on_ties(spark):
    docs = spark.createDataFrame([(2, ["x", "y"]), (1, ["x", "y"]), (3, ["z"])], "doc_id long, tokens array<string>")
    asked = spark.createDataFrame([(1, ["x", "x"]), (2, ["x"]), (3, [])], "query_id long, tokens array<string>")
    got = {(r.query_id, r.rank): r for r in retrieval.bm25(docs, asked, 5).collect()}
    assert got[(1, 1)].doc_id == 1 and got[(1, 1)].score == pytest.approx(2 * got[(2, 1)].score, abs=2e-6) and (3, 1) not in got
    assert retrieval.bm25(docs, asked, 0).count() == 0


def test_gate(spark):
    ranked = spark.createDataFrame([(q, d, s, d) for q, s in ((1, 9.0), (2, 5.0), (3, 1.0)) for d in range(1, 7)], "query_id long, doc_id long, score double, rank long")
    kept = {r.query_id: r.n for r in retrieval.gate(ranked, 2, 8, 2).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kept == {1: 2, 2: 4}


def test_flat_search_in_blocks(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, vector array<double>").repartition(5)
    asked = vectors.where("doc_id < 7").select(F.col("doc_id").alias("query_id"), "vector")
    got = {(r.query_id, r.rank): r.doc_id for r in retrieval.flat_search(vectors, asked, 3, block=2).collect()}
    for q in range(7):
        assert [got[q, r] for r in (1, 2, 3)] == np.lexsort((np.arange(300), -np.round(v @ v[q], 5)))[:3].tolist()
    assert retrieval.flat_search(vectors, asked.where("false"), 3).count() == 0


def test_binary_similarity(spark):
    frame = spark.createDataFrame([([1.0, -1.0, 2.0] * 20, [1.0, 1.0, 2.0] * 20)], "a array<double>, b array<double>")
    got = frame.select(retrieval.hamming_similarity(retrieval.sign_bits(F.col("a"), 60), retrieval.sign_bits(F.col("b"), 60), 60).alias("s")).first().s
    assert got == pytest.approx(2 / 3)


def test_sessions_and_interval_ends(spark):
    t = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    rows = spark.createDataFrame([("a", t(0)), ("a", t(119)), ("a", t(500)), ("b", t(1))], "k string, ts timestamp")
    assert [(r.k, r.n) for r in sequences.sessions(rows, "k", "ts", 120, 2).collect()] == [("a", 2)]
    spans = spark.createDataFrame([(1, t(0), t(119)), (2, t(120), t(499))], "s int, f timestamp, u timestamp")
    assert sorted(r.s for r in joins.interval_join(rows, "ts", spans, "f", "u", 60).collect()) == [1, 1, 1]


def test_jaccard_pairs_are_whole(spark):
    rng = np.random.default_rng(2)
    sets = {i: sorted(set(rng.integers(0, 12, 6).tolist())) for i in range(40)}
    frame = spark.createDataFrame(list(sets.items()), "id long, s array<long>")
    got = {(r.a, r.b) for r in joins.jaccard_pairs(frame, "id", "s", 0.5).collect()}
    j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert got == {(a, b) for a in sets for b in sets if a != b and j(sets[a], sets[b]) >= 0.5}


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    got = {r.node: r.distance for r in graph.distances(edges, spark.createDataFrame([(1,)], "node long"), 2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}
    assert graph.longest_chains(edges, spark.createDataFrame([(1,)], "node long"), 8).first().path == "1>2>3>4"
    two = spark.createDataFrame([("g", 1, 2, 5.0), ("g", 2, 3, 5.0), ("g", 1, 3, 5.0), ("g", 3, 4, 0.1), ("g", 4, 5, 5.0)], "g string, a long, b long, weight double")
    label = {r.node: r.label for r in graph.label_propagation(two, "g").collect()}
    assert label[1] == label[2] == label[3] != label[4] == label[5]


def records(spark, rows):
    cols = "memory_id string, tier string, tags array<string>, asset_ids array<string>, confidence double, importance double, strength double, access_count long, links array<string>, quarantined boolean, insertion_order long"
    return spark.createDataFrame([(m, "episodic", t, a, 1.0, 1.0, s, 1, [], False, n) for n, (m, t, a, s) in enumerate(rows)], cols)


def test_memory_rules(spark):
    store = records(spark, [("m1", ["x", "y", "root:a"], ["h"], 1.0), ("m2", ["x", "y", "root:a"], ["h"], 0.5), ("seed-1", ["q"], ["z"], 0.1)])
    asked = records(spark, [("c1", ["x", "y", "root:b"], ["h"], 1.0), ("c2", ["x", "y", "root:a"], ["h"], 1.0), ("c3", ["x", "y", "w"], ["h"], 1.0), ("c4", ["none"], ["none"], 1.0)])
    got = {r.memory_id: (r.op, r.target_id) for r in memory.route(store, asked).collect()}
    assert got == {"c1": ("SUPERSEDE", "m1"), "c2": ("NOOP", "m1"), "c3": ("UPDATE", "m1"), "c4": ("ADD", None)}
    faded = {r.memory_id: r for r in memory.decay(store).collect()}
    assert faded["m2"].quarantined and "quarantine:forgotten" in faded["m2"].tags and faded["seed-1"].strength == 0.1 and not faded["m1"].quarantined
    assert [r.memory_id for r in memory.evict(store, 2).collect()] == ["m2"] and memory.evict(store, 3).count() == 0
    with pytest.raises(ValueError):
        memory.evict(store, -1)


def test_packing(spark):
    rows = spark.createDataFrame([("g", i, w) for i, w in enumerate((1, 1, 1))], "g string, i int, w int")
    assert [r.budget for r in pack.largest_remainder(rows, "g", "i", "w", 100).orderBy("i").collect()] == [34, 33, 33]
    page = spark.createDataFrame([(1, "<nav><p>no</p></nav><h1>T</h1><p>one <b>two</b></p><script>x</script><h2>U</h2><p>z</p>"), (2, None)], "page_id long, html string")
    blocks = pack.html_blocks(page)
    assert [(r.tag, r.text) for r in blocks.orderBy("place").collect()] == [("h1", "T"), ("p", "one two"), ("h2", "U"), ("p", "z")]
    assert [r.text for r in pack.chunks(blocks).orderBy("chunk").collect()] == ["T one two", "U z"]


def test_duplicate_lease_window(spark):
    t = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    leases = spark.createDataFrame([("10.0.0.1", "a", t(0)), ("10.0.0.1", "b", t(300)), ("10.0.0.2", "a", t(0)), ("10.0.0.2", "b", t(301))], "ip string, mac string, ts timestamp")
    assert [r.subject for r in detect.duplicate_leases(leases).collect()] == ["10.0.0.1"]


def test_streams(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", t(0), 1, True), ("a", t(60), 2, True), ("a", t(60), 2, True), ("a", t(90), 3, True), ("b", t(0), 4, False), ("a", t(9000), 5, False)]
    schema = "k string, ts timestamp, id long, bad boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).json(f"{tmp_path}/in")

    def drain(frame, name):
        query = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    assert [(r.k, r.n) for r in drain(jobs.clusters(source, "k", "ts", "id"), "clusters")] == [("a", 3)]
    assert [(r.k, r.streak) for r in drain(jobs.confirmations(source, "k", "ts", "bad"), "confirmed")] == [("a", 3)]
    query = source.writeStream.foreachBatch(jobs.project(f"{tmp_path}/index", "k", "id")).option("checkpointLocation", f"{tmp_path}/p").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.k, r.id) for r in spark.read.parquet(f"{tmp_path}/index").collect()) == [("a", 5), ("b", 4)]


def test_versions(spark, tmp_path):
    from skein.sources import versions

    path = f"{tmp_path}/log"
    frame = lambda *rows: spark.createDataFrame(list(rows), "memory_id string, text string")
    assert versions.append(frame(("a", "x"), ("b", "y")), path, "memory_id") == 2
    assert versions.append(frame(("a", "x"), ("b", "z"), ("c", None)), path, "memory_id") == 2
    log = spark.read.parquet(path)
    assert {r.memory_id: (r.text, r.version) for r in versions.current(log, "memory_id").collect()} == {"a": ("x", 1), "b": ("z", 2), "c": (None, 1)}
    stale = spark.createDataFrame([("b", 1)], "memory_id string, version long")
    with pytest.raises(versions.Conflict):
        versions.append(frame(("b", "w")), path, "memory_id", stale)
    with pytest.raises(ValueError):
        versions.append(frame(("b", "w"), ("b", "v")), path, "memory_id")
    first = [r.event_offset for r in versions.events_after(log, 0, 2).collect()]
    assert first == sorted(first) and versions.events_after(log, first[-1], 10).count() == 2
    versions.save_snapshot(log, f"{tmp_path}/snap")
    assert versions.load_snapshot(spark, f"{tmp_path}/snap").count() == 4
    log.limit(1).write.mode("append").parquet(f"{tmp_path}/snap/data")
    with pytest.raises(ValueError):
        versions.load_snapshot(spark, f"{tmp_path}/snap")


def test_approximate_search_finds_most(spark):
    from skein.plans import knowledge as plans

    assert plans.vector_recall(spark, "/root/testdata/sf0.01").first().recall >= 0.9


def test_consensus_fails_closed(spark):
    from skein.operators import knowledge

    votes = spark.createDataFrame([(1, "s"), (1, "s"), (1, "u"), (2, "s"), (2, "u"), (3, "u")], "claim_id int, label string")
    got = {r.claim_id: (r.verdict, r.disputed) for r in knowledge.consensus(votes).collect()}
    assert got == {1: ("s", False), 2: ("insufficient", True), 3: ("u", False)}


def test_tiered_retrieval_walks_links(spark):
    from skein.operators import knowledge

    rows = [("m1", ["disk"], ["h"], ["m2", "gone"], False), ("m2", ["fan"], [], ["m3"], False), ("m3", ["fan"], [], [], False), ("m4", ["disk"], ["h"], [], True)]
    cols = "memory_id string, tokens array<string>, asset_ids array<string>, links array<string>, quarantined boolean"
    more = {"tier": F.lit("episodic"), "strength": F.lit(1.0), "importance": F.lit(0.0), "confidence": F.lit(1.0), "insertion_order": F.monotonically_increasing_id()}
    records = spark.createDataFrame(rows, cols).withColumns(more)
    asked = spark.createDataFrame([(1, ["disk"], ["h"])], "query_id long, tokens array<string>, assets array<string>")
    got = {r.memory_id: r.hop for r in knowledge.tiered(records, asked, per_tier=9).collect()}
    assert got == {"m1": 0, "m2": 1, "m3": 2}


def test_owner_detectors(spark):
    from skein.operators import detect

    pairs = lambda *rows: spark.createDataFrame(list(rows), "ip string, mac string")
    leases = pairs(("a", "M1"), ("b", "m2"), ("d", "m9"))
    seen = pairs(("a", "m1"), ("a", "M1"), ("b", "m3"), ("c", "m4"), ("d", "m9"), ("d", "m5"))
    assert {(r.subject, r.confidence) for r in detect.contradicted_owners(seen, leases).collect()} == {("b", 0.9), ("d", 0.98)}
    assert detect.contradicted_owners(pairs(("a", "m1")).where("false"), leases).count() == 0
    stats = spark.createDataFrame([("p", 1, 10, 1), ("p", 2, 10, 8), ("q", 1, 0, 5), ("r", 1, 10, 9), ("r", 2, 10, 7)], "pool string, at long, total long, used long")
    assert [(r.subject, r.measured) for r in detect.pool_pressure(stats).collect()] == [("p", 0.8)]
    clashes = spark.createDataFrame([("x",)] * 10 + [("y",)] * 9, "srcip string")
    assert [(r.subject, r.measured) for r in detect.session_clashes(clashes).collect()] == [("x", 10.0)]
