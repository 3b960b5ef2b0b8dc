"""Greedy, stateful and streaming operators against plain loops and worked cases."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from skein.functions import net
from skein.operators import devices, evaluate, pack, retrieval
from skein.sources import syslog


def test_strongest_ties_respect_the_cap(spark):
    rng = random.Random(3)
    rows = sorted({(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", "fleet", round(rng.random(), 3), "") for _ in range(80)})
    rows = [("s1", a, b, k, w, n) for a, b, k, w, n in rows if a < b]
    got = devices.strongest(spark.createDataFrame(rows, "segment string, src string, dst string, kind string, weight double, note string"), "segment", 3)
    degree, want = {}, []
    for _, a, b, k, w, _n in sorted(rows, key=lambda r: (-r[4], r[1], r[2], r[3])):
        if degree.get(a, 0) < 3 and degree.get(b, 0) < 3:
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
            want.append((a, b, w))
    assert sorted((r.src, r.dst, r.weight) for r in got.collect()) == sorted(want)


def test_sections_lend_unused_room_and_keep_what_is_required(spark):
    items = [
        (1, "Evidence", 1, "a b c d e", False), (1, "Evidence", 2, "f g h", True), (1, "Workflow", 1, "w1 w2 w3", False), (1, "Workflow", 2, "w4 w5", False),
        (2, "Workflow", 1, "only this", False), (2, "Evidence", 1, None, False),
    ]
    frame = spark.createDataFrame(items, "case_id long, section string, item long, text string, required boolean")
    got = {}
    for r in pack.sections(frame, {"Evidence": 4, "Workflow": 3}, 12).orderBy("case_id", "section", "place").collect():
        got.setdefault((r.case_id, r.section), []).append((r.item, r.text))
    # First 4 + 3 words of evidence and 3 of the workflow; of the two words left one makes item 1 whole, one goes to the workflow.
    assert got[1, "Evidence"] == [(1, "a b c d e"), (2, "f g h")]
    assert got[1, "Workflow"] == [(1, "w1 w2 w3"), (2, "w4")]
    assert got[2, "Workflow"] == [(1, "only this")]


def test_longest_prefix():
    assert pack.longest_prefix("aa bb cc dd", 2) == ("aa bb", "cc dd")
    assert pack.longest_prefix("aaaa bbbb", 6, len) == ("aaaa", "bbbb")
    assert pack.longest_prefix("abcdef", 3, len) == ("abc", "def")
    assert pack.longest_prefix("x y", 0) == ("", "x y") and pack.longest_prefix("", 5) == ("", "")


def test_second_owner_within_a_window(spark, tmp_path):
    rows = [("a", 0, "m1"), ("a", 30, "m2"), ("a", 200, "m3"), ("b", 0, "m1"), ("b", 61, "m2"), ("b", 70, "m1"), ("c", 5, "m9"), ("c", 6, "m9")]
    base = pd.Timestamp("2024-01-01", tz="UTC")
    for part, chunk in enumerate((rows[:4], rows[4:])):
        frame = spark.createDataFrame([(ip, (base + pd.Timedelta(seconds=s)).isoformat(), m) for ip, s, m in chunk], "ip string, ts string, mac string")
        frame.coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema("ip string, ts timestamp, mac string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    query = devices.dual_owners(stream, 60, "10 minutes").writeStream.format("memory").queryName("dual").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.ip, int(r.ts.timestamp()) % 1000 - int(base.timestamp()) % 1000, r.macs) for r in spark.table("dual").collect())
    assert got == [("a", 30, 2), ("b", 70, 2)]  # the claim at 61 s is too late for that of 0 s


def test_parsing_keeps_the_last_of_repeated_keys(spark):
    line = r'date=1 a="x y" b=2 a="z \" q" c="" b=3 =5 d=e=f'
    got = spark.createDataFrame([(line,), ("",), (None,)], "line string").select(syslog.fields(F.col("line")).alias("f")).collect()
    assert got[0].f == {"date": "1", "a": 'z \\" q', "c": "", "b": "3", "d": "e=f"}
    assert got[1].f == {} and not got[2].f


def test_device_scalars(spark):
    rows = [(None, None, None, None), ("f4:b1:c2:00", "ipc-12AB", None, []), ("xx", " cam_007", "iOS", ["554"]), ("", "box", None, ["37777"])]
    frame = spark.createDataFrame(rows, "mac string, name string, system string, ports array<string>")
    got = frame.select(net.maker(F.col("mac")).alias("m"), net.role(F.col("name"), F.col("system"), F.col("ports")).alias("r"), net.family(F.col("name")).alias("f")).collect()
    assert [tuple(r) for r in got] == [("unknown", "unknown", ""), ("Dahua", "camera", "ipc"), ("unknown", "mobile", "cam"), ("unknown", "camera", "box")]


def test_hybrid_without_a_reranker_is_the_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, doc_id int, rank int")
    assert [r.doc_id for r in retrieval.hybrid(a, b, 3).orderBy("rank").collect()] == [11, 10, 12]


def test_recall_of_nothing(spark):
    asked = spark.createDataFrame([], "query_id int, type string, gold array<int>, answer string")
    hits = spark.createDataFrame([], "query_id int, doc_id int, text string, rank int")
    assert [tuple(r) for r in evaluate.recall_by_type(asked, hits).collect()] == []
