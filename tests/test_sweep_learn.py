"""The one-pass sweep, generations, learning from traces, corpus signals, masks and backfill against plain loops."""

from __future__ import annotations

import collections
import gzip
import ipaddress
import json
import math
import os
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from skein.operators import signals, sweep
from skein.plans import learning
from skein.sources import generations, syslog
from skein.streaming import backfill, learn


def log_lines():
    r = random.Random(6)
    out = []
    for i in range(1500):
        ip, mac = f"10.0.{r.randrange(3)}.{r.randrange(1, 30)}", f"{r.choice(['02', '00'])}:11:22:33:44:{r.randrange(40):02x}"
        when = f'date=2024-01-{r.randrange(1, 9):02d} time={r.randrange(24):02d}:{r.randrange(60):02d}:{r.randrange(60):02d}'
        kind = r.randrange(8)
        if kind == 0:
            out.append(f'{when} type="event" logdesc="DHCP Ack log" ip={ip} mac={mac.upper().replace(":", "-")} lease={r.choice(["3600", "86400", "x"])} hostname="{r.choice(["cam 1", "N/A", "pc"])}" interface="lan{r.randrange(2)}"')
        elif kind == 1:
            out.append(f'{when} logdesc="DHCP statistics" interface="lan{r.randrange(3)}" total={r.choice(["100", "bad"])} used={r.randrange(100)}')
        elif kind == 2:
            out.append(f'{when} logdesc="session clash" new_status="10.0.0.{r.randrange(4)}:55->8.8.8.8:53 and 9.9.9.9:1->10.0.0.1:2"')
        elif kind == 3:
            out.append(f'{when} logdesc="Admin login {r.choice(["failed", "disabled"])}" srcip={r.choice(["203.0.113.9", ip])}')
        elif kind == 4:
            out.append("no pairs here" if r.random() < 0.5 else 'date=bad time=xx a="q\\"z" a=2')
        else:
            out.append(f'{when} type="traffic" srcip={ip} dstip={r.choice(["8.8.8.8", "192.168.1.7"])} dstport=443 action=accept')
    return out


def test_fields_take_the_last_of_a_key(spark):
    lines = ['a=1 b="x y" a=3', 'k="" k2="a\\"b" z=', "none", 'q=" q2="', 'a=1 a="2" b=1 b=2 a=9', "é=1 x_1=é"]
    got = [r.f for r in spark.createDataFrame([(x,) for x in lines], "line string").select(syslog.fields(F.col("line")).alias("f")).collect()]
    want = []
    for x in lines:
        pairs = re.findall(r'([A-Za-z0-9_]+)=("(?:[^"\\]|\\.)*"|\S+)', x)
        want.append({k: v[1:-1] if len(v) > 1 and v[0] == v[-1] == '"' else v for k, v in pairs})
    assert got == want


def test_one_pass_gives_all_tables(spark):
    lines = log_lines()
    rows = syslog.parse(spark.createDataFrame(list(enumerate(lines)), "n long, line string").repartition(5))
    counts = Observation("corpus")
    seen = sweep.observed(rows, order="n", counts=counts)
    got = {(r.kind, r.subject, r.detail): (r.n, r.value) for r in seen.collect()}
    want, last = collections.Counter(), {}
    private = lambda x: x and ipaddress.ip_address(x).is_private
    stamps, used = [], 0
    for line in lines:
        f = {k: v.strip('"') for k, v in re.findall(r'(\w+)=("(?:[^"\\]|\\.)*"|\S+)', line)}
        if not f:
            continue
        used += 1
        want["corpus", "", ""] += 1
        try:
            stamps.append(datetime.fromisoformat(f"{f['date']}T{f['time']}"))
        except (KeyError, ValueError):
            pass
        desc, tell = f.get("logdesc", ""), lambda k, s="", d="": want.update([(k, s, d)])
        if desc == "DHCP Ack log":
            ip, mac = f["ip"], f["mac"].lower().replace("-", ":")
            tell("ack", ip, mac), tell("source", "dhcp_ack")
            for kind, v in (("lease", f["lease"] if f["lease"].isdigit() else None), ("hostname", None if f["hostname"] == "N/A" else f["hostname"]), ("interface", f["interface"])):
                if v is not None:
                    tell(kind, ip)
                    last[kind, ip, ""] = v
        elif desc == "DHCP statistics" and f["total"].isdigit():
            tell("pool", f["interface"]), tell("source", "dhcp_stats")
            last["pool", f["interface"], ""] = f"{f['used']}/{f['total']}"
        elif desc == "session clash":
            tell("clash"), tell("source", "session_clash")
            for s in re.findall(sweep.CLASH_SOURCE, line):
                if private(s):
                    tell("clash_source", s)
        elif desc.startswith("Admin login"):
            tell("login_failed" if desc.endswith("failed") else "login_disabled", f["srcip"]), tell("source", "admin_auth")
        if f.get("type") == "traffic":
            tell("traffic", f["srcip"])
        for c in ("srcip", "dstip"):
            if private(f.get(c)):
                tell("flow", f[c]), tell("source", "l3_flow")
    assert {k: n for k, (n, _) in got.items()} == dict(want)
    assert {k: v for k, (_, v) in got.items() if v is not None} == last
    assert counts.get["lines"] == used and counts.get["first_seen"] == min(stamps)
    told = sweep.findings(seen, logins=10).collect()
    assert {r.fault for r in told} >= {"multi_address", "unmanaged_identity", "session_tuple_clash"}
    assert {r.subject: r.measured for r in told if r.fault == "login_bruteforce"} == {s: n for (k, s, _), n in want.items() if k == "login_failed" and n >= 10}
    assert {r.source: r.told for r in sweep.blind_spots(sweep.observed(rows.where("n < 0"))).collect()} == dict.fromkeys(["admin_auth", "dhcp_ack", "dhcp_stats", "l3_flow", "session_clash"], False)
    with pytest.raises(ValueError):
        sweep.of(seen, "nothing")


def test_the_plan_of_the_sweep_has_one_scan_and_one_shuffle(spark, tmp_path):
    spark.createDataFrame([(x,) for x in log_lines()], "line string").write.parquet(str(tmp_path / "lines"))
    plan = sweep.observed(syslog.parse(spark.read.parquet(str(tmp_path / "lines"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange") == 1


def test_generations_are_whole_or_absent(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        generations.load(spark, root)
    for i in range(1, 5):
        before = generations.load(spark, root)["a"] if i > 1 else spark.createDataFrame([], "x long, `y.z` string")
        new = before.unionAll(spark.createDataFrame([(i, None)], "x long, `y.z` string"))
        assert generations.save({"a": new, "b": spark.range(i)}, root, {"offset": i}, keep=2) == i
    assert generations.numbers(spark, root) == [3, 4]
    assert [r.x for r in generations.load(spark, root)["a"].orderBy("x").collect()] == [1, 2, 3, 4]
    assert generations.manifest(spark, root)["notes"] == {"offset": 4} and generations.manifest(spark, root, 9) is None
    # A torn write: tables without a manifest are not seen, and go with the next write.
    spark.range(3).write.parquet(f"{root}/generation-000000000005/a")
    assert generations.load(spark, root)["b"].count() == 4
    assert generations.save({"a": spark.range(1)}, root) == 5 and generations.load(spark, root)["a"].count() == 1
    # A table that lost rows is found out; the generation before can still be read.
    folder = f"{root}/generation-000000000005/a"
    for name in os.listdir(folder):
        if name.startswith("part-"):
            os.remove(f"{folder}/{name}")
    with pytest.raises(generations.Corrupt):
        generations.load(spark, root)
    assert generations.load(spark, root, 4)["b"].count() == 4
    with pytest.raises(ValueError):
        generations.save({"a": spark.range(1)}, root, keep=0)


def traces(n=60):
    r = random.Random(9)
    events, cases, evidence = [], [], []
    for i in range(n):
        run, root = f"r{i:03d}", f"cause{r.randrange(3)}"
        seq = i * 100
        at = iter(range(seq, seq + 100))
        put = lambda kind, **p: events.append((run, next(at), kind, json.dumps(p)))  # noqa: B023, E731
        skills = r.sample(["ping", "arp", "log", "cfg"], 3)
        put("skills_exposed", skills=skills)
        inside = r.sample(["m1", "m2", "m3", "m4", "sem-cause0", "gone", "nobody"], 3)
        put("context_compiled", included_memory_ids=[*inside, inside[0]])
        put("context_compiled", included_memory_ids=["m1"])  # only the first counts
        made = [f"{run}-e{j}" for j in range(4)]
        for j, s in enumerate(skills[:2]):
            put("tool_called", skill=s, evidence_ids=made[2 * j : 2 * j + 2] if r.random() < 0.7 else [], blocked=r.random() < 0.2)
        if r.random() < 0.5:
            put("memory_attributed", memory_ids=[inside[0]], items=[{"memory_id": inside[1], "role": r.choice(["procedural_shortcut", "hypothesis"])}] if r.random() < 0.6 else [])
        if r.random() < 0.2:
            put("memory_resolved", memory_id=inside[2])
        if r.random() < 0.9:
            put("diagnosis_completed", root_cause_key=root if r.random() < 0.95 else "", confidence=0.9, evidence=[{"evidence_id": x} for x in r.sample(made, 2)])
            put("verifier_result", passed=r.random() < 0.7)
        cases.append((run, [f"T{i % 2}", root], [f"a{i % 4}"]))
        evidence += [(run, made[0], f"cause{r.randrange(3)}"), (run, made[2], f"cause{r.randrange(3)}"), (run, made[1], None)]
    return events, cases, evidence


START = [("m1", "episodic", ["x", "root:cause0"], ["a1"], 1.0, 0.0, 0.5, 0, False, None), ("m2", "episodic", ["root:cause1"], [], 2.9, 1.0, 1.0, 3, False, None), ("m3", "semantic", ["root:cause2"], [], 1.0, 0.0, 1.0, 0, False, None), ("m4", "episodic", ["root:cause2"], [], 1.0, 0.0, 1.0, 0, False, None), ("gone", "episodic", ["root:cause0"], [], 1.0, 0.0, 1.0, 0, True, None)]


def learn_in_a_loop(events, cases, evidence, batches):
    """Runs one after the other; which memories live and exist is that of the batch's start, as batches are atomic."""
    mem = {m[0]: {"tier": m[1], "tags": list(m[2]), "assets": list(m[3]), "conf": m[4], "imp": m[5], "str": m[6], "acc": m[7], "gone": m[8]} for m in START}
    skills = {s: [0, 0, False] for s in ("arp", "cfg", "log", "ping")}
    strikes, facts = collections.defaultdict(set), collections.defaultdict(list)
    for run, _, kind, p in events:
        facts[run].append((kind, json.loads(p)))
    info, contra = {c[0]: c for c in cases}, {(r, e): c for r, e, c in evidence}
    for runs in batches:
        live, known = {k for k, m in mem.items() if not m["gone"]}, set(mem)
        for run in runs:
            first = lambda kind: next((p for k, p in facts[run] if k == kind), None)  # noqa: B023, E731
            inside = list(dict.fromkeys((first("context_compiled") or {}).get("included_memory_ids", [])))
            for m in inside:
                if m in live:
                    mem[m]["acc"] += 1
            diag = first("diagnosis_completed")
            if diag is None:
                continue
            passed, root = bool((first("verifier_result") or {}).get("passed")), diag["root_cause_key"]
            cited = {e["evidence_id"] for e in diag["evidence"]}
            named, good = set(), set()
            for k, p in facts[run]:
                if k == "memory_attributed":
                    named |= set(p["memory_ids"]) | {i["memory_id"] for i in p["items"]}
                    good |= {i["memory_id"] for i in p["items"] if i["role"] in learn.CREDITED} if p["items"] else set(p["memory_ids"])
                if k == "memory_resolved":
                    named.add(p["memory_id"]), good.add(p["memory_id"])
            tools = [p for k, p in facts[run] if k == "tool_called" and not p["blocked"]]
            made = {e for p in tools for e in p["evidence_ids"]}
            against = {contra.get((run, e)) for e in made & cited} - {None}
            own = lambda m: next((t[5:] for t in mem[m]["tags"] if t.startswith("root:")), None)
            hit = {m for m in inside if m in named and m in known and mem[m]["tier"] == "episodic" and own(m) in against}
            winning = list(dict.fromkeys(p["skill"] for p in tools if set(p["evidence_ids"]) & cited))
            if passed and root:
                _, terms, assets = info[run]
                base = list(dict.fromkeys([*map(str.lower, terms), root, f"root:{root}"]))
                for i, tier, conf, step, more, can in ((f"sem-{root}", "semantic", 1.2, 0.3, [], True), (f"proc-{root}", "procedural", 1.5, 0.4, [f"skill:{s}" for s in winning], bool(winning))):
                    if i in mem:
                        mem[i]["conf"], mem[i]["imp"], mem[i]["str"] = min(3.0, mem[i]["conf"] + step), mem[i]["imp"] + 1, 1.0
                        mem[i]["tags"] += [t for t in more if t not in mem[i]["tags"]]
                    elif can:
                        mem[i] = {"tier": tier, "tags": base + more, "assets": list(assets), "conf": conf, "imp": 0.0, "str": 1.0, "acc": 0, "gone": False}
                for m in inside:
                    if m in good and m in known and m not in hit:
                        mem[m]["conf"], mem[m]["imp"], mem[m]["str"] = min(3.0, mem[m]["conf"] + 0.1), mem[m]["imp"] + 0.5, 1.0
            for m in hit:
                if m in live:
                    strikes[m].add(run)
            gave = {p["skill"] for p in tools if p["evidence_ids"]}
            for s, c in skills.items():
                if passed and s in winning:
                    c[0] += 1
                elif s in first("skills_exposed")["skills"] and s not in gave:
                    c[1] += 1
                c[2] = c[2] or c[0] + c[1] >= 4 and c[1] / (c[0] + c[1]) > 0.5
        for m, x in strikes.items():
            if len(x) >= 2 and not mem[m]["gone"]:
                mem[m]["gone"] = True
                mem[m]["tags"].append("quarantine:repeated_explicit_contradiction")
    return mem, skills


def test_learning_from_traces_and_its_replay(spark, tmp_path):
    events, cases, evidence = traces()
    frame = spark.createDataFrame(events, "run_id string, seq long, kind string, payload string")
    case_rows = spark.createDataFrame(cases, "run_id string, terms array<string>, assets array<string>")
    proof = spark.createDataFrame(evidence, "run_id string, evidence_id string, contradicts string")
    start = learn.empty(spark) | {"memories": spark.createDataFrame(START, learn.MEMORIES), "skills": spark.createDataFrame([(s, 0, 0, False) for s in ("arp", "cfg", "log", "ping")], learn.SKILLS)}
    root, source, log = (str(tmp_path / x) for x in ("store", "in", "log"))
    names = sorted({e[0] for e in events})
    batches = [names[:20], names[20:21], names[21:]]
    write = learn.writer(root, case_rows, proof, start)

    def feed():
        rows = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
        rows.writeStream.foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination(300)

    for b in batches:
        frame.where(F.col("run_id").isin(b)).coalesce(1).write.mode("append").parquet(source)
        feed()

    def state():
        tables = generations.load(spark, root)
        mem = {r.memory_id: {"tier": r.tier, "tags": sorted(r.tags), "assets": r.asset_ids, "conf": round(r.confidence, 6), "imp": r.importance, "str": r.strength, "acc": r.access_count, "gone": r.quarantined} for r in tables["memories"].collect()}
        return mem, {r.skill: [r.success, r.misuse, r.frozen] for r in tables["skills"].collect()}

    want, skills = learn_in_a_loop(events, cases, evidence, batches)
    got = state()
    assert got[1] == skills and any(c[2] for c in skills.values())
    assert got[0] == {i: m | {"tags": sorted(m["tags"]), "conf": round(m["conf"], 6)} for i, m in want.items()}
    assert any(m["gone"] for i, m in want.items() if i != "gone") and any(i.startswith("proc-") for i in want)
    # The same batches again, whole or in part, change nothing.
    number = generations.numbers(spark, root)[-1]
    write(frame, 7)
    write(frame.where(F.col("run_id") < "r010"), 8)
    assert generations.numbers(spark, root)[-1] == number and state() == got


def test_corpus_signals_equal_a_loop(spark):
    r = random.Random(12)
    rows = [(f"m{i:02d}", r.choices([f"t{j}" for j in range(40)], weights=[40 - j for j in range(40)], k=r.randrange(0, 14))) for i in range(70)]
    got = {x.memory_id: (x.importance, x.links, x.access_count) for x in signals.corpus_signals(spark.createDataFrame(rows, "memory_id string, tags array<string>")).collect()}
    sets = {i: set(t) for i, t in rows}
    df = collections.Counter(t for s in sets.values() for t in s)
    idf = {t: math.log(1 + len(rows) / n) for t, n in df.items()}
    access = collections.Counter()
    for i, s in sets.items():
        probe = set(sorted(s, key=lambda t: (df[t], t))[:8])
        found = sorted((-len(probe & sets[j]), j) for j in sets if j != i)[:5]
        access.update(j for n, j in found if n < 0)
    for i, s in sets.items():
        links = sum(1 for j in sets if j != i and s and sets[j] and len(s & sets[j]) / len(s | sets[j]) >= 0.2 - 1e-9)
        assert got[i] == (round(sum(idf[t] for t in s) / max(1, len(s)), 6), links, access[i]), i


def test_leaked_masks_and_the_site_graph(spark):
    r = random.Random(2)
    sent = [("10.0.1.9", "10.0.255.255"), ("10.0.1.9", "10.0.3.255"), ("10.0.1.8", "10.0.1.255"), ("10.0.1.7", "10.1.255.255"), ("10.0.1.6", "255.255.255.255"), ("10.0.1.5", "x"), ("10.0.1.4", "10.255.255.255"), (None, "10.0.3.255")]
    sent += [(f"10.0.{r.randrange(4)}.{r.randrange(1, 255)}", str(ipaddress.ip_address(r.getrandbits(32) | (1 << r.randrange(32)) - 1))) for _ in range(300)]
    sent += [(a, str(ipaddress.ip_network(f"{a}/{p}", strict=False).broadcast_address)) for a, p in ((f"10.2.{i}.{i + 3}", 10 + i % 20) for i in range(60))]
    got = {x.node: (x.prefix, x.n) for x in signals.leaked_masks(spark.createDataFrame(sent, "node string, target string")).collect()}
    want = collections.defaultdict(collections.Counter)
    for a, t in sent:
        try:
            s, d = int(ipaddress.ip_address(a)), int(ipaddress.ip_address(t))
        except ValueError:
            continue
        z = 0
        while d >> z & 1:
            z += 1
        if 8 < z < 32 and s >> z == d >> z and s >> 8 != d >> 8:
            want[a][32 - z] += 1
    assert got == {a: (min(c), c[min(c)]) for a, c in want.items()}
    hosts = spark.createDataFrame([(f"10.0.1.{i}", f"00:11:22:33:44:{i:02x}", f"cam-{i}" if i < 5 else None, None, ["443"], i, i * 10) for i in range(1, 10)], "ip string, mac string, name string, system string, ports array<string>, denied long, flows long")
    frame = spark.createDataFrame(sent, "node string, target string")
    flows = spark.createDataFrame([(f"10.0.1.{i}", "8.8.8.8" if i < 4 else f"9.9.9.{i}", p) for i in range(1, 10) for p in ("80", "443", "22")], "node string, target string, port string")
    leases = spark.createDataFrame([(f"10.0.1.{i}", s) for i in (2, 3) for s in range(5)] + [("10.0.1.4", 1)], "node string, slot long")
    clashes = spark.createDataFrame([("10.0.1.1", "t"), ("10.0.1.5", "t"), ("10.0.1.6", "u")], "node string, tuple string")
    site = signals.site_graph(hosts, frame, flows, leases, clashes)
    kinds = collections.Counter(x.kind for x in site["edges"].collect())
    assert kinds["clash"] == 1 and kinds["lease"] == 1 and kinds["codst"] == 3
    odd = {x.kind: x.members for x in site["anomalies"].where("segment LIKE '10.0.1.%'").collect()}
    assert odd["session-clash"] == "10.0.1.1,10.0.1.5" and odd["netmask-leak"] == ",".join(sorted(a for a in got if a in {f"10.0.1.{i}" for i in range(1, 10)}))
    degree = collections.Counter(n for x in site["edges"].collect() for n in (x.src, x.dst))
    assert max(degree.values()) <= 7 and {x.ip: x.degree for x in site["nodes"].collect()} == {f"10.0.1.{i}": degree[f"10.0.1.{i}"] for i in range(1, 10)}
    assert site["stats"].first().hosts == 9 and site["stats"].first().edges == sum(kinds.values())
    both = signals.enriched(hosts.select("ip", "flows"), spark.createDataFrame([("10.0.1.1", 99), ("10.0.9.9", 5)], "ip string, flows long"), "ip", ["flows"])
    assert {x.ip: x.flows for x in both.collect()} == {f"10.0.1.{i}": 99 if i == 1 else i * 10 for i in range(1, 10)}


def test_backfill_takes_each_file_once(spark, tmp_path):
    logs, out, log = (str(tmp_path / x) for x in ("logs", "out", "log"))
    os.makedirs(logs)

    def rotate(name, first, n, age):
        text = "".join(f'date=2024-01-0{1 + i % 3} time=00:00:{i % 60:02d} type="traffic" srcip=10.0.0.{i % 9} dstip=8.8.8.8 dstport={first + i} action=accept sentbyte=1\nnoise type=utm\n' for i in range(n))
        path = f"{logs}/{name}"
        with gzip.open(path, "wt") if name.endswith(".gz") else open(path, "w") as f:
            f.write(text)
        os.utime(path, (1_700_000_000 + age,) * 2)

    rotate("b.2.gz", 0, 50, 1)
    rotate("a.1.gz", 50, 30, 2)
    rotate("now.log", 80, 20, 3)
    query = backfill.backfill(spark, logs, out, log, files=1)
    assert query.awaitTermination(300) and query.exception() is None
    batches = [p.numInputRows for p in query.recentProgress if p.numInputRows]
    assert batches == [100, 60, 40]  # oldest first, whatever their names
    ports = lambda: sorted(r.dstport for r in spark.read.parquet(out).collect())
    assert ports() == list(range(100))
    rotate("later.log", 100, 7, 4)
    for _ in range(2):
        assert backfill.backfill(spark, logs, out, log).awaitTermination(300)
    assert ports() == list(range(107))


def test_deltas_and_rates(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "id long, v string, w long")
    b = spark.createDataFrame([(2, "y", 1), (3, "z", None), (4, "n", 2), (5, "o", 2)], "id long, v string, w long")
    delta = backfill.snapshot_delta(a, b, "id")
    assert {r.id: r.change for r in delta.collect()} == {1: "removed", 3: "changed", 4: "added", 5: "added"}
    assert [r.v for r in backfill.lit_path(delta, b, "id", "w", "v").collect()] == ["n"]
    assert backfill.lit_path(backfill.snapshot_delta(b, b, "id"), b, "id", "w", "v").count() == 0
    log = spark.createDataFrame([(1,), (5,)], "event_offset long")
    assert backfill.pending(log, 4) and not backfill.pending(log, 5)
    rows = spark.createDataFrame([("k", i) for i in range(10)] + [("one", 1)], "k string, s long").select("k", F.timestamp_seconds(F.col("s") * 2).alias("ts"))
    assert {r.k: (r.n, r.per_second) for r in backfill.tail_rate(rows, "k", "ts", 5).collect()} == {"k": (5, 0.5), "one": (1, None)}


def test_corpus_signals_read_whole_texts(spark, tmp_path):
    head = " ".join(f"head{i}" for i in range(60))
    texts = {1: head + " " + " ".join(f"one{i}" for i in range(200)), 2: head + " " + " ".join(f"two{i}" for i in range(200)), 3: " ".join(f"x{i}" for i in range(60)) + " " + " ".join(f"tail{i}" for i in range(200)), 4: " ".join(f"y{i}" for i in range(60)) + " " + " ".join(f"tail{i}" for i in range(200))}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.memory_id: r.links for r in learning.corpus_signals(spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}  # 1 and 2 begin alike, 3 and 4 share most of what follows
