"""The operators against brute force on small fixtures, with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import decontam, fingerprints, langid, mixing, near_dup, pii, quality, suffix_dedup, suffix_sort, url_filter, warc
from skein.llm.common import components
from skein.llm.textbatch import IS_BREAK, Words, text_slices

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "one"), (-5, "ab" * 3000), (-6, "x y z " * 800), (-7, "x y z " * 800), (None, "no id here at all"), (-8, "é" * 400), (-9, "one")]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], real.schema)
    return real.unionByName(odd).withColumn("key", F.lit("clash")).withColumn("rank", F.lit(1))


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def shingles(text, k):
    w = WORD.findall((text or "").translate(ASCII))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_near_duplicates_match_brute_force(docs, rows):
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect()}
    want = brute_components(rows, 4)
    assert {i: got[i].component_id for i in want} == want
    assert all(got[i].n_shingles == len(shingles(t, 4)) for i, t in rows)
    assert all(got[i].kept == (i == want[i]) for i in want) and got[None].kept


@pytest.mark.parametrize("bounds", [{"BLOCK": 4}, {"BLOCK": 4, "BUCKET": 3}, {"BLOCK_BYTES": 900, "PIVOTS": 2}, {"BUCKET": 3, "PIVOTS": 1, "BLOCK": 2}])
def test_near_duplicates_in_blocks(spark, monkeypatch, bounds):
    """Large groups: one cluster of copies, chains, several clusters, with hot buckets and by bytes."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(60)]
    copies = [(n, " ".join(base[:n] + ["changed"] + base[n + 1 :])) for n in range(0, 60, 3)]
    for c in range(3):
        words = [f"c{c}x{i}" for i in range(50)]
        for n in range(12):  # a chain: neighbours are linked, the ends are not
            words[int(rng.integers(0, 50))] = f"new{c}{n}"
            copies.append((100 * (c + 1) + n, " ".join(words)))
    frame = spark.createDataFrame(copies, "doc_id long, text string")
    for name, value in bounds.items():
        monkeypatch.setattr(near_dup, name, value)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame, 2).collect()}
    assert got == brute_components(copies, 2)


def test_near_duplicate_links_are_found(spark):
    """Recall of exact links on the driver's documents."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets = [(i, shingles(t, 4)) for i, t in rows]
    by_shingle = collections.defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in sorted(s)[: len(s) - -(-8 * len(s) // 10) + 1]:  # two linked sets share one of these
            by_shingle[x].append(n)
    pairs = {(a, b) for m in by_shingle.values() for k, a in enumerate(m) for b in m[k + 1 :]}
    links = [(sets[a][0], sets[b][0]) for a, b in pairs if 100 * len(sets[a][1] & sets[b][1]) >= 80 * len(sets[a][1] | sets[b][1])]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(links) > 20 and all(got[a] == got[b] for a, b in links)


def test_deduplicate_keeps_one_of_each_group_and_all_columns(docs, rows):
    kept = near_dup.deduplicate(docs, 5)
    want = brute_components(rows, 5)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(i for i in want if want[i] == i)


def test_deduplicate_with_null_ids(spark):
    text = lambda c, n=40: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, text("a")), (None, text("a")), (None, text("a") + " more"), (None, text("b")), (None, text("c")), (None, text("c")), (None, text("c") + " more"), (None, text("d")), (7, text("d") + " more"), (None, ""), (None, None), (None, "")]
    frame = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = [(r.doc_id, r.text) for r in near_dup.deduplicate(frame).select("doc_id", "text").collect()]
    of_c = [(i, t) for i, t in kept if t and t.startswith("c")]
    assert len(of_c) == 1 and of_c[0][0] is None
    assert sorted(map(str, set(kept) - set(of_c))) == sorted(map(str, {(1, text("a")), (None, text("b")), (7, text("d") + " more"), (None, ""), (None, None)}))
    assert len(kept) == 7
    marked = near_dup.near_duplicates(frame, 5).collect()
    assert sorted((r.component_id for r in marked if r.component_id is not None)) == [1, 1, 1, 7, 7]


def test_empty_tables(spark, docs):
    none = docs.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert near_dup.near_duplicates(none).count() == 0 and suffix_dedup.remove_repeats(none).count() == 0
    assert pii.find(none).count() == 0 and mixing.taken(none).count() == 0 and mixing.mix(none).count() == 0
    assert fingerprints.with_next(none).count() == 0 and langid.classify(none).count() == 0
    assert quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels).collect()} == {0.5}
    assert decontam.search(docs, bench).count() == 0 and decontam.keep_clean(docs, bench).count() == docs.count()
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0 and url_filter.judge_urls(pages).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 9), (9, 8), (5, 5), (None, 4), *((20 + i, 21 + i) for i in range(30))], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{20 + i: 20 for i in range(31)}}


@pytest.mark.parametrize(("hot", "segment"), [(suffix_dedup.HOT, suffix_dedup.SEGMENT), (1, 500)])
def test_repeats_match_brute_force(docs, rows, hot, segment, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    counts = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        counts.update(b[p : p + 200] for p in range(len(b) - 199))
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, hot=hot).collect()}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if counts[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()), i


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n in (*range(1, 30), 200):
        x = rng.integers(1, 4, n)
        assert suffix_dedup.suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


@pytest.mark.parametrize("text", ["aaaaaaaaaaaaaaaaaaab", "banana" * 4])
def test_distributed_suffix_sort(spark, text):
    for n in (len(text) - 2, len(text) - 1, len(text)):
        chars = spark.createDataFrame([(i, ord(c)) for i, c in enumerate(text[:n])], "pos long, c long")
        got = {r.pos: r.rank for r in suffix_sort.suffix_ranks(chars, n, 12).collect()}
        assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(n), key=lambda i: text[i:n]) and sorted(got.values()) == list(range(n))


def test_distributed_sort_finds_repeated_strings(spark):
    rng = np.random.default_rng(6)
    part = bytes(rng.integers(97, 100, 60).tolist()).decode()
    texts = [(1, part + "é" + part[:30]), (2, "x" + part[20:] + "y" * 50), (3, None), (4, ""), (5, "short"), (6, "y" * 25)]
    counts = collections.Counter(t.encode()[p : p + 20] for _, t in texts if t for p in range(len(t.encode()) - 19))
    want = {(k, p) for k, t in texts if t for p in range(len(t.encode()) - 19) if counts[t.encode()[p : p + 20]] > 1}
    got = suffix_sort.repeated_starts(spark.createDataFrame(texts, "key long, text string"), 20, 150)
    assert {(r.key, r.a) for r in got.collect()} == want and len(want) > 40


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def holds(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            total = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d))))
            return 16 <= len(d) <= 19 and total % 10 == 0
        return kind != "phone" or 8 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m.group())]


TRICKY = ["a@b.c_d@e.f x@y.z.w 1.2.3.4.5 999.1.1.1 0001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 é4111111111111111", "+1 (22) 333-4444 +1 2 +123456789012345678", "1" * 9000, "a." * 4000 + "@x.y", "@@ a@b a@b. a@.b"]


def test_personal_data_matches_the_base_patterns(spark, docs):
    cue = [(-200 - i, f"reach me by e-mail: user{i}@mail{i}.example.org, or e-mail: joe{i} [at] site{i} [dot] org") for i in range(30)]
    odd = spark.createDataFrame([*((-100 - i, t) for i, t in enumerate(TRICKY)), *cue], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    texts = {r.doc_id: r.text or "" for r in every.collect()}
    got = {r.doc_id: r for r in pii.find(every).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        want = base_spans(text)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (i, said)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == x for k, _, _ in want) for x in PATTERNS]
        assert set(said.split(",")) - {""} <= set(got[i].spans.split(","))
    assert all(got[i].spans.count("email") == 2 for i, _ in cue)  # the obfuscated one is discovered
    clean = pii.redact(every.where("doc_id IN (-200, -3)"))
    assert {r.doc_id: r.text for r in clean.collect()}[-3] == " \t\n" and "user0" not in {r.doc_id: r.text for r in clean.collect()}[-200]


def test_redaction_leaves_other_columns_alone(spark):
    texts = ["write to a@b.org or +12 345 678 90 now", None, "", "none here", "x" * 3000 + " joe@site.example.com " + "é😀" * 2000 + " 10.0.0.1", "a@b.org", "+1 10.0.0.1 22 33 end"]
    frame = spark.createDataFrame([(i, t, f"k{i}", i, None, "t", [i]) for i, t in enumerate(texts)], "doc_id long, text string, key string, every int, `row` string, cuts string, rows array<int>")
    got = {r.doc_id: r for r in pii.redact(frame).collect()}
    assert pii.redact(frame).columns == frame.columns and len(got) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i].key, got[i].every, got[i].row, got[i].cuts, got[i].rows) == (f"k{i}", i, None, "t", [i])
        spans, out, at = sorted((a, b, k) for k, a, b in base_spans(t or "")), [], 0
        for a, b, k in spans:
            if a >= at:
                out += [(t or "")[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        assert got[i].text == (None if t is None else "".join(out) + t[at:])


def test_a_long_text_full_of_addresses(spark):
    text = " ".join(f"u{i}@h{i % 97}.example.org" for i in range(60_000))  # 1.4 MB
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.redact(frame).first().text == " ".join(["[EMAIL]"] * 60_000)


def test_trust_counts_all_documents(spark):
    """Patterns confirm only if most of their occurrences, in documents without candidates too, precede instances."""
    rows = [(i, f"mailto: user{i}@mail.example.org") for i in range(20)] + [(100, "mailto: joe [at] site [dot] org")]
    clean = [(1000 + i, "mailto: nobody") for i in range(200)]
    found = lambda r: {x.doc_id: x.spans for x in pii.find(spark.createDataFrame(r, "doc_id long, text string")).collect()}
    assert "email" in found(rows)[100]
    assert found(rows + clean)[100] == ""


def test_decontamination_finds_planted_items_only(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(900, None), (901, "")], "item_id long, text string"))
    items = [r for r in bench.where("length(text) > 50").orderBy("item_id").collect()]
    filler = "zarbo plint quavex morit dunsk velpar " * 30
    words = items[1].text.split()
    paraphrase = " ".join(w if n % 6 else "changed" for n, w in enumerate(words))
    plant = [(-301, f"{filler}{items[0].text} {filler}"), (-302, f"{filler}{paraphrase} {filler}"), (-303, filler), (-304, items[2].text.upper()), (-305, " ".join(items[3].text.split()[:4]) + filler)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(plant, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontam.search(every, bench).collect()}
    assert {(-301, items[0].item_id), (-302, items[1].item_id), (-304, items[2].item_id)} <= got
    assert not {i for i, _ in got} & {-303, -305}
    exact = {(i, b.item_id) for i, t in [(r.doc_id, r.text) for r in docs.collect()] for b in items if t and b.text in t}
    assert exact <= got
    kept = {r.doc_id for r in decontam.keep_clean(every, bench).collect()}
    assert kept == {r.doc_id for r in every.collect()} - {i for i, _ in got}


def planted(seed, n_items, size, changed):
    """(benchmark rows, document rows) of random words: each document holds the item of its number, every ``changed``-th word anew."""
    rng = np.random.default_rng(seed)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 20000, size))) for i in range(n_items)]
    filler = lambda: " ".join(f"f{x}" for x in rng.integers(0, 10**6, 60))
    alter = lambda t: " ".join("changed" if changed and k % changed == 2 else w for k, w in enumerate(t.split()))
    return items, [(i, f"{filler()} {alter(t)} {filler()}") for i, t in items]


def test_decontamination_by_more_passages_than_the_rank(spark):
    items, plant = planted(7, 2000, 16, 4)
    plant = plant[::25]
    got = {(r.doc_id, r.item_id) for r in decontam.search(spark.createDataFrame(plant, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i, _ in plant}


@pytest.mark.parametrize("n", [1_000, 500_000])
def test_decontamination_does_not_depend_on_the_number_of_documents(spark, n):
    items = [(i, " ".join(f"w{i + 80 * k}" for k in range(12))) for i in range(80)]
    # Each word of the benchmark is in 1 % of the documents.
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(0, 9), k -> concat('w', id % 100 + 100 * k)), ' ')").alias("text"))
    filler = " ".join(f"f{k}" for k in range(64))
    copies = [f"{filler} {' '.join('changed' if k % 3 == 0 else w for k, w in enumerate(t.split()))} {filler}" for _, t in items]
    found = set()
    for searcher in decontam.searchers(docs, spark.createDataFrame(items, "item_id long, text string")):
        for a, _, raw, off in text_slices(pa.array(copies)):
            found |= {(a + h[0], h[1]) for h in searcher.hits(Words(raw, off, IS_BREAK))}
    assert found == {(i, i) for i, _ in items}


def test_decontamination_finds_excerpts_across_cuts_and_copies_without_an_end(spark):
    long, short = [f"a{k}" for k in range(128)], [f"b{k}" for k in range(59)]
    filler = " ".join(f"f{k}" for k in range(80))
    parts = {1: long[26:119], 2: long[:64], 3: short[:50], 4: short[:40], 5: long[10:35]}
    docs = spark.createDataFrame([(i, f"{filler} {' '.join(p)} {filler}") for i, p in parts.items()] + [(100 + i, filler) for i in range(100)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short))], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.search(docs, bench).collect())
    assert got == [(1, 1), (2, 1), (3, 2)]  # the fourth lacks the answer, the fifth is a short phrase


def test_decontamination_counts_a_pair_once_over_passes(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PASS", 1)
    words = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    bench = spark.createDataFrame([(1, words[0]), (1, words[1]), (2, words[2]), (1, words[0])], "item_id long, text string")
    docs = spark.createDataFrame([(i, w, i) for i, w in enumerate(words)] + [(0, words[1], 7), (9, "clean", 8), (None, words[2], 9)], "doc_id long, text string, _lower int")
    assert sorted(map(str, [(r.doc_id, r.item_id) for r in decontam.search(docs, bench).collect()])) == sorted(map(str, [(0, 1), (1, 1), (2, 2), (None, 2)]))
    assert [tuple(r) for r in decontam.keep_clean(docs, bench).collect()] == [(9, "clean", 8)]


def brute_hits(docs, items):
    """Pairs by the longest common subsequence of each passage and each stretch of a text, without retrieval."""
    found = set()
    texts = [Words(raw, off, IS_BREAK) for _, _, raw, off in text_slices(pa.array([t.lower() for _, t in docs], pa.large_string()), 1 << 40)][0]
    p = decontam._cut([(i, t.lower()) for i, t in items])
    passages = [p.words[a : a + n].tolist() for a, n in zip(p.first, p.size, strict=True)]
    for d, (doc_id, _) in enumerate(docs):
        own = texts.hash[texts.first[d] : texts.first[d + 1]].tolist()
        for item, passage in zip(p.item.tolist(), passages, strict=True):
            n = len(passage)
            if (doc_id, item) in found or len(set(own) & set(passage)) < 0.5 * len(set(passage)):
                continue
            for at in range(0, max(1, len(own)), decontam.STEP):
                near = own[max(0, at - n) : at + 2 * decontam.STEP + n]
                share = decontam.common_words(passage, near) / n
                told = decontam.common_words(passage[-max(1, n // 4) :], near) / max(1, n // 4)
                if share >= decontam.COMMON and (told >= decontam.ANSWER or share >= decontam.WHOLE):
                    found.add((doc_id, item))
                    break
    return found


def test_decontamination_recall_against_exact_subsequences(spark):
    """What a search without retrieval confirms, on real documents and copies with up to 35 % of words changed."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    rng = np.random.default_rng(8)
    for n, (_, text) in enumerate(items * 2):
        words = [w if rng.random() > 0.35 * rng.random() else f"z{rng.integers(10**6)}" for w in text.split()]
        docs.append((10**6 + n, " ".join([*(f"f{x}" for x in rng.integers(0, 10**6, 40)), *words, *(f"f{x}" for x in rng.integers(0, 10**6, 40))])))
    want = brute_hits(docs, items)
    got = {(r.doc_id, r.item_id) for r in decontam.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > len(items) and len(got & want) / len(want) >= 0.97
    assert len(got - want) <= 0.01 * len(got)


def test_common_words_is_the_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.integers(0, 4, 12).tolist(), rng.integers(0, 4, 20).tolist()
        table = np.zeros((13, 21), int)
        for i in range(12):
            for j in range(20):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontam.common_words(a, b) == table[-1, -1]


def test_quality_learns_the_labels(docs, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    real = docs.where("doc_id >= 0")
    got = {r.doc_id: r for r in quality.classify(real, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    right = [got[r.doc_id].predicted == r.quality for r in labels.collect()]
    assert np.mean(right) > 0.9
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, labels).collect())


def test_quality_matches_a_dense_discriminant(docs, spark):
    """Moments, shrinkage and densities against a direct computation; accuracy on held-out rows only."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    real = docs.where("doc_id >= 0")
    stats = {r.doc_id: np.array(r.stats) for r in quality.describe(real).collect()}
    mark = {r.doc_id: r.quality for r in labels.collect()}
    taught = [i for i in stats if i in mark and zlib.crc32(str(i).encode()) % 3 != 1]
    x, y = np.stack([stats[i] for i in taught]), np.array([mark[i] for i in taught])
    shift, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-9))
    asked = (np.stack([stats[i] for i in sorted(stats)]) - shift) / scale
    density = []
    for c in (0, 1):
        own = (x[y == c] - shift) / scale
        cov = np.cov(own.T, bias=True)
        cov = (1 - quality.SHRINKAGE) * cov + quality.SHRINKAGE * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
        gap = asked - own.mean(0)
        density.append(np.log(len(own) / len(x)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap))
    want = 1 / (1 + np.exp(np.clip((density[0] - density[1]) / quality.TEMPERATURE, -500, 500)))
    got = {r.doc_id: r for r in quality.classify(real, labels).collect()}
    assert np.allclose([got[i].score for i in sorted(stats)], want, atol=1e-5)
    held = [i for i in mark if got[i].held_out]
    assert np.mean([got[i].predicted == mark[i] for i in held]) > 0.9


def test_languages_are_told_apart(docs):
    got = {r.doc_id: r for r in langid.classify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.where("lang IS NOT NULL").collect()}
    held = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    assert got[-1].lang_pred == got[-2].lang_pred == got[-3].lang_pred == "und"
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)


def brute_code_lengths(texts, order):
    """Bits of a byte after a context by escape method C with exclusion, from counts in dictionaries."""
    counts = collections.defaultdict(collections.Counter)
    for t in texts:
        padded = b"\n" * order + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts[padded[i - k : i]][padded[i]] += 1

    def probabilities(context):
        below = probabilities(context[1:]) if context else [1 / 256] * 256
        seen = counts.get(context)
        if not seen:
            return below
        total, left = sum(seen.values()) + len(seen), sum(p for b, p in enumerate(below) if b not in seen)
        return [seen[b] / total if b in seen else len(seen) / total * p / left for b, p in enumerate(below)]

    return probabilities


def test_code_lengths_match_brute_force():
    rng = np.random.default_rng(2)
    taught = [bytes(rng.integers(97, 101, 60).tolist()), "éàü naïve".encode(), b"", b"abc"]
    asked = [b"abca", b"\xff\x00z", "é abcd".encode(), b"", b"q"]
    order = langid.ORDER
    tree, probabilities = langid.train(taught, order), brute_code_lengths(taught, order)
    for context in (b"\n" * order, b"abcd", b"\x00\xff\xc3\xa9"):
        assert sum(probabilities(context)) == pytest.approx(1)
    model = langid.Identifier(["x"], [tree])
    off = np.concatenate([[0], np.cumsum([len(t) for t in asked])])
    got = model.code_lengths(np.frombuffer(b"".join(asked), np.uint8), off)[:, 0]
    for g, t in zip(got, asked, strict=True):
        padded = b"\n" * order + t
        want = -sum(np.log2(probabilities(padded[i - order : i])[padded[i]]) for i in range(order, len(padded)))
        assert g == pytest.approx(want)


def test_many_languages_and_repeated_rows(spark):
    rows = [(100 * k + i, " ".join(f"{chr(0x4E00 + k)}{chr(0x4E00 + k + j)}" for j in range(i + 2)), f"l{k:03}") for k in range(70) for i in range(3)]
    rows += [(7, "the same row again", "l000")] * 50 + [(8, None, None), (9, "", "l001"), (None, "no id", "l002")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    assert model.names == [f"l{k:03}" for k in range(70)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(frame, model).collect()}
    right = np.mean([got[i] == lang for i, t, lang in rows if i is not None and i >= 10 and t])
    assert right > 0.9
    assert got[8] == "und"


def test_fingerprints_estimate_likeness(docs):
    got = [r for r in fingerprints.with_next(docs).collect()]
    order = sorted(((r.doc_id if r.doc_id is not None else -(1 << 63), r.text or "") for r in docs.collect()))
    by_id = {r.doc_id if r.doc_id is not None else -(1 << 63): r for r in got}
    errors = []
    for k, (i, text) in enumerate(order):
        nxt, h = order[(k + 1) % len(order)][1], len(text) // 2
        edited, r = text[: len(text) - h] + nxt[:h], by_id[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, nxt)):
            a, b = shingles(text, 5), shingles(other, 5)
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    same = collections.defaultdict(set)
    for r in got:
        same[dict(order)[r.doc_id if r.doc_id is not None else -(1 << 63)]].add(r.fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_fingerprint_ranges_with_ties(spark):
    rows = [(None, f"null {i} {'w ' * i}") for i in range(40)] + [(5, f"five {i}") for i in range(40)] + [(i, f"text {i} of its own") for i in range(100, 160)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = fingerprints.with_next(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = [(r.doc_id, r.text) for r in frame.orderBy(F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64("text"), "text").collect()]
    want = collections.Counter()
    for k, (i, text) in enumerate(order):
        h = len(text) // 2
        want[i, hashlib.sha256((text[: len(text) - h] + order[(k + 1) % len(order)][1][:h]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_mixing_meets_its_targets(docs):
    got = mixing.taken(docs).collect()
    assert len(got) == docs.count() and sorted(map(str, got)) == sorted(map(str, mixing.taken(docs).collect()))
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    assert all(r.size == sizes[r.doc_id] and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.taken // r.size for r in got if r.size) + mixed.where(mixing.word_count(F.col("text")) == 0).count()


def test_one_source_takes_what_it_has(spark):
    frame = spark.createDataFrame([(1, "a b c", "s"), (2, "d", "t"), (3, None, None)], "doc_id long, text string, source string")
    got = {r.source: r for r in mixing.source_targets(frame).collect()}
    assert [got[k].target for k in ("s", "t", None)] == pytest.approx([4 / 3, 8 / 3, 0.0])
    frame = spark.createDataFrame([(1, "a b c d e f g h", "s"), (2, "d", "t")], "doc_id long, text string, source string")
    got = {r.source: r for r in mixing.source_targets(frame).collect()}
    assert [got[k].target for k in ("s", "t")] == pytest.approx([6.0, 3.0])  # t stops at three times its size


def test_warc_round_trip(spark):
    long = "<p>WARC/1.1\r\n\r\nWARC/1.1\r\né</p>" * 9000
    pages = [(5, "http://a/WARC/1.1", "x" * 200), (3, None, "x" * 200), (4, "u\r\nv", "x" * 99), (6, "u", "x" * 99), (7, "u", long), (8, "u", None), (9, "u", "\r\n\r\n"), (2, "u", long), (None, "u", "x" * 200), (3, "u", "x" * 200)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(map(tuple, warc.round_trip(frame, segment=50000).collect()), key=str)
    want = []
    for i, _, html in pages:
        b = (html or "").encode()
        first = min((j for j, _, h in pages if j is not None and h == html), default=None) if len(b) >= 100 else None
        revisit = i is not None and first is not None and i != first
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)


def test_warc_reports_what_is_broken(spark, tmp_path):
    path = f"file://{tmp_path}/broken"
    warc.write_warc(spark.createDataFrame([(1, "u", "abc" * 9000)], "page_id long, url string, html string"), path, segment=5000)
    text = "".join(p.read_bytes().decode() for p in (tmp_path / "broken").glob("part-*"))
    parts = text.split(warc.START)
    (tmp_path / "cut.warc").write_bytes(warc.START.join(parts[:3] + parts[4:]).encode())
    assert [r.error for r in warc.read_warc(spark, f"file://{tmp_path}/cut.warc").collect()] == ["segments missing"]
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nab\r\n0\r\n\r\n")


def record(version, kind, name, block, extra=""):
    head = f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{name}>\r\n{extra}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("split", ["128m", "300"])
def test_warc_of_any_bytes_and_versions(spark, tmp_path, split):
    """Framing is by Content-Length: payloads may hold record starts, whole records and bytes that are no text."""
    inner = record("1.1", "response", "quoted", b"HTTP/1.1 200 OK\r\n\r\nnot a record of its own", "Page-ID: 77\r\n")
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    payloads = [b"plain", bytes(range(256)) * 3, b"WARC/1.1\r\n" * 30, b"x" * 500 + inner * 4 + b"WARC/1.", inner, b"", b"\r\n\r\n", b"WARC/1.0\r\nWARC-Type: response\r\n\r\n"]
    written = [record("1.0" if i % 2 else "1.1", "response", i, http + p, f"Page-ID: {i}\r\n") for i, p in enumerate(payloads)]
    info = record("1.0", "warcinfo", "info", b"software: none\r\n")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(info + b"".join(written[:5]))
    (tmp_path / "in" / "b.warc").write_bytes(b"".join(written[5:])[:-4])
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1" if split == "300" else "4m")
    try:
        got = {r.page_id: r for r in warc.read_warc(spark, f"file://{tmp_path}/in").where("record_type = 'response'").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {i: bytes(r.payload) for i, r in got.items()} == dict(enumerate(payloads))
    assert {r.error for r in got.values()} == {None}


def test_urls_against_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x?q#f", "http://www.example.com/en/", "https://a.www.example.com/en/y", "http://b.net/es/", "http://net/fr/z", "http://net/fr", "http://com", "http://com/", "http://xcom/", "http://x.com?/", "x://y://z.com/en/", "http://notexample.com/en/"]
    real = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    frame = spark.createDataFrame(list(enumerate(urls + real)), "page_id long, url string").withColumn("host", F.lit("clash"))
    for r in url_filter.judge_urls(frame).collect():
        url = (urls + real)[r.page_id]
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group().translate(ASCII)
        path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
        fits = [x for x in url_filter.RULES if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[0] + best[1], best[2] if best else "allow")


def test_digest_collisions_are_told_apart(tmp_path):
    at = f"{tmp_path}/r-"
    same = lambda b: len(b) % 2
    url_filter.DigestArray.write([("a", "/", "block"), ("bb", "/", "allow"), ("ccc", "/x", "block")], at, same)
    rules = url_filter.DigestArray(at)
    hits = rules.find([b"bb\0/", b"a\0/", b"ccc\0/x", b"zz\0/"], same)
    assert [h >= 0 for h in hits] == [True, True, True, False] and len(set(hits[:3])) == 3
