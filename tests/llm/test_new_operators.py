"""Hard negatives, phrases and secrets against brute force on small fixtures."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from skein.llm import decontam, fingerprints, hard_negatives, langid, mixing, near_dup, phrases, secret_scan, suffix_dedup

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_secrets(text):
    found = []
    for m in ASSIGN.finditer(text):
        if len(m.group(2)) >= 6:
            found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if m.end() - m.start() >= 20:
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if m.end() - m.start() >= 24:
            found.append((m.start(), 2, m.end()))
    return sorted(found)


def said(found):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def secret_texts():
    r = random.Random(5)
    texts = [None, "", "token", "Token : 'abc.de', PASSWORD=\"zzzzzz\" api-key=1234567 APIKEY:x api_key =  a/b+c=", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 12 + "c", "AKIA AKIA" + "7" * 30, "é𝄞 token=abcdef é" + "0af" * 9]
    texts += ["f" * 23, "f" * 24, "x" + "9e" * 5_000 + "g", "secret=" + "a" * 100_000, "token=token=token=abcdef", "passwdpassword:secret", "token" + " " * 5_000 + "= abcdefg", "f" * 24, "f" * 24]
    bits = ["token", "password", "passwd", "api_key", "apikey", "secret", "=", ":", " ", "  ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "word", "é", "-", ".", "\n"]
    return texts + ["".join(r.choice(bits) for _ in range(r.randrange(1, 40))) for _ in range(400)]


def test_base_secrets_match_brute_force(spark):
    texts = secret_texts()
    docs = spark.createDataFrame([(i if i else None, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, key string, kind int")
    got = {r.doc_id: r for r in secret_scan.find(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want, row = brute_secrets(t or ""), got[i if i else None]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3)), t
        assert row.base_sha256 == hashlib.sha256(said(want).encode()).hexdigest()
        spans = [x.split(":") for x in row.spans.split(",") if x]
        assert [x for x in spans if x[0] != "random"] == [x.split(":") for x in said(want).split(",") if x]
        # Added spans touch no base span.
        assert all(int(b) <= s or int(a) >= e for k, a, b in spans if k == "random" for s, _, e in want)
    assert secret_scan.find(docs.limit(0)).count() == 0


def test_random_tokens_are_told_from_ordinary_ones(spark):
    r = random.Random(11)
    kinds = {"b64": string.ascii_letters + string.digits + "+/", "lower": string.ascii_lowercase + string.digits, "upper": string.ascii_uppercase + string.digits}
    planted = ["".join(r.choices(a, k=n)) for a in kinds.values() for n in (20, 32, 40) for _ in range(20)]
    plain = ["my_long_variable_name", "version20240501release", "com/articles/2024/05/my-post-title", "thequickbrownfoxjumps", "THE_MAXIMUM_NUMBER_OF_ROWS", "4847708710132934", "-" * 40]
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(10_000 + i, f"see <{t}> and more") for i, t in enumerate(planted + plain)]
    found = secret_scan.spans(real.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).where("kind = 'random'").collect()
    hit = {x.doc_id - 10_000: x for x in found}
    assert sum(i in hit for i in range(len(planted))) >= 0.97 * len(planted)
    assert all(hit[i].value == planted[i] and hit[i].start == 5 and hit[i].score > math.log(secret_scan.ODDS_AGAINST) for i in hit if 0 <= i < len(planted))
    assert not [plain[i - len(planted)] for i in hit if i >= len(planted)]
    assert not [x for x in found if x.doc_id < 10_000]  # the corpus holds no secret but those of the base patterns


def test_scores_are_sums_of_log_ratios(spark):
    strings = lambda rows: spark.createDataFrame([(x,) for x in rows], "string string")
    one, two = ["a1b2", "Zq9"], ["word", "some_word", "words"]
    model = secret_scan.fit(strings(one), strings(two))
    got = {r.string: r.score for r in secret_scan.scores(strings(["a1word", "word", "9", "some-word"]), model).collect()}

    def chances(rows):
        pairs = [("^" + x)[i : i + 2] for x in rows for i in range(len(x))]
        v = len(secret_scan.ALPHABET)
        return lambda p: math.log((pairs.count(p) + 0.5) / (sum(x[0] == p[0] for x in pairs) + 0.5 * v))

    a, b = chances(one), chances(two)
    for s, score in got.items():
        m = "^" + s.replace("-", "_")
        assert score == pytest.approx(sum(a(m[i : i + 2]) - b(m[i : i + 2]) for i in range(len(m) - 1)), abs=1e-5)


def brute_negatives(rows, every=100):
    rows = [(i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, [math.floor(256 * x) for x in v]) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    big, out = 1 << 70, []
    for n, (a, la, q) in enumerate(rows):
        if a is None or a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), big if i is None else i, m, l) for m, (i, l, v) in enumerate(rows) if m != n)
        for s, p, _, _ in [x for x in scored if x[3] == la][:5]:
            hard = [x for x in scored if x[3] != la and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, None if p == big else p, r, None if i == big else i, -s, -t) for r, (t, i, _, _) in enumerate(hard, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_match_brute_force(spark, monkeypatch, small):
    if small:  # many blocks and rounds
        monkeypatch.setattr(hard_negatives, "LEAST_BLOCK", 7)
        monkeypatch.setattr(hard_negatives, "FIRST", 2)
        monkeypatch.setattr(hard_negatives, "GROW", 2)
        monkeypatch.setattr(hard_negatives, "CHUNK", 3)
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 0.2) + (i % 3) for _ in range(6)], r.randrange(4)) for i in range(0, 600, 2)]
    hot = [0.5, 0.25, 0.5, 0.125, 0.5, 0.5]
    rows += [(1001 + i, hot, i % 2) for i in range(150)]  # one vector in very many rows: ties
    rows += [(700, hot, 1), (700, hot, 1), (800, [0.0] * 6, 2), (900, [-1.0] * 6, 3), (None, hot, 1), (None, [2.0] * 6, 2)]
    rows += [(1, None, 1), (2, [1.0] * 6, None), (3, [None] * 6, 1), (4, [math.nan] * 6, 1), (1000, [math.inf] * 6, 1), (1100, [], 1), (1200, [3.0], 2), (1300, [1.0] * 6, 77)]
    df = spark.createDataFrame([(*x, "x") for x in rows], "vec_id long, embedding array<float>, label int, score string")
    got = sorted(str(tuple(x)) for x in hard_negatives.mine(df, relabel=(7, 10)).collect())
    assert got == brute_negatives(rows)
    assert len(got) > 100
    assert hard_negatives.mine(df.limit(0)).count() == 0
    assert hard_negatives.mine(df.where("label IS NULL")).count() == 0


def test_hard_negatives_of_too_large_components(spark):
    df = spark.createDataFrame([(0, [1e9, 1e9], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError):
        hard_negatives.mine(df)


SPACE = re.compile(r"[^\x20\x09]+")
PIECE = re.compile(r"[.,;:!?\x0A-\x0D]")
ASCII = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_collocations(rows, least, longest=5, share=100, most=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in PIECE.split((text or "").translate(ASCII)):
            w = SPACE.findall(piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    kept = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    longer = collections.Counter()
    for (lang, w), a in kept.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    longer[lang, w[i:j]] = max(longer[lang, w[i:j]], a)
    told = collections.defaultdict(list)
    for (lang, w), a in kept.items():
        if longer[lang, w] and 100 * longer[lang, w] >= share * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        told[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in told.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:most], 1))


def phrase_rows():
    r = random.Random(7)
    words = ["the", "The", "of", "in", "New", "York", "city", "é", "日本", "a-b", "x", "xx", "new", "\x1e", " "]
    rows = [(" ".join(r.choices(words, weights=[9, 3, 8, 7, 5, 5, 3, 2, 2, 1, 6, 2, 3, 1, 1], k=r.randrange(1, 80))) + r.choice([".", "", "\n", " , x"]), r.choice(["en", "en", "fr", None, "und"])) for _ in range(600)]
    rows += [("of the New\tYork  city!the", "en")] * 120 + [("x " * 5_000, "en"), ("x,x\nx x", "fr"), (None, "en"), ("", None), (".,;", "fr"), (None, None), ("lone", "de")]
    return rows + [("w" * 100_000 + " of", "en")] * 2


@pytest.mark.parametrize("narrow", [False, True])
def test_collocations_match_brute_force(spark, monkeypatch, narrow):
    if narrow:  # sketches too narrow to tell much, and many automata in many scans
        monkeypatch.setattr(phrases, "LEAST_CELLS", 1 << 16)
        monkeypatch.setattr(phrases, "MOST_CELLS", 1 << 16)
        monkeypatch.setattr(phrases, "AUTOMATON_BYTES", 500)
        monkeypatch.setattr(phrases, "SCAN_BYTES", 2_000)
        monkeypatch.setattr(phrases, "MOST_SEEN", 100)
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, lang, i, "x") for i, (t, lang) in enumerate(rows)], "text string, lang string, n long, phrase string").repartition(7)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=20).collect())
    assert got == brute_collocations(rows, 20)
    assert len(got) > 100


def test_collocations_with_other_parameters(spark):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "text string, lang string")
    for least, longest, share, most in ((300, 3, 50, 5), (5, 2, 100, 3), (10**6, 5, 100, 10)):
        got = sorted(tuple(r) for r in phrases.collocations(docs, least, longest, share, most).collect())
        assert got == brute_collocations(rows, least, longest, share, most)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    counts = {"a b": 10**11, "a": 2 * 10**11, "b": 3 * 10**11 + 7}
    told = spark.createDataFrame([("en", p, c) for p, c in counts.items()], "lang string, phrase string, f long")
    monkeypatch.setattr(phrases, "counted", lambda docs, wanted: told)
    docs = spark.createDataFrame([("a b", "en")] * 9, "text string, lang string")
    monkeypatch.setattr(phrases.F, "regexp_count", lambda *_: phrases.F.lit(10**14 + 1))
    row = phrases.collocations(docs, least=2).first()
    assert row.score == 1000 * 10**11 * 9 * (10**14 + 1) // (2 * 10**11 * (3 * 10**11 + 7))


def twins(n):
    """Two words of n letters, each the other with its letters swapped, that sums of powers of an odd base cannot tell apart."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 256, 1024, 4096])
def test_words_that_differ_have_different_hashes(spark, n):
    a, b = twins(n)
    docs = spark.createDataFrame([(1, a, None, None, None), (2, b, None, None, None), (3, a.upper(), None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, shingle=4).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    benchmark = spark.createDataFrame([(7, " ".join([b] * 8))], "item_id long, text string")
    table = spark.createDataFrame([(1, " ".join([a] * 8)), (2, " ".join([b] * 8))], "doc_id long, text string")
    assert {r.doc_id for r in decontam.search(table, benchmark).collect()} == {2}
    marked = {r.doc_id: r for r in fingerprints.with_next(docs.where("doc_id < 3")).collect()}
    assert marked[1].fingerprint != marked[2].fingerprint and marked[1].near_next < 0.2
    left = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs.where("doc_id < 3")).collect()}
    windows = collections.Counter(t[i : i + 200] for t in (a, b) for i in range(n - 199))
    for i, t in ((1, a), (2, b)):
        gone = set()
        for at in range(n - 199):
            if windows[t[at : at + 200]] > 1:
                gone.update(range(at, at + 200))
        assert left[i] == len(gone)


def test_mixing_and_deduplication_leave_columns_of_any_name_alone(spark):
    rows = [(1, "one two three", "a"), (2, "one two three", "b"), (3, "four five", None), (3, "four five six", "a"), (None, "lone text", "a"), (4, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for i, c in enumerate(["_copy", "_size", "_source", "_rate", "_drop", "_again", "a.b", "key", "row", "own", "rate", "copies", "target"]):
        docs = docs.withColumn(c, F.lit(i))
    docs = docs.withColumn("a map", F.create_map(F.lit("k"), F.col("doc_id")))
    plain = lambda df: sorted(map(str, df.collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and set(plain(mixed)) <= set(plain(docs))
    kept = near_dup.deduplicate(docs)
    assert kept.columns == docs.columns and set(plain(kept)) <= set(plain(docs))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]


@pytest.mark.parametrize("others", [2000, 100])
@pytest.mark.parametrize("foreign", [4, 5])
def test_common_words_do_not_hide_a_hit(spark, others, foreign):
    item = " ".join([f"said{i}" for i in range(20)] + [f"rare{i}" for i in range(foreign)])
    body = " ".join(f"said{i}" for i in range(20))
    rows = [(i, f"{body} and then tail{i}") for i in range(30)] + [(1000 + i, f"plain{i} words{i % 7} of no note {i}") for i in range(others)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontam.search(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == list(range(30))


def test_the_model_of_very_many_languages_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_TOTAL", 1 << 17)
    r = random.Random(4)
    rows = []
    for i in range(300):
        letters = r.sample([chr(97 + j) for j in range(26)] + [chr(0x430 + j) for j in range(32)], 12)
        rows += [(i * 10 + j, "".join(r.choices(letters + [" "], k=3000)), f"l{i:03d}") for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    size = sum(a.nbytes for t in model.trees for part in (t.contexts, t.escapes, t.codes, t.bits) for a in part)
    assert len(model.trees) == 300 and size <= 160 * (langid.TRAIN_TOTAL + 300 * 4 * langid.PIECE)
    told = langid.identify(docs, model).collect()
    want = {i: lang for i, _, lang in rows}
    assert sum(want[x.doc_id] == x.lang_pred for x in told) >= 0.95 * len(rows)
