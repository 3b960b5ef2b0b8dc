"""Tables of contents, headers, record corpora, exposure and leading rows against plain versions."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import exposure, sequences
from skein.sources import corpus

NESTED = """<nav><ul class="toc"><li><a href="/g/1">Guide</a><ul><li><a href="/g/2">Set&amp;up</a><ol><li><a href="/g/3"> Net
 work </a></li></ol></li><li><a href="/g/4">Use</a></li></ul></li><li><a href="/g/5">Use</a><ul><li><a href="/g/6">Use</a></li></ul></li></ul></nav><a href="/no">outside</a><ul><li><a>no href</a></li><li><a href="/g/3">Flat</a></li>"""


def test_tables_of_contents_and_headers(spark):
    pages = spark.createDataFrame([(1, NESTED), (2, None), (3, "<p>none</p>"), (4, "<ul><a href='/x'>unclosed<ul><a href='/y'>b</a>")], "page_id long, html string")
    got = [(r.place, r.parent, r.depth, r.href, r.path) for r in corpus.toc(pages).where("page_id = 1").orderBy("place").collect()]
    assert got == [
        (0, None, 1, "/g/1", ["Guide"]), (1, 0, 2, "/g/2", ["Guide", "Set&up"]), (2, 1, 3, "/g/3", ["Guide", "Set&up", "Net work"]), (3, 0, 2, "/g/4", ["Guide", "Use"]), (4, None, 1, "/g/5", ["Use"]), (5, 4, 2, "/g/6", ["Use", "Use"]), (6, None, 1, "/g/3", ["Flat"]),
    ]
    assert {r.page_id for r in corpus.toc(pages).collect()} == {1, 4}
    known = corpus.sections(corpus.toc(pages))
    assert {r.href: r.path for r in known.collect()}["/g/3"] == ["Guide", "Set&up", "Net work"]
    chunks = spark.createDataFrame([("/g/3", "a"), ("/g/6", "b"), ("/zz", "c")], "href string, text string")
    assert {r.text: (r.header, r.cr_text) for r in corpus.headed(chunks, known).collect()} == {"a": ("Guide > Set&up > Net work", "Guide > Set&up > Net work\na"), "b": ("Use", "Use\nb"), "c": ("", "c")}


def test_records_become_documents(spark):
    rows = [("1", "cr", "h", "t", 5), ("2", None, "h", "t", None), ("3", None, "", "t", 7), ("4", None, "h", None, 8), (None, "x", "h", "t", 9), ("6", None, None, "t", 1)]
    df = spark.createDataFrame(rows, "id string, cr_text string, context_header string, text string, `a.b` int")
    said = lambda **k: {r.doc_id: (r.text, json.loads(r.metadata)) for r in corpus.normalised(df, **k).collect()}
    assert said() == {"1": ("cr", {"a.b": 5}), "2": ("h\nt", {}), "3": ("t", {"a.b": 7}), "6": ("t", {"a.b": 1})}
    assert said(contextual=False)["2"][0] == "t"
    assert said(text_field="context_header")["4"] == ("h", {"a.b": 8})
    with pytest.raises(ValueError):
        corpus.normalised(df, id_field="nothing")
    with pytest.raises(ValueError):
        corpus.normalised(df.drop("cr_text", "text"))


def test_leading_rows_of_any_number(spark):
    r = random.Random(1)
    rows = [(r.randrange(5), r.randrange(3), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b int, i int").repartition(9)
    for n in (0, 1, 7, 999, 1999, 2000, 5000):
        assert sorted((x.a, x.b, x.i) for x in sequences.leading(df, n, "a", "b", "i").collect()) == sorted(rows)[:n]


def test_aspects_of_hosts(spark):
    rows = [
        ("a", 3306, "5.5.5-10.3.2-MariaDB", None), ("a", 6379, "", None), ("a", 23, None, None), ("a", 23, None, None), ("b", 443, "Date: Mon, 3 Jan 2022 x", "TLSv1.2"), ("b", 8443, None, "TLSv1"), ("c", 443, "Date: Mon, 3 Jan 2022 x", None), ("c", 80, None, None),
        ("d", 21, "220 FileZilla Server 1.2.0", None), ("d", 22, "SSH-2.0-OpenSSH_7.4", None), ("e", 9, None, None), ("e", 7, None, None), ("f", 22, "SSH-2.0-dropbear_2019.78", None), ("f", 21, "FileZilla Server 0.9.60 beta", None), (None, 1, None, None), ("g", None, None, None),
    ]
    got = {(r.ip, r.aspect): (r.severity, r.port, r.ports, r.detail) for r in exposure.aspects(spark.createDataFrame(rows, "ip string, port int, banner string, protocol string"), 2024).collect()}
    assert got == {
        ("a", "exposed_db"): (8.0, 3306, [3306, 6379], None), ("a", "exposed_admin"): (8.5, 23, [23], None), ("b", "weak_tls"): (5.5, 443, [443], "TLSv1.2"), ("b", "exposed_admin"): (7.0, 8443, [8443], None), ("c", "info"): (2.5, 80, [80, 443], None),
        ("d", "info"): (4.5, 22, [22], "OpenSSH 7.4"), ("e", "info"): (2.5, 7, [7, 9], None), ("f", "info"): (4.5, 21, [21], "FileZilla Server 0.9.60 beta"),
    }


def test_what_is_told_was_observed(spark):
    evidence = [("s", "e1", "ssh", None, 1.0), ("s", "e2", "REDIS", "expired", 9.9), ("s", None, "rdp", None, 1.0), ("t", "e3", "http", None, None), ("u", "e4", "http", None, 0.0), ("v", None, "ssh", None, None), ("v", "e5", "http", None, None)]
    pictures = [("s", "weak_tls_exposed", ["e1"]), ("t", None, ["e3", "gone"]), ("u", "public_database_exposure", ["e4"]), ("v", "informational_exposure", ["e5"])]
    told = exposure.recommend(spark.createDataFrame(evidence, "site string, evidence_id string, service string, tls string, severity double"), spark.createDataFrame(pictures, "site string, top_risk string, exposures array<string>")).collect()
    assert {(r.site, r.priority): (r.risk, r.evidence_ids, r.requires_approval) for r in told} == {
        ("s", 1): ("critical_cve_exposed", "e2", True), ("s", 2): ("internet_exposed_admin", "e1", True), ("s", 3): ("public_database_exposure", "e2", True), ("s", 4): ("weak_tls_exposed", "e2", True), ("t", 1): ("informational_exposure", "e3", False),
    }


def test_similar_specs(spark):
    rows = [("a", ["x", "y", "z"], ["p", "q"]), ("b", ["x", "y"], ["q"]), ("c", ["x", "y"], []), ("d", ["w"], ["p"]), ("e", [], [])]
    df = spark.createDataFrame(rows, "spec_id string, words array<string>, params array<string>")
    assert [(r.spec_id, r.other, r.score, r.shared) for r in exposure.similar_specs(df, df, 2).orderBy("spec_id", "rank").collect()] == [("a", "b", 0.6667, "q"), ("a", "c", 0.6667, ""), ("b", "c", 1.0, ""), ("b", "a", 0.6667, "q"), ("c", "b", 1.0, ""), ("c", "a", 0.6667, "")]
    assert exposure.similar_specs(df.select("*", F.lit(1).alias("extra")), df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        exposure.similar_specs(df, df, 0)
