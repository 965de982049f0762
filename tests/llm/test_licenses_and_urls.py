"""License scans and URL filters against plain re-statements of what they must find."""

import os
import re

import pytest

from runledger.llm import licenses, queries, url_filter

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_scan(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for i in range(len(words)) for phrase, label in licenses.BASE_PHRASES.items() if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None, "", " \n", "MIT License", "the mit-license, MIT LICENSE; smit license", "General\nPublic  License general public", "Apache\u00a0License apache license",
    "ÉCOLE mit license", "mit license " * 3000, "GNU Lesser General Public License", "x" * 100_000,
]


def scanned(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, hits string")
    return {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}


def test_phrases_match_the_plain_scan(spark):
    rows = scanned(spark, TEXTS)
    for i, text in enumerate(TEXTS):
        base = [h["word"] for h in rows[i]["hits"] if h["kind"] == "base"]
        labels = ",".join(sorted({h["label"] for h in rows[i]["hits"] if h["kind"] == "base"}))
        assert (rows[i]["n_words"], len(base), min(base, default=None), max(base, default=None), labels) == plain_scan(text)


@needs_data
def test_license_query_matches_the_plain_scan(spark):
    texts = {r["doc_id"]: r["text"] for r in queries.read(spark, DATA, "documents").collect()}
    rows = queries.op1_license_scan(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_scan(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@pytest.mark.parametrize(("expression", "labels", "verdict"), [
    ("MIT", ["mit"], "permissive"), ("GPL-3.0-or-later", ["gpl"], "copyleft"), ("MIT OR GPL-2.0-only", ["gpl", "mit"], "permissive"),
    ("MIT AND GPL-2.0-only", ["gpl", "mit"], "copyleft"), ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl"], "weak-copyleft"),
    ("MIT OR GPL-2.0 AND CC-BY-NC-4.0", ["cc-by-nc", "gpl", "mit"], "permissive"), ("(MIT OR GPL-2.0) AND CC-BY-NC-4.0", ["cc-by-nc", "gpl", "mit"], "restricted"),
    ("something-odd", ["something-odd"], "unknown"), ("MIT AND", [], "invalid"), ("(MIT", [], "invalid"), ("MIT)", [], "invalid"), ("MIT GPL", [], "invalid"), ("", [], "invalid"),
    ("OR MIT", [], "invalid"), ("()", [], "invalid"), ("(" * 5000 + "MIT" + ")" * 5000, ["mit"], "permissive"),
])
def test_expressions(expression, labels, verdict):
    assert licenses.evaluate(expression) == (labels, verdict)


def test_tags_are_read_to_the_end_of_their_line(spark):
    text = "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */\nMIT License\nnotalicense: x\nLicense: GPL-3.0 AND"
    row = scanned(spark, [text])[0]
    assert [(x["expression"], x["labels"], x["verdict"]) for x in row["expressions"]] == [("(MIT OR Apache-2.0)", ["apache", "mit"], "permissive"), ("GPL-3.0 AND", [], "invalid")]
    assert {(h["kind"], h["label"]) for h in row["hits"]} == {("tag", "mit"), ("tag", "apache"), ("base", "mit")}


def test_empty_tables(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme/adult", "", "", None, "block"), ("http://NET/x", "net", "/x", "net/", "block"),
    ("http://a.example.net/en/1?q#f", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://a.example.net/EN/1", "a.example.net", "/EN/1", "net/", "block"),
    ("http://net", "net", "", None, "allow"), ("http://xexample.com/de/1", "xexample.com", "/de/1", None, "allow"), ("http://x.example.com/de/", "x.example.com", "/de/", "example.com/de/", "block"),
    ("http://adult.x.org/fr/1", "adult.x.org", "/fr/1", "org/fr/", "allow"), ("http://adults.com/", "adults.com", "/", None, "allow"), ("http://cheap.com/cheap?cheap", "cheap.com", "/cheap", None, "allow"),
    ("http://cheap.com/free", "cheap.com", "/free", None, "block"), ("http://a.com?x=/b", "a.com", "", None, "allow"), ("http://a.com/p//q://net/", "a.com", "/p//q://net/", None, "allow"),
])
def test_urls(url, host, path, rule, verdict):
    judge = url_filter.Judge(url_filter.RULES, url_filter.STRICT, url_filter.SOFT)
    assert judge(url)[:4] == (host, path, rule, verdict)


@needs_data
def test_url_query_matches_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    base.sql(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet' UNION ALL SELECT -1, NULL, NULL UNION ALL SELECT -2, 'http://a.net?x=/b', NULL UNION ALL SELECT -3, 'adult\n://Org/fr/#/x', NULL")
    extra = spark.createDataFrame([(-1, None), (-2, "http://a.net?x=/b"), (-3, "adult\n://Org/fr/#/x")], "page_id long, url string")
    judge = url_filter.Judge(url_filter.RULES, url_filter.STRICT, url_filter.SOFT)
    got = {r["page_id"]: tuple(r)[1:] for r in queries.op2_url_filter(spark, DATA).collect()}
    for r in extra.collect():
        host, path, rule, verdict, strict, soft, weight = judge(r["url"])
        got[r["page_id"]] = (host, path, rule, verdict, ",".join(strict), ",".join(soft), weight)
    found = base.sql(queries.ORACLES["op2_url_filter"])
    assert {r[0]: r[1:] for r in found.fetchall()} == got
