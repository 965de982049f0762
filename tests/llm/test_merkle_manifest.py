"""The manifest against a tree built by hand."""

import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from runledger.llm import merkle_manifest, queries

DATA = "/root/testdata/sf0.001"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def tree(nodes, fanout=2):
    """(root, for each node its [(before, behind)] on the way up)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, n in enumerate(at):
            run = nodes[n // fanout * fanout : (n // fanout + 1) * fanout]
            proofs[i].append(("".join(run[: n % fanout]), "".join(run[n % fanout + 1 :])))
            at[i] = n // fanout
        nodes = [digest(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def plain(rows, fanout=2):
    """Sorted (doc_id, leaf, subroot, root, proof)."""
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append((row["doc_id"], leaf(row)))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built[lang] = tree([x[1] for x in groups[lang]], fanout)
    root, above = tree([built[g][0] for g in langs], fanout)
    out = [(d, x, built[g][0], root, own + above[i]) for i, g in enumerate(langs) for (d, x), own in zip(groups[g], built[g][1], strict=True)]
    return sorted(out, key=repr)


def found(table, **options):
    rows = merkle_manifest.manifest(table, FIELDS, **options).collect()
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in rows), key=repr)


def table_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, digest string, block int, tree int")


def random_rows(n):
    langs = ["de", "en", "en", "en", "é", None, "", "zz"]
    return [(None if i % 17 == 3 else i // 2, f"s{i % 3}", langs[i * i % 8], None if i % 5 == 0 else i, None if i % 11 == 0 else "tä" * (i % 4), "d", 1, 2) for i in range(n)]


@pytest.mark.parametrize(("n", "fanout", "band"), [(1, 2, 6), (2, 2, 1), (37, 2, 2), (150, 2, 6), (150, 3, 1), (260, 4, 2)])
def test_matches_a_tree_built_by_hand(spark, n, fanout, band):
    rows = random_rows(n) + random_rows(n)[:3]
    table = table_of(spark, rows).repartition(3)
    assert found(table, fanout=fanout, band=band) == plain([dict(zip(table.columns, r, strict=True)) for r in rows], fanout)


def test_one_row_for_each_group_and_one_group(spark):
    for lang in (lambda i: f"g{i}", lambda i: None):
        rows = [(i, "s", lang(i), 1, "t", "d", 0, 0) for i in range(70)]
        assert found(table_of(spark, rows)) == plain([dict(zip([*FIELDS[:1], "source", "lang", "n_chars", "text"], r[:5], strict=True)) for r in rows])


def test_empty_table(spark):
    assert found(table_of(spark, []).filter("doc_id = 1")) == []


def test_folding_tells_what_was_tampered_with(spark):
    long = "x" * 300_000
    rows = [(i, "s", "en", 5, long if i == 4 else "t", "d", 0, 0) for i in range(9)]
    table = table_of(spark, rows).withColumn("other", merkle_manifest.leaf("doc_id", "source", "lang", F.col("n_chars") + (F.col("doc_id") % 2), "text"))
    out = merkle_manifest.manifest(table, FIELDS, keep=["other"])
    for row in out.withColumn("folded", merkle_manifest.folded(F.col("kept.other"), F.col("proof"))).collect():
        assert (row["folded"] == row["root"]) == (row["doc_id"] % 2 == 0)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query(spark):
    docs = [r.asDict() for r in queries.read(spark, DATA, "documents").collect()]
    expected = {r[0]: r for r in plain(docs)}
    rows = queries.op11_merkle_manifest(spark, DATA).collect()
    assert len(rows) == len(docs) and len(expected) == len(docs)
    by_id = {d["doc_id"]: d for d in docs}
    tampered = 0
    for row in rows:
        _, own, subroot, root, proof = expected[row["doc_id"]]
        assert (row["leaf"], row["subroot"], row["root"]) == (own, subroot, root)
        assert row["proof_sha256"] == digest(*(x for step in proof for x in step))
        claimed = dict(by_id[row["doc_id"]])
        if zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0:
            claimed["n_chars"] += 1
            tampered += 1
        node = leaf(claimed)
        for before, behind in proof:
            node = digest(before, node, behind)
        assert row["folded_root"] == node and row["verified"] == (node == root)
    assert tampered
