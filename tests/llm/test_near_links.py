"""Links of single pairs in buckets over the limit: a class can't make up for them by another path."""

import numpy as np
from pyspark.sql import functions as F

from runledger.llm import edit_fingerprints


def test_pairs_in_large_buckets_are_found(spark):
    """Pairs at LIKENESS whose bands are all crowded by rows like neither: at least nine of ten must be linked."""
    draw = np.random.default_rng(12)
    pairs, bits = 150, edit_fingerprints.BITS
    differing = round(bits * (1 - edit_fingerprints.LIKENESS) / 2)
    # Few different band words: every bit but one in six is the same in all rows.
    shared = draw.integers(0, 2, bits, dtype=np.uint8)
    free = draw.random(bits) < 0.45
    rows = []
    for i in range(pairs):
        left = np.where(free, draw.integers(0, 2, bits, dtype=np.uint8), shared)
        right = left.copy()
        right[draw.choice(bits, differing - 1, replace=False)] ^= 1
        rows += [(2 * i, left), (2 * i + 1, right)]
    table = np.array([r[1] for r in rows])
    like = 1 - 2 * (table[:, None] != table[None]).mean(axis=2)
    np.fill_diagonal(like, 0)
    expected = {tuple(sorted((i, j))) for i, j in np.argwhere(like >= edit_fingerprints.LIKENESS).tolist()}
    only = [p for p in expected if (like[p[0]] >= edit_fingerprints.LIKENESS).sum() == (like[p[1]] >= edit_fingerprints.LIKENESS).sum() == 1]
    assert len(only) >= 100
    frame = spark.createDataFrame([(i, bytearray(np.packbits(b).tobytes())) for i, b in rows], "id long, raw binary")
    for limit in (edit_fingerprints.BUCKET_ROWS, 4):
        found = {r["id"]: r["class_id"] for r in frame.join(edit_fingerprints.shared_classes(frame, limit=limit), "raw", "left").collect()}
        linked = sum(found[a] is not None and found[a] == found[b] for a, b in only)
        assert linked >= 0.9 * len(only), (limit, linked, len(only))


def test_fingerprints_of_one_number_are_not_merged(spark, monkeypatch):
    """A hash that tells nothing apart: all fingerprints with one sketch first get the same number."""
    numbered = edit_fingerprints._node
    monkeypatch.setattr(edit_fingerprints, "_node", lambda raw, tried=0: numbered(raw, tried) if tried else F.lit(7).cast("long"))
    draw = np.random.default_rng(5)
    apart = [bytes(4) + draw.bytes(edit_fingerprints.BITS // 8 - 4) for _ in range(6)]
    near = bytearray(apart[0])
    near[20] ^= 1
    rows = [*enumerate(apart), (6, bytes(near)), (7, apart[3]), (8, None), (9, None)]
    frame = spark.createDataFrame([(i, raw and bytearray(raw)) for i, raw in rows], "id long, raw binary")
    found = {r["id"]: (r["class_id"], r["documents"]) for r in frame.join(edit_fingerprints.shared_classes(frame), "raw", "left").collect()}
    assert found == {0: (0, 2), 6: (0, 2), 3: (3, 2), 7: (3, 2), **dict.fromkeys([1, 2, 4, 5, 8, 9], (None, None))}


def test_links_do_not_depend_on_the_size_of_a_bucket(spark):
    """Crowded bands, single pairs and a dense group: classes are those of every pair that a band and its sketch agree on, whatever the limit."""
    draw = np.random.default_rng(3)
    bits, bands, first = edit_fingerprints.BITS, 2, 8 * edit_fingerprints.SKETCH_BYTES
    picks = np.random.default_rng(edit_fingerprints.SEED + 1)
    picks = [picks.choice(np.arange(first, bits), edit_fingerprints.WORD_BITS, replace=False) for _ in range(bands)]
    # All rows agree in the first band.
    shared, free = draw.integers(0, 2, bits, dtype=np.uint8), draw.random(bits) < 0.45
    free[picks[0][: edit_fingerprints.BAND_BITS]] = False
    others = np.setdiff1d(np.arange(bits), picks[0][: edit_fingerprints.BAND_BITS])
    table = [np.where(free, draw.integers(0, 2, bits, dtype=np.uint8), shared) for _ in range(150)]
    for of, times in [(i, 1) for i in range(1, 100)] + [(0, 40)]:
        for _ in range(times):
            near = table[of].copy()
            near[draw.choice(others, draw.integers(60, 76), replace=False)] ^= 1
            table.append(near)
    table = np.array(table)
    share = (1 - edit_fingerprints.LIKENESS) / 2
    root = np.arange(len(table))
    differ = table[:, None] != table[None]
    linked = np.zeros(differ.shape[:2], bool)
    for pick in picks:
        seen = [*range(first), *pick[edit_fingerprints.BAND_BITS :]]
        allowed = len(seen) * share + 3 * (len(seen) * share * (1 - share)) ** 0.5
        linked |= ~differ[:, :, pick[: edit_fingerprints.BAND_BITS]].any(axis=2) & (differ[:, :, seen].sum(axis=2) <= allowed)
    linked &= 1 - 2 * differ.mean(axis=2) >= edit_fingerprints.LIKENESS
    for i in range(len(table)):
        joined = np.unique(root[linked[i]])
        root[np.isin(root, joined)] = joined[0]
    sizes = np.bincount(root, minlength=len(table))
    wanted = {i: int(root[i]) if sizes[root[i]] > 1 else None for i in range(len(table))}
    assert sum(sizes == 2) > 50 and sizes.max() > 20
    frame = spark.createDataFrame([(i, bytearray(np.packbits(b).tobytes())) for i, b in enumerate(table)], "id long, raw binary")
    for limit in (edit_fingerprints.BUCKET_ROWS, 20):
        found = {r["id"]: r["class_id"] for r in frame.join(edit_fingerprints.shared_classes(frame, bands=bands, limit=limit), "raw", "left").collect()}
        assert found == wanted, limit
