"""Byte-level BPE and packing: against the libraries themselves, and as round trips."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from runledger.llm import byte_bpe, packing, queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "a", " ", "It's  the\n\nend. ", "éß漢字🙂 ", "x" * 70_000, " " * 200_000 + "x", "word " * 40_000, "\n\t" * 40_000, "ab 12\u00a0\x1c\x1d<|endoftext|> I'LL Σας İ e\u0301 \u2003x", "ΑΣ ΑΣ. 'S 's."]


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)


def test_ids_are_the_librarys_and_decode_to_the_bytes(spark, coder):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "null id", 1), (0, "twice", 1)], "doc_id long, text string, ids int")
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    rows = {(r["doc_id"], len(r["ids"])): r["ids"] for r in encoded.collect()}
    assert len(rows) == len(TEXTS) + 2
    for i, text in enumerate(TEXTS):
        ids = coder.encode_ordinary(text or "")
        assert rows[(i, len(ids))] == ids
    decoded = byte_bpe.decode(encoded.filter("doc_id > 0"), RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in decoded.collect()} == {i: t.encode() for i, t in enumerate(TEXTS) if i}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_bpe_query_gives_the_librarys_digests(spark, coder):
    texts = {r["doc_id"]: r["text"] or "" for r in queries.read(spark, DATA, "documents").collect()}
    rows = {r["doc_id"]: r for r in queries.op4_byte_bpe(spark, DATA).collect()}
    assert sorted(rows) == sorted(texts)
    for doc, text in texts.items():
        ids = coder.encode_ordinary(text)
        assert (rows[doc]["n_tokens"], rows[doc]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert rows[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "Z", "9", " ", "\n", "\t", "'s", "é", ".", "\u00a0", "\x1c", "漢"]), max_size=120).map("".join), st.integers(1, 9))
def test_cuts_never_change_the_ids(text, size):
    coder = _CODER[0] if _CODER else _CODER.append(byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)) or _CODER[0]
    parts = list(byte_bpe.pieces(text, size))
    assert "".join(parts) == text
    assert [i for p in parts for i in coder.encode_ordinary(p)] == coder.encode_ordinary(text)


_CODER: list = []


def test_runs_of_white_space_beyond_the_librarys_stack(coder):
    for text in (" " * 2_000_000, "x" + " \n" * 1_000_000 + "y z", " " * 1_500_000 + "\ty"):
        ids = byte_bpe.encode_text(coder, text)
        assert coder.decode(ids) == text
    # Shorter runs, which the library can do, go the same way.
    for text in ("a" + " " * 70_000 + "b", "a" + "\n" * 70_000 + "b " + " " * 66_000, "\u00a0" * 70_000):
        assert byte_bpe.encode_text(coder, text) == coder.encode_ordinary(text)


def check_pieces(rows, texts, ids_of):
    """Every document whole and in order, every sequence gapless and of an allowed length."""
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        documents[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert sorted(documents) == sorted(texts)
    for doc, pieces in documents.items():
        expected = np.array([*ids_of(texts[doc] or ""), 2], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(expected)
            part = expected[at : at + p["length"]].tobytes()
            assert p["ids_crc32"] == zlib.crc32(part) if "ids_crc32" in p.__fields__ else bytes(p["ids"]) == part
            at += p["length"]
        assert at == len(expected)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096 and at & (at - 1) == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_texts(tokenizer):
    """Ids of texts that hold the strings of added tokens, against the untouched library."""
    draw = random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "|>", "<", "a", "it's", "\u00e9", "e\u0301", "12", " ", "\n", "\x1c", "\u3000", "!?"]
    encoder = packing.WordEncoder(WORDS, remembered=50)
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(12)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer(text), text
    assert np.frombuffer(encoder.encode("a <|endoftext|> b"), "<u4").tolist() == [320, 49407, 321]


def test_pieces_of_odd_texts(spark, tokenizer):
    texts = dict(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, start string").repartition(2)
    check_pieces(packing.pack(docs, WORDS).collect(), texts, tokenizer)
    assert packing.pack(docs.limit(0), WORDS).collect() == []
    twice = packing.pack(docs.filter("doc_id = 2").union(docs.filter("doc_id = 2")), WORDS).collect()
    assert sorted(bytes(r["ids"]) for r in twice) == sorted([np.array([*tokenizer("a"), 2], "<u4").tobytes()] * 2) or sum(r["length"] for r in twice) == 4


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_packing_query(spark, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in queries.read(spark, DATA, "documents").collect()}
    check_pieces(queries.op9_packing(spark, DATA).collect(), texts, tokenizer)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 99), max_size=40))
def test_differencing_gives_near_equal_windows(sizes):
    pieces = [(i, 0, n) for i, n in enumerate(sizes)]
    windows = packing.windows_of(pieces, 100)
    assert sorted(p for w in windows for p in w) == pieces
    assert all(sum(p[2] for p in w) <= 100 for w in windows)
    full, rest = packing.topped_up(windows, 100)
    assert all(sum(p[2] for p in w) == 100 for w in full) and sum(p[2] for p in rest) < 100
    cut = packing.powers_of_two(rest)
    for doc, n in enumerate(sizes):
        at = 0
        for _, start, length in sorted(p for w in [*full, *cut] for p in w if p[0] == doc):
            assert start == at
            at += length
        assert at == n


def test_differencing_of_a_known_case():
    # The classic five numbers: differencing gives 16 against 14.
    window, sums = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sums.tolist()) == [14, 16]
    assert sorted(np.bincount(window, [8, 7, 6, 5, 4], 2).tolist()) == [14, 16]
