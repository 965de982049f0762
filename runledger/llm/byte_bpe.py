"""Byte-level BPE with tiktoken and a local rank file.

Long texts are cut before the library sees them, at boundaries that no match of
the splitting pattern crosses: between a letter or digit and a space or line
break after it. The pattern never joins such a pair, and looks ahead only from
white space, so the pieces' ids joined are the whole text's ids.

Defined cases: a null text is an empty one (no ids, empty bytes). Null or
repeated ids pass, one row per input row. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from runledger.llm.common import arrow_schema, schema, slices

#: Texts over so many characters are cut into pieces of about this size.
PIECE = 1 << 16
_BOUNDARY = re.compile(r"[A-Za-z0-9](?=[ \n])")
#: Unicode's White_Space, which is what the pattern's white space is.
_SPACE = "[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Runs of white space as long as this overflow the library's matcher; each is one match, and is handed over as one.
_LONG_RUN = re.compile(f"{_SPACE}{{{PIECE},}}")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in order, cut only at safe boundaries; without one, a stretch stays whole."""
    at = 0
    while len(text) - at > size:
        found = _BOUNDARY.search(text, at + size - 1)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def stretches(text: str) -> Iterator[tuple[str, bool]]:
    """(stretch, whether it is one match of the pattern): very long runs of white space, and what lies between them.

    A run ends the match before it. Its own match takes all of it but the last
    character, which may open the next match, or all of it at the text's end.
    """
    at = 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    yield text[at:], False


def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(f"local-{len(ranks)}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(coder, text: str) -> list[int]:
    if len(text) <= PIECE:
        return coder.encode_ordinary(text)
    ids: list[int] = []
    for stretch, one_match in stretches(text):
        if one_match:
            ids += coder._encode_single_piece(stretch)
        else:
            for piece in pieces(stretch):
                ids += coder.encode_ordinary(piece)
    return ids


def _encoded(batches: Iterable[pa.RecordBatch], coder) -> Iterator[tuple[pa.Array, list[list[int]]]]:
    for batch in slices(batches, 64):
        yield batch.column(0), [encode_text(coder, text or "") for text in batch.column(1).to_pylist()]


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id and ids (array of int)."""
    out = schema(docs.select(id_col), [id_col], "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, fields = encoding(rank_file, pattern), arrow_schema(out)
        for keys, ids in _encoded(batches, coder):
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, fields.field(1).type)], schema=fields)

    return docs.select(id_col, text_col).mapInArrow(run, out)


def decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the raw bytes of its ids (null ids: empty). Bytes, since cut ids need not end at a character."""
    out = schema(encoded.select(id_col), [id_col], "decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, fields = encoding(rank_file, pattern), arrow_schema(out)
        for batch in slices(batches, 64):
            raw = [coder.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, fields.field(1).type)], schema=fields)

    return encoded.select(id_col, ids_col).mapInArrow(run, out)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode, then decode, in one pass of one Python process: id, ids and the decoded bytes."""
    out = schema(docs.select(id_col), [id_col], "ids array<int>, decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, fields = encoding(rank_file, pattern), arrow_schema(out)
        for keys, ids in _encoded(batches, coder):
            raw = [coder.decode_bytes(x) for x in ids]
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, fields.field(1).type), pa.array(raw, fields.field(2).type)], schema=fields)

    return docs.select(id_col, text_col).mapInArrow(run, out)
