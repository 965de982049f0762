"""Packing by Karmarkar-Karp multiway differencing.

Documents become token ids, closed by an end id. Each task takes its documents
in batches. Whole windows are cut from long documents; the remainders are
partitioned into near-equal windows: each remainder starts as a partial
partition into k windows, and the two partial partitions with the largest
imbalance are merged again and again, the fullest window of one onto the
emptiest of the other. If a window exceeds the capacity, k rises and the
partition is made anew. At last near-equal windows are topped up: documents may
be cut, so the emptiest windows are cut up to fill the others, and what doesn't
fill a window waits for the next batch. A task's very last remainder is cut into
sequences whose lengths are powers of two, which need no padding.

Nothing is shuffled, and a task holds one batch at a time; a sequence lies in
one task. Its id holds the task's partition number in the upper bits, so it is
unique and the same when the task is run again over the same partition.

Defined cases: a null or empty text has the end id only. Null or repeated ids
pass; every row is a document of its own. Extra columns are ignored; an empty
table gives no pieces. The strings of the tokenizer's added tokens have those
tokens' ids, as the library gives them by default.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runledger.llm.common import arrow_schema, schema, slices

CAPACITY, END_ID = 4096, 2
#: Documents whose remainders are partitioned together, tokens a batch may hold beyond that, and words a task remembers.
BATCH, BATCH_TOKENS, REMEMBERED = 256, 2_000_000, 250_000
ADDED = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Control characters that Python's split takes for white space and the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")
#: Words of Latin letters, digits and punctuation but apostrophes: they need no normalising beyond lower case, and
#: the tokenizer splits them into runs of letters, single digits and runs of punctuation.
_PLAIN = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[!-&(-/:-@[-`{-~]+")
#: The characters that byte-level vocabularies write for bytes that don't print.
_UNPRINTED = [*range(33), *range(127, 161), 173]
_BYTE_CHARACTERS = {byte: 256 + n for n, byte in enumerate(_UNPRINTED)}


class WordEncoder(dict):
    """Word -> token ids as little-endian unsigned 32-bit bytes, found on first use.

    The tokenizer drops white space and splits at it, so a text's ids are its
    words' ids joined. Plain words are split here and their parts go to the
    tokenizer's model; any other word, and one that holds an added token, goes
    through the whole tokenizer. The words met last are remembered, in two
    generations.
    """

    def __init__(self, tokenizer_file: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)", re.IGNORECASE)
        self.model, self.remembered, self.before = self.tokenizer.model, remembered, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            if self.added.search(word) or not _PLAIN.fullmatch(word):
                ids = self.whole(word)
            elif len(parts := _PARTS.findall(word.lower())) > 1 or parts[0] != word:
                ids = b"".join(map(self.__getitem__, parts))
            else:
                piece = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
                tokens = self.model.tokenize(piece)
                ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > self.remembered:
            self.before = dict(self)
            self.clear()
        return self.whole(text) if _ODD.search(text) else b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=1)
def _encoder(tokenizer_file: str) -> WordEncoder:
    """Kept for all tasks of a Python worker; what it remembers changes no result."""
    return WordEncoder(tokenizer_file)


def difference(sizes: list[int], windows: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each item, sums of the windows) by the largest differencing method.

    A partial partition is a row of sums, fullest first and less the emptiest's,
    with a group number for each window. A merge notes which two groups each new
    one is made of; at the end the windows are followed down to their items.
    """
    n = len(sizes)
    serial, parts, joined = count(), [], []
    for item, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        groups = np.full(windows, -1)
        groups[0] = item
        parts.append((-size, next(serial), sums, groups))
    heapq.heapify(parts)
    made = n
    while len(parts) > 1:
        (_, _, sums, groups), (_, _, other, added) = heapq.heappop(parts), heapq.heappop(parts)
        sums = sums + other[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        joined.append((made, groups[order], added[::-1][order]))
        heapq.heappush(parts, (int(sums[-1] - sums[0]), next(serial), sums - sums[-1], np.arange(made, made + windows)))
        made += windows
    window = np.full(made, -1)
    if parts:
        top = parts[0][3]
        window[top[top >= 0]] = np.flatnonzero(top >= 0)
    for first, left, right in reversed(joined):
        own = window[first : first + windows]
        window[left[left >= 0]] = own[left >= 0]
        window[right[right >= 0]] = own[right >= 0]
    return window[:n], np.bincount(window[:n], sizes, windows).astype(np.int64) if n else np.zeros(windows, np.int64)


#: A piece: (number of the document in the task, start, length).
Piece = tuple[int, int, int]


def windows_of(pieces: list[Piece], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Near-equal windows of the pieces (each below the capacity), none over it, by differencing.

    Their number starts at what the sum asks for. Whenever the fullest exceeds
    the capacity it rises, by as much as the excess asks for and by one at least.
    """
    sizes = [p[2] for p in pieces]
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window, sums = difference(sizes, k)
        if sums.max() <= capacity:
            break
        k = max(k + 1, k * int(sums.max()) // capacity)
    found: list[list[Piece]] = [[] for _ in range(k)]
    for piece, at in zip(pieces, window.tolist(), strict=True):
        found[at].append(piece)
    return [w for w in found if w]


def topped_up(windows: list[list[Piece]], capacity: int = CAPACITY) -> tuple[list[list[Piece]], list[Piece]]:
    """(full windows, pieces left over, less than a window): the emptiest windows are cut up to fill the fullest."""
    order = sorted(windows, key=lambda w: (-sum(p[2] for p in w), w))
    total = sum(p[2] for w in order for p in w)
    full, rest = order[: total // capacity], [p for w in order[total // capacity :] for p in w]
    done = []
    for window in full:
        more, rest = _taken(rest, capacity - sum(p[2] for p in window))
        done.append([*window, *more])
    return done, rest


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces cut into sequences of lengths that are powers of two, longest first."""
    total, waiting, sequences = sum(p[2] for p in pieces), list(pieces), []
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            sequence, waiting = _taken(waiting, 1 << bit)
            sequences.append(sequence)
    return sequences


def _taken(pieces: list[Piece], tokens: int) -> tuple[list[Piece], list[Piece]]:
    """(pieces of so many tokens, what is left), cutting the last."""
    taken, rest = [], list(pieces)
    while tokens:
        doc, start, length = rest.pop()
        part = min(tokens, length)
        taken.append((doc, start, part))
        if part < length:
            rest.append((doc, start + part, length - part))
        tokens -= part
    return taken, rest


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, batch: int = BATCH) -> DataFrame:
    """The pieces: id, start and length in the document's ids, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and offset in the sequence.

    capacity is a power of two. Sequences hold capacity ids, or a power of two.
    """
    out = schema(docs.select(id_col), [id_col], ADDED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fields, encoder = arrow_schema(out), _encoder(tokenizer_file)
        numbers = count(TaskContext.get().partitionId() << 33)
        end = np.array([end_id], "<u4").tobytes()
        ids: dict[int, tuple[object, bytes]] = {}  # document number -> (key, ids), as long as a piece of it waits

        def emit(sequences: Iterable[list[Piece]]) -> pa.RecordBatch:
            rows = []
            for sequence in sequences:
                number, offset = next(numbers), 0
                for doc, start, length in sequence:
                    key, raw = ids[doc]
                    rows.append((key, start, length, raw[4 * start : 4 * (start + length)], len(raw) // 4, number, offset))
                    offset += length
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], fields.field(i).type) for i in range(len(fields))], schema=fields)

        serial, waiting, new, tokens = count(), [], 0, 0
        for part in slices(batches, 64):
            whole = []
            for key, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                doc, raw = next(serial), encoder.encode(raw or "") + end
                ids[doc], length = (key, raw), len(raw) // 4
                cut = length // capacity * capacity
                whole += [[(doc, at, capacity)] for at in range(0, cut, capacity)]
                if cut < length:
                    waiting.append((doc, cut, length - cut))
                new, tokens = new + 1, tokens + length
            if whole:
                yield emit(whole)
            if new >= batch or tokens >= BATCH_TOKENS:
                full, waiting = topped_up(windows_of(waiting, capacity), capacity)
                yield emit(full)
                held = {p[0] for p in waiting}
                ids, new, tokens = {d: x for d, x in ids.items() if d in held}, 0, 0
        full, waiting = topped_up(windows_of(waiting, capacity), capacity)
        yield emit(full)
        yield emit(powers_of_two(waiting))

    return docs.select(id_col, text_col).mapInArrow(run, out)
