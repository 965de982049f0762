"""Periodic runs: stretches of words that repeat themselves, by maximal-pair enumeration.

A run of smallest period q from word s to e is the maximal pair (s, s + q): the
e - s - q words from both places are the same, the words before and behind them
differ. Pairs whose distance is at most a third of their length are exactly the
runs of at least four periods, each with the multiples of its period, so nothing
is extended: the least distance of a stretch is its period.

The suffixes of many documents' words are sorted at once by prefix doubling;
only places whose four words occur twice in their document take part beyond the
second round. Then the LCP-interval tree of each document is walked bottom-up.
An interval keeps its places in order, each in the class of the word to its
left, and a child is merged into it from the smaller side. Places so close that
the common words overlap three times are one progression: all but the first
have the same left word, and all but the last the same right word. So a place
has at most one partner of another class on each side, the farthest in reach,
and no list of a class has to be searched.

Each document is a row by itself: no shuffle. A task holds the words of about
`BATCH_WORDS` at a time, or of one document.

Defined cases: a null text has no words; texts are read whole; repeated rows and
null ids are rows like any other; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import arrow_schema, schema, slices

#: A run has at least MIN_WORDS words and TIMES periods.
MIN_WORDS, TIMES = 6, 4
#: Words whose suffixes a task sorts at once; a longer document is sorted alone.
BATCH_WORDS = 200_000
BLOCK = 1024
ADDED = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
Run = tuple[int, int, int]


class Places:
    """Word numbers in order, in blocks, so that a very long list takes insertions."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, place: int) -> None:
        self.blocks, self.tops, self.size = [[place]], [place], 1

    def add(self, place: int) -> None:
        at = min(bisect_left(self.tops, place), len(self.tops) - 1)
        block = self.blocks[at]
        block.insert(bisect_left(block, place), place)
        self.tops[at], self.size = block[-1], self.size + 1
        if len(block) > BLOCK:
            half = BLOCK // 2
            self.blocks[at : at + 1] = [block[:half], block[half:]]
            self.tops[at : at + 1] = [block[half - 1], block[-1]]

    def first_from(self, place: int) -> int:
        """The first number from place on; place + 2^62 if there is none."""
        at = bisect_left(self.tops, place)
        return self.blocks[at][bisect_left(self.blocks[at], place)] if at < len(self.tops) else place + (1 << 62)

    def last_to(self, place: int) -> int:
        """The last number up to place; -1 if there is none."""
        at = bisect_left(self.tops, place)
        if at < len(self.tops) and (i := bisect_right(self.blocks[at], place)):
            return self.blocks[at][i - 1]
        return self.tops[at - 1] if at else -1


def _pair_ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of the pairs, in their order; equal pairs have equal ranks: the number of pairs that are less."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return ranks


def repeated_suffixes(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, and the words that each shares with the place before it.

    ids: the words of documents one after the other; ends: for each word the end
    of its document. Only places whose four words occur twice in the document
    are returned; the first has no words in common with what is before it.
    """
    n = len(ids)
    every = np.arange(n)

    def ahead(rank: np.ndarray, places: np.ndarray, step: int) -> np.ndarray:
        """The rank `step` words later, -1 beyond the document."""
        inside = places + step < ends[places]
        return np.where(inside, rank[np.minimum(places + step, n - 1)], -1)

    def tied(rank: np.ndarray, places: np.ndarray) -> np.ndarray:
        _, where, counts = np.unique(rank[places], return_inverse=True, return_counts=True)
        return places[counts[where] > 1]

    rank = _pair_ranks(ends, ids)
    levels = [(every, rank)]
    rank = _pair_ranks(rank, ahead(rank, every, 1))
    levels.append((every, rank))
    rank = _pair_ranks(rank, ahead(rank, every, 2))
    active = taking_part = tied(rank, every)
    step = 4
    while len(active):
        levels.append((active, rank[active]))
        # Ranks are numbers of lesser places, so a group's ranks grow from its own without touching the next group's.
        here = rank[active]
        pairs = _pair_ranks(here, ahead(rank, active, step))
        order = np.argsort(here, kind="stable")
        opens = np.ones(len(order), bool)
        opens[1:] = here[order][1:] != here[order][:-1]
        group_start = np.empty(len(order), np.int64)
        group_start[order] = np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))
        rank = rank.copy()
        rank[active] = here + pairs - group_start
        active = tied(rank, active)
        step *= 2
    order = taking_part[np.argsort(rank[taking_part], kind="stable")]
    shared = np.zeros(max(len(order) - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        places, ranks = levels[k]
        dense = np.full(n, -1, np.int64)
        dense[places] = ranks
        i, j = order[:-1] + shared, order[1:] + shared
        inside = (i < ends[order[:-1]]) & (j < ends[order[1:]])
        a, b = dense[np.minimum(i, n - 1)], dense[np.minimum(j, n - 1)]
        shared += np.where(inside & (a == b) & (a >= 0), 1 << k, 0)
    return order, np.concatenate([np.zeros(min(len(order), 1), np.int64), shared])


def shortest_pair(least: int, times: int) -> int:
    """Words that the two places of a pair share at least."""
    return max(times - 1, -(-least * (times - 1) // times))


def maximal_pairs(order: list[int], shared: list[int], left: list[int], times: int = TIMES, least: int = MIN_WORDS) -> Iterator[tuple[int, int, int]]:
    """(i, j, l) with i < j: the l words from both are the same, not so the words before and behind; l is at least (times - 1)(j - i) and least - (j - i).

    left: for each place the class of the word before it, one of its own where there is none.
    """
    shortest = shortest_pair(least, times)
    found: list[tuple[int, int, int]] = []

    def merged(a: Places, b: Places, words: int) -> Places:
        small, large = (a, b) if a.size <= b.size else (b, a)
        reach = words // (times - 1)
        for block in small.blocks:
            for p in block:
                f, g = large.first_from(p - reach), large.last_to(p + reach)
                if f < p and left[f] != left[p] and words + p - f >= least:
                    found.append((f, p, words))
                if g > p and left[g] != left[p] and words + g - p >= least:
                    found.append((p, g, words))
        for block in small.blocks:
            for p in block:
                large.add(p)
        return large

    open_intervals: list[tuple[int, Places]] = []
    current: Places | None = None
    for place, words in zip([*order, -1], [*shared, 0], strict=True):
        while open_intervals and open_intervals[-1][0] >= words:
            depth, places = open_intervals.pop()
            current = merged(places, current, depth)
        if words >= shortest:
            open_intervals.append((words, current))
        current = Places(place)
        if found:
            yield from found
            found.clear()


def runs_of(documents: list[list[bytes]], least: int = MIN_WORDS, times: int = TIMES) -> list[list[Run]]:
    """For each document (its words) the runs (start, length, period), by start, then period."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for words in documents for w in words), np.int64)
    lengths = np.array([len(words) for words in documents], np.int64)
    stops = np.cumsum(lengths)
    ends = np.repeat(stops, lengths)
    runs: list[list[Run]] = [[] for _ in documents]
    if not len(ids):
        return runs
    order, shared = repeated_suffixes(ids, ends)
    starts = np.repeat(stops - lengths, lengths)
    left = np.empty(len(ids), np.int64)
    left[1:] = ids[:-1]
    at_start = starts == np.arange(len(ids))
    left[at_start] = -1
    periods: dict[tuple[int, int], int] = {}
    for i, j, words in maximal_pairs(order.tolist(), shared.tolist(), left.tolist(), times, least):
        stretch, period = (i, words + j - i), j - i
        periods[stretch] = min(period, periods.get(stretch, period))
    for (start, length), period in sorted(periods.items(), key=lambda x: (x[0][0], x[1])):
        doc = int(np.searchsorted(stops, start, "right"))
        runs[doc].append((start - int(stops[doc] - lengths[doc]), length, period))
    return runs


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words, joined by one space, without those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(kept).tolist())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS, times: int = TIMES, batch_words: int = BATCH_WORDS) -> DataFrame:
    """Per row of docs: the id, n_words, runs (start, length, period; by start, then period) and the collapsed text.

    Words stand between ASCII white space. times is at least four (below, a place
    may have several partners), and least so great that pairs share four words.
    """
    if times < 4 or shortest_pair(least, times) < 4:
        raise ValueError("shorter runs, or of fewer than four periods, need another enumeration")
    out = schema(docs.select(id_col), [id_col], ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = arrow_schema(out)

        def emit(keys: list, documents: list[list[bytes]]) -> pa.RecordBatch:
            found = runs_of(documents, least, times)
            texts = [collapsed(words, runs).decode() for words, runs in zip(documents, found, strict=True)]
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found]
            columns = [keys, [len(words) for words in documents], rows, texts]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

        keys, documents, words = [], [], 0
        for part in slices(batches, 64):
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                keys.append(key)
                documents.append((text or "").encode().split())
                words += len(documents[-1])
                if words >= batch_words:
                    yield emit(keys, documents)
                    keys, documents, words = [], [], 0
        yield emit(keys, documents)

    return docs.select(id_col, text_col).mapInArrow(run, out)


def longest(runs: Column) -> Column:
    """The run of greatest length; of several the first start, then the least period. Null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    return F.struct((-best["before"]).alias("start"), best["length"].alias("length"), (-best["less"]).alias("period"))
