"""Suffix-array dedup by prefix-free parsing: bytes of long strings that also start elsewhere are removed.

A rolling hash over `WINDOW` bytes is a trigger where it is a multiple of
`MODULUS`. A phrase runs from one trigger to the end of the next, so that what a
text is cut into depends on its bytes alone: equal strings hold the same
triggers, the same whole phrases between them, a suffix of a phrase in front and
a prefix of one behind. The dictionary is the distinct phrases, the parse a
document's sequence of them, and a string of `LENGTH` bytes has its place in the
corpus order by (suffix of its first phrase, parse behind it).

* Phrases that occur once split the parse: no string that occurs twice holds
  one whole. Only stretches of repeated phrases go on, about what really repeats.
* The dictionary's suffix order: the phrases around the borders of stretches are
  sorted, backwards in front of a phrase and forwards behind it. What a border
  phrase has in common with its neighbours in that order is the most that any
  string can take of it, which trims the stretches.
* The parse: all strings that begin in one phrase are told by that phrase and
  what follows it, so whole ranges of the corpus order are found equal at once.
* The order inside the few ranges that have no equal as a whole is found string
  by string, together with one copy of each range that begins with the same
  parse. Strings with fewer than two triggers, which hold no whole phrase, are
  found in the same way.

An interval of the corpus order whose strings have `LENGTH` bytes in common is
told by a 128-bit hash of the suffix and the parse instead of by its position:
the order between different intervals is never needed, and a hash deals out what
a sort would have to split.

Rows that repeat inside a task's batch are marked there, and one of them is sent
on for all, so a string that a third of all documents hold reaches the task of
its hash as one row for each batch. Documents are known by a 128-bit hash of their text; copies of a
text are parsed for themselves, and removed as a whole.

Defined cases: a null text is an empty one; matches never cross documents, and
texts below `LENGTH` bytes lose nothing; repeated rows are copies of each other;
null ids stay. Texts are read whole, as UTF-8 bytes; what is kept may begin or
end inside of a character, so it is binary. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.common import arrow_schema, slices
from runledger.session import stage

#: Bytes of a trigger (a power of two), the hash's modulus (about the bytes from one trigger to the next) and bytes of a string.
#: A string should hold about ten triggers: with fewer, more strings have no whole phrase; with more, there are more phrases.
WINDOW, MODULUS, LENGTH = 16, 40, 400
#: Bytes of text, and rows, of which a task looks for repeats at once; positions that are hashed at once.
BATCH_BYTES, BATCH_ROWS, CHUNK = 8 << 20, 200_000, 1 << 20
BASE, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
KEY = ["a", "b"]
#: A row that was seen once in its batch; one of several, dealt anywhere; and one for them all, dealt by its hash.
ONCE, KNOWN, WITNESS = 0, 1, 2


def triggers(data: bytes, window: int = WINDOW, modulus: int = MODULUS) -> np.ndarray:
    """Where triggers start."""
    codes, found = np.frombuffer(data, np.uint8), []
    for at in range(0, len(codes) - window + 1, CHUNK):
        hashed = codes[at : at + CHUNK + window - 1].astype(np.uint64)
        width = 1
        while width < window:
            hashed = hashed[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + hashed[width:]
            width *= 2
        hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(MIX)
        found.append(np.flatnonzero((hashed >> np.uint64(32)) % np.uint64(modulus) == 0) + at)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class Parse:
    """The phrases of a text: from one trigger to the end of the next. The first and the last lack a trigger."""

    def __init__(self, data: bytes, window: int, modulus: int) -> None:
        places = triggers(data, window, modulus).tolist()
        self.data, self.window = data, window
        self.starts, self.ends = [0, *places], [*(p + window for p in places), len(data)]

    def __len__(self) -> int:
        return len(self.starts)

    def phrase(self, t: int) -> bytes:
        return self.data[self.starts[t] : self.ends[t]]

    def stretches(self, repeated: Iterable[int], length: int) -> list[tuple[int, int]]:
        """(first, end) of the runs of repeated phrases that a string of this length fits into, with what is around them."""
        flags, found, n = np.zeros(len(self) + 2, np.int8), [], len(self.data)
        flags[np.fromiter(repeated, np.int64) + 1] = 1
        edges = np.diff(flags)
        for i, j in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            low, high = self.reach(i, j)
            if high - low >= length:
                found.append((i, j))
        return found

    def reach(self, i: int, j: int, before: int | None = None, behind: int | None = None) -> tuple[int, int]:
        """The bytes that strings of the stretch can cover: not the whole phrase around it, and no more of it than before and behind.

        A string without the border's trigger may still hold all but one byte of that.
        """
        low = self.starts[i - 1] + 1 if i > 1 else 0
        high = self.ends[j] - 1 if j < len(self) - 1 else len(self.data)
        if before is not None and i:
            low = max(low, self.ends[i - 1] - max(before, self.window - 1))
        if behind is not None and j < len(self):
            high = min(high, self.starts[j] + max(behind, self.window - 1))
        return low, high


def _hash64(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


def _columns(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[] for _ in fields], fields, strict=True)], schema=fields)


def _marked(hashes: np.ndarray, columns: list[np.ndarray], fields: pa.Schema, runs: bool) -> pa.RecordBatch:
    """Rows of hash, mark and columns. hashes: two longs a row.

    Rows that repeat here are dealt by their place, and one of them by its hash
    as well. runs: the columns are a, b, low, high and more; what repeats here
    from low to high and on from the next row is one row.
    """
    first, second = hashes[:, 0], hashes[:, 1]
    order = np.lexsort((second, first))
    same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
    known = np.zeros(len(order), bool)
    known[order[1:][same]] = True
    known[order[:-1][same]] = True
    opens = np.ones(len(order), bool)
    opens[1:] = ~same
    witnesses, repeats, single = order[opens & known[order]], np.flatnonzero(known), np.flatnonzero(~known)
    held = [c[repeats] for c in columns]
    if runs and len(repeats):
        text, low, high = held[:2], held[2], held[3]
        begins = np.ones(len(repeats), bool)
        begins[1:] = (text[0][1:] != text[0][:-1]) | (text[1][1:] != text[1][:-1]) | (low[1:] > high[:-1] + 1) | (low[1:] < low[:-1])
        at = np.flatnonzero(begins)
        held = [c[at] for c in held]
        held[3] = np.maximum.reduceat(high, at)
    spread = (np.arange(len(held[0]), dtype=np.uint64) * np.uint64(MIX)).view(np.int64) ^ (first[0] if len(first) else 0)
    dealt = [spread, spread ^ held[0]]
    values = [np.concatenate([h[single], d, h[witnesses]]) for h, d in zip((first, second), dealt, strict=True)]
    marks = np.repeat(np.array([ONCE, KNOWN, WITNESS], np.int8), [len(single), len(spread), len(witnesses)])
    arrays = [*values, marks, *(np.concatenate([c[single], h, c[witnesses]]) for c, h in zip(columns, held, strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(arrays, fields, strict=True)], schema=fields)


def _digests(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)


def _mapped(table: DataFrame, ddl: str, rows: Callable[[dict], Iterator[tuple]], marked: bool = False, runs: bool = False, once: bool = False) -> DataFrame:
    """rows(row) for every row of the table, batch by batch.

    marked: a row starts with a 16-byte hash, which becomes h1, h2 and mark; the
    rest are longs. runs: see _marked. once: only the first of the rows with a
    key in a task.
    """
    out = T.StructType.fromDDL(("h1 long, h2 long, mark tinyint, " if marked else "") + ddl)

    def emit(held: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
        if not marked or not held:
            return _columns(held, fields)
        raw, *rest = zip(*held, strict=True)
        return _marked(_digests(raw), [np.array(c, np.int64) for c in rest], fields, runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, held, size, seen = arrow_schema(out), [], 0, set()
        for part in slices(batches, 64):
            for row in part.to_pylist():
                if once:
                    if (row["a"], row["b"]) in seen:
                        continue
                    seen.add((row["a"], row["b"]))
                size += len(row.get("text") or "")
                for made in rows(row):
                    held.append(made)
                    if len(held) >= BATCH_ROWS:
                        yield emit(held, fields)
                        held, size = [], 0
                if size >= BATCH_BYTES:
                    yield emit(held, fields)
                    held, size = [], 0
        if held:
            yield emit(held, fields)

    return table.mapInArrow(run, out)


def _in_classes(rows: DataFrame, order: str) -> DataFrame:
    """rows with repeated (their hash occurs twice or more) and lead (one of the rows of a repeated hash, the same for each)."""
    by_hash = Window.partitionBy("h1", "h2")
    counted = rows.withColumns({"n": F.count(F.lit(1)).over(by_hash), "place": F.row_number().over(by_hash.orderBy(order))})
    repeated = (F.col("mark") != ONCE) | (F.col("n") > 1)
    return counted.withColumn("repeated", repeated).withColumn("lead", repeated & (F.col("place") == 1) & (F.col("mark") != KNOWN)).drop("n", "place", "h1", "h2", "mark")


def keyed(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    """a, b (a 128-bit hash of the text) and the text of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), text.alias("text"), *more)


def repeated_stretches(texts: DataFrame, window: int, modulus: int, length: int) -> DataFrame:
    """a, b, text and stretches of the texts that have any: phrases (first, end) that all occur at least twice in the corpus."""

    def phrases(row: dict) -> Iterator[tuple]:
        parse = Parse(row["text"].encode(), window, modulus)
        if len(parse.data) >= length:
            for t in range(len(parse)):
                yield _hash64(parse.phrase(t)).to_bytes(8, "little") + bytes(8), row["a"], t

    # Two texts alike in a only would share their numbers: some phrases more would count as repeated, which is no harm.
    marked = _mapped(texts, "a long, t int", phrases, marked=True)
    by_hash = Window.partitionBy("h1", "h2")
    counted = marked.withColumn("n", F.count(F.lit(1)).over(by_hash)).filter((F.col("mark") != ONCE) | (F.col("n") > 1))
    numbers = stage(counted.groupBy("a").agg(F.collect_set("t").alias("repeated")), "phrases")

    def stretches(row: dict) -> Iterator[tuple]:
        found = Parse(row["text"].encode(), window, modulus).stretches(row["repeated"], length)
        if found:
            yield row["a"], row["b"], row["text"], [{"first": i, "end": j} for i, j in found]

    joined = texts.join(numbers.hint("shuffle_hash"), "a")
    return stage(_mapped(joined, "a long, b long, text string, stretches array<struct<first:int,end:int>>", stretches, once=True), "stretches")


def border_reach(parsed: DataFrame, window: int, modulus: int, length: int) -> DataFrame:
    """a, b and borders: how much of the phrase in front of (side 0) and behind (side 1) a stretch any string can hold.

    Phrases in front of the same phrase are sorted backwards, phrases behind the
    same one forwards. At the ends of a sorted part the neighbour is unknown and
    the phrase isn't trimmed.
    """

    def around(row: dict) -> Iterator[tuple]:
        parse = Parse(row["text"].encode(), window, modulus)
        for s in row["stretches"]:
            i, j = s["first"], s["end"]
            names = {t: _hash64(parse.phrase(t)) - (1 << 63) for t in range(i, j)}
            for t in range(max(i, 1), min(j, len(parse) - 1)):
                front = parse.phrase(t - 1)[-length:][::-1]
                yield (0, names[t], front, *((row["a"], row["b"], i) if t == i else (None,) * 3))
                behind = parse.phrase(t + 1)[:length]
                yield (1, names[t], behind, *((row["a"], row["b"], i) if t + 1 == j else (None,) * 3))

    order = ["side", "y", "phrase"]
    sorted_phrases = _mapped(parsed, "side tinyint, y long, phrase binary, a long, b long, first int", around).repartitionByRange(*order).sortWithinPartitions(*order)
    out = T.StructType.fromDDL("a long, b long, first int, side tinyint, bytes int")

    def common(x: bytes, y: bytes) -> int:
        n = min(len(x), len(y))
        if x[:n] == y[:n]:
            return n
        differ = np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)
        return int(differ.argmax())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = arrow_schema(out)
        here, shared = None, length  # the row before, and what it has in common with its own neighbour before
        for part in slices(batches, 4096):
            rows = []
            for row in part.to_pylist():
                if here is not None:
                    same = (here["side"], here["y"]) == (row["side"], row["y"])
                    ahead = common(here["phrase"], row["phrase"]) if same else 0
                    if here["a"] is not None:
                        rows.append((here["a"], here["b"], here["first"], here["side"], max(shared, ahead)))
                    shared = ahead
                here = row
            yield _columns(rows, fields)
        if here is not None and here["a"] is not None:
            yield _columns([(here["a"], here["b"], here["first"], here["side"], length)], fields)

    borders = F.collect_set(F.struct("first", "side", "bytes")).alias("borders")
    return stage(sorted_phrases.mapInArrow(run, out).groupBy(*KEY).agg(borders), "borders")


def anchor_ranges(parsed: DataFrame, borders: DataFrame, copies: DataFrame, window: int, modulus: int, length: int) -> DataFrame:
    """a, b, low, high, y, repeated, lead: the strings that start from low to high all begin in one phrase; y is the phrase behind it.

    A range is repeated if the same strings start elsewhere as well. Ranges that
    are known to be may be joined, and their y means nothing unless they lead.
    """
    import xxhash

    def ranges(row: dict) -> Iterator[tuple]:
        parse, limits = Parse(row["text"].encode(), window, modulus), {}
        for x in row["borders"] or []:
            limits[x["first"], x["side"]] = x["bytes"]
        for s in row["stretches"]:
            i, j = s["first"], s["end"]
            least, most = parse.reach(i, j, limits.get((i, 0)), limits.get((i, 1)))
            for t in range(max(i, 1), min(j, len(parse) - 1)):
                # The strings whose first trigger ends phrase t - 1, so that phrase t is the first whole one.
                end = parse.ends[t - 1]
                low = max(parse.starts[t - 1] + (t > 1), least)
                high = min(end - window, most - length)
                if low <= high:
                    digest = xxhash.xxh3_128_digest(parse.data[low : high + length], seed=end - low)
                    made = digest, row["a"], row["b"], low, high, _hash64(parse.phrase(t)) - (1 << 63)
                    # A copied text is parsed once in a task; its ranges repeat all the same.
                    yield from (made,) * (2 if row["n"] else 1)

    joined = parsed.join(borders.hint("shuffle_hash"), KEY, "left").join(copies.select(*KEY, "n"), KEY, "left")
    marked = _mapped(joined, "a long, b long, low long, high long, y long", ranges, marked=True, runs=True)
    return stage(_in_classes(marked, "low"), "ranges")


def single_strings(texts: DataFrame, parsed: DataFrame, ranges: DataFrame, window: int, modulus: int, length: int) -> DataFrame:
    """a, b, low, high: the strings that start elsewhere too, of those with fewer than two triggers and of the ranges without an equal."""
    import xxhash

    digest = xxhash.xxh3_128_digest

    def sparse(row: dict) -> Iterator[tuple]:
        data = row["text"].encode()
        if len(data) < length:
            return
        places = triggers(data, window, modulus)
        last, done = len(data) - length, -1
        lows = np.concatenate([[0], places[:-1] + 1]) if len(places) else np.zeros(1, np.int64)
        highs = np.append(places[1:] - (length - window) - 1, last) if len(places) else np.array([last])
        for k in np.flatnonzero(lows <= highs).tolist():
            for at in range(max(int(lows[k]), done + 1), min(int(highs[k]), last) + 1):
                yield digest(data[at : at + length]), row["a"], row["b"], at, at
                done = at

    open_ranges = ranges.filter("NOT repeated")
    begins = stage(open_ranges.select("y").distinct(), "begins")
    partners = ranges.filter("lead").join(begins, "y", "left_semi")
    both = open_ranges.unionByName(partners.select(*open_ranges.columns))
    asked = stage(both.groupBy(*KEY).agg(F.collect_set(F.struct("low", "high")).alias("asked")), "asked")

    def singles(row: dict) -> Iterator[tuple]:
        data = row["text"].encode()
        for x in row["asked"]:
            for at in range(x["low"], x["high"] + 1):
                yield digest(data[at : at + length]), row["a"], row["b"], at, at

    ddl = "a long, b long, low long, high long"
    few = _mapped(texts, ddl, sparse, marked=True, runs=True)
    rest = _mapped(parsed.select(*KEY, "text").join(asked.hint("shuffle_hash"), KEY), ddl, singles, marked=True, runs=True)
    # Apart, since a range may hold strings with one trigger as well.
    found = [_in_classes(rows, "low").filter("repeated").select(*KEY, "low", "high") for rows in (few, rest)]
    return found[0].unionByName(found[1])


def repeated_spans(docs: DataFrame, text_col: str = "text", window: int = WINDOW, modulus: int = MODULUS, length: int = LENGTH) -> DataFrame:
    """a, b and covers (start, end; neither in order nor merged): the bytes of each text in strings that also start anywhere else."""
    if window & (window - 1) or window >= length:
        raise ValueError("window must be a power of two below length")
    texts = keyed(docs, text_col)
    counted = texts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).cast("long").alias("end"))
    copies = stage(counted.filter((F.col("n") > 1) & (F.col("end") >= length)), "copies")
    parsed = repeated_stretches(texts, window, modulus, length)
    ranges = anchor_ranges(parsed, border_reach(parsed, window, modulus, length), copies, window, modulus, length)
    singles = single_strings(texts, parsed, ranges, window, modulus, length)
    covers = [
        ranges.filter("repeated").select(*KEY, F.col("low").alias("start"), (F.col("high") + length).alias("end")),
        singles.select(*KEY, F.col("low").alias("start"), (F.col("high") + length).alias("end")),
        copies.select(*KEY, F.lit(0).cast("long").alias("start"), "end"),
    ]
    every = covers[0].unionByName(covers[1]).unionByName(covers[2])
    return stage(every.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("covers")), "covers")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, modulus: int = MODULUS, length: int = LENGTH) -> DataFrame:
    """Per row of docs: the id, n_bytes, removed (the maximal spans start, end that go) and kept (the other bytes, joined)."""
    covers = repeated_spans(docs, text_col, window, modulus, length)
    texts = keyed(docs, text_col, F.col(id_col).alias("id"))
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T.StructType.fromDDL("n_bytes long, removed array<struct<start:long,end:long>>, kept binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = arrow_schema(out)
        for part in slices(batches, 64):
            sizes, spans, kept = [], [], []
            for text, covered in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                data, merged = text.encode(), []
                for start, end in sorted((x["start"], x["end"]) for x in covered or []):
                    if merged and start <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], end)
                    else:
                        merged.append({"start": start, "end": end})
                edges = [0, *(x for span in merged for x in (span["start"], span["end"])), len(data)]
                sizes.append(len(data))
                spans.append(merged)
                kept.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip((sizes, spans, kept), list(fields)[1:], strict=True))], schema=fields)

    return texts.join(covers.hint("shuffle_hash"), KEY, "left").select("id", "text", "covers").mapInArrow(run, out)
