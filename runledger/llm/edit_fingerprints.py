"""Document fingerprints by a randomised edit embedding, bit-sampled banding and verification.

A walk goes over a text's characters. At each step it puts out the character it
stands on, then moves on or stays, as a random bit shared by all texts says
(one for each pair of step and character class). Two walks over texts that
differ by an insertion soon meet again, so edit distance becomes Hamming
distance between the walks.

A walk is as long as its text asks (about two steps a character), so the
fingerprint samples it: sample b takes the step whose shared random number is
smallest among the steps of the walk. Walks of unlike length thus sample mostly
the same steps. A sample is kept as one shared random bit of the character put
out there; two unrelated samples agree half the time, so the likeness is
1 - 2 * (differing share), at least 0.

Defined cases: a null text is an empty one, whose fingerprint is all zeros.
Documents are ordered by descending id (nulls last), then by the hash of their
text; the next one of the last is the first, and an only document's next is
itself. Repeated rows each count. Texts are walked whole. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import arrow_schema, fresh, schema, slices
from runledger.llm.simhash_dedup import components
from runledger.session import stage

#: Samples, and so bits, of a fingerprint.
BITS = 512
#: Classes of characters that share their random bits, and the steps after which the bits come back under other classes.
CLASSES, PERIOD = 64, 1 << 13
SEED = 20240229
#: Characters walked together in a task; bounds its memory.
CHUNK = 2_000_000
#: Bands, and the fingerprint bits sampled for each: a pair at LIKENESS shares a band with probability 0.987.
BANDS, BAND_BITS = 40, 14
#: Fingerprints at least this alike are near. It is a share of walk samples: see the README for the texts with known edits it was set by.
LIKENESS = 0.7
#: Bits of a band's word besides its number (band bits, then a sketch), and leading bytes of a fingerprint in its node's number.
WORD_BITS, SKETCH_BYTES = 56, 4
#: Likely pairs of a row in a bucket, above which it puts out itself; rows of a bucket, and of each block of a larger one, that are compared at once.
NEAR_ROWS, BUCKET_ROWS = 8, 4096
#: Rows of whole buckets that a task holds.
INDEX_ROWS = 200_000
ADDED = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


class Embedding:
    """The shared random numbers, built alike in every task."""

    def __init__(self, bits: int = BITS, seed: int = SEED) -> None:
        draw = np.random.default_rng(seed)
        self.bits = bits
        moves = draw.integers(0, 2, (CLASSES, PERIOD), dtype=np.int8)
        moves[:, -1] = 1  # no walk stays for a whole period
        # Steps from here to the first at which this class moves on, that one included.
        wait = np.empty((CLASSES, PERIOD), np.int64)
        wait[:, -1] = 1
        for step in range(PERIOD - 2, -1, -1):
            wait[:, step] = np.where(moves[:, step] == 1, 1, wait[:, step + 1] + 1)
        self.wait = wait.ravel()
        # Where each sample's smallest random number so far stands: the next such step after r is (r + 1) / u.
        records = [np.zeros(bits)]
        while records[-1].min() < 2**40:
            records.append(np.ceil((records[-1] + 1) / draw.random(bits)))
        self.records = np.minimum(np.array(records).T, 2**62).astype(np.int64)
        self.salt = draw.integers(1, 2**63, bits, dtype=np.uint64) | np.uint64(1)

    def walk(self, points: list[np.ndarray], start: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For each text (code points) and the step it starts at: the step at which each character is entered, and the last step."""
        order = sorted(range(len(points)), key=lambda i: -len(points[i]))
        lengths = np.array([len(points[i]) for i in order], np.int64)
        flat = np.concatenate([points[i] for i in order]) if len(order) else np.empty(0, np.uint32)
        klass = ((flat * np.uint32(2654435761)) >> np.uint32(26)).astype(np.int64) * PERIOD
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(order) else lengths
        entered, step = np.empty(len(flat), np.int64), start[order].astype(np.int64)
        alive = len(order)
        for i in range(int(lengths[0]) if len(order) else 0):
            while lengths[alive - 1] <= i:
                alive -= 1
            at, now = first[:alive] + i, step[:alive]
            entered[at] = now
            now += self.wait[klass[at] + (now & (PERIOD - 1))]
        steps, last = [None] * len(order), np.empty(len(order), np.int64)
        for place, i in enumerate(order):
            steps[i] = entered[first[place] : first[place] + lengths[place]]
            last[i] = step[place]
        return steps, last

    def sample(self, points: np.ndarray, entered: np.ndarray, last: int) -> np.ndarray:
        """The fingerprint's bits (one byte each)."""
        if not len(points):
            return np.zeros(self.bits, np.uint8)
        taken = self.records[np.arange(self.bits), (self.records < last).sum(axis=1) - 1]
        seen = points[np.searchsorted(entered, taken, "right") - 1].astype(np.uint64)
        mixed = (seen + np.uint64(1)) * self.salt
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed >> np.uint64(47)) & np.uint64(1)).astype(np.uint8)


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    return max(0.0, 1.0 - 2.0 * float(np.count_nonzero(left != right)) / len(left))


def _bytes(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Text:
    """A document on its way through a task."""

    __slots__ = ("bits", "entered", "key", "last", "points", "text")

    def __init__(self, key, text: str) -> None:
        self.key, self.text, self.points = key, text, code_points(text)


def _walked(embedding: Embedding, texts: list[Text]) -> None:
    steps, last = embedding.walk([t.points for t in texts], np.zeros(len(texts), np.int64))
    for t, entered, end in zip(texts, steps, last, strict=True):
        t.entered, t.last, t.bits = entered, int(end), embedding.sample(t.points, entered, int(end))


def _compared(embedding: Embedding, pairs: list[tuple[Text, Text]]) -> list[tuple]:
    """A result for each (document, next document), both walked. The edited text shares its beginning's walk."""
    cuts = [len(t.points) // 3 for t, _ in pairs]
    heads = [len(t.points) - cut for (t, _), cut in zip(pairs, cuts, strict=True)]
    tails = [following.points[:cut] for (_, following), cut in zip(pairs, cuts, strict=True)]
    starts = np.array([t.entered[head] if cut else t.last for (t, _), head, cut in zip(pairs, heads, cuts, strict=True)], np.int64)
    steps, ends = embedding.walk(tails, starts)
    rows = []
    for (t, following), cut, head, tail, entered, end in zip(pairs, cuts, heads, tails, steps, ends, strict=True):
        edited = t.text[:head] + following.text[:cut]
        bits = embedding.sample(np.concatenate([t.points[:head], tail]), np.concatenate([t.entered[:head], entered]), int(end))
        rows.append((t.key, len(t.points), hashlib.sha256(edited.encode()).digest(), _bytes(t.bits), _bytes(bits), likeness(t.bits, bits), likeness(t.bits, following.bits)))
    return rows


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, partitions: int | None = None) -> DataFrame:
    """Per row of docs: id, n_chars, the edited text's hash, both fingerprints (hex) and their likeness, and that to the next document's."""
    return _in_hex(_edits(docs, id_col, text_col, bits, partitions))


def edit_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, partitions: int | None = None) -> DataFrame:
    """The rows of fingerprint_edits and class_id: the smallest id among all rows linked with this one by near fingerprints."""
    edits = _edits(docs, id_col, text_col, bits, partitions)
    (of_class,) = fresh(edits.columns, "class_raw")
    found = shared_classes(edits.select(F.col(id_col).alias("id"), F.col("fingerprint").alias("raw")), bits)
    found = found.select(F.col("raw").alias(of_class), "class_id")
    # Only classes of several documents are looked up; any other row is a class of its own.
    joined = edits.join(found, F.col("fingerprint") == F.col(of_class), "left").drop(of_class)
    return _in_hex(joined.withColumn("class_id", F.coalesce("class_id", F.col(id_col))))


def _in_hex(edits: DataFrame) -> DataFrame:
    return edits.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def _edits(docs: DataFrame, id_col: str, text_col: str, bits: int, partitions: int | None) -> DataFrame:
    """The rows of fingerprint_edits, hash and fingerprints as bytes.

    The edited text has the last third replaced by the start of the next
    document. The texts are range-split by descending id once; a task meets its
    neighbours in order. Each task's first and last documents are set aside, and
    those few (two a task) are paired across tasks afterwards.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = schema(docs.select(id_col), [id_col], ADDED)
    wide = schema(docs.select(id_col), [id_col], f"{ADDED}, part int, role string, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        embedding, fields, part = Embedding(bits), arrow_schema(wide), TaskContext.get().partitionId()
        n = len(out.fields)

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], fields.field(i).type) for i in range(len(fields))], schema=fields)

        def aside(t: Text, role: str) -> tuple:
            return (t.key, *[None] * (n - 1), part, role, t.text)

        held: list[Text] = []
        began, size = False, 0
        for batch in slices(batches, 64):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = Text(key, text or "")
                if not began:
                    began = True
                    yield emit([aside(t, "first")])
                held.append(t)
                size += len(t.points) + 100
                if size >= CHUNK:
                    _walked(embedding, [x for x in held if not hasattr(x, "bits")])
                    yield emit([(*r, part, None, None) for r in _compared(embedding, list(zip(held, held[1:])))]) if len(held) > 1 else emit([])
                    held, size = held[-1:], 0
        if held:
            _walked(embedding, [x for x in held if not hasattr(x, "bits")])
            if len(held) > 1:
                yield emit([(*r, part, None, None) for r in _compared(embedding, list(zip(held, held[1:])))])
            yield emit([aside(held[-1], "last")])

    order = [F.col(id_col).desc_nulls_last(), F.xxhash64(text_col)]
    sorted_docs = docs.select(id_col, text_col).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    done = stage(sorted_docs.mapInArrow(run, wide), "fingerprints")

    # Two rows a task: who follows whom is found on part numbers alone.
    lasts = done.filter("role = 'last'").select("part", F.col(id_col).alias("key"), F.col("text").alias("last_text"))
    firsts = done.filter("role = 'first'").select("part", F.col("text").alias("first_text"))
    parts = firsts.select("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    seams = lasts.join(following, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("key", "last_text", "first_text")

    def seam(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedding, fields = Embedding(bits), arrow_schema(out)
        for batch in slices(batches, 16):
            pairs = [(Text(k, a), Text(None, b)) for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            _walked(embedding, [t for pair in pairs for t in pair])
            rows = _compared(embedding, pairs)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], fields.field(i).type) for i in range(len(fields))], schema=fields)

    return done.filter("role IS NULL").select(*out.names).unionByName(stage(seams.mapInArrow(seam, out), "seams"))


def near_classes(
    fingerprints: DataFrame, id_col: str = "doc_id", fingerprint_col: str = "fingerprint", bits: int = BITS, bands: int = BANDS, band_bits: int = BAND_BITS, least: float = LIKENESS,
) -> DataFrame:
    """Per row: id, class_id (the smallest id among all rows it is linked with, over any number of links) and documents of the class.

    Rows without a fingerprint are one class.
    """
    rows = fingerprints.select(F.col(id_col).alias("id"), F.unhex(fingerprint_col).alias("raw"))
    found = shared_classes(rows, bits, bands, band_bits, least).withColumnRenamed("raw", "class_raw")
    placed = rows.join(found, F.col("raw").eqNullSafe(F.col("class_raw")), "left")
    return placed.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("documents", F.lit(1).cast("long")).alias("documents"))


def _node(raw: Column, tried: int = 0) -> Column:
    """A fingerprint's number: its first 32 bits, which serve as a sketch, above 32 bits of its hash."""
    sketch = F.shiftleft(F.conv(F.hex(F.substring(raw, 1, SKETCH_BYTES)), 16, 10).cast("long"), 32)
    hashed = F.xxhash64(raw, F.lit(tried)) if tried else F.xxhash64(raw)
    return F.coalesce(sketch.bitwiseOR(hashed.bitwiseAND(F.lit((1 << 32) - 1))), hashed)


def _numbered(rows: DataFrame) -> DataFrame:
    """raw, least, n, node: the distinct fingerprints, each under a number that no other has.

    Those that share a number are numbered again by another hash, until none do.
    """
    nodes = stage(rows.groupBy("raw").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("node", _node(F.col("raw"))), "nodes")
    for tried in count(1):
        shared = stage(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("fingerprints")).filter("fingerprints > 1").select("node"), "shared-numbers")
        if shared.isEmpty():
            return nodes
        moved = nodes.join(shared, "node", "left_semi").withColumn("node", _node(F.col("raw"), tried))
        nodes = stage(nodes.join(shared, "node", "left_anti").unionByName(moved), "nodes")


def shared_classes(rows: DataFrame, bits: int = BITS, bands: int = BANDS, band_bits: int = BAND_BITS, least: float = LIKENESS, limit: int = BUCKET_ROWS) -> DataFrame:
    """(raw, class_id, documents) of every class with several documents. rows: id, raw (the fingerprint's bytes).

    Fingerprints are linked if a bit-sampled band agrees, so do enough of that
    band's sketch bits, and the whole fingerprints are verified to be at least
    `least` alike: whether two are linked depends on these two alone, not on how
    many rows there are. Equal ones are one node with a number of its own, so a
    group of copies has one row in each band. Such a row is two
    longs: a word (band, its sampled bits, a sketch of other bits) and the node,
    whose upper half is a sketch too. In a bucket the sketches choose the pairs
    that are worth verifying. A row with more than NEAR_ROWS of them, as in a
    group of near copies, puts out itself instead of its pairs: these few get
    their fingerprints at once, and each bucket of them puts out links to its
    components' roots, by the same sketches. A bucket over `limit` is cut into
    blocks of about `limit` rows; each two blocks are compared like a bucket, so
    no pair of it is left out and no task holds all of it.
    """
    draw = np.random.default_rng(SEED + 1)
    # Band bits first, then those of the sketch; the bits of the node's sketch aren't used again.
    picks = [draw.choice(np.arange(8 * SKETCH_BYTES, bits), WORD_BITS, replace=False) for _ in range(bands)]
    shift = WORD_BITS - band_bits
    sketched = shift + 8 * SKETCH_BYTES
    share = (1 - least) / 2
    allowed = sketched * share + 3 * (sketched * share * (1 - share)) ** 0.5
    nodes = _numbered(rows)

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            table = _unpacked(batch.column(1).to_pylist())
            for i, pick in enumerate(picks):
                words = np.ascontiguousarray(np.hstack([np.full((len(table), 1), i, np.uint8), np.packbits(table[:, pick], axis=1)]))
                yield pa.RecordBatch.from_arrays([pa.array(words.view(">i8").ravel().astype(np.int64)), batch.column(0)], names=["word", "node"])

    def chosen_rows(left: np.ndarray, right: np.ndarray, nodes_: np.ndarray, buckets: np.ndarray, kind: int) -> pa.RecordBatch:
        """Pairs (kind 0), then rows of their own: a node and its bucket (dense, kind 1) or its word (of a large bucket, kind 2)."""
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([np.minimum(left, right), nodes_])), pa.array(np.concatenate([np.maximum(left, right), buckets])),
            pa.array(np.repeat(np.array([0, kind], np.int32), [len(left), len(nodes_)])),
        ], names=["a", "b", "kind"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        passed = -1  # the large bucket whose first rows were passed on already

        def found(word: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
            bucket = word >> shift
            starts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
            sizes = np.diff(np.append(starts, len(bucket)))
            large = (np.repeat(sizes, sizes) > limit) | (bucket == passed)
            if large.any():
                yield chosen_rows(none, none, node[large], word[large], 2)
            word, node, bucket = word[~large], node[~large], bucket[~large]
            upper, sketch = node >> 32, word & ((1 << shift) - 1)
            at, left, right, step = np.arange(len(bucket)), [], [], 0
            while len(at):
                step += 1
                at = at[at + step < len(bucket)]
                at = at[bucket[at] == bucket[at + step]]
                other = at + step
                differ = np.bitwise_count(sketch[at] ^ sketch[other]).astype(np.int64) + np.bitwise_count((upper[at] ^ upper[other]) & 0xFFFFFFFF)
                close = differ <= allowed
                left.append(at[close])
                right.append(other[close])
            left, right = (np.concatenate(x) if x else none for x in (left, right))
            dense = np.bincount(left, minlength=len(bucket)) + np.bincount(right, minlength=len(bucket)) > NEAR_ROWS
            pairs = ~(dense[left] & dense[right])
            yield chosen_rows(node[left[pairs]], node[right[pairs]], node[dense], bucket[dense], 1)

        held_word, held = none, none
        for batch in batches:
            held_word, held = np.concatenate([held_word, batch.column(0).to_numpy()]), np.concatenate([held, batch.column(1).to_numpy()])
            if len(held) >= INDEX_ROWS:
                cut = int(np.searchsorted(held_word >> shift, held_word[-1] >> shift))
                if not cut and len(held) > limit:
                    passed, cut = int(held_word[-1] >> shift), len(held)
                if cut:
                    yield from found(held_word[:cut], held[:cut])
                    held_word, held = held_word[cut:], held[cut:]
        if len(held):
            yield from found(held_word, held)

    def choose_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same for two blocks of a large bucket (or one with itself)."""

        def found(unit: tuple, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            word, node, block = (np.concatenate([r.column(i).to_numpy() for r in rows]) for i in (3, 4, 5))
            upper, sketch = (node >> 32) & 0xFFFFFFFF, word & ((1 << shift) - 1)
            first, second = np.flatnonzero(block == unit[1]), np.flatnonzero(block == unit[2])
            close = np.empty((len(first), len(second)), bool)
            for i, at in enumerate(first):
                differ = np.bitwise_count(sketch[second] ^ sketch[at]).astype(np.int64) + np.bitwise_count(upper[second] ^ upper[at])
                close[i] = differ <= allowed
            if unit[1] == unit[2]:
                close = np.triu(close, 1)
            likely = np.zeros(len(node), np.int64)
            likely[first] += close.sum(axis=1)
            likely[second] += close.sum(axis=0)
            dense = likely > NEAR_ROWS
            left, right = np.nonzero(close & ~(dense[first][:, None] & dense[second]))
            left, right, alone = node[first[left]], node[second[right]], np.flatnonzero(dense)
            chosen = chosen_rows(left, right, node[alone], np.full(len(alone), unit[0]), 1)
            return pa.RecordBatch.from_arrays([*chosen.columns, *(pa.array(np.full(chosen.num_rows, x, np.int32)) for x in unit[1:])], names=["a", "b", "kind", "first", "second"])

        unit, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1) if batch.num_rows else np.empty((0, 3), np.int64)
            starts = np.flatnonzero((np.diff(keys, axis=0, prepend=-1 - keys[:1]) != 0).any(axis=1))
            for start, end in zip(starts, np.append(starts[1:], batch.num_rows)):
                now = tuple(int(x) for x in keys[start])
                if now != unit and held:
                    yield found(unit, held)
                    held = []
                unit = now
                held.append(batch.slice(start, end - start))
        if held:
            yield found(unit, held)

    known = nodes.filter("raw IS NOT NULL").select("node", "raw")
    bucket = F.shiftright("word", shift)
    banded = known.mapInArrow(band, "word long, node long").repartition(bucket).sortWithinPartitions("word")
    chosen = stage(banded.mapInArrow(choose, "a long, b long, kind int"), "candidates").withColumns({"first": F.lit(0), "second": F.lit(0)})
    large = chosen.filter("kind = 2").select(F.col("a").alias("node"), F.col("b").alias("word"), F.shiftright("b", shift).alias("bucket"))
    if not large.isEmpty():
        blocks = large.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(limit)).cast("int").alias("blocks"))
        placed = large.join(stage(blocks, "large-buckets"), "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        met = placed.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        units = met.select("bucket", F.least("block", "met").alias("first"), F.greatest("block", "met").alias("second"), "word", "node", "block")
        units = units.repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second")
        compared = stage(units.mapInArrow(choose_blocks, "a long, b long, kind int, first int, second int"), "candidates")
        chosen = chosen.filter("kind < 2").unionByName(compared)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                differ = (_unpacked(batch.column(2).to_pylist()) != _unpacked(batch.column(3).to_pylist())).sum(axis=1)
                near = pa.array(1.0 - 2.0 * differ / bits >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["f", "root"])

    pairs = chosen.filter("kind = 0").select("a", "b").distinct()
    pairs = pairs.join(known.select(F.col("node").alias("a"), F.col("raw").alias("raw_a")), "a").join(known.select(F.col("node").alias("b"), F.col("raw").alias("raw_b")), "b")
    links = pairs.select("a", "b", "raw_a", "raw_b").mapInArrow(verify, "f long, root long")
    dense = chosen.filter("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("bucket"), "first", "second")
    masks = []
    for pick in picks:
        mask = np.zeros(bits, np.uint8)
        mask[: 8 * SKETCH_BYTES] = mask[pick[band_bits:]] = 1
        masks.append(np.packbits(mask).view(np.uint64))
    links = links.unionByName(_star_links(dense.join(known, "node"), bits, least, masks, band_bits, allowed))
    linked = components(links).withColumnRenamed("f", "node")
    rooted = nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("documents")).filter("documents > 1")
    return stage(rooted.select("raw", "root").join(groups, "root").drop("root"), "classes")


def _unpacked(raw: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), axis=1)


def _star_links(rows: DataFrame, bits: int, least: float, masks: list[np.ndarray], band_bits: int, allowed: float) -> DataFrame:
    """(f, root): each linked node and its component's root in a bucket (or two blocks of it), verified. rows: node, bucket, first, second, raw.

    masks: for each band the bits of its sketch, of which `allowed` may differ.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(members: list[int], raw: list[bytes], mask: np.ndarray) -> pa.RecordBatch:
            table, root = np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), -1), np.arange(len(raw))
            for at in range(len(raw) - 1):
                others = at + 1 + np.flatnonzero(root[at + 1 :] != root[at])
                differ = table[others] ^ table[at]
                alike = 1.0 - 2.0 * np.bitwise_count(differ).sum(axis=1) / bits >= least
                near = others[alike & (np.bitwise_count(differ & mask).sum(axis=1) <= allowed)]
                if len(near):
                    joined = np.unique(np.append(root[near], root[at]))
                    root[np.isin(root, joined)] = joined[0]
            moved = np.flatnonzero(root != np.arange(len(raw)))
            names = np.array(members, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], names=["f", "root"])

        now, members, raw = None, [], []
        for batch in batches:
            for *key, node, bytes_ in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if key != now:
                    if len(members) > 1:
                        yield found(members, raw, masks[now[0] >> band_bits])
                    now, members, raw = key, [], []
                members.append(node)
                raw.append(bytes_)
        if len(members) > 1:
            yield found(members, raw, masks[now[0] >> band_bits])

    unit = ["bucket", "first", "second"]
    return rows.select(*unit, "node", "raw").repartition(*unit).sortWithinPartitions(*unit, "node").mapInArrow(verify, "f long, root long")
