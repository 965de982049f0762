"""Line dedup: later copies of repeated line runs are deleted. DataFrame functions only.

The documents' lines, by id and place, are one long sequence of line ids; a run
never crosses documents. Prefix doubling sorts the suffixes of that sequence:
in round k each place gets the rank of its next 2^k lines, by sorting the pairs
(rank of the first half, rank of the second half) that occur more than once. A
place whose 2^k lines occur nowhere else is settled and leaves, so rounds shrink
to what really repeats. Places of one rank are an interval of the suffix array
whose longest common prefix is 2^k lines at least.

Then the intervals are followed from the longest prefixes down, as in a binary
search: a place goes from an interval (its first place and its length) into the
deeper one that also holds an earlier place, and the first place of each such
interval stays visible in it. What remains is, for every place, the longest run
that occurs earlier as well. Of these the ones that no run to the left contains
are maximal; those with at least `min_words` words are deleted.

Shuffles deal by place or by pair of ranks. A very frequent line or run is
counted in the map tasks, and AQE splits the join that brings its rank back.

Defined cases: a null text stays null and has no lines; the text between line
breaks is a line, so empty ones count as lines without words. Documents are
ordered by id (nulls last), then by text hash; rows alike in both are one
document and lose the same lines. All columns of the input are kept, whatever
their names. A document may end up with an empty text, and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import fresh
from runledger.session import stage

#: Words (between white space) from which a repeated run is deleted.
MIN_WORDS = 50
#: A place: the document (whether its id is null, id, hash) and the number of the line.
DOC, PLACE = ["none", "id", "hash"], ["none", "id", "hash", "line"]


def _document(docs: DataFrame, id_col: str, text_col: str) -> list:
    """The document's key, without nulls: a null id is told by `none` and by the hash."""
    none = F.col(id_col).isNull()
    return [none.alias("none"), F.coalesce(F.col(id_col), F.lit(0).cast(docs.schema[id_col].dataType)).alias("id"), F.xxhash64(none, F.col(text_col)).alias("hash")]


def _ranked(counted: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once, with ranks that follow their order. Written, so that ranks stay as they are."""
    repeated = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys)
    return stage(repeated.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def prefix_ranks(lines: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: the places whose next 2^k lines occur elsewhere too, with the rank of those lines.

    lines: none, id, hash, line, words, a, b (two hashes of the line, 128 bits
    together). The first table has words too.
    """
    names = _ranked(lines, ["a", "b"])
    levels = [stage(lines.join(names, ["a", "b"]).select(*PLACE, "words", "rank").distinct(), "level")]
    while not levels[-1].isEmpty():
        step = 1 << (len(levels) - 1)
        here = levels[-1].select(*PLACE, F.col("rank").alias("first"))
        ahead = levels[-1].select(*DOC, (F.col("line") - step).alias("line"), F.col("rank").alias("second"))
        pairs = stage(here.join(ahead, PLACE), "pairs")
        levels.append(stage(pairs.join(_ranked(pairs, ["first", "second"]), ["first", "second"]).select(*PLACE, "rank"), "level"))
    return levels[:-1]


def earlier_runs(levels: list[DataFrame]) -> DataFrame | None:
    """none, id, hash, line, length: each place and the longest run from it that also starts at an earlier place.

    A state is an interval of the suffix array, named by the first place that
    has it (`at`) and its length. Places in no state yet are in the whole array.
    """
    place = F.struct(*PLACE)
    state = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        whole = F.lit(None).cast(level.select(place.alias("p")).schema["p"].dataType)
        if state is None:
            tested = level.select(place.alias("p"), whole.alias("at"), F.lit(0).alias("length"), "rank")
        else:
            entered = state.filter("NOT witness").select("p.*").select(*PLACE)
            outside = level.join(entered, PLACE, "left_anti").select(place.alias("p"), whole.alias("at"), F.lit(0).alias("length"), "rank")
            inside = state.select("p", "at", "length", F.col("p.none").alias("none"), F.col("p.id").alias("id"), F.col("p.hash").alias("hash"), (F.col("p.line") + F.col("length")).alias("line"))
            tested = outside.unionByName(inside.join(level.select(*PLACE, "rank"), PLACE).select("p", "at", "length", "rank"))
        tested = stage(tested.withColumn("key", F.xxhash64("at.hash", "at.id", "at.line", "at.none")), "tested")
        deeper = stage(tested.groupBy("key", "at", "length", "rank").agg(F.min("p").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "intervals")
        if deeper.isEmpty():
            continue
        same = tested["key"].eqNullSafe(deeper["key"]) & tested["at"].eqNullSafe(deeper["at"]) & (tested["length"] == deeper["length"]) & (tested["rank"] == deeper["rank"])
        moved = tested.join(deeper, same).filter(tested["p"] != deeper["first"]).select(tested["p"], tested["at"].alias("was_at"), tested["length"].alias("was"), deeper["first"].alias("at"), (tested["length"] + (1 << k)).alias("length"))
        moved = stage(moved, "moved")
        seen = deeper.select(F.col("first").alias("p"), F.col("first").alias("at"), (F.col("length") + (1 << k)).alias("length"), F.lit(True).alias("witness"))
        arrived = moved.select("p", "at", "length", F.lit(False).alias("witness"))
        if state is not None:
            # A place that moved on leaves the state it was in.
            left = moved.filter("was > 0").select(F.col("p").alias("gone"), F.col("was_at").alias("gone_at"), F.col("was").alias("gone_length"))
            stayed = state.join(left, (state["p"] == left["gone"]) & (state["at"] == left["gone_at"]) & (state["length"] == left["gone_length"]), "left_anti")
            arrived = stayed.unionByName(arrived)
        state = stage(arrived.unionByName(seen).distinct(), "state")
    return None if state is None else state.filter("NOT witness").select("p.*", "length")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """none, id, hash, start, end: the maximal runs (start, end excluded) of at least min_words words that occur at an earlier place too."""
    key = _document(docs, id_col, text_col)
    split = docs.select(*key, F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "text"))
    hashed = split.select(*PLACE, F.regexp_count("text", F.lit(r"\S+")).alias("words"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    levels = prefix_ranks(stage(hashed, "lines"))
    nothing = docs.select(*key).limit(0).withColumns({"start": F.lit(0), "end": F.lit(0)})
    runs = earlier_runs(levels) if levels else None
    if runs is None:
        return nothing
    in_document = Window.partitionBy(*DOC).orderBy("line")
    counted = stage(levels[0].select(*PLACE, "words", F.sum("words").over(in_document).alias("so_far")), "words")
    placed = stage(runs.join(counted, PLACE), "runs")
    before = (F.lag("line").over(in_document) == F.col("line") - 1) & (F.lag("length").over(in_document) == F.col("length") + 1)
    maximal = placed.withColumn("inner", F.coalesce(before, F.lit(False))).filter("NOT inner")
    ends = counted.select(*DOC, F.col("line").alias("last"), F.col("so_far").alias("at_last"))
    spans = maximal.withColumn("last", F.col("line") + F.col("length") - 1).join(ends, [*DOC, "last"])
    return spans.filter(F.col("at_last") - F.col("so_far") + F.col("words") >= min_words).select(*DOC, F.col("line").alias("start"), (F.col("last") + 1).alias("end"))


def drop_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, removed_col: str | None = None) -> DataFrame:
    """docs with later copies of repeated runs deleted from the text; removed_col, if named, counts the lines deleted."""
    runs = repeated_runs(docs, id_col, text_col, min_words)
    # Overlapping runs become one cut.
    ordered = Window.partitionBy(*DOC).orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.withColumn("opens", (reach.isNull() | (F.col("start") > reach)).cast("int")).withColumn("cut", F.sum("opens").over(ordered))
    cuts = islands.groupBy(*DOC, "cut").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    names = fresh(docs.columns, "cuts_", "none_", "id_", "hash_")
    cuts_col, *doc_cols = names
    cuts = cuts.groupBy(*(F.col(c).alias(n) for c, n in zip(DOC, doc_cols, strict=True))).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cuts_col))
    cuts = stage(cuts, "cuts")

    keyed = docs.select("*", *(c.alias(n) for c, n in zip(_document(docs, id_col, text_col), (f"{n}key" for n in doc_cols), strict=True)))
    same = [keyed[f"{n}key"] == cuts[n] for n in doc_cols]
    joined = keyed.join(cuts.hint("shuffle_hash"), same[0] & same[1] & same[2], "left")
    here = F.col(cuts_col)

    def kept(lines):
        """What lies between the cuts, joined again. The lines are split once, for all cuts."""
        part = lambda i: F.slice(
            lines,
            F.when(i == 0, 0).otherwise(F.get(here, i - 1)["end"]) + 1,
            F.when(i == F.size(here), F.size(lines)).otherwise(F.get(here, i)["start"]) - F.when(i == 0, 0).otherwise(F.get(here, i - 1)["end"]),
        )
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(here)), part)), "\n")

    cleaned = F.when(here.isNull(), F.col(text_col)).otherwise(F.get(F.transform(F.array(F.split(F.col(text_col), "\n")), kept), F.lit(0)))
    removed = F.coalesce(F.aggregate(here, F.lit(0), lambda n, c: n + c["end"] - c["start"]), F.lit(0)).cast("long")
    out = [cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*out, *([removed.alias(removed_col)] if removed_col else []))
