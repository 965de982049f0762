"""License scans: Aho-Corasick finds identifier tags and notice phrases; a shunting-yard parser evaluates and/or/with expressions.

Defined cases: a null text is an empty one (no words, no hits, score 0); a null
or repeated id is passed on, one row per input row; very long texts are scanned
whole; extra columns are ignored, whatever their names; an empty table gives an
empty result. A tag whose expression can't be parsed gives the verdict
"invalid" and no label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import WORD_BYTES, arrow_schema, schema, slices

#: The base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases of well-known licences, and their labels.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "apache software license": "apache",
    "gnu gpl": "gpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "boost",
    "released into the public domain": "public-domain",
    "cc0": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "all rights reserved": "proprietary",
}
#: Identifier tags, lower case; the expression follows on the same line.
TAGS = ("spdx-license-identifier:", "license-expression:", "license:")
#: What a licence asks of its users, from least to most. An unknown licence counts as most.
LEVELS = ("permissive", "weak-copyleft", "copyleft", "restricted", "unknown")
LEVEL_OF = {
    "mit": 0, "apache": 0, "bsd": 0, "isc": 0, "boost": 0, "public-domain": 0, "cc0": 0, "cc-by": 0, "zlib": 0, "unlicense": 0,
    "lgpl": 1, "mpl": 1, "epl": 1, "gpl": 2, "agpl": 2, "cc-by-sa": 2, "cc-by-nc": 3, "cc-by-nd": 3, "proprietary": 3,
}
#: How much each kind of evidence adds to the score.
WEIGHTS = {"tag": 0.9, "base": 0.6, "notice": 0.5}
BINDS = {"or": 1, "and": 2, "with": 3}
ADDED = "n_words long, hits array<struct<kind:string,label:string,phrase:string,word:long>>, expressions array<struct<expression:string,labels:array<string>,verdict:string>>"


def label_of(identifier: str) -> str:
    """The family of a licence identifier: Apache-2.0 -> apache, GPL-3.0-or-later -> gpl, CC-BY-NC-4.0 -> cc-by-nc."""
    name = identifier.lower().rstrip("+")
    name = re.sub(r"-(only|or-later)$", "", name)
    name = re.sub(r"-v?[0-9][0-9.]*(-clause.*)?$", "", name)
    return {"bsl": "boost", "expat": "mit", "cc0": "cc0"}.get(name, name)


def evaluate(expression: str) -> tuple[list[str], str]:
    """(labels, verdict) of a licence expression by the shunting-yard algorithm.

    "with" binds tightest, then "and", then "or". Of an "or" the reader takes the
    mildest side, under an "and" the strictest holds; an exception after "with"
    turns copyleft into weak copyleft.
    """
    values: list[tuple[frozenset[str], int]] = []
    waiting: list[str] = []

    def apply(operator: str) -> None:
        right, left = values.pop(), values.pop()
        if operator == "with":
            values.append((left[0], 1 if left[1] == 2 else left[1]))
        else:
            values.append((left[0] | right[0], (max if operator == "and" else min)(left[1], right[1])))

    operand_next = True
    try:
        for token in re.findall(r"[()]|[^\s()]+", expression):
            word = token.lower()
            if word in BINDS:
                if operand_next:
                    raise ValueError("operator without a left side")
                while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[word]:
                    apply(waiting.pop())
                waiting.append(word)
                operand_next = True
            elif word == "(":
                if not operand_next:
                    raise ValueError("no operator before (")
                waiting.append(word)
            elif word == ")":
                if operand_next:
                    raise ValueError("nothing before )")
                while waiting[-1] != "(":
                    apply(waiting.pop())
                waiting.pop()
            else:
                if not operand_next:
                    raise ValueError("two identifiers without an operator")
                if waiting and waiting[-1] == "with":
                    values.append((frozenset(), 0))
                else:
                    label = label_of(word)
                    values.append((frozenset([label]), LEVEL_OF.get(label, 4)))
                operand_next = False
        if operand_next:
            raise ValueError("ends in an operator")
        while waiting:
            apply(waiting.pop())
    except (IndexError, ValueError):
        return [], "invalid"
    return (sorted(values[0][0]), LEVELS[values[0][1]]) if len(values) == 1 else ([], "invalid")


class Scanner:
    """The automata; built once in each task."""

    def __init__(self, base: dict[str, str], notices: dict[str, str]) -> None:
        import ahocorasick

        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        self.kinds: list[tuple[str, str, str]] = []
        for phrase in {**notices, **base}:
            # Words stand between single spaces, so a phrase with its spaces matches whole words only.
            self.phrases.add_word(f" {phrase} ".encode().decode("latin-1"), (phrase, len(phrase.encode()) + 1))
        self.base, self.notices = base, notices
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def scan(self, text: str) -> tuple[int, list, list]:
        words = text.encode().translate(WORD_BYTES).split()
        spaced = b" " + b" ".join(words) + b" "
        hits, word, counted = [], 0, 0
        found = [(end - length, phrase) for end, (phrase, length) in self.phrases.iter(spaced.decode("latin-1"))]
        for start, phrase in sorted(found):
            word, counted = word + spaced.count(b" ", counted, start), start
            for kind, labels in (("base", self.base), ("notice", self.notices)):
                if phrase in labels:
                    hits.append({"kind": kind, "label": labels[phrase], "phrase": phrase, "word": word})
        expressions = []
        if b"license" in spaced:
            expressions = self.expressions(text)
            hits += [{"kind": "tag", "label": label, "phrase": x["expression"], "word": None} for x in expressions for label in x["labels"]]
        return len(words), hits, expressions

    def expressions(self, text: str) -> list:
        """The expression after each tag, to the end of its line. Of tags that end at one place the longest counts."""
        lower = text.translate(ASCII_LOWER)
        ends = {}
        for end, tag in self.tags.iter(lower):
            start = end - len(tag) + 1
            if start and (lower[start - 1].isalnum() or lower[start - 1] in "-_"):
                continue
            ends[end] = max(ends.get(end, ""), tag, key=len)
        found = []
        for end in sorted(ends):
            line = text[end + 1 : stop if (stop := text.find("\n", end)) >= 0 else len(text)]
            expression = re.sub(r"\s*(\*/|-->)\s*$", "", line).strip().strip("\"'").rstrip(".,;")
            labels, verdict = evaluate(expression) if expression else ([], "invalid")
            found.append({"expression": expression, "labels": labels, "verdict": verdict})
        return found


ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """Per row of docs: the id, n_words, hits (kind, label, phrase, first word) and the evaluated expressions.

    One pass over the texts without a shuffle. Phrases are given in lower case
    with single spaces between their words.
    """
    base, notices = BASE_PHRASES if base is None else base, NOTICE_PHRASES if notices is None else notices
    out = schema(docs.select(id_col), [id_col], ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, fields = Scanner(base, notices), arrow_schema(out)
        for batch in slices(batches):
            rows = [scanner.scan(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], fields.field(i + 1).type) for i in range(3))], schema=fields)

    return docs.select(id_col, text_col).mapInArrow(run, out)


def score(hits: Column) -> Column:
    """1 minus the product of what each distinct (kind, label) leaves in doubt."""
    distinct = F.array_distinct(F.transform(hits, lambda h: F.struct(h["kind"].alias("kind"), h["label"].alias("label"))))
    weight = lambda x: F.create_map(*(F.lit(v) for kv in WEIGHTS.items() for v in kv))[x["kind"]]
    return F.lit(1.0) - F.aggregate(distinct, F.lit(1.0), lambda left, x: left * (F.lit(1.0) - weight(x)))


def labels(hits: Column, *kinds: str) -> Column:
    """The distinct labels of hits of these kinds (all, if none is named), sorted and joined by commas."""
    wanted = F.filter(hits, lambda h: h["kind"].isin(*kinds)) if kinds else hits
    return F.array_join(F.array_sort(F.array_distinct(F.transform(wanted, lambda h: h["label"]))), ",")
