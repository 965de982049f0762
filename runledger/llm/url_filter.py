"""URL filters: a weighted vocabulary found by Aho-Corasick with boundary checks, under host and path rules.

A url is rejected on one strict term, or when its distinct soft terms are
several and weigh enough together. A term counts only between boundaries: no
letter or digit stands beside it. A rule of the lists comes before the
vocabulary; the longest fitting rule wins.

Defined cases: a null url, or one without "://", has an empty host and path, no
rule, and is judged by its vocabulary (null: allow). Null or repeated ids pass,
one row per input row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from runledger.llm.common import arrow_schema, schema, slices

#: The rules (host and path), and what they say.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: One of these rejects a url.
STRICT = ("adult", "casino", "porn", "pills", "xxx")
#: Soft terms and their weights.
SOFT = {"ads": 1.0, "bets": 1.0, "cheap": 1.0, "click": 0.5, "farm": 0.5, "free": 1.0, "spam": 1.5, "track": 1.0, "win": 1.0}
#: So many distinct soft terms, and so much weight, reject a url.
LEAST_TERMS, LEAST_WEIGHT = 2, 1.5
ADDED = "host string, path string, rule string, verdict string, strict_terms array<string>, soft_terms array<string>, soft_weight double"
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str) -> tuple[str, str]:
    """(host in lower case, path), both empty without "://"."""
    before, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    path_end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:path_end]
    host, slash, path = rest.partition("/")
    return host.translate(ASCII_LOWER), slash + path


class Judge:
    """Rules by host and the automaton; built once in each task."""

    def __init__(self, rules: dict[str, str], strict: tuple[str, ...], soft: dict[str, float]) -> None:
        import ahocorasick

        self.rules: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules.items():
            host, slash, path = rule.partition("/")
            self.rules.setdefault(host, []).append((slash + path, rule, verdict))
        self.soft, self.terms = soft, ahocorasick.Automaton()
        for term in (*strict, *soft):
            self.terms.add_word(term, (term, term in strict))
        self.strict_any = bool(strict or soft)
        if self.strict_any:
            self.terms.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule whose host is this one or a parent of it and whose path begins this one."""
        best = None
        while host:
            for start, rule, verdict in self.rules.get(host, ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
            host = host.partition(".")[2]
        return best

    def __call__(self, url: str | None) -> tuple:
        url = url or ""
        host, path = split_url(url)
        lower, strict, soft = url.translate(ASCII_LOWER), set(), set()
        for end, (term, is_strict) in self.terms.iter(lower) if self.strict_any else ():
            start = end - len(term)
            if (start < 0 or lower[start] not in WORD) and (end + 1 == len(lower) or lower[end + 1] not in WORD):
                (strict if is_strict else soft).add(term)
        weight = sum(self.soft[term] for term in sorted(soft))
        found = self.rule(host, path)
        verdict = found[1] if found else "block" if strict or (len(soft) >= LEAST_TERMS and weight >= LEAST_WEIGHT) else "allow"
        return host, path, found[0] if found else None, verdict, sorted(strict), sorted(soft), float(weight)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] | None = None, strict: tuple[str, ...] = STRICT, soft: dict[str, float] | None = None) -> DataFrame:
    """Per row of pages: id, host, path, rule, verdict (allow or block), the terms found and the soft weight."""
    rules, soft = RULES if rules is None else rules, SOFT if soft is None else soft
    out = schema(pages.select(id_col), [id_col], ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, fields = Judge(rules, strict, soft), arrow_schema(out)
        for batch in slices(batches, 4096):
            rows = [judge(url) for url in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], fields.field(i + 1).type) for i in range(7))], schema=fields)

    return pages.select(id_col, url_col).mapInArrow(run, out)
