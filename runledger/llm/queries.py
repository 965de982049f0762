"""The operators over the given tables, with production parameters, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import byte_bpe, edit_fingerprints, graph_ann, licenses, line_dedup, merkle_manifest, packing, periodic_runs, prefix_free_parse, quality, simhash_dedup, tool_calls, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def rank_file(name: str) -> str:
    """A vocabulary file of the public tokenizers package; it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(read(spark, folder, "documents"))
    base = F.filter("hits", lambda h: h["kind"] == "base")
    words = F.transform(base, lambda h: h["word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        licenses.labels(F.col("hits"), "base").alias("base_labels"), licenses.labels(F.col("hits")).alias("labels"), licenses.score(F.col("hits")).alias("score"),
        F.to_json("expressions").alias("expressions"),
    )


@query
def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filter.filter_urls(read(spark, folder, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("strict_terms", ",").alias("strict_terms"), F.array_join("soft_terms", ",").alias("soft_terms"), "soft_weight")


def _url_sql() -> str:
    """The same judgement as SQL text, written from the operator's parameters."""
    fits = "CASE " + " ".join(
        f"WHEN (host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}') THEN '{rule}'"
        for rule in sorted(url_filter.RULES, key=len, reverse=True)
    ) + " END"
    verdict_of = "CASE rule " + " ".join(f"WHEN '{rule}' THEN '{verdict}'" for rule, verdict in url_filter.RULES.items()) + " END"
    has = lambda term: f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"
    found = lambda terms: "concat_ws(',', " + ", ".join(f"CASE WHEN {has(t)} THEN '{t}' END" for t in sorted(terms)) + ")"
    many = lambda terms: " + ".join(f"CASE WHEN {has(t)} THEN 1 ELSE 0 END" for t in sorted(terms))
    weight = " + ".join(f"CASE WHEN {has(t)} THEN {w} ELSE 0.0 END" for t, w in sorted(url_filter.SOFT.items()))
    lower = lambda text: f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        WITH cut AS (
            SELECT page_id, coalesce({lower('url')}, '') AS low, CASE WHEN contains(url, '://') THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#].*$', '', 's') ELSE '' END AS rest FROM pages
        ), split AS (
            SELECT page_id, low, {lower("split_part(rest, '/', 1)")} AS host, CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM cut
        ), judged AS (
            SELECT page_id, host, path, {fits} AS rule, {found(url_filter.STRICT)} AS strict_terms, {found(url_filter.SOFT)} AS soft_terms, {many(url_filter.STRICT)} AS n_strict, {many(url_filter.SOFT)} AS n_soft, CAST({weight} AS DOUBLE) AS soft_weight FROM split
        )
        SELECT page_id, host, path, rule,
            coalesce({verdict_of}, CASE WHEN n_strict > 0 OR (n_soft >= {url_filter.LEAST_TERMS} AND soft_weight >= {url_filter.LEAST_WEIGHT}) THEN 'block' ELSE 'allow' END) AS verdict,
            strict_terms, soft_terms, soft_weight
        FROM judged
    """


ORACLES["op2_url_filter"] = _url_sql()


@query
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_runs(docs, removed_col="lines_removed")


@query
def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    coded = byte_bpe.round_trip(read(spark, folder, "documents"), rank_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_edit_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edit_fingerprints.edit_classes(read(spark, folder, "documents"))


#: Tools of the chat tables: each turn of a user, of the system or without a role is a call, whose text is an argument.
CHAT_SCHEMAS = {
    "user": {"text": ("string", True), "turn": ("integer", True), "words": ("integer", False)},
    "system": {"text": ("string", True), "turn": ("integer", True)},
}


@query
def op6_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), turn)
    is_result = F.coalesce(F.col("role").isin("assistant", "tool"), F.lit(False))
    calls = turns.filter(~is_result).select(
        F.col("conv_id").alias("conversation"), F.col("turn").alias("position"), name(F.col("turn")).alias("call"), F.coalesce("role", F.lit("message")).alias("name"),
        F.to_json(F.struct("text", "turn", F.when(F.col("role") == "user", F.size(F.split("text", " "))).alias("words"))).alias("arguments"),
        F.array(name(F.col("turn") - 1), name(F.col("turn") - 2)).alias("after"),
    )
    results = turns.filter(is_result).select(F.col("conv_id").alias("conversation"), F.col("turn").alias("position"), name(F.col("turn") - 1).alias("call"), F.col("text").alias("content"))
    linked = tool_calls.link_calls(calls, results, CHAT_SCHEMAS)
    return linked.select("conversation", "position", "call", "depth", "status", F.array_join("errors", "; ").alias("errors"), "repeats", "results", "json")


@query
def op7_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    found = graph_ann.search(graph_ann.build_index(vectors), vectors.filter(F.col("vec_id") % 100 == 0))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id", "documents")


@query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(read(spark, folder, "documents"), rank_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.classify(read(spark, folder, "documents"), read(spark, folder, "labels"), keep=["doc_id", "source", "lang"])
    return judged.select("doc_id", "source", "lang", f"{judged.columns[-1]}.*")


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    altered = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    docs = docs.withColumn("claimed", merkle_manifest.leaf("doc_id", "source", "lang", altered, "text"))
    found = merkle_manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], keep=["claimed"])
    siblings = F.array_join(F.transform("proof", lambda step: F.concat(step["before"], step["behind"])), "")
    folded = found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        merkle_manifest.folded(F.col("kept.claimed"), F.col("proof")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def _manifest_sql() -> str:
    """The trees level by level: nodes, then each leaf's walk up, first in its language, then among the subroots."""
    field = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    leaf = lambda n_chars: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"
    crc = "list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c))), lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END))"

    def nodes(name: str, start: str) -> str:
        return f"""{name} AS (SELECT tree, 0 AS level, number, n, digest FROM {start} UNION ALL
            SELECT tree, level + 1, number // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY number)) FROM {name} WHERE n > 1 GROUP BY tree, level, number // 2, n)"""

    def walk(name: str, start: str, nodes: str) -> str:
        return f"""{name} AS (SELECT doc_id, tree, 0 AS level, number, n, folded, proof FROM {start} UNION ALL
            SELECT w.doc_id, w.tree, w.level + 1, w.number // 2, (w.n + 1) // 2,
                CASE WHEN s.digest IS NULL THEN sha256(w.folded) WHEN w.number % 2 = 0 THEN sha256(w.folded || s.digest) ELSE sha256(s.digest || w.folded) END, w.proof || coalesce(s.digest, '')
            FROM {name} w LEFT JOIN {nodes} s ON s.tree = w.tree AND s.level = w.level AND s.number = xor(w.number, 1) WHERE w.n > 1)"""

    return f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE ':' || lang END AS tree, {leaf("n_chars")} AS digest, {leaf("(n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END)")} AS folded, '' AS proof
            FROM (SELECT *, xor({crc}, 4294967295) AS crc FROM documents)
        ), placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS number, COUNT(*) OVER (PARTITION BY tree) AS n FROM leaves),
        {nodes("lower_nodes", "placed")}, {walk("lower_walk", "placed", "lower_nodes")},
        subroots AS (SELECT tree AS lang, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS number, COUNT(*) OVER () AS n, '' AS tree FROM lower_nodes WHERE n = 1),
        {nodes("upper_nodes", "subroots")},
        halfway AS (SELECT w.doc_id, s.tree, s.number, s.n, w.folded, w.proof FROM lower_walk w JOIN subroots s ON s.lang = w.tree WHERE w.n = 1),
        {walk("upper_walk", "halfway", "upper_nodes")}
        SELECT p.doc_id, p.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = r.digest AS verified
        FROM placed p JOIN subroots s ON s.lang = p.tree JOIN upper_walk w ON w.doc_id = p.doc_id AND w.n = 1, (SELECT digest FROM upper_nodes WHERE n = 1) r
    """


ORACLES["op11_merkle_manifest"] = _manifest_sql()


@query
def op12_prefix_free_parse(spark: SparkSession, folder: str) -> DataFrame:
    found = prefix_free_parse.drop_repeats(read(spark, folder, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, by the id's checksum, the words from some place on repeat a few of them."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    draw = F.floor(checksum / 10)

    def repeated(words):
        n = F.size(words).cast("long")
        first = F.pmod(draw, n)
        period = F.lit(1).cast("long") + F.floor((n - first) / (F.lit(3) + F.pmod(draw, F.lit(8))))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < first, w).otherwise(F.get(words, (first + F.pmod(i - first, period)).cast("int")))), " ")

    # The words are split once, as the element of an array.
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    altered = F.get(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, repeated(ws))), F.lit(0))
    chosen = F.coalesce(F.pmod(checksum, F.lit(10)) == 0, F.lit(False))
    return docs.select("doc_id", F.when(chosen, altered).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted_runs(read(spark, folder, "documents")))
    best = periodic_runs.longest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
