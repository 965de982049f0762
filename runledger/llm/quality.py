"""Quality classifier: hierarchical empirical Bayes over sites and paths.

A logistic model of a document's shape gives its own evidence. All documents of
a site (host) and of a path below it then say how good that place is: the mean
quality of a place is shrunk toward that of its parent - path to host, host to
the global prior - by a Beta prior whose strength is fitted to how far places
of that level really differ. A document's verdict is its own evidence, with the
global prior replaced by its path's posterior.

Defined cases: a null text is an empty one. A null host or path is a place of
its own. A null, repeated or unknown document id passes through; labels with a
null id or a null class are ignored, and a label that is repeated counts each
time. Of the documents with a labelled id, the first by its text's hash is
fitted. Without labels of both classes the model says nothing (every document is
as good as the prior, 0.5) and all documents are kept. Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.common import arrow_schema, fresh, slices
from runledger.session import stage

#: Labelled documents that the model is fitted on at most; they are the first by a hash of their id.
FIT_ROWS = 20_000
#: Documents whose probability of good quality is below this are rejected.
THRESHOLD = 0.5
#: A place's evidence moves a document's log-odds by this much at most either way.
MOST_SHIFT = 2.0
#: Strengths of the Beta priors stay within these bounds.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0
FEATURES = ("log_words", "word_length", "upper", "digit", "punctuation", "symbol", "exclamation", "bar", "repeated_next", "distinct", "top_word", "spaces")
_UPPER, _DIGIT, _PUNCTUATION, _SYMBOL = (bytes(x, "ascii") for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-", "#$%&*+<=>@[\\]^_`{}~/"))


def features(text: str) -> list[float]:
    """The document's shape, each about 0 to 1 but for the first two."""
    raw = text.encode()
    words = raw.split()
    size, n = max(1, len(raw)), max(1, len(words))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    distinct = set(words)
    repeated = sum(map(eq, words, words[1:]))
    top = max(Counter(words).values()) if words else 1
    return [
        np.log1p(len(words)), size / n / 10, share(_UPPER), share(_DIGIT), share(_PUNCTUATION), share(_SYMBOL), raw.count(b"!") / n, raw.count(b"|") / n,
        repeated / n, len(distinct) / n, min(1.0, top / n), share(b" \t\n\r\x0b\x0c"),
    ]


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in texts], float).reshape(-1, len(FEATURES))


class Model:
    """Logistic regression on the features and their squares, fitted by Newton's method with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z, self.weights = self.expand(x), np.zeros(2 * x.shape[1] + 1)
        for _ in range(50):
            p = self.sigmoid(z @ self.weights)
            gradient = z.T @ (p - y) + 0.1 * self.weights
            hessian = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(z.shape[1])
            step = np.linalg.solve(hessian, gradient)
            self.weights -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(x), 1)), z, z * z / 8])

    @staticmethod
    def sigmoid(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -30, 30)))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        # einsum adds up in one order, however many rows come together: a document's logit doesn't depend on its batch.
        return np.clip(np.einsum("ij,j->i", self.expand(_matrix(texts)), self.weights), -20, 20) if texts else np.empty(0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Model | None:
    """The document model, from at most `rows` labelled documents; None without both classes among them."""
    wanted = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("double").alias("y")).filter("key IS NOT NULL AND y IS NOT NULL")
    wanted = stage(wanted.orderBy(F.xxhash64("key"), "key", "y").limit(rows), "label-sample")

    # One document stands for each labelled id, so an id that many documents share weighs no more than others.
    labelled = wanted.groupBy("key").agg(F.collect_list("y").alias("ys"))
    out = T.StructType([*wanted.select("key").schema, *T.StructType.fromDDL("hash long, x array<double>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = arrow_schema(out)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(_matrix(batch.column(2).to_pylist())), pa.list_(pa.float64()))], schema=fields)

    named = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("body")).join(F.broadcast(labelled.select("key")), "key")
    shapes = named.select("key", F.xxhash64("body").alias("hash"), "body").mapInArrow(run, out)
    firsts = shapes.groupBy("key").agg(F.min(F.struct("hash", "x")).alias("first"))
    # A row for each sampled label at most: bounded by its row number, and two numbers wide.
    sample = firsts.join(F.broadcast(labelled), "key").select("first.x", F.explode("ys").alias("y")).collect()
    y = np.array([r["y"] for r in sample])
    if len(np.unique(y)) < 2:
        return None
    order = np.lexsort(np.array([[*r["x"], r["y"]] for r in sample]).T)  # rows come in any order; sums don't depend on it
    return Model(np.array([r["x"] for r in sample])[order], y[order])


def _strength(n: Column, total: Column, mean: Column | float) -> Column:
    """By moments over places: how many documents the parent's mean is worth against a place's own.

    Between-place variance v of the true means, from the spread of the observed
    ones less what chance gives; a Beta prior has strength m(1-m)/v - 1.
    """
    mean = F.lit(mean) if isinstance(mean, float) else mean
    spread = F.sum(n * F.pow(total / n - mean, 2)) - F.sum(mean * (1 - mean)) + F.avg(mean * (1 - mean))
    weight = F.sum(n) - F.sum(n * n) / F.sum(n)
    between = F.when(weight > 0, F.greatest(spread / weight, F.lit(0.0))).otherwise(F.lit(0.0))
    m = F.avg(mean)
    return F.least(F.greatest(F.when(between > 1e-9, m * (1 - m) / between - 1).otherwise(F.lit(MOST_STRENGTH)), F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def posteriors(scored: DataFrame, host: str, path: str, probability: str) -> DataFrame:
    """Per (host, path): documents, and the posterior mean quality of host and path, with the prior and the strengths.

    One aggregation over the documents, combined in the map tasks (a hot host
    costs no more than any other); the rest works on one row a place.
    """
    paths = stage(
        scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.round(F.col(probability) * 1e9).cast("decimal(28,0)")).alias("units")),
        "places",
    ).withColumn("total", F.col("units").cast("double") / 1e9)
    prior = paths.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).first()
    prior = float(prior["total"] / prior["n"]) if prior["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"))
    host_strength = float(hosts.agg(_strength(F.col("host_n"), F.col("host_total"), prior)).first()[0] or MOST_STRENGTH)
    hosts = hosts.withColumn("host_posterior", (F.lit(prior * host_strength) + F.col("host_total")) / (F.lit(host_strength) + F.col("host_n")))
    hosts = stage(hosts, "hosts").withColumnRenamed("host", "of_host")
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host", "units")
    path_strength = float(paths.agg(_strength(F.col("n"), F.col("total"), F.col("host_posterior"))).first()[0] or MOST_STRENGTH)
    return stage(
        paths.select(
            "host", "path", F.lit(prior).alias("prior"), F.col("n").cast("long").alias("path_n"), F.col("host_n").cast("long").alias("host_n"), "host_posterior",
            ((F.lit(path_strength) * F.col("host_posterior") + F.col("total")) / (F.lit(path_strength) + F.col("n"))).alias("path_posterior"),
        ),
        "posteriors",
    )


def _logit(p: Column) -> Column:
    held = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(held / (1 - held))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality",
    threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS, keep: list[str] | None = None,
) -> DataFrame:
    """The kept columns of docs (all, if none are named) and a struct of verdicts, whose name is the frame's last column.

    The struct holds document_logit, prior, host_n, path_n, host_posterior,
    path_posterior, probability and keep. The texts are read twice - for the
    places, then for the verdicts - instead of being shuffled; the places join
    by their measured size.
    """
    keep = docs.columns if keep is None else keep
    model = fit(docs, labels, id_col, text_col, label_col, fit_rows)
    logit, host, path, verdict = fresh(docs.columns, "logit_", "host_", "path_", "verdict")

    @F.pandas_udf(T.DoubleType())
    def evidence(texts):
        import pandas as pd

        return pd.Series(model.logits(texts.tolist()) if model else np.zeros(len(texts)))

    # Else the optimizer evaluates it again below the join, for filters that it derives from the verdict's.
    evidence = evidence.asNondeterministic()

    # The columns are renamed by place, so that no name in docs can clash.
    read = docs.select(F.col(host_col).alias(host), F.col(path_col).alias(path), evidence(F.col(text_col)).alias(logit))
    chance = 1 / (1 + F.exp(-F.col(logit)))
    places = posteriors(read.select(F.col(host), F.col(path), chance.alias(logit)), host, path, logit)
    names = {c: f"{c}__of_place" for c in places.columns}
    places = places.select(*(F.col(c).alias(name) for c, name in names.items()))
    place = {c: F.col(name) for c, name in names.items()}
    scored = docs.select(*(F.col(c) for c in keep), F.col(host_col).alias(host), F.col(path_col).alias(path), evidence(F.col(text_col)).alias(logit))
    joined = scored.join(places, F.col(host).eqNullSafe(place["host"]) & F.col(path).eqNullSafe(place["path"]), "left")
    shift = F.least(F.greatest(_logit(place["path_posterior"]) - _logit(place["prior"]), F.lit(-MOST_SHIFT)), F.lit(MOST_SHIFT))
    probability = 1 / (1 + F.exp(-(F.col(logit) + shift)))
    return joined.select(
        *keep,
        F.struct(
            F.col(logit).alias("document_logit"), *(place[c].alias(c) for c in ("prior", "host_n", "path_n", "host_posterior", "path_posterior")),
            probability.alias("probability"), (probability >= threshold).alias("keep"),
        ).alias(verdict),
    )


def kept_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of docs that the classifier keeps, with their own columns."""
    judged = classify(docs, labels, **settings)
    return judged.filter(F.col(judged.columns[-1])["keep"]).select(*docs.columns)
