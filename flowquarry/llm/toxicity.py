"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the presence of words and of word beginnings. One weight per feature is
shared by all grades; ordered thresholds turn the score into P(grade >= k), whose sum
over k is the expected severity.

The labels only say toxic or not, so the grades to learn are made from the sample: 0 for
a clean document, and for a toxic one 1 to 3 by the thirds of how many markers it has, a
marker being a feature chosen for its excess in toxic documents.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.batches import text_function, text_of
from flowquarry.llm.sampling import labelled_sample
from flowquarry.session import settle

GRADES = 4
PER_CLASS = 8_000  # labelled rows of each class to fit on
FEATURES = 2_048  # features of the model
MIN_DOCUMENTS = 4  # of the sample that hold a feature
LEAST_Z = 3.0  # standard errors by which a feature's log odds must differ
LEAST_ODDS = 2.5  # and how far: words that are merely commoner in one language are no evidence
BEGINNINGS = (4, 5, 6)
CACHE_ENTRIES = 50_000  # tokens that a task remembers
CACHE_TOKEN = 64  # characters of the longest
WORD = re.compile(r"\w+")


def word_features(token: str) -> list[str]:
    """Features of one white-space token: its words, and ``^`` with their beginnings."""
    out = []
    for word in WORD.findall(token.lower()):
        out.append(word)
        out += ["^" + word[:n] for n in BEGINNINGS if len(word) >= n]
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by feature and the ordered thresholds of grades 1, 2, .."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def reaches(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, .. as columns."""
        return 1 / (1 + np.exp(np.clip(np.asarray(self.thresholds)[None, :] - scores[:, None], -500, 500)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, n_features: int, grades: np.ndarray, n_grades: int,
                steps: int = 400, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of P(y >= k) = s(w x - theta_k) by Adam, for 0/1 features at (rows, cols).

    Thresholds are theta_1 and positive steps, so they stay in order. Rows weigh the same, so that a text without
    any feature keeps the low chance that the sample gives it.
    """
    n = len(grades)
    params = np.zeros(n_features + n_grades - 1)
    params[n_features] = 1.0
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        score = np.bincount(rows, params[:n_features][cols], minlength=n)
        theta = params[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(params[n_features + 1:]))])
        # likelihood of the grade: a difference of two neighbouring cumulative probabilities
        up = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -500, 500)))
        above = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], axis=1)
        slope = above * (1 - above)
        at = np.arange(n)
        chance = np.maximum(above[at, grades] - above[at, grades + 1], 1e-9)
        by_score = -(slope[at, grades] - slope[at, grades + 1]) / chance
        by_theta = np.zeros((n, n_grades + 1))
        by_theta[at, grades] += slope[at, grades] / chance
        by_theta[at, grades + 1] -= slope[at, grades + 1] / chance
        by_theta = by_theta[:, 1:n_grades].sum(axis=0)
        gradient = np.zeros_like(params)
        gradient[:n_features] = np.bincount(cols, by_score[rows], minlength=n_features) / n + ridge * params[:n_features]
        gradient[n_features] = by_theta.sum() / n
        later = np.cumsum(by_theta[::-1])[::-1]
        gradient[n_features + 1:] = later[1:] * np.exp(params[n_features + 1:]) / n
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient * gradient
        params -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    theta = params[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(params[n_features + 1:]))])
    return params[:n_features], theta


def _sample_features(texts: list[str]) -> pa.Array:
    features, sketches = [], []
    for text in texts:
        found = sorted({f for t in set(text.split()) for f in word_features(t)})
        features.append(found)
        # near copies of one text would count its every word as evidence; they mostly share this sketch
        sketches.append(sorted((f for f in found if f[0] != "^"), key=lambda w: zlib.crc32(w.encode()))[:4])
    kind = pa.list_(pa.string())
    return pa.StructArray.from_arrays([pa.array(features, kind), pa.array(sketches, kind)], ["features", "sketch"])


_features = text_function("toxicity", "struct<features:array<string>,sketch:array<string>>", lambda: _sample_features)


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
                 per_class: int = PER_CLASS, features: int = FEATURES) -> OrdinalModel:
    """Model from at most ``per_class`` labelled documents of each class, near copies once.

    Without documents of both classes it has no features and calls nothing toxic.
    """
    classes = {"toxic": F.col(label) == 1, "clean": F.col(label) == 0}
    sample = labelled_sample(docs, labels, classes, per_class, key, text)
    read = sample.select("cls", _features("text").alias("f")).select("cls", "f.*")
    read = settle(read.dropDuplicates(["cls", "sketch"]).withColumn("row", F.monotonically_increasing_id()), "toxic-sample")
    sizes = {r.cls: r.n for r in read.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return OrdinalModel({}, (1.0, 2.0, 3.0))
    one = {c: F.sum((F.col("cls") == c).cast("int")) for c in sizes}
    counts = read.select("cls", F.explode("features").alias("feature")).groupBy("feature").agg(
        one["toxic"].alias("t"), one["clean"].alias("c")).filter(F.col("t") + F.col("c") >= MIN_DOCUMENTS)
    odds = {c: (F.col(n) + 0.5) / (F.lit(float(sizes[c])) - F.col(n) + 0.5) for c, n in (("toxic", "t"), ("clean", "c"))}
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    z = F.log(odds["toxic"] / odds["clean"]) / error
    counts = counts.withColumns({"odds": F.log(odds["toxic"] / odds["clean"]), "z": z})
    chosen = counts.filter((F.abs("z") >= LEAST_Z) & (F.abs("odds") >= LEAST_ODDS)).orderBy(F.desc(F.abs("z")), "feature").limit(features).collect()
    place = {r.feature: i for i, r in enumerate(chosen)}
    if not place:
        return OrdinalModel({}, (1.0, 2.0, 3.0))
    wanted = F.array(*[F.lit(f) for f in place])
    rows = read.select("row", "cls", F.array_intersect("features", wanted).alias("features")).orderBy("row").collect()
    markers = {r.feature for r in chosen if r.z > 0}
    marks = np.array([sum(f in markers for f in r.features) for r in rows])
    toxic = np.array([r.cls == "toxic" for r in rows])
    cuts = np.quantile(marks[toxic], [1 / 3, 2 / 3])
    grades = np.where(toxic, 1 + np.searchsorted(cuts, marks, side="left"), 0)
    at = np.array([(i, place[f]) for i, r in enumerate(rows) for f in r.features], dtype=np.int64).reshape(-1, 2)
    weights, theta = fit_ordinal(at[:, 0], at[:, 1], len(place), grades, GRADES)
    return OrdinalModel({f: float(weights[i]) for f, i in place.items()}, tuple(map(float, theta)))


class _Scorer:
    """Scores of texts; a task remembers which features of the model a token has."""

    def __init__(self, model: OrdinalModel):
        self.model, self.tokens = model, {}

    def features(self, token: str) -> tuple[str, ...]:
        found = self.tokens.get(token)
        if found is None:
            found = tuple(f for f in word_features(token) if f in self.model.weights)
            if len(self.tokens) < CACHE_ENTRIES and len(token) <= CACHE_TOKEN:
                self.tokens[token] = found
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        weights, features = self.model.weights, self.features
        return np.array([
            sum(weights[f] for f in sorted({f for found in map(features, set(t.split())) if found for f in found}))
            for t in texts], dtype=float)


NAMES = ("p_toxic", "expected_severity", "grade")


def _verdict(docs: DataFrame, model: OrdinalModel, text: str, least: float) -> DataFrame:
    """(row, verdict): the rows as they are, and what the model says of their texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def make():
        own, scorer = shared.value, _Scorer(shared.value)

        def score(texts: list[str]) -> pa.Array:
            reaches = own.reaches(scorer(texts))
            chance = reaches[:, 0].round(9)
            return pa.StructArray.from_arrays(
                [pa.array(chance), pa.array(reaches.sum(axis=1).round(9)), pa.array((reaches >= 0.5).sum(axis=1).astype("int32")),
                 pa.array(chance >= least)], [*NAMES, "is_toxic"])

        return score

    score = text_function("toxicity", "struct<p_toxic:double,expected_severity:double,grade:int,is_toxic:boolean>", make)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.withColumn("verdict", score(text_of(F.col("row"), text)))


def toxicity(docs: DataFrame, model: OrdinalModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with p_toxic = P(grade >= 1), expected_severity (0 to 3), grade and is_toxic (p_toxic >= least).

    A NULL or empty text has the score of no feature. Rows are scored where they are: NULL keys, ties and repeated rows
    are rows like others and get equal results; columns named like the results, in any case, are replaced, all others
    stay; an empty table stays empty. Whole texts are read in the map tasks, a few at a time, nothing is shuffled.
    """
    found = _verdict(docs, model, text, least)
    rest = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in (*NAMES, "is_toxic")]
    return found.select(*rest, *[F.col("verdict").getField(n).alias(n) for n in (*NAMES, "is_toxic")])


def drop_toxic(docs: DataFrame, model: OrdinalModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows called toxic; all columns stay as they are, whatever their names.

    NULL and empty texts stay, as do repeated rows that are not toxic; an empty table stays empty. Texts are read as by
    ``toxicity``, and held once.
    """
    return _verdict(docs, model, text, least).filter(~F.col("verdict.is_toxic")).select("row.*")
