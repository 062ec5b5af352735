"""Mixing documents to target weights of domains they belong to only in part.

A classifier fitted on the labelled table gives each document its probabilities of the
domains. Rates r >= 0 are then sought, one per document, so that the expected tokens of
each domain, sum of r * tokens * probability, match the targets in the sense of least squares
relative to the domains' sizes, with a slight pull of each rate towards 1.

The rates come from accelerated projected gradient steps. A step needs one number per
domain, the domain's excess, summed over all documents by Spark. A document's rate
follows from its own probabilities and the excesses of the earlier steps, so each task
works the rates out anew and none is stored: a lost task loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.batches import text_function, text_of
from flowquarry.llm.sampling import labelled_sample
from flowquarry.session import settle

PAIRS = 1 << 16  # features: all pairs of adjacent bytes
PER_CLASS = 2_000  # labelled rows of each domain to fit on
BYTES_AT_ONCE = 1 << 20
PULL = 1e-3
STEPS = 80
CLOSE = 2e-4  # largest excess of a domain, as a share of all tokens, at which the steps end
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


@dataclass(frozen=True)
class DomainModel:
    """Softmax regression on the shares of byte pairs."""

    domains: tuple[str, ...]
    weights: np.ndarray  # pairs x domains
    bias: np.ndarray

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (words between white space) and domain probabilities of each text, read whole."""
        raws = [t.encode() for t in texts]
        tokens = np.zeros(len(raws), dtype=np.int64)
        scores = np.tile(self.bias, (len(raws), 1))
        for i, raw in enumerate(raws):
            data = np.frombuffer(raw, dtype=np.uint8)
            total, pairs = np.zeros(len(self.domains)), max(len(data) - 1, 1)
            for start in range(0, len(data), BYTES_AT_ONCE):
                piece = data[max(start - 1, 0):start + BYTES_AT_ONCE]
                blank = SPACE[piece]
                tokens[i] += int((~blank[1:] & blank[:-1]).sum()) + int(start == 0 and not blank[0])
                codes = piece[:-1].astype(np.intp) << 8 | piece[1:]
                total += self.weights[codes].sum(axis=0, dtype=np.float64)
            scores[i] += total / pairs
        scores -= scores.max(axis=1, keepdims=True)
        chances = np.exp(scores)
        return tokens, chances / chances.sum(axis=1, keepdims=True)


def _pair_shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    codes, counts = np.unique(data[:-1].astype(np.int64) << 8 | data[1:], return_counts=True)
    return codes, counts / max(len(data) - 1, 1)


def _pair_lists(texts: list[str]) -> pa.Array:
    found = [_pair_shares(t) for t in texts]
    codes, shares = [c.tolist() for c, _ in found], [v.tolist() for _, v in found]
    return pa.StructArray.from_arrays([pa.array(codes, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["codes", "shares"])


_pairs = text_function("mixing", "struct<codes:array<int>,shares:array<float>>", lambda: _pair_lists)


def fit_softmax(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n_cols: int, n_classes: int,
                steps: int = 200, rate: float = 0.5, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by Adam; classes weigh the same in total."""
    used, cols = np.unique(cols, return_inverse=True)
    n = len(y)
    weight = (n / n_classes / np.maximum(np.bincount(y, minlength=n_classes), 1))[y][:, None] / n
    params = np.zeros((len(used) + 1, n_classes))
    first, second, onehot = np.zeros_like(params), np.zeros_like(params), np.eye(n_classes)[y]
    for step in range(1, steps + 1):
        score = np.stack([np.bincount(rows, values * params[cols, k], minlength=n) for k in range(n_classes)], axis=1) + params[-1]
        chance = np.exp(score - score.max(axis=1, keepdims=True))
        error = (chance / chance.sum(axis=1, keepdims=True) - onehot) * weight
        gradient = np.empty_like(params)
        for k in range(n_classes):
            gradient[:-1, k] = np.bincount(cols, values * error[rows, k], minlength=len(used))
        gradient[-1] = error.sum(axis=0)
        gradient += ridge * params
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient * gradient
        params -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-10)
    weights = np.zeros((n_cols, n_classes), dtype=np.float32)
    weights[used] = params[:-1]
    return weights, params[-1]


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], text: str = "text",
                key: str = "doc_id", per_class: int = PER_CLASS) -> DomainModel:
    """Classifier of ``domain``, an expression over ``labels``, from at most ``per_class`` rows of each domain.

    A domain without labelled rows gets next to no probability; without any labels all domains are equally likely.
    """
    sample = labelled_sample(docs, labels, {d: domain == d for d in domains}, per_class, key, text)
    found = sample.select("cls", "_key", _pairs("text").alias("p")).orderBy("_key", "cls").select("cls", "p.codes", "p.shares").toArrow()
    if not len(found):
        return DomainModel(tuple(domains), np.zeros((PAIRS, len(domains)), np.float32), np.zeros(len(domains)))
    found = found.combine_chunks()
    y = np.array([domains.index(c) for c in found["cls"].to_pylist()])
    lists = found["codes"].chunk(0)
    sizes = np.diff(lists.offsets.to_numpy())
    cols, values = lists.flatten().to_numpy().astype(np.int64), found["shares"].chunk(0).flatten().to_numpy().astype(float)
    del found, lists
    weights, bias = fit_softmax(np.repeat(np.arange(len(sizes)), sizes), cols, values, y, PAIRS, len(domains))
    seen = np.bincount(y, minlength=len(domains)) > 0
    return DomainModel(tuple(domains), weights, np.where(seen, bias, -50.0))


def quality_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled documents: their language, or ``low`` for those of low quality."""
    return labels.select("doc_id", "quality").join(docs.select("doc_id", "lang"), "doc_id").select(
        "doc_id", F.when(F.col("quality") == 0, "low").otherwise(F.col("lang")).alias("domain"))


@dataclass(frozen=True)
class MixingPlan:
    """What a document's rate follows from: step length, bounds, pull and the scaled excesses of all steps."""

    model: DomainModel
    length: float
    low: float
    high: float
    pull: float
    excesses: tuple[tuple[float, ...], ...] = ()

    def rates(self, chances: np.ndarray, ahead: bool = False) -> np.ndarray:
        """Rates after all steps (``ahead``: the point at which the next excess is to be taken)."""
        rate = point = np.clip(np.ones(len(chances)), self.low, self.high)
        pace = 1.0
        for excess in self.excesses:
            moved = np.clip(point - self.length * (chances @ np.asarray(excess) + self.pull * (point - 1)), self.low, self.high)
            faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            point = moved + (pace - 1) / faster * (moved - rate)
            rate, pace = moved, faster
        return point if ahead else rate


CHANCES = "n_tokens:bigint,chances:array<double>"


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))


def posteriors(docs: DataFrame, model: DomainModel, text: str = "text") -> Column:
    """struct(n_tokens, chances): rounded, so that they are the same wherever a text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pairs x domains numbers

    def make():
        def read(texts: list[str]) -> pa.Array:
            tokens, chances = shared.value.read(texts)
            return pa.StructArray.from_arrays([pa.array(tokens), _lists(chances.round(6))], ["n_tokens", "chances"])

        return read

    return text_function("mixing", f"struct<{CHANCES}>", make)(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def _matrix(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    return (batch["n_tokens"].to_numpy(zero_copy_only=False).astype(float),
            batch["chances"].flatten().to_numpy(zero_copy_only=False).reshape(-1, n))


def plan_mixture(docs: DataFrame, model: DomainModel, weights: dict[str, float], size: float | None = 1.0, text: str = "text",
                 low: float = 0.0, high: float = float("inf"), pull: float = PULL, steps: int = STEPS) -> MixingPlan:
    """Rates at which the domains' expected tokens are ``weights`` times ``size`` times the tokens of ``docs``.

    ``size`` None: the smallest size that no domain has to be thinned for. Weights are scaled to sum to 1;
    domains without one get 0. A target that no document can meet is missed by as little as possible.
    """
    n = len(model.domains)
    read = settle(docs.select(posteriors(docs, model, text).alias("p")).select("p.*").filter("n_tokens > 0"), "chances")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mass, chances = _matrix(batch, n)
            sums = np.concatenate([[mass.sum()], mass @ chances, ((chances * mass[:, None]).T @ chances).ravel()])
            yield pa.RecordBatch.from_pydict({"at": np.arange(len(sums), dtype=np.int32), "value": sums})

    sums = read.mapInArrow(moments, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    if not sums:
        return MixingPlan(model, 1.0, low, high, pull)
    values = np.array([r.value for r in sorted(sums, key=lambda r: r.at)])
    total, shares, gram = values[0], values[1:n + 1] / values[0], values[n + 1:].reshape(n, n) / values[0]
    wanted = np.array([weights.get(d, 0.0) for d in model.domains])
    wanted = wanted / wanted.sum()
    if size is None:
        size = float(np.max(shares[wanted > 0] / wanted[wanted > 0]))
    # relative to its size each domain bends the sum of squares alike, so few steps do
    scale = 1 / np.maximum(np.maximum(shares, wanted * size), 1e-4)
    length = 1 / (np.linalg.eigvalsh(gram * np.sqrt(np.outer(scale, scale)))[-1] + pull)
    plan, last = MixingPlan(model, length, low, high, pull), np.full(n, np.inf)
    for _ in range(steps):
        now = plan

        def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mass, chances = _matrix(batch, n)
                yield pa.RecordBatch.from_pydict({
                    "at": np.arange(n, dtype=np.int32), "value": (mass * now.rates(chances, ahead=True)) @ chances})

        found = read.mapInArrow(expected, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        excess = np.array([r.value for r in sorted(found, key=lambda r: r.at)]) / total - wanted * size
        if np.abs(excess).max() < CLOSE or np.abs(excess - last).max() < CLOSE / 50:
            break  # close enough, or as close as the bounds allow
        last = excess
        plan = MixingPlan(model, length, low, high, pull, (*plan.excesses, tuple((excess * scale).round(12).tolist())))
    return plan


def _decided(docs: DataFrame, plan: MixingPlan, text: str, key: str, seed: int) -> DataFrame:
    """(row, found, copies): the rows as they are, what the plan says of their texts, and how often each is to be taken."""
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def make():
        own = shared.value

        def decide(texts: list[str]) -> pa.Array:
            tokens, chances = own.model.read(texts)
            chances = chances.round(6)
            rates = np.where(tokens > 0, own.rates(chances), 1.0)
            domains = [own.model.domains[i] for i in chances.argmax(axis=1)]
            return pa.StructArray.from_arrays(
                [pa.array(tokens), _lists(chances), pa.array(domains, pa.string()), pa.array(rates.round(6))], ["n_tokens", "chances", "domain", "rate"])

        return decide

    decide = text_function("mixing", f"struct<{CHANCES},domain:string,rate:double>", make)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    value = text_of(F.col("row"), text)
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("row").getField(key).cast("string"), value), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.withColumn("found", decide(value)).withColumn("copies", F.floor(F.col("found.rate") + chance).cast("int"))


def mixing_rates(docs: DataFrame, plan: MixingPlan, text: str = "text", key: str = "doc_id", seed: int = 17) -> DataFrame:
    """``docs`` with n_tokens, domain (the likeliest), chances, rate and copies.

    copies is the rate rounded up or down by a hash of key and text, so that it has the rate as its mean. NULL and empty
    texts have no tokens and rate 1; a NULL key is a key like others; repeated rows get equal results, ties of domains go
    to the first; columns named like the results, in any case, are replaced, all others stay. Whole texts are read where
    they are, a few at a time; nothing is shuffled; an empty table stays empty.
    """
    names = ["n_tokens", "chances", "domain", "rate"]
    rest = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in (*names, "copies")]
    return _decided(docs, plan, text, key, seed).select(*rest, *[F.col("found").getField(n).alias(n) for n in names], "copies")


def mix(docs: DataFrame, plan: MixingPlan, text: str = "text", key: str = "doc_id", seed: int = 17) -> DataFrame:
    """``docs`` with each row as often as its ``copies`` by ``mixing_rates`` say; all columns stay as they are, whatever their names.

    NULL, empty and very long texts, NULL keys and repeated rows are rows like others; an empty table stays empty.
    """
    drawn = _decided(docs, plan, text, key, seed).filter("copies > 0")
    return drawn.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).select("row.*")
