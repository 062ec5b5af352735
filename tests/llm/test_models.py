import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.llm.mixing import DomainModel, MixingPlan, fit_domains, fit_softmax, mix, mixing_rates, plan_mixture
from flowquarry.llm.toxicity import OrdinalModel, drop_toxic, fit_ordinal, fit_toxicity, toxicity, word_features
from tests.llm.data import WORDS, awkward_texts, frame

BAD = ["gromp", "vilth", "snurk", "drabble"]


def _labelled(n, seed):
    """Texts of which every fourth holds a few bad words; one of them is only ever seen with endings."""
    pick, rows = random.Random(seed), []
    for i in range(n):
        words = [pick.choice(WORDS) + pick.choice(["", "", "a", "o"]) for _ in range(pick.randint(10, 80))]
        if i % 4 == 0:
            for _ in range(pick.randint(1, 4)):
                bad = pick.choice(BAD)
                words.insert(pick.randrange(len(words)), bad + (pick.choice(["xa", "xe", "xi"]) if bad == "drabble" else pick.choice(["", ",", "."])))
        rows.append((i, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = _labelled(600, 1)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows] + [(None, 1), (99_999, 0)], "doc_id long, toxic int")
    return fit_toxicity(frame(spark, rows), labels)


def test_held_out_accuracy(spark, model):
    rows = _labelled(400, 2)
    found = {r.doc_id: r for r in toxicity(frame(spark, rows), model).collect()}
    wrong = [k for k, _ in rows if found[k].is_toxic != (k % 4 == 0)]
    assert len(wrong) <= 4
    by_bad = {k: len({w[:5] for w in t.split()} & {b[:5] for b in BAD}) for k, t in rows}
    severity = [np.mean([found[k].expected_severity for k, n in by_bad.items() if n == level]) for level in (0, 1, 2, 3)]
    assert severity == sorted(severity) and severity[0] < 0.5
    left = drop_toxic(frame(spark, rows), model)
    assert left.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(k for k in found if not found[k].is_toxic)


def test_scores_equal_brute_force(spark, model):
    rows = awkward_texts() + [(700, "Gromp! vilth snurk"), (701, "gromp " * 5000)]
    theta = np.array(model.thresholds)
    for r in toxicity(frame(spark, rows), model).collect():
        features = {f for w in (r.text or "").split() for f in word_features(w)}
        reaches = 1 / (1 + np.exp(theta - sum(model.weights.get(f, 0.0) for f in features)))
        assert r.expected_severity == pytest.approx(reaches.sum(), abs=1e-6) and r.is_toxic == (reaches[0] >= 0.5)
        assert r.grade == (reaches >= 0.5).sum()


def test_toxicity_without_labels(spark):
    rows = awkward_texts()
    empty = fit_toxicity(frame(spark, rows), spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty == OrdinalModel({}, (1.0, 2.0, 3.0))
    assert drop_toxic(frame(spark, rows), empty).count() == len(rows)
    assert toxicity(frame(spark, []), empty).collect() == []


def test_ordinal_thresholds_and_weights():
    pick = np.random.default_rng(3)
    x = pick.random((4000, 5)) < 0.4
    truth, cuts = np.array([3.0, 2.0, -2.0, 0.0, 1.0]), np.array([1.0, 2.5, 4.0])
    grades = (x @ truth + pick.logistic(size=4000) >= cuts[:, None]).sum(axis=0)
    rows, cols = np.nonzero(x)
    weights, theta = fit_ordinal(rows, cols, 5, grades, 4, steps=600, ridge=0.0)
    assert (np.diff(theta) > 0).all() and np.abs(weights - truth).max() < 0.5


def test_ordinal_gradient_by_differences():
    rows, cols, grades = np.array([0, 1, 2, 2]), np.array([0, 1, 0, 1]), np.array([0, 1, 2])
    weights, theta = fit_ordinal(rows, cols, 2, grades, 3, steps=3000, rate=0.02, ridge=0.1)

    def loss(w, t):
        s = np.bincount(rows, w[cols], minlength=3)
        assert t[1] > t[0]
        up = 1 / (1 + np.exp(t[None, :] - s[:, None]))
        above = np.concatenate([np.ones((3, 1)), up, np.zeros((3, 1))], axis=1)
        return -np.log(above[np.arange(3), grades] - above[np.arange(3), grades + 1]).mean() + 0.05 * (w ** 2).sum()

    best = loss(weights, theta)
    for i in range(2):
        for step in (-0.05, 0.05):
            assert loss(weights + step * np.eye(2)[i], theta) >= best - 1e-5
            assert loss(weights, theta + step * np.eye(2)[i]) >= best - 1e-5


DOMAINS = ["left", "right", "odd"]


def _domain_text(pick, domain):
    letters = {"left": "abcde", "right": "vwxyz", "odd": "#%&12"}[domain]
    return " ".join("".join(pick.choice(letters + "mn") for _ in range(5)) for _ in range(pick.randint(5, 60)))


def _domain_rows(n, seed):
    pick = random.Random(seed)
    return [(i, _domain_text(pick, DOMAINS[0 if i % 10 < 6 else 1 if i % 10 < 9 else 2])) for i in range(n)]


@pytest.fixture(scope="module")
def domains(spark):
    rows = _domain_rows(300, 5)
    labels = spark.createDataFrame([(k, DOMAINS[0 if k % 10 < 6 else 1 if k % 10 < 9 else 2]) for k, _ in rows], "doc_id long, domain string")
    return fit_domains(frame(spark, rows), labels, F.col("domain"), DOMAINS)


def test_domains_held_out(domains):
    rows = _domain_rows(200, 6)
    tokens, chances = domains.read([t for _, t in rows])
    assert tokens.tolist() == [len(t.split()) for _, t in rows]
    truth = [0 if k % 10 < 6 else 1 if k % 10 < 9 else 2 for k, _ in rows]
    assert (chances.argmax(axis=1) == truth).mean() >= 0.98
    assert np.allclose(chances.sum(axis=1), 1)


def test_rates_meet_targets(spark, domains):
    rows = _domain_rows(500, 7)
    weights = {"left": 0.3, "right": 0.5, "odd": 0.2}
    docs = frame(spark, rows)
    plan = plan_mixture(docs, domains, weights)
    found = mixing_rates(docs, plan).collect()
    total = sum(r.n_tokens for r in found)
    reached = sum(r.n_tokens * r.rate * np.array(r.chances) for r in found) / total
    assert np.abs(reached - [0.3, 0.5, 0.2]).max() < 2e-3 and min(r.rate for r in found) >= 0
    # the least squares solution with its pull, by dense projected gradient
    p, m = np.array([r.chances for r in found]), np.array([r.n_tokens for r in found]) / total
    scale = 1 / np.maximum(np.maximum(m @ p, [0.3, 0.5, 0.2]), 1e-4)
    r = np.ones(len(found))
    for _ in range(3000):
        r = np.maximum(0, r - 0.3 * (p @ (scale * ((m * r) @ p - [0.3, 0.5, 0.2])) + plan.pull * (r - 1)))
    assert np.abs((m * r) @ p - reached).max() < 3e-3
    counts = Counter(x.doc_id for x in mix(docs, plan).collect())
    assert counts == Counter({r.doc_id: r.copies for r in found if r.copies})
    assert all(abs(r.copies - r.rate) < 1 for r in found)


def test_every_document_stays_when_asked(spark, domains):
    rows = _domain_rows(200, 8) + awkward_texts()
    docs = frame(spark, rows)
    plan = plan_mixture(docs, domains, {"left": 0.4, "right": 0.4, "odd": 0.2}, size=None, low=1.0)
    left = mix(docs, plan)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {k for k, _ in rows}


def test_mixing_edges(spark, domains):
    none = fit_domains(frame(spark, awkward_texts()), spark.createDataFrame([], "doc_id long, domain string"), F.col("domain"), DOMAINS)
    _, chances = none.read(["any text", ""])
    assert np.allclose(chances, 1 / 3)
    empty = frame(spark, [])
    assert mixing_rates(empty, plan_mixture(empty, domains, {"left": 1.0})).collect() == []
    blank = frame(spark, [(1, None), (2, ""), (None, " ")])
    assert [r.rate for r in mixing_rates(blank, plan_mixture(blank, domains, {"left": 1.0})).collect()] == [1.0] * 3
    absent = plan_mixture(frame(spark, _domain_rows(50, 9)), none, {"left": 0.5, "right": 0.5}, steps=5)
    assert isinstance(absent, MixingPlan) and isinstance(absent.model, DomainModel)


def test_long_text_in_pieces(domains, monkeypatch):
    from flowquarry.llm import mixing
    text = " \n" + _domain_text(random.Random(1), "left") * 30 + "é"
    whole = domains.read([text, "a", ""])
    monkeypatch.setattr(mixing, "BYTES_AT_ONCE", 17)
    pieces = domains.read([text, "a", ""])
    assert (whole[0] == pieces[0]).all() and np.allclose(whole[1], pieces[1])


def test_softmax_fits():
    rows, cols = np.arange(90), np.arange(90) % 3
    weights, bias = fit_softmax(rows, cols, np.ones(90), np.arange(90) % 3, 3, 3)
    assert (weights + bias).argmax(axis=1).tolist() == [0, 1, 2]
