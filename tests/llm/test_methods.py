"""Parts of the methods against plain versions of their definitions: the subsequence kernel and its machine, and the least determinant."""

import itertools
import math
import random

import numpy as np
import pytest

from tracemill.llm import quality, toxicity


def plain_vector(unit):
    """Gap-weighted subsequences of a unit between marks, by their letters, and the norm."""
    s, found, norm = f"\x02{unit}\x03", {}, 1e-9
    for i, j, k in toxicity.OFFSETS:
        for at in range(len(s) - k):
            key = (s[at], s[at + i], s[at + j], s[at + k])
            found[key] = found.get(key, 0.0) + toxicity.DECAY ** (k - 3)
            norm += toxicity.DECAY ** (2 * (k - 3))
    return found, norm**toxicity.POWER


def plain_kernel(u, v):
    (a, na), (b, nb) = plain_vector(u), plain_vector(v)
    return sum(x * b.get(k, 0.0) for k, x in a.items()) / (na * nb)


@pytest.fixture(scope="module")
def units():
    rng = random.Random(1)
    return ["a", "insult", "insullt", "i-n-s-u-l-t", "stupid", "stu pid", "été"] + ["".join(rng.choice("abcdeinst") for _ in range(rng.randint(1, 12))) for _ in range(40)]


def test_kernel_is_the_plain_one(units, monkeypatch):
    """With so many buckets that no two subsequences here share one."""
    monkeypatch.setattr(toxicity, "BITS", 25)
    space = toxicity.Landmarks(units[:15])
    found = space.kernel(units, step=7)
    want = np.array([[plain_kernel(u, v) for v in units[:15]] for u in units])
    assert np.allclose(found, want, atol=2e-4), np.abs(found - want).max()


def test_folded_weights_are_the_machine_on_landmarks(units):
    space, rng = toxicity.Landmarks(units[:15]), np.random.default_rng(2)
    weights = rng.normal(size=15)
    folded = toxicity.Subsequences(units).values(space.folded(weights))
    assert np.allclose(folded, space.kernel(units) @ weights, atol=2e-3)


def test_gapped_and_inserted_letters_stay_near(units):
    k = lambda u, v: plain_kernel(u, v) / math.sqrt(plain_kernel(u, u) * plain_kernel(v, v))
    assert k("insult", "insullt") > 3 * k("insult", "island") and k("insult", "in-sult") > 3 * k("insult", "island")


def test_machine_is_at_its_optimum():
    rng = np.random.default_rng(3)
    x, bad, fine = rng.normal(size=(60, 4)), rng.random(60), rng.random(60)
    w = toxicity.squared_hinge(x, bad, fine, penalty=0.05, rounds=60)

    def loss(w):
        value = x @ w[:-1] + w[-1]
        return (bad * np.maximum(0, 1 - value) ** 2 + fine * np.maximum(0, 1 + value) ** 2).sum() + 0.05 * (w[:-1] ** 2).sum() + 1e-3 * w[-1] ** 2

    for k, h in itertools.product(range(5), (1e-3, -1e-3)):
        step = np.zeros(5)
        step[k] = h
        assert loss(w + step) >= loss(w) - 1e-9


@pytest.mark.parametrize("seed", range(6))
def test_least_determinant_of_all_subsets(seed):
    """Twelve rows of which three lie far off: the starts and steps end at the determinant that trying every nine of them finds."""
    rng = np.random.default_rng(seed)
    d = len(quality.VECTOR)
    x = np.vstack([rng.normal(size=(9, d)) * 3, rng.normal(size=(3, d)) + 40])
    scale = quality.consistency(0.75, d)
    every = [quality.regular(x[list(s)].mean(axis=0), scale * np.cov(x[list(s)].T, bias=True)) for s in itertools.combinations(range(12), 9)]
    least = min(every, key=lambda e: e[2])
    found = quality.best_starts(x, 0.75)[0]
    assert found[2] == pytest.approx(least[2], abs=1e-6) and np.allclose(found[0], least[0])
    far = np.einsum("ij,jk,ik->i", x - found[0], found[1], x - found[0])
    assert far[9:].min() > quality.chi_square_quantile(quality.CONFIDENCE, d) > np.median(far[:9])


def test_toxicity_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, units string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 0


def test_toxicity_of_repeated_rows_and_ids(spark):
    rows = [(k % 40, f"fine words number {k % 40}" + (" idiot fool" if k % 4 == 0 else "")) for k in range(400)] + [(None, "idiot"), (None, None), (3, "other text under this id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(40)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels, max_units=200, landmarks=16)).collect()
    assert len(out) == len(rows) and len({round(r["score"], 9) for r in out if r["doc_id"] == 7}) == 1
